"""Line dedup by site-relative frequency, in DataFrame functions only.

A line is boilerplate on its host when more than ``ratio`` of the host's pages hold it, and at least
``min_pages`` of them do; pages lose their boilerplate lines.  Pages of equal text count as one, so a
copied page does not turn its own lines into boilerplate.

Defined cases: blank lines are never dropped; a null host is a host of its own; a null text stays null
and is no page; a page that holds a line twice counts once; repeated rows are one page and all of them
lose the same lines; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, require

#: A line with anything but white space; other lines are blank and stay.
WORDED = r"[^\x09-\x0D\x20]"
RATIO = 0.05
MIN_PAGES = 3
SALTS = 16


def _line_key(host: Column, line: Column) -> Column:
    return F.xxhash64(host, line)


def _worded(line: Column) -> Column:
    return line.rlike(WORDED)


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, key): the lines that exceed the ratio.

    Distinct pages are counted in two steps, first by (host, line, page), so a line on a third of all pages
    is spread over all tasks and then comes as partial counts.  Only lines on ``min_pages`` pages or more meet
    the host totals."""
    site = pages.filter(col(text).isNotNull()).select(
        F.struct(col(host).alias("v")).alias("__host"), col(text).alias("__text"))
    site = site.withColumn("__page", F.xxhash64("__host", "__text"))
    keys = F.array_distinct(F.transform(F.filter(F.split("__text", "\n"), _worded),
                                        lambda x: _line_key(F.col("__host"), x)))
    counts = (site.select("__host", "__page", F.explode(keys).alias("__line")).groupBy("__host", "__line")
              .agg(F.count_distinct("__page").alias("__n")).filter(F.col("__n") >= min_pages))
    totals = site.groupBy("__host").agg(F.count_distinct("__page").alias("__pages"))
    return counts.join(totals, "__host").filter(F.col("__n") > ratio * F.col("__pages")).select("__host", "__line")


def dedup_lines(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO,
                min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` with boilerplate lines gone from ``text``, and ``__lines``, ``__dropped`` (counts).

    What a page loses depends on its host and text alone, so that pair (as a hash) is the key of the last
    join; both joins are salted, for a line or a copied page may make up a third of all rows."""
    require(pages, [host, text])
    site = pages.select("*", F.struct(col(host).alias("v")).alias("__host"))
    site = site.withColumn("__page", F.xxhash64("__host", col(text)))
    keys = F.array_distinct(F.transform(F.filter(F.split(col(text), "\n"), _worded),
                                        lambda x: _line_key(F.col("__host"), x)))
    salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("__salt")
    bad = boilerplate(pages, host, text, ratio, min_pages).select("__line", salts)
    lines = site.select("__page", F.explode(keys).alias("__line")).withColumn(
        "__salt", F.pmod(F.col("__page"), F.lit(SALTS)).cast("int"))
    drops = (lines.join(bad, ["__line", "__salt"], "left_semi").groupBy("__page")
             .agg(F.collect_set("__line").alias("__drop"))).select("__page", "__drop", salts)
    others = [col(c) for c in pages.columns if c != text]  # copies of a page differ in their ids
    row_salt = F.pmod(F.xxhash64(*others), F.lit(SALTS)).cast("int")
    met = site.withColumn("__salt", row_salt).join(drops, ["__page", "__salt"], "left")
    parts = F.split(col(text), "\n")
    kept = F.filter(parts, lambda x: ~_worded(x) | ~F.array_contains("__drop", _line_key(F.col("__host"), x)))
    total = F.coalesce(F.size(parts), F.lit(0))
    total = F.when(col(text).isNull(), F.lit(0)).otherwise(total).cast("long")
    out = met.withColumn("__kept", F.when(F.col("__drop").isNotNull(), kept))
    dropped = F.when(F.col("__kept").isNull(), F.lit(0)).otherwise(total - F.size("__kept")).cast("long")
    out = out.withColumn("__lines", total).withColumn("__dropped", dropped)
    out = out.withColumn(text, F.when(F.col("__kept").isNull(), col(text)).otherwise(F.array_join("__kept", "\n")))
    return out.select(*[col(c) for c in pages.columns], "__lines", "__dropped")


def line_table(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, source, the text that is left, n_lines, n_dropped."""
    out = dedup_lines(docs.select("doc_id", "source", "text"))
    return out.select("doc_id", "source", "text", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"))


ORACLE_SQL = f"""
WITH lines AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
counted AS (
  SELECT source, line, count(DISTINCT text) AS n FROM lines WHERE regexp_matches(line, '{WORDED}') GROUP BY ALL),
totals AS (SELECT source, count(DISTINCT text) AS pages FROM documents GROUP BY ALL),
bad AS (
  SELECT counted.source, line FROM counted JOIN totals ON counted.source IS NOT DISTINCT FROM totals.source
  WHERE n >= {MIN_PAGES} AND n > {RATIO} * pages),
marked AS (
  SELECT lines.*, bad.line IS NOT NULL AS is_bad
  FROM lines LEFT JOIN bad ON lines.source IS NOT DISTINCT FROM bad.source AND lines.line = bad.line),
kept AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT is_bad), '') AS left_text,
         count(*) AS n_lines, count(*) FILTER (is_bad) AS n_dropped
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, d.source, CASE WHEN d.text IS NULL THEN NULL ELSE left_text END AS text,
       coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped
FROM documents d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
