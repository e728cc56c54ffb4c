"""URL filters: host and path rules, and for urls without a rule a character language-model ratio.

Two variable-order Markov models are counted over all urls that a rule decides: one for allowed, one for
blocked.  Symbols are the letters, one for any digit, twelve marks and one for the rest, so a model of
``ORDER`` symbols has a fixed largest size.  The models read the whole url after ``://`` (A-Z lower-cased),
query string and fragment included; only host, path and rules stop at ``?`` and ``#``.  A context counts only if it was seen ``MIN_CONTEXT`` times;
else the next shorter one speaks, and every order is smoothed with the next shorter one (Witten-Bell).  The
score of a url is the difference of the two log-likelihoods divided by its length, and the threshold is
where the two kinds part best on rule-decided urls that were not counted.

Defined cases: a null url or one without ``://`` has empty host and path; the method then reads the whole
string, and a url without characters scores 0; if rules decide no url of one kind, the method gives the
other kind, and ``allow`` if there is neither; ids may be null or repeat; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textnp
from .common import ascii_lower, col, require

ORDER = 4
MIN_CONTEXT = 3
#: One in so many rule-decided urls is kept for the threshold; width of a score bin there.
HOLD, BIN = 5, 0.01

_MARKS = "-._/~%+=&?#:"
N_SYMBOLS = 1 + 26 + 1 + len(_MARKS)
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[ord("a"):ord("z") + 1] = np.arange(1, 27)
_SYMBOL[ord("0"):ord("9") + 1] = 27
_SYMBOL[[ord(c) for c in _MARKS]] = np.arange(28, 28 + len(_MARKS))


@dataclass(frozen=True)
class Rule:
    """``site`` is a host, a slash and the start of a path; it fits the host and its subdomains."""

    verdict: str
    site: str

    @property
    def host(self) -> str:
        return self.site.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.site.partition("/")[2]

    def fits(self) -> Column:
        host = F.col("host")
        return ((host == self.host) | host.endswith("." + self.host)) & F.col("path").startswith(self.path)


RULES = (Rule("allow", "com/"), Rule("block", "example.com/en/"), Rule("allow", "www.example.com/en/"),
         Rule("block", "net/es/"), Rule("block", "net/fr/"))


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` (A-Z lower-cased) and ``path``."""
    text = F.coalesce(col(url).cast("string"), F.lit(""))
    return (pages.withColumn("host", ascii_lower(F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1)))
            .withColumn("path", F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)))


def with_rule(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``rule`` and ``by_rule`` (its verdict) from the longest rule that fits; null if none does."""
    ordered = sorted(rules, key=lambda r: -len(r.site))
    pick = lambda value: F.coalesce(*[F.when(r.fits(), F.lit(value(r))) for r in ordered]) if ordered else F.lit(None).cast("string")
    return pages.withColumn("rule", pick(lambda r: r.site)).withColumn("by_rule", pick(lambda r: r.verdict))


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of the ORDER-gram that ends at each character, the text it is in); short contexts are padded."""
    data, offsets = textnp.text_bytes(column)
    n = np.diff(offsets)
    owner = np.repeat(np.arange(len(n)), n)
    symbols = _SYMBOL[data[offsets[0]:offsets[-1]]]
    place = np.arange(len(symbols)) - np.repeat(offsets[:-1] - offsets[0], n)
    out = symbols.copy()
    for back in range(1, ORDER):
        earlier = np.zeros(len(symbols), np.int64)
        earlier[back:] = symbols[:-back]
        out += np.where(place >= back, earlier, 0) * N_SYMBOLS ** back
    return out, owner


def count_grams(urls: DataFrame, by: str, text: str) -> dict[str, np.ndarray]:
    """Counts of every gram for each value of ``by``; tasks add up their own urls first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            found, owner = grams(batch.column(1))
            kinds = np.array(batch.column(0).to_pylist())[owner] if batch.num_rows else np.zeros(0, str)
            for kind in np.unique(kinds):
                seen[kind] = seen.get(kind, 0) + np.bincount(found[kinds == kind], minlength=N_SYMBOLS ** ORDER)
        for kind, counts in seen.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(at)), pa.array(at), pa.array(counts[at])], ["kind", "gram", "n"])

    found = (urls.select(col(by), col(text)).mapInArrow(run, "kind string, gram long, n long")
             .groupBy("kind", "gram").agg(F.sum("n").alias("n")).toPandas())  # at most N_SYMBOLS ** ORDER rows a kind
    out = {}
    for kind, rows in found.groupby("kind"):
        out[kind] = np.zeros(N_SYMBOLS ** ORDER)
        out[kind][rows["gram"]] = rows["n"]
    return out


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """log P(last symbol | the symbols before it) for every gram."""
    p = np.full(N_SYMBOLS, 1 / N_SYMBOLS)
    for order in range(1, ORDER + 1):
        seen = counts.reshape(-1, N_SYMBOLS ** order).sum(axis=0).reshape(-1, N_SYMBOLS)
        total, kinds = seen.sum(axis=1, keepdims=True), (seen > 0).sum(axis=1, keepdims=True)
        shorter = np.tile(p.reshape(-1, N_SYMBOLS), (len(seen) * N_SYMBOLS // p.size, 1))
        speaks = total >= (MIN_CONTEXT if order > 1 else 1)
        p = np.where(speaks, (seen + kinds * shorter) / np.maximum(total + kinds, 1), shorter).ravel()
    return np.log(p)


def score(urls: DataFrame, keep: list[str], text: str, ratio: np.ndarray) -> DataFrame:
    """``keep`` columns and ``score``, the mean of ``ratio`` over the grams of a url."""
    schema = T.StructType([*(urls.schema[c] for c in keep), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, owner = grams(batch.column(len(keep)))
            n = np.bincount(owner, minlength=batch.num_rows)
            mean = np.bincount(owner, ratio[found], batch.num_rows) / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(mean, pa.float64())], schema.names)

    return urls.select(*[col(c) for c in keep], col(text)).mapInArrow(run, schema)


def threshold(scored: DataFrame) -> float:
    """The score at and above which a url is allowed: the middle of the best cut by balanced accuracy."""
    bins = (scored.groupBy(F.floor(F.col("score") / BIN).alias("bin"), "by_rule").agg(F.count(F.lit(1)).alias("n")).toPandas())
    if bins.empty or bins["by_rule"].nunique() < 2:
        return 0.0
    table = bins.pivot_table(index="bin", columns="by_rule", values="n", fill_value=0).sort_index()
    at = table.index.to_numpy()
    passed = 1 - (table["allow"].cumsum() - table["allow"]).to_numpy() / table["allow"].sum()
    stopped = (table["block"].cumsum() - table["block"]).to_numpy() / table["block"].sum()
    best = int((passed + stopped).argmax())
    low = at[best - 1] + 1 if best else at[0]
    return float((low + at[best]) / 2 * BIN)


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, host, path, rule, verdict, score) for every url; the score is null where a rule decides."""
    require(pages, [page_id, url])
    raw = F.coalesce(col(url).cast("string"), F.lit(""))
    parts = with_rule(with_parts(pages.select(col(page_id).alias("__id"), col(url)), url), rules)
    parts = parts.withColumn("__text", ascii_lower(F.when(raw.contains("://"), F.regexp_extract(raw, r"(?s)^.*?://(.*)", 1)).otherwise(raw))).drop(url)
    decided = parts.filter("by_rule IS NOT NULL")
    held = F.pmod(F.xxhash64("__text"), F.lit(HOLD)) == 0
    counts = count_grams(decided.filter(~held), "by_rule", "__text")
    if len(counts) == 2:
        ratio = (log_probabilities(counts["allow"]) - log_probabilities(counts["block"])).astype(np.float32)
        least = threshold(score(decided.filter(held), ["by_rule"], "__text", ratio))
        method = F.when(F.col("score") >= least, F.lit("allow")).otherwise(F.lit("block"))
    else:
        ratio = np.zeros(N_SYMBOLS ** ORDER, np.float32)
        method = F.lit(next(iter(counts), "allow"))
    scored = score(parts, ["__id", "host", "path", "rule", "by_rule"], "__text", ratio)
    return scored.select(F.col("__id").alias(page_id), "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"),
                         F.when(F.col("by_rule").isNull(), F.col("score")).alias("score"))
