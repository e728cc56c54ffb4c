"""A Merkle manifest of a dataset: a content-addressed DAG, and membership proofs by descent through it.

Every row is a leaf.  The leaves of one group (a language) stand in order of their ids; runs of ``ARITY``
consecutive nodes become the SHA-256 of their digests until one is left, the subroot; the subroots, in order
of their groups, give the root in the same way.  A digest is lower-case hex text, and so is what is hashed.

The store keeps digest-to-children records, ``PAGE_LEVELS`` levels of them together in one row (a page,
addressed by the digest at its top; equal pages are stored once).  A request is (group, rank): it descends from
the root by the digits of its rank and collects the children that it doesn't select, a page for each group of
digits.  All requests below a page share their way to it, so the pages are descended first, from the
top: each knows the siblings above it when its own turn comes.  What one page gives is a path segment, root
first; reversed and put below the segment above it, it gives the siblings from the leaf upwards.

Ranks come from one range partitioning by (group, id), whose partitions are counted, so a group with a third of
all rows is no more work for one task than others; the largest thing a task holds is a page with its
requests (``ARITY ** PAGE_LEVELS`` leaves).

Defined cases: a null field is hashed as ``-`` and an empty one as ``0:``; rows with equal ids are ordered by
their digests, rows equal in everything are separate leaves; null ids come first in their group and null groups first of
all; an empty table has no rows and no root; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterable
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, materialise, require

ARITY = 2
#: Levels of digest-to-children records in one page: 1,024 nodes at its foot.
PAGE_LEVELS = 10
#: Bytes of a digest as hex text.
WIDTH = 64
#: Fields of a leaf, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PAGE = "tree string, page long, digest string, parents binary, fans binary, children binary"
_ABOVE = "tree string, node long, digest string, above binary"


def digest(parts: Iterable[bytes]) -> bytes:
    return sha256(b"".join(parts)).hexdigest().encode()


def cut_digests(packed: bytes) -> list[bytes]:
    return [packed[i:i + WIDTH] for i in range(0, len(packed), WIDTH)]


def raise_levels(nodes: list[bytes], levels: int, arity: int = ARITY) -> tuple[bytes, dict[bytes, list[bytes]]]:
    """The top of ``nodes`` after ``levels`` levels, and the digest-to-children records made on the way."""
    records: dict[bytes, list[bytes]] = {}
    for _ in range(levels):
        runs = [nodes[i:i + arity] for i in range(0, len(nodes), arity)]
        nodes = [digest(run) for run in runs]
        records.update(zip(nodes, runs, strict=True))
    return nodes[0], records


def descend(top: bytes, records: dict[bytes, list[bytes]], rank: int, levels: int, arity: int = ARITY) -> tuple[bytes, list[bytes]]:
    """From ``top`` down by the digits of ``rank``: the node reached, and the unselected children, lowest level
    first."""
    segment: list[list[bytes]] = []
    at = top
    for level in reversed(range(levels)):
        children = records[at]
        digit = rank // arity ** level % arity
        segment.append(children[:digit] + children[digit + 1:])
        at = children[digit]
    return at, [sibling for siblings in reversed(segment) for sibling in siblings]


def levels_of(n: int, arity: int = ARITY) -> int:
    """Levels above ``n`` nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // arity), levels + 1
    return levels


def fold(node: bytes, siblings: list[bytes], sizes: Iterable[tuple[int, int]], arity: int = ARITY) -> bytes:
    """The root that ``node`` and its ``siblings`` give.  ``sizes`` says for each tree on the way, lowest first,
    the node's rank in it and its number of nodes; they tell where a run is short."""
    at = 0
    for rank, n in sizes:
        while n > 1:
            digit, first = rank % arity, rank - rank % arity
            others = min(arity, n - first) - 1
            run = siblings[at:at + others]
            node = digest([*run[:digit], node, *run[digit:]])
            at, rank, n = at + others, rank // arity, -(-n // arity)
    return node


def leaf_digest(fields: list[Column]) -> Column:
    def framed(field: Column) -> Column:
        value = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))
    return F.sha2(F.concat(*map(framed, fields)), 256)


def ranked(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` with the long ``node``, the rank within ``tree``, and ``n``, the tree's number of leaves.

    Equal rows may fall into different partitions: they are told apart by where they were read."""
    leaves = leaves.withColumn("salt", F.monotonically_increasing_id())
    keys = ["tree", *order, "salt"]
    # written once: range bounds are sampled anew for each run
    placed = materialise(leaves.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("salt").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    placed = placed.withColumn("part", part)
    runs = placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    tree = Window.partitionBy("tree")
    before = runs.select("tree", "part", "first", F.sum("rows").over(tree).alias("n"),
                         (F.sum("rows").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows")).alias("before"))
    return placed.join(before, ["tree", "part"]).withColumn("node", F.col("before") + F.col("at") - F.col("first")).drop("at", "part", "first", "before")


def _pages(nodes: DataFrame, arity: int, page_levels: int, below: int) -> DataFrame:
    """The pages above ``nodes`` (tree, node, digest, n: the tree's leaves), which lie ``below`` levels up."""
    size = arity ** page_levels

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        levels = min(page_levels, max(0, levels_of(int(pdf["n"].iloc[0]), arity) - below))
        top, records = raise_levels([d.encode() for d in pdf["digest"]], levels, arity)
        row = (key[0], key[1], top.decode(), b"".join(records), bytes(map(len, records.values())), b"".join(d for run in records.values() for d in run), pdf["n"].iloc[0])
        return pd.DataFrame([row], columns=["tree", "page", "digest", "parents", "fans", "children", "n"])

    keyed = nodes.select("tree", "node", "digest", "n", F.floor(F.col("node") / size).cast("long").alias("page"))
    return keyed.groupBy("tree", "page").applyInPandas(build, f"{_PAGE}, n long")


def build(leaves: DataFrame, arity: int = ARITY, page_levels: int = PAGE_LEVELS) -> list[DataFrame]:
    """The store of all trees in ``leaves`` (tree, node, digest, n), one table of pages for each range of levels,
    lowest first; each table is written to the shared checkpoint folder."""
    store = []
    while True:
        nodes = leaves if not store else store[-1].select("tree", F.col("page").alias("node"), "digest", "n")
        store.append(materialise(_pages(nodes, arity, page_levels, len(store) * page_levels)))
        if store[-1].filter("page > 0").isEmpty():
            return store


def _records(parents: bytes, fans: bytes, children: bytes) -> dict[bytes, list[bytes]]:
    found, at, kids = {}, 0, cut_digests(children)
    for parent, fan in zip(cut_digests(parents), fans, strict=True):
        found[parent] = kids[at:at + fan]
        at += fan
    return found


def _levels(records: dict[bytes, list[bytes]], top: bytes) -> int:
    levels = 0
    while top in records:
        top, levels = records[top][0], levels + 1
    return levels


def _addressed(pages: DataFrame) -> DataFrame:
    """The page records by their address; equal pages count once."""
    return pages.groupBy("digest").agg(*[F.any_value(c).alias(c) for c in ("parents", "fans", "children")])


def descend_pages(store: list[DataFrame], tops: DataFrame, arity: int = ARITY, page_levels: int = PAGE_LEVELS) -> DataFrame:
    """For each page of the lowest table: ``above``, the siblings between its top and the root, lowest first.
    ``tops`` holds that (tree, node 0, digest, above) for the top page of each tree.  Each tree has a page in every
    table; that of a short tree has no records from the table on in which its subroot is at the foot."""
    size = arity ** page_levels
    above = tops
    for below, pages in zip(reversed(store[:-1]), reversed(store[1:]), strict=True):
        counts = below.groupBy("tree").agg(F.count("*").alias("under"))

        def down(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
            for batch in batches:
                for row in batch.itertuples():
                    top = row.digest.encode()
                    records = _records(row.parents, row.fans, row.children)
                    levels, first = _levels(records, top), row.node * size
                    out = []
                    for node in range(first, min(first + size, row.under)):
                        at, segment = descend(top, records, node - first, levels, arity)
                        out.append((row.tree, node, at.decode(), b"".join(segment) + row.above))
                    yield pd.DataFrame(out, columns=["tree", "node", "digest", "above"])

        # one row for each page, and a page's requests at a time, so nothing is held beyond a page
        above = materialise(above.join(counts, "tree").join(_addressed(pages), "digest").mapInPandas(down, _ABOVE))
    return above


def prove(requests: DataFrame, store: list[DataFrame], above: DataFrame, arity: int = ARITY, page_levels: int = PAGE_LEVELS) -> DataFrame:
    """For requests (tree, node, and other columns): with ``proof`` (binary, the siblings from the leaf to the
    root as joined hex digests)."""
    size = arity ** page_levels
    names = requests.columns
    schema = T.StructType([*requests.schema, T.StructField("proof", T.BinaryType())])

    def answer(asked: pd.DataFrame, pages: pd.DataFrame) -> pd.DataFrame:
        page = pages.iloc[0]
        top, records = page["digest"].encode(), _records(page["parents"], page["fans"], page["children"])
        levels = _levels(records, top)
        out = asked[names].copy()
        out["proof"] = [b"".join(descend(top, records, int(node) % size, levels, arity)[1]) + page["above"] for node in asked["node"]]
        return out

    keyed = requests.withColumn("__page", F.floor(F.col("node") / size).cast("long"))
    ways = above.join(_addressed(store[0]), "digest")
    return keyed.groupBy("tree", "__page").cogroup(ways.groupBy("tree", "node")).applyInPandas(answer, schema)


def group_tag(group: Column) -> Column:
    """Groups as text that is never null and keeps their order, null first."""
    return F.coalesce(F.concat(F.lit("1"), group.cast("string")), F.lit("0"))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, doc_id: str = "doc_id", group: str = "lang", tamper: Column | None = None,
             tampered_fields: dict[str, Column] | None = None, arity: int = ARITY, page_levels: int = PAGE_LEVELS) -> DataFrame:
    """One row for each document: id, ``leaf``, ``subroot``, ``root``, ``proof`` (binary, joined siblings), and the root
    folded from the leaf, ``folded_root``.  Where ``tamper`` holds, that leaf is made from ``tampered_fields``
    instead, as a check that a change shows."""
    require(docs, (*fields, doc_id, group))
    leaf = leaf_digest([col(c) for c in fields])
    other = leaf_digest([(tampered_fields or {}).get(c, col(c)) for c in fields])
    leaves = ranked(docs.select(group_tag(col(group)).alias("tree"), col(doc_id).alias("id"), leaf.alias("digest"),
                                (F.when(tamper, other).otherwise(leaf) if tamper is not None else leaf).alias("shown")), ["id", "digest"])
    leaves = materialise(leaves)
    store = build(leaves.select("tree", "node", "digest", "n"), arity, page_levels)
    subroots = store[-1].select(F.col("tree").alias("group"), F.col("digest"))
    tops = materialise(ranked(subroots.select(F.lit("").alias("tree"), "group", "digest"), ["group"]))
    crown = build(tops.select("tree", "node", "digest", "n"), arity, page_levels)
    top = crown[-1].select("tree", F.lit(0).cast("long").alias("node"), "digest", F.lit(b"").alias("above"))
    root = next((row["digest"] for row in top.collect()), None)  # one row, or none without leaves
    proved = prove(tops, crown, descend_pages(crown, top, arity, page_levels), arity, page_levels)
    # one row for each group, with the place of its subroot
    ways = materialise(proved.select(F.col("group").alias("tree"), F.col("digest").alias("subroot"), F.lit(root).alias("root"), F.col("proof").alias("above"),
                                     F.col("node").alias("group_node"), F.col("n").alias("groups")))
    above = descend_pages(store, ways.select("tree", F.lit(0).cast("long").alias("node"), F.col("subroot").alias("digest"), "above"), arity, page_levels)
    found = prove(leaves, store, above, arity, page_levels).join(ways.drop("above"), "tree")

    @F.pandas_udf("string")
    def folded(shown: pd.Series, proof: pd.Series, node: pd.Series, n: pd.Series, group_node: pd.Series, groups: pd.Series) -> pd.Series:
        rows = zip(shown, proof, node, n, group_node, groups, strict=True)
        return pd.Series([fold(s.encode(), cut_digests(p), [(a, b), (c, d)], arity).decode() for s, p, a, b, c, d in rows], dtype=object)

    return found.select(F.col("id").alias(doc_id), F.col("digest").alias("leaf"), "subroot", "root", "proof",
                        folded("shown", "proof", "node", "n", "group_node", "groups").alias("folded_root"))


def manifest_table(docs: DataFrame) -> DataFrame:
    """The digest form of the manifest of ``documents``; documents whose id's CRC-32 divides by 7 are shown with
    one more in ``n_chars``."""
    found = manifest(docs, tamper=F.pmod(F.crc32(col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0,
                     tampered_fields={"n_chars": col("n_chars").cast("long") + 1})
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(F.col("proof"), 256).alias("proof_sha256"), "folded_root",
                        (F.col("folded_root") == F.col("root")).alias("verified"))
