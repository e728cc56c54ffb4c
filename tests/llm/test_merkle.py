import collections
import hashlib
import zlib

import brute
import pytest
from pyspark.sql import functions as F

from poslake.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc, text, lang, source, n_chars):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n_chars, text)])


def levels(nodes, arity):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + arity]) for i in range(0, len(out[-1]), arity)])
    return out


def path(tree, at, arity):
    found = []
    for nodes in tree[:-1]:
        first = at - at % arity
        found.append((at - first, [x for k, x in enumerate(nodes[first:first + arity]) if first + k != at]))
        at //= arity
    return found


def brute_manifest(docs, arity=2, key=lambda r: r[2]):
    groups = collections.defaultdict(list)
    for r in docs:
        groups[key(r)].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[g] = levels([leaf(*r) for r in groups[g]], arity)
    crown = levels([trees[g][-1][0] for g in order], arity)
    out = []
    for g in order:
        for i, r in enumerate(groups[g]):
            steps = path(trees[g], i, arity) + path(crown, order.index(g), arity)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            node = leaf(*r[:4], r[4] + 1) if tampered else leaf(*r)
            for digit, others in steps:
                node = h(*others[:digit], node, *others[digit:])
            out.append((r[0], leaf(*r), trees[g][-1][0], crown[-1][0], h(*[x for _, s in steps for x in s]), node, node == crown[-1][0]))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


EDGES = [(1, "a", None, "s", 1), (None, None, None, None, None), (2, "", "", "", 0), (2, "", "", "", 0), (2, "b", "", "s", 3), (3, "é" * 5000, "en", "x", None),
         (-5, "t", "en", "y", 2), (14, "x", "zé", None, 9), (None, "q", "en", "y", 4)] + [(i, f"t{i}", "en", "s", i) for i in range(20, 60)]


def test_all_documents_against_recursion(spark, sf_dir):
    docs = brute.rows("documents", "doc_id", "text", "lang", "source", "n_chars")
    got = rows(merkle.manifest_table(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    assert got == brute_manifest(docs)
    assert {r[-1] for r in got} == {True, False}


def test_nulls_ties_repeated_rows_and_clashing_names(spark):
    df = spark.createDataFrame(EDGES, SCHEMA)
    for c in ("tree", "node", "n", "digest", "salt", "part", "leaf", "above"):
        df = df.withColumn(c, F.lit("x"))
    assert rows(merkle.manifest_table(df)) == brute_manifest(EDGES)


@pytest.mark.parametrize(("arity", "page_levels"), [(2, 2), (3, 1), (4, 3)])
def test_requests_descend_through_several_pages(spark, arity, page_levels):
    found = merkle.manifest(spark.createDataFrame(EDGES, SCHEMA), arity=arity, page_levels=page_levels)
    got = sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], h(bytes(r["proof"]).decode()), r["folded_root"] == r["root"]) for r in found.collect()), key=str)
    assert [r[:5] for r in got] == sorted([r[:5] for r in brute_manifest(EDGES, arity)], key=str)
    assert all(r[-1] for r in got)


def test_equal_pages_are_stored_once(spark):
    leaves = merkle.ranked(spark.createDataFrame([("g", "d" * 64)] * 64, "tree string, digest string"), ["digest"])
    assert sorted(r["node"] for r in leaves.collect()) == list(range(64))
    store = merkle.build(leaves, page_levels=2)
    assert [t.count() for t in store] == [16, 4, 1]
    assert merkle._addressed(store[0]).count() == 1


def test_one_row_and_no_rows(spark):
    assert rows(merkle.manifest_table(spark.createDataFrame(EDGES[:1], SCHEMA))) == brute_manifest(EDGES[:1])
    assert rows(merkle.manifest_table(spark.createDataFrame([], SCHEMA))) == []
