import random
from pathlib import Path

import brute
import numpy as np
import pytest

from poslake.llm import common, components, partenum

DOCS = "doc_id long, text string, class string, sign int"


def _run(spark, docs):
    rows = spark.createDataFrame([(*d, "c", 1) for d in docs], DOCS).repartition(5)
    return partenum.near_duplicates(rows).collect()


def _edited(seed, groups=60):
    pick, out = random.Random(seed), []
    words = [f"w{k}" for k in range(300)]
    for _ in range(groups):
        base = [pick.choice(words) for _ in range(pick.choice([3, 5, 6, 7, 8, 9, 10, 12, 15, 20, 40, 120]))]
        for _ in range(pick.choice([1, 2, 5, 12])):
            w = list(base)
            for _ in range(pick.choice([0, 0, 1, 1, 2, 3])):
                k, kind = pick.randrange(len(w)), pick.random()
                if kind < 0.5:
                    w[k] = pick.choice(words)
                elif kind < 0.75:
                    w.insert(k, pick.choice(words))
                elif len(w) > 1:
                    del w[k]
            out.append((len(out), pick.choice([" ", "\n"]).join(w)))
    n = len(out)
    return out + [(n, None), (n + 1, ""), (n + 2, "  "), (n + 3, "a"), (n + 4, "A"), (n + 5, "a b"), (n + 6, "a b")]


@pytest.mark.parametrize("way", ["", "salted", "blocks"])
def test_equals_brute_force(spark, monkeypatch, way):
    if way == "salted":  # every signature is salted
        monkeypatch.setattr(partenum.np, "median", lambda x: -10 ** 6)
    if way == "blocks":
        monkeypatch.setattr(partenum, "LISTED_PAIRS", 0)
        monkeypatch.setattr(partenum, "BLOCK_SHINGLES", 30)
    docs = _edited(5 if way != "salted" else 6)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in _run(spark, docs)}
    assert got == brute.components(docs)


def test_driver_tables(spark):
    docs = brute.rows("documents", "doc_id", "text")
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in _run(spark, docs)} == brute.components(docs)


def test_similar_sets_share_a_signature():
    pick, join = np.random.default_rng(7), partenum.Join()
    frequency = pick.integers(0, 50, partenum.SLOTS)
    for _ in range(1500):
        size = int(pick.choice([1, 2, 3, 4, 5, 6, 7, 9, 12, 20, 50, 200]))
        a = np.unique(pick.integers(0, 1 << 63, size, dtype=np.uint64))
        lost, new = pick.integers(0, size // 5 + 2, 2)
        b = np.unique(np.concatenate((a[:max(1, len(a) - lost)], pick.integers(0, 1 << 63, new, dtype=np.uint64))))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 75 * (len(a) + len(b) - both):
            assert np.intersect1d(*(partenum.signatures(s, join, frequency)[0] for s in (a, b))).size, (len(a), len(b), both)


def test_a_dense_group_of_near_copies(spark, monkeypatch):
    pick = random.Random(9)
    base, docs = [f"b{k}" for k in range(60)], []
    for i in range(150):
        w = list(base)
        for _ in range(pick.randint(0, 6)):
            w[pick.randrange(len(w))] = f"x{pick.randrange(10 ** 6)}"
        docs.append((i, " ".join(w)))
    monkeypatch.setattr(partenum, "BLOCK_SHINGLES", 2000)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in _run(spark, docs)} == brute.components(docs)


def test_shared_counts_and_bounds():
    pick = np.random.default_rng(1)
    sets = [np.unique(pick.integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False) if n < 400 else pick.choice(pool, n))
            for pool in [pick.integers(0, 1 << 64, 900, dtype=np.uint64, endpoint=False)] for n in (1, 3, 40, 700, 800, 5000)]
    both = partenum._shared(sets[:4], sets)
    for i, a in enumerate(sets[:4]):
        for j, b in enumerate(sets):
            n = len(np.intersect1d(a, b))
            assert both[i, j] == n <= partenum.most_shared(partenum.cell_counts(a), partenum.cell_counts(b))
    assert partenum.most_shared(bytes([255] * 16), bytes([255] * 16)) == np.inf


def test_repeated_and_missing_ids(spark):
    got = _run(spark, [(4, "a b"), (4, "a b"), (None, "a b"), (None, "x"), (9, None)])
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 4), (4, 4), (4, 4), (9, 9)]
    assert _run(spark, []) == []


def test_one_of_each_group_stays(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(5, base), (3, base), (8, base + " end"), (1, "else"), (7, None), (2, ""), (1, "else"), (None, "else"), (None, "alone")]
    kept = partenum.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text or "")[:2] for r in kept) == [(0, "alone"), (1, "else"), (2, ""), (3, base), (7, "")]


def test_components_of_chains_and_stars(spark):
    pick = random.Random(3)
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    loose = [(pick.randint(200, 260), pick.randint(200, 260)) for _ in range(40)]
    links = chain + star + loose
    pick.shuffle(links)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_links_take_few_tasks(spark):
    """Steps over few rows take few tasks, however many partitions a shuffle has: each task writes files of its own."""
    pick, sc = random.Random(4), spark.sparkContext
    links = spark.createDataFrame([(pick.randint(0, 300), pick.randint(0, 300)) for _ in range(200)], "a long, b long")
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        sc.setJobGroup("few links", "")
        components.components(links)
        jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("few links")]
        tasks = sum(sc.statusTracker().getStageInfo(s).numTasks for s in {s for j in jobs for s in j.stageIds})
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < tasks < 2000


def test_fitted_counts_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "TASK_ROWS", 10)
    rows = common.fitted(spark.range(0, 35, 1, 8))
    assert rows.rdd.getNumPartitions() == 4 and {r.id for r in rows.collect()} == set(range(35))
    assert common.fitted(spark.range(0)).count() == 0


def test_fitted_writes_as_many_files_as_rows_ask_for(spark):
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = set(folder.rglob("part-*"))
    rows = common.fitted(spark.range(0, 640, 1, 64))
    assert rows.count() == 640 and len(set(folder.rglob("part-*")) - before) == 1
    assert common.fitted(spark.range(0, 640, 1, 64), 100).rdd.getNumPartitions() == 7
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()
