import random

import brute

from poslake.llm import decontam

DOCS, ITEMS = "doc_id long, text string, key string, pos int", "item_id long, text string, term string"


def _run(spark, docs, items):
    d = spark.createDataFrame([(*x, "k", 1) for x in docs], DOCS).repartition(4)
    return decontam.decontaminate(d, spark.createDataFrame([(*x, "t") for x in items], ITEMS)).collect()


def _some():
    pick, words = random.Random(2), ["aa", "Bb", "c9", "é", "dd", "ee"]
    items = [(i, " ".join(pick.choices(words, k=pick.choice([1, 2, 3, 5, 13, 14, 20])))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "..."), (53, "aa"), (54, "aa")]
    more = words + [f"zz{k}" for k in range(20)]
    docs = [(i, pick.choice([" ", "-", "\n"]).join(pick.choices(more, k=pick.randint(0, 60)))) for i in range(120)]
    docs += [(200 + i, f" q{i} {items[i][1]} tail {items[i * 5 % 12][1]}") for i in range(12)]
    return docs + [(300, None), (301, ""), (302, items[3][1]), (303, items[3][1])], items


def test_equals_brute_force(spark):
    docs, items = _some()
    assert {tuple(r)[:6] for r in _run(spark, docs, items)} == brute.contaminated(docs, items)


def test_driver_tables(spark):
    docs, items = brute.rows("documents", "doc_id", "text"), brute.rows("benchmark", "item_id", "text")
    want = brute.contaminated(docs, items)
    assert {tuple(r)[:6] for r in _run(spark, docs, items)} == want and any(r[2] for r in want)


def test_empty_sides_and_repeated_ids(spark):
    docs, items = _some()
    assert all(r.n_hit == 0 and not r.contaminated for r in _run(spark, docs, []))
    assert _run(spark, [], items) == []
    got = _run(spark, [(1, "aa"), (1, "aa"), (None, "aa"), (None, None)], [(7, "aa"), (None, "aa"), (8, "bb")])
    assert sorted((r.doc_id or 0, r.n_hit, r.n_items) for r in got) == [(0, 0, 0), (0, 1, 1), (1, 1, 1), (1, 1, 1)]


def test_proximity_allows_a_gap(spark):
    item = " ".join(f"w{i}" for i in range(13))
    gap = item.replace("w6", "w6 extra")
    far = " ".join(f"w{i} x x x x x x x x x" for i in range(13))
    got = {r.doc_id: r for r in _run(spark, [(1, item), (2, gap), (3, far)], [(1, item)])}
    assert [(got[i].n_hit, got[i].n_near) for i in (1, 2, 3)] == [(13, 1), (0, 1), (0, 0)]


def test_every_alignment_counts_for_proximity(spark):
    rest = " ".join("defghijklm")  # the fillers make a, b and c the rarest
    docs = [(1, f"a x b c {rest}"), (2, f"a x b x c {rest}"), (3, f"a x x x b x x c {rest}"), (4, "a a a a z z a"), (5, "a y b"),
            (6, "a y b"), (7, "b a y"), (8, "b c a"), (9, f"a b c {rest}")] + [(10 + i, "a y") for i in range(8)]
    got = {r.doc_id: r for r in _run(spark, docs + [(20 + i, rest) for i in range(60)], [(1, f"a b c {rest}")])}
    assert [got[i].n_near for i in range(1, 10)] == [1, 1, 0, 0, 0, 0, 0, 1, 1]
    assert [got[i].n_hit for i in range(1, 10)] == [0] * 8 + [13] and not any(got[10 + i].n_near for i in range(8))


def test_pairs_equal_a_count_of_every_group(spark):
    pick = random.Random(4)
    rows = [(pick.randint(1, 4), pick.randint(1, 3), pick.randint(-9, 30), pick.randint(0, 5), 3, 6) for _ in range(320)]
    rows += rows[:30]
    met = spark.createDataFrame(rows, "text long, item long, offset long, place long, need long, n_terms long")
    got = {tuple(r) for r in decontam.alignments(met).collect()}
    want = set()
    for text, item in {r[:2] for r in rows}:
        mine = {r[2:4] for r in rows if r[:2] == (text, item)}
        want |= {(text, item, o, False) for o, _ in mine if len({p for q, p in mine if q == o}) >= 3}
        if any(len({p for q, p in mine if o <= q <= o + decontam.SLOP}) * 100 >= decontam.NEAR_PERCENT * 6 for o, _ in mine):
            want.add((text, item, None, True))
    assert got == want and 0 < sum(r[3] for r in want) < 12 and any(not r[3] for r in want)
