"""Compare guards (C8), field sets (C5), CSV policy (S8), summary."""

from decimal import Decimal as D

from pyspark.sql import functions as F

from poslake.fixtures import fixture
from poslake.operators.compare import CompareOptions, diff, field_sets, summary
from poslake.plans import q_compare
from poslake.plans.compare_job import run_compare


def _frames(spark):
    schema = "k int, s string, v decimal(30,9)"
    e = spark.createDataFrame([(1, "A", D("1")), (2, "b", D("2")), (3, "x", D("3"))], schema)
    a = spark.createDataFrame([(1, "a", D("1.000001")), (2, "b", D("2.5")), (4, "y", D("4"))],
                              schema)
    return e, a


def test_field_sets():
    cols = ["k", "a", "b", "c"]
    assert field_sets(CompareOptions(["k"], excluded_fields={"b"}), cols) == {1: ["a", "c"]}
    o = CompareOptions(["k"], use_all_fields=False, two_steps=True, phase1_fields={"a"},
                       phase2_fields={"c", "B"})
    assert field_sets(o, cols) == {1: ["a"], 2: ["c"]}


def test_diff_tolerance_and_case(spark):
    e, a = _frames(spark)
    d = {(r.k, r.field) for r in diff(e, a, CompareOptions(["k"])).collect()}
    assert d == {(1, "s"), (2, "v"), (3, "__row__"), (4, "__row__")}
    o = CompareOptions(["k"], string_case_insensitive=True)
    d = {(r.k, r.field) for r in diff(e, a, o).collect()}
    assert (1, "s") not in d
    s = summary(e, a, diff(e, a, o), o).first()
    assert (s.success, s.expected_count, s.actual_count, s.phase1_diffs) == (False, 3, 3, 3)


def test_guards(spark):
    e, a = _frames(spark)
    o = CompareOptions(["k"])
    assert run_compare(e, a, o, expected_source="bogus").reason == "source"
    assert run_compare(e.where(F.lit(False)), a, o).reason == "expected_empty"
    assert run_compare(e, a.where(F.lit(False)), o).reason == "actual_empty"


def test_csv_policy(spark, scratch):
    e, a = _frames(spark)
    o = CompareOptions(["k"])
    r = run_compare(e, a, o, save_policy="onfailure", output_dir=scratch + "/out")
    assert r.success is False and "phase1" in r.paths
    assert spark.read.option("header", True).csv(r.paths["phase1"]["expectedCsv"]).count() == 3
    r2 = run_compare(e, e, o, save_policy="OnFailure", output_dir=scratch + "/out2")
    assert r2.success is True and r2.paths == {}
    r3 = run_compare(e, a, o, save_policy="Never", output_dir=scratch + "/out3")
    assert r3.paths == {}


def test_positions_in_a_hot_key_span_partitions(spark):
    from poslake.operators.compare import positions_in_key
    rows = [(1 if i % 3 else 2, i % 7, f"v{i:04d}") for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, a int, b string").repartition(16)
    got = positions_in_key(df, ["k"], ["a", "b"]).collect()
    by = {}
    for r in got:
        by.setdefault(r.k, []).append(((r.a, r.b), r._pos))
    for k, lst in by.items():
        lst.sort()
        assert [p for _, p in lst] == list(range(1, len(lst) + 1)), k


def test_align_of_unique_keys_is_one_join(spark):
    """Where no key repeats, rows are not joined with the set of repeated keys."""
    from poslake.operators.compare import align
    e = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    a = spark.createDataFrame([(1, "a"), (3, "b"), (None, "c")], "k int, v string")
    out = align(e, a, ["k"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert sorted((r.k or 0, r.pos, r.status) for r in out.collect()) == [(0, 1, "both"), (1, 1, "both"), (2, 1, "expected_only"),
                                                                          (3, 1, "actual_only")]


def test_only_the_positions_are_written(spark, sf_dir, monkeypatch):
    """The target is read from the stored positions, not written beside them, and has all its rows."""
    written, store = [], q_compare.store
    monkeypatch.setattr(q_compare, "store", lambda df: written.append(df) or store(df))
    target, actual = q_compare._inputs(spark, sf_dir)
    assert len(written) == 1
    rows, want = target.collect(), fixture(spark, sf_dir, "fx_target").collect()
    assert sorted(map(str, rows)) == sorted(map(str, want)) and actual.count() > 0
