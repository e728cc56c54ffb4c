"""The bitmap that tells rows which cannot match: it never loses one that can, whatever the key."""

import os

from pyspark.sql import functions as F

from poslake.operators import netting, prefilter
from poslake.operators.normalise import add_weights, best_keys, best_rows, few_keys, look_up, portfolio_nav, strict_inbound
from poslake.operators.upsert import FX, collapse, merged_rows
from poslake.plans.q_netting import initial_scan, initial_stored, own_map
from poslake.schemas import BEST_ROW_KEY, PORTFOLIO_KEY, POSITIONS_COLUMNS, POSITIONS_SCHEMA
from poslake.session import store


def test_bitmap_never_loses_a_key(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else f"k{i}") for i in range(3000)], "a int, b string")
    keys = rows.where("a % 7 = 0")
    bits = prefilter.bitmap(keys.select(prefilter.key_hash(["a", "b"]).alias("_hash")))
    got = prefilter.may_hold(rows, prefilter.key_hash(["a", "b"]), bits)
    assert got.columns == ["a", "b", "_hit"] and got.count() == 3000
    assert got.where("a % 7 = 0 AND NOT _hit").count() == 0
    assert got.where("a % 7 <> 0 AND _hit").count() < 30
    assert prefilter.may_hold(rows, F.lit(None).cast("bigint"), bits).where("_hit").count() == 0
    none = prefilter.bitmap(keys.where("a < 0").select(prefilter.key_hash(["a"]).alias("_hash")))
    assert prefilter.may_hold(rows, prefilter.key_hash(["a"]), none).where("_hit").count() == 0


def _rows(spark, rows):
    base = dict.fromkeys(POSITIONS_COLUMNS)
    return spark.createDataFrame([tuple((base | r)[c] for c in POSITIONS_COLUMNS) for r in rows], POSITIONS_SCHEMA)


def test_merge_joins_only_rows_that_can_match(spark):
    import datetime as dt
    day = dt.date(2024, 1, 2)
    row = lambda i, ticket, **k: {"account_id": f"A{i}", "as_of_date": day, "deal_ticket_num": ticket, "currency": "USD",
                                  "load_bb_entity_type": "t", "msg_request_id": "m", "load_order": i} | k
    old = _rows(spark, [row(i, i) for i in range(1, 200)] + [row(500, None)])
    new = _rows(spark, [row(3, 3, load_status="new"), row(300, 1), row(400, 2, load_order=8), row(400, 2, load_order=9, load_status="last"),
                        row(500, None)])
    out = merged_rows(old, new, FX, {"load_status": "EXCLUDED.load_status"})
    got = {(r.account_id, r.deal_ticket_num, r._action): (r.load_order, r.load_status) for r in out.collect()}
    assert len(got) == out.count() == 203
    assert got["A3", 3, "updated"] == (3, "new") and got["A300", 1, "inserted"] == (300, None)
    assert got["A400", 2, "inserted"] == (8, "last")  # first row's columns, SET columns from the last
    assert ("A500", None, "kept") in got and ("A500", None, "appended") in got
    assert sum(a == "kept" for *_, a in got) == 199


def test_stored_rows_are_small(spark, sf_dir):
    """A stored table holds less than half of the bytes of a lineage cut of the same rows."""
    from poslake.session import cut, ensure_checkpoint_dir
    si = strict_inbound(initial_scan(spark, sf_dir))
    root = ensure_checkpoint_dir(spark).removeprefix("file:")
    size = lambda: sum(os.path.getsize(os.path.join(r, f)) for r, _, fs in os.walk(root) for f in fs)
    a = size()
    one = store(si)
    b = size()
    two = cut(si)
    assert 2 * (b - a) < size() - b
    assert one.schema.simpleString() == two.schema.simpleString() and one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_weights_of_kept_rows_equal_weights_of_all(spark, sf_dir):
    si, nav = initial_stored(spark, sf_dir)
    late = best_rows(si, nav=nav)
    early = best_rows(strict_inbound(initial_scan(spark, sf_dir)))
    assert late.select(*early.columns).exceptAll(early).isEmpty() and early.exceptAll(late.select(*early.columns)).isEmpty()
    assert best_keys(si).count() == best_keys(si).select(*BEST_ROW_KEY).distinct().count() == early.count()
    assert portfolio_nav(si).exceptAll(nav).isEmpty()
    assert collapse(late, FX, ["load_status"]).count() <= late.count()


def _nodes(plan):
    """The physical nodes that ran, inside adaptive plans and their stages too."""
    kind = plan.getClass().getSimpleName()
    inner = plan.executedPlan() if kind == "AdaptiveSparkPlanExec" else plan.plan() if kind.endswith("QueryStageExec") else None
    below = [inner] if inner is not None else [plan.children().apply(i) for i in range(plan.children().size())]
    return [plan] + [n for b in below for n in _nodes(b)]


def _shuffled(df):
    """How many rows the plan of ``df`` shuffled (after it ran)."""
    of = lambda n: n.metrics().get("shuffleRecordsWritten")
    return sum(of(n).get().value() for n in _nodes(df._jdf.queryExecution().executedPlan())
               if n.getClass().getSimpleName() == "ShuffleExchangeExec" and of(n).isDefined())


def test_best_rows_shuffle_only_repeated_keys(spark):
    key = dict(load_bb_entity_name="G", load_process="p", id_bb_unique="X", cusip="c")
    rows = _rows(spark, [key | dict(account_id=f"A{i}", load_order=i, fx_flag=False) for i in range(1000)]
                 + [key | dict(account_id=f"A{i}", load_order=5000 + i % 2, fx_flag=i > 6) for i in (5, 6, 7)]
                 + [key | dict(account_id="A6", load_order=5000, cusip=None, ticker=t, fx_flag=False) for t in "ab"]  # a tie: both are best
                 + [key | dict(account_id="N", load_order=None, fx_flag=False)])  # no order: never the best
    best = best_rows(rows)
    got = best.collect()
    assert sorted(r.load_order for r in got) == sorted([i for i in range(1000) if i not in (5, 6, 7)] + [5001, 5000, 5001] + [5000, 5000])
    assert _shuffled(best) < 100
    nonfx = netting.nonfx_best(rows)  # a row that ranks first is left out if it is FX, the next is not taken for it
    assert {r.account_id for r in nonfx.collect()} == {f"A{i}" for i in range(1000) if i != 7} and _shuffled(nonfx) < 100


def test_weights_of_few_portfolios_shuffle_no_rows(spark, sf_dir):
    si, nav = initial_stored(spark, sf_dir)
    out = add_weights(si, nav=nav)
    assert len(out.collect()) == si.count() and _shuffled(out) == 0
    normal = add_weights(si)
    assert out.exceptAll(normal).isEmpty() and normal.exceptAll(out).isEmpty()
    assert few_keys(nav, PORTFOLIO_KEY) and not few_keys(nav.unionByName(nav), PORTFOLIO_KEY)  # equal hashes: no lookup
    late = look_up(si, nav, PORTFOLIO_KEY, few=False)
    early = look_up(si, nav, PORTFOLIO_KEY, few=True)
    assert late.exceptAll(early).isEmpty() and early.exceptAll(late).isEmpty()


def test_short_groups_count_only_pairs_of_short_securities(spark):
    rows = [dict(load_bb_entity_name="G", load_process="p", account_id=a, id_bb_unique=i, short_flag=s)
            for a, i, s in [("A", "X", None), ("A", "X", False), ("B", "X", True), ("C", None, True), ("C", None, True)]
            + [("A", f"Y{i}", False) for i in range(500)] * 2]
    day = spark.sql("SELECT DATE'2024-01-01' AS as_of_date").first()[0]
    out = netting.short_groups(_rows(spark, [r | dict(as_of_date=day) for r in rows]))
    assert [(r.account_id, r.id_bb_unique) for r in out.collect()] == [("A", "X")] and _shuffled(out) < 50


def test_windows_of_a_map_run_before_the_typed_columns(spark, sf_dir):
    si = strict_inbound(initial_scan(spark, sf_dir), own_map(), weights=False)
    plan = si._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(i for i, line in enumerate(plan) if "Window [row_number()" in line and "trim" in line or "_window_" in line and "Window [" in line)
    assert any("market_value_raw" in line for line in plan[:at]) and not any("market_value_raw" in line for line in plan[at:])
    plain = strict_inbound(initial_scan(spark, sf_dir), weights=False)
    same = [c for c in si.columns if c in plain.columns]
    assert si.select(*same).exceptAll(plain.select(*same)).isEmpty() and si.where("row_number = 1").count() > 0
