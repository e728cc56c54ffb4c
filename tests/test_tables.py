"""Versioned tables (S7, S10), retries, run log (S11), metadata copy."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from poslake.schemas import POSITIONS_SCHEMA
from poslake.sources.tables import (DailyVersionedTable, RunLog, VersionedTable, copy_tables,
                                    keep_history, read_positions)


def _one(spark, name="G"):
    row = {c: None for c in POSITIONS_SCHEMA.names}
    row.update(account_id="A", as_of_date=dt.date(2024, 1, 1), load_bb_entity_name=name,
               load_order=1, msg_request_id="r", load_bb_entity_type="groups")
    return spark.createDataFrame([tuple(row[c] for c in POSITIONS_SCHEMA.names)],
                                 POSITIONS_SCHEMA)


def test_versions_and_retry(spark, scratch):
    t = VersionedTable(spark, f"{scratch}/current")
    assert t.read().count() == 0
    assert t.write(_one(spark), "q-0") == 1
    assert t.write(_one(spark).unionByName(_one(spark, "H")), "q-0") == 1  # retry: no-op
    assert t.read().count() == 1
    t.write(_one(spark).unionByName(_one(spark, "H")))
    assert t.current_version() == 2 and t.read().count() == 2
    assert t.read(1).count() == 1
    t.reset()
    assert t.read().count() == 0 and t.current_version() == 3


def test_read_positions_source_switch(spark, scratch):
    day = [dt.date(2024, 1, 1)]
    with pytest.raises(FileNotFoundError):
        read_positions(spark, scratch, "current", "2024-01-01", "G")
    DailyVersionedTable(spark, f"{scratch}/positions").write(_one(spark), day)
    keep_history(spark, scratch, day)
    for source in ("HISTORY", "current"):
        assert read_positions(spark, scratch, source, "2024-01-01", "G").count() == 1
    try:
        read_positions(spark, scratch, "other", "2024-01-01", "G")
        raise AssertionError("expected a failure")
    except ValueError as e:
        assert "current" in str(e)


def test_run_log(spark, scratch):
    log = RunLog(spark, f"{scratch}/log")
    job = log.start("upsert", "is_intraday=false")
    log.status(job, "upsert", "", "rows: 3")
    log.end(job, 1, "completed")
    j = log.jobs().first()
    assert j.job_id == job and j.job_status_description == "completed"
    assert log.details().count() == 2


def test_copy_tables(spark, scratch):
    _one(spark).write.parquet(f"{scratch}/src")
    assert copy_tables(spark, [(f"{scratch}/src", f"{scratch}/dst")]) == 1
    assert copy_tables(spark, [(f"{scratch}/src", f"{scratch}/dst")], truncate=False) == 1
    assert spark.read.parquet(f"{scratch}/dst").count() == 2


def test_upsert_job_is_logged_and_closed_on_failure(spark, scratch, sf_dir):
    from poslake.fixtures import fixture
    from poslake.operators.colmap import ColumnMap, ColumnMapError
    from poslake.plans.upsert_job import run_logged
    log = RunLog(spark, f"{scratch}/runlog")
    inbound = fixture(spark, sf_dir, "fx_inbound")
    empty = spark.createDataFrame([], POSITIONS_SCHEMA)
    out = run_logged(log, inbound, empty, False, policy="last")
    assert out.positions.count() > 0
    with pytest.raises(ColumnMapError):
        run_logged(log, inbound, empty, False, cmap=ColumnMap([]))
    states = {r.job_status_description.split(":")[0] for r in log.jobs().collect()}
    assert states == {"completed", "failed"}
    assert log.details().where("status_text LIKE 'nonfx_inserted:%'").count() == 1


def test_daily_versions_touch_only_written_days(spark, scratch):
    t = DailyVersionedTable(spark, f"{scratch}/daily")
    one = _one(spark)
    other = one.withColumn("as_of_date", F.lit("2024-01-02").cast("date"))
    t.write(one.unionByName(other), ["2024-01-01", "2024-01-02"], "q-1")
    t.write(one.unionByName(one.withColumn("load_bb_entity_name", F.lit("H"))),
            ["2024-01-01"], "q-2")
    assert t.days() == ["2024-01-01", "2024-01-02"]
    assert t.read(["2024-01-01"]).count() == 2 and t.read(["2024-01-02"]).count() == 1
    t.write(one, ["2024-01-01"], "q-2")  # retried batch: day already committed
    assert t.read().count() == 3
