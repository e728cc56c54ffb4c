"""Archive and positions scans prune partitions and push filters to Parquet."""

from pyspark.sql import functions as F

from poslake.fixtures import fixture
from poslake.sources import archive
from poslake.sources.tables import VersionedTable, positions_asof


def _plan(df):
    spark = df.sparkSession
    old = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", old)


def test_archive_scan_prunes_and_orders(spark, sf_dir, scratch):
    log = fixture(spark, sf_dir, "fx_stream")
    (log.write.partitionBy("as_of_date", "load_bb_entity_type", "load_bb_entity_name")
     .parquet(f"{scratch}/archive"))
    a = archive.read_archive(spark, f"{scratch}/archive", "2024-01-01", "accounts", "U8")
    rows = archive.initial_rows(a, ordered=True).select("stream_order", "json_stream")
    plan = _plan(rows)
    assert "PartitionFilters: [" in plan and "(load_bb_entity_name#" in plan and "= U8)" in plan
    assert "ReadSchema: struct<stream_order:bigint,load_bb_action:string,json_stream:string>" \
        in plan
    got = [r.stream_order for r in rows.collect()]
    want = sorted(r.stream_order for r in log.where(
        (F.col("load_bb_entity_name") == "U8") & (F.col("load_bb_action") == "initial"))
        .collect())
    assert got == want


def test_positions_read_prunes_to_one_directory(spark, sf_dir, scratch):
    from poslake.operators.normalise import conform_positions
    pos = conform_positions(fixture(spark, sf_dir, "fx_positions"))
    t = VersionedTable(spark, f"{scratch}/positions")
    t.write(pos)
    df = positions_asof(t.read(), "2024-01-02", "GRP1").select("account_id", "figi")
    plan = _plan(df)
    assert "PartitionFilters: [" in plan and "= GRP1)" in plan
    assert "ReadSchema: struct<account_id:string,figi:string>" in plan
    assert df.count() == pos.where((F.col("as_of_date") == "2024-01-02")
                                   & (F.col("load_bb_entity_name") == "GRP1")).count()


def test_daily_table_read_is_one_pruned_relation(spark, sf_dir, scratch):
    from poslake.operators.normalise import conform_positions
    from poslake.sources.tables import DailyVersionedTable
    pos = conform_positions(fixture(spark, sf_dir, "fx_positions"))
    t = DailyVersionedTable(spark, f"{scratch}/daily")
    t.write(pos, ["2024-01-01", "2024-01-02"], tag=1)
    df = t.read().where(F.col("as_of_date") == F.lit("2024-01-02").cast("date")) \
        .select("account_id")
    plan = _plan(df)
    assert plan.count("FileScan parquet") == 1
    assert "PartitionFilters: [" in plan and "2024-01-02" in plan.split("PartitionFilters")[1]
    assert df.count() == pos.where(F.col("as_of_date") == "2024-01-02").count()
