"""Stream = batch: stateful phase/framing operators and the foreachBatch sink,
over archive files split several ways, with a restart from the checkpoint."""

import pytest
from pyspark.sql import functions as F

from poslake.fixtures import fixture
from poslake.operators import messages as msg
from poslake.operators.framing import reassemble
from poslake.plans.upsert_job import run_day
from poslake.schemas import POSITIONS_SCHEMA, SESSION_KEY
from poslake.sources.inbound import load_inbound
from poslake.streaming.sessions import classify_stream, reassemble_stream
from poslake.streaming.sink import run_archive_stream
from poslake.testing import digest


def _split_write(df, order_col, parts, root):
    lo, hi = df.agg(F.min(order_col), F.max(order_col)).first()
    step = (hi - lo) // parts + 1
    for i in range(parts):
        (df.where((F.col(order_col) >= lo + i * step) & (F.col(order_col) < lo + (i + 1) * step))
         .coalesce(1).write.mode("overwrite").parquet(f"{root}/part={i:03d}"))
    return [f"{root}/part={i:03d}" for i in range(parts)]


def _collect_stream(spark, stream_df, checkpoint):
    got = []

    def sink(b, _bid):
        got.extend(tuple(r) for r in b.collect())

    q = (stream_df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return got


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_phase_stream_equals_batch(spark, sf_dir, scratch, parts):
    log = fixture(spark, sf_dir, "fx_stream")
    src_root = f"{scratch}/src"
    _split_write(log, "stream_order", parts, src_root)
    stream = (spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1)
              .parquet(f"{src_root}/*"))
    out = classify_stream(stream).select(*SESSION_KEY, "stream_order", "phase")
    got = _collect_stream(spark, out, f"{scratch}/ckpt")
    want = [tuple(r) for r in msg.session_phase(log)
            .select(*SESSION_KEY, "stream_order", "phase").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_framing_stream_equals_batch(spark, sf_dir, scratch):
    chunks = fixture(spark, sf_dir, "fx_chunks")
    _split_write(chunks, "chunk_seq", 5, f"{scratch}/chunks")
    stream = (spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1)
              .parquet(f"{scratch}/chunks/*"))
    got = _collect_stream(spark, reassemble_stream(stream), f"{scratch}/ckpt")
    want = [tuple(r) for r in reassemble(chunks).collect()]
    assert sorted(got) == sorted(want)


def _batch_positions(spark, log):
    phased = msg.session_phase(log)
    cols = [*SESSION_KEY, "stream_order", "json_stream", "phase"]
    released = msg.initial_batch(phased).select(*cols).unionByName(
        phased.where(F.col("phase") == "intraday").select(*cols))
    inbound = load_inbound(released).rows
    _first, second = run_day(inbound, spark.createDataFrame([], POSITIONS_SCHEMA), policy="last")
    return second.positions


def test_upsert_stream_equals_batch_with_restart(spark, sf_dir, scratch):
    log = fixture(spark, sf_dir, "fx_stream")
    # A slice of sessions keeps the micro-batch count small for the test.
    log = log.where(F.col("load_bb_entity_name").isin("U1", "U2", "U3", "U8"))
    paths = _split_write(log, "stream_order", 4, f"{scratch}/arch")
    live = f"{scratch}/live"
    # First half arrives, the job stops; the rest arrives, the job resumes.
    for p in paths[:2]:
        spark.read.parquet(p).write.mode("overwrite").parquet(f"{live}/{p.rsplit('/', 1)[1]}")
    run_archive_stream(spark, f"{live}/*", log.schema, f"{scratch}/tables", f"{scratch}/ck",
                       policy="last")
    for p in paths[2:]:
        spark.read.parquet(p).write.mode("overwrite").parquet(f"{live}/{p.rsplit('/', 1)[1]}")
    tables = run_archive_stream(spark, f"{live}/*", log.schema, f"{scratch}/tables",
                                f"{scratch}/ck", policy="last")
    got = tables.positions.read()
    want = _batch_positions(spark, log)
    assert digest(got.columns, [tuple(r) for r in got.collect()])[0] == \
        digest(want.columns, [tuple(r) for r in want.collect()])[0]
    assert got.count() > 0


def test_retried_micro_batch_applies_once(spark, sf_dir, scratch):
    from poslake.streaming.sink import StreamTables, inbound_schema, make_sink
    log = fixture(spark, sf_dir, "fx_stream").where(
        F.col("load_bb_entity_name").isin("U1", "U2"))
    batch = msg.session_phase(log).drop("released").withColumn("released", F.lit(True))
    tables = StreamTables(spark, f"{scratch}/t", inbound_schema(spark))
    sink = make_sink(tables, policy="last")
    sink(batch, 0)
    first_pos = digest(POSITIONS_SCHEMA.names,
                       [tuple(r) for r in tables.positions.read().collect()])[0]
    first_in = tables.inbound().count()
    sink(batch, 0)  # the same batch id again (a retry)
    assert digest(POSITIONS_SCHEMA.names,
                  [tuple(r) for r in tables.positions.read().collect()])[0] == first_pos
    assert tables.inbound().count() == first_in > 0


def _sessions(spark, sf_dir, *names):
    log = fixture(spark, sf_dir, "fx_stream").where(F.col("load_bb_entity_name").isin(*names))
    return msg.session_phase(log)


def test_reset_then_next_batch_is_applied_and_foreign_query_refused(spark, sf_dir, scratch):
    from poslake.streaming.sink import StreamTables, inbound_schema, make_sink
    tables = StreamTables(spark, f"{scratch}/t", inbound_schema(spark))
    sink = make_sink(tables, policy="last", query_id="q1")
    sink(_sessions(spark, sf_dir, "U1"), 0)
    tables.positions.reset()
    assert tables.positions.read().count() == 0
    sink(_sessions(spark, sf_dir, "U2"), 1)
    assert tables.positions.read().count() > 0
    with pytest.raises(RuntimeError, match="belongs to streaming query q1"):
        make_sink(tables, query_id="q2")(_sessions(spark, sf_dir, "U3"), 0)


def test_received_is_loaded_or_quarantined(spark, sf_dir, scratch):
    from poslake.streaming.sink import StreamTables, inbound_schema, make_sink
    tables = StreamTables(spark, f"{scratch}/t", inbound_schema(spark))
    phased = _sessions(spark, sf_dir, "U1")
    intraday = phased.where("phase = 'intraday'").limit(1)
    bad = intraday.withColumn("json_stream", F.lit("{broken")).withColumn("stream_order", F.lit(10 ** 9).cast("long"))
    late = intraday.withColumn("phase", F.lit("late"))
    batch = phased.unionByName(bad).unionByName(late)
    make_sink(tables, policy="last")(batch, 0)
    reasons = {r.reason: r["count"] for r in tables.quarantine().groupBy("reason").count().collect()}
    assert reasons == {"malformed": 1, "late": 1}
    want = msg.zero_filter(phased).where("phase = 'intraday' OR (phase = 'initial' AND released)").count()
    assert tables.inbound().count() == want > 0
    assert tables.inbound().where("is_processed <> 'true'").count() == 0
    assert tables.log.jobs().where("job_status_description = 'completed'").count() == 1


def _write(df, folder):
    df.coalesce(1).write.parquet(folder)


def _tables_state(spark, tables):
    """Sorted rows of everything a stream writes, positions and run log's counts aside from times."""
    out = []
    for df in (tables.inbound(), tables.quarantine(), tables.positions.read()):
        out.append(digest(sorted(df.columns), [tuple(r) for r in df.select(*sorted(df.columns)).collect()])[0])
    return out


def _raw(spark, sf_dir, *names):
    return fixture(spark, sf_dir, "fx_stream").where(F.col("load_bb_entity_name").isin(*names))


def _start(spark, live, schema, scratch, sink, **idle):
    from poslake.streaming.release import drained, release_stream
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(live)
    with drained(spark):
        q = (release_stream(src, **idle).writeStream.foreachBatch(sink).option("checkpointLocation", f"{scratch}/ck")
             .trigger(availableNow=True).start())
        q.awaitTermination(300)


def test_batches_cost_their_own_rows_and_initial_rows_wait_in_state(spark, sf_dir, scratch):
    import os
    log = _raw(spark, sf_dir, "U1", "U2", "U3", "U8")
    phased = msg.session_phase(log).where("released").cache()
    raw = lambda df: df.select(*log.columns)
    live, top = f"{scratch}/live", phased.agg(F.max("stream_order")).first()[0]
    _write(raw(phased.where("phase = 'initial'")), f"{live}/part=0")
    tables = run_archive_stream(spark, f"{live}/*", log.schema, f"{scratch}/t", f"{scratch}/ck", policy="last")
    assert tables.inbound().count() == 0 and tables.quarantine().count() == 0
    _write(raw(phased.where("phase <> 'initial'")), f"{live}/part=1")
    for b in (2, 3):
        again = phased.where("phase = 'intraday'").limit(2).withColumn("stream_order", (F.lit(top + 10 * b) + F.monotonically_increasing_id()).cast("long"))
        _write(raw(again), f"{live}/part={b}")
    tables = run_archive_stream(spark, f"{live}/*", log.schema, f"{scratch}/t", f"{scratch}/ck", policy="last")
    folders = sorted(f for f in os.listdir(f"{scratch}/t/inbound") if f.startswith("batch="))
    counts = [spark.read.parquet(f"{scratch}/t/inbound/{f}").count() for f in folders]
    want = msg.zero_filter(phased).where("phase IN ('initial', 'intraday')").count()
    assert counts == [want, 2, 2] and want > 0


def test_retry_of_a_releasing_batch_changes_nothing(spark, sf_dir, scratch):
    from poslake.streaming.sink import StreamTables, inbound_schema, make_sink
    log = _raw(spark, sf_dir, "U4", "U12")
    phased = msg.session_phase(log).where("released").cache()
    raw = lambda df: df.select(*log.columns)
    initial = phased.where("phase = 'initial'")
    bad = initial.limit(1).withColumn("json_stream", F.lit("{broken")).withColumn("stream_order", F.lit(-1).cast("long"))
    live = f"{scratch}/live"
    _write(raw(initial.unionByName(bad)), f"{live}/part=0")
    _write(raw(phased.where("phase <> 'initial'")), f"{live}/part=1")
    tables = StreamTables(spark, f"{scratch}/t", inbound_schema(spark))
    sink, seen = make_sink(tables, policy="last"), []

    def failing(batch, batch_id):
        sink(batch, batch_id)
        seen.append((batch_id, batch.count()))
        if len(seen) == 2:
            raise RuntimeError("lost after its writes")

    with pytest.raises(Exception, match="lost after its writes"):
        _start(spark, f"{live}/*", log.schema, scratch, failing)
    before, loaded = _tables_state(spark, tables), tables.inbound().count()
    assert {r.reason: r["count"] for r in tables.quarantine().groupBy("reason").count().collect()} == {"malformed": 1}
    assert tables.inbound().where("is_intraday = 'false'").count() == msg.zero_filter(initial).count() > 0
    _start(spark, f"{live}/*", log.schema, scratch, failing)
    assert seen[1] == seen[2]  # the same batch with the same rows
    assert _tables_state(spark, tables) == before and tables.inbound().count() == loaded
    want = _batch_positions(spark, log)
    got = tables.positions.read()
    assert digest(got.columns, [tuple(r) for r in got.collect()])[0] == digest(want.columns, [tuple(r) for r in want.collect()])[0]


def test_idle_sessions_expire_and_are_counted(spark, sf_dir, scratch):
    import time
    log = _raw(spark, sf_dir, "U4", "U12")
    phased = msg.session_phase(log).where("released").cache()
    raw = lambda df: df.select(*log.columns)
    first = phased.where("load_bb_entity_name = 'U4' AND phase = 'initial'")
    live = f"{scratch}/live"

    def run():
        return run_archive_stream(spark, f"{live}/*", log.schema, f"{scratch}/t", f"{scratch}/ck", policy="last", idle_ms=1500)

    _write(raw(first), f"{live}/part=0")
    run()
    time.sleep(2)
    _write(raw(phased.where("load_bb_entity_name = 'U12'")), f"{live}/part=1")
    tables = run()
    n = first.count()
    assert n > 0 and tables.quarantine().groupBy("reason").count().collect() == [("expired", n)]
    sessions = first.select(*SESSION_KEY).distinct().count()
    assert tables.log.details().where(f"status_text = 'sessions_expired: {sessions}'").count() == 1
    _write(raw(first.limit(3)), f"{live}/part=2")
    tables = run()
    assert {r.reason: r["count"] for r in tables.quarantine().groupBy("reason").count().collect()} == {"expired": n, "late": 3}


def test_waiting_rows_are_kept_in_chunks(spark, sf_dir, scratch, monkeypatch):
    from poslake.streaming import release
    monkeypatch.setattr(release, "CHUNK_ROWS", 3)
    log = _raw(spark, sf_dir, "U3", "U4", "U12")
    released = msg.session_phase(log).where("released")
    paths = _split_write(log, "stream_order", 4, f"{scratch}/src")
    assert len(paths) == 4
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{scratch}/src/*")
    with release.drained(spark):
        got = _collect_stream(spark, release.release_stream(stream).select(*SESSION_KEY, "stream_order", "phase"), f"{scratch}/ck")
    want = [tuple(r) for r in released.select(*SESSION_KEY, "stream_order", "phase").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_out_of_order_files_keep_every_initial_row(spark, sf_dir, scratch):
    log = fixture(spark, sf_dir, "fx_stream").where(F.col("load_bb_entity_name").isin("U1", "U2"))
    first_hb = msg.first_heartbeats(log).select(*SESSION_KEY, "first_hb")
    early = log.join(first_hb, SESSION_KEY).where("stream_order <= first_hb").drop("first_hb")
    half = early.where("stream_order % 2 = 0")
    live = f"{scratch}/live"
    # Every even row (some heartbeats among them) comes before the odd ones.
    half.coalesce(1).write.parquet(f"{live}/part=000")
    early.where("stream_order % 2 = 1").coalesce(1).write.parquet(f"{live}/part=001")
    stream = (spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{live}/*"))
    out = classify_stream(stream).select(*SESSION_KEY, "stream_order", "phase")
    got = _collect_stream(spark, out, f"{scratch}/ckpt")
    want = [tuple(r) for r in msg.session_phase(early).select(*SESSION_KEY, "stream_order", "phase").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
