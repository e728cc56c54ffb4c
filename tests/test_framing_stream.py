"""Streaming M1 by the carried scan: any cut into batches gives what one ordered scan gives."""

import json
import random

import pytest
from pyspark.sql import functions as F

from poslake.operators.framing import Carried, Framer, frame_batch, reassemble
from poslake.streaming.framing import SessionFraming, frame_stream
from poslake.fixtures import fixture

SCHEMA = "msg_request_id string, chunk_seq long, chunk string"


def _session(rnd, name, objects):
    """(rows, objects) of one session: random text with braces and quotes, cut anywhere."""
    texts = []
    for _ in range(objects):
        obj = {f"K{i}": "".join(rnd.choice('ab{}"\\: ,') for _ in range(rnd.randint(0, 9))) for i in range(rnd.randint(0, 3))}
        texts.append(json.dumps({"deep": [obj, {"x": "}{"}]} if rnd.random() < 0.3 else obj))
        texts.append(rnd.choice(["", "}", " ", "{}"]))
    stream = "".join(texts) + rnd.choice(["", '{"open":"tail'])
    cuts = sorted({rnd.randint(0, len(stream)) for _ in range(2 * objects)})
    seq, rows, want, f = 0, [], [], Framer()
    for a, b in zip([0] + cuts, cuts + [len(stream)]):
        seq += rnd.randint(1, 3)
        rows.append((name, seq, stream[a:b] or None))
        want.extend((name, s, o, j) for s, o, j in f.feed(seq, stream[a:b]))
    return rows, want


@pytest.mark.parametrize("seed,batches", [(1, 2), (3, 5)])
def test_batches_together_equal_one_scan(spark, seed, batches):
    rnd = random.Random(seed)
    sessions = [_session(rnd, f"s{i}", rnd.randint(0, 6)) for i in range(12)] + [_session(rnd, "hot", 60)]
    want = sorted(w for _, found in sessions for w in found)
    parts = [[] for _ in range(batches)]
    for rows, _ in sessions:  # each session's rows stay in order from batch to batch
        at = sorted(rnd.randrange(batches) for _ in rows)
        for row, k in zip(rows, at):
            parts[k].append(row)
    carried, got = Carried.nothing(spark.createDataFrame([], SCHEMA)), []
    for part in parts:
        rnd.shuffle(part)
        framed = frame_batch(spark.createDataFrame(part, SCHEMA), carried, width=3)
        got += [tuple(r) for r in framed.objects.collect()]
        carried = framed.carried
        assert carried.border.groupBy("msg_request_id").count().where("count > 1").isEmpty()
    assert sorted(got) == want


def test_state_stands_at_borders_only(spark):
    rows = [("a", 0, '{"x":1}'), ("b", 0, '{"x":'), ("c", 0, '{"x":"\\'), ("d", 0, "plain"), ("e", 0, None)]
    framed = frame_batch(spark.createDataFrame(rows, SCHEMA), Carried.nothing(spark.createDataFrame([], SCHEMA)))
    assert sorted((r.msg_request_id, r.e_state, r.e_depth) for r in framed.carried.border.collect()) == [("b", 0, 1), ("c", 2, 1)]
    assert {r.msg_request_id for r in framed.active.collect()} == {"a", "b", "c", "d", "e"}


def test_one_session_is_framed_by_several_tasks(spark):
    df = spark.createDataFrame([("hot", i, '{"a":%d}{"b":1}' % i) for i in range(64)], SCHEMA)
    merged = "spark.sql.adaptive.coalescePartitions.enabled"  # tiny partitions would be read by one task
    before = spark.conf.get(merged)
    spark.conf.set(merged, "false")
    try:
        objects = frame_batch(df, Carried.nothing(df), width=4).objects.select("json", F.spark_partition_id().alias("task"))
        assert objects.count() == 128 and objects.select("task").distinct().count() > 1
    finally:
        spark.conf.set(merged, before)


def _files(spark, chunks, root, parts):
    lo, hi = chunks.agg(F.min("chunk_seq"), F.max("chunk_seq")).first()
    step = (hi - lo) // parts + 1
    for i in range(parts):
        chunks.where(F.col("chunk_seq").between(lo + i * step, lo + (i + 1) * step - 1)).coalesce(1).write.parquet(f"{root}/part={i:03d}")
    return spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/*")


def test_stream_with_restart_and_failed_batch_equals_batch(spark, sf_dir, scratch):
    chunks = fixture(spark, sf_dir, "fx_chunks")
    stream = _files(spark, chunks, f"{scratch}/chunks", 4)
    failed = []

    def store(objects, batch_id):
        objects.write.mode("overwrite").parquet(f"{scratch}/objects/batch={batch_id}")
        if batch_id == 2 and not failed:
            failed.append(batch_id)
            raise ValueError("lost after the write")

    def run():
        q = frame_stream(stream, f"{scratch}/state", store, f"{scratch}/ckpt", width=16).trigger(availableNow=True).start()
        q.awaitTermination()

    with pytest.raises(Exception, match="lost after the write"):
        run()
    run()
    assert failed == [2]
    got = spark.read.parquet(f"{scratch}/objects").drop("batch")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, reassemble(chunks).collect()))


def test_repeated_batch_brings_the_same_and_keeps_its_state(spark, scratch):
    got = {}
    framing = SessionFraming(f"{scratch}/state", lambda df, b: got.setdefault(b, []).append(sorted(map(tuple, df.collect()))))
    first = spark.createDataFrame([("s", 0, '{"a":1}{"b"')], SCHEMA)
    second = spark.createDataFrame([("s", 1, ':2}{"c":')], SCHEMA)
    for df, b in ((first, 0), (second, 1), (second, 1), (spark.createDataFrame([("s", 2, "3}")], SCHEMA), 2)):
        framing(df, b)
    assert got == {0: [[("s", 0, 0, '{"a":1}')]], 1: [[("s", 0, 7, '{"b":2}')]] * 2, 2: [[("s", 1, 3, '{"c":3}')]]}
    assert sorted(framing._versions(spark)) == [1, 2]
    with pytest.raises(RuntimeError, match="another streaming query"):
        framing(first, 0)
    with pytest.raises(RuntimeError, match="no state of batch 4"):
        framing(first, 5)


def test_idle_session_is_given_up_and_counted(spark, scratch):
    now, got = [100.0], []
    framing = SessionFraming(f"{scratch}/state", lambda df, b: got.extend(r.json for r in df.collect()), idle_seconds=50, clock=lambda: now[0])
    nothing = spark.createDataFrame([], SCHEMA)
    framing(spark.createDataFrame([("idle", 0, '{"a":"'), ("busy", 0, '{"b":')], SCHEMA), 0)
    now[0] = 140.0
    framing(spark.createDataFrame([("busy", 1, "1")], SCHEMA), 1)
    assert framing.expired(spark).count() == 0
    now[0] = 160.0
    framing(nothing, 2)
    assert [(r.msg_request_id, r.start_seq, r.n_chars) for r in framing.expired(spark).collect()] == [("idle", 0, 6)]
    framing(spark.createDataFrame([("busy", 2, "}"), ("idle", 1, 'x}{"n":1}')], SCHEMA), 3)
    assert sorted(got) == ['{"b":1}', '{"n":1}']
