import collections
import zlib

import brute

from poslake.llm import shards


def _check(out, docs, n_shards=8):
    assert collections.Counter(r.doc_id for r in out) == collections.Counter(d for d, _ in docs)
    by = collections.defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    sizes = [len(by[k]) for k in range(n_shards)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(by[k]) == list(range(len(by[k]))) for k in by)


def test_shards_hold_all_rows_evenly(spark, monkeypatch):
    docs = brute.rows("documents", "doc_id", "text") + [(10 ** 6, None), (10 ** 6 + 1, ""), (10 ** 6 + 1, ""), (None, "é")]
    monkeypatch.setattr(shards, "BUCKET_BYTES", 40_000)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    out = shards.shard_table(table).collect()
    _check(out, docs)
    text = dict(docs)
    for r in out:
        if r.doc_id is not None:
            raw = (text[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    assert [tuple(r) for r in sorted(shards.shard_table(table.repartition(7)).collect(), key=str)] == [tuple(r) for r in sorted(out, key=str)]


def test_order_is_mixed(spark):
    docs = [(i, f"text {i}") for i in range(2000)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    shuffled, rows = shards.external_shuffle(table, bucket_bytes=4000)
    placed = sorted((r["__shard"], r["__slot"], r.doc_id) for r in shards.place(shuffled, rows).collect())
    order = [d for _, _, d in placed]
    assert sorted(order) == list(range(2000)) and sum(b == a + 1 for a, b in zip(order, order[1:], strict=False)) < 20
    other, _ = shards.external_shuffle(table, bucket_bytes=4000, seed=5)
    assert [r.doc_id for r in other.collect()] != [r.doc_id for r in shuffled.collect()]


def test_repeated_rows_spread_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(shards, "COPIES", 100)
    docs = [(i, f"text {i}", None) for i in range(2000)] + [(5, "the same", "a")] * 900 + [(None, None, None)] * 300 + [(6, "x", str(i)) for i in range(300)]
    table = spark.createDataFrame(docs, "doc_id long, text string, n string").repartition(5)
    shuffled, rows = shards.external_shuffle(table, bucket_bytes=4000)
    out = shuffled.collect()
    assert collections.Counter((r.doc_id, r.text, r.n) for r in out) == collections.Counter(docs) and rows == len(docs)
    size = collections.Counter(r["__bucket"] for r in out)
    assert max(size.values()) < 3 * len(docs) / len(size)


def test_files_hold_the_records(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", "s") for i in range(100)], "doc_id long, text string, slot string")
    shards.write_shards(docs, str(tmp_path / "out"), n_shards=4, bucket_bytes=500)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and back.select("doc_id").distinct().count() == 100
    assert {r["shard"]: r["n"] for r in back.groupBy("shard").count().withColumnRenamed("count", "n").collect()} == dict.fromkeys(range(4), 25)


def test_few_and_no_rows(spark):
    docs = [(1, "a"), (2, None), (3, "a")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    _check(shards.shard_table(table).collect(), docs)
    assert shards.shard_table(table.limit(0)).count() == 0
