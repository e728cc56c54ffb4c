import zlib

import numpy as np

from poslake.llm import gam

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = gam.quality_table(docs, labels).join(labels, "doc_id", "left").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.quality is not None]
    assert len(held) > 50 and np.mean([r.predicted == r.quality for r in held]) >= 0.97


def test_an_interaction_is_learned():
    pick = np.random.default_rng(5)
    x = pick.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.fit(x, y)
    assert {0, 1} in [set(p) for p in model.pairs]
    fresh = pick.random((1000, 4))
    assert np.mean((model.score(fresh) > 0.5) == ((fresh[:, 0] > 0.5) ^ (fresh[:, 1] > 0.5))) > 0.9


def test_without_labels_or_with_one_class(spark):
    docs = spark.createDataFrame([(1, "a b", 3), (None, None, 4), (2, "", 5)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in gam.quality_table(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1), (7, 0), (None, 0), (1, None)], "doc_id long, quality int")
    got = gam.quality_table(docs, one).collect()
    assert len(got) == 3 and all(r.score > 0.5 for r in got)
    assert gam.quality_table(docs.limit(0), one).count() == 0


def test_features_are_finite_for_any_text():
    import pyarrow as pa

    from poslake.llm import textnp
    block = next(textnp.blocks(pa.array(["", None, " \n", "x", "!!! ***", "é " * 5000]), textnp.Words.SPACED))
    assert np.isfinite(gam.features(block)).all()
