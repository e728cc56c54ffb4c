"""Each stage of the pipeline on its own input, against the brute-force answers."""

import brute
import pytest

import corpus_pipeline
from poslake.llm import gam


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_stages_in_order():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality", "line_dedup", "jaccard_join", "decontamination", "best_fit_packing"]


def test_quality_drops_what_the_classifier_rejects(spark, sf_dir, docs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    keep = {r.doc_id for r in gam.quality_table(docs, labels).filter("predicted = 1").collect()}
    out = corpus_pipeline.quality(spark, docs, sf_dir)
    assert out.columns == docs.columns and {r.doc_id for r in out.select("doc_id").collect()} == keep and 0 < len(keep) < docs.count()


def test_line_dedup_keeps_rows_and_length(spark, sf_dir, docs):
    out = corpus_pipeline.line_dedup(spark, docs, sf_dir)
    assert out.schema.names == docs.schema.names and out.count() == docs.count()
    changed = out.join(docs.select("doc_id", docs.text.alias("old")), "doc_id").filter("text <> old").collect()
    assert changed and all(r.n_chars == len(r.text) for r in changed)


def test_join_keeps_one_of_each_group(spark, sf_dir, docs):
    out = corpus_pipeline.jaccard_join(spark, docs, sf_dir)
    want = {c for _, n, c in brute.components(brute.rows("documents", "doc_id", "text"))}
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == want and out.count() == len(want)


def test_decontamination_drops_contaminated_documents(spark, sf_dir, docs):
    out = corpus_pipeline.decontamination(spark, docs, sf_dir)
    answers = brute.contaminated(brute.rows("documents", "doc_id", "text"), brute.rows("benchmark", "item_id", "text"))
    want = {r[0] for r in answers if not r[5]}
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == want and len(want) < docs.count()


def test_decontamination_does_not_shuffle_documents_to_meet_few_contaminated(spark, sf_dir, docs):
    plan = corpus_pipeline.decontamination(spark, docs, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_run_packs_what_is_left(spark, sf_dir, docs):
    out = corpus_pipeline.run(spark, sf_dir)
    left = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    assert left < {r.doc_id for r in docs.select("doc_id").collect()} and len(left) > 50


def test_stages_take_odd_and_empty_tables(spark, sf_dir, docs):
    odd = docs.limit(30).unionByName(spark.createDataFrame([(None, None, None, None, None), (10 ** 6, "", "en", None, 0), (10 ** 6, "", "en", None, 0)], docs.schema))
    odd = odd.selectExpr("*", "lang AS score", "1 AS `class`", "2 AS `key`", "3 AS n_words")
    for _, stage in corpus_pipeline.STAGES:
        for table in (odd, odd.limit(0)):
            out = stage(spark, table, sf_dir)
            assert out.count() <= 3 * table.count()
            if stage is not corpus_pipeline.best_fit_packing:
                assert out.columns == odd.columns


def test_rows_that_differ_in_their_nulls_have_keys_of_their_own(spark):
    from poslake.llm import partenum
    from poslake.llm.common import with_row_key
    rows = [(1, None, "en", None, 0), (1, None, None, "en", 0), (1, None, "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert len({r["__row_key"] for r in with_row_key(docs).collect()}) == 2
    assert {tuple(r) for r in partenum.keep_one(docs).collect()} == set(rows)


@pytest.mark.parametrize("stage", [corpus_pipeline.jaccard_join, corpus_pipeline.decontamination])
def test_few_rows_in_many_partitions_are_few_files(spark, sf_dir, docs, monkeypatch, stage):
    """Each file that an executor writes to a local file system starts processes of its own."""
    from poslake.llm import common
    files, cut = [], common.cut

    def counted(df):
        out = cut(df)
        files.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(common, "cut", counted)
    held = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        out = stage(spark, docs.repartition(32), sf_dir)
        assert out.count() > 50
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert files and max(files) <= 8
