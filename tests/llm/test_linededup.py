import brute
import pytest

from poslake.llm import linededup
from poslake.llm.queries import oracle_sql, queries
from poslake.testing import compare_with_oracle


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_oracle(spark, sf_dir, name):
    ok, detail = compare_with_oracle(spark, sf_dir, queries()[name], oracle_sql()[name])
    assert ok, detail


def _run(spark, rows, **options):
    pages = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines string")
    return linededup.dedup_lines(pages, **options)


def test_only_lines_over_the_ratio_of_their_host_go(spark):
    rows = [(i, f"menu\n\npage {i}\nmenu", "a", "x") for i in range(10)] + [(100 + i, f"menu\nother {i}" if i < 2 else f"other {i}", "b", None) for i in range(10)]
    got = {r.doc_id: (r.text, r["__lines"], r["__dropped"]) for r in _run(spark, rows, ratio=0.5).collect()}
    assert got[3] == ("\npage 3", 4, 2)
    assert got[100] == ("menu\nother 0", 2, 0)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, "", None, None), (None, "x", None, None), (None, "x", None, None), (2, "x\ny", None, None), (3, "x", "h", None)]
    got = sorted(((r.doc_id or 0, r.text, r["__dropped"]) for r in _run(spark, rows, ratio=0.4, min_pages=2).collect()), key=str)
    assert got == sorted([(1, None, 0), (1, "", 0), (0, "", 1), (0, "", 1), (2, "y", 1), (3, "x", 0)], key=str)


def test_copies_keep_their_lines(spark):
    rows = [(i, "copied page\nits only line", "a", None) for i in range(50)] + [(100 + i, f"page {i}\nmenu", "a", None) for i in range(20)]
    got = {r.doc_id: r.text for r in _run(spark, rows).collect()}
    assert got[7] == "copied page\nits only line" and got[103] == "page 3"
    out = _run(spark, rows).limit(0)
    assert out.count() == 0 and _run(spark, rows).columns[:4] == ["doc_id", "text", "source", "n_lines"]


def test_small_hosts_and_lines_just_over_the_ratio(spark):
    rows = [(i, f"page {i}\nfooter" if i < 3 else f"page {i}" + "\nrare" * (i < 5), "a", None) for i in range(50)]
    rows += [(100 + i, f"small {i}\nmenu", "b", None) for i in range(3)] + [(200 + i, f"two {i}\nmenu", "c", None) for i in range(2)]
    got = {r.doc_id: r.text for r in _run(spark, rows).collect()}
    assert [got[i] for i in (0, 1, 2)] == ["page 0", "page 1", "page 2"] and got[3] == "page 3\nrare" and got[4] == "page 4\nrare"
    assert [got[100 + i] for i in range(3)] == ["small 0", "small 1", "small 2"] and got[200] == "two 0\nmenu"


def test_lines_of_white_space_stay(spark):
    rows = [(i, f"page {i}\n\t\t\n \x0b\x0c \nmenu", "a", None) for i in range(30)]
    got = {r.doc_id: (r.text, r["__dropped"]) for r in _run(spark, rows).collect()}
    assert got[4] == ("page 4\n\t\t\n \x0b\x0c ", 1)


def test_no_python_runs(spark, sf_dir):
    plan = queries()["op3_line_dedup"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert brute.rows("documents", "doc_id")
