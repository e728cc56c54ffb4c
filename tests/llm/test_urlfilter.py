import collections

import brute
import numpy as np

from poslake.llm import urlfilter

ODD = [(9000, None), (9001, ""), (9002, "x.com/en/"), (9003, "http://COM/"), (9004, "http://com"), (9005, "a://b://c.com/x"),
       (9006, "http://WWW.Example.com/en/1?x=/#"), (9007, "http://x.net/es/?é"), (9008, "http://h?q/p"),
       (9009, "http://a\nb.com/x\ny#z"), (9009, "http://a.org/"), (None, "http://a.org/")]


def test_parts_rules_and_verdicts(spark):
    pages = brute.rows("pages", "page_id", "url", sf="/root/testdata/sf0.01") + ODD
    got = urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string")).collect()
    want = collections.Counter((p, *brute.url(u, urlfilter.RULES)[:3]) for p, u in pages)
    assert collections.Counter((r.page_id, r.host, r.path, r.rule) for r in got) == want
    verdicts = {r.site: r.verdict for r in urlfilter.RULES}
    assert all(r.verdict == verdicts.get(r.rule, r.verdict) and r.verdict in ("allow", "block") for r in got)
    assert all((r.score is None) == (r.rule is not None) for r in got)
    free = [r for r in got if r.rule is None and r.host]
    assert {r.verdict for r in free} == {"allow", "block"}


def test_probabilities_add_up():
    counts = np.random.default_rng(0).poisson(0.001, urlfilter.N_SYMBOLS ** urlfilter.ORDER).astype(float)
    p = np.exp(urlfilter.log_probabilities(counts)).reshape(-1, urlfilter.N_SYMBOLS)
    assert np.allclose(p.sum(axis=1), 1)


def test_a_seen_continuation_is_likelier():
    import pyarrow as pa
    at, _ = urlfilter.grams(pa.array(["abcd"] * 5))
    counts = np.bincount(at, minlength=urlfilter.N_SYMBOLS ** urlfilter.ORDER).astype(float)
    p = urlfilter.log_probabilities(counts)
    seen, other = (urlfilter.grams(pa.array([t]))[0][-1] for t in ("abcd", "abcz"))
    assert p[seen] > np.log(0.5) > p[other]


def test_the_models_part_urls_that_no_rule_decides(spark):
    pages = [(i, f"http://shop{i % 7}.com/news/{i}") for i in range(200)] + [(1000 + i, f"http://zqxj{i % 7}.net/es/{i}") for i in range(200)]
    pages += [(5000, "http://shop3.org/news/7"), (5001, "http://zqxj3.org/es/7")]
    got = {r.page_id: r.verdict for r in urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string")).collect()}
    assert got[5000] == "allow" and got[5001] == "block"


def test_query_and_fragment_are_judged(spark):
    pages = [(i, f"http://h{i % 9}.com/p{i}?news=report&day#summary") for i in range(200)]
    pages += [(1000 + i, f"http://h{i % 9}.net/es/p{i}?zqxj=wkvb&qz#xxjq") for i in range(200)]
    pages += [(5000, "http://h3.org/p7?news=report&day"), (5001, "HTTP://H3.org/p7?ZQXJ=wkvb&qz"), (5002, "http://h3.org/p7#summary"), (5003, "http://h3.org/p7#xxjq")]
    got = {r.page_id: r for r in urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string")).collect()}
    assert [got[i].verdict for i in range(5000, 5004)] == ["allow", "block"] * 2
    assert {(got[i].host.lower(), got[i].path) for i in range(5000, 5004)} == {("h3.org", "/p7")}


def test_one_kind_none_and_empty(spark):
    schema = "page_id long, url string, host int, score string"
    one = spark.createDataFrame([(1, "http://a.net/es/x", 1, ""), (2, "http://b.org/", 1, "")], schema)
    assert {r.page_id: r.verdict for r in urlfilter.judge(one).collect()} == {1: "block", 2: "block"}
    none = spark.createDataFrame([(2, "http://b.org/", 1, "")], schema)
    assert urlfilter.judge(none).collect()[0].verdict == "allow"
    assert urlfilter.judge(none.limit(0)).count() == 0
