"""Scalar rules: is_numeric (N3), ticket clean (N9), heartbeat (M2), zero filter (M5)."""

from pyspark.sql import functions as F

from poslake.functions.fields import figi_fallback, json_field, parse_message, ticket_clean
from poslake.functions.numeric import is_numeric
from poslake.operators.messages import is_heartbeat, zero_position_excluded


def test_is_numeric_edge_cases(spark):
    vals = ["1", "-1.5", "+2", ".5", "1.", "", "1,250.5", ",,", "1e3", "abc", " 1", "999.994",
            "999.995", "-999.995", None, "123456789012345678901234567890123456789012345",
            "1\n"]
    df = spark.createDataFrame([(v,) for v in vals], "val string")
    got = dict(df.select("val", is_numeric("val", 5, 2).alias("ok")).collect())
    for v in ["1", "-1.5", "+2", ".5", "999.994"]:
        assert got[v] is True, v
    for v in ["1.", "", ",,", "1e3", "abc", " 1", "1,250.5", "999.995", "-999.995",
              "123456789012345678901234567890123456789012345", "1\n"]:
        assert got[v] is False, v
    assert got[None] is None


def test_ticket_clean(spark):
    df = spark.createDataFrame([(" 0 ",), ("12",), (None,), (" 7",)], "t string")
    assert [r[0] for r in df.select(ticket_clean("t")).collect()] == [None, 12, None, 7]


def test_figi_fallback(spark):
    df = spark.createDataFrame([(None, 5), ("BBG1", 6)], "f string, i int")
    assert [r[0] for r in df.select(figi_fallback("f", "i")).collect()] == [
        "NOFIGI_ROW_ID_5", "BBG1"]


def test_heartbeat_rule(spark):
    df = spark.createDataFrame([("{}",), ("{ }",), (" {}",), ('{"a":1}',), ("",)], "p string")
    assert [r[0] for r in df.select(is_heartbeat("p")).collect()] == [
        True, False, False, False, False]


def test_zero_filter_rule(spark):
    rows = ['{"POSITION_WITHOUT_PENDING":"0"}', '{"POSITION_WITHOUT_PENDING":"0.00"}',
            '{"POSITION_WITHOUT_PENDING":0}', '{"POSITION_WITHOUT_PENDING":null}',
            '{"A":1}', '{"POSITION_WITHOUT_PENDING":"  "}', '{"POSITION_WITHOUT_PENDING":"N.A."}',
            '{"POSITION_WITHOUT_PENDING":"1,250"}', '{"position_without_pending":"5"}',
            "{not json"]
    df = spark.createDataFrame([(r,) for r in rows], "p string")
    got = [r[0] for r in df.select(zero_position_excluded("p")).collect()]
    assert got == [True, True, True, True, True, True, False, False, True, False]


def test_json_field_upper_cases_the_key(spark):
    df = spark.createDataFrame([('{"ACCOUNT":"A1","N":12.50}',)], "j string")
    m = parse_message("j")
    r = df.select(json_field(m, "account").alias("a"), json_field(m, "n").alias("n"),
                  json_field(m, "missing").alias("x")).first()
    # Non-string scalars come back as their number text (12.50 → "12.5").
    assert (r.a, r.n, r.x) == ("A1", "12.5", None)


def test_no_python_udf_in_scalar_rules(spark):
    df = spark.createDataFrame([("1",)], "v string")
    plan = df.select(is_numeric("v", 5, 2), ticket_clean("v"),
                     zero_position_excluded(F.col("v")))._jdf.queryExecution()
    assert "PythonUDF" not in plan.optimizedPlan().toString()


def test_request_id_header_or_deterministic_fallback(spark):
    import datetime as dt

    from poslake.operators.messages import request_id
    rows = [("groups", "G1", dt.date(2024, 1, 1), "hdr-1"), ("groups", "G1", dt.date(2024, 1, 1), " "),
            ("groups", "G1", dt.date(2024, 1, 1), None), ("groups", "G2", dt.date(2024, 1, 1), None)]
    df = spark.createDataFrame(rows, "load_bb_entity_type string, load_bb_entity_name string, "
                                     "as_of_date date, hdr string")
    got = [r[0] for r in df.select(request_id("hdr")).collect()]
    assert got[0] == "hdr-1"
    assert got[1] == got[2] and len(got[1]) == 64  # blank header → same key-derived id
    assert got[3] != got[2]


def test_effective_as_of(spark):
    import datetime as dt

    from poslake.operators.messages import effective_as_of
    r = spark.range(1).select(effective_as_of("2024-01-02").alias("a"),
                              effective_as_of("  ").alias("b"),
                              F.current_date().alias("today")).first()
    assert r.a == dt.date(2024, 1, 2) and r.b == r.today


def test_target_status_order_and_zero_fill(spark):
    from poslake.operators.sessions import target_names, target_status
    metrics = spark.createDataFrame(
        [("groups", "beta", 2, 3, 4, None), ("accounts", "Zed", 0, 1, 1, None)],
        "load_bb_entity_type string, load_bb_entity_name string, heartbeats long, "
        "intraday_objects long, initial_objects long, last_message_at timestamp_ntz")
    targets = spark.createDataFrame(
        [("groups", "Alpha"), ("groups", "beta"), ("accounts", "aa"), ("accounts", "AA")],
        "entity_type string, entity_name string")
    rows = [(r.started, r.entity_type, r.entity_name, r.heartbeats)
            for r in target_status(metrics, targets).collect()]
    assert rows[:2] == [(True, "accounts", "Zed", 0), (True, "groups", "beta", 2)]
    rest = rows[2:]
    assert {r[2] for r in rest} == {"AA", "aa", "Alpha"} and all(not r[0] for r in rest)
    # Then type, then name ignoring case ("AA"/"aa" tie; their order is free).
    assert [(r[1], r[2].lower()) for r in rest] == sorted((r[1], r[2].lower()) for r in rest)
    assert [r.entity_name for r in target_names(targets, "ACCOUNTS").collect()] == ["AA"]
    assert [r.entity_name for r in target_names(targets, "groups").collect()] == [
        "Alpha", "beta"]
