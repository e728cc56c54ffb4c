"""Column map: builders (N4–N7), load list (S6), validate (N15), checks."""

import pytest

from poslake.operators.colmap import (ColumnMap, ColumnMapError, MapRow, default_map_df,
                                      load_columns_df, map_search, map_update, map_violations,
                                      validate_expr)


def test_select_list_sorted_by_target_and_quoted():
    cm = ColumnMap([MapRow(1, "b src", "zz", "json", True, True, "trim(source_column)"),
                    MapRow(2, "a", "aa", "json", True, True),
                    MapRow(3, "c", "mm", "computed_upd", True, True, "x"),
                    MapRow(4, "d", "dd", "json", False, True)])
    assert cm.select_list() == ["`a` AS `aa`", "trim(`b src`) AS `zz`"]
    assert cm.target_list() == ["aa", "mm", "zz"]


def test_empty_map_is_an_error():
    with pytest.raises(ColumnMapError):
        ColumnMap([MapRow(1, "a", "a", "json", False, True)]).select_list()


def test_load_columns_and_double_listing():
    cm = ColumnMap([MapRow(1, "a", "x", "json", False, False),
                    MapRow(2, "a", "y", "json", True, True),
                    MapRow(3, "d", "d", "loader", True, True),
                    MapRow(4, " ", "e", "json", True, True),
                    MapRow(5, "f", "f", "computed", True, True)])
    assert cm.load_columns() == [("a", "json"), ("d", "loader")]
    bad = ColumnMap(cm.rows + [MapRow(6, "a", "z", "loader", True, True)])
    with pytest.raises(ColumnMapError):
        bad.load_columns()


def test_update_list_replaces_token():
    cm = ColumnMap.default()
    ups = cm.update_list()
    assert ups["currency"] == "EXCLUDED.currency"
    assert "deal_ticket_num" not in ups


def test_fixture_map_load_columns(spark, sf_dir):
    from poslake.fixtures import fixture
    rows = {tuple(r) for r in load_columns_df(fixture(spark, sf_dir, "fx_colmap")).collect()}
    assert rows == {("account", "json"), ("as_of_date", "loader"),
                    ("deal_ticket_num", "json"), ("local_market_value", "json"),
                    ("ivol", "json"), ("crncy", "json")}


def test_violations_search_update(spark):
    df = default_map_df(spark)
    assert map_violations(df).count() == 0
    bad = map_update(df, 3, source_kind="bogus")
    assert [tuple(r) for r in map_violations(bad).collect()] == [(3, "source_kind")]
    hits = {r.map_id for r in map_search(df, "  CUSIP ").collect()}
    assert hits == {4}
    assert map_search(df, "").count() == df.count()


def test_validate_expr(spark):
    schema = "account string, crncy string, load_order int"
    assert validate_expr(spark, schema, "account", "account_id", "trim(source_column)",
                         "target_column = EXCLUDED.target_column") == {"ok": True}
    r = validate_expr(spark, schema, "account", "account_id", "trim(source_column", None)
    assert r["ok"] is False and r["kind"] == "transform" and r["error_class"] == "PARSE"
    r = validate_expr(spark, schema, "account", "x", "nosuch + 1", None)
    assert r["kind"] == "transform" and r["error_class"] == "ANALYSIS"
    r = validate_expr(spark, schema, "account", "crncy", None, "target_column = EXCLUDED.zz")
    assert r["kind"] == "update_set"
