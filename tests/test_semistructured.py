import json

import pytest

from stancelake.operators.semistructured import NestedSpec, flatten_records, member_ordinals, members, outermost_json

SCHEMA = "raw_id long, payload string, extra string"


def found(spark, payloads):
    rows = [(i, p, "x") for i, p in enumerate(payloads)]
    df = member_ordinals(spark.createDataFrame(rows, SCHEMA), "raw_id", "payload")
    out = {}
    for r in sorted(map(tuple, df.collect())):
        out.setdefault(r[0], []).append(r[1:])
    return out


def test_shapes_of_members(spark):
    t = {"predicate": "p", "target": "x"}
    got = found(spark, [
        json.dumps({"positions": [{"stakeholder": "a", "targets": [t, t]}, None, {}, {"stakeholder": "b"}]}),
        json.dumps({"positions": {"stakeholder": "a", "targets": t}}),
        json.dumps({"report": {"positions": {"0": {"stakeholder": "a", "targets": ["x", "", None, "y"]}, "1": {"stakeholder": "b", "targets": {}}}}}),
        json.dumps({"positions": json.dumps([{"stakeholder": "a", "Targets": json.dumps([t])}])}),
        json.dumps({"positions": [[{"stakeholder": "a", "targets": [[t], [t]]}]]}),
        json.dumps([{"positions": []}]),
        json.dumps({"status": "ok", "result": {"report": {"political_issue": "x"}}}),
    ])
    assert got[0] == [(0, 0), (0, 1), (1, -1)]
    assert got[1] == [(0, 0)]
    assert got[2] == [(0, 0), (0, 1), (1, -1)]
    assert got[3] == [(0, 0)]
    assert got[4] == [(0, 0), (0, 1)]
    assert got[5] == [(-1, -1)]
    assert got[6] == [(-1, -1)]


def test_index_maps_go_by_number():
    assert list(members({"10": "c", "2": "b", "0": "a"}, {"target"})) == ["a", "b", "c"]


@pytest.mark.parametrize("bad", [None, "", "   ", "null", "I cannot", '{"positions": [', '{"positions": [],}', "{'positions': []}", '{"positions": NaN}', '{"error": "x"}', '{"status": 1, "result": {"report": {"positions": []}}', "[]", "{}", "3"])
def test_no_record(spark, bad):
    assert found(spark, [bad]) == {0: [(-2, -2)]}


def test_blanks_behind_a_bracket():
    for n in (10, 250, 5_000):
        assert outermost_json("[" + " " * n + 'draft] {"title": "x"}') == {"title": "x"}


def test_text_around_is_ignored():
    assert outermost_json('Here [draft]: {"a": 1} bye }') == {"a": 1}
    assert outermost_json('```json\n[{"a": [1]}]\n```') == [{"a": [1]}]
    with pytest.raises(ValueError):
        outermost_json('{"status": {"positions": []}, "x"')


def test_tables_keep_links_and_merge_schemas(spark):
    rows = [
        (1, json.dumps({"political_issue": "i", "positions": [{"stakeholder": "a", "support": {"type": "t", "content": 1}, "targets": [{"target": "x"}, "y"]}, {"stakeholder": "b", "score": 2.5}]}), ""),
        (2, json.dumps({"is_about_event": "True", "positions": [{"stakeholder": "c", "support": {"type": "u"}, "targets": {"target": "z", "root_key": "clash"}}]}), ""),
        (3, json.dumps({"is_about_event": True, "positions": None}), ""), (4, None, "")]
    t = flatten_records(spark.createDataFrame(rows, SCHEMA), "raw_id", "payload")
    root = {r.root_key: r for r in t["root"].collect()}
    assert [root[i].is_record for i in (1, 2, 3, 4)] == [True, True, True, False]
    pos = {r.positions_key: r for r in t["positions"].collect()}
    assert set(pos) == {"1/0", "1/1", "2/0"} and pos["1/1"].parent_key == "1" and pos["1/0"].support_type == "t" and pos["1/1"].score == 2.5
    tg = {r.targets_key: r for r in t["targets"].collect()}
    assert {k: (r.parent_key, r.target) for k, r in tg.items()} == {"1/0/0": ("1/0", "x"), "1/0/1": ("1/0", "y"), "2/0/0": ("2/0", "z")}
    assert tg["2/0/0"].root_key == 2 and tg["2/0/0"].root_key_2 == "clash"


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert member_ordinals(df, "raw_id", "payload").count() == 0
    t = flatten_records(df, "raw_id", "payload")
    assert [t[k].count() for k in ("root", "positions", "targets")] == [0, 0, 0]


def test_repeated_and_very_long(spark):
    p = json.dumps({"positions": [{"stakeholder": "s" * 200_000, "targets": ["t"] * 3_000}]})
    df = spark.createDataFrame([(7, p, ""), (7, p, "")], SCHEMA)
    # payloads under one key are one record's; under two keys each has its own rows
    assert member_ordinals(df, "raw_id", "payload").count() == 3_000
    other = spark.createDataFrame([(7, p, ""), (8, p, "")], SCHEMA)
    assert member_ordinals(other, "raw_id", "payload").count() == 6_000


def test_other_spec(spark):
    from stancelake.operators.semistructured import Level

    spec = NestedSpec((Level("orders", "no"), Level("lines", "sku")), frozenset({"orders"}))
    df = spark.createDataFrame([(1, json.dumps({"orders": [{"no": "a", "lines": ["x", {"sku": "y"}]}]}), "")], SCHEMA)
    assert [tuple(r) for r in member_ordinals(df, "raw_id", "payload", spec).orderBy("lines_no").collect()] == [(1, 0, 0), (1, 0, 1)]
