import json

from tallyloom.operators import nested

BODY = {"constructs": {"threat": {"components": [{"name": "age", "value": None, "items": [{"variable": "AGEP_A", "code": 1}, {"variable": "X"}]}, {"value": 1}]}}}
KEYED = {"constructs": {"threat": {"components": {"age": {"items": {"variable": "AGEP_A"}}, "health": None, "bmi": 0.5}}}}
STEPS = {"reflection": {"corrected_reasoning_path": [{"stage": "s1", "text": None, "evidence": [{"variable": "V"}]}, {"stage": "s2", "evidence": []}]}}


def rows(spark, *payloads):
    schema = "record_id long, source_row_index long, payload string, name string, body string, node_path string"
    return spark.createDataFrame([(i, i if i % 2 else None, p, "x", "y", "z") for i, p in enumerate(payloads)], schema)


def found(spark, *payloads):
    return {(r[0], r[1]) for r in nested.found_nodes(rows(spark, *payloads)).collect()}


def test_shapes(spark):
    assert found(spark, json.dumps(BODY)) == {(0, "threat/age"), (0, "threat/age/AGEP_A"), (0, "threat/age/X")}
    assert found(spark, json.dumps(KEYED)) == {(0, "threat/age"), (0, "threat/age/AGEP_A"), (0, "threat/health"), (0, "threat/bmi")}
    assert found(spark, json.dumps(STEPS)) == {(0, f"corrected_reasoning_path/{x}") for x in ("s1", "s1/V", "s2")}
    lone = {"corrected_reasoning_path": {"stage": "s1", "text": "t"}}
    assert found(spark, json.dumps(lone)) == {(0, "corrected_reasoning_path/s1")}
    one = {"constructs": {"c": {"components": {"name": "only", "items": None}}}}
    assert found(spark, json.dumps(one)) == {(0, "c/only")}


def test_json_inside_json_and_wrappers(spark):
    inner = json.dumps(BODY["constructs"]["threat"])
    text = {"data": [{"status": "ok", "profile": json.dumps({"hbm5_proxies": {"threat": inner}})}]}
    assert (0, "threat/age/X") in found(spark, json.dumps(text))
    assert (0, "threat/age/X") in found(spark, json.dumps(json.dumps(BODY)))


def test_unreadable_payloads_have_no_nodes(spark):
    good = json.dumps(BODY)
    assert found(spark, None, "", " ", "null", "[]", "{}", good[:-3], good + " trailing", good.replace('"', "'"), "plain text", "{,}", "12") == set()


def test_links_and_flat_tables(spark):
    t = nested.flat_tables(rows(spark, json.dumps(BODY), json.dumps(STEPS), json.dumps(BODY)))
    items = t["items"].orderBy("record_id", "ordinal").collect()
    assert [(r.record_id, r.parent_path, r.ordinal, r.name, r.code) for r in items] == [
        (0, "threat/age", 0, "AGEP_A", 1), (0, "threat/age", 1, "X", None), (2, "threat/age", 0, "AGEP_A", 1), (2, "threat/age", 1, "X", None),
    ]
    assert t["steps"].filter("text is null").count() == 2
    assert {r.source_row_index for r in t["evidence"].collect()} == {1}


def test_empty_table_and_repeats(spark):
    assert nested.found_nodes(rows(spark)).count() == 0
    df = rows(spark, json.dumps(BODY))
    assert nested.found_nodes(df.unionByName(df)).count() == 3
    assert nested.node_table(df.unionByName(df)).count() == 8


def test_long_record(spark):
    many = {"constructs": {"c": {"components": [{"name": f"n{i}", "items": [{"variable": "v"}]} for i in range(3000)]}}}
    assert len(found(spark, json.dumps(many), json.dumps(BODY))) == 6003
