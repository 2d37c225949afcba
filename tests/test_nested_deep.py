import json

from tallyloom.operators import nested
from tests.test_nested import BODY, STEPS, found, rows


def wrap(value, n, kind):
    for i in range(n):
        value = {"w": value} if kind == "object" else [value] if kind == "list" else {"w": json.dumps(value)} if i < 6 else {"w": value}
    return value


def test_any_number_of_wrappers(spark):
    want = {"threat/age", "threat/age/AGEP_A", "threat/age/X"}
    for kind in ("object", "list", "text"):
        texts = [json.dumps(wrap(BODY, n, kind)) for n in (0, 3, 4, 5, 7, 12, 200 if kind != "text" else 9)]
        assert found(spark, *texts) == {(i, p) for i in range(len(texts)) for p in want}, kind


def test_kernel_path_equals_jvm_path_on_all_records(spark, data):
    """The reader of deep wrappers, applied to every payload as brute force, gives the same nodes."""
    df = spark.read.parquet(f"{data}/nested_records.parquet")
    want = set()
    for r in df.collect():
        try:
            whole = json.loads(f"[{r.payload}]") if r.payload is not None else []
        except ValueError:
            continue
        if len(whole) != 1:
            continue
        for b, tree in zip(nested.BRANCHES, nested.opened(whole[0] if isinstance(whole[0], str) else json.dumps(whole[0]))):
            stack = [("" if b.label == "construct" else "corrected_reasoning_path", e, 0) for e in tree]
            while stack:
                above, e, depth = stack.pop()
                path = f"{above}/{e['name']}" if above else e["name"]
                if b.label == "step" or depth:
                    want.add((r.record_id, path))
                stack += [(path, k, depth + 1) for k in e.get("kids", [])]
    assert {tuple(r) for r in nested.found_nodes(df).collect()} == want and want


def test_entries_of_one_name_and_repeats_keep_their_children(spark):
    twice = {"constructs": {"c": {"components": [{"name": "cost", "items": [{"variable": "A"}]}, {"name": "cost", "items": [{"variable": "B"}]}]}}}
    t = nested.flat_tables(rows(spark, json.dumps(twice)).unionAll(rows(spark, json.dumps(twice))).unionAll(rows(spark, json.dumps(STEPS))))
    parts, items = t["components"].collect(), t["items"].collect()
    assert len({p.node_id for p in parts}) == len(parts) == 4
    held = {p.node_id: p for p in parts}
    assert sorted((held[i.parent_id].ordinal, i.name) for i in items) == [(0, "A"), (0, "A"), (1, "B"), (1, "B")]
    assert len({i.parent_id for i in items}) == 4
    steps = {s.node_id for s in t["steps"].collect()}
    assert {e.parent_id for e in t["evidence"].collect()} <= steps
