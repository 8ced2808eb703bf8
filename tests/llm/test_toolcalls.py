import json

from gatewise.llm import toolcalls

CALLS = "conv_id long, turn long, call_id string, after string, name string, arguments string"
RESULTS = "conv_id long, turn long, call_id string, content string"
SCHEMAS = {"add": {"x": "number", "y": "integer?"}, "say": {"text": "string", "tags": "array?", "loud": "boolean?", "more": "object?"}, "none": {}}


def formatted(spark, calls, results=()):
    out = toolcalls.format_calls(spark.createDataFrame(list(calls), CALLS), spark.createDataFrame(list(results), RESULTS), SCHEMAS)
    assert out.columns == ["conv_id", "turn", "kind", "call_id", "depth", "status", "errors", "json"]
    return out


def test_links_order_and_json(spark):
    calls = [
        (1, 5, "c", "b", "add", '{"y": 2, "x":1.50}'),
        (1, 3, "b", "a", "say", '{"text": "hi\\n\\"é\\"", "tags": [ 1, {"b":1,"a":2} ]}'),
        (1, 1, "a", None, "none", "{}"),
        (2, 1, "a", None, "none", "{ }"),
    ]
    results = [(1, 2, "a", "first"), (1, 9, "a", "late"), (1, 4, "x", "of none"), (2, 2, "a", 'quo"teé')]
    got = {(r.conv_id, r.turn): r for r in formatted(spark, calls, results).collect()}
    assert [(got[1, t].depth, got[1, t].status) for t in (1, 3, 5)] == [(0, "done"), (1, "open"), (2, "open")]
    assert got[1, 5].json == '{"arguments":{"x":1.5,"y":2},"depth":2,"id":"c","name":"add","result":null,"status":"open"}'
    assert json.loads(got[1, 3].json)["arguments"] == {"text": 'hi\n"é"', "tags": [1, {"a": 2, "b": 1}]}
    assert '{"a":2,"b":1}' in got[1, 3].json and json.loads(got[2, 1].json)["result"] == 'quo"teé'
    assert {k for k, r in got.items() if r.kind == "orphan"} == {(1, 4), (1, 9)}


def test_errors_by_schema(spark):
    cases = {
        '{"x": "1"}': "x: not number",
        '{"y": 1}': "x: missing",
        '{"x": 1, "y": 1.5, "z": 0}': "y: not integer; z: unknown",
        '{"x": null}': "x: missing",
        '{"x": 1': "arguments",
        "[1]": "arguments",
        None: "arguments",
        '{"x": 1e3}': "",
        '{"x": 1, "y": 3}': "",
    }
    got = {r.turn: r.errors for r in formatted(spark, [(1, k, f"c{k}", None, "add", a) for k, a in enumerate(cases)]).collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values())
    more = [(1, 1, "a", None, "fly", "{}"), (1, 2, "b", None, None, "{}"), (1, 3, "c", None, "say", '{"text":"t","loud":1,"more":[],"tags":{}}')]
    got = {r.turn: r.errors for r in formatted(spark, more).collect()}
    assert got == {1: "tool", 2: "tool", 3: "loud: not boolean; more: not object; tags: not array"}


def test_depths_of_chains_circles_and_unknown_calls(spark):
    chain = [(1, k, f"c{k}", f"c{k - 1}" if k else None) for k in range(70)]
    odd = [(2, 1, "a", "b"), (2, 2, "b", "a"), (2, 3, "d", "a"), (2, 4, "s", "s"), (2, 5, "u", "nowhere"), (2, 6, "v", "u"), (2, 7, "w", None)]
    df = spark.createDataFrame([*chain, *odd], "conv_id long, turn long, call_id string, after string")
    got = {(r.conv_id, r.call_id): r.depth for r in toolcalls.depths(df).collect()}
    assert all(got[1, f"c{k}"] == k for k in range(70))
    assert [got[2, c] for c in "abdsuvw"] == [None] * 6 + [0]


def test_nulls_repeats_and_empty_tables(spark):
    calls = [(None, 1, "a", None, "none", "{}"), (1, None, None, None, "none", "{}"), (1, 1, "a", None, "none", "{}"), (1, 1, "a", None, "none", "{}")]
    got = formatted(spark, calls, [(1, 2, "a", None), (None, 2, "a", "x"), (1, 3, None, "y")])
    assert got.where("kind = 'call'").count() == 4 and got.where("status = 'done'").count() == 2
    assert got.where("kind = 'orphan'").count() == 2
    assert formatted(spark, []).count() == 0


def test_every_other_turn_is_a_message(spark):
    messages = [(1, 0, "system", 'be "kind"\n'), (1, 1, "user", "hi"), (1, 1, "user", "hi"), (2, 0, None, None)]
    df = spark.createDataFrame(messages, "conv_id long, turn long, role string, content string")
    call = spark.createDataFrame([(1, 2, "a", None, "none", "{}")], CALLS)
    got = toolcalls.format_calls(call, spark.createDataFrame([], RESULTS), SCHEMAS, df)
    plain = got.where("kind = 'message'").orderBy("conv_id", "turn").collect()
    assert got.count() == 5 and [(r.conv_id, r.turn) for r in plain] == [(1, 0), (1, 1), (1, 1), (2, 0)]
    assert plain[0].json == '{"content":"be \\"kind\\"\\n","role":"system"}' and plain[3].json == '{"content":null,"role":null}'


def test_joins_are_hashed(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = formatted(spark, [(1, 1, "a", None, "none", "{}"), (1, 2, "b", "a", "none", "{}")])._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_python_on_the_executors(spark):
    plan = formatted(spark, [(1, 1, "a", None, "none", "{}")])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
