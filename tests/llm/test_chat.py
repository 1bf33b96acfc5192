import json

import duckdb
from pyspark.sql import functions as F

from trajlake.llm.chat import SQL, call_depths, calls_of, canonical, link_calls, op2_chat, schema_errors
from trajlake.llm.common import shared_dir

SCHEMAS = {
    "find": {"properties": {"q": "string", "n": "integer", "deep": "object"}, "required": ["q"], "minLength": {"q": 2}},
    "noop": {"properties": {}},
}


def test_link_validate_serialise(spark):
    calls = [
        ("a", "find", '{"n": 3, "q":"xé\\n", "deep": {"z": [1, {"b": 2, "a": 1}], "y": null}}', None),
        ("b", "find", '{"n":"3","zz":1}', "a"), ("c", "find", "{oops", "b"), ("d", "other", "{}", "c"), ("e", "noop", "{}", "nobody"),
        ("f", "find", '{"q":"x"}', "g"), ("g", "find", "[1]", "f"), (None, "noop", "{}", None), ("a", "find", '{"q":"zz"}', None),
        ("h", None, None, None),
    ]
    results = [("a", "fine"), ("b", None), ("zzz", 'say "hi"'), (None, "lost"), ("a", "gine")]
    cs = spark.createDataFrame(calls, "call_id string, name string, arguments string, after string").withColumn("depth", F.lit(9))
    rs = spark.createDataFrame(results, "call_id string, content string").withColumn("name", F.lit("clash"))
    rows = link_calls(cs, rs, SCHEMAS).collect()
    got = {r.call_id: r for r in rows if r.call_id and not r.status.startswith("duplicate")}
    assert sorted((r.call_id, r.status, json.loads(r.json)["result"]) for r in rows if r.status.startswith("duplicate")) == [
        ("a", "duplicate_call", None), ("a", "duplicate_result", "gine")]
    assert sum(r.copies for r in rows) + 2 == len(calls) + len(results)
    assert [(k, got[k].depth) for k in "abcdefgh"] == [("a", 0), ("b", 1), ("c", 2), ("d", 3), ("e", 0), ("f", None), ("g", None), ("h", 0)]
    assert {k: got[k].status for k in "abc"} == {"a": "linked", "b": "linked", "c": "unanswered"} and got["zzz"].status == "orphan"
    assert got["a"].errors == [] and got["b"].errors == ["missing:q", "type:n", "unknown:zz"]
    assert got["c"].errors == ["invalid_json"] == got["g"].errors and got["d"].errors == ["unknown_tool"] == got["h"].errors
    assert got["f"].errors == ["short:q"] and got["e"].errors == []
    for r in rows:
        assert json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.json
    assert json.loads(got["a"].json)["arguments"]["deep"]["z"] == [1, {"a": 1, "b": 2}]
    assert json.loads(got["a"].json)["result"] == "fine" and json.loads(got["zzz"].json)["result"] == 'say "hi"'
    assert sorted(r.status for r in rows if r.call_id is None) == ["orphan", "unanswered"]


def test_long_chain_and_empty(spark):
    n = 3000
    chain = spark.range(n).selectExpr("cast(id as string) call_id", "cast(id - 1 as string) after")
    assert {int(r.call_id): r.depth for r in call_depths(chain).collect()} == {i: i for i in range(n)}
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert link_calls(*calls_of(none)[:2], SCHEMAS).count() == 0 == calls_of(none)[2].count()


def test_numbers_bounds_choices_and_nested_schemas(spark):
    schemas = {"t": {
        "properties": {"n": "integer", "r": "number", "s": "string", "in": {"properties": {"k": "integer"}, "required": ["k"]}},
        "minimum": {"r": -1}, "maximum": {"r": 2.5, "n": 9}, "enum": {"s": ["a", "b"]},
    }}
    cases = [
        ('{"n":1.0,"r":2}', [], '{"n":1,"r":2}'), ('{"n":1.5}', ["type:n"], '{"n":1.5}'), ('{"r":1e400}', ["invalid_json"], None),
        ('{"s":"Infinity"}', ["enum:s"], '{"s":"Infinity"}'), ('{"r":-2,"n":10,"s":"b"}', ["range:n", "range:r"], '{"n":10,"r":-2,"s":"b"}'),
        ('{"in":{"k":"x","z":1}}', ["in.type:k", "in.unknown:z"], '{"in":{"k":"x","z":1}}'), ('{"in":{}}', ["in.missing:k"], '{"in":{}}'),
        ('{"in":3}', ["type:in"], '{"in":3}'), (None, ["invalid_json"], None), ("", ["invalid_json"], None), ('{"s":"%s"}' % ("x" * 90_000), ["enum:s"], None),
    ]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, a string")
    got = rows.select("i", schema_errors(F.lit("t"), F.col("a"), schemas).alias("e"), canonical(F.col("a")).alias("c")).collect()
    for r in got:
        assert (r.e, r.c if r.i < 10 else None) == cases[r.i][1:]


def test_every_message_is_a_record(spark):
    rows = [
        (1, 0, "system", "be brief"), (1, 1, "user", "x" * 30), (1, 2, "assistant", "ok"), (1, 1, "user", "x" * 30), (1, 1, "user", "other"),
        (None, 3, "user", "q"), (1, None, "assistant", None), (2, 5, None, None), (2, 6, "tool", ""), (1, 3, "user", None), (1, 0, "system", "be brief"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    calls, results, others = calls_of(frame)
    linked = link_calls(calls, results, SCHEMAS).collect()
    assert sum(r.copies for r in linked) + others.count() + 1 == len(rows)  # one linked pair has two rows
    con = duckdb.connect()
    con.register("conversations", frame.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    want = con.sql(SQL).fetchall()
    frame.write.mode("overwrite").parquet(f"{shared_dir(spark)}/conv/conversations.parquet")
    got = [tuple(r) for r in op2_chat(spark, f"{shared_dir(spark)}/conv").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
