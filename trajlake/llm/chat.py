"""Operator 2: tool calls linked to results, ordered, validated and serialised, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, release, scratch

_NUMBER = "(BIGINT|DOUBLE|DECIMAL|FLOAT)"
#: JSON types of a parameter, by the prefix of what schema_of_variant tells; an integer is a number without fraction.
_TYPES = {
    "string": "STRING", "integer": _NUMBER, "boolean": "BOOLEAN", "array": "ARRAY", "object": "OBJECT",
    "number": _NUMBER, "null": "VOID",
}
_INFINITE = '"-?Infinity"'

Schemas = dict[str, dict]


def canonical(json: Column) -> Column:
    """Canonical text of a JSON document: keys sorted, no white space, numbers in shortest form.

    Null if it isn't JSON, or holds a number beyond double precision: that
    would become a text that the document doesn't have.
    """
    infinite = lambda text: F.regexp_count(text, F.lit(_INFINITE))
    return _let(F.to_json(F.try_parse_json(json)), lambda text: F.when(infinite(text) <= infinite(json), text))


def schema_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Array of what is wrong with a call's arguments, sorted; empty when they fit.

    ``schemas``: tool name -> {"properties": {parameter: type}, "required": [..],
    "minLength": {parameter: n}, "minimum" and "maximum": {parameter: number},
    "enum": {parameter: [texts]}}; a type "object" may be a schema itself, for
    the nested document. Codes: unknown_tool, invalid_json, missing:p, type:p,
    short:p, range:p, enum:p, unknown:p, and nested ones as p.code. A null
    argument document is invalid JSON.
    """
    errors = F.array(F.lit("unknown_tool"))
    for tool, schema in schemas.items():
        errors = F.when(name == tool, _checked(arguments, schema)).otherwise(errors)
    return errors


def _checked(arguments: Column, schema: dict) -> Column:
    return _let(canonical(arguments), lambda text: _fits(text, schema))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _within(parameter: str, codes: Column) -> Column:
    return F.transform(codes, lambda code: F.concat(F.lit(f"{parameter}."), code))


def _fits(document: Column, schema: dict) -> Column:
    """Array of what is wrong with a canonical document, which is parsed once."""
    return _let(F.try_parse_json(document), lambda value: _problems(document, value, schema))


def _problems(document: Column, value: Column, schema: dict) -> Column:
    props, found, inner = schema.get("properties", {}), [], []
    for p, kind in sorted(props.items()):
        path = f"$['{p}']"
        held = F.try_variant_get(value, path, "variant")
        shape = F.schema_of_variant(held)
        nested = isinstance(kind, dict)
        right = shape.rlike(f"^{_TYPES['object' if nested else kind]}")
        number = F.try_variant_get(value, path, "double")
        if kind == "integer":
            right = right & (number == F.floor(number))
        if p in schema.get("required", []):
            found.append(F.when(held.isNull(), f"missing:{p}"))
        found.append(F.when(held.isNotNull() & ~F.coalesce(right, F.lit(False)), f"type:{p}"))
        text = F.try_variant_get(value, path, "string")
        if (least := schema.get("minLength", {}).get(p)) is not None:
            found.append(F.when((shape == "STRING") & (F.length(text) < least), f"short:{p}"))
        if (only := schema.get("enum", {}).get(p)) is not None:
            found.append(F.when((shape == "STRING") & ~text.isin(only), f"enum:{p}"))
        for key, beyond in (("minimum", lambda n, b: n < b), ("maximum", lambda n, b: n > b)):
            if (bound := schema.get(key, {}).get(p)) is not None:
                found.append(F.when(shape.rlike(f"^{_NUMBER}") & beyond(number, bound), f"range:{p}"))
        if nested:
            inner.append(F.when(right, _within(p, _fits(F.to_json(held), kind))))
    extra = F.array_except(F.json_object_keys(document), F.array(*map(F.lit, props)).cast("array<string>"))
    extra = F.transform(extra, lambda k: F.concat(F.lit("unknown:"), k))
    none = F.array().cast("array<string>")
    every = F.concat(
        F.array_distinct(F.array_compact(F.array(F.lit(None).cast("string"), *found))), F.coalesce(extra, none),
        *(F.coalesce(x, none) for x in inner),
    )
    whole = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    return F.when(~whole, F.array(F.lit("invalid_json"))).otherwise(F.array_sort(every))


def call_depths(calls: DataFrame) -> DataFrame:
    """(call_id, depth): calls before it on its chain of ``after`` links; null on a cycle.

    Pointer doubling: after round r a call knows its 2**r-th predecessor, so a
    chain takes as many rounds as its length has bits. An ``after`` that names no
    call, or is null, starts a chain.
    """
    ids = calls.groupBy("call_id").agg(F.min("after").alias("after"))
    heads = ids.select(F.col("call_id").alias("after"), F.lit(True).alias("there"))
    # Calls without a predecessor aren't looked up: their null keys would meet in one task.
    named = ids.where("after is not null").join(heads, "after", "left").select(
        "call_id", F.when(F.col("there"), F.col("after")).alias("up"), F.when(F.col("there"), 1).otherwise(0).cast("long").alias("depth")
    )
    first = ids.where("after is null").select("call_id", F.col("after").alias("up"), F.lit(0).cast("long").alias("depth"))
    jump = named.unionByName(first)
    jump = scratch(jump, "jump")
    tables, rounds = [jump], int(jump.count()).bit_length() + 1
    done, active = jump.where("up is null"), jump.where("up is not null")
    for _ in range(rounds):
        if active.isEmpty():
            break
        # Finished calls are looked up and don't take part.
        parent = active.unionByName(done).select(F.col("call_id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        step = active.join(parent, "up").select("call_id", F.col("up2").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))
        tables.append(scratch(step, "jump"))
        done, active = done.unionByName(tables[-1].where("up is null")), tables[-1].where("up is not null")
    cyclic = active.select("call_id", F.lit(None).cast("long").alias("depth"))
    out = scratch(done.select("call_id", "depth").unionByName(cyclic), "depths")
    release(*tables)
    return out


def link_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """Every call and every result, linked by ``call_id``: (call_id, status, depth, errors, json, copies).

    calls: (call_id, name, arguments JSON text, after); results: (call_id, content).
    status: linked, unanswered, orphan (a result without call); depth:
    topological order, a call comes after all of smaller depth on its chain, its
    result right behind it; json: the canonical document of the pair.

    Equal rows are one record of so many ``copies``. Of different calls or
    results of one id the least links (by arguments, name and after, or by
    content); the others are records of their own, duplicate_call and
    duplicate_result. Null ids never match and keep their rows. Null content is
    JSON null; arguments that are no JSON are null in the document. Depths
    follow the linking call's ``after``. Other columns are ignored; empty
    tables give no rows.
    """
    parts = ["arguments", "name", "after"]
    cs = calls.select("call_id", *parts).groupBy("call_id", *parts).agg(F.count(F.lit(1)).alias("copies"))
    rs = results.select("call_id", "content").groupBy("call_id", "content").agg(F.count(F.lit(1)).alias("copies"))
    cs, rs = scratch(cs, "calls"), scratch(rs, "results")
    one = cs.where("call_id is not null").groupBy("call_id").agg(F.min(F.struct(*parts, "copies")).alias("c"), F.count(F.lit(1)).alias("kinds"))
    back = rs.where("call_id is not null").groupBy("call_id").agg(F.min(F.struct("content", "copies")).alias("r"), F.count(F.lit(1)).alias("kinds"))
    first = one.select("call_id", "c.arguments", "c.name", "c.after", F.col("c.copies").alias("copies"))
    depths = call_depths(first.select("call_id", "after"))
    linked = first.join(depths, "call_id").withColumn("is_call", F.lit(True))
    answers = back.select("call_id", "r.content", F.col("r.copies").alias("more"), F.lit(True).alias("is_result"))
    # One row an id on both sides: hashed by the identifier, no key is hot.
    both = linked.join(answers.hint("shuffle_hash"), "call_id", "full")
    status = F.when(F.col("is_call") & F.col("is_result"), "linked").when(F.col("is_call"), "unanswered").otherwise("orphan")
    shape = ["call_id", "status", "arguments", "name", "depth", "content", "copies"]
    both = both.withColumn("status", status).withColumn("copies", F.coalesce("copies", "more")).select(*shape)
    bare = {"depth": F.lit(None).cast("long"), "content": F.lit(None).cast("string")}
    loose = cs.where("call_id is null").withColumns(bare | {"status": F.lit("unanswered"), "depth": F.lit(0).cast("long")})
    again = cs.join(one.where("kinds > 1").select("call_id", F.struct(*(F.col(f"c.{p}") for p in parts)).alias("kept")), "call_id")
    again = again.where(F.struct(*parts) != F.col("kept")).withColumns(bare | {"status": F.lit("duplicate_call")})
    empty = {c: F.lit(None).cast("string") for c in ("arguments", "name")} | {"depth": bare["depth"]}
    lost = rs.where("call_id is null").withColumns(empty | {"status": F.lit("orphan")})
    twice = rs.join(back.where("kinds > 1").select("call_id", "r.content").withColumnRenamed("content", "kept"), "call_id")
    twice = twice.where(~F.col("content").eqNullSafe(F.col("kept"))).withColumns(empty | {"status": F.lit("duplicate_result")})
    every = both
    for more in (loose, again, lost, twice):
        every = every.unionByName(more.select(*shape))
    is_call = F.col("status").isin("linked", "unanswered", "duplicate_call")
    errors = F.when(is_call, schema_errors(F.col("name"), F.col("arguments"), schemas)).otherwise(F.array().cast("array<string>"))
    json = F.concat(
        F.lit('{"arguments":'), F.coalesce(canonical(F.col("arguments")), F.lit("null")),
        F.lit(',"call_id":'), json_text("call_id"), F.lit(',"name":'), json_text("name"),
        F.lit(',"order":'), F.coalesce(F.col("depth").cast("string"), F.lit("null")),
        F.lit(',"result":'), json_text("content"), F.lit("}"),
    )
    return every.select("call_id", "status", "depth", errors.alias("errors"), json.alias("json"), "copies")


def json_text(name: str) -> Column:
    """The string of a column as a JSON text: the value of a one-field object."""
    whole = F.to_json(F.struct(F.col(name).alias("v")))
    return F.when(F.col(name).isNull(), "null").otherwise(F.substring(whole, F.lit(6), F.length(whole) - 6))


#: The tool that a user's turn of ``conversations`` calls.
SCHEMAS: Schemas = {
    "reply": {
        "properties": {"conv": "integer", "text": "string", "turn": "integer"},
        "required": ["conv", "text", "turn"],
        "minLength": {"text": 30},
        "minimum": {"turn": 0},
    }
}


def calls_of(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and other messages of (conv_id, turn, role, text).

    A user's turn calls, the next assistant's turn answers. A call comes after
    the call two turns before. Ids are "conv:turn", null without conversation
    or turn. Other roles, null too, are records as they are.
    """
    rows = messages.select("conv_id", "turn", "role", "text")
    ident = lambda back: F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - back).cast("string"))
    arguments = F.to_json(F.struct(F.col("turn").alias("turn"), F.col("text").alias("text"), F.col("conv_id").alias("conv")))
    user = rows.where("role = 'user'")
    calls = user.select(ident(0).alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"), ident(2).alias("after"))
    results = rows.where("role = 'assistant'").select(ident(1).alias("call_id"), F.col("text").alias("content"))
    others = rows.where("coalesce(role, '') not in ('user', 'assistant')").select(ident(0).alias("call_id"), "role", "text")
    return calls, results, others


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linked, ordered, validated and serialised calls of all ``conversations``; other turns are messages."""
    calls, results, others = calls_of(read(spark, sf_dir, "conversations"))
    out = link_calls(calls, results, SCHEMAS).withColumn("errors", F.array_join("errors", ","))
    json = F.concat(F.lit('{"content":'), json_text("text"), F.lit(',"message_id":'), json_text("call_id"), F.lit(',"role":'), json_text("role"), F.lit("}"))
    others = others.groupBy("call_id", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    others = others.select("call_id", F.lit("message").alias("status"), F.lit(None).cast("long").alias("depth"), F.lit("").alias("errors"), json.alias("json"), "copies")
    return out.unionByName(others)


SQL = """
WITH RECURSIVE uc AS (
  SELECT conv_id, turn, text, count(*) AS copies, conv_id || ':' || turn AS id
  FROM conversations WHERE role = 'user' GROUP BY conv_id, turn, text
),
ac AS (
  SELECT conv_id, turn, text, count(*) AS copies, conv_id || ':' || turn AS id
  FROM (SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE role = 'assistant') GROUP BY conv_id, turn, text
),
ur AS (SELECT *, CASE WHEN id IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY id ORDER BY text NULLS LAST) END AS k FROM uc),
ar AS (SELECT *, CASE WHEN id IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY id ORDER BY text NULLS FIRST) END AS k FROM ac),
u AS (SELECT * FROM ur WHERE k = 1 AND id IS NOT NULL),
a AS (SELECT * FROM ar WHERE k = 1 AND id IS NOT NULL),
d AS (
  SELECT u.conv_id, u.turn, 0::BIGINT AS depth FROM u
  WHERE NOT EXISTS (SELECT 1 FROM u p WHERE p.conv_id = u.conv_id AND p.turn = u.turn - 2)
  UNION ALL
  SELECT d.conv_id, d.turn + 2, d.depth + 1 FROM d JOIN u ON u.conv_id = d.conv_id AND u.turn = d.turn + 2
),
b AS (
  SELECT coalesce(u.id, a.id) AS call_id, CASE WHEN u.id IS NULL THEN 'orphan' WHEN a.id IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
         u.conv_id AS c, u.turn AS t, u.text, a.text AS content, d.depth, coalesce(u.copies, a.copies) AS copies, u.id IS NOT NULL AS is_call
  FROM u FULL JOIN a ON u.id = a.id LEFT JOIN d ON d.conv_id = u.conv_id AND d.turn = u.turn
  UNION ALL SELECT NULL, 'unanswered', conv_id, turn, text, NULL, 0, copies, true FROM ur WHERE id IS NULL
  UNION ALL SELECT id, 'duplicate_call', conv_id, turn, text, NULL, NULL, copies, true FROM ur WHERE k > 1
  UNION ALL SELECT NULL, 'orphan', NULL, NULL, NULL, text, NULL, copies, false FROM ar WHERE id IS NULL
  UNION ALL SELECT id, 'duplicate_result', NULL, NULL, NULL, text, NULL, copies, false FROM ar WHERE k > 1
)
SELECT call_id, status, depth,
       CASE WHEN NOT is_call THEN '' ELSE array_to_string(list_filter([
         CASE WHEN c IS NULL THEN 'missing:conv' END, CASE WHEN text IS NULL THEN 'missing:text' END, CASE WHEN t IS NULL THEN 'missing:turn' END,
         CASE WHEN t < 0 THEN 'range:turn' END, CASE WHEN length(text) < 30 THEN 'short:text' END], lambda e: e IS NOT NULL), ',') END AS errors,
       '{"arguments":' || CASE WHEN is_call THEN '{' || array_to_string(list_filter([
         CASE WHEN c IS NOT NULL THEN '"conv":' || c END, CASE WHEN text IS NOT NULL THEN '"text":' || to_json(text) END,
         CASE WHEN t IS NOT NULL THEN '"turn":' || t END], lambda e: e IS NOT NULL), ',') || '}' ELSE 'null' END
       || ',"call_id":' || CASE WHEN call_id IS NULL THEN 'null' ELSE to_json(call_id)::VARCHAR END
       || ',"name":' || CASE WHEN is_call THEN '"reply"' ELSE 'null' END
       || ',"order":' || coalesce(depth::VARCHAR, 'null')
       || ',"result":' || CASE WHEN content IS NULL THEN 'null' ELSE to_json(content)::VARCHAR END || '}' AS json,
       copies
FROM b
UNION ALL
SELECT CASE WHEN conv_id IS NOT NULL AND turn IS NOT NULL THEN conv_id || ':' || turn END, 'message', NULL, '',
       '{"content":' || CASE WHEN text IS NULL THEN 'null' ELSE to_json(text)::VARCHAR END || ',"message_id":'
       || CASE WHEN conv_id IS NULL OR turn IS NULL THEN 'null' ELSE to_json(conv_id || ':' || turn)::VARCHAR END
       || ',"role":' || CASE WHEN role IS NULL THEN 'null' ELSE to_json(role)::VARCHAR END || '}', count(*)
FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant') GROUP BY conv_id, turn, role, text
"""
