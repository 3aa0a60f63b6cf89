"""Chat formatting with tool-call linking (built-in functions only).

A turn is a message.  An assistant turn whose text is a JSON object with `tool_calls` carries calls
(`id`, `name`, `arguments`, or the nested `function` form with arguments as an object or a JSON string); a turn of
the role `tool` (or any with `tool_call_id`) is the result of the call with that identifier.

* linking - calls and results are joined by (conversation, identifier), a hash or sort-merge join that AQE may
  split; the first call of an identifier and the first result of it count.  `mark` says "repeated" of a further result
  and "orphaned" of one without a call; `n_repeated` counts a turn's calls whose identifier was called before;
* order - each message gets a topological key (order_turn, order_rank, turn): a result never stands before its
  call, and what stands in order keeps its turn.  A turn may be a result and carry calls itself; such chains are followed to
  their first call by doubling, over the turns in them only, so no conversation is collected or windowed in one task.  Turns
  whose calls answer each other in a ring have no order; they keep their turns, and are marked "cyclic";
* validation - arguments against the tool's schema: required and known names, types, enumerated values, and the same for
  properties of objects and items of arrays at any depth;
* serialisation - canonical JSON: keys sorted at every level, no blanks, by way of the variant type.

Defined cases: null role or text give JSON nulls; text that is no JSON object is an ordinary message, of any length;
an element of `tool_calls` that is no object is a call without
identifier and name; repeated rows are kept, each with the links of one; rows that repeat a turn with another text are messages of their own; null
conversations are one conversation, null turns come first; arguments that do not parse are invalid; an empty table gives no rows; other columns of the input are
ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.session import cut

#: Tools by name: (required names, properties).  A property is the name of its type, or a schema: type, enum, items (a schema), properties, required.
Schemas = dict[str, tuple[list[str], dict[str, str | dict]]]
#: Kinds of JSON values by the variant type's name of them.
_KINDS = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"], "object": ["OBJECT"], "array": ["ARRAY"], "null": ["VOID"]}


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), r"^([A-Z]+)", 1)


def _value(v: Column, schema: str | dict, at: str) -> list[Column]:
    """Problems of a value (a variant) that is there: texts, or null where there is none."""
    schema = {"type": schema} if isinstance(schema, str) else schema
    out, fits = [], F.lit(True)
    if "type" in schema:
        fits = F.coalesce(_kind(v).isin(_KINDS[schema["type"]]), F.lit(False))
        out.append(F.when(~fits, f"type:{at}"))
    if "enum" in schema:
        values = [json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for x in schema["enum"]]
        out.append(F.when(fits & ~F.coalesce(F.to_json(v).isin(values), F.lit(False)), f"enum:{at}"))
    if "items" in schema:
        elements = F.try_variant_get(v, "$", "array<variant>")
        wrong = F.exists(elements, lambda e: F.size(F.array_compact(F.array(*_value(e, schema["items"], at)))) > 0)
        out.append(F.when(fits & F.coalesce(wrong, F.lit(False)), f"items:{at}"))
    if "properties" in schema:
        keys = F.coalesce(F.json_object_keys(F.to_json(v)), F.array().cast("array<string>"))
        out += [F.when(fits & c.isNotNull(), c) for c in _object(v, keys, schema.get("required", []), schema["properties"], f"{at}.")]
    return out


def _object(v: Column, keys: Column, required: list[str], properties: dict[str, str | dict], at: str) -> list[Column]:
    out = [F.when(~F.array_contains(keys, k), f"missing:{at}{k}") for k in required]
    for k, schema in sorted(properties.items()):
        there = F.array_contains(keys, k)
        out += [F.when(there & c.isNotNull(), c) for c in _value(F.try_variant_get(v, f"$['{k}']", "variant"), schema, at + k)]
    return out


def _problems(schemas: Schemas, name: Column, args: Column) -> Column:
    """Sorted problems of a call; empty if it is valid."""
    none = F.array().cast("array<string>")
    parsed = F.coalesce(_kind(args) == "OBJECT", F.lit(False))
    keys = F.coalesce(F.json_object_keys(F.to_json(args)), none)
    out = F.when(name.isNull(), F.array(F.lit("no_name"))).otherwise(F.array(F.concat(F.lit("unknown_tool:"), F.coalesce(name, F.lit("")))))
    for tool, (required, props) in sorted(schemas.items()):
        checks = _object(args, keys, required, props, "")
        own = F.array_compact(F.array(*checks)) if checks else none
        extra = F.transform(F.array_except(keys, F.array(*map(F.lit, props)) if props else none), lambda k: F.concat(F.lit("unknown:"), k))
        out = F.when(name == tool, F.when(parsed, F.array_sort(F.concat(own, extra))).otherwise(F.array(F.lit("arguments")))).otherwise(out)
    return out


def _looks(text: Column) -> Column:
    """Whether a text may be an object with a key of calls or results: it has the word, or an escape that may spell it."""
    return F.coalesce(F.contains(text, F.lit("tool_call")) | (F.ltrim(text).startswith("{") & F.contains(text, F.lit("\\u"))), F.lit(False))


def canonical(text: Column) -> Column:
    """Canonical JSON of a JSON text; null if it does not parse."""
    return F.to_json(F.try_parse_json(text))


def calls_of(turns: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per call of the turns (conv, row, role, text): conv, row, call_no, call_id, name, arguments (canonical JSON), problems."""
    calls = F.try_variant_get("v", "$.tool_calls", "array<variant>")
    c = turns.filter(_looks(F.col("text")) & (F.col("role") == "assistant")).withColumn("v", F.try_parse_json("text"))
    c = c.filter(_kind(F.col("v")) == "OBJECT").select("conv", "row", F.posexplode(calls).alias("call_no", "c"))
    part = lambda path, kind: F.try_variant_get("c", path, kind)
    raw = F.coalesce(part("$.arguments", "variant"), part("$.function.arguments", "variant"))
    # Arguments may be an object or a JSON text of one.
    args = F.when(_kind(raw) == "STRING", F.try_parse_json(F.try_variant_get(raw, "$", "string"))).otherwise(raw)
    c = c.select("conv", "row", "call_no", part("$.id", "string").alias("call_id"), F.coalesce(part("$.name", "string"), part("$.function.name", "string")).alias("name"), args.alias("args"))
    return c.select("conv", "row", "call_no", "call_id", "name", F.to_json("args").alias("arguments"), _problems(schemas, F.col("name"), F.col("args")).alias("problems"))


def link(turns: DataFrame, schemas: Schemas | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: conv_id, turn, role, kind (message, calls or result), n_calls, n_answered, n_repeated, n_invalid, linked, mark, order_turn, order_rank and message (canonical JSON)."""
    t = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    looks = _looks(F.col("text"))
    t = t.withColumn("result_of", F.when(looks, F.try_variant_get(F.try_parse_json("text"), "$.tool_call_id", "string")))
    # Only rows that look like calls or results take part in joins; all others pass by.  Structs are equal where both hold null.
    special, plain = t.filter(looks), t.filter(~looks)
    special = special.withColumns({"conv": F.struct("conv_id"), "row": F.struct("turn", F.coalesce("role", F.lit("")).alias("by"), F.sha2("text", 256).alias("digest"))})
    once = special.dropDuplicates(["conv", "row"])
    calls = calls_of(once, schemas or {})
    ids = ["conv", "call_id"]
    first = calls.filter("call_id IS NOT NULL").groupBy(*ids).agg(F.min(F.struct("row", "call_no")).alias("first_call"))
    answer = once.filter("result_of IS NOT NULL").groupBy("conv", F.col("result_of").alias("call_id")).agg(F.min("row").alias("first_result"))
    own = F.col("first_call") == F.struct("row", "call_no")
    per_row = (
        calls.join(first, ids, "left")
        .join(answer, ids, "left")
        .groupBy("conv", "row")
        .agg(
            F.count(F.lit(1)).alias("n_calls"),
            F.count_if(own & F.col("first_result").isNotNull()).alias("n_answered"),
            F.count_if(~own).alias("n_repeated"),
            F.count_if(F.size("problems") > 0).alias("n_invalid"),
            F.array_sort(F.collect_list(F.struct("call_no", F.col("call_id").alias("id"), "name", "arguments", "problems"))).alias("calls"),
        )
    )
    of = {"call_id": "result_of"}
    linked = (
        special.join(per_row, ["conv", "row"], "left")
        .join(first.withColumnsRenamed(of), ["conv", "result_of"], "left")
        .join(answer.withColumnsRenamed(of), ["conv", "result_of"], "left")
        .withColumns(
            {
                **{n: F.coalesce(n, F.lit(0)) for n in _COUNTS},
                "linked": F.col("first_call").isNotNull(),
                "mark": F.when(F.col("result_of").isNull(), None).when(F.col("first_call").isNull(), "orphaned").when(F.col("first_result") != F.col("row"), "repeated"),
            }
        )
    )
    linked = _ordered(linked)
    extra = [*_COUNTS, "calls", "first_turn", "depth", "linked", "mark"]
    none = {n: F.lit(0).cast("bigint") for n in _COUNTS} | {"calls": F.lit(None).cast(per_row.schema["calls"].dataType), "first_turn": F.lit(None).cast(t.schema["turn"].dataType), "depth": F.lit(0), "linked": F.lit(False), "mark": F.lit(None).cast("string")}
    return _format(linked.select(*t.columns, *extra).unionByName(plain.withColumns(none).select(*t.columns, *extra)))


def _ordered(special: DataFrame) -> DataFrame:
    """special with first_turn (the latest turn of the chain of calls that a result hangs on) and depth (its calls in that chain; 0 for none and in a ring)."""
    turn_of = lambda c: F.col(c)["turn"]
    links = special.filter("linked").select("conv", "row", F.col("first_call")["row"].alias("up")).distinct()
    links = links.select("conv", "row", "up", turn_of("up").alias("first_turn"), F.lit(1).alias("depth"))
    done = links.join(links.select("conv", F.col("row").alias("up")), ["conv", "up"], "left_anti")
    chained = cut(links.join(links.select("conv", F.col("row").alias("up")), ["conv", "up"], "left_semi").select(*links.columns))
    if chained.isEmpty():  # no call stands in a result, the usual case
        every = links.withColumn("ring", F.lit(False))
    else:
        state = cut(chained.unionByName(done.select(*links.columns)))
        for _ in range(40):
            above = state.select("conv", F.col("row").alias("up"), F.col("up").alias("further"), F.col("first_turn").alias("t2"), F.col("depth").alias("d2"))
            joined = state.join(above, ["conv", "up"], "left")
            # In a ring the depth would grow for ever; no chain has more links than there are results.
            state = cut(joined.select("conv", "row", F.coalesce("further", "up").alias("up"), F.greatest("first_turn", "t2").alias("first_turn"), (F.col("depth").cast("bigint") + F.coalesce("d2", F.lit(0))).alias("depth"), F.col("further").isNotNull().alias("open")))
            left = state.filter("open").agg(F.count(F.lit(1)).alias("n"), F.min("depth").alias("d")).first()
            if not left.n or left.d > 2 * state.count():
                break
        every = state.select("conv", "row", "first_turn", "depth", F.col("open").alias("ring"))
    every = every.select("conv", "row", "first_turn", F.col("depth").cast("int").alias("depth"), "ring")
    out = special.join(every, ["conv", "row"], "left")
    ring = F.coalesce("ring", F.lit(False))
    return out.withColumns({"first_turn": F.when(~ring, F.col("first_turn")), "depth": F.when(ring, 0).otherwise(F.coalesce("depth", F.lit(0))), "mark": F.when(ring, "cyclic").otherwise(F.col("mark"))}).drop("ring")


_COUNTS = ("n_calls", "n_answered", "n_repeated", "n_invalid")


def _format(df: DataFrame) -> DataFrame:
    is_call, is_result = F.col("n_calls") > 0, F.col("result_of").isNotNull()
    linked = is_result & F.col("linked")
    body = F.try_parse_json("text")
    call_list = F.transform("calls", lambda c: F.struct(c["arguments"].alias("arguments"), c["id"].alias("id"), c["name"].alias("name")))
    held = F.try_variant_get(body, "$.content", "variant")
    # A text is written as it is, anything else as its JSON.
    content = F.when(_kind(held) == "STRING", F.try_variant_get(held, "$", "string")).otherwise(F.to_json(held))
    message = (
        F.when(is_call, F.to_json(F.struct(F.try_variant_get(body, "$.content", "string").alias("content"), "role", call_list.alias("tool_calls"))))
        .when(is_result, F.to_json(F.struct(content.alias("content"), "role", F.col("result_of").alias("tool_call_id"))))
        .otherwise(F.to_json(F.struct(F.col("text").alias("content"), "role"), {"ignoreNullFields": "false"}))
    )
    return df.select(
        "conv_id",
        "turn",
        "role",
        F.when(is_call, "calls").when(is_result, "result").otherwise("message").alias("kind"),
        *[F.col(n).cast("bigint").alias(n) for n in _COUNTS],
        linked.alias("linked"),
        "mark",
        F.when(linked, F.greatest("turn", "first_turn")).otherwise(F.col("turn")).alias("order_turn"),
        F.when(linked, F.col("depth")).otherwise(0).alias("order_rank"),
        canonical(message).alias("message"),
    )
