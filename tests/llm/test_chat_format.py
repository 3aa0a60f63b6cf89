import json
import random

from recordloom.llm import chat_format as C

TOOLS = {"add": (["a", "b"], {"a": "integer", "b": "number", "note": "string"})}
SCHEMA = "conv_id long, turn long, role string, text string, kind string"


def _call(i, name="add", args=None, nested=False):
    args = {"b": 1.5, "a": 1} if args is None else args
    return {"id": i, "function": {"name": name, "arguments": json.dumps(args)}} if nested else {"id": i, "name": name, "arguments": args}


def _calls(*calls):
    return json.dumps({"content": "x", "tool_calls": list(calls)})


def _result(i, content="ok"):
    return json.dumps({"tool_call_id": i, "content": content})


def _problems(name, args):
    if name is None:
        return ["no_name"]
    if name not in TOOLS:
        return ["unknown_tool:" + name]
    if not isinstance(args, dict):
        return ["arguments"]
    required, props = TOOLS[name]
    kinds = {"integer": lambda v: type(v) is int, "number": lambda v: type(v) in (int, float), "string": lambda v: type(v) is str}
    out = [f"missing:{k}" for k in required if k not in args] + [f"type:{k}" for k in props if k in args and not kinds[props[k]](args[k])]
    return sorted(out + [f"unknown:{k}" for k in args if k not in props])


def _brute(rows):
    out = []
    for conv, turn, role, text, _ in rows:
        body = None
        try:
            body = json.loads(text or "")
        except ValueError:
            pass
        body = body if isinstance(body, dict) else {}
        calls = body.get("tool_calls", []) if role == "assistant" else []
        of = body.get("tool_call_id")
        call_turn = [t for c, t, r, x, _ in rows if c == conv and r == "assistant" and of and f'"id": "{of}"' in (x or "")]
        answered = [c for c in calls if any(c2 == conv and f'"tool_call_id": "{c["id"]}"' in (x or "") for c2, _, _, x, _ in rows)]
        invalid = 0
        for c in calls:
            f = c.get("function", {})
            args = c.get("arguments", json.loads(f["arguments"]) if "arguments" in f else None)
            invalid += bool(_problems(c.get("name", f.get("name")), args))
        out.append((conv, turn, role, len(calls), len(answered), invalid, bool(call_turn), max(turn, min(call_turn)) if call_turn else turn))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    r = random.Random(4)
    rows = []
    for conv in range(12):
        ids = [f"c{conv}_{k}" for k in range(4)]
        for turn in range(10):
            what = r.randrange(4)
            if what == 0 and ids:
                some = [ids.pop() for _ in range(r.randrange(1, len(ids) + 1))]
                args = [{"a": 1, "b": 2}, {"a": "x"}, {"b": 1, "z": 1}, [1]]
                rows.append((conv, turn, "assistant", _calls(*[_call(i, r.choice(["add", "nope"]), r.choice(args), r.random() < 0.5) for i in some]), "k"))
            elif what == 1:
                rows.append((conv, turn, "tool", _result(f"c{conv}_{r.randrange(5)}"), "k"))
            else:
                rows.append((conv, turn, r.choice(["user", "assistant", None]), r.choice(["hi", "", None, '{"x": 1}', "tool_calls {"]), "k"))
    got = C.link(spark.createDataFrame(rows, SCHEMA), TOOLS)
    have = sorted(((x.conv_id, x.turn, x.role, x.n_calls, x.n_answered, x.n_invalid, x.linked, x.order_turn) for x in got.collect()), key=str)
    assert have == _brute(rows)


def test_order_and_canonical_json(spark):
    rows = [(1, 0, "user", 'say "hi"\n', "k"), (1, 1, "tool", _result("q", {"b": 1, "a": [{"z": 1, "y": None}]}), "k"), (1, 2, "assistant", _calls(_call("q")), "k"), (1, 3, "user", "x" * 200_000, "k")]
    got = C.link(spark.createDataFrame(rows, SCHEMA), TOOLS).orderBy("conv_id", "order_turn", "order_rank", "turn").collect()
    assert [x.turn for x in got] == [0, 2, 1, 3]
    for x in got:
        body = json.loads(x.message)
        assert x.message == json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert json.loads(json.loads(got[1].message)["tool_calls"][0]["arguments"]) == {"a": 1, "b": 1.5}


def test_repeats_orphans_and_null_conversations(spark):
    call = _calls(_call("a"), _call("b"))
    rows = [
        (1, 0, "assistant", call, "k"), (1, 0, "assistant", call, "k"), (1, 1, "tool", _result("a", "first"), "k"), (1, 1, "tool", _result("a", "first"), "k"), (1, 2, "tool", _result("a", "again"), "k"),
        (1, 3, "tool", _result("z"), "k"), (1, 4, "assistant", _calls(_call("b"), _call("c")), "k"), (1, 0, "assistant", _calls(_call("d")), "k"),
        (None, 0, "assistant", _calls(_call("q")), "k"), (None, 1, "tool", _result("q"), "k"), (None, None, "tool", _result("q", "x"), "k"), (2, None, "user", "hi", "k"),
    ]
    got = sorted(((x.conv_id or 0, -1 if x.turn is None else x.turn, x.n_calls, x.n_answered, x.n_repeated, x.linked, x.mark or "") for x in C.link(spark.createDataFrame(rows, SCHEMA), TOOLS).collect()))
    assert got == sorted([
        (1, 0, 2, 1, 0, False, ""), (1, 0, 2, 1, 0, False, ""), (1, 1, 0, 0, 0, True, ""), (1, 1, 0, 0, 0, True, ""), (1, 2, 0, 0, 0, True, "repeated"), (1, 3, 0, 0, 0, False, "orphaned"),
        (1, 4, 2, 0, 1, False, ""), (1, 0, 1, 0, 0, False, ""), (0, 0, 1, 1, 0, False, ""), (0, 1, 0, 0, 0, True, "repeated"), (0, -1, 0, 0, 0, True, ""), (2, -1, 0, 0, 0, False, ""),
    ])


def test_the_query_links_calls(spark, tmp_path):
    from recordloom.llm.queries import op6_chat_format

    rows = [(1, 0, "user", "find it", "k"), (1, 1, "tool", _result("s"), "k"), (1, 2, "assistant", _calls(_call("s", "search", {"query": "it", "limit": 3}), _call("t", "search", {"limit": "3"})), "k")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {x.turn: x for x in op6_chat_format(spark, str(tmp_path)).collect()}
    assert got[1].linked and (got[1].order_turn, got[1].order_rank) == (2, 1) and (got[2].n_calls, got[2].n_answered, got[2].n_invalid) == (2, 1, 1)


def test_empty(spark):
    assert C.link(spark.createDataFrame([], SCHEMA), TOOLS).count() == 0


def test_malformed_elements_escaped_keys_and_texts(spark):
    rows = [
        (1, 0, "assistant", json.dumps({"tool_calls": [1, _call("p"), None, "x", _call("q", nested=True), {"id": 7, "name": ["no"]}]}), "k"),
        (1, 1, "tool", _result("p", "r"), "k"),
        (1, 2, "tool", '{"\\u0074ool_call_id": "q", "content": "say \\"r\\""}', "k"),
        (2, 0, "assistant", '{"\\u0074ool_c\\u0061lls": [{"id": "z", "name": "add", "arguments": {"a": 1, "b": 2}}]}', "k"),
        (2, 1, "user", "an escape \\u0041 in words, and {\\u0041", "k"),
    ]
    got = {(x.conv_id, x.turn): x for x in C.link(spark.createDataFrame(rows, SCHEMA), TOOLS).collect()}
    assert (got[1, 0].kind, got[1, 0].n_calls, got[1, 0].n_answered, got[1, 0].n_invalid) == ("calls", 6, 2, 4)
    assert got[1, 1].linked and json.loads(got[1, 1].message)["content"] == "r"
    assert got[1, 2].linked and json.loads(got[1, 2].message) == {"content": 'say "r"', "role": "tool", "tool_call_id": "q"}
    assert (got[2, 0].kind, got[2, 0].n_calls, got[2, 0].n_invalid) == ("calls", 1, 0) and got[2, 1].kind == "message"


def test_chains_and_rings(spark):
    both = lambda of, *ids: json.dumps({"tool_call_id": of, "tool_calls": [_call(i) for i in ids]})
    rows = [
        (1, 1, "tool", _result("c"), "k"), (1, 2, "assistant", both("b", "c"), "k"), (1, 3, "assistant", both("a", "b"), "k"), (1, 9, "assistant", _calls(_call("a")), "k"), (1, 12, "tool", _result("b"), "k"),
        (2, 1, "assistant", both("y", "x"), "k"), (2, 2, "assistant", both("x", "y"), "k"), (2, 3, "tool", _result("x"), "k"),
    ]
    got = {(x.conv_id, x.turn): x for x in C.link(spark.createDataFrame(rows, SCHEMA), TOOLS).collect()}
    key = lambda t: (got[1, t].order_turn, got[1, t].order_rank, t)
    assert key(9) < key(3) < key(2) < key(1) < key(12) and got[1, 12].mark == "repeated"
    assert [(got[2, t].order_turn, got[2, t].order_rank, got[2, t].mark) for t in (1, 2)] == [(1, 0, "cyclic"), (2, 0, "cyclic")]


def test_nested_schemas(spark):
    tools = {"make": (["kind"], {"kind": {"type": "string", "enum": ["a", "b"]}, "tags": {"type": "array", "items": {"type": "string", "enum": ["x", "y"]}}, "size": {"type": "object", "required": ["w"], "properties": {"w": "integer", "unit": {"enum": [1, "cm", None]}}}})}
    cases = [
        ({"kind": "a"}, []), ({"kind": "c"}, ["enum:kind"]), ({"kind": 1}, ["type:kind"]), ({"kind": "a", "tags": ["x", "y"]}, []), ({"kind": "a", "tags": ["x", 1]}, ["items:tags"]), ({"kind": "a", "tags": "x"}, ["type:tags"]),
        ({"kind": "b", "size": {"w": 1, "unit": "cm"}}, []), ({"kind": "b", "size": {"unit": "m"}}, ["enum:size.unit", "missing:size.w"]), ({"kind": "b", "size": {"w": "1", "unit": None}}, ["type:size.w"]), ({"kind": "b", "size": 3}, ["type:size"]), ({"tags": []}, ["missing:kind"]),
    ]
    rows = [(1, i, "assistant", _calls(_call(f"c{i}", "make", a)), "k") for i, (a, _) in enumerate(cases)]
    turns = spark.createDataFrame(rows, SCHEMA).selectExpr("conv_id AS conv", "turn AS row", "role", "text")
    got = {x.row: list(x.problems) for x in C.calls_of(turns, tools).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}
