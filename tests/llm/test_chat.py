import json

from veldspar.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, level string"


def call(i, name="search", args=None, **more):
    return {"id": i, "type": "function", "function": {"name": name, "arguments": {"query": "x"} if args is None else args}, **more}


def test_links_orders_and_validates(spark):
    rows = [
        (1, 0, "user", "hi \"you\"\n", "a"),
        (1, 1, "assistant", json.dumps({"content": "ok", "tool_calls": [call("a"), call("b", "search", json.dumps({"limit": 1}))]}), "a"),
        (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": {"z": 1, "b": [2]}}), "a"),
        (1, 3, "tool", json.dumps({"tool_call_id": "nowhere", "content": "?"}), "a"),
        (1, 4, "tool", json.dumps({"tool_call_id": "a", "content": "again"}), "a"),
        (2, 0, "tool", json.dumps({"tool_call_id": "c", "content": "early"}), None),
        (2, 5, "assistant", json.dumps({"tool_calls": [call("c", "calculator", {"expression": "1"})]}), None),
        (2, 1, "assistant", json.dumps({"tool_calls": [call("d", "weather", {"place": "$c", "unit": "K"}, depends_on=["c"])]}), None),
        (3, 0, "assistant", json.dumps({"tool_calls": [call("e", depends_on=["f"]), call("f", depends_on=["e"])]}), None),
        (4, 0, None, None, None),
        (None, None, "assistant", "{not json", None),
        (1, 0, "user", "hi \"you\"\n", "a"),
        (5, 0, "assistant", json.dumps({"tool_calls": [call("g", "other", {"q": 1}), call("g", "search", [1])]}), None),
    ]
    out = chat.link(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    by = {(r.conv_id, r.turn): r for r in out}
    assert by[1, 0].status == "plain" and by[1, 0].json == '{"content":"hi \\"you\\"\\n","role":"user"}'
    one = by[1, 1]
    assert (one.status, one.n_calls, one.n_answered, one.n_invalid) == ("calls", 2, 1, 1)
    assert json.loads(one.json)["tool_calls"][1]["function"]["arguments"] == '{"limit":1}'
    assert by[1, 2].status == "linked" and json.loads(by[1, 2].json)["content"] == '{"b":[2],"z":1}'
    assert by[1, 3].status == "orphan" and by[1, 4].status == "duplicate"
    assert by[3, 0].status == "cycle" and by[4, 0].role == "unknown" and by[None, None].status == "plain"
    assert by[5, 0].status == "duplicate" and by[5, 0].n_invalid == 2
    two = sorted((r for r in out if r.conv_id == 2), key=lambda r: (r.order_turn, r.level, r.is_result, r.turn))
    assert [r.turn for r in two] == [5, 0, 1]  # the call, its result, then the call that needs it
    assert by[2, 1].n_invalid == 1 and by[2, 1].level == 1


def test_empty(spark):
    assert chat.link(spark.createDataFrame([], SCHEMA)).count() == 0
