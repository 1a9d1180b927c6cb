import json
import random

from tidemark.llm import toolcalls

CALLS = "thread string, call_id string, name string, arguments string, needs array<string>, errors string"
RESULTS = "thread string, call_id string, content string, level int"
RULES = [("add", "a", "integer", True), ("add", "b", "number", True), ("add", "note", "string", False), ("go", "list", "array", True), ("go", "map", "object", None), ("go", "flag", "boolean", None), ("add", "a", "integer", True), (None, "x", "string", True), ("odd", None, "string", True)]


def linked(spark, calls, results, rules=RULES):
    schema = spark.createDataFrame(rules, "name string, parameter string, type string, required boolean")
    return toolcalls.link_calls(spark.createDataFrame([(*c, "x") for c in calls], CALLS), spark.createDataFrame([(*r, 1) for r in results], RESULTS), schema).collect()


def test_links_levels_and_errors(spark):
    calls = [
        ("t", "1", "add", '{"b": 2.5, "a": 1}', None),
        ("t", "2", "add", '{"a":"x","b":1,"z":null}', ["1"]),
        ("t", "3", "go", '{"list":[{"y":1,"x":[ ]}],"map":{"k":{"b":1,"a":2}},"flag":true}', ["2", "1", None]),
        ("t", "4", "go", "[1]", ["9"]),
        ("t", "5", "go", "{bad", []),
        ("t", "6", "none", "{}", ["7"]),
        ("t", "7", "add", None, ["6"]),
        ("t", "8", "add", '{"a":1,"b":1}', ["7"]),
        ("u", "1", "add", '{"a":1,"b":1,"note":"é \\"q\\" \\n"}', []),
        ("u", "1", "add", '{"a":1,"b":1}', []),
        (None, "1", "add", '{"a":1,"b":1}', ["1"]),
        ("u", None, "add", '{"a":1,"b":1}', ["1"]),
    ]
    results = [("t", "1", "one"), ("t", "1", "again"), ("t", "3", None), ("u", "1", "é" * 100_000), ("u", "77", "lost"), (None, "1", "nowhere"), (None, "1", "nowhere")]
    rows = linked(spark, calls, results)
    got = {(r["thread"], r["call_id"]): r for r in rows if r["kind"] == "call" and (r["thread"], r["call_id"]) != ("u", "1")}
    assert {k[1]: r["level"] for k, r in got.items() if k[0] == "t"} == {"1": 0, "2": 1, "3": 2, "4": 0, "5": 0, "6": None, "7": None, "8": None}
    errors = {k: r["errors"] for k, r in got.items()}
    assert errors[("t", "1")] == errors[("t", "3")] == errors[(None, "1")] == errors[("u", None)] == []
    assert errors[("t", "2")] == ["type a", "unknown z"] and errors[("t", "4")] == ["arguments", "need"] and errors[("t", "5")] == ["arguments"]
    assert errors[("t", "6")] == ["schema", "circle"] and errors[("t", "7")] == ["arguments", "circle"] and errors[("t", "8")] == ["circle"]
    assert got[("t", "1")]["n_results"] == 2 and json.loads(got[("t", "1")]["json"]) == {"arguments": {"a": 1, "b": 2.5}, "call_id": "1", "name": "add", "result": "again"}
    assert got[("t", "3")]["json"] == '{"arguments":{"flag":true,"list":[{"x":[],"y":1}],"map":{"k":{"a":2,"b":1}}},"call_id":"3","name":"go","result":null}'
    assert got[(None, "1")]["n_results"] == 0 and got[("t", "5")]["json"].startswith('{"arguments":null,')
    twice = [r for r in rows if (r["thread"], r["call_id"]) == ("u", "1")]
    assert len(twice) == 2 and all(r["n_results"] == 1 and json.loads(r["json"])["result"] == "é" * 100_000 for r in twice)
    assert sorted((str(r["thread"]), r["call_id"], *r["errors"]) for r in rows if r["kind"] == "result") == [("None", "1", "call"), ("None", "1", "call"), ("t", "1", "repeated"), ("u", "77", "call")]
    assert [json.loads(r["json"])["result"] for r in rows if r["errors"] == ["repeated"]] == ["one"]
    assert len(rows) == len(calls) + 4


def slow_levels(needs):
    """{call: level} by recursion; None in or behind a circle."""
    found = {}

    def level(c, above):
        if c in above:
            return None
        if c not in found:
            own = [level(n, above | {c}) for n in needs[c] if n in needs]
            found[c] = None if None in own else max((x + 1 for x in own), default=0)
        return found[c]

    return {c: level(c, frozenset()) for c in needs}


def test_levels_of_long_chains_and_any_graph(spark):
    rng = random.Random(7)
    graphs = {"chain": {str(i): [str(i - 1)] for i in range(300)}, "ring": {str(i): [str((i + 1) % 9)] for i in range(9)} | {"x": ["3"], "y": ["x"], "z": ["y", "free"], "free": []}}
    for g in range(12):
        n = rng.randrange(2, 25)
        graphs[f"g{g}"] = {str(i): [str(rng.randrange(max(1, i))) for _ in range(rng.choice([0, 1, 1, 1, 2, 3])) if i] for i in range(n)}
    rows = [(g, c, own) for g, needs in graphs.items() for c, own in needs.items()]
    got = {(r["thread"], r["call_id"]): r["level"] for r in toolcalls.levels(spark.createDataFrame(rows, "thread string, call_id string, needs array<string>")).collect()}
    assert got == {(g, c): level for g, needs in graphs.items() for c, level in slow_levels(needs).items()}


def test_places(spark):
    rows = [("a", str(i), "call", i % 5 if i % 7 else None, "{}") for i in range(400)] + [(None, "1", "call", 0, "x"), (None, "1", "call", 0, "x"), ("b", None, "result", None, "y")]
    got = toolcalls.in_order(spark.createDataFrame(rows, "thread string, call_id string, kind string, level int, json string")).collect()
    for thread in ("a", None, "b"):
        own = sorted((r for r in got if r["thread"] == thread), key=lambda r: r["place"])
        assert [r["place"] for r in own] == list(range(len(own)))
        assert own == sorted(own, key=lambda r: (r["level"] is None, r["level"] or 0, r["call_id"] or ""))


def test_conversations_of_odd_rows(spark):
    turns = spark.createDataFrame(
        [(1, 0, "system", "s", 0), (1, 1, "user", None, 0), (1, 1, "user", None, 0), (1, 2, "assistant", "b", 0), (1, 2, "assistant", "a", 0), (1, 5, "user", "u", 0), (None, 0, "user", "n", 0), (2, None, None, "n", 0), (3, 3, "assistant", "x" * 300_000, 0)],
        "conv_id long, turn long, role string, text string, level int",
    )
    rows = toolcalls.in_order(toolcalls.of_conversations(turns)).collect()
    got = sorted((str(r["thread"]), str(r["call_id"]), r["kind"], r["level"] if r["level"] is not None else -1, r["n_results"], *r["errors"]) for r in rows)
    assert got == [
        ("1", "0", "call", 0, 0, "type turn"), ("1", "1", "call", 1, 2, "missing text"), ("1", "1", "call", 1, 2, "missing text"), ("1", "1", "result", -1, 1, "repeated"), ("1", "5", "call", 0, 0, "need"),
        ("2", "None", "call", -1, 0, "missing turn"), ("3", "2", "result", -1, 1, "call"), ("None", "0", "call", -1, 0, "missing previous"),
    ]
    assert toolcalls.in_order(toolcalls.of_conversations(turns.limit(0))).collect() == []


def test_empty(spark):
    assert linked(spark, [], []) == []
    assert [r["kind"] for r in linked(spark, [], [("t", "1", "x")])] == ["result"]
    assert [r["errors"] for r in linked(spark, [("t", "1", "add", "{}", None)], [], [("a", "b", "string", True)])] == [["schema"]]
