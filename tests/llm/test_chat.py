import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from streamlearn.llm import chat as C
from streamlearn.llm import queries as Q


def call(i, name="search", **args):
    return f'<tool_call>{json.dumps({"id": i, "name": name, "arguments": args})}</tool_call>'


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


ROWS = [
    (1, 0, "user", "hello"),
    (1, 1, "assistant", "let me see " + call("a", query="x", limit=2.0) + call("b", "lookup", key="$a", source="web") + call("c", "lookup", key="$b")),
    (1, 2, "tool", result("b", {"z": 1, "a": [1.0, 2.5]})),
    (1, 3, "tool", result("a", "found")),
    (1, 4, "tool", result("zz", "nobody asked")),
    (1, 5, "assistant", call("a", query="again") + call("d", limit=0) + call("e", "nothing", k=1) + "<tool_call>{broken</tool_call>"),
    (2, 0, "assistant", call("p", "lookup", key="$q") + call("q", "lookup", key="$p")),
    (2, 1, None, None),
    (None, None, "tool", result("a", "lost")),
    (3, 0, "tool", "not json"),
    (1, 6, "assistant", "äö \"quoted\" \n" + call("c2", "calculator", expression="1+1")),
    (1, 7, "tool", result("c2", "2")),
    (1, 7, "tool", result("c2", "2")),
]


def test_links(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "conv_id bigint, turn bigint, role string, text string, msg string")
    rows = C.format_chats(df).collect()
    assert len(rows) == len(ROWS)
    by = {(r.conv_id, r.turn): r for r in rows}
    m = json.loads(by[1, 1].message)
    assert [(c["id"], c["status"]) for c in m["tool_calls"]] == [("a", "linked"), ("b", "linked"), ("c", "unanswered")]
    assert m["tool_calls"][0]["arguments"] == {"limit": 2, "query": "x"} and by[1, 1].level == 2 and m["content"] == "let me see"
    assert by[1, 2].status == "result" and by[1, 2].level == 1 and json.loads(by[1, 2].message)["content"] == '{"a":[1,2.5],"z":1}'
    assert by[1, 3].status == "result" and by[1, 3].level == 0 and by[1, 4].status == "orphan"
    assert [c["status"] for c in json.loads(by[1, 5].message)["tool_calls"]] == ["duplicate", "invalid", "invalid", "invalid"]
    assert [c["status"] for c in json.loads(by[2, 0].message)["tool_calls"]] == ["cycle", "cycle"]
    assert json.loads(by[2, 1].message) == {"content": "", "role": "unknown"}
    assert by[None, None].status == "orphan" and by[3, 0].status == "orphan"
    assert by[1, 6].message == '{"content":"äö \\"quoted\\"","role":"assistant","tool_calls":[{"arguments":{"expression":"1+1"},"id":"c2","name":"calculator","status":"linked"}]}'
    places = sorted((r.turn, r.place) for r in C.ordered(C.format_chats(df)).where("conv_id = 1").collect())
    assert [p for _, p in places] == list(range(9))


def test_schema_errors():
    s = {"type": "object", "properties": {"a": {"type": ["integer", "null"]}, "b": {"type": "array", "items": {"type": "boolean"}}}, "required": ["a"], "additionalProperties": False}
    assert C.errors({"a": None, "b": [True]}, s) == []
    assert C.errors({"a": 1.5, "b": [True, 1], "c": 0}, s) == ["$.a: not integer or null", "$.b[1]: not boolean", "$.c: not known"]
    assert C.errors({"a": "$other"}, s) == [] and C.errors([], s) == ["$: not object"]


def test_query(spark, sf_dir):
    want = sorted((r.conv_id, r.turn, C.canonical({"content": r.text or "", "role": r.role})) for r in Q.read(spark, sf_dir, "conversations").collect())
    assert sorted((r.conv_id, r.turn, r.message) for r in Q.op8_chat(spark, sf_dir).collect()) == want


def test_empty(spark):
    assert C.format_chats(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def plain_json(v):
    """Canonical JSON written out by hand."""
    if isinstance(v, dict):
        return "{" + ",".join(f"{plain_json(k)}:{plain_json(v[k])}" for k in sorted(v)) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(plain_json, v)) + "]"
    if isinstance(v, float) and v == round(v) and abs(v) < 2**53:
        return str(round(v))
    out = json.dumps(v, ensure_ascii=False)
    return "".join(f"\\u{ord(c):04x}" if 0xD800 <= ord(c) < 0xE000 else c for c in out)


def no_infinity(v):
    if isinstance(v, float) and (v != v or v in (float("inf"), -float("inf"))):
        raise ValueError
    for x in v.values() if isinstance(v, dict) else v if isinstance(v, list) else ():
        no_infinity(x)
    return v


def brute_chats(rows):
    """A plain linker: everything of a conversation at once, levels by recursion."""
    parsed = []
    for n, (conv, turn, role, text) in enumerate(rows):
        role, text, calls, answers = role or "unknown", text or "", [], None
        if role == "assistant":
            for part in re.findall(r"(?s)<tool_call>(.*?)</tool_call>", text):
                try:
                    body = no_infinity(json.loads(part))
                    calls.append((body["id"] + "", body["name"] + "", body.get("arguments", {})))
                except (ValueError, TypeError, KeyError, AttributeError, RecursionError):
                    calls.append(None)
            if calls:
                text = re.sub(r"(?s)<tool_call>.*?</tool_call>", "", text)
            text = text.strip() if "<tool_call>" in (rows[n][3] or "") else text
        if role == "tool":
            try:
                body = no_infinity(json.loads(text))
                answers = body["tool_call_id"] + ""
                content = body.get("content", "")
                text = content if isinstance(content, str) else plain_json(content)
            except (ValueError, TypeError, KeyError, AttributeError, RecursionError):
                answers = None
        parsed.append((conv, turn, role, text, calls, answers))
    first, answered = {}, {(p[0], p[5]) for p in parsed if p[5] is not None and p[0] is not None}
    for n in sorted(range(len(rows)), key=lambda n: (rows[n][1] is not None, rows[n][1] or 0, n)):
        for k, c in enumerate(parsed[n][4]):
            if c and parsed[n][0] is not None:
                first.setdefault((parsed[n][0], c[0]), (n, k, c))

    def needs(v):
        if isinstance(v, (dict, list)):
            return {r for x in (v.values() if isinstance(v, dict) else v) for r in needs(x)}
        return {v[1:]} if isinstance(v, str) and re.fullmatch(r"\$[A-Za-z0-9_-]+", v) else set()

    level = {}

    def level_of(key, seen=()):
        if key not in first or key in seen:
            return None
        if key not in level:
            below = [level_of((key[0], r), (*seen, key)) for r in needs(first[key][2][2])]
            got = None if None in below else 1 + max(below, default=-1)
            if got is None and seen:
                return None  # it may only wait for the cycle that asks
            level[key] = got
        return level[key]

    out = Counter()
    for n, (conv, turn, role, text, calls, answers) in enumerate(parsed):
        body, states, levels = {"content": text, "role": role}, [], []
        for k, c in enumerate(calls):
            key = c and (conv, c[0])
            if c is None:
                states.append({"error": "broken call", "status": "invalid"})
                continue
            wrong = "; ".join(C.errors(c[2], C.TOOLS[c[1]]) if c[1] in C.TOOLS else ["unknown tool"])
            lv = level_of(key) if conv is not None else None
            status = "invalid" if wrong else "duplicate" if key in first and first[key][:2] != (n, k) else "cycle" if lv is None else "linked" if key in answered else "unanswered"
            levels += [lv] if lv is not None else []
            states.append({"arguments": c[2], "error": wrong, "id": c[0], "name": c[1], "status": status} if wrong else {"arguments": c[2], "id": c[0], "name": c[1], "status": status})
        if calls:
            body["tool_calls"] = states
        if answers is not None:
            body["tool_call_id"] = answers
        found = conv is not None and (conv, answers) in first
        state = ("result" if found else "orphan") if role == "tool" else "calls" if calls else "plain"
        place = max(levels, default=0) if calls else (level_of((conv, answers)) or 0) if found else 0
        linked = sum(s["status"] == "linked" for s in states)
        out[conv, turn, role, place, len(calls), linked, len(calls) - linked, state, plain_json(body)] += 1
    return out


def chats(seed, turns):
    rnd = random.Random(seed)
    ids = [f"c{k}" for k in range(turns)] + ["\ud800", "\ud801", "\U0001f600", ""]
    raw = ['{"id":"x","name":"search","arguments":{"query":"q","limit":1e999}}', '{"id":"y","name":"search","arguments":{"query":"q","limit":NaN}}', '{"id":"z","name":"search","arguments":' + "[" * 5000 + "]" * 5000 + "}", '{"id":"w","name":"search","arguments":{"limit":' + "9" * 5000 + "}}", "{", "[1]", '{"id":1}', '{"id":"v","name":"\\ud800","arguments":{"\\ud800":"\\udfff"}}']
    rows = []
    for conv in (1, 2, None):
        for t in range(turns):
            kind = rnd.randrange(6)
            if kind < 3:
                made = []
                for _ in range(rnd.randrange(3)):
                    name = rnd.choice(["search", "lookup", "calculator", "none"])
                    args = {"search": {"query": "$" + rnd.choice(ids[:turns]), "limit": rnd.choice([1, 2.0, 2.5, 0, 1e300])}, "lookup": {"key": "$" + rnd.choice(ids[:turns]), "more": [{"x": "$" + rnd.choice(ids[:turns])}] * rnd.randrange(2)}, "calculator": {"expression": rnd.choice(["1", "\ud83d", 5])}, "none": {}}[name]
                    made.append("<tool_call>" + json.dumps({"id": rnd.choice(ids), "name": name, "arguments": args}) + "</tool_call>")
                if rnd.random() < 0.2:
                    made.append(f"<tool_call>{rnd.choice(raw)}</tool_call>")
                rows.append((conv, t, "assistant", " say ".join(made)))
            elif kind < 5:
                rows.append((conv, t, "tool", rnd.choice([result(rnd.choice(ids), rnd.choice(["ok", "\udc00", {"b": 1.0, "a": [1e20, None]}])), '{"tool_call_id":"c1","content":1e999}', "plain", None])))
            else:
                rows.append((conv, rnd.choice([t, None]), rnd.choice(["user", None]), rnd.choice(["hi", "", None, "<tool_call>{}</tool_call>"])))
    return rows


@pytest.mark.parametrize(("seed", "block"), [(1, 200_000), (2, 7), (3, 1)])
def test_against_a_plain_linker(spark, tmp_path, monkeypatch, seed, block):
    monkeypatch.setattr(C, "BLOCK_CALLS", block)
    rows = chats(seed, 40)
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = Counter(tuple(r) for r in Q.op8_chat(spark, str(tmp_path)).collect())
    assert got == brute_chats(rows)


def test_long_chains_take_few_rounds(spark, monkeypatch):
    rounds = []
    real = C.staged
    monkeypatch.setattr(C, "staged", lambda df, name: (rounds.append(name), real(df, name))[1])
    n = 3000
    df = spark.range(n).select(F.lit(1).cast("bigint").alias("conv_id"), F.concat(F.lit("c"), "id").alias("id"), F.when(F.col("id") > 0, F.array(F.concat(F.lit("c"), F.col("id") - 1))).otherwise(F.array().cast("array<string>")).alias("needs"), F.col("id").alias("at"))
    out = C.levels(df.repartition(7))
    assert {(r.id, r.level) for r in out.collect()} == {(f"c{k}", k) for k in range(n)}
    assert len(rounds) <= 10


def test_settle():
    rows = [(1, "a", 0, ["b", "z"]), (1, "b", 3, []), (1, "c", 0, ["b", "d"]), (1, "d", 0, ["b"]), (1, "e", 0, ["e"]), (2, "b", 0, ["a"])]
    assert C.settle(rows) == [(4, ["z"]), (3, []), (5, []), (4, []), (0, ["e"]), (0, ["a"])]
