"""Chat formatting with tool-call linking and canonical JSON.

An assistant message may hold calls, each `<tool_call>{"id": ..., "name": ..., "arguments": {...}}</tool_call>`; a
message of role tool is a result, `{"tool_call_id": ..., "content": ...}`. Calls and results are exploded to narrow
rows and hash-joined by (conversation, identifier). A call whose arguments mention another call's result as
"$identifier" depends on it. Levels of the topological order are settled inside blocks of BLOCK_CALLS neighbouring
calls, then what blocks owe each other is joined and they are settled again: as many rounds as the longest chain
crosses blocks, not as it has calls. Calls on a cycle, and those that wait for one or for an unknown call, get no
level. Arguments are validated against the schema of the named tool. Each message comes back as one line of canonical
JSON (sorted keys, no spaces, whole numbers without fraction) with its place (level, then turn) in the conversation.

Conversations are never gathered into one task or row: a result is a row per message, so one huge conversation is
many rows. Messages without a call or an answer pass without an exchange. Calls and results of one message stay with it.

Defined results: a null text is an empty content and a null role "unknown"; null conv_id and turn are ordinary
values (null links to nothing). Broken JSON makes an invalid call; numbers beyond the range of doubles, NaN, numbers
of thousands of digits and nesting beyond the interpreter's limit are broken JSON. Lone surrogates are kept, written as
escapes. Of several calls with one identifier the first by
turn and position is linked and the others are marked duplicate; a result without a call is an orphan; equal results
all link. Repeated message rows are one message each, but their calls are duplicates of each other. Empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, staged

CALL = re.compile(r"<tool_call>(.*?)</tool_call>", re.S)
REFERENCE = re.compile(r"^\$([A-Za-z0-9_-]+)\Z")
#: Calls whose order one task settles at once.
BLOCK_CALLS = 200_000
_SURROGATE = re.compile("[\ud800-\udfff]")
#: Schemas of tools the query knows: a subset of JSON Schema.
TOOLS = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1}}, "required": ["query"], "additionalProperties": False},
    "calculator": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"], "additionalProperties": False},
    "lookup": {"type": "object", "properties": {"key": {"type": "string"}, "source": {"type": "string", "enum": ["web", "files"]}}, "required": ["key"]},
}


def _refused(number: str):
    raise ValueError(f"no JSON number: {number}")


def _finite(number: str) -> float:
    out = float(number)
    return out if abs(out) != float("inf") else _refused(number)


def loads(text: str):
    """The value of JSON text; what has no finite value is refused with a ValueError or RecursionError."""
    return json.loads(text, parse_float=_finite, parse_constant=_refused)


def canonical(value) -> str:
    """One spelling of a JSON value: sorted keys, no spaces, integers for whole numbers, no escapes beyond need."""

    def plain(v):
        if isinstance(v, float):
            return int(v) if v.is_integer() and abs(v) < 2**53 else v
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v

    out = json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    # columns hold no lone surrogates, JSON escapes do
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", out)


_TYPES = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "integer": lambda v: (isinstance(v, int) and not isinstance(v, bool)) or (isinstance(v, float) and v.is_integer()),
}


def errors(value, schema: dict, at: str = "$") -> list[str]:
    """What is wrong with value; a reference to another result ("$id") passes for any type."""
    if isinstance(value, str) and REFERENCE.match(value):
        return []
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_TYPES[k](value) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if _TYPES["number"](value):
        out += [f"{at}: below minimum"] * (value < schema.get("minimum", value)) + [f"{at}: above maximum"] * (value > schema.get("maximum", value))
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in sorted(value.items()):
            if k in known:
                out += errors(v, known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: not known")
    if isinstance(value, list) and "items" in schema:
        out += [e for n, v in enumerate(value) for e in errors(v, schema["items"], f"{at}[{n}]")]
    return out


def references(value) -> list[str]:
    if isinstance(value, dict):
        return sorted({r for v in value.values() for r in references(v)})
    if isinstance(value, list):
        return sorted({r for v in value for r in references(v)})
    m = REFERENCE.match(value) if isinstance(value, str) else None
    return [m.group(1)] if m else []


def parse(role: str | None, text: str | None, tools: dict) -> tuple[str, list[tuple], str | None]:
    """Content without its calls, the calls (id, name, canonical arguments, error, references), and the call a result answers."""
    text = text or ""
    if role == "tool":
        try:
            body = loads(text)
            if isinstance(body, dict) and isinstance(body.get("tool_call_id"), str):
                content = body.get("content", "")
                return content if isinstance(content, str) else canonical(content), [], body["tool_call_id"]
        except (ValueError, RecursionError):
            pass
        return text, [], None
    calls = []
    if role == "assistant" and "<tool_call>" in text:
        for m in CALL.finditer(text):
            try:
                body = loads(m.group(1))
                if not isinstance(body, dict) or not isinstance(body.get("id"), str) or not isinstance(body.get("name"), str):
                    raise ValueError("no id or name")
                args = body.get("arguments", {})
                args = loads(args) if isinstance(args, str) else args
                wrong = errors(args, tools[body["name"]]) if body["name"] in tools else ["unknown tool"]
                calls.append((body["id"], body["name"], canonical(args), "; ".join(wrong) or None, references(args)))
            except (ValueError, RecursionError):
                calls.append((None, None, None, "broken call", []))
        text = CALL.sub("", text).strip()
    return text, calls, None


#: Strings out of JSON (content, answers, id, name, error, needs) travel as canonical JSON.
_PARSED = "conv_id bigint, turn bigint, role string, content string, answers string, calls array<struct<id:string,name:string,arguments:string,error:string,needs:array<string>>>"


def _parsed(messages: DataFrame, tools: dict) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        call = pa.struct([("id", pa.string()), ("name", pa.string()), ("arguments", pa.string()), ("error", pa.string()), ("needs", pa.list_(pa.string()))])
        coded = lambda s: None if s is None else canonical(s)
        for batch in batches:
            got = [parse(r.as_py(), t.as_py(), tools) for r, t in zip(batch.column(2), batch.column(3))]
            calls = [[{"id": coded(i), "name": coded(n), "arguments": a, "error": coded(e), "needs": [canonical(x) for x in needs]} for i, n, a, e, needs in g[1]] for g in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([canonical(g[0]) for g in got], pa.string()), pa.array([coded(g[2]) for g in got], pa.string()), pa.array(calls, pa.list_(call))], ["conv_id", "turn", "role", "content", "answers", "calls"])

    return map_arrow(messages, run, _PARSED)


def settle(rows: list[tuple]) -> list[tuple[int, list[str]]]:
    """(level, needs still open) of calls (conv_id, id, floor, open needs) among themselves; a level without open needs is final."""
    index = {(c, i): n for n, (c, i, _, _) in enumerate(rows)}
    level, left = [r[2] for r in rows], [set(r[3]) for r in rows]
    waiting = defaultdict(list)
    for n, (c, _, _, needs) in enumerate(rows):
        for need in left[n]:
            if (m := index.get((c, need))) is not None:
                waiting[m].append(n)
    ready = [n for n in range(len(rows)) if not left[n]]
    while ready:
        m = ready.pop()
        for n in waiting.pop(m, ()):
            level[n] = max(level[n], level[m] + 1)
            left[n].discard(rows[m][1])
            if not left[n]:
                ready.append(n)
    return [(a, sorted(b)) for a, b in zip(level, left)]


def _settled(calls: DataFrame) -> DataFrame:
    """calls (conv_id, id, at, level, open) after each block has settled what it can."""

    def run(batches):
        import pyarrow as pa

        def flush(rows):
            got = settle([(c, i, f, o) for c, i, _, f, o in rows])
            columns = ([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [g[0] for g in got], [g[1] for g in got])
            types = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["conv_id", "id", "at", "level", "open"])

        rows: list[tuple] = []
        for batch in batches:
            rows += zip(*(c.to_pylist() for c in batch.columns))
            if len(rows) >= BLOCK_CALLS:
                yield flush(rows)
                rows = []
        if rows:
            yield flush(rows)

    near = calls.select("conv_id", "id", "at", "level", "open").repartitionByRange("conv_id", "at").sortWithinPartitions("conv_id", "at", "id")
    return map_arrow(near, run, "conv_id bigint, id string, at bigint, level int, open array<string>")


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, id and level of calls whose needs can all be met: 1 + the highest level among them.

    calls: conv_id, id, needs, and at, a place near the calls they need; it decides about the work, not the result.
    """
    state = calls.select("conv_id", "id", F.coalesce("at", F.lit(0)).cast("bigint").alias("at"), F.lit(0).alias("level"), F.col("needs").alias("open"))
    done = None
    while True:
        state = staged(_settled(state), "chat-levels")
        new = state.where(F.size("open") == 0).select("conv_id", "id", "level")
        done = new if done is None else done.unionByName(new)
        state = state.where(F.size("open") > 0)
        if new.isEmpty() or state.isEmpty():
            return done
        owed = state.select("conv_id", "id", F.explode("open").alias("need"))
        met = owed.join(new.withColumnsRenamed({"id": "need", "level": "theirs"}), ["conv_id", "need"])
        met = met.groupBy("conv_id", "id").agg((F.max("theirs") + 1).alias("floor"), F.collect_set("need").alias("met"))
        state = state.join(met, ["conv_id", "id"], "left").select("conv_id", "id", "at", F.greatest("level", F.coalesce("floor", F.lit(0))).alias("level"), F.array_except("open", F.coalesce("met", F.array().cast("array<string>"))).alias("open"))


def format_chats(messages: DataFrame, *, tools: dict | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, level, n_calls, n_linked, n_invalid, status and the message's canonical JSON."""
    own = messages.select(F.col(conv_id).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("role"), F.col(text).alias("text"))
    parsed = staged(_parsed(own, TOOLS if tools is None else tools).withColumn("msg", F.monotonically_increasing_id()), "chat-parsed")
    calls = parsed.select("conv_id", "turn", "msg", F.posexplode("calls").alias("pos", "call")).select("conv_id", "turn", "msg", "pos", "call.*")
    named = calls.where("id is not null and conv_id is not null")
    first = named.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "msg", "pos")).alias("first"), F.min_by("needs", F.struct("turn", "msg", "pos")).alias("needs"))
    first = staged(first.select("conv_id", "id", F.col("first.turn").alias("at"), F.col("first.msg").alias("first_msg"), F.col("first.pos").alias("first_pos"), "needs"), "chat-calls")
    order = levels(first)
    results = parsed.where("answers is not null and conv_id is not null").groupBy("conv_id", F.col("answers").alias("id")).agg(F.count(F.lit(1)).alias("n_results"))
    known = first.join(results, ["conv_id", "id"], "left").join(order, ["conv_id", "id"], "left").drop("needs", "at")
    linked = calls.join(known, ["conv_id", "id"], "left")
    status = F.when(F.col("error").isNotNull(), "invalid").when(F.col("first_msg").isNotNull() & ((F.col("first_msg") != F.col("msg")) | (F.col("first_pos") != F.col("pos"))), "duplicate").when(F.col("level").isNull(), "cycle").when(F.col("n_results").isNull(), "unanswered").otherwise("linked")
    by_msg = linked.withColumn("status", status).groupBy("msg").agg(
        F.array_sort(F.collect_list(F.struct("pos", "id", "name", "arguments", "error", "status", "level"))).alias("linked"),
        F.max("level").alias("level"),
    )  # the calls of one message
    answered = known.select("conv_id", F.col("id").alias("answers"), F.lit(True).alias("found"), F.col("level").alias("call_level"))
    # most messages neither call nor answer: they meet no exchange
    calling, answering = F.size("calls") > 0, F.col("answers").isNotNull()
    own_calls = parsed.where(calling).drop("calls").join(by_msg, "msg", "left").withColumns({"found": F.lit(None).cast("boolean"), "call_level": F.lit(None).cast("int")})
    own_results = parsed.where(~calling & answering).drop("calls").join(answered, ["conv_id", "answers"], "left")
    plain = parsed.where(~calling & ~answering).drop("calls")
    return _written(own_calls.unionByName(own_results, allowMissingColumns=True).unionByName(plain, allowMissingColumns=True))


_WRITTEN = "conv_id bigint, turn bigint, role string, level int, n_calls bigint, n_linked bigint, n_invalid bigint, status string, message string"


def _written(rows: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        names = ["conv_id", "turn", "role", "level", "n_calls", "n_linked", "n_invalid", "status", "message"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

        def joined(**parts: str | None) -> str:
            """An object whose values are canonical JSON already."""
            return "{" + ",".join(f'"{k}":{v}' for k, v in sorted(parts.items()) if v is not None) + "}"

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                calls = r["linked"] or []
                told = [joined(arguments=c["arguments"], error=c["error"], id=c["id"], name=c["name"], status=canonical(c["status"])) for c in calls]
                state = ("result" if r["found"] else "orphan") if r["role"] == "tool" else "calls" if calls else "plain"
                level = r["level"] if r["level"] is not None else r["call_level"]
                message = joined(content=r["content"], role=canonical(r["role"]), tool_calls=f"[{','.join(told)}]" if told else None, tool_call_id=r["answers"])
                out.append((r["conv_id"], r["turn"], r["role"], level or 0, len(calls), sum(c["status"] == "linked" for c in calls), sum(c["status"] != "linked" for c in calls), state, message))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate(types)], names)

    return map_arrow(rows.select("conv_id", "turn", "role", "content", "answers", "linked", "level", "found", "call_level"), run, _WRITTEN)


def ordered(chats: DataFrame) -> DataFrame:
    """chats with place, the number of each message in its conversation by (turn, level); for consumers that need a
    total order and whose conversations fit a task."""
    return chats.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "level", "message")) - 1)
