"""Chat formatting: tool-call linking, topological order, argument checks and canonical JSON.

An assistant text that is a JSON object with `tool_calls` holds calls {id, name, arguments}; a tool text that is a JSON object with
`tool_call_id` holds a result. Any other text is plain. Calls and results meet by (conversation, identifier) in hash joins, arguments are checked
against the tool's schema, and a call whose arguments name another call's result ({"$ref": id}) comes after it: depth 0 for calls that name none,
else one more than the deepest they name. The calls of a message stand by depth, then as given, those without depth last; results stand right behind their calls. Each message becomes one line of canonical JSON: sorted keys, no
spaces, UTF-8, shortest numbers.

One row comes out for each message, so that a conversation of any length is never gathered in one place; at_turn, is_answer, at_depth, at_place and turn order it.
Behaviour at the edges: null text counts as empty, null role as user; rows without a conversation or turn are kept, with nulls; broken JSON is plain text; a
result without call, a call without result and identifiers that several calls share are marked, not dropped: of calls that share one, results link
with the first by turn and place; calls that wait for each other in a circle, or for a call that does not exist, have depth null and are
invalid; a message that repeats is repeated in the output, and its calls, which then share their identifiers, are invalid; texts of any length are read whole;
columns beside the four are ignored, whatever their names; empty tables give no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from caseworks.llm.workspace import drop, settle, ship

TYPES = {"string": (str,), "integer": (int,), "number": (int, float), "boolean": (bool,), "object": (dict,), "array": (list,), "null": (type(None),)}


def canonical(value: object) -> str:
    """JSON with sorted keys and no spaces; numbers that are whole are written as integers."""

    def plain(x: object) -> object:
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        if isinstance(x, float):
            if x != x or x in (float("inf"), float("-inf")):
                return None
            return int(x) if x.is_integer() and abs(x) < 1 << 53 else x
        return x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def violations(value: object, schema: dict, at: str = "$") -> list[str]:
    """Where the value breaks the schema (type, enum, minimum, maximum, required, properties, additionalProperties, items)."""
    if isinstance(value, dict) and set(value) == {"$ref"}:
        return []  # filled in by another call's result
    kinds = schema.get("type")
    if kinds is not None:
        names = [kinds] if isinstance(kinds, str) else kinds
        fits = any(isinstance(value, TYPES[n]) and (n in ("boolean",) or not isinstance(value, bool)) for n in names)
        if not fits:
            return [f"{at}: not {' or '.join(names)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not one of the values")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if "minimum" in schema and value < schema["minimum"]:
            out.append(f"{at}: below the minimum")
        if "maximum" in schema and value > schema["maximum"]:
            out.append(f"{at}: above the maximum")
    if isinstance(value, dict):
        fields = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in fields:
                out += violations(value[k], fields[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        out += [e for i, v in enumerate(value) for e in violations(v, schema["items"], f"{at}[{i}]")]
    return out


def references(value: object) -> set[str]:
    """Identifiers of the calls whose results the value names."""
    if isinstance(value, dict):
        if set(value) == {"$ref"} and isinstance(value["$ref"], str):
            return {value["$ref"]}
        return set().union(*(references(v) for v in value.values())) if value else set()
    if isinstance(value, list):
        return set().union(*(references(v) for v in value)) if value else set()
    return set()


def _object(text: str) -> dict | None:
    if not text.lstrip().startswith("{"):
        return None
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def read_message(role: str | None, text: str | None, schemas: dict[str, dict]) -> tuple[str, str, str | None, list[dict]]:
    """Canonical JSON of a message, the call it answers, and its calls with what is wrong with them.

    The JSON comes in two parts; those of the calls, in the order that is found later, belong between them.
    """
    role, text = role or "user", text or ""
    body = _object(text) if role in ("assistant", "tool") else None
    calls: list[dict] = []
    if body is not None and role == "assistant" and isinstance(body.get("tool_calls"), list):
        for k, call in enumerate(body["tool_calls"]):
            given, call = call, call if isinstance(call, dict) else {}
            arguments = call.get("arguments")
            if isinstance(arguments, str):
                arguments = _object(arguments)
            name = call.get("name")
            wrong = [] if isinstance(call.get("id"), str) else ["$.id: missing"]
            if not isinstance(name, str) or name not in schemas:
                wrong.append("$.name: no such tool")
            elif not isinstance(arguments, dict):
                wrong.append("$.arguments: not object")
            else:
                wrong += violations(arguments, schemas[name])
            calls.append({"place": k, "json": canonical(given), "call": call.get("id") if isinstance(call.get("id"), str) else None, "wrong": "; ".join(wrong) or None, "needs": sorted(references(arguments))})
        whole = canonical({"role": role, **body, "tool_calls": []})
        before = len(canonical({k: v for k, v in {"role": role, **body, "tool_calls": []}.items() if k <= "tool_calls"})) - 2
        return whole[:before], whole[before:], None, calls
    if body is not None and role == "tool" and isinstance(body.get("tool_call_id"), str):
        return canonical({"role": role, **body}), "", body["tool_call_id"], calls
    return canonical({"role": role, "content": text}), "", None, calls


def _messages(turns: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    ship(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("place", pa.int32()), ("json", pa.string()), ("call", pa.string()), ("wrong", pa.string()), ("needs", pa.list_(pa.string()))]))
        for batch in batches:
            read = [read_message(r, t, schemas) for r, t in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array([m[k] for m in read], pa.string()) for k in range(3)), pa.array([m[3] for m in read], kind)], names=["row", "conv_id", "turn", "role", "json", "tail", "answers", "calls"])

    conv, turn = (turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    rows = turns.select(F.monotonically_increasing_id().alias("row"), "conv_id", "turn", "role", "text")
    return settle(rows.mapInArrow(run, f"row long, conv_id {conv}, turn {turn}, role string, json string, tail string, answers string, calls array<struct<place:int,json:string,call:string,wrong:string,needs:array<string>>>"), "messages")


def call_depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call, depth) of the calls that can be ordered: those whose needs, all the way down, exist and form no circle."""
    needs = calls.select("conv_id", "call", F.explode("needs").alias("need")).distinct()
    if needs.isEmpty():
        return calls.select("conv_id", "call", F.lit(0).alias("depth")).distinct()
    waits = settle(needs.groupBy("conv_id", "call").agg(F.count(F.lit(1)).alias("open")), "waits")
    free = calls.select("conv_id", "call").distinct().join(waits, ["conv_id", "call"], "left_anti")
    placed = settle(free.withColumn("depth", F.lit(0)), "depths")
    while True:  # one round for each step of the longest chain
        met = needs.join(placed.select("conv_id", F.col("call").alias("need"), F.col("depth").alias("below")), ["conv_id", "need"])
        ready = met.groupBy("conv_id", "call").agg(F.count(F.lit(1)).alias("have"), (F.max("below") + 1).alias("depth")).join(waits, ["conv_id", "call"]).filter("have = open")
        after = settle(placed.unionByName(ready.select("conv_id", "call", "depth").join(placed, ["conv_id", "call"], "left_anti")), "depths")
        grown = after.count() > placed.count()
        drop(placed)
        placed = after
        if not grown:
            return placed


def format_chats(turns: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """For each message: conv_id, turn, role, its place (at_turn, is_answer, at_depth, at_place, then turn), n_calls, n_answered, link (linked, orphan or null), valid and its canonical JSON."""
    messages = _messages(turns, schemas)
    calls = messages.select("row", "conv_id", "turn", F.explode("calls").alias("c")).select("row", "conv_id", "turn", "c.*")
    named = calls.filter("call IS NOT NULL AND conv_id IS NOT NULL")
    first = named.groupBy("conv_id", "call").agg(F.min(F.struct(F.col("turn"), F.col("place"), F.col("row"))).alias("at"), F.count(F.lit(1)).alias("twins"))
    answers = messages.filter("answers IS NOT NULL").select("row", "conv_id", F.col("answers").alias("call"))
    answered = answers.groupBy("conv_id", "call").agg(F.count(F.lit(1)).alias("results"))
    depths = call_depths(named.select("conv_id", "call", "needs"))
    known = first.join(depths, ["conv_id", "call"], "left").join(answered, ["conv_id", "call"], "left")
    judged = calls.join(known, ["conv_id", "call"], "left")
    per_row = judged.groupBy("row").agg(
        F.count(F.lit(1)).alias("n_calls"), F.sum(F.when(F.col("results") > 0, 1).otherwise(0)).alias("n_answered"),
        F.max(F.when(F.col("wrong").isNotNull() | F.col("depth").isNull() | (F.col("twins") > 1), 1).otherwise(0)).alias("bad"),
        F.concat_ws("; ", F.array_sort(F.collect_set("wrong"))).alias("problems"),
        F.array_sort(F.collect_list(F.struct(F.coalesce("depth", F.lit(2**31 - 1)).alias("depth"), "place", "json"))).alias("ordered"),  # of one message, no more than it held
    )
    linked = answers.join(known.select("conv_id", "call", "at", "depth"), ["conv_id", "call"], "left").select("row", F.col("at").alias("home"), F.col("depth").alias("home_depth"))
    whole = messages.join(per_row, "row", "left").join(linked, "row", "left")
    # Order: the turn, or a result's call's turn; the message before results; deeper calls' results later; then the call's place and the own turn.
    turn = F.coalesce(F.col("home.turn"), F.col("turn"))
    key = F.struct(turn.alias("turn"), F.when(F.col("home").isNotNull(), 1).otherwise(0).alias("answer"), F.coalesce("home_depth", F.lit(0)).alias("depth"), F.coalesce("home.place", F.lit(0)).alias("place"), F.col("turn").alias("own_turn"))
    is_answer = F.col("answers").isNotNull()
    link = F.when(is_answer & F.col("home").isNotNull(), "linked").when(is_answer, "orphan")
    return whole.select(
        "conv_id", "turn", "role", key["turn"].alias("at_turn"), key["answer"].alias("is_answer"), key["depth"].alias("at_depth"), key["place"].alias("at_place"), F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"), F.coalesce("n_answered", F.lit(0)).cast("long").alias("n_answered"),
        link.alias("link"), ((F.coalesce("bad", F.lit(0)) == 0) & (F.coalesce(link, F.lit("")) != "orphan")).alias("valid"), F.coalesce("problems", F.lit("")).alias("problems"),
        F.concat("json", F.coalesce(F.concat_ws(",", F.col("ordered.json")), F.lit("")), "tail").alias("message_json"),
    )
