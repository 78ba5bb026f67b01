"""Chat formatting: tool calls linked to their results, put in order, checked and written as canonical JSON.

Calls and results are two tables. Both are reduced to one row for each conversation and identifier (the first by turn; how
many there were is kept) and hash-joined on these, so repeated identifiers never multiply, and an identifier that two
conversations use is two calls. A call may depend on others of its conversation, named in its arguments as "$ref:<id>". Its
wave is its level in topological order: 0 without dependencies, else one more than the highest wave among them, by the same
rule for every conversation; it is null on a cycle, behind one, and behind a call that is missing. Conversations of up to
LOCAL calls are levelled where they lie after one shuffle; in larger ones, which may hold a great part of all calls, pointers
to what is depended on are doubled round by round over a stored table: a call takes over all pointers of the calls that it
points at, each with the longest way to it, as long as that makes no more than SPREAD of them. Where n calls stand in rows
of up to the root of SPREAD that need each other in any way, as in chains and ladders, this takes about log2(n) rounds; where more
than that are needed at once, a round goes on by a level at least.

Arguments are validated against a JSON schema of their tool (type, required, properties, additionalProperties, enum, minimum,
maximum, minLength, maxLength, items). Canonical JSON has sorted keys, no spaces and no escapes that are not needed; a lone
surrogate stays escaped.

Plain conversations, which hold no tool messages, are read as such: a message that is not the assistant's calls
the tool `reply` with its text as argument and is answered by the assistant's message of the next turn.

Edge cases: a null identifier makes a row of its own, `unlinked` and without a wave (of plain messages, those with a null
conversation or turn); null and empty texts are empty arguments; arguments that are no JSON (NaN and infinite numbers are
none), that are nested over DEPTH levels or hold a number out of range fail validation and are kept as a JSON string; results
without a call are returned as `orphan`; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.store import drop, partitions, written

#: Schemas of the tools that plain conversations are read as calling.
REPLY_SCHEMAS = {"reply": {"type": "object", "required": ["role", "text"], "additionalProperties": False, "properties": {"role": {"type": "string", "enum": ["user", "system", "tool"]}, "text": {"type": "string", "minLength": 1}, "after": {"type": "string"}}}}
#: Levels that arguments may be nested; calls of a conversation that are put in order in one task.
DEPTH, LOCAL = 100, 100_000
#: Pointers that a call may take over at once.
SPREAD = 256
KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


_SURROGATE = re.compile("[\ud800-\udfff]")


def plain(text: str) -> str:
    """The text with lone surrogates, which UTF-8 can't hold, escaped as in JSON."""
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    return plain(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def _integer(digits: str) -> int:
    try:
        return int(digits)
    except ValueError:  # more digits than Python reads
        raise OverflowError from None


def _float(digits: str) -> float:
    if not math.isfinite(value := float(digits)):
        raise OverflowError
    return value


def _constant(name: str):
    raise ValueError(name)


def parsed(text: str | None) -> tuple[object, list[str]]:
    """The value of a JSON text, or the text itself and why it can't be one."""
    try:
        value = json.loads(text, parse_int=_integer, parse_float=_float, parse_constant=_constant)
    except OverflowError:
        return text, ["$: number out of range"]
    except RecursionError:
        return text, [f"$: nested over {DEPTH} levels"]
    except (TypeError, ValueError):
        return text, ["$: not JSON"]
    level, depth = [value], 0
    while level := [x for v in level if isinstance(v, (dict, list)) for x in (v.values() if isinstance(v, dict) else v)]:
        if (depth := depth + 1) > DEPTH:
            return text, [f"$: nested over {DEPTH} levels"]
    return value, []


def errors(value, schema: dict, at: str = "$") -> list[str]:
    """What is wrong with a value, by path."""
    kind = schema.get("type")
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    right = {"number": number, "integer": number and (isinstance(value, int) or value.is_integer())}.get(kind) if kind in ("number", "integer") else isinstance(value, KINDS[kind]) if kind in KINDS else True
    if not right:
        return [f"{at}: not {kind}"]
    out = []
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        out.append(f"{at}: not in enum")
    if number:
        out += [f"{at}: under minimum"] if "minimum" in schema and value < schema["minimum"] else []
        out += [f"{at}: over maximum"] if "maximum" in schema and value > schema["maximum"] else []
    if isinstance(value, str):
        out += [f"{at}: too short"] if len(value) < schema.get("minLength", 0) else []
        out += [f"{at}: too long"] if "maxLength" in schema and len(value) > schema["maxLength"] else []
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        for k in sorted(value):
            if k in known:
                out += errors(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += errors(x, schema["items"], f"{at}[{i}]")
    return out


def references(value) -> set[str]:
    """Identifiers that arguments refer to."""
    if isinstance(value, str):
        return {value[5:]} if value.startswith("$ref:") else set()
    if isinstance(value, dict):
        return set().union(*map(references, value.values()))
    return set().union(*map(references, value)) if isinstance(value, list) else set()


def _kind(rows: DataFrame) -> tuple[str, pa.DataType]:
    """The type of conversation ids: texts stay texts."""
    return ("string", pa.string()) if isinstance(rows.schema["conv_id"].dataType, T.StringType) else ("long", pa.int64())


def from_conversations(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls (conv_id, turn, call_id, tool, arguments) and results (conv_id, turn, call_id, content) of plain turns.

    Everything follows from the row itself: a message answers the turn before it and comes after the call two before.
    """
    own = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    conv = F.col("conv_id").cast(_kind(messages)[0])
    m = messages.select(conv.alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.lower("role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    named = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    asked = m.where(F.coalesce(F.col("role"), F.lit("")) != "assistant")
    after = F.when(F.col("turn") >= 2, F.concat(F.lit("$ref:"), F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - 2).cast("string"))))
    calls = asked.select("conv_id", "turn", F.when(named, own).alias("call_id"), F.lit("reply").alias("tool"), F.to_json(F.struct("role", "text", after.alias("after"))).alias("arguments"))
    said = m.where(F.col("role") == "assistant")
    results = said.select("conv_id", "turn", F.when(named, F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string"))).alias("call_id"), F.col("text").alias("content"))
    return calls, results


ROW = "call_id string, conv_id {kind}, turn long, status string, n_calls long, n_results long, valid boolean, problems array<string>, deps array<string>, json string"
_ARROW = pa.schema([("call_id", pa.string()), ("conv_id", pa.int64()), ("turn", pa.int64()), ("status", pa.string()), ("n_calls", pa.int64()), ("n_results", pa.int64()), ("valid", pa.bool_()), ("problems", pa.list_(pa.string())), ("deps", pa.list_(pa.string())), ("json", pa.string())])


def _checked(x: dict, schemas: dict) -> dict:
    """One call with its result: what it is, what is wrong with it, what it depends on, and its canonical form."""
    has_call = x["n_calls"] > 0
    value, problems, deps = None, [], set()
    if has_call:
        value, problems = parsed(x["arguments"])
        if not problems:
            schema = schemas.get(x["tool"])
            problems = errors(value, schema) if schema is not None else [f"unknown tool {x['tool']}"]
            deps = references(value)
    if x["call_id"] is None:
        status = "unlinked"
    elif not has_call:
        status = "orphan"
    elif not x["n_results"]:
        status = "open"
    else:
        status = "early" if x["turn"] is not None and x["result_turn"] is not None and x["result_turn"] < x["turn"] else "linked"
    call = {"id": x["call_id"], "tool": x["tool"], "arguments": value} if has_call else None
    result = {"id": x["call_id"], "content": x["content"]} if x["n_results"] else None
    return {"call_id": x["call_id"], "conv_id": x["conv_id"], "turn": x["turn"] if has_call else x["result_turn"], "status": status, "n_calls": x["n_calls"], "n_results": x["n_results"], "valid": has_call and not problems, "problems": list(map(plain, problems)), "deps": sorted(map(plain, deps)), "json": canonical({"call": call, "result": result})}


def linked(calls: DataFrame, results: DataFrame, schemas: dict = REPLY_SCHEMAS, local: int = LOCAL) -> DataFrame:
    """One row a call or orphan result: conv_id, call_id, turn, wave, status, n_calls, n_results, valid, problems, json."""
    key = ["conv_id", "call_id"]
    one = calls.where("call_id is not null").groupBy(*key).agg(F.min(F.struct("turn", "tool", "arguments")).alias("c"), F.count("*").alias("n_calls"))
    answer = results.where("call_id is not null").groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results"))
    other = answer.toDF("conv_r", "call_r", "r", "n_results")
    both = F.col("conv_id").eqNullSafe(F.col("conv_r")) & (F.col("call_id") == F.col("call_r"))
    pairs = one.join(other, both, "full_outer").select(F.coalesce("conv_id", "conv_r").alias("conv_id"), F.coalesce("call_id", "call_r").alias("call_id"), "c", "n_calls", "r", "n_results")
    no_call, no_result = F.lit(None).cast(one.schema["c"].dataType).alias("c"), F.lit(None).cast(answer.schema["r"].dataType).alias("r")
    zero, single = F.lit(0).cast("long"), F.lit(1).cast("long")
    lone = calls.where("call_id is null").select(*key, F.struct("turn", "tool", "arguments").alias("c"), single.alias("n_calls"), no_result, zero.alias("n_results"))
    stray = results.where("call_id is null").select(*key, no_call, zero.alias("n_calls"), F.struct("turn", "content").alias("r"), single.alias("n_results"))
    flat = pairs.unionByName(lone).unionByName(stray).select(*key, F.col("c.turn").alias("turn"), F.col("c.tool").alias("tool"), F.col("c.arguments").alias("arguments"), F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"), F.coalesce("n_calls", zero).alias("n_calls"), F.coalesce("n_results", zero).alias("n_results"))

    kind, arrow = _kind(calls)
    shape = _ARROW.set(1, pa.field("conv_id", arrow))

    def check(batches):
        for b in batches:
            yield pa.RecordBatch.from_pylist([_checked(x, schemas) for x in b.to_pylist()], schema=shape)

    return ordered(written(flat.mapInArrow(check, ROW.format(kind=kind)), "calls"), local)


def waves(deps: dict[str, list[str]]) -> dict[str, int | None]:
    """The level of each call of one conversation."""
    out: dict[str, int | None] = {}
    users: dict[str, list[str]] = {}
    wait = {}
    for call, own in deps.items():
        wait[call] = len(own)
        for d in own:
            users.setdefault(d, []).append(call)
    now = [call for call, n in wait.items() if not n]
    level = 0
    while now:
        ahead = []
        for call in now:
            out[call] = level
            for user in users.get(call, ()):
                wait[user] -= 1
                if not wait[user]:
                    ahead.append(user)
        now, level = ahead, level + 1
    return {call: out.get(call) for call in deps}


def _near_waves(nodes: DataFrame) -> DataFrame:
    """conv_id, call_id, wave of whole conversations in a task."""

    kind, arrow = _kind(nodes)

    def run(batches):
        now, deps = object(), {}

        def done():
            got = waves(deps)
            return pa.RecordBatch.from_arrays([pa.array([now] * len(got), arrow), pa.array(list(got), pa.string()), pa.array(list(got.values()), pa.int64())], names=["conv_id", "call_id", "wave"])

        for b in batches:  # rows come sorted by conversation
            for conv, call, own in zip(*[b.column(c).to_pylist() for c in ("conv_id", "call_id", "deps")]):
                if conv != now:
                    if deps:
                        yield done()
                    now, deps = conv, {}
                deps[call] = own
        if deps:
            yield done()

    dealt = nodes.repartition(partitions(nodes.sparkSession), "conv_id").sortWithinPartitions("conv_id")
    return dealt.mapInArrow(run, f"conv_id {kind}, call_id string, wave long")


def _far_waves(nodes: DataFrame) -> DataFrame:
    """The same by pointer doubling. A call points at what it depends on, each pointer with the most steps that it spans. In a
    round a pointer at a settled call is settled too, and one at another call is replaced by that call's own pointers, whose
    settled part counts as well. A round always settles calls that need settled ones only; once log2(n) + 2 rounds settle
    nothing, what is left lies on or behind a cycle."""
    far = F.lit(1 << 60)  # steps around a cycle grow without end
    state = written(nodes.select("conv_id", "call_id", F.transform("deps", lambda d: F.struct(d.alias("p"), F.lit(1).cast("long").alias("k"))).alias("ptrs"), (F.size("deps") == 0).alias("done"), F.when(F.size("deps") == 0, F.lit(0)).cast("long").alias("wave")), "waves")
    idle, settled, most = 0, -1, state.count().bit_length() + 2
    while idle < most:
        target = state.select(F.col("conv_id").alias("tc"), F.col("call_id").alias("tp"), F.col("done").alias("td"), F.col("wave").alias("tw"), F.col("ptrs").alias("to"))
        asked = state.where("not done").select("conv_id", "call_id", "wave", F.explode("ptrs").alias("x")).select("conv_id", "call_id", "wave", "x.p", "x.k")
        met = asked.join(target, asked["conv_id"].eqNullSafe(F.col("tc")) & (F.col("p") == F.col("tp")), "left")
        over = F.coalesce("td", F.lit(True))  # a missing call is settled, without a wave
        per = met.groupBy("conv_id", "call_id").agg(F.collect_list(F.when(~over, F.struct("p", "k", "to", "tw"))).alias("open"), F.max(over & F.col("tw").isNull()).alias("lost"), F.greatest(F.max("wave"), F.max(F.when(over, F.col("tw") + F.col("k")))).alias("wave"))
        fits = F.aggregate("open", F.lit(0), lambda n, x: n + F.size(x["to"])) <= SPREAD
        per = per.withColumn("open", F.transform("open", lambda x: F.struct(x["p"].alias("p"), x["k"].alias("k"), (fits | (F.size(x["to"]) == 1)).alias("on"), x["to"].alias("to"), x["tw"].alias("tw"))))
        behind = F.array_max(F.transform("open", lambda x: F.when(x["on"], x["tw"] + x["k"])))
        onward = F.flatten(F.transform("open", lambda x: F.when(x["on"], F.transform(x["to"], lambda y: F.struct(y["p"].alias("p"), F.least(x["k"] + y["k"], far).alias("k")))).otherwise(F.array(F.struct(x["p"].alias("p"), x["k"].alias("k"))))))
        # of several ways to one call the longest
        each = per.select("conv_id", "call_id", "lost", F.greatest("wave", behind).alias("wave"), F.explode_outer(onward).alias("x")).groupBy("conv_id", "call_id", "lost", "wave", "x.p").agg(F.max("x.k").alias("k"))
        seen = each.groupBy("conv_id", "call_id", "lost", "wave").agg(F.collect_list(F.when(F.col("p").isNotNull(), F.struct("p", "k"))).alias("ptrs"))
        done = F.col("lost") | (F.size("ptrs") == 0)
        new = written(state.where("done").unionByName(seen.select("conv_id", "call_id", F.when(done, F.array().cast(state.schema["ptrs"].dataType)).otherwise(F.col("ptrs")).alias("ptrs"), done.alias("done"), F.when(~F.col("lost"), F.col("wave")).alias("wave"))), "waves")
        drop(state)
        state = new
        now = state.where("done").count()
        idle, settled = (0 if now > settled else idle + 1), now
        if state.where("not done").isEmpty():
            break
    return state.select("conv_id", "call_id", F.when(F.col("done"), F.col("wave")).alias("wave"))


def ordered(checked: DataFrame, local: int = LOCAL) -> DataFrame:
    """Adds wave, the level of each call that has an identifier."""
    nodes = checked.where("call_id is not null and n_calls > 0").select("conv_id", "call_id", "deps")
    large = written(nodes.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > local), "large")
    if large.isEmpty():
        found = _near_waves(nodes)
    else:  # so few conversations of so many calls that their ids can be sent to all tasks
        met = nodes["conv_id"].eqNullSafe(large["conv_id"])
        found = _near_waves(nodes.join(F.broadcast(large), met, "left_anti")).unionByName(_far_waves(nodes.join(F.broadcast(large), met, "left_semi")))
    found = found.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_i"), "wave")
    return checked.join(found, checked["conv_id"].eqNullSafe(F.col("_c")) & (checked["call_id"] == F.col("_i")) & (F.col("n_calls") > 0), "left").drop("deps", "_c", "_i")


def op7_toolcalls(conversations: DataFrame) -> DataFrame:
    return linked(*from_conversations(conversations))
