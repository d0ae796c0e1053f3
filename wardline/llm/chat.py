"""Chat formatting with linked tool calls.

Input messages have (conv_id, turn, role, text, tool_calls, call_id):
``tool_calls`` is a JSON list of ``{"id", "name", "arguments"}`` on a message
that calls tools, ``call_id`` names the call that a message with role "tool"
answers.  Calls and results are joined by (conv_id, id), ordered so that a call
follows the calls its arguments refer to (``{"$call": id}``) and a result
follows its call, arguments are checked against the tool's schema, and every
message becomes one line of canonical JSON (sorted keys, no spaces).

Nothing gathers a conversation: positions are columns to sort by, not ranks, so
one conversation may hold any share of the rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import materialize

TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict,
         "null": type(None)}


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def faults(value, schema: dict, at: str = "") -> list[str]:
    """What ``value`` breaks of type, enum, minimum, maximum, required,
    properties, additionalProperties and items.  A ``{"$call": id}`` stands for
    a value that is known later and breaks nothing."""
    if isinstance(value, dict) and set(value) == {"$call"}:
        return []
    kind = schema.get("type")
    if kind and (not isinstance(value, TYPES[kind]) or (isinstance(value, bool) and kind in ("integer", "number"))):
        return [f"{at or '.'}: not {kind}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at or '.'}: not in enum")
    if "minimum" in schema and value < schema["minimum"]:
        out.append(f"{at or '.'}: below minimum")
    if "maximum" in schema and value > schema["maximum"]:
        out.append(f"{at or '.'}: above maximum")
    if isinstance(value, dict):
        props = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        for k in sorted(value):
            if k in props:
                out += faults(value[k], props[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += faults(x, schema["items"], f"{at}[{i}]")
    return out


def _refs(value) -> list[str]:
    if isinstance(value, dict):
        if set(value) == {"$call"}:
            return [str(value["$call"])]
        return [r for v in value.values() for r in _refs(v)]
    return [r for v in value for r in _refs(v)] if isinstance(value, list) else []


def calls(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call: (conv_id, turn, item, id, name, arguments, refs, fault).

    A malformed list gives one row with a null id and a fault.  An id that a
    conversation repeats belongs to its first call; later ones get the fault
    "repeated id"."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for conv, turn, raw in zip(b["conv_id"], b["turn"], b["tool_calls"]):
                try:
                    got = json.loads(raw)
                    if not isinstance(got, list):
                        raise ValueError
                except ValueError:
                    rows.append((conv, turn, 0, None, None, None, [], "malformed calls"))
                    continue
                for k, c in enumerate(got):
                    c = c if isinstance(c, dict) else {}
                    name, args = c.get("name"), c.get("arguments")
                    if isinstance(args, str):
                        try:
                            args = json.loads(args)
                        except ValueError:
                            pass
                    if name not in schemas:
                        fault = "unknown tool"
                    else:
                        fault = "; ".join(faults(args, schemas[name])) or None
                    i = c.get("id")
                    rows.append((conv, turn, k, None if i is None else str(i), None if name is None else str(name),
                                 canonical(args), sorted(set(_refs(args))), fault if i is not None else "no id"))
            out = pd.DataFrame(rows, columns=["conv_id", "turn", "item", "id", "name", "arguments", "refs", "fault"])
            yield out.astype({"id": object, "name": object, "arguments": object, "fault": object})

    made = (messages.where(F.col("tool_calls").isNotNull())
            .select(F.col("conv_id").cast("string").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), "tool_calls")
            .mapInPandas(run, "conv_id string, turn long, item int, id string, name string, arguments string, "
                              "refs array<string>, fault string"))
    return materialize(made.select(F.col("conv_id").cast("long").alias("conv_id"), F.nullif("turn", F.lit(-1)).alias("turn"),
                                   "item", "id", "name", "arguments", "refs", "fault"), "calls")


def _first(df: DataFrame) -> DataFrame:
    """Place of the first row of each (conv_id, id); combines before the shuffle."""
    return (df.where(F.col("id").isNotNull()).groupBy(F.col("conv_id").alias("c"), F.col("id").alias("i"))
            .agg(F.min(F.struct("turn", "item")).alias("place")))


def order_calls(made: DataFrame) -> DataFrame:
    """``made`` with (after_turn, depth) and the order's own faults.

    A call keeps its own turn unless it refers to a call that comes no earlier;
    then it moves to that call's turn, one step deeper.  Only calls that late
    references reach can move; they are placed in topological order, a round
    for each step of the longest chain among them.  When a round places none,
    the rest are on a cycle or behind one: they keep their turn and get the
    fault "cycle".  An unknown reference is the fault "unknown call"."""
    same = lambda c, i: F.col("conv_id").eqNullSafe(F.col(c)) & (F.col("id") == F.col(i))
    refs = made.where((F.size("refs") > 0) & F.col("id").isNotNull()).select("conv_id", "id", F.explode("refs").alias("ref")).distinct()
    known = _first(made)
    targets = known.select(F.col("c").alias("rc"), F.col("i").alias("ri"), F.col("place").alias("ref_place"))
    edges = (refs.join(targets, F.col("conv_id").eqNullSafe(F.col("rc")) & (F.col("ref") == F.col("ri")), "left")
             .join(known, same("c", "i")).select("conv_id", "id", "ref", "ref_place", "place"))
    edges = materialize(edges, "call-edges")
    lost = edges.where("ref_place IS NULL").select(F.col("conv_id").alias("lc"), F.col("id").alias("li")).distinct()
    good = edges.where("ref_place IS NOT NULL")

    # what late references reach, widened until it stays as it is
    moving = materialize(good.where("ref_place >= place").select("conv_id", "id").distinct(), "moving")
    size, before = moving.count(), 0
    while size > before:
        via = moving.select(F.col("conv_id").alias("mc"), F.col("id").alias("mi"))
        next_ = good.join(via, F.col("conv_id").eqNullSafe(F.col("mc")) & (F.col("ref") == F.col("mi")), "left_semi")
        moving = materialize(moving.unionByName(next_.select("conv_id", "id")).distinct(), "moving")
        size, before = moving.count(), size
    places = None
    if size:
        inside = moving.select(F.col("conv_id").alias("mc"), F.col("id").alias("mi"))
        work = good.join(inside, same("mc", "mi"), "left_semi")
        # refs outside have their final place
        outer = F.struct(F.col("ref_place.turn").alias("t"), F.lit(0).alias("d"), F.col("ref_place.turn").alias("o"), F.col("ref_place.item").alias("k"))
        target = moving.select(F.col("conv_id").alias("tc"), F.col("id").alias("ti"), F.lit(True).alias("open"))
        work = (work.join(target, F.col("conv_id").eqNullSafe(F.col("tc")) & (F.col("ref") == F.col("ti")), "left")
                .select("conv_id", "id", "ref", "place", F.when(F.col("open").isNull(), outer).alias("at")))
        work = materialize(work, "call-work")
        while True:
            own = F.struct(F.col("place.turn").alias("t"), F.lit(0).alias("d"), F.col("place.turn").alias("o"), F.col("place.item").alias("k"))
            ready = (work.groupBy("conv_id", "id").agg(F.first("place").alias("place"), F.max("at").alias("last"),
                                                       F.count_if(F.col("at").isNull()).alias("open")).where("open = 0"))
            moved = F.struct(F.col("last.t").alias("t"), (F.col("last.d") + 1).alias("d"), F.col("place.turn").alias("o"), F.col("place.item").alias("k"))
            done = materialize(ready.select("conv_id", "id", F.when(F.col("last") < own, own).otherwise(moved).alias("new")), "call-places")
            if not done.limit(1).count():
                break
            places = done if places is None else places.unionByName(done)
            new = done.select(F.col("conv_id").alias("nc"), F.col("id").alias("ni"), "new")
            left = work.join(new.select("nc", "ni"), same("nc", "ni"), "left_anti")
            work = materialize(left.join(new, F.col("conv_id").eqNullSafe(F.col("nc")) & (F.col("ref") == F.col("ni")), "left")
                               .select("conv_id", "id", "ref", "place", F.coalesce("at", "new").alias("at")), "call-work")
        stuck = work.select(F.col("conv_id").alias("yc"), F.col("id").alias("yi")).distinct()

    out = made.join(lost, same("lc", "li"), "left")
    out = out.withColumn("fault", F.coalesce("fault", F.when(F.col("li").isNotNull(), F.lit("unknown call")))).drop("lc", "li")
    out = out.withColumns({"after_turn": F.col("turn"), "depth": F.lit(0)})
    if size:
        out = out.join(stuck, same("yc", "yi"), "left")
        out = out.withColumn("fault", F.coalesce("fault", F.when(F.col("yi").isNotNull(), F.lit("cycle")))).drop("yc", "yi")
    if places is not None:
        new = places.select(F.col("conv_id").alias("nc"), F.col("id").alias("ni"), "new")
        out = (out.join(new, same("nc", "ni"), "left")
               .withColumn("after_turn", F.coalesce("new.t", "turn")).withColumn("depth", F.coalesce("new.d", F.lit(0)))
               .drop("nc", "ni", "new"))
    firsts = known.select(F.col("c").alias("fc"), F.col("i").alias("fi"), F.col("place").alias("fp"))
    out = out.join(firsts, same("fc", "fi"), "left")
    again = F.col("fp").isNotNull() & (F.col("fp") != F.struct("turn", "item"))
    return out.withColumn("fault", F.coalesce("fault", F.when(again, F.lit("repeated id")))).drop("fc", "fi", "fp")


def format_chat(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per plain message, call and result: (conv_id, turn, item, kind,
    id, fault, after_turn, depth, line).

    Sort by (conv_id, after_turn, depth, turn, item, kind) to read a
    conversation.  A call without a result has the fault "no result"; a result
    without a call "no call"; a second result of a call "repeated result".
    Rows whose conv_id is null form one conversation; null text is empty, null
    role is "unknown"; an exactly repeated message appears as often as given."""
    m = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text"), "tool_calls", F.col("call_id").cast("string").alias("call_id"))
    ordered = materialize(order_calls(calls(m, schemas)), "ordered-calls")
    results = m.where(F.col("role") == "tool").select("conv_id", "turn", F.lit(0).alias("item"), F.col("call_id").alias("id"), "text")
    first = _first(results).select(F.col("c").alias("rc"), F.col("i").alias("ri"), F.col("place").alias("rp"))
    anchor = (ordered.where("id IS NOT NULL").groupBy(F.col("conv_id").alias("ac"), F.col("id").alias("ai"))
              .agg(F.min_by(F.struct("after_turn", "depth", "name"), F.struct("turn", "item")).alias("call")))

    done = ordered.join(first, F.col("conv_id").eqNullSafe(F.col("rc")) & (F.col("id") == F.col("ri")), "left")
    call_rows = done.select(
        "conv_id", "turn", "item", F.lit("call").alias("kind"), "id",
        F.coalesce("fault", F.when(F.col("ri").isNull(), F.lit("no result"))).alias("fault"), "after_turn", "depth",
        F.lit("assistant").alias("role"), F.lit(None).cast("string").alias("text"), "name", "arguments")

    linked = (results.join(anchor, F.col("conv_id").eqNullSafe(F.col("ac")) & (F.col("id") == F.col("ai")), "left")
              .join(first, F.col("conv_id").eqNullSafe(F.col("rc")) & (F.col("id") == F.col("ri")), "left"))
    late = F.struct(F.col("call.after_turn").alias("t"), F.col("call.depth").alias("d"))
    own = F.struct(F.col("turn").alias("t"), F.lit(0).alias("d"))
    at = F.when(F.col("call").isNotNull(), F.greatest(late, own)).otherwise(own)
    result_rows = linked.select(
        "conv_id", "turn", "item", F.lit("result").alias("kind"), "id",
        F.when(F.col("call").isNull(), "no call").when(F.col("rp") != F.struct("turn", "item"), "repeated result").alias("fault"),
        at["t"].alias("after_turn"), at["d"].alias("depth"), F.lit("tool").alias("role"), "text",
        F.col("call.name").alias("name"), F.lit(None).cast("string").alias("arguments"))

    plain = m.where((F.col("role") != "tool") & ((F.col("text") != "") | F.col("tool_calls").isNull())).select(
        "conv_id", "turn", F.lit(-1).alias("item"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("id"),
        F.lit(None).cast("string").alias("fault"), F.col("turn").alias("after_turn"), F.lit(0).alias("depth"), "role", "text",
        F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"))

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for kind, i, role, text, name, args in zip(b["kind"], b["id"], b["role"], b["text"], b["name"], b["arguments"]):
                if kind == "call":
                    x = {"role": role, "tool_call": {"id": i, "name": name, "arguments": None if args is None else json.loads(args)}}
                elif kind == "result":
                    x = {"role": role, "call_id": i, "name": name, "content": text}
                else:
                    x = {"role": role, "content": text}
                out.append(canonical(x))
            yield b.assign(line=out).drop(columns=["role", "text", "name", "arguments"])

    every = call_rows.unionByName(result_rows).unionByName(plain)
    numbers = ["conv_id", "turn", "after_turn"]
    out = every.withColumns({c: F.col(c).cast("string") for c in numbers}).mapInPandas(
        lines, "conv_id string, turn string, item int, kind string, id string, fault string, after_turn string, depth int, line string")
    return out.withColumns({c: F.col(c).cast("long") for c in numbers})
