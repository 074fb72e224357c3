"""Operator 4: chat formatting by linking tool calls with their results.

Calls and results are hash-joined by conversation and call id. Calls may depend on several others and are ordered
topologically: the level of a call is the length of its longest chain of parents, found by
pointer doubling along calls with one parent and by Kahn's rounds between those with several, all over joins,
so neither a long conversation nor a long chain meets in one task. Arguments are validated against the schema of the named tool, and each
message is written as canonical JSON: sorted keys, no blanks, UTF-8 as it is.

Every call and result has a row. Rows of a conversation are in order when sorted by (level, call_id, kind, turn): a call
stands after the calls it depends on, and its results stand after it. Plain messages
(kind 2: every turn that is neither a call nor a result, of any role) take no part in
linking: they have no call id and no level, and stand at their turn.

Defined cases: a result without a call has level null and the problem "no call"; a call
without a result stays; calls on a cycle have level null and the problem "cycle"; a
parent id that names no call counts as none; of calls with one id in a conversation
the one with the smallest turn and arguments is linked, the others have level null, no
answers and the problem "repeated id"; a call without an id has level null and the problem
"no id"; rows without a conversation are one conversation; repeated results stay; null arguments
are the problem "no JSON object"; an unknown tool is the problem "unknown tool"; a plain message
without a role is the problem "no role". Empty tables give no rows of their kind; repeated dependencies count once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracause.llm.components import join_spread
from terracause.llm.shared import cut

#: {tool: {field: (type, required)}}
Schemas = dict[str, dict[str, tuple[str, bool]]]

_KINDS = {"string": str, "object": dict, "array": list, "boolean": bool}


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _is(value: object, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool)
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, _KINDS[kind])


def problems(tool: str | None, arguments: str | None, schemas: Schemas) -> tuple[list[str], object]:
    """What is wrong with a call, in order of field, and its arguments as read."""
    try:
        read = json.loads(arguments) if arguments is not None else None
    except ValueError:
        read = None
    if not isinstance(read, dict):
        return ["no JSON object"], arguments
    if tool not in schemas:
        return ["unknown tool"], read
    fields, found = schemas[tool], []
    for name in sorted({*fields, *read}):
        if name not in fields:
            found.append(f"{name}: not in the schema")
        elif name not in read:
            if fields[name][1]:
                found.append(f"{name}: missing")
        elif not _is(read[name], fields[name][0]):
            found.append(f"{name}: not {fields[name][0]}")
    return found, read


def levels(calls: DataFrame, depends: DataFrame) -> DataFrame:
    """call_id and level of each call: the longest chain of calls that it depends on (0 without any; null on or behind a cycle).

    ``calls`` has call_id, unique; ``depends`` call_id and parent_id, and only parents that are calls count. A call
    with one parent follows it by pointer doubling up to the first call with none or with several; of
    these each waits for all of its parents (Kahn), so rounds grow with the nesting of such calls, not with
    the length of chains. A parent of very many calls is joined by broadcast.
    """
    ids = cut(calls.select("call_id"), "op4-ids")
    known = cut(depends.select("call_id", "parent_id").distinct().join(ids.select(F.col("call_id").alias("parent_id")), "parent_id", "left_semi"), "op4-depends")
    per = known.groupBy("call_id").agg(F.count("*").alias("k"), F.min("parent_id").alias("up"))
    k = F.coalesce("k", F.lit(0))
    every = cut(ids.join(per, "call_id", "left").select("call_id", k.alias("k"), F.when(k == 1, F.col("up")).otherwise(F.col("call_id")).alias("at"), (k == 1).cast("long").alias("far"), (k == 1).alias("open")), "op4")
    step, most = every.drop("k"), ids.count()
    left = step.where("open").count()
    while left:
        above = step.select(F.col("call_id").alias("at"), F.col("at").alias("_at"), F.col("far").alias("_far"), F.col("open").alias("_open"))
        # who has arrived stays there
        going = join_spread(step.where("open"), above, "at").select("call_id", F.col("_at").alias("at"), (F.col("far") + F.col("_far")).alias("far"), F.col("_open").alias("open"))
        step = cut(step.where("not open").unionByName(going), "op4")
        now = step.where("open")
        left, before = now.count(), left
        if left == before and now.agg(F.min("far")).first()[0] > most:
            break  # chains longer than there are calls: what is left is on a cycle or behind one
    done = every.where("k = 0").select(F.col("call_id").alias("at"), F.lit(0).cast("long").alias("level"))
    several = every.where("k > 1").select("call_id")
    if not several.isEmpty():
        ends = known.join(several, "call_id", "left_semi").withColumnRenamed("call_id", "waits")
        places = step.select(F.col("call_id").alias("parent_id"), F.when(~F.col("open"), F.col("at")).alias("at"), (F.col("far") + 1).alias("more"))
        waiting = cut(join_spread(ends, places, "parent_id").select("waits", "at", "more"), "op4-waiting")
        done = cut(done, "op4-done")
        while True:
            ready = join_spread(waiting, done, "at").groupBy("waits").agg(F.max(F.col("level") + F.col("more")).alias("level"), (F.count("level") == F.count("*")).alias("_all")).where("_all")
            ready = cut(ready.select(F.col("waits").alias("at"), "level"), "op4-ready")
            if ready.isEmpty():
                break
            waiting = cut(waiting.join(ready.select(F.col("at").alias("waits")), "waits", "left_anti"), "op4-waiting")
            done = cut(done.unionByName(ready), "op4-done")
    return join_spread(step, cut(done, "op4-levels"), "at").select("call_id", F.when(~F.col("open"), F.col("level") + F.col("far")).alias("level"))


def _order() -> list[Column]:
    """Of calls with one id the smallest in these is linked."""
    return [F.col("conv_id"), F.col("turn"), F.coalesce("arguments", F.lit("")).alias("_"), *map(F.col, ("arguments", "up", "tool", "call_id"))]


def _linked(calls: DataFrame, results: DataFrame, depends: DataFrame) -> DataFrame:
    """Messages of the calls that are linked, one an ``id``, and of all results; calls have ``up``, the id of their parent, and ``depends`` more of these (id, up)."""
    first = calls.where("id is not null").groupBy("id").agg(F.min(F.struct(*_order())).alias("c"))
    one = cut(first.select("id", "c.conv_id", "c.turn", "c.up", "c.tool", "c.arguments", "c.call_id"), "op4-calls")
    order = cut(levels(one.select(F.col("id").alias("call_id")), one.select("id", "up").unionByName(depends).where("up is not null").toDF("call_id", "parent_id")).withColumnRenamed("call_id", "id"), "op4-order")
    answers = results.groupBy("id").agg(F.count("*").alias("answers"))
    asked = one.join(order, "id").join(answers, "id", "left").select(
        "conv_id", "turn", F.lit(0).alias("kind"), "call_id", "level", F.coalesce("answers", F.lit(0)).cast("long").alias("answers"), "tool", F.col("arguments").alias("body"), F.when(F.col("level").isNull(), "cycle").alias("note")
    )
    said = results.join(order.withColumn("_call", F.lit(True)), "id", "left").select(
        "conv_id",
        "turn",
        F.lit(1).alias("kind"),
        "call_id",
        "level",
        F.when(F.col("_call"), 1).otherwise(0).cast("long").alias("answers"),
        F.lit(None).cast("string").alias("tool"),
        F.col("content").alias("body"),
        F.when(F.col("_call").isNull(), "no call").alias("note"),
    )
    return asked.unionByName(said)


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row a linked call and a result, where ids are unique over all conversations; ``chat`` has every call.

    conv_id, turn, kind (0 call, 1 result), call_id, level, answers, valid, problems, json.
    Of calls with one id the one with the smallest conversation, turn and arguments stays; calls without an id go.
    """
    named = calls.withColumns({"id": F.col("call_id"), "up": F.col("parent_id")})
    return _messages(_linked(named, results.withColumn("id", F.col("call_id")), named.select("id", "up").where("false")), schemas)


def chat(calls: DataFrame, results: DataFrame, plain: DataFrame, schemas: Schemas, depends: DataFrame | None = None) -> DataFrame:
    """One row a message: conv_id, turn, kind (0 call, 1 result, 2 plain), call_id, level, answers, valid, problems, json.

    ``calls`` has conv_id, turn, call_id, parent_id, tool, arguments (JSON text); ``results``
    has conv_id, turn, call_id, content; ``plain`` has conv_id, turn, role, content; ``depends``
    has conv_id, call_id, depends_on: parents beside the one in the call. Other
    columns are not read. Ids need to be unique within a conversation only.
    """
    inside = lambda name: F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.col(name))
    none = lambda kind: F.lit(None).cast(kind)
    read = calls.select("conv_id", "turn", "call_id", "parent_id", "tool", "arguments")
    # each call has a number of its own, written once
    calls = cut(read.withColumns({"id": inside("call_id"), "up": inside("parent_id"), "nr": F.monotonically_increasing_id()}), "op4-every")
    more_parents = calls.select("id", "up").where("false") if depends is None else depends.select(inside("call_id").alias("id"), inside("depends_on").alias("up"))
    linked = _linked(calls, results.withColumn("id", inside("call_id")), more_parents)
    taken = calls.where("id is not null").groupBy("id").agg(F.min(F.struct(*_order(), "nr")).alias("c")).select("c.nr")
    left = calls.join(taken, "nr", "left_anti")
    more = left.select("conv_id", "turn", F.lit(0).alias("kind"), "call_id", none("long").alias("level"), F.lit(0).cast("long").alias("answers"), "tool", F.col("arguments").alias("body"), F.when(F.col("id").isNull(), "no id").otherwise("repeated id").alias("note"))
    others = plain.select("conv_id", "turn", F.lit(2).alias("kind"), none("string").alias("call_id"), none("long").alias("level"), F.lit(0).cast("long").alias("answers"), F.col("role").alias("tool"), F.col("content").alias("body"), F.when(F.col("role").isNull(), "no role").alias("note"))
    return _messages(linked.unionByName(more).unionByName(others), schemas)


def _messages(rows: DataFrame, schemas: Schemas) -> DataFrame:
    """Each row as canonical JSON, with what is wrong with it."""
    out = "conv_id long, turn long, kind int, call_id string, level long, answers long, valid boolean, problems string, json string"
    names = [x.split()[0] for x in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, turn, kind, call_id, level, n, tool, body, note in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    found, read = problems(tool, body, schemas)
                    text = canonical({"arguments": read, "call_id": call_id, "name": tool, "role": "assistant"})
                elif kind == 2:
                    found = []
                    text = canonical({"content": body, "role": tool})
                else:
                    found = []
                    text = canonical({"call_id": call_id, "content": body, "role": "tool"})
                found += [note] if note else []
                rows.append((conv, turn, kind, call_id, level, n, not found, "; ".join(found), text))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names)

    typed = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("kind").cast("int"), "call_id", "level", "answers", "tool", "body", "note")
    return typed.mapInArrow(run, out)
