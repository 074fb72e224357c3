"""Every turn of a conversation has a row in the formatted output."""

import json
import random

import duckdb

from terracause.llm import queries, toolcalls
from terracause.llm.queries import TOOLS, calls_and_results, other_turns, table


def test_every_turn_of_the_table_has_a_row(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").collect()
    got = queries.op4_tool_calls(spark, sf_dir).collect()
    assert sorted((r.conv_id, r.turn) for r in got) == sorted((r.conv_id, r.turn) for r in turns)
    other = {(r.conv_id, r.turn): {"content": r.text, "role": r.role} for r in turns if r.role not in ("user", "assistant")}
    assert other and {(r.conv_id, r.turn): json.loads(r.json) for r in got if r.kind == 2} == other
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    want = con.sql(queries.OP4_SQL)
    assert sorted((tuple(r[c] for c in want.columns) for r in got), key=str) == sorted(want.fetchall(), key=str)


def test_other_roles_and_none(spark):
    rows = [(1, 0, "system", "be \"brief\""), (1, 1, "user", "é"), (1, 2, "assistant", "a"), (1, 3, "critic", None), (1, 4, None, "lost")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.turn: r for r in toolcalls.chat(*calls_and_results(turns), other_turns(turns), TOOLS).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    assert [got[i].kind for i in range(5)] == [2, 0, 1, 2, 2]
    assert got[0].json == '{"content":"be \\"brief\\"","role":"system"}' and got[0].valid and got[0].level is None
    assert got[3].json == '{"content":null,"role":"critic"}'
    assert got[4].json == '{"content":"lost","role":null}' and got[4].problems == "no role"


def test_calls_that_repeat_an_id_or_have_none_stay(spark):
    calls = [
        (1, 1, "call_0", None, "search", '{"text":"a"}'),
        (1, 3, "call_1", "call_0", "search", '{"text":"b"}'),
        (2, 1, "call_0", None, "search", '{"text":"c"}'),
        (2, 3, "call_1", "call_0", "search", '{"text":"d"}'),
        (2, 5, "call_1", "call_0", "search", '{"text":"e"}'),
        (2, 5, "call_1", "call_0", "search", '{"text":"e"}'),
        (2, 7, None, "call_1", "search", '{"text":"f"}'),
        (3, 1, None, None, "search", None),
        (3, 2, "only_1", "call_1", "search", '{"text":"g"}'),
        (None, 1, "call_0", None, "search", '{"text":"h"}'),
    ]
    results = [(1, 2, "call_0", "A"), (2, 2, "call_0", "C"), (2, 4, "call_1", "D"), (3, 3, "call_0", "other"), (3, 4, None, "none")]
    plain = [(3, 0, "system", "s")]
    frames = (
        spark.createDataFrame(calls, "conv_id long, turn long, call_id string, parent_id string, tool string, arguments string"),
        spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string"),
        spark.createDataFrame(plain, "conv_id long, turn long, role string, content string"),
    )
    rows = toolcalls.chat(*frames, TOOLS).collect()
    assert len(rows) == len(calls) + len(results) + len(plain)
    said = sorted((r.conv_id or 0, r.turn, r.level, r.answers, r.problems) for r in rows if r.kind == 0 and r.level is not None)
    assert said == [(0, 1, 0, 0, ""), (1, 1, 0, 1, ""), (1, 3, 1, 0, ""), (2, 1, 0, 1, ""), (2, 3, 1, 1, ""), (3, 2, 0, 0, "")]
    rest = sorted((r.conv_id, r.turn, r.call_id or "", r.answers, r.problems) for r in rows if r.kind == 0 and r.level is None)
    assert rest == [(2, 5, "call_1", 0, "repeated id"), (2, 5, "call_1", 0, "repeated id"), (2, 7, "", 0, "no id"), (3, 1, "", 0, "no JSON object; no id")]
    answers = {(r.conv_id, r.turn): (r.level, r.problems) for r in rows if r.kind == 1}
    assert answers == {(1, 2): (0, ""), (2, 2): (0, ""), (2, 4): (1, ""), (3, 3): (None, "no call"), (3, 4): (None, "no call")}


def longest(calls, edges):
    """Level of each call by brute force; None on or behind a cycle."""
    up = {c: {p for a, p in edges if a == c and p in calls} for c in calls}
    level = {}
    while True:
        ready = {c: 1 + max((level[p] for p in up[c]), default=-1) for c in calls if c not in level and all(p in level for p in up[c])}
        if not ready:
            return {c: level.get(c) for c in calls}
        level |= ready


def test_calls_that_depend_on_several(spark):
    """A random graph of calls with none, one and several parents, a long chain into a merge, repeats, strangers and cycles."""
    rng = random.Random(8)
    names = [f"c{i:03d}" for i in range(160)]
    edges = [(names[i], names[rng.randrange(i)]) for i in range(1, 120) for _ in range(rng.choice([0, 1, 1, 2, 4]))]
    edges += [(names[i], names[i - 1]) for i in range(121, 150)] + [(names[150], names[149]), (names[150], names[3]), (names[151], names[150])]
    edges += [(names[152], names[153]), (names[153], names[152]), (names[154], names[152]), (names[155], names[154]), (names[155], names[1]), (names[156], names[156])]
    edges += [(names[157], "gone"), (names[5], "gone"), *edges[:9]]
    hot = [f"h{i:03d}" for i in range(300)]
    edges += [(h, names[2]) for h in hot] + [(h, names[4]) for h in hot[:100]]
    want = longest([*names, *hot], edges)
    table = spark.createDataFrame([(c,) for c in [*names, *hot]], "call_id string")
    got = {r.call_id: r.level for r in toolcalls.levels(table, spark.createDataFrame(edges, "call_id string, parent_id string")).collect()}
    assert got == want and want[names[151]] > 30 and sum(v is None for v in want.values()) == 5


def test_more_parents_within_a_conversation(spark):
    """Parents of the call and of the table together; ids of another conversation don't count."""
    rows = [(k, i, f"t{i}", f"t{i - 1}" if i in (1, 2) else None, "search", '{"text":"a"}') for k in (1, 2) for i in range(5)]
    calls = spark.createDataFrame(rows, "conv_id long, turn long, call_id string, parent_id string, tool string, arguments string")
    depends = spark.createDataFrame([(1, "t4", "t2"), (1, "t4", "t3"), (1, "t4", "t3"), (1, "t2", "t4x"), (2, "t3", "t4"), (2, None, "t1"), (2, "t1", None)], "conv_id long, call_id string, depends_on string")
    none = (spark.createDataFrame([], "conv_id long, turn long, call_id string, content string"), spark.createDataFrame([], "conv_id long, turn long, role string, content string"))
    got = {(r.conv_id, r.turn): r.level for r in toolcalls.chat(calls, *none, TOOLS, depends).collect()}
    assert got == {(1, 0): 0, (1, 1): 1, (1, 2): 2, (1, 3): 0, (1, 4): 3, (2, 0): 0, (2, 1): 1, (2, 2): 2, (2, 3): 1, (2, 4): 0}
