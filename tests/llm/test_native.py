import json
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from terracause.llm import licences, mixing, queries, toolcalls
from tests.llm.fixtures import documents, frame

NAMED = ["op4_tool_calls", "op8_mixing", "op9_licences"]


@pytest.mark.parametrize("name", NAMED)
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.queries()[name](spark, sf_dir)
    want = con.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    assert got == sorted((tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()), key=str)


# --- mixing


@pytest.mark.parametrize("units", [{"a": 1}, {"a": 1, "b": 1}, {"a": 5, "b": 3, "c": 1, "d": 7}, {f"s{i}": 1 + i % 4 for i in range(20)}])
def test_pattern_is_never_a_block_off(units):
    total, seen = sum(units.values()), Counter()
    order = sorted(mixing.pattern(units), key=lambda r: r[2])
    assert [r[2] for r in order] == list(range(total))
    for name, i, slot in order:
        assert seen[name] == i and slot >= i * total // units[name] and slot < -(-(i + 1) * total // units[name])
        seen[name] += 1
        assert all(abs(seen[s] - (slot + 1) * u / total) < 1 for s, u in units.items())


def test_mix_keeps_all_and_follows_the_weights(spark):
    rows = [(i, f"t{i}", None, "a" if i % 3 else ("b" if i % 2 else None), i) for i in range(400)]
    units = {"a": 2, "b": 1}
    df = frame(spark, rows, extra=True)
    got = mixing.mix(df, units, block=4).collect()
    assert Counter(r.doc_id for r in got) == Counter(range(400)) and {r.part for r in got} == {"x"}
    assert len({r.position for r in got}) == 400
    slots = {}
    for r in got:
        slots.setdefault(r.slot, []).append(r)
    assert all(len({r.source for r in b}) == 1 and len(b) <= 4 for b in slots.values())
    target = {"a": 2 / 4, "b": 1 / 4, None: 1 / 4}
    seen, last = Counter(), max(r.slot for r in got if r.on_target)
    for slot in range(last + 1):
        seen[slots[slot][0].source] += 1
        assert all(abs(seen[s] - (slot + 1) * w) < 1 for s, w in target.items())
        assert len(slots[slot]) == 4


def test_mix_of_awkward_tables(spark, monkeypatch):
    assert mixing.mix(frame(spark, []), {"a": 1}).count() == 0
    got = mixing.mix(frame(spark), {"src0": 3}, block=8)
    assert got.count() == len(documents()) and got.select("position").distinct().count() == len(documents())
    rows = [(None, "t", None, "a", i) for i in range(300)] + [(7, "t", None, "a", i) for i in range(300)] + [(i, "t", None, "b", i) for i in range(50)]
    monkeypatch.setattr(mixing, "GROUP_ROWS", 8)
    got = mixing.mix(frame(spark, rows).withColumn("slot", F.lit("mine")).withColumn("_source", F.lit("kept")), {"a": 2, "b": 1}, block=4)
    out = got.collect()
    assert len(out) == 650 and len({r.position for r in out}) == 650 and {r._source for r in out} == {"kept"}
    assert sorted(got.columns) == sorted(["doc_id", "text", "lang", "source", "n_chars", "_source", "block", "slot", "position", "on_target"])
    named = mixing.mix(frame(spark, rows).withColumn("slot", F.lit("mine")), {}, names=("b", "s", "p", "o")).collect()
    assert {r.slot for r in named} == {"mine"} and sorted(r.p for r in named) == list(range(650))


# --- licences


def scan(spark, *texts):
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    return {r.doc_id: r for r in licences.scan(frame(spark, rows, extra=True)).collect()}


def test_base_places(spark):
    got = scan(spark, "The MIT License, the mit-license and mit license; Apache LICENSE.", None, "", "...", "xmit license", "GNU General Public License", "mit licenseé", "mıt license")
    r = got[0]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (11, 4, 1, 9, "apache,mit")
    for i in (1, 2, 3):
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].base_labels, got[i].labels, got[i].score) == (0, 0, None, "", "", 0.0)
    assert [got[i].n_base for i in (4, 5, 6, 7)] == [0, 1, 0, 0]


def test_method_finds_notices_and_asks_for_the_phrase(spark):
    filler = "lorem ipsum dolor sit amet " * 40
    got = scan(spark, filler + "Licensed under CC BY-NC 4.0.", "Licensed under CC something NC 4.0", filler + "Released under the MIT License. " + filler, *[filler] * 5)
    assert got[0].labels == "cc-by-nc" and got[0].n_base == 0 and got[0].score > 0.5
    assert got[1].labels == "" and got[1].score == 0
    assert got[2].labels == "mit" and got[2].base_labels == "mit"
    assert all(0 <= r.score <= 1 for r in got.values())


def test_only_ascii_capitals_are_lowered(spark):
    got = scan(spark, "this wor\u212a is licensed under the gnu general public license version 3", "LICENSED UNDER THE GNU GENERAL PUBLIC LICENSE", "L\u0130CENSED mit l\u0131cense")
    assert [got[i].n_words for i in range(3)] == [12, 7, 3] and [got[i].n_base for i in range(3)] == [1, 1, 0]
    assert got[0].labels == "gpl" and got[1].labels == "gpl"


def test_key_phrase_alone_is_no_notice(spark):
    filler = "lorem ipsum dolor sit amet " * 40
    text = "redistribution permitted modification " + filler + "we ship source and binary forms of it " + filler + "use with or without"
    got = scan(spark, text, *[filler] * 9)
    assert got[0].labels == "" and got[0].score == 0


def test_scan_of_repeats_and_nothing(spark):
    assert licences.scan(frame(spark, [])).count() == 0
    got = [r for r in licences.scan(frame(spark)).collect() if r.doc_id == 1011]
    assert len(got) == 2 and got[0] == got[1]


# --- tool calls

CALLS = "conv_id long, turn long, call_id string, parent_id string, tool string, arguments string, level int"
RESULTS = "conv_id long, turn long, call_id string, content string, kind int"
SCHEMAS = {"add": {"a": ("integer", True), "b": ("number", True), "tags": ("array", False), "on": ("boolean", False), "o": ("object", False)}}


def test_calls_and_results(spark):
    ok = '{"b": 2.5, "a": 1, "tags": ["é", 1], "on": true, "o": {"z": 1, "y": null}}'
    calls = [
        (1, 1, "c1", None, "add", ok, 9),
        (1, 3, "c2", "c1", "add", '{"a": true, "b": "x", "c": 1}', 9),
        (1, 5, "c3", "c2", "none", "{}", 9),
        (1, 7, "c4", "c3", "add", None, 9),
        (2, 1, "x1", "x2", "add", ok, 9),
        (2, 2, "x2", "x1", "add", ok, 9),
        (2, 3, "x3", "x2", "add", ok, 9),
        (3, 1, "y1", "gone", "add", "[1]", 9),
        (3, 2, "c1", "c4", "add", "{}", 9),
        (3, 4, None, None, "add", "{}", 9),
    ]
    results = [(1, 2, "c1", "one\n\"q\"", 5), (1, 9, "c1", "again", 5), (1, 4, "c9", "lost", 5), (1, 6, None, None, 5)]
    rows = toolcalls.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS).collect()
    got = {(r.kind, r.call_id, r.turn): r for r in rows}
    assert len(rows) == 12
    first = got[0, "c1", 1]
    assert (first.level, first.answers, first.valid) == (0, 2, True)
    assert first.json == '{"arguments":{"a":1,"b":2.5,"o":{"y":null,"z":1},"on":true,"tags":["é",1]},"call_id":"c1","name":"add","role":"assistant"}'
    assert got[0, "c2", 3].problems == "a: not integer; b: not number; c: not in the schema"
    assert [got[0, f"c{i}", 2 * i - 1].level for i in (2, 3, 4)] == [1, 2, 3]
    assert got[0, "c3", 5].problems == "unknown tool" and got[0, "c4", 7].problems == "no JSON object"
    assert all(got[0, f"x{i}", i].level is None and got[0, f"x{i}", i].problems == "cycle" for i in (1, 2, 3))
    assert got[0, "y1", 1].level == 0
    assert got[1, "c1", 2].level == 0 and json.loads(got[1, "c1", 2].json)["content"] == 'one\n"q"'
    assert got[1, "c9", 4].problems == "no call" and not got[1, None, 6].valid


def test_long_chain_and_no_calls(spark):
    calls = [(1, i, f"k{i}", f"k{i - 1}" if i else None, "add", '{"a":1,"b":1}', 0) for i in range(300)]
    rows = toolcalls.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS), SCHEMAS).collect()
    assert sorted((r.turn, r.level) for r in rows) == [(i, i) for i in range(300)]
    assert toolcalls.link(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), SCHEMAS).count() == 0


@pytest.mark.parametrize("group_rows", [4, 2_048])
def test_positions_are_the_same_for_any_layout(spark, monkeypatch, group_rows):
    """A hot id on different rows, a hot row in many copies, ids of null: the same rows at the same positions however the table is dealt."""
    monkeypatch.setattr(mixing, "GROUP_ROWS", group_rows)
    rows = [(7, f"s{i % 2}", f"text {i}") for i in range(150)] + [(8, "s0", "copy")] * 120 + [(None, "s1", f"n{i % 40}") for i in range(90)] + [(i, f"s{i % 3}", "t") for i in range(100, 300)]
    tables = [spark.createDataFrame(some, "doc_id long, source string, text string").repartition(n) for some, n in ((rows, 1), (rows[::-1], 5), (rows[100:] + rows[:100], 3))]
    found = [sorted((tuple(r) for r in mixing.mix(df, {"s0": 3, "s1": 1, "s2": 2}, 8).select("doc_id", "source", "text", "block", "slot", "position").collect()), key=str) for df in tables]
    assert found[0] == found[1] == found[2] and len(found[0]) == len(rows)
    assert len({r[5] for r in found[0]}) == len(rows)
    for name in ("s0", "s1", "s2"):
        mine = sorted(r[5] for r in found[0] if r[1] == name)
        assert len({p // 8 for p in mine}) == -(-len(mine) // 8)  # whole blocks, the last one shorter
