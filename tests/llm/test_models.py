import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terracause.llm import language, quality, vectortree
from tests.llm.fixtures import frame, prose

SYLLABLES = {"aa": ["ka", "to", "ri"], "bb": ["öl", "sch", "un"], "cc": ["eau", "çon", "lé"]}


def corpus(n=300):
    rng, rows, labels = random.Random(4), [], []
    for i in range(n):
        lang = sorted(SYLLABLES)[i % 3]
        text = " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(40))
        good = i % 4 != 0
        if not good:
            text = text.upper().replace(" ", "!! ") if i % 8 else "spam " * 60
        rows.append((i, text, lang, "src0", len(text)))
        labels.append((i, int(good), 0))
    rows += [(5000, None, None, None, None), (5001, "", None, None, None), (5002, "12 34", "aa", None, 5), (None, "ka to ri", "aa", None, 8)]
    return rows, labels


def test_quality_on_the_held_out_fold(spark):
    rows, labels = corpus()
    marks = spark.createDataFrame([*labels, (0, 1, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.documents_report(frame(spark, rows, extra=True), marks).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    test = [(r, y) for i, y, _ in labels if (r := got[i]).held_out]
    assert len(test) > 30 and np.mean([r.predicted == y for r, y in test]) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) for r in got.values())


def test_quality_without_labels(spark):
    rows, labels = corpus(20)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.documents_report(frame(spark, rows), none).collect()} == {0.5}
    assert quality.documents_report(frame(spark, []), none).count() == 0
    clash = quality.score(frame(spark, rows), quality.fit(frame(spark, rows), none), out="lang")
    assert {r.lang for r in clash.collect()} == {0.5} and sorted(clash.columns) == sorted(frame(spark, rows).columns)
    with pytest.raises(ValueError):
        quality.score(frame(spark, rows), quality.fit(frame(spark, rows), none), out="text")


def test_held_out_fold_is_crc32(spark):
    import zlib

    got = spark.range(50).select("id", quality.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


def test_language_on_the_held_out_fold(spark):
    rows, _ = corpus()
    got = {r.doc_id: r for r in language.documents_report(frame(spark, rows, extra=True)).collect()}
    test = [(got[r[0]], r[2]) for r in rows if r[0] is not None and r[2] and got[r[0]].held_out and r[0] < 5000]
    assert np.mean([r.lang_pred == lang for r, lang in test]) > 0.85
    assert [got[i].lang_pred for i in (5000, 5001, 5002)] == ["und"] * 3
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_of_small_tables(spark):
    assert language.documents_report(frame(spark, [])).count() == 0
    rows = [(1, "ka to", "aa", None, 5), (2, "ri", "aa", None, 2), (3, None, "aa", None, None)]
    assert {(r.doc_id, r.lang_pred) for r in language.documents_report(frame(spark, rows)).collect()} == {(1, "aa"), (2, "aa"), (3, "und")}
    none = [(1, "ka to", None, None, 5)]
    assert language.documents_report(frame(spark, none)).first().lang_pred == "und"


def test_language_whose_rows_are_repeats(spark):
    """A language of eight texts, each thousands of times under one id, beside many others: it is learnt, each text once."""
    rows, _ = corpus(200)
    rows = [r for r in rows if r[2] != "cc"]
    few = [(9001 + i, " ".join("eau çon lé".split() * (8 + i)), "cc") for i in range(8)]
    df = frame(spark, rows).select("doc_id", "text", "lang")
    copies = spark.createDataFrame(few, df.schema).crossJoin(spark.range(700)).select("doc_id", "text", "lang")
    both = df.unionByName(copies)
    names, some = language.sample_texts(both.where("lang is not null and text is not null").where(~quality.held_out(F.col("doc_id"))).select("text", "lang"), 60)
    count = {r.lang: r["count"] for r in some.groupBy("lang").count().collect()}
    kept = spark.createDataFrame(few, df.schema).where(~quality.held_out(F.col("doc_id"))).count()
    assert names == ["aa", "bb", "cc"] and count == {"aa": 20, "bb": 20, "cc": kept} and kept > 0
    one = language.sample_texts(both.where("lang is not null and text is not null").select("text", "lang"), 2)[1]
    assert sorted(r.lang for r in one.collect()) == ["aa", "bb", "cc"]
    got = language.documents_report(both.dropDuplicates(["doc_id"]).unionByName(copies.limit(0)))
    assert {r.lang_pred for r in got.where("doc_id > 9000 and doc_id < 9009").collect()} == {"cc"}


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in language.start_weights(3).items()}
    codes, y = rng.integers(0, 256, (4, 5)).astype(np.uint8), np.array([0, 1, 2, 1])
    loss, g = language.gradients({k: v.astype(np.float32) for k, v in w.items()}, codes, y)
    for name in ("f_rec", "b_in", "out", "embed", "f_bias"):
        i = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        ends = []
        for step in (1e-2, -1e-2):
            moved = {k: v.astype(np.float32) for k, v in w.items()}
            moved[name][i] += step
            ends.append(language.gradients(moved, codes, y)[0])
        assert (ends[0] - ends[1]) / 2e-2 == pytest.approx(float(g[name][i]), rel=0.05, abs=1e-4)


def test_every_position_is_labelled():
    m = language.Model(["a", "b"], language.train([b"aaaa", b"bbbb", b"abab", b"baba"] * 20, np.array([0, 1, 0, 1] * 20), 2, steps=60))
    p = m.probabilities(pa.array(["aaaa aaaa", "bbbb", "", None]))
    assert p[0].argmax() == 0 and p[1].argmax() == 1 and (p[2:] == 0).all()


def vectors(n=900, dims=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (12, dims))
    x = (centres[rng.integers(0, 12, n)] + rng.normal(0, 0.4, (n, dims))).astype(np.float32)
    x[100:160] = x[100]  # many equal vectors
    rows = [(i, x[i].tolist(), int(i % 3)) for i in range(n)]
    rows += [(n, None, 0), (n + 1, [0.0] * dims, 0), (n + 2, [float("nan")] * dims, 0), (n + 3, [1.0] * (dims - 1), 0), (n + 4, [None] * dims, 0), (None, x[0].tolist(), 0), (n + 5, [float("inf")] * dims, 0)]
    return rows, x


def test_neighbours_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectortree, "BLOCK_ROWS", 40)
    rows, x = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("leaf", F.lit(1)).repartition(3)
    got = vectortree.nearest(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert sorted(by) == list(range(0, 900, 20))
    exact, hit = x.astype(np.float64), []
    for q, found in by.items():
        found.sort(key=lambda r: r["rank"])
        score = exact @ exact[q]
        assert [r["rank"] for r in found] == list(range(1, len(found) + 1)) and q not in {r.vec_id for r in found}
        assert all(r.score == pytest.approx(score[r.vec_id], rel=1e-12) for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        best = sorted((i for i in range(900) if i != q), key=lambda i: (-score[i], i))[:20]
        hit.append(len({r.vec_id for r in found} & set(best)) / 20)
    assert np.mean(hit) >= 0.9


def test_few_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vectortree.nearest(spark.createDataFrame([], schema)).count() == 0
    rows = [(0, [1.0, 2.0], 0), (1, [2.0, 1.0], 0), (2, [1.0, 2.0], 0)]
    got = vectortree.nearest(spark.createDataFrame(rows, schema)).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 2, 5.0), (0, 2, 1, 4.0)]
