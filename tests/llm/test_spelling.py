"""Operator 13 against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from terracause.llm import spelling
from tests.llm.fixtures import documents


def vocabulary(rows):
    count = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n):
    beside = {w: [x for x in n if abs(len(x) - len(w)) < 2 and near(w, x)] for w in n}
    form = {}
    for w, others in beside.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(beside[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def rows_of(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, df.collect()))


def words(seed=0, kinds=260):
    """Documents of words from few letters, with their single edits, in numbers from 5 to some hundreds."""
    rng, texts = np.random.default_rng(seed), []
    for _ in range(kinds):
        w = "".join(rng.choice(list("abé"), rng.integers(6, 10)))
        texts += [w] * int(5 * 5.5 ** rng.integers(0, 4))
        for _ in range(3):
            i, c = rng.integers(len(w)), rng.choice(list("abéöX"))
            texts += [[w[:i] + c + w[i + 1 :], w[:i] + c + w[i:], w[:i] + w[i + 1 :]][rng.integers(3)]] * int(rng.integers(5, 40))
    rng.shuffle(texts)
    return [(i, " ".join(texts[i * 40 : i * 40 + 40])) for i in range(len(texts) // 40 + 1)]


@pytest.mark.parametrize("crowd", [spelling.CROWD, 6])
def test_variants_match_brute_force(spark, crowd, monkeypatch):
    monkeypatch.setattr(spelling.near_words, "__defaults__", (crowd, 64))
    rows = words()
    got = rows_of(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    assert got == brute(vocabulary(rows))
    assert sum(r[1] is not None and r[2] != r[1] for r in got) > 5  # chains of two at least


def test_awkward_documents(spark):
    rows = documents() * 4 + [(7, "Straße STRASSE straße " * 9), (8, "z" * 3000 + " " + "z" * 2999 + " "), (None, "ÉCOLES école Écoles " * 9)]
    rows += [(9 + i, "z" * 3000 + " " + "z" * 2999 + " a×b÷cdef \x00naïveté") for i in range(8)]
    rows = [r[:2] for r in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as word", "2 as shelf", "3 as own", "4 as name", "5 as run")
    assert rows_of(spelling.variants(df)) == brute(vocabulary(rows))


def test_empty(spark):
    assert rows_of(spelling.variants(spark.createDataFrame([], "doc_id long, text string"))) == []
    assert rows_of(spelling.variants(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))) == []


@pytest.mark.parametrize("tile", [2, 5, 64])
def test_tiles_find_all_pairs_of_a_shelf(tile):
    rng = np.random.default_rng(3)
    bag = sorted({"abc" + "".join(rng.choice(list("xy"), 4)) for _ in range(40)} | {"abc" + "".join(rng.choice(list("xy"), 3)) for _ in range(20)})
    zeros = np.zeros(len(bag), np.int64)
    a, b = spelling.near_pairs(bag, zeros, zeros + 7, zeros, zeros, zeros > 0, tile)
    want = {(i, j) for i in range(len(bag)) for j in range(i) if max(len(bag[i]), len(bag[j])) == 7 and near(bag[i], bag[j])}
    found = [(max(p, q), min(p, q)) for p, q in zip(a.tolist(), b.tolist(), strict=True)]
    assert len(found) == len(set(found)) and set(found) == want
