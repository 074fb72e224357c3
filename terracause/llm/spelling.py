"""Operator 13: spelling variants of words by dense prefix-suffix tiling.

Words are counted in one reading of the texts. Two words are a single edit apart when their
common prefix and common suffix together reach the longer length less one. A tile compares
two blocks of words at once: their code points stand as rows of padded matrices, and one
step a place tells for all pairs how far they agree, from the front and from the back.

Which tiles are needed: of words a single edit apart, the longer one with L places, the
first L // 2 agree, or the last L - L // 2 do. So a word stands on four shelves: by its
beginning and by its end, as one of the longest there and as a shorter one. Shelves are
sorted, their rows cut into blocks, and blocks with a shelf in common are compared; a pair
counts once, on the shelf of its beginning if it has one. A shelf with over ``CROWD`` words
is dealt into sections by hash, and each pair of sections is compared apart, so the work of
a crowded one is spread over tasks and no pair is left out. A task passes on one row a word:
how many near ones it found, and the most frequent.

A word's form is its near word of the largest number of occurrences, if that is
``RATIO`` times its own or more; roots follow forms by pointer doubling (numbers grow
``RATIO``-fold at every step, so chains are short).

Defined cases: a null or empty text has no words; a null id counts as an empty text before
the colon; rows with equal id and text all count; runs of any length are words; ties of
numbers go to the smallest word in code-point order; a word without near words has n_near 0
and null form; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracause.llm.components import join_spread
from terracause.llm.shared import cut, give_back, partitions

#: One word in this many of a document, by hash, loses a code point.
DROPPED = 199
LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
#: Words of a shelf before it is dealt into sections, rows of a tile's side, and rows of a task about.
CROWD = 4_096
TILE = 192
TASK_ROWS = 65_536
_FOUND = "word string, n_near long, other_n long, other string"


def vocabulary(docs: DataFrame, least: int = LEAST_COUNT, length: int = LEAST_LENGTH) -> DataFrame:
    """word and n: maximal runs of letters up to U+00FF, A-Z lower-cased, some short of a code point by hash; those long and frequent enough."""
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    # a shorter run makes no word, and no part of it is matched
    runs = docs.where("text is not null").select(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit(":")).alias("name"), F.explode(F.regexp_extract_all(lower, F.lit(f"[a-zÀ-ÿ]{{{length},}}"), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("name", "run").cast("binary"))
    place = (h % F.char_length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.char_length("run")))
    words = runs.select(F.when(h % DROPPED == 0, short).otherwise(F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where((F.col("n") >= least) & (F.char_length("word") >= length))


def shelved(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """The rows of all shelves: word, n, longer, side, shelf, and section (own) with the pair of sections (one, two) that is compared."""
    size = F.char_length("word")
    spots = []
    for longer in (size, size + 1):
        head = F.floor(longer / 2).cast("int")
        tail = (longer - head).cast("int")
        for side, piece in ((0, F.substring("word", F.lit(1), head)), (1, F.substring("word", size - tail + 1, tail))):
            spots.append(F.struct(longer.alias("longer"), F.lit(side).alias("side"), F.xxhash64(longer, F.lit(side), piece).alias("shelf")))
    rows = cut(words.select("word", "n", F.inline(F.array(*spots))), "op13-shelves")
    crowded = rows.groupBy("shelf").agg(F.count("*").alias("_k")).where(F.col("_k") > crowd).select("shelf", F.ceil(F.col("_k") * 2 / crowd).cast("int").alias("sections"))
    dealt = join_spread(rows, cut(crowded, "op13-crowded"), "shelf").withColumn("sections", F.coalesce("sections", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("sections")).cast("int")
    both = dealt.withColumn("own", own).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("sections") - 1)))
    return both.select("word", "n", "longer", "side", "shelf", "own", F.least("own", "_o").alias("one"), F.greatest("own", "_o").alias("two"))


def pad(words: list[str], back: bool) -> np.ndarray:
    """Code points as rows, from the front or from the back; 0 where a word has no more."""
    lengths = np.array([len(w) for w in words])
    flat = np.frombuffer("".join(w[::-1] if back else w for w in words).encode("utf-32-le"), np.uint32)
    out = np.zeros((len(words), int(lengths.max(initial=0))), np.uint32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def agreement(a: np.ndarray, b: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """In how many places from the start a row of ``a`` agrees with a row of ``b``, for all pairs that are ``alive``."""
    out, alive = np.zeros(alive.shape, np.int32), alive.copy()
    for place in range(min(a.shape[1], b.shape[1])):
        alive &= (a[:, place][:, None] == b[:, place]) & (a[:, place] != 0)[:, None]
        if not alive.any():
            break
        out += alive
    return out


def near_pairs(words: list[str], unit: np.ndarray, longer: np.ndarray, side: np.ndarray, own: np.ndarray, mixed: np.ndarray, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words of each near pair, once; rows are sorted by ``unit``, and ``mixed`` ones pair with other sections only."""
    lengths = np.array([len(w) for w in words])
    begins = list(range(0, len(words), tile))
    blocks = [(pad(words[a : a + tile], False), pad(words[a : a + tile], True)) for a in begins]
    left, right = [], []
    for i, a in enumerate(begins):
        x = np.arange(a, min(a + tile, len(words)))
        for j in range(i, len(begins)):
            b = begins[j]
            if j > i and unit[b] != unit[x[-1]]:
                break
            y = np.arange(b, min(b + tile, len(words)))
            alive = (unit[x][:, None] == unit[y]) & (np.maximum(lengths[x][:, None], lengths[y]) == longer[x][:, None])
            alive &= ~mixed[x][:, None] | (own[x][:, None] != own[y])
            if i == j:
                alive &= x[:, None] < y
            if not alive.any():
                continue
            prefix = agreement(blocks[i][0], blocks[j][0], alive)
            alive &= (side[x] == 0)[:, None] | (prefix < longer[x][:, None] // 2)
            suffix = agreement(blocks[i][1], blocks[j][1], alive)
            p, q = np.nonzero(alive & (prefix + suffix >= longer[x][:, None] - 1))
            left.append(x[p])
            right.append(y[q])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def _compare(table: pa.Table) -> pa.Table:
    """Of the shelves of one task: each word with its number of near words, and the one with the most occurrences."""
    keys = {c: table[c].to_numpy() for c in ("shelf", "one", "two", "longer", "side", "own", "n")}
    order = np.lexsort([keys[c] for c in ("two", "one", "shelf", "side", "longer")])
    steps = sum((np.diff(keys[c][order], prepend=keys[c][order][:1]) != 0).astype(np.int64) for c in ("two", "one", "shelf", "side", "longer"))
    unit = np.cumsum(steps > 0)
    # who stands alone has no partner there
    some = np.bincount(unit, minlength=1)[unit] > 1
    order, unit = order[some], unit[some]
    words = table["word"].combine_chunks().take(pa.array(order)).to_pylist()
    n = keys["n"][order]
    a, b = near_pairs(words, unit, keys["longer"][order], keys["side"][order], keys["own"][order], (keys["one"] != keys["two"])[order])
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    number = {w: i for i, w in enumerate(sorted(set(words)))}
    rank = np.array([number[w] for w in words], np.int64)
    of = rank[a] if len(a) else a
    by = np.lexsort((rank[b], -n[b], of)) if len(a) else a
    first = np.flatnonzero(np.diff(of[by], prepend=-1))
    count = np.diff(first, append=len(by))
    best = b[by][first]
    give_back()
    return pa.table({"word": pa.array([words[i] for i in a[by][first]], pa.string()), "n_near": pa.array(count, pa.int64()), "other_n": pa.array(n[best], pa.int64()), "other": pa.array([words[i] for i in best], pa.string())})


def near_words(words: DataFrame, crowd: int = CROWD, task_rows: int = TASK_ROWS) -> DataFrame:
    """word, n_near, other_n and other (the near word with the most occurrences) of the words that have near ones."""
    rows = cut(shelved(words, crowd), "op13-sections")
    parts = max(partitions(words.sparkSession), math.ceil(rows.count() / task_rows))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("shelf", "one", "two"), F.lit(parts)).cast("int"))
    found = dealt.groupBy("part").applyInArrow(_compare, _FOUND)
    best = F.min(F.struct((-F.col("other_n")).alias("m"), "other"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("other_n"), F.col("b.other").alias("other"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root of all words that have a form, by pointer doubling."""
    up = cut(forms.select("word", F.col("form").alias("root")), "op13-roots")
    while True:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = cut(join_spread(up, further, "root").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "op13-roots")
        up = step.select("word", "root")
        if step.where("moved").isEmpty():
            return up


def variants(docs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the documents."""
    words = cut(vocabulary(docs), "op13-words")
    joined = words.join(near_words(words), "word", "left")
    form = F.col("other_n") >= ratio * F.col("n")
    named = cut(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(form, F.col("other")).alias("form"), F.when(form, F.col("other_n")).alias("form_n")), "op13-forms")
    out = named.join(roots(named.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
