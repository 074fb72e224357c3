"""Operator 6: quality classifier on random-indexing word vectors.

Tokens are runs of letters, of digits or of other visible bytes, as written. The
``VOCABULARY`` most frequent tokens of all documents have ids of their own; any other token
has the id of its shape. Each id has a sparse random index vector; its word vector is the
sum of the index vectors of its neighbours in all documents, within two tokens.

A whole text is pooled to three vectors: the sum of its word vectors over their number
plus ``SHRINK``, and for the pairs of tokens one and two apart the sum of the products of
their vectors, likewise (a pair's vector, as a bigram's in random indexing). A two-layer
numpy network scores them; a temperature fitted on rows kept out of its training
calibrates the probability.

Bounds: the network is fitted on at most ``sample`` labelled rows (default ``SAMPLE``),
drawn by a hash of their id; vocabulary and word vectors come from all documents. What
reaches the driver is of a size fixed by the parameters. Scoring reads every document.

Defined cases: a null text counts as empty; an empty text is scored as the vector of
zeros; a document labelled more than once counts with its lowest label; without both
labels in the sample every score is the share of label 1 (0.5 without any). Repeated rows
and ids each have a row; of ids on many rows as many rows are learnt from as ids were to
be. An input column with the name of the output column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracause.llm.shared import cut, give_back
from terracause.llm.textvec import U64, WHITE, buffers, mix64, slices, span_hashes

SAMPLE = 6_000
VOCABULARY = 2_000
DIMS = 64
WINDOW = 2
HIDDEN = 32
#: Added to the number of tokens, and of pairs, that a pooled vector is divided by: short texts stay near zero.
SHRINK = 16
SHRINK_PAIRS = 4
#: Words, pairs one apart, pairs two apart.
WIDTH = 3 * DIMS
#: Tokens whose vectors are held at once.
TOKENS = 1 << 11
#: Bytes of text that one pass cuts into tokens.
SLICE = 2 << 20

_CLASS = np.full(256, 3, np.uint8)
_CLASS[WHITE] = 0
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[0x80:] = 1
SHAPES = 8


def held_out(doc_id: Column) -> Column:
    """The fold that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and shape of every token, and for each row the index of its first token."""
    size = len(data)
    kind = _CLASS[data]
    new = np.ones(size + 1, bool)
    new[1:size] = kind[1:] != kind[:-1]
    new[offsets] = True
    at = np.flatnonzero(new[:size])
    starts, ends = at, np.append(at[1:], size)
    keep = kind[starts] != 0 if size else np.zeros(0, bool)
    starts, ends = starts[keep], ends[keep]
    upper = np.zeros(size + 1, np.int64)
    np.cumsum((data >= 65) & (data <= 90), out=upper[1:])
    capitals = upper[ends] - upper[starts]
    long = (ends - starts) > 1
    # 0 lower, 1 one capital, 2 mixed, 3 all capitals, 4 digits, 5 one other, 6 several others
    all_caps = long & (capitals == ends - starts)
    shape = np.where(all_caps, 3, np.where(capitals > 1, 2, np.where(capitals == 1, 1, 0)))
    k = kind[starts] if size else np.zeros(0, np.uint8)
    shape = np.where(k == 2, 4, np.where(k == 3, np.where(long, 6, 5), shape))
    return span_hashes(data, starts, ends), shape, np.searchsorted(starts, offsets)


def token_ids(hashes: np.ndarray, shape: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Ids of tokens: the place in the sorted vocabulary, or beyond it the shape."""
    if not len(vocabulary):
        return shape
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at, len(vocabulary) + shape)


def index_vectors(n: int) -> np.ndarray:
    """Sparse ternary vectors: eight entries of +1 or -1 each."""
    out = np.zeros((n, DIMS), np.float32)
    for j in range(8):
        h = mix64(np.arange(n, dtype=U64) * U64(8) + U64(j + 1))
        np.add.at(out, (np.arange(n), (h % U64(DIMS)).astype(int)), np.where(h >> U64(63), 1.0, -1.0))
    return out


def _passes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    data, offsets = buffers(column)
    for a, b in slices(offsets, SLICE):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        yield a, b, *tokens(part, at)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, hashes, _, _ in _passes(batch.column(0)):
            seen, n = np.unique(hashes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(n)], ["token", "n"])
    give_back()


def _contexts(vocabulary: np.ndarray):
    """Rows id, v0 … of what each id's neighbours add to its word vector; whole numbers, so their order doesn't matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(vocabulary) + SHAPES
        seen = np.zeros((n, n), np.int64)
        for batch in batches:
            for _, _, hashes, shape, first in _passes(batch.column(0)):
                ids = token_ids(hashes, shape, vocabulary)
                row = np.repeat(np.arange(len(first) - 1), np.diff(first))
                for step in range(1, WINDOW + 1):
                    same = row[step:] == row[:-step]
                    seen += np.bincount(ids[:-step][same] * n + ids[step:][same], minlength=n * n).reshape(n, n)
        index = index_vectors(n).astype(np.float64)
        total = (seen @ index + seen.T @ index).astype(np.int64)
        some = np.flatnonzero(seen.sum(1) + seen.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(total[some, j]) for j in range(DIMS)]], ["id", *SUMS])
        del seen, total
        give_back()

    return run


SUMS = [f"v{j}" for j in range(DIMS)]


def pool(column: pa.Array, vocabulary: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Pooled vectors of each whole text (rows x WIDTH): of words, and of pairs one and two apart."""
    out = np.zeros((len(column), WIDTH), np.float32)
    for a, b, hashes, shape, first in _passes(column):
        ids, whole = token_ids(hashes, shape, vocabulary), np.diff(first)
        row = np.repeat(np.arange(a, b), whole)
        for lo in range(0, len(ids), TOKENS):
            back = min(lo, 2)  # pairs reach over the cut
            v, of = vectors[ids[lo - back : lo + TOKENS]], row[lo - back : lo + TOKENS]
            new = np.flatnonzero(np.diff(of[back:], prepend=-1))
            rows = of[back:][new]
            out[rows, :DIMS] += np.add.reduceat(v[back:], new, axis=0)
            for step in (1, 2):
                gap = max(step - back, 0)  # the first tokens of all have nothing before them
                pair = np.zeros((len(v) - back, DIMS), np.float32)
                np.multiply(v[back + gap :], v[back + gap - step : len(v) - step], out=pair[gap:])
                pair[gap:][of[back + gap :] != of[back + gap - step : len(v) - step]] = 0
                out[rows, step * DIMS : (step + 1) * DIMS] += np.add.reduceat(pair, new, axis=0)
        out[a:b, :DIMS] /= (whole + SHRINK)[:, None]
        for step in (1, 2):
            out[a:b, step * DIMS : (step + 1) * DIMS] /= (np.maximum(whole - step, 0) + SHRINK_PAIRS)[:, None]
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """All that scoring needs; its size is fixed by the parameters above."""

    vocabulary: np.ndarray
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    temperature: float
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(column), self.constant)
        return sigmoid(self.logits(pool(column, self.vocabulary, self.vectors)).astype(np.float64) / self.temperature)


def train(x: np.ndarray, y: np.ndarray, seed: int = 7, epochs: int = 60) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], float]:
    """Two-layer network by Adam on four fifths of the rows, its temperature on the rest."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    x, y = x[order], y[order].astype(np.float32)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = (x - mean) / scale
    cut_at = max(1, len(x) // 5)
    zt, yt, zv, yv = z[cut_at:], y[cut_at:], z[:cut_at], y[:cut_at]
    if not len(zt):
        zt, yt = zv, yv
    w = [rng.normal(0, DIMS**-0.5, (z.shape[1], HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32), rng.normal(0, HIDDEN**-0.5, HIDDEN).astype(np.float32), np.zeros((), np.float32)]
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(zt)), max(1, len(zt) // 128)):
            h = np.tanh(zt[rows] @ w[0] + w[1])
            d = (sigmoid(h @ w[2] + w[3]) - yt[rows]) / len(rows)
            dh = d[:, None] * w[2] * (1 - h * h)
            grads = [zt[rows].T @ dh + 1e-4 * w[0], dh.sum(0), h.T @ d + 1e-4 * w[2], d.sum()]
            t += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] = (w[i] - 3e-3 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    out = np.tanh(zv @ w[0] + w[1]) @ w[2] + w[3]
    temps = np.geomspace(0.5, 8, 60)
    loss = [np.mean(np.logaddexp(0, out / s) - yv * out / s) for s in temps]
    return mean, scale, w, float(temps[int(np.argmin(loss))])


def word_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Vocabulary (sorted token hashes) and unit word vectors of all ids, from all documents."""
    texts = docs.select("text")
    top = texts.mapInArrow(_count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(VOCABULARY)
    vocabulary = np.sort(np.array([r.token for r in top.collect()], np.int64).view(U64))
    sums = texts.mapInArrow(_contexts(vocabulary), ", ".join(f"{c} long" for c in ("id", *SUMS))).groupBy("id").agg(*[F.sum(c).alias(c) for c in SUMS])
    got = sums.toPandas()  # one row an id
    total = np.zeros((len(vocabulary) + SHAPES, DIMS))
    total[got["id"].to_numpy(int)] = got[SUMS].to_numpy(float)
    return vocabulary, (total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled rows outside the held-out fold."""
    spark = docs.sparkSession
    marked = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = marked.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    vocabulary, vectors = word_vectors(docs)
    column = spark.sparkContext.broadcast((vocabulary, vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pool(batch.column(0), *column.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), WIDTH).cast(pa.list_(pa.float32()))], ["y", "h", "t", "x"])
        give_back()

    # at most ``sample`` ids and labels; of ids that stand on many rows as many rows are taken
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = cut(rows.select("text", F.col("quality").cast("int").alias("y"), F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t")), "op6")
    got = rows.mapInArrow(run, "y int, h long, t long, x array<float>").orderBy("h", "t").limit(sample).toPandas()
    y = got["y"].to_numpy() if len(got) else np.zeros(0)
    if len(set(y.tolist())) < 2:
        return Model(vocabulary, vectors, np.zeros(WIDTH), np.ones(WIDTH), [], 1.0, float(y.mean()) if len(y) else 0.5)
    x = np.stack(got["x"].to_numpy())
    keys = np.lexsort((*x.T[:4], y))  # the order in which tasks ended doesn't matter
    mean, scale, weights, temperature = train(x[keys], y[keys])
    return Model(vocabulary, vectors, mean, scale, weights, temperature)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1; all other columns stay as they are."""
    if out == text:
        raise ValueError(f"{out} is the column of the texts")
    docs = docs.drop(out)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = held.value.scores(batch.column(batch.schema.get_field_index(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.astype(np.float64))], [*batch.schema.names, out])
        give_back()

    return docs.mapInArrow(run, docs.withColumn(out, F.lit(0.5)).schema)


def documents_report(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Score of each document; predicted 1 from ``threshold`` on."""
    model = fit(docs, labels)
    rows = score(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
