"""Operator 10: language identification by a bidirectional gated recurrent network over bytes.

The network reads the whole text, blanks too, once forwards and once backwards, and labels
every byte. Long texts are read in windows that overlap: each labels ``CORE`` bytes and has
read ``CONTEXT`` bytes more on either side before; all cuts are at the ends of characters. A
document's probabilities are the means over all byte positions. Training is
backpropagation through time in numpy. The squashing function is x / (1 + |x|).

Bounds: fitted on at most ``documents`` different texts with a language outside the held-out
fold, an equal number of each language (but one at least), drawn by a hash of the text, and
on at most ``pieces`` windows of ``read`` bytes of each, evenly spread over all of it: three
parameters of ``fit``. The driver holds these windows and one number a language. Scoring
reads every document.

Defined cases: a null text, or one without any letter, is ``und`` with score 0; with a
single language in the sample that one has score 1; without any, all are ``und``. Repeated
rows each have a row. An input column with the name of an output column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terracause.llm.quality import held_out
from terracause.llm.shared import cut, fresh, give_back
from terracause.llm.textvec import buffers, slices

DOCUMENTS = 3_000
WINDOWS = 48
#: Bytes of a training window.
READ = 64
CORE = 448
CONTEXT = 32
UNITS = 16
EMBED = 12
STEPS = 700
BATCH = 256
#: Windows that are read side by side, and bytes of text whose windows are found together.
ROWS = 1024
SLICE = 2 << 20
#: No letter at all, or no text.
UNDETERMINED = "und"


def squash(x: np.ndarray) -> np.ndarray:
    """In place."""
    below = np.abs(x)
    below += 1
    x /= below
    return x


def softmax(x: np.ndarray) -> np.ndarray:
    """Along the first axis, in place."""
    x -= x.max(0)
    np.exp(x, out=x)
    x /= x.sum(0)
    return x


def start_weights(classes: int, seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape).astype(np.float32)
    w = {"embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), "out": draw(2 * UNITS, classes), "bias": np.zeros(classes, np.float32)}
    for way in "fb":
        w |= {f"{way}_in": draw(EMBED, 3 * UNITS), f"{way}_rec": draw(UNITS, 3 * UNITS), f"{way}_bias": np.zeros(3 * UNITS, np.float32)}
    return w


def inputs(w: dict[str, np.ndarray], way: str) -> np.ndarray:
    """What each of the 256 bytes adds to the gates and the new state (3 units x 256)."""
    return np.ascontiguousarray((w["embed"] @ w[f"{way}_in"] + w[f"{way}_bias"]).T)


def step(x: np.ndarray, h: np.ndarray, rec: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step for all rows (units x rows): state, gates, new state, and the recurrent part of the latter."""
    u = len(h)
    r = rec @ h
    gates = squash(x[: 2 * u] + r[: 2 * u])
    gates += 1
    gates *= 0.5
    new = squash(x[2 * u :] + gates[u:] * r[2 * u :])
    after = h - new
    after *= gates[:u]
    after += new
    return after, gates, new, r[2 * u :]


def gradients(w: dict[str, np.ndarray], codes: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over all positions and its gradients, by backpropagation through time."""
    n, length = codes.shape
    states, kept = np.empty((2 * UNITS, length, n), np.float32), {"f": [], "b": []}
    for way, place, order in (("f", slice(0, UNITS), range(length)), ("b", slice(UNITS, None), range(length - 1, -1, -1))):
        table, rec, h = inputs(w, way), np.ascontiguousarray(w[f"{way}_rec"].T), np.zeros((UNITS, n), np.float32)
        for t in order:
            after, gates, new, rn = step(table[:, codes[:, t]], h, rec)
            kept[way].append((t, h, gates, new, rn))
            states[place, t] = h = after
    flat = states.reshape(2 * UNITS, -1)
    p = softmax((w["out"].T @ flat).reshape(-1, length, n) + w["bias"][:, None, None])
    loss = -float(np.log(p[y, :, np.arange(n)] + 1e-9).mean())
    p[y, :, np.arange(n)] -= 1
    d = p.reshape(len(p), -1) / (n * length)
    g = {k: np.zeros_like(v) for k, v in w.items()}
    g["out"], g["bias"] = flat @ d.T, d.sum(1)
    back = (w["out"] @ d).reshape(2 * UNITS, length, n)
    for way, part in (("f", back[:UNITS]), ("b", back[UNITS:])):
        dh, rec = np.zeros((UNITS, n), np.float32), w[f"{way}_rec"]
        seen, flows = [], []
        for t, h, gates, new, rn in reversed(kept[way]):
            z, reset = gates[:UNITS], gates[UNITS:]
            dh = dh + part[:, t]
            dnew = dh * (1 - z) * (1 - np.abs(new)) ** 2
            dgates = np.concatenate([dh * (h - new), dnew * rn]) * (0.5 * (1 - np.abs(2 * gates - 1)) ** 2)
            drec = np.concatenate([dgates, dnew * reset])
            seen.append(codes[:, t])
            flows.append(np.concatenate([dgates, dnew]))
            g[f"{way}_rec"] += h @ drec.T
            dh = dh * z + rec @ drec
        flow, code = np.concatenate(flows, axis=1), np.concatenate(seen)
        dtable = np.stack([np.bincount(code, line, 256) for line in flow], axis=1).astype(np.float32)
        g[f"{way}_in"] = w["embed"].T @ dtable
        g[f"{way}_bias"] = dtable.sum(0)
        g["embed"] += dtable @ w[f"{way}_in"].T
    return loss, g


def train(pieces: list[bytes], y: np.ndarray, classes: int, steps: int = STEPS, seed: int = 5) -> dict[str, np.ndarray]:
    """Adam over batches of equally long windows; each length is drawn by its share of bytes."""
    rng = np.random.default_rng(seed)
    w = start_weights(classes)
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    lengths = np.array([len(p) for p in pieces])
    groups = {n: np.flatnonzero(lengths == n) for n in np.unique(lengths)}
    sizes = list(groups)
    share = np.array([n * len(groups[n]) for n in sizes], float)
    share /= share.sum()
    for t in range(1, steps + 1):
        n = sizes[rng.choice(len(sizes), p=share)]
        rows = rng.choice(groups[n], min(BATCH, len(groups[n])), replace=False)
        codes = np.frombuffer(b"".join(pieces[i] for i in rows), np.uint8).reshape(-1, n)
        _, g = gradients(w, codes, y[rows])
        norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        rate = 0.02 * min(1.0, 2 * (1 - t / (steps + 1)) + 0.05)
        for k in w:
            grad = g[k] * min(1.0, 1.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.99 * v[k] + 0.01 * grad * grad
            w[k] = (w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return w


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows of all rows: row, and the bytes that each reads (from, to) and labels (from, to).

    The labelled parts of a row's windows follow each other and are the whole row.
    """
    tail = np.append((data & 0xC0) == 0x80, [False] * 4)
    size = np.diff(offsets)
    pieces = -(-size // CORE)
    row = np.repeat(np.arange(len(size)), pieces)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin, end = offsets[:-1][row], offsets[1:][row]
    first, last = begin + nth * CORE, np.minimum(begin + (nth + 1) * CORE, end)
    left, right = np.maximum(first - CONTEXT, begin), np.minimum(last + CONTEXT, end)
    for _ in range(3):  # a character has three more bytes at most
        first += tail[first] & (first < end) & (nth > 0)
        last += tail[last] & (last < end)
        right += tail[right] & (right < end)
        left -= tail[left] & (left > begin)
    return row, left, right, first, last


def blocks(w: dict[str, np.ndarray], way: str) -> tuple[np.ndarray, np.ndarray]:
    """What each byte adds to update gate, reset gate and new state (3 x 256 x units), and the recurrent weights (3 x units x units), halved for the new state."""
    apart = lambda x: np.ascontiguousarray(x.reshape(len(x), 3, UNITS).swapaxes(0, 1))
    return apart(inputs(w, way).T), apart(w[f"{way}_rec"]) * np.array([1, 1, 0.5], np.float32)[:, None, None]


def label(w: dict[str, np.ndarray], data: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Class probabilities (longest x classes x rows) of the bytes from ``left`` to ``right``; rows from the longest on.

    The steps are those of :func:`step`, in place and with a row's units side by side, so that the
    rows at work are the first ones: with gates (1 + s) / 2 the state after a step is
    ((h + new) + s (h - new)) / 2. Backwards a row joins at its last byte.
    """
    size = right - left
    longest, n, u = int(size[0]), len(size), UNITS
    active = np.searchsorted(-size, -np.arange(longest), side="left").tolist()
    out = np.zeros((longest, len(w["bias"]), n), np.float32)
    for way in "fb":
        table, rec = blocks(w, way)
        share = np.ascontiguousarray((w["out"][:u] if way == "f" else w["out"][u:]).T)
        state, wide = np.zeros((n, u), np.float32), 0
        for t in range(longest) if way == "f" else range(longest - 1, -1, -1):
            k = active[t]
            if k != wide:
                wide, h, at = k, state[:k], left[:k]
                x, r, below = (np.empty((m, k, u), np.float32) for m in (3, 3, 2))
                gates, new, half, apart = x[:2], x[2], r[2], r[0]
            table.take(data.take(at + t), axis=1, out=x, mode="clip")
            np.matmul(h, rec, out=r)
            gates += r[:2]
            np.abs(gates, out=below)
            below += 1
            gates /= below
            new += half
            half *= gates[1]
            new += half
            np.abs(new, out=below[0])
            below[0] += 1
            new /= below[0]
            np.subtract(h, new, out=apart)
            apart *= gates[0]
            h += new
            h += apart
            h *= 0.5
            out[t, :, :k] += share @ h.T
    out += w["bias"][:, None]
    return softmax(out.swapaxes(0, 1)).swapaxes(0, 1)


@dataclass
class Model:
    languages: list[str]
    weights: dict[str, np.ndarray] | None

    def probabilities(self, column: pa.Array) -> np.ndarray:
        """Mean class probabilities over all positions of each whole text (rows x languages)."""
        k = len(self.languages)
        out = np.zeros((len(column), max(k, 1)))
        if self.weights is None:
            out[:] = float(k == 1)
            return out
        data, offsets = buffers(column)
        for a, b in slices(offsets, SLICE):
            part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            row, left, right, first, last = windows(part, at)
            order = np.argsort(left - right, kind="stable")
            sums = np.zeros((b - a, k))
            for c in range(0, len(order), ROWS):
                some = order[c : c + ROWS]
                p = label(self.weights, part, left[some], right[some])
                place = np.arange(len(p))[:, None]
                p *= ((place >= first[some] - left[some]) & (place < last[some] - left[some]))[:, None]
                np.add.at(sums, row[some], p.sum(0).T)
            out[a:b] = sums / np.maximum(np.diff(at), 1)[:, None]
        return out


def _sample(batches: Iterator[pa.RecordBatch], most: int, read: int) -> Iterator[pa.RecordBatch]:
    """Of each document ``most`` windows, evenly spread, cut at the ends of characters."""
    for batch in batches:
        data, offsets = buffers(batch.column(0))
        tail = (data & 0xC0) == 0x80
        pieces = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            found = []
            for start in np.unique(np.linspace(a, max(a, b - read), most).astype(int)).tolist():
                while start < b and tail[start]:
                    start += 1
                piece = data[start : min(start + read, b)].tobytes()
                if piece:
                    found.append(piece)
            pieces.append(found)
        yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.list_(pa.binary())), *batch.columns[1:]], ["pieces", *batch.schema.names[1:]])


def sample_texts(known: DataFrame, documents: int) -> tuple[list[str], DataFrame | None]:
    """Languages, and text and lang of as many different texts of each: ``documents`` together, one of each language at least.

    Texts are told apart and drawn by hash alone; only the chosen ones are read again.
    """
    hashed = known.withColumn("_h", F.xxhash64("text"))
    distinct = cut(hashed.select("lang", "_h").distinct(), "op10-texts")
    # as many rows as there are languages: the classes of the model
    counts = {r.lang: (r.n, r.least) for r in distinct.groupBy("lang").agg(F.count("*").alias("n"), F.min("_h").alias("least")).collect()}
    languages = sorted(counts)
    if len(languages) < 2:
        return languages, None
    each = max(1, documents // len(languages))
    rates = known.sparkSession.createDataFrame([(name, min(1.0, 1.5 * each / n), least) for name, (n, least) in counts.items()], "lang string, _rate double, _least long")
    # half as many again as wanted of each language, about, and one of each for certain
    drawn = distinct.join(F.broadcast(rates), "lang").where((F.pmod("_h", F.lit(1 << 30)) < F.col("_rate") * (1 << 30)) | (F.col("_h") == F.col("_least")))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("_h", F.lit(1 << 30)), "_h"))
    chosen = drawn.withColumn("_n", nth).where(F.col("_n") <= each).select("lang", "_h")
    # ``documents`` rows at most, or one a language
    return languages, hashed.join(F.broadcast(cut(chosen, "op10-chosen")), ["lang", "_h"]).groupBy("lang", "_h").agg(F.first("text").alias("text")).select("text", "lang")


def fit(docs: DataFrame, documents: int = DOCUMENTS, pieces: int = WINDOWS, read: int = READ) -> Model:
    """Learn from at most ``documents`` different texts with a language outside the held-out fold, as many of each language."""
    known = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null").where(~held_out(F.col("doc_id"))).select("text", "lang")
    languages, rows = sample_texts(known, documents)
    if rows is None:
        return Model(languages, None)
    some = rows.mapInArrow(lambda batches: _sample(batches, pieces, read), "pieces array<binary>, lang string")
    got = some.select(F.explode("pieces").alias("piece"), "lang").toPandas().sort_values(["lang", "piece"], ignore_index=True)
    if not len(got):
        return Model(languages, None)
    y = got["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy()
    return Model(languages, train([bytes(p) for p in got["piece"]], y, len(languages)))


def identify(docs: DataFrame, model: Model, lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its pooled probability; all other columns stay as they are."""
    docs = docs.drop(lang_pred, score)
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.withColumns({lang_pred: F.lit(""), score: F.lit(0.0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols, names = batch.columns[:-1], batch.schema.names[:-1]
            p = held.value.probabilities(batch.column(batch.schema.get_field_index("text")))
            has = batch.column(len(cols)).to_numpy(zero_copy_only=False)
            best = p.argmax(1)
            choice = np.array([*held.value.languages, UNDETERMINED], object)
            none = ~has.astype(bool) | (not held.value.languages)
            said = choice[np.where(none, len(choice) - 1, best)]
            found = np.where(none, 0.0, p[np.arange(len(p)), best])
            yield pa.RecordBatch.from_arrays([*cols, pa.array(said, pa.string()), pa.array(np.clip(found, 0, 1))], [*names, lang_pred, score])
        give_back()

    return docs.withColumn(fresh(docs, "_has_letter"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).mapInArrow(run, schema)


def documents_report(docs: DataFrame) -> DataFrame:
    rows = identify(docs.select("doc_id", "text"), fit(docs))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
