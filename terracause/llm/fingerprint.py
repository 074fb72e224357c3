"""Operator 1: document fingerprints by one-permutation MinHash.

Every shingle hash is binned once (its top bits name the bin, the rest is its value
there). A bin that got nothing takes the value of the bin that a fixed sequence of
universal hashes finds first (optimal densification). Of each bin only the lowest
``BITS`` bits are stored, packed; the share of equal bins is corrected for the
2**-BITS chance that two different values agree in those bits.

Defined cases: a null or wordless text has the empty fingerprint; two empty ones are
alike 1.0, an empty and another one 0.0. Equal texts have equal fingerprints. Repeated
rows and ids each give their own row; rows of one id are ordered by a hash of their text,
and null ids come last. Extra columns are ignored by ``documents_report``; ``fingerprint``
replaces a column with the name of its output. A very long text is one row of a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terracause.llm.shared import cut
from terracause.llm.textvec import U64, mix64, text_shingles

BINS = 256
BITS = 4
WORDS = 5
_TOP = 8  # log2(BINS)
_EMPTY = U64(0xFFFFFFFFFFFFFFFF)
_ATTEMPTS = 64
_SALT = mix64(np.arange(BINS, dtype=U64) + U64(101))


def _donors(bins: int, attempts: int = _ATTEMPTS) -> np.ndarray:
    """donors[t, i]: the bin that empty bin i tries at attempt t; the last attempts walk on through all bins."""
    i = np.arange(bins, dtype=U64)
    t = np.arange(attempts, dtype=U64)[:, None]
    return (mix64(i * U64(0x9E3779B97F4A7C15) + mix64(t + U64(7))) % U64(bins)).astype(np.int64)


_DONORS = _donors(BINS)


def densify(values: np.ndarray) -> np.ndarray:
    """Fill the empty bins of each row (rows without any value stay empty)."""
    full = values != _EMPTY
    out = values.copy()
    todo = ~full & full.any(axis=1)[:, None]
    for step in range(len(_DONORS) + values.shape[1]):
        rows, cols = np.nonzero(todo)
        if not len(rows):
            break
        donor = _DONORS[step][cols] if step < len(_DONORS) else (cols + step) % values.shape[1]
        ok = full[rows, donor]
        out[rows[ok], cols[ok]] = values[rows[ok], donor[ok]]
        todo[rows[ok], cols[ok]] = False
    return out


def fingerprints(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Low bits per bin (rows x BINS, uint8) and which rows have any word."""
    low = np.zeros((len(column), BINS), np.uint8)
    some = np.zeros(len(column), bool)
    for a, b, rows, hashes in text_shingles(column, WORDS):
        for c in range(a, b, 2048):
            d = min(c + 2048, b)
            lo, hi = np.searchsorted(rows, (c - a, d - a))
            values = np.full((d - c) * BINS, _EMPTY, U64)
            place = (rows[lo:hi] - (c - a)) * BINS + (hashes[lo:hi] >> U64(64 - _TOP)).astype(np.int64)
            np.minimum.at(values, place, hashes[lo:hi] << U64(_TOP))
            values = values.reshape(-1, BINS)
            some[c:d] = (values != _EMPTY).any(axis=1)
            # the bin goes into the stored bits, else texts of few shingles would agree by chance in all bins at once
            low[c:d] = (mix64(densify(values) + _SALT) & U64((1 << BITS) - 1)).astype(np.uint8)
    low[~some] = 0
    return low, some


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Bias-corrected estimate of the Jaccard similarity of rows of fingerprints."""
    chance = 2.0**-BITS
    share = (a[0] == b[0]).mean(axis=1)
    out = np.clip((share - chance) / (1 - chance), 0.0, 1.0)
    return np.where(a[1] & b[1], out, (a[1] == b[1]).astype(float))


def packed(low: np.ndarray, some: np.ndarray) -> list[str]:
    """Two bins a byte, as hexadecimal text; empty for a text without words."""
    both = (low[:, 0::2] << 4) | low[:, 1::2]
    return [row.tobytes().hex() if has else "" for row, has in zip(both, some, strict=True)]


def unpacked(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    low = np.zeros((len(texts), BINS), np.uint8)
    for i, t in enumerate(texts):
        if t:
            b = np.frombuffer(bytes.fromhex(t), np.uint8)
            low[i, 0::2], low[i, 1::2] = b >> 4, b & 15
    return low, np.array([bool(t) for t in texts])


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``df`` with a fingerprint column; any other columns stay as they are."""
    if out == text:
        raise ValueError(f"{out} is the column of the texts")
    df = df.drop(out)
    schema = df.withColumn(out, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array(packed(*fingerprints(b.column(b.schema.get_field_index(text)))), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, found], [*b.schema.names, out])

    return df.mapInArrow(run, schema)


_REPORT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_PASS = _REPORT.replace("fingerprint string", "fingerprint binary").replace("edited_fingerprint string", "edited_fingerprint binary") + ", edge int, first_text string, last_text string"


def _compare(ids: list, texts: list[str], following: list[str], own=None, after=None) -> list[pa.Array]:
    """Report columns for texts that are each followed by another."""
    edited = [t[: len(t) - len(t) // 2] + nxt[: len(t) // 2] for t, nxt in zip(texts, following, strict=True)]
    own = own or fingerprints(pa.array(texts, pa.string()))
    after = after or fingerprints(pa.array(following, pa.string()))
    changed = fingerprints(pa.array(edited, pa.string()))
    raw = lambda f: pa.array([bytes.fromhex(x) for x in packed(*f)], pa.binary())
    return [
        pa.array(ids, pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
        raw(own),
        raw(changed),
        pa.array(likeness(own, changed), pa.float64()),
        pa.array(likeness(own, after), pa.float64()),
    ]


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edge", "first_text", "last_text"]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range of ids in order: each is compared with the next; the last one waits in an edge row."""
    from pyspark import TaskContext

    first = held = None
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        size, start = 0, 0
        for end in range(1, len(texts) + 1):
            size += len(texts[end - 1])
            if size < (4 << 20) and end < len(texts):
                continue
            some_ids, some = ids[start:end], texts[start:end]
            start, size = end, 0
            if first is None:
                first = some[0]
            if held:
                some_ids, some = [held[0], *some_ids], [held[1], *some]
            held = (some_ids[-1], some[-1])
            if len(some) > 1:
                low, has = fingerprints(pa.array(some, pa.string()))
                cols = _compare(some_ids[:-1], some[:-1], some[1:], (low[:-1], has[:-1]), (low[1:], has[1:]))
                n = len(some) - 1
                yield pa.RecordBatch.from_arrays([*cols, pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], _NAMES)
    if held:
        none = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), *none, pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([first]), pa.array([held[1]])], _NAMES)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays(_compare(*(c.to_pylist() for c in b.columns)), _NAMES[:7])


def documents_report(docs: DataFrame) -> DataFrame:
    """Fingerprint of each text and of its edited form, and their likenesses.

    The edited form replaces the last floor(n/2) code points by the first as many of the
    next document in descending doc_id (after the last: the first). One range shuffle of the
    texts puts neighbours beside each other; an id on very many rows is spread over ranges by
    a number of the rows. The texts at the ends of each range meet by the number of the range.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumns({"_h": F.xxhash64("text"), "_i": F.monotonically_increasing_id()})
    order = [F.col("doc_id").desc_nulls_last(), F.col("_h"), F.col("_i")]
    first = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(_walk, _PASS), "op1")
    ends = first.where("edge is not null")
    # one number a range that has rows
    numbers = ends.select("edge")
    after = numbers.select("edge", F.lead("edge").over(Window.orderBy("edge")).alias("_next")).crossJoin(F.broadcast(numbers.agg(F.min("edge").alias("_least"))))
    pairs = ends.select("edge", "doc_id", F.col("last_text").alias("text")).join(after.select("edge", F.coalesce("_next", "_least").alias("next")), "edge").join(ends.select(F.col("edge").alias("next"), F.col("first_text").alias("following")), "next")
    names = _NAMES[:7]
    rest = pairs.select("doc_id", "text", "following").mapInArrow(_edges, _PASS.split(", edge")[0])
    both = first.where("edge is null").select(*names).unionByName(rest)
    hexed = lambda c: F.lower(F.hex(c)).alias(c)
    return both.select("doc_id", "n_chars", "edited_sha256", hexed("fingerprint"), hexed("edited_fingerprint"), "near_edited", "near_next")
