"""Operator 2: token ids in fixed-width bit-packed files.

A file is a run of segments, each ended by one line feed byte. A segment holds, little
endian: the magic ``TKB1``; int32 bits, shard, segment, docs, ids per block, blocks;
int64 ids; int64 doc_id and uint8 has-id and uint32 token count of each document; int64
byte offset of each block in the packed part (one more than blocks); the packed blocks.
Each id takes the fewest bits that hold the vocabulary's largest id; a block holds a fixed
number of ids and begins at a whole byte, so a range of ids is found by its block offsets
and unpacked by a few numpy passes. Spark's text writer puts the segments into files,
``FILE_SEGMENTS`` in each, so any store that Spark writes to will do.

Defined cases: a null text counts as the empty text (its one id is the end id); a null
doc_id comes first in the order and stays null; rows of one id are ordered by a hash of
their text; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terracause.llm.shared import cut, give_back, new_path
from terracause.llm.textvec import buffers, slices
from terracause.llm.vocab import built, whole_text_ids

MAGIC = b"TKB1"
_HEAD = struct.Struct("<4s6iq")
BLOCK_IDS = 8192
SEGMENT_BYTES = 16 << 20
FILE_SEGMENTS = 8


def bits_for(vocabulary: int) -> int:
    """Fewest bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flags = np.unpackbits(np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(flags[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(packed: bytes | memoryview, bits: int, count: int) -> np.ndarray:
    raw = np.frombuffer(packed, np.uint8)
    if bits in (8, 16, 32):
        return raw[: count * bits // 8].view(f"<u{bits // 8}").astype(np.uint32)
    raw = np.concatenate([raw, np.zeros(5, np.uint8)])
    at = np.arange(count, dtype=np.int64) * bits
    byte = at >> 3
    value = np.zeros(count, np.uint64)
    for j in range(5):
        value |= raw[byte + j].astype(np.uint64) << np.uint64(8 * j)
    return ((value >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def segment(ids: np.ndarray, counts: np.ndarray, doc_ids: list, bits: int, shard: int, number: int) -> bytes:
    blocks = [pack(ids[i : i + BLOCK_IDS], bits) for i in range(0, len(ids), BLOCK_IDS)]
    offsets = np.zeros(len(blocks) + 1, "<i8")
    np.cumsum([len(b) for b in blocks], out=offsets[1:])
    has = np.array([d is not None for d in doc_ids], np.uint8)
    names = np.array([d or 0 for d in doc_ids], "<i8")
    head = _HEAD.pack(MAGIC, bits, shard, number, len(doc_ids), BLOCK_IDS, len(blocks), len(ids))
    return b"".join([head, names.tobytes(), has.tobytes(), counts.astype("<u4").tobytes(), offsets.tobytes(), *blocks])


class Segment:
    """A view of one segment in a file's bytes."""

    def __init__(self, raw: memoryview, at: int):
        magic, self.bits, self.shard, self.number, docs, self.block_ids, blocks, self.n_ids = _HEAD.unpack_from(raw, at)
        if magic != MAGIC:
            raise ValueError(f"no segment at byte {at}")
        take = lambda kind, n, p: (np.frombuffer(raw, kind, n, p), p + n * np.dtype(kind).itemsize)
        self.doc_ids, p = take("<i8", docs, at + _HEAD.size)
        self.has_id, p = take(np.uint8, docs, p)
        self.counts, p = take("<u4", docs, p)
        self.offsets, self.begin = take("<i8", blocks + 1, p)
        self.end = self.begin + int(self.offsets[-1])
        self._raw = raw

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start … stop-1; only the blocks that hold them are touched."""
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = start // self.block_ids, (stop - 1) // self.block_ids
        got = []
        for k in range(a, b + 1):
            n = min(self.block_ids, self.n_ids - k * self.block_ids)
            got.append(unpack(self._raw[self.begin + int(self.offsets[k]) : self.begin + int(self.offsets[k + 1])], self.bits, n))
        return np.concatenate(got)[start - a * self.block_ids : stop - a * self.block_ids]


def segments(raw: bytes) -> Iterator[Segment]:
    view, at = memoryview(raw), 0
    while at < len(view):
        found = Segment(view, at)
        yield found
        at = found.end + 1


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, vocabulary: int) -> None:
    """Encode every whole text, append ``end_id`` and write files in ascending doc_id order."""
    bits = bits_for(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, number, tok = TaskContext.get().partitionId(), 0, built(tokenizer)
        for batch in batches:
            names, column = batch.column(0).to_pylist(), batch.column(1)
            for a, b in slices(buffers(column)[1], SEGMENT_BYTES):
                ids, counts = whole_text_ids(tok, column.slice(a, b - a))
                ends = np.cumsum(counts + 1) - 1
                full = np.full(len(ids) + len(counts), end_id, np.uint32)
                keep = np.ones(len(full), bool)
                keep[ends] = False
                full[keep] = ids
                yield pa.RecordBatch.from_arrays([pa.array([segment(full, counts + 1, names[a:b], bits, shard, number)], pa.binary())], ["segment"])
                number += 1
                del ids, full, keep
                give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumns({"_h": F.xxhash64("text"), "_i": F.monotonically_increasing_id()})
    # an id on very many rows is spread over ranges by a number of the rows
    order = [F.col("doc_id").asc_nulls_first(), F.col("_h"), F.col("_i")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    ordered.mapInArrow(run, "segment binary").select(F.col("segment").cast("string").alias("value")).write.option("compression", "none").option("maxRecordsPerFile", FILE_SEGMENTS).text(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row a document: shard and segment, doc_id, start within its segment, n_tokens, ids_crc32 and, if asked for, ids."""
    schema = "shard int, segment int, doc_id long, local_start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                for seg in segments(raw.as_buffer()):
                    ids, n = seg.ids(), len(seg.counts)
                    ends = np.cumsum(seg.counts.astype(np.int64))
                    begins = ends - seg.counts
                    plain = memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(plain[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                    cols = [pa.array(np.full(n, x, np.int32)) for x in (seg.shard, seg.number)]
                    cols += [pa.array(seg.doc_ids, pa.int64(), mask=seg.has_id == 0), pa.array(begins), pa.array(seg.counts.astype(np.int64)), pa.array(crc, pa.int64())]
                    if with_ids:
                        cols.append(pa.ListArray.from_arrays(pa.array(np.append(begins, ends[-1:]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(cols, names)
        give_back()

    names = ["shard", "segment", "doc_id", "local_start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    return _files(spark, path).mapInArrow(run, schema)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def documents_report(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int, path: str | None = None) -> DataFrame:
    """Write the token files, read them back, and give each document's place, length and checksum."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_token_files(docs, path, tokenizer, end_id, vocabulary)
    rows = cut(read_token_files(spark, path), "op2")
    sizes = rows.groupBy("shard", "segment").agg(F.sum("n_tokens").alias("_n"))
    # one row a writing task, then one a segment of it
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = sizes.groupBy("shard").agg(F.sum("_n").alias("_n")).select("shard", before(Window.orderBy("shard")).alias("_shard"))
    bases = sizes.select("shard", "segment", before(Window.partitionBy("shard").orderBy("segment")).alias("_segment")).join(shards, "shard")
    return rows.join(bases, ["shard", "segment"]).select("doc_id", (F.col("_shard") + F.col("_segment") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
