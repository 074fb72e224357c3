"""Operator 3: BPE encoding and decoding through a distinct-word table.

1. Each block of texts is split into words (runs of bytes other than ASCII white space);
   its distinct words are numbered by word part and by frequency in the part, and every
   position holds such a number.
2. The distinct words of all blocks meet by a hash of the word; there each distinct word
   is encoded once, whichever block it came from.
3. The ids go back to the blocks and are joined by position; the pieces of ids give the
   decoded text (id-to-piece join against the vocabulary, whose size is fixed).

What is moved is packed: one blob for a block and word part. A very common word is one
entry in each block, so no key gathers more than one row a block.

Defined cases: a null text counts as empty (no ids, empty decoded text); a null doc_id
stays null; repeated rows each give a row; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracause.llm.shared import cut, give_back, partitions
from terracause.llm.textvec import U64, buffers, slices, span_hashes
from terracause.llm.vocab import built, encode_each, text_array, words

BLOCK_BYTES = 32 << 20
#: Words of a block that are written out together.
POSITIONS = 1 << 18
#: Bytes of text for each word part at least, so that the words of a part fit in a task however long the table is.
PART_BYTES = 128 << 20
#: Effort of the compression of what is moved.
LEVEL = 9


def squeeze(a: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    wide = np.ascontiguousarray(a)
    return zstandard.compress(wide.view(np.uint8).reshape(-1, wide.itemsize).T.tobytes(), LEVEL)


def squeeze_codes(codes: np.ndarray) -> list[bytes]:
    """Small numbers as one byte each; larger ones leave 255 there and go into a stream of their own."""
    large = codes >= 255
    return [squeeze(np.where(large, 255, codes).astype(np.uint8)), squeeze(codes[large])]


def expand_codes(raw: list[bytes]) -> np.ndarray:
    codes = expand(raw[0], np.uint8).astype(np.uint32)
    codes[codes == 255] = expand(raw[1], np.uint32)
    return codes


def expand(raw: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _coded(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the word at each position as a place among them, and how many words each row has.

    Read a few MB at a time, so that a large block needs little memory.
    """
    seen, counts = [], []
    for a, b in slices(buffers(column)[1]):
        data, offsets = buffers(column.slice(a, b - a))
        found, first = words(data, offsets)
        seen.append(found.dictionary_encode())
        counts.append(np.diff(first))
    one = pa.chunked_array(seen).unify_dictionaries()
    return one.chunk(0).dictionary, np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in one.chunks]), np.concatenate(counts)


def _split(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b in slices(buffers(batch.column(1))[1], BLOCK_BYTES):
                block = f"{task}-{number}"
                number += 1
                dictionary, use, counts = _coded(batch.column(1).slice(a, b - a))
                n = len(dictionary)
                raw, at = buffers(dictionary)
                part = (span_hashes(raw, at[:-1], at[1:]) % U64(parts)).astype(np.int64)
                order = np.lexsort((-np.bincount(use, minlength=n), part))
                bounds = np.searchsorted(part[order], np.arange(parts + 1))
                code = np.empty(n, np.uint32)
                code[order] = (np.arange(n) - bounds[part[order]]) * parts + part[order]
                filled = np.flatnonzero(np.diff(bounds))
                blobs = []
                grouped = dictionary.take(pa.array(order))
                for p in filled:
                    raw, at = buffers(grouped.slice(bounds[p], bounds[p + 1] - bounds[p]))
                    blobs.append(zstandard.compress(np.diff(at).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() + raw.tobytes(), LEVEL))
                k = len(filled) + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block] * k),
                        pa.array([None, *filled.tolist()], pa.int32()),
                        pa.array([n, *np.diff(bounds)[filled].tolist()], pa.int64()),
                        pa.array([None, *blobs], pa.binary()),
                        pa.array([squeeze_codes(code[use]), *[None] * (k - 1)], pa.list_(pa.binary())),
                        pa.array([batch.column(0).slice(a, b - a).to_pylist(), *[None] * (k - 1)], pa.list_(pa.int64())),
                        pa.array([counts.tolist(), *[None] * (k - 1)], pa.list_(pa.int64())),
                    ],
                    ["block", "part", "n", "payload", "codes", "doc_ids", "counts"],
                )
                give_back()

    return run


_BLOCKS = "block string, part int, n long, payload binary, codes array<binary>, doc_ids array<long>, counts array<long>"


def _encode(tokenizer: str):
    def run(table: pa.Table) -> pa.Table:
        """Words of one part from all blocks: each distinct one is encoded once."""
        tok, coded = built(tokenizer), []
        for n, raw in zip(table["n"].to_pylist(), table["payload"], strict=True):
            plain = zstandard.decompress(raw.as_buffer())
            ends = np.cumsum(np.ascontiguousarray(np.frombuffer(plain, np.uint8, 4 * n).reshape(4, n).T).view("<u4").ravel().astype(np.int64))
            coded.append(text_array(np.frombuffer(plain, np.uint8, offset=4 * n), ends).dictionary_encode())
        one = pa.chunked_array(coded).unify_dictionaries()
        ids, counts = encode_each(tok, one.chunk(0).dictionary.to_pylist())
        begin = np.cumsum(counts) - counts
        out_counts, out_ids = [], []
        for chunk in one.chunks:
            some = chunk.indices.to_numpy(zero_copy_only=False)
            out_counts.append(squeeze(counts[some].astype(np.uint32)))
            out_ids.append(squeeze(ids[spread(begin[some], counts[some])]))
        give_back()
        return pa.table({"block": table["block"], "part": table["part"], "counts": pa.array(out_counts, pa.binary()), "ids": pa.array(out_ids, pa.binary())})

    return run


def spread(begin: np.ndarray, each: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, … as many as each[0], then the same for the next, on end."""
    stop = np.cumsum(each)
    total = int(stop[-1]) if len(stop) else 0
    kind = np.int32 if max(total, int((begin + each).max(initial=0))) < 1 << 31 else np.int64
    out = np.repeat((begin - (stop - each)).astype(kind), each)
    out += np.arange(total, dtype=kind)
    return out


def _join(tokenizer: str, parts: int, digests: bool):
    def run(docs: pa.Table, coded: pa.Table) -> pa.Table:
        """One block: ids by position, pieces by id; about ``POSITIONS`` words at a time."""
        tok = built(tokenizer)
        codes = expand_codes(docs["codes"][0].as_py())
        begin, counts, ids, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        for part, each, raw in zip(coded["part"].to_pylist(), coded["counts"], coded["ids"], strict=True):
            each = expand(each.as_buffer(), np.uint32).astype(np.int64)
            size = (len(each) - 1) * parts + part + 1 if len(each) else 0
            if size > len(counts):
                begin, counts = np.pad(begin, (0, size - len(begin))), np.pad(counts, (0, size - len(counts)))
            stop = np.cumsum(each) + held
            begin[part:size:parts], counts[part:size:parts] = stop - each, each
            ids.append(expand(raw.as_buffer(), np.uint32))
            held += len(ids[-1])
        ids = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        # every piece with the blank that joins it to the next
        pieces = [(tok.id_to_token(i) or "").encode() + b" " for i in range(tok.get_vocab_size(with_added_tokens=True))]
        letters, lengths = np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces], np.int64)
        starts = np.cumsum(lengths) - lengths
        many, stop = np.array(docs["counts"][0].as_py(), np.int64), 0
        sizes, out_ids, out_text = [], [], []
        for a, b in slices(np.append(0, np.cumsum(many)), POSITIONS):
            some = codes[stop : (stop := stop + int(many[a:b].sum()))]
            each = counts[some]
            found = ids[spread(begin[some], each)]
            text = letters[spread(starts[found], lengths[found])].tobytes()
            raw = found.astype("<u4").tobytes()
            before = np.append(0, np.cumsum(each))[np.append(0, np.cumsum(many[a:b]))]
            place = np.append(0, np.cumsum(lengths[found]))[before].tolist()
            before = before.tolist()
            for i in range(b - a):
                one, said = raw[4 * before[i] : 4 * before[i + 1]], text[place[i] : max(place[i], place[i + 1] - 1)]
                sizes.append(before[i + 1] - before[i])
                out_ids.append(sha256(one).hexdigest() if digests else one)
                out_text.append(sha256(said).hexdigest() if digests else said)
        ids_column = pa.array(out_ids, pa.string() if digests else pa.binary())
        text_column = pa.array(out_text, pa.string() if digests else pa.binary()).cast(pa.string())
        out = pa.table({"doc_id": docs["doc_ids"].combine_chunks().flatten(), "n_tokens": pa.array(sizes, pa.int64()), "ids": ids_column, "decoded": text_column})
        del codes, ids, begin, counts, out_ids, out_text
        give_back()
        return out

    return run


def encode_decode(docs: DataFrame, tokenizer: str, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the decoded text of each whole text.

    With ``digests`` both are given as SHA-256 digests, so that they never leave the task.
    For tokenizers whose pre-tokenizer drops white space and cuts there, and whose file
    names no decoder (pieces are then joined by blanks).
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(2 * partitions(spark), size // PART_BYTES)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    blocks = cut(rows.mapInArrow(_split(parts), _BLOCKS), "op3")
    table = blocks.where("part is not null").select("block", "part", "n", "payload")
    coded = table.groupBy("part").applyInArrow(_encode(tokenizer), "block string, part int, counts binary, ids binary")
    held = blocks.where("part is null").select("block", "codes", "doc_ids", "counts")
    return held.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(_join(tokenizer, parts, digests), f"doc_id long, n_tokens long, ids {'string' if digests else 'binary'}, decoded string")


def documents_report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Length and digests of each document's ids and decoded text."""
    both = encode_decode(docs, tokenizer, digests=True)
    return both.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))
