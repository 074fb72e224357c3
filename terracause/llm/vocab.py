"""Tokenizer files: read once on the driver, built once in each Python worker."""

from __future__ import annotations

import hashlib
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from terracause.llm.textvec import WHITE, buffers

_BUILT: dict[str, object] = {}


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def built(text: str):
    """The tokenizer of a JSON text, without truncation or padding."""
    key = hashlib.md5(text.encode()).hexdigest()
    if key not in _BUILT:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _BUILT.clear()
        _KNOWN.clear()
        _LENGTHS.clear()
        _BUILT[key] = tokenizer = Tokenizer.from_str(text)
        tokenizer.no_truncation()
        tokenizer.no_padding()
    return _BUILT[key]


def encode_each(tokenizer, pieces: list[str], step: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces on end, and how many each piece has."""
    counts, ids = [], []
    for i in range(0, len(pieces), step):
        got = [e.ids for e in tokenizer.encode_batch_fast(pieces[i : i + step], add_special_tokens=False)]
        counts.append(np.fromiter(map(len, got), np.int64, len(got)))
        ids.append(np.fromiter(chain.from_iterable(got), np.uint32, int(counts[-1].sum())))
    if not counts:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.concatenate(ids), np.concatenate(counts)


def text_array(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Consecutive spans of ``data`` that end at ``ends``, as an Arrow string column."""
    offsets = np.zeros(len(ends) + 1, np.int64)
    offsets[1:] = ends
    return pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Cut texts before single blanks and line feeds where a byte-level pre-tokenizer always cuts.

    Such a place follows a byte that surely ends a character other than white space: a
    visible ASCII byte, or the second byte of a two-byte character from U+00C0 on. The
    chunks of a text, encoded one by one, give the ids of the whole text.
    """
    size = len(data)
    if not size:
        return text_array(data, np.zeros(0, np.int64)), np.zeros(len(offsets), np.int64)
    one = (data > 0x20) & (data < 0x7F)
    lead = (data >= 0xC3) & (data <= 0xDF)
    safe = one.copy()
    safe[1:] |= lead[:-1] & (data[1:] >= 0x80)
    start = np.zeros(size + 1, bool)
    start[1:size] = ((data[1:] == 0x20) | (data[1:] == 0x0A)) & safe[:-1]
    start[offsets] = True
    start[size] = False
    at = np.flatnonzero(start)
    return text_array(data, np.append(at[1:], size)), np.searchsorted(at, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Runs of bytes other than ASCII white space, and for each row the index of its first run."""
    from terracause.llm.textvec import word_spans

    starts, ends, first = word_spans(data, offsets)
    return text_array(data[~WHITE[data]], np.cumsum(ends - starts)), first


def _lengths(tokenizer) -> np.ndarray:
    """Bytes of text that each id stands for; pieces of a byte-level vocabulary have a character a byte."""
    if id(tokenizer) not in _LENGTHS:
        _LENGTHS.clear()
        out = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), np.int64)
        for piece, i in tokenizer.get_vocab(with_added_tokens=True).items():
            out[i] = len(piece)
        for i, token in tokenizer.get_added_tokens_decoder().items():
            out[i] = len(token.content.encode())
        _LENGTHS[id(tokenizer)] = out
    return _LENGTHS[id(tokenizer)]


def encode_chunks(tokenizer, pieces: pa.Array, step: int = 2_000) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all ``chunks`` on end, and how many each has.

    Chunks that begin with white space and end with a visible character are cut from each
    other by the pre-tokenizer in any order, so they are encoded ``step`` at a time as one
    text; the bytes that the ids stand for tell which chunk each belongs to.
    """
    data, at = buffers(pieces)
    counts, ids = np.zeros(len(pieces), np.int64), []
    if not len(pieces):
        return np.zeros(0, np.uint32), counts
    last = data[at[1:] - 1]
    head = data[at[:-1]]
    before = data[np.maximum(at[1:] - 2, 0)]
    joins = ((head == 0x20) | (head == 0x0A)) & (at[1:] - at[:-1] > 1) & (((last > 0x20) & (last < 0x7F)) | ((last >= 0x80) & (before >= 0xC3) & (before <= 0xDF)))
    alone = np.flatnonzero(~joins)
    got, counts[alone] = encode_each(tokenizer, pieces.take(pa.array(alone)).to_pylist())
    together = np.flatnonzero(joins)
    data, at = buffers(pieces.take(pa.array(together)))
    whole, lengths = [], _lengths(tokenizer)
    texts = [data[at[i] : at[min(i + step, len(together))]].tobytes().decode() for i in range(0, len(together), step)]
    for i in range(0, len(texts), 16):
        whole += [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(texts[i : i + 16], add_special_tokens=False)]
    whole = np.concatenate(whole) if whole else np.zeros(0, np.uint32)
    stops = np.searchsorted(np.cumsum(lengths[whole]), at[1:], side="left") + 1
    counts[together] = np.diff(stops, prepend=0)
    # back in the order of the chunks
    out = np.empty(int(counts.sum()), np.uint32)
    mine = np.repeat(joins, counts)
    out[mine], out[~mine] = whole, got
    return out, counts


class Known:
    """Ids of the chunks that this worker has met before, ``most`` of them at most, so that few are encoded again."""

    def __init__(self, most: int = 800_000):
        self.most, self.chunks = most, pa.array([], pa.large_string())
        self.ids, self.begin, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, tokenizer, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of old and new chunks on end, and for each of the distinct ``chunks`` where its ids begin and how many there are."""
        at = pc.index_in(chunks, value_set=self.chunks)
        new = pc.is_null(at)
        ids, counts = encode_chunks(tokenizer, chunks.filter(new))
        fresh, place = new.to_numpy(zero_copy_only=False), np.empty(len(chunks), np.int64)
        place[fresh] = len(self.chunks) + np.arange(len(counts))
        place[~fresh] = at.drop_null().to_numpy()
        begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(counts) - counts])
        counts = np.concatenate([self.counts, counts])
        ids = np.concatenate([self.ids, ids])
        self._keep(pa.chunked_array([self.chunks, chunks.filter(new)]), place, ids, begin, counts)
        return ids, begin[place], counts[place]

    def _keep(self, chunks: pa.ChunkedArray, now: np.ndarray, ids: np.ndarray, begin: np.ndarray, counts: np.ndarray) -> None:
        """Those of this call, then older ones, as far as the bound goes."""
        order = np.ones(len(chunks), bool)
        order[now] = False
        kept = np.concatenate([now, np.flatnonzero(order)])[: self.most]
        self.chunks, self.counts = chunks.take(pa.array(kept)).combine_chunks(), counts[kept]
        ends = np.cumsum(self.counts)
        self.ids = ids[np.repeat(begin[kept] - (ends - self.counts), self.counts) + np.arange(ends[-1] if len(ends) else 0)]
        self.begin = ends - self.counts


_KNOWN: dict[int, Known] = {}
_LENGTHS: dict[int, np.ndarray] = {}


def whole_text_ids(tokenizer, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts on end and the count of each text; equal chunks are encoded once."""
    data, offsets = buffers(column)
    pieces, first = chunks(data, offsets)
    coded = pieces.dictionary_encode()
    if id(tokenizer) not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[id(tokenizer)] = Known()
    ids, begin, counts = _KNOWN[id(tokenizer)].encode(tokenizer, coded.dictionary)
    use = coded.indices.to_numpy(zero_copy_only=False)
    each = counts[use]
    total = np.zeros(len(use) + 1, np.int64)
    np.cumsum(each, out=total[1:])
    kind = np.int32 if max(total[-1], len(ids)) < 1 << 31 else np.int64  # the largest arrays here
    source = np.repeat((begin[use] - total[:-1]).astype(kind), each)
    source += np.arange(total[-1], dtype=kind)
    return ids[source], np.diff(total[first])
