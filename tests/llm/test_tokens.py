import hashlib
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from terracause.llm import tokenfile, wordbpe  # noqa: E402
from terracause.llm.shared import new_path  # noqa: E402
from terracause.llm.vocab import read_tokenizer  # noqa: E402
from tests.llm.fixtures import documents, frame  # noqa: E402


@pytest.mark.parametrize("bits", [1, 5, 8, 11, 16, 17, 32])
def test_packing_round_trip(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 10_001, dtype=np.uint64).astype(np.uint32)
    assert (tokenfile.unpack(tokenfile.pack(ids, bits), bits, len(ids)) == ids).all()
    raw = tokenfile.segment(ids, np.array([4000, 0, 6001]), [5, None, 7], bits, 3, 0)
    seg = next(tokenfile.segments(raw + b"\n"))
    assert (seg.ids(8000, 8400) == ids[8000:8400]).all() and seg.counts.tolist() == [4000, 0, 6001]
    assert seg.has_id.tolist() == [1, 0, 1] and seg.shard == 3


def test_fewest_bits():
    assert [tokenfile.bits_for(n) for n in (1, 2, 3, 256, 257, 50_257)] == [1, 1, 2, 8, 9, 16]


@pytest.mark.parametrize("vocabulary", [50_257, 100_000])
def test_token_files_match_the_library(spark, vocabulary):
    path = P.path("byte_bpe_50k.json")
    got = tokenfile.documents_report(frame(spark, extra=True), read_tokenizer(path), 2, vocabulary).collect()
    tok, start = Tokenizer.from_file(path), 0
    want = []
    for doc_id, text in sorted(((d[0], d[1] or "") for d in documents()), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_ids_are_read_back(spark):
    path = new_path(spark, "tokens")
    tokenfile.write_token_files(frame(spark), path, read_tokenizer(P.path("byte_bpe_50k.json")), 2, 50_257)
    rows = tokenfile.read_token_files(spark, path, with_ids=True).collect()
    tok, texts = Tokenizer.from_file(P.path("byte_bpe_50k.json")), {d[0]: d[1] or "" for d in documents()}
    assert all(r.ids == [*tok.encode(texts[r.doc_id], add_special_tokens=False).ids, 2] for r in rows)


def test_word_table_matches_the_library(spark):
    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    want = []
    for d in documents():
        ids = tok.encode(d[1] or "", add_special_tokens=False).ids
        want.append((d[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = wordbpe.documents_report(frame(spark, extra=True), read_tokenizer(path)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    full = {r.doc_id: r for r in wordbpe.encode_decode(frame(spark), read_tokenizer(path)).collect()}
    assert full[1003].decoded == tok.decode(tok.encode("one two").ids, skip_special_tokens=False)
    assert np.frombuffer(full[1003].ids, "<u4").tolist() == tok.encode("one two").ids


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert tokenfile.documents_report(empty, read_tokenizer(P.path("byte_bpe_50k.json")), 2, 50_257).count() == 0
    assert wordbpe.documents_report(empty, read_tokenizer(P.path("word_bpe_49k.json"))).count() == 0
