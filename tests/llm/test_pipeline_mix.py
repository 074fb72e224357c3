"""The places that the mixing stage gives are those of the encoded rows, also where ids are missing or repeated."""

import hashlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline as pipeline  # noqa: E402
from terracause.llm import mixing  # noqa: E402
from terracause.llm.queries import MIX_BLOCK, MIX_UNITS  # noqa: E402
from terracause.llm.shared import cut  # noqa: E402
from tests.llm.fixtures import SCHEMA, prose  # noqa: E402


@pytest.mark.parametrize("crowded", [False, True])
def test_encoded_rows_stand_where_the_mix_put_them(spark, monkeypatch, crowded):
    if crowded:  # ranges of hashes with over 16 rows are hot
        monkeypatch.setattr(mixing, "GROUP_ROWS", 2)
    from tokenizers import Tokenizer

    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [None] * 60 + [7] * 60 + list(range(100, 130))
    rows = [(i, prose(900 + n, 8), "en", [f"src{n % 3}", None][n % 10 == 9], n) for n, i in enumerate(ids)]
    sha = {r[4]: hashlib.sha256(np.array(tok.encode(r[1], add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for r in rows}
    assert len(set(sha.values())) == len(rows)
    got = []
    for given, parts in ((rows, 1), (rows[::-1], 5)):
        docs = spark.createDataFrame(given, SCHEMA).repartition(parts)
        mixed = cut(pipeline.mix_sources(spark, docs, None), "mixed")
        out = {r.ids_sha256: r for r in pipeline.encode(spark, mixed, None).collect()}
        assert len(out) == len(rows)
        # the whole decision of the mix, row by row
        placed = mixing.mix(docs, MIX_UNITS, MIX_BLOCK).collect()
        assert {sha[r.n_chars]: (r.doc_id, r.source, *[r[n] for n in mixing.NAMES]) for r in placed} == {k: (r.doc_id, r.source, *[r[n] for n in mixing.NAMES]) for k, r in out.items()}
        # and the order in which the stage wrote its rows
        assert [sha[r.n_chars] for r in mixed.collect()] == sorted(out, key=lambda k: out[k].position)
        got.append({k: r.position for k, r in out.items()})
    assert got[0] == got[1]
