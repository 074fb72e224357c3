"""Every stage of the pipeline against a plain Python version on its own input."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline as pipeline  # noqa: E402
from terracause.llm import language, mixing, quality  # noqa: E402
from terracause.llm.queries import MIX_BLOCK, MIX_UNITS, table  # noqa: E402
from terracause.llm.shared import cut  # noqa: E402
from tests.llm.fixtures import SCHEMA, frame  # noqa: E402
from tests.llm.test_similarity import groups  # noqa: E402


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_stages_one_by_one(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    inputs = []
    for _, stage in pipeline.STAGES:
        inputs.append(docs)
        docs = cut(stage(spark, docs, sf_dir), "stage")
    assert all(d.columns == columns for d in inputs)
    first, second, third, fourth, fifth = map(rows, inputs)

    model = quality.fit(inputs[0], table(spark, sf_dir, "labels"))
    keep = [bool(model.scores(pa.array([r[1] or ""]))[0] >= pipeline.QUALITY_THRESHOLD) for r in first]
    assert sorted(r[0] for r, k in zip(first, keep, strict=True) if k) == sorted(r[0] for r in second) and len(second) < len(first)
    bad = {r.doc_id for r in table(spark, sf_dir, "labels").where("quality = 0").collect()}
    assert len(bad & {r[0] for r in second}) <= 0.25 * len(bad)  # 64 labelled rows to learn from

    model = language.fit(inputs[1])
    p = model.probabilities(pa.array([r[1] for r in second]))
    said = [any(c.isalpha() for c in r[1] or "") and p[i].max() >= pipeline.LANGUAGE_THRESHOLD for i, r in enumerate(second)]
    assert sorted(r[0] for r, k in zip(second, said, strict=True) if k) == sorted(r[0] for r in third)

    assert sorted(i for i, _, c in groups(third) if i == c) == sorted(r[0] for r in fourth)

    key = lambda r: (int(hashlib.md5(str(r[0]).encode()).hexdigest()[:8], 16), r[0])
    units = {s: MIX_UNITS.get(s, 1) for s in sorted({r[3] for r in fourth})}
    period, slots = sum(units.values()), {(n, i): slot for n, i, slot in mixing.pattern(units)}
    want = []
    for s, u in units.items():
        for nth, r in enumerate(sorted((r for r in fourth if r[3] == s), key=key)):
            block = nth // MIX_BLOCK
            want.append(((block // u * period + slots[s, block % u]) * MIX_BLOCK + nth % MIX_BLOCK, r[0]))
    assert [r[0] for r in fifth] == [i for _, i in sorted(want)]

    from tokenizers import Tokenizer

    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r[0]: tok.encode(r[1], add_special_tokens=False).ids for r in fifth}
    got = {r.doc_id: r for r in docs.collect()}
    assert {i: (len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()) for i, x in ids.items()} == {i: (r.n_tokens, r.ids_sha256) for i, r in got.items()}


def test_awkward_documents_pass_every_stage(spark, sf_dir):
    for given in (frame(spark), spark.createDataFrame([], SCHEMA)):
        docs = cut(given, "awkward")
        for _, stage in pipeline.STAGES:
            docs = cut(stage(spark, docs, sf_dir), "awkward")
        docs.collect()


def test_repeated_ids_are_one_document(spark, sf_dir):
    kept = pipeline.keep_one_of_each(spark, frame(spark), sf_dir).where("doc_id = 1011")
    assert kept.count() == 1
