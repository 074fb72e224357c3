"""What the pipeline does with repeated and missing ids, and what its rows say of the mix."""

from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline as pipeline  # noqa: E402
from terracause.llm import mixing  # noqa: E402
from terracause.llm.queries import MIX_BLOCK, MIX_UNITS, table  # noqa: E402
from tests.llm.fixtures import frame, prose  # noqa: E402


def test_one_row_of_each_group_stays(spark, sf_dir):
    x, y, z, w = (prose(500 + i, 60) for i in range(4))
    rows = [(5, x), (7, x), (5, y), (2, y), (None, z), (None, z), (None, w), (9, w), (3, "one two"), (3, "one two"), (3, "three"), (None, ""), (None, ""), (4, ""), (4, ""), (4, " ")]
    docs = frame(spark, [(i, t, "en", "src0", len(t)) for i, t in rows])
    got = pipeline.keep_one_of_each(spark, docs, sf_dir)
    assert got.columns == docs.columns
    want = [(5, x), (2, y), (None, z), (9, w), (3, "one two"), (3, "three"), (None, ""), (None, ""), (4, ""), (4, " ")]
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(want)


def test_rows_of_a_run_carry_the_mix(spark, sf_dir):
    got = pipeline.run(spark, sf_dir).collect()
    source = {r.doc_id: r for r in table(spark, sf_dir, "documents").select("doc_id", "source").collect()}
    docs = spark.createDataFrame([(r.doc_id, source[r.doc_id].source) for r in got], "doc_id long, source string")
    want = {r.doc_id: (r.position, r.slot, r.on_target) for r in mixing.mix(docs, MIX_UNITS, MIX_BLOCK).collect()}
    assert got and {r.doc_id: (r.position, r.slot, r.on_target) for r in got} == want
    assert len({r.position for r in got}) == len(got)
    slots = {}
    for r in got:
        slots.setdefault(r.slot, set()).add(source[r.doc_id].source)
    assert all(len(s) == 1 for s in slots.values())
    assert all(r.n_tokens is not None and r.ids_sha256 for r in got)
