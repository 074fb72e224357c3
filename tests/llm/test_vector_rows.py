import numpy as np
import pytest

from terracause.llm import vectortree


def brute(rows, k=20):
    """Each asking row's nearest other rows by position, as a sorted list of (query_id, rank, vec_id, score)."""
    out = []
    for i, (q, x) in enumerate(rows):
        if q % 20 == 0:
            near = sorted((-float(np.dot(x, y)), v) for j, (v, y) in enumerate(rows) if j != i)[:k]
            out += [(q, n + 1, v, -s) for n, (s, v) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["float", "double", "int"])
def test_numeric_kinds_and_shared_ids(spark, kind):
    """Components of any numeric type; rows that share an id are each other's candidates, also where both ask."""
    rng = np.random.default_rng(4)
    x = rng.integers(-9, 10, (60, 6)).astype(float) if kind != "double" else rng.normal(size=(60, 6))
    x[:, 0] = 10
    ids = [i if i < 55 else 20 for i in range(60)]
    rows = [(i, [int(c) if kind == "int" else float(c) for c in v]) for i, v in zip(ids, x, strict=True)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    got = sorted(tuple(r) for r in vectortree.nearest(df).select("query_id", "rank", "vec_id", "score").collect())
    want = brute(rows)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    np.testing.assert_allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)
    assert sum(g[0] == 20 and g[1] == 1 for g in got) == 6
