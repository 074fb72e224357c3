"""Pooled vectors and byte labels against plain loops."""

import numpy as np
import pyarrow as pa

from terracause.llm import language, quality


def test_pooled_vectors(monkeypatch):
    monkeypatch.setattr(quality, "TOKENS", 7)
    texts = ["Aa bb aa! 12 bb", "", "x y", "\n", None, "one Two THREE four!! five six seven eight nine ten"]
    hashes = np.concatenate([p[2] for p in quality._passes(pa.array(["bb aa one six ten"]))])
    known = np.sort(hashes)
    vectors = np.random.default_rng(0).normal(0, 1, (len(known) + quality.SHAPES, quality.DIMS)).astype(np.float32)
    got = quality.pool(pa.array(texts), known, vectors)
    for i, t in enumerate(texts):
        if not t:
            assert not got[i].any()
            continue
        ((_, _, h, shape, _),) = quality._passes(pa.array([t]))
        v = vectors[quality.token_ids(h, shape, known)]
        n = len(v)
        want = [sum(v, np.zeros(quality.DIMS)) / (n + quality.SHRINK)]
        for step in (1, 2):
            want.append(sum((v[j] * v[j - step] for j in range(step, n)), np.zeros(quality.DIMS)) / (max(n - step, 0) + quality.SHRINK_PAIRS))
        assert np.allclose(np.concatenate(want), got[i], atol=1e-4)


def test_probabilities_of_whole_texts(monkeypatch):
    monkeypatch.setattr(language, "CORE", 11)
    monkeypatch.setattr(language, "CONTEXT", 5)
    monkeypatch.setattr(language, "ROWS", 3)
    w = language.start_weights(3, seed=1)
    texts = ["short", "", "ein längerer Text mit Ümläuten und Blanks, über mehrere Fenster", None, "çççççççççççç"]
    got = language.Model(["a", "b", "c"], w).probabilities(pa.array(texts))
    squash = lambda x: x / (1 + np.abs(x))

    def walk(way, codes):
        h, out, u = np.zeros(language.UNITS), [], language.UNITS
        for c in codes:
            x, r = w["embed"][c] @ w[f"{way}_in"] + w[f"{way}_bias"], h @ w[f"{way}_rec"]
            z, reset = (0.5 + 0.5 * squash(x[a : a + u] + r[a : a + u]) for a in (0, u))
            new = squash(x[2 * u :] + reset * r[2 * u :])
            h = new + z * (h - new)
            out.append(h)
        return out

    for i, t in enumerate(texts):
        raw = (t or "").encode()
        row, left, right, first, last = language.windows(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert b"".join(raw[a:b] for a, b in zip(first, last)) == raw
        for a, b in zip([*left, *first], [*right, *last]):
            raw[a:b].decode()  # no character is cut
        total = np.zeros(3)
        for a, b, c, d in zip(left, right, first, last):
            f, back = walk("f", raw[a:b]), walk("b", raw[a:b][::-1])[::-1]
            for p in range(c - a, d - a):
                e = np.exp(np.concatenate([f[p], back[p]]) @ w["out"] + w["bias"])
                total += e / e.sum()
        assert np.allclose(total / max(len(raw), 1), got[i], atol=1e-4)


def test_rows_of_uneven_lengths_step_alike():
    w, rng = language.start_weights(3, seed=2), np.random.default_rng(4)
    size = np.array([9, 9, 7, 4, 4, 1])
    data, left = rng.integers(0, 256, size.sum()).astype(np.uint8), np.cumsum(size) - size
    got = language.label(w, data, left, left + size)
    assert got.shape == (9, 3, 6)
    for i, (a, n) in enumerate(zip(left, size)):
        states = []
        for way in "fb":
            h, table, rec, of = np.zeros((language.UNITS, 1), np.float32), language.inputs(w, way), w[f"{way}_rec"].T, []
            for c in data[a : a + n] if way == "f" else data[a : a + n][::-1]:
                h = language.step(table[:, [c]], h, rec)[0]
                of.append(h)
            states.append(np.hstack(of if way == "f" else of[::-1]))
        want = language.softmax(w["out"].T @ np.vstack(states) + w["bias"][:, None])
        assert np.allclose(got[:n, :, i].T, want, atol=1e-6)
