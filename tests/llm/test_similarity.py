import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from terracause.llm import fingerprint, ngramjoin
from terracause.llm.textvec import text_shingles
from tests.llm.fixtures import documents, frame, prose

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def groups(rows):
    """Brute force: every pair."""
    sets = [shingles(r[1]) for r in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), least.get(root(i))) for i, r in enumerate(rows)), key=str)


def test_shingle_counts_match_python():
    texts = [d[1] or "" for d in documents()]
    for a, b, rows, hashes in text_shingles(pa.array(texts), 5):
        for i in range(a, b):
            assert len(set(hashes[rows == i - a].tolist())) == len(shingles(texts[i]))


def test_join_matches_brute_force(spark):
    got = sorted(map(tuple, ngramjoin.near_groups(frame(spark, extra=True)).collect()), key=str)
    assert got == groups(documents())


def near_copies(n, words, edits, seed=0):
    rng = np.random.default_rng(seed)
    base = prose(seed + 500, words).split()
    rows = []
    for i in range(n):
        w = list(base)
        for at in rng.integers(0, words, rng.integers(0, edits + 1)):
            w[at] = f"e{rng.integers(1e9)}"
        rows.append((i * 3 % n, " ".join(w), None, None, None))
    return rows


@pytest.mark.parametrize("edits", [2, 5, 9])
def test_large_group_of_near_copies(spark, edits, monkeypatch):
    rows = near_copies(120, 150, edits, edits)
    got = sorted(map(tuple, ngramjoin.near_groups(frame(spark, rows)).collect()), key=str)
    assert got == groups(rows)
    monkeypatch.setattr(ngramjoin, "MOST_ROUNDS", 1)
    assert sorted(map(tuple, ngramjoin.near_groups(frame(spark, rows)).collect()), key=str) == got


def test_join_of_empty_and_unlinked_tables(spark):
    assert ngramjoin.near_groups(frame(spark, [])).count() == 0
    rows = [(i, prose(i, 30), None, None, None) for i in range(5)] + [(9, None, None, None, None)]
    assert sorted(map(tuple, ngramjoin.near_groups(frame(spark, rows)).collect()), key=str) == groups(rows)


def test_fingerprint_report(spark):
    rows = documents()
    got = {(r.doc_id, r.n_chars, r.edited_sha256): r for r in fingerprint.documents_report(frame(spark, extra=True)).collect()}
    order = sorted(rows, key=lambda d: (d[0] is None, -(d[0] or 0), d[1] or ""))
    errors = []
    for d, nxt in zip(order, [*order[1:], order[0]], strict=True):
        text, following = d[1] or "", nxt[1] or ""
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        r = got[d[0], len(text), hashlib.sha256(edited.encode()).hexdigest()]
        errors.append(abs(r.near_edited - jaccard(shingles(text), shingles(edited))))
        errors.append(abs(r.near_next - jaccard(shingles(text), shingles(following))))
        assert (r.fingerprint == "") == (not shingles(text))
    assert max(errors) < 0.3 and np.mean(errors) < 0.05
    same = [r for r in got.values() if r.doc_id in (1003, 1004, 1005)]
    assert len({r.fingerprint for r in same}) == 1


def test_fingerprint_of_one_and_no_document(spark):
    one = fingerprint.documents_report(frame(spark, [(5, "a b c d e f", None, None, None)])).first()
    assert (one.near_next, one.n_chars) == (1.0, 11)
    assert fingerprint.documents_report(frame(spark, [])).count() == 0
    clash = fingerprint.fingerprint(frame(spark), out="lang")
    assert sorted(clash.columns) == sorted(frame(spark).columns) and len(clash.first().lang or "") in (0, 256)
    with pytest.raises(ValueError):
        fingerprint.fingerprint(frame(spark), out="text")
    both = fingerprint.fingerprint(frame(spark)).where("doc_id in (1000, 1001)").collect()
    assert [r.fingerprint for r in both] == ["", ""]


def test_estimate_is_unbiased():
    base = prose(1, 700).split()
    words = list(base)
    for i in range(0, 700, 25):
        words[i] = f"new{i}"
    a, b = fingerprint.fingerprints(pa.array([" ".join(base)])), fingerprint.fingerprints(pa.array([" ".join(words)]))
    truth = jaccard(shingles(" ".join(base)), shingles(" ".join(words)))
    assert abs(float(fingerprint.likeness(a, b)[0]) - truth) < 0.1
    low, some = fingerprint.unpacked(fingerprint.packed(*a))
    assert (low == a[0]).all() and some.all()


def test_sets_whose_keys_agree_in_half_their_bits(spark):
    """Two near texts in two slices, whose set keys share the upper four bytes: neither is taken for a copy of the other."""
    base = prose(9000, 79).split()
    ends = [f"end{i}" for i in range(150_000)]
    keys = _keys(base, ends)
    upper = keys >> np.uint64(32)
    order = np.argsort(upper, kind="stable")
    twins = np.flatnonzero(np.diff(upper[order]) == 0)
    assert len(twins)
    for t in twins[:3]:
        pair = [" ".join([*base, ends[order[t + i]]]) for i in (0, 1)]
        rows = [(1, pair[0], None, None, 0), (2, pair[1], None, None, 0), (3, prose(9001, 90), None, None, 0)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartitionByRange(3, "doc_id")
        assert sorted(map(tuple, ngramjoin.near_groups(df).collect()), key=str) == groups(rows)


def _keys(base, ends):
    """Set keys of the texts that differ in their last word alone: all but one shingle are the same."""
    out = []
    for a in range(0, len(ends), 5_000):
        texts = pa.array([" ".join([*base, e]) for e in ends[a : a + 5_000]])
        out += [k for *_, k in ngramjoin._sets(texts, 5)]
    return np.concatenate(out)
