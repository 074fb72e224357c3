"""Operator 7: exact Jaccard join on 5-word shingles by a grouped prefix join.

1. Each document becomes the set of 64-bit hashes of its distinct shingles; results are
   exact but for shingles with equal hashes. Equal sets are one set from here on (its key
   is a hash of the set).
2. Shingles meet by hash. One that stands in a single set can't be part of any overlap,
   so only shared shingles go on, with the number of sets that hold them. A set with
   fewer than 75 % of its shingles shared has no partner and leaves.
3. Shingles are ordered by that number, rarest first. Two linked sets share one of the
   first n - ceil(0.75 n) + 1 shingles of each: the prefixes.
4. Sets with one size, one number of shared shingles and one prefix are one group. Groups that share a prefix shingle and
   whose sizes and shared shingles allow a link are candidates; they are expanded to members and verified on
   the whole sets.

A shingle that a large group of near copies shares would make all pairs of them. As the
result is who is connected to whom, a pair need be verified only while its sets are in
different components: rounds compare the groups of each shingle with one pivot, which
connects most of them; then every pair of groups that still spans components, and whose
sizes are near enough, is expanded. No link between components is left out. What is
left in the worst case is many groups of one size that share their rarest shared shingles
and aren't linked: their pairs are compared.

Defined cases: a null or wordless text has the empty set and is linked with nothing;
texts of under five words have one shingle, all their words; equal texts are linked; a
null doc_id keeps its row, and counts for no component's smallest id; extra columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracause.llm.components import components, join_spread
from terracause.llm.shared import cut, drop, give_back, partitions
from terracause.llm.textvec import U64, mix64, text_shingles

WORDS = 5
PERCENT = 75
#: Pivot rounds end early once all pairs of groups left would be under this many times the postings.
ALL_PAIRS = 1
MOST_ROUNDS = 12
#: They also end when a round leaves more than this share of the pairs of the round before.
SLOW = 0.8
#: Bytes of text for each part of the shingles at least.
PART_BYTES = 8 << 20


def _sets(column: pa.Array, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows: distinct hashes of each row on end, sizes, and set keys."""
    for a, b, rows, hashes in text_shingles(column, words):
        first = np.searchsorted(rows, np.arange(b - a + 1))
        distinct = [np.unique(hashes[first[i] : first[i + 1]]) for i in range(b - a)]
        n = np.array([len(d) for d in distinct], np.int64)
        flat = np.concatenate(distinct)
        sums = np.zeros(len(flat) + 1, U64)
        np.cumsum(mix64(flat), out=sums[1:])
        ends = np.cumsum(n)
        keys = mix64(sums[ends] - sums[ends - n] + n.astype(U64) * U64(0x9E3779B97F4A7C15))
        yield a, b, flat, n, keys


#: A slice of texts numbers its sets; with their numbers go their 64-bit keys, so that copies of a set in other slices are known.
SEVERAL = 0xFFFFFFFF
#: Kinds of rows behind the shuffle: a shingle of one set of a slice or of several (then without an owner), the owners of the latter, documents.
POSTING, OWNERS, DOCUMENT = 0, 1, 2
_BLOBS = "part int, slice long, kind int, data binary"
_ROWS = "kind int, slice long, owner long, set_key long, doc_id long, n_shingles long, data binary"
_NAMES = [x.split()[0] for x in _ROWS.split(", ")]


def _names(owner: np.ndarray, several: np.ndarray, keys: np.ndarray) -> bytes:
    """Owners as places in a list of the sets named here, each with its key; the last place of the width stands for several."""
    used, place = np.unique(owner[~several], return_inverse=True)
    width = "<u2" if len(used) < 0xFFFF else "<u4"
    at = np.full(len(owner), np.iinfo(width).max, width)
    at[~several] = place.ravel()
    return np.array([len(used)], "<i8").tobytes() + at.tobytes() + used.astype("<u4").tobytes() + keys[used].tobytes()


def _postings(words: int, parts: int):
    """Each slice of texts sends every distinct shingle once to its part; owners of those in several sets, and documents, pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, b, flat, n, keys in _sets(batch.column(1), words):
                distinct, once, owner = np.unique(keys, return_index=True, return_inverse=True)
                owner = owner.ravel().astype("<u4")
                keep = np.zeros(len(keys), bool)
                keep[once] = True
                keep &= n > 0
                tokens, holder = flat[np.repeat(keep, n)], np.repeat(owner[keep], n[keep])
                order = np.argsort(tokens, kind="stable")
                tokens, holder = tokens[order], holder[order]
                first = np.flatnonzero(np.diff(tokens, prepend=~tokens[:1]))
                counts = np.diff(first, append=len(tokens))
                several = counts > 1
                token = tokens[first]
                part = (token % U64(parts)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                bounds = np.searchsorted(part[order], np.arange(parts + 1))
                filled = np.flatnonzero(np.diff(bounds))
                blobs = []
                for p in filled:
                    some = order[bounds[p] : bounds[p + 1]]
                    blobs.append(np.array([len(some)], "<i8").tobytes() + _steps(token[some] // U64(parts)) + _names(holder[first[some]], several[some], distinct) + counts[some][several[some]].astype("<u4").tobytes())
                held = np.repeat(several, counts)
                owners = np.array([several.sum()], "<i8").tobytes() + token[several].tobytes() + zstandard.compress(counts[several].astype("<u4").tobytes() + holder[held].tobytes(), 1)
                ids = batch.column(0).slice(a, b - a)
                documents = b"".join(
                    [np.array([b - a], "<i8").tobytes(), ids.fill_null(0).to_numpy().astype("<i8").tobytes(), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(), n.astype("<i8").tobytes(), keys.tobytes(), owner.tobytes()]
                )
                k, by = len(filled), (place * 0x9E3779B97F4A7C15 >> 20) % parts
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([*filled.tolist(), by, by], pa.int32()),
                        pa.array([place] * (k + 2), pa.int64()),
                        pa.array([POSTING] * k + [OWNERS, DOCUMENT], pa.int32()),
                        pa.array([*blobs, owners, documents], pa.binary()),
                    ],
                    ["part", "slice", "kind", "data"],
                )
                place += 1
        give_back()

    return run


#: A step that takes more than six bytes.
_LARGE = (1 << 48) - 1


def _steps(rising: np.ndarray) -> bytes:
    """Rising numbers as the steps between them: six bytes each, larger ones apart."""
    step = np.diff(rising, prepend=U64(0))
    large = step >= U64(_LARGE)
    return np.where(large, U64(_LARGE), step).view(np.uint8).reshape(-1, 8)[:, :6].tobytes() + step[large].tobytes()


class _Reader:
    def __init__(self, raw: memoryview):
        self.raw, self.at = raw, 0

    def take(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self.raw, kind, n, self.at)
        self.at += out.nbytes
        return out

    def names(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Owner and set key of each entry; owner ``SEVERAL``, key 0 where there are several."""
        k = int(self.take("<i8", 1)[0])
        at = self.take("<u2" if k < 0xFFFF else "<u4", n)
        several = at == np.iinfo(at.dtype).max
        used, keys = np.append(self.take("<u4", k), np.uint32(SEVERAL)), np.append(self.take("<u8", k), U64(0))
        at = np.where(several, k, at)
        return used[at], keys[at]

    def rest(self) -> _Reader:
        return _Reader(memoryview(zstandard.decompress(self.raw[self.at :])))

    def steps(self, n: int) -> np.ndarray:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :6] = self.take(np.uint8, 6 * n).reshape(-1, 6)
        step = wide.view(U64).ravel()
        large = step == U64(_LARGE)
        step[large] = self.take("<u8", int(large.sum()))
        return np.cumsum(step, dtype=U64)


def _shared(parts: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """Shingles of one part that two sets or more hold, with their number of sets; the other rows as they came."""
        give_back()
        out, tokens, places, owners, keys_, counts, slices_ = [_rows(0)], [], [], [], [], [], []
        part = key[0].as_py()
        for kind, place, raw in zip(table["kind"].to_pylist(), table["slice"].to_pylist(), table["data"], strict=True):
            r = _Reader(memoryview(raw.as_buffer()))
            n = int(r.take("<i8", 1)[0])
            if kind == OWNERS:
                out.append(_rows(1, kind=OWNERS, slice=place, data=pa.array([raw.as_py()], pa.binary())))
            elif kind == POSTING:
                tokens.append(r.steps(n))
                owner, whose = r.names(n)
                owners.append(owner)
                keys_.append(whose)
                many = np.ones(n, np.int32)
                many[owner == SEVERAL] = r.take("<u4", int((owner == SEVERAL).sum()))
                counts.append(many)
                places.append(np.full(n, len(slices_), np.int32))
                slices_.append(place)
            else:
                ids, has = r.take("<i8", n), r.take(np.uint8, n)
                sizes, keys, whose = r.take("<i8", n), r.take("<i8", n), r.take("<u4", n)
                out.append(_rows(n, kind=DOCUMENT, slice=place, owner=whose, set_key=keys, doc_id=pa.array(ids, mask=has == 0), n_shingles=sizes))
        if tokens:
            # numbered as the slices are, so that the first copy of a set stands in the first of its slices
            rise = np.empty(len(slices_), np.int32)
            rise[np.argsort(slices_)] = np.arange(len(slices_))
            token, owner, whose, many, place = np.concatenate(tokens), np.concatenate(owners), np.concatenate(keys_), np.concatenate(counts), rise[np.concatenate(places)]
            tokens, owners, keys_, counts, places = [], [], [], [], []
            order = np.argsort(token, kind="stable")
            token = token[order]
            first = np.flatnonzero(np.diff(token, prepend=~token[:1]))
            often = np.repeat(np.diff(first, append=len(token)) > 1, np.diff(first, append=len(token))) | (owner[order] == SEVERAL)
            token, order = token[often], order[often]
            again = np.lexsort((place[order], whose[order], token))
            token, order = token[again], order[again]
            owner, whose, many, place = owner[order], whose[order], many[order].astype(np.int64), place[order]
            # copies of a set in several slices count once: by all of its key
            new = (np.diff(token, prepend=~token[:1]) != 0) | (np.diff(whose, prepend=~whose[:1]) != 0) | (owner == SEVERAL) | np.append(True, owner[:-1] == SEVERAL)
            token, owner, many, place = token[new], owner[new], many[new], place[new]
            first = np.flatnonzero(np.diff(token, prepend=~token[:1]))
            times = np.repeat(np.add.reduceat(many, first), np.diff(first, append=len(token))) if len(first) else many
            some = times > 1
            owner = owner[some]
            full, times, place = token[some] * U64(parts) + U64(part), np.minimum(times[some], (1 << 31) - 1), place[some]
            order = np.argsort(place, kind="stable")
            bounds = np.append(np.flatnonzero(np.diff(place[order], prepend=-1)), len(order))
            names = np.sort(slices_)
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                mine = order[lo:hi]
                blob = np.array([hi - lo], "<i8").tobytes() + full[mine].tobytes() + zstandard.compress(owner[mine].astype("<u4").tobytes() + times[mine].astype("<u4").tobytes(), 1)
                out.append(_rows(1, kind=POSTING, slice=int(names[place[mine[0]]]), data=pa.array([blob], pa.binary())))
        return pa.concat_tables(out)

    return run


def _rows(n: int, **given) -> pa.Table:
    """Columns of ``_ROWS``; a number stands for all rows, and what isn't given is null."""
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    cols = []
    for name, kind in (x.split() for x in _ROWS.split(", ")):
        v = given.get(name)
        v = pa.nulls(n, types[kind]) if v is None else pa.array(np.full(n, v, np.int64)) if isinstance(v, int) else v if isinstance(v, pa.Array) else pa.array(v)
        cols.append(v.cast(types[kind]))
    return pa.Table.from_arrays(cols, _NAMES)


def shingle_table(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Documents with their set keys, and the shingles that several sets hold: one reading of the texts, one shuffle.

    Parts grow with the table, so that the shingles of one part fit in a task; a shingle has
    one entry a slice of texts there, however many documents hold it.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(partitions(spark), size // PART_BYTES)
    sent = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_postings(words, parts), _BLOBS)
    return cut(sent.groupBy("part").applyInArrow(_shared(parts), _ROWS), "op7-shingles")


def _assemble(blobs: pa.Table, chosen: pa.Table) -> pa.Table:
    """One slice: the shared shingles, rarest first, of each of the sets that it stands for."""
    give_back()
    tokens, owners, times, several = [], [], [], None
    for kind, raw in zip(blobs["kind"].to_pylist(), blobs["data"], strict=True):
        r = _Reader(memoryview(raw.as_buffer()))
        n = int(r.take("<i8", 1)[0])
        if kind == OWNERS:
            token = r.take("<u8", n)
            r = r.rest()
            many = r.take("<u4", n)
            several = token, many, r.take("<u4", int(many.sum()))
        else:
            tokens.append(r.take("<u8", n))
            r = r.rest()
            owners.append(r.take("<u4", n))
            times.append(r.take("<u4", n))
    token, owner, time = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((tokens, "<u8"), (owners, "<u4"), (times, "<u4")))
    if several is not None and len(several[0]):
        mark = np.flatnonzero(owner == SEVERAL)
        mark = mark[np.argsort(token[mark])]
        found = time[mark][np.searchsorted(token[mark], several[0])]
        one = owner != SEVERAL
        token, owner, time = np.concatenate([token[one], np.repeat(several[0], several[1])]), np.concatenate([owner[one], several[2]]), np.concatenate([time[one], np.repeat(found, several[1])])
    chosen = chosen.sort_by("owner")
    names = chosen["owner"].to_numpy()
    place = np.searchsorted(names, owner)
    mine = (place < len(names)) & (names[np.minimum(place, len(names) - 1)] == owner) if len(names) else np.zeros(len(owner), bool)
    token, place, time = token[mine], place[mine], time[mine]
    order = np.lexsort((token.view(np.int64), time, place))
    offsets = np.searchsorted(place[order], np.arange(len(names) + 1)).astype(np.int32)
    return pa.table({"set_key": chosen["set_key"], "n": chosen["n"], "tokens": pa.ListArray.from_arrays(pa.array(offsets), pa.array(token[order].view(np.int64)))})


def candidate_sets(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """set_key, n, tokens (shared shingles, rarest first), prefix length and share of lone shingles of the sets that can have a partner."""
    blobs = rows.where(F.col("kind") != DOCUMENT).select("slice", "kind", "data")
    # equal sets of several slices are one set, which the first of these stands for
    own = rows.where((F.col("kind") == DOCUMENT) & (F.col("n_shingles") > 0)).groupBy("set_key").agg(F.min(F.struct("slice", "owner")).alias("p"), F.first("n_shingles").alias("n"))
    chosen = own.select("p.slice", "p.owner", "set_key", "n")
    sets = blobs.groupBy("slice").cogroup(chosen.groupBy("slice")).applyInArrow(_assemble, "set_key long, n long, tokens array<long>").where(100 * F.size("tokens") >= percent * F.col("n"))
    # of n shingles, a partner shares ceil(percent n / 100) at least; lone ones come first in the order
    need = F.ceil(percent * F.col("n") / 100)
    kept = sets.select("set_key", "n", "tokens", (F.size("tokens") - need + 1).cast("int").alias("prefix"), (1 - F.size("tokens") / F.col("n")).alias("lone"))
    return cut(kept, "op7-sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) of set keys those that are linked."""
    side = lambda x: sets.select(F.col("set_key").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"t_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("common", F.size(F.array_intersect("t_a", "t_b")))
    return both.where(100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")


def _fits(n: str, shared: str, m: str, others: str, percent: int) -> Column:
    """Whether two sets of sizes n and m with so many shared shingles can be linked: J >= p/100 needs an overlap of p (n + m) / (100 + p)."""
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * F.least(shared, others) >= percent * (F.col(n) + F.col(m)))


def linked_components(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """set_key and comp of the candidate sets."""
    head = F.slice("tokens", 1, F.col("prefix"))
    named = sets.select("set_key", "n", "lone", F.size("tokens").alias("shared"), head.alias("head"), F.xxhash64("n", F.size("tokens"), head).alias("group"))
    # a group's members share size and prefix; one of them stands for it
    first = named.groupBy("group").agg(F.min("set_key").alias("rep"))
    member = cut(named.join(first, "group"), "op7-members")
    # the first shingle that two sets share leaves them what stands behind it: at a place in the order, ``shared`` is the rest
    every = member.where("set_key = rep").select("set_key", "group", "n", "lone", "shared", F.posexplode("head").alias("place", "token")).withColumn("shared", F.col("shared") - F.col("place")).drop("place")
    # a set whose shared shingles don't suffice even for the smallest one beside it goes from that shingle
    every = cut(every, "op7-every")
    least = every.groupBy("token").agg(F.min("n").alias("_n"), F.count("*").alias("_k")).where("_k > 1")
    posting = cut(join_spread(every, least, "token").where((100 + percent) * F.col("shared") >= percent * (F.col("n") + F.col("_n"))).drop("_n", "_k"), "op7-postings")
    drop(every)
    labels = member.select("set_key", F.col("set_key").alias("comp"))
    known = posting.withColumns({"low": F.col("set_key"), "high": F.col("set_key")})
    count, work = posting.count(), None
    for number in range(MOST_ROUNDS):
        # the set with the smallest share of lone shingles is the nearest to the rest; later rounds draw
        rank = F.col("lone") if number == 0 else F.xxhash64("set_key", F.lit(number)).cast("double")
        pivot = known.groupBy("token").agg(F.min(F.struct(rank.alias("_"), F.col("set_key").alias("a"), F.col("n").alias("n_a"), F.col("shared").alias("s_a"), F.col("low").alias("comp_a"))).alias("p"), F.min("low").alias("least"), F.max("high").alias("most"))
        pivot = pivot.where("least <> most").select("token", "p.a", "p.n_a", "p.s_a", "p.comp_a")
        pairs = join_spread(known, pivot, "token").where((F.col("low") != F.col("comp_a")) & _fits("n", "shared", "n_a", "s_a", percent)).select("a", F.col("set_key").alias("b")).distinct()
        if number == 0:
            pairs = pairs.unionByName(member.where("set_key <> rep").select(F.col("rep").alias("a"), F.col("set_key").alias("b")))
        labels = _joined(labels, verified(pairs, sets, percent))
        if number:
            drop(known)
        known = _known(posting, member, labels)
        spans = cut(_spanning(known), "op7-spans")
        before, work = work, spans.agg(F.sum(F.col("few") * F.col("all"))).first()[0] or 0
        if work <= ALL_PAIRS * count or (before is not None and work > SLOW * before):
            break
    # sets that can be linked are within a quarter of each other's size: their bands of sizes are one apart at most
    band = F.floor(F.log("n") / F.log(F.lit(100 / percent))).cast("int")
    side = lambda x: known.select("token", band.alias("band"), F.col("group").alias(f"g{x}"), F.col("n").alias(f"n{x}"), F.col("shared").alias(f"s{x}"), F.col("low").alias(f"low{x}"), F.col("high").alias(f"high{x}"))
    few = side("1").join(spans.select("token", "mode"), "token").where("low1 <> mode or high1 <> mode").withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    spanning = (F.least("low1", "low2") != F.greatest("high1", "high2")) & _fits("n1", "s1", "n2", "s2", percent)
    groups = few.join(side("2"), ["token", "band"]).where(spanning & (F.col("g1") != F.col("g2"))).select(F.least("g1", "g2").alias("g1"), F.greatest("g1", "g2").alias("g2")).distinct()
    of = member.select("group", "set_key").join(labels, "set_key")
    inside = of.groupBy("group").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select(F.col("group").alias("g1"), F.col("group").alias("g2"))
    groups = cut(groups.unionByName(inside), "op7-groups")
    drop(known)
    drop(posting)
    if groups.isEmpty():
        return labels
    end = lambda x, y: of.select(F.col("group").alias(f"g{x}"), F.col("set_key").alias(y), F.col("comp").alias(f"c{x}"))
    pairs = groups.join(end("1", "a"), "g1").join(end("2", "b"), "g2").where("c1 <> c2").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return _joined(labels, verified(pairs, sets, percent))


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after the components that the links connect are one."""
    ends = cut(links, "op7-links")
    of = lambda x: labels.select(F.col("set_key").alias(x), F.col("comp").alias(f"c{x}"))
    over = components(ends.join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    moved = join_spread(labels, over.select(F.col("node").alias("comp"), F.col("comp").alias("root")), "comp")
    return cut(moved.select("set_key", F.coalesce("root", "comp").alias("comp")), "op7-labels")


def _known(posting: DataFrame, member: DataFrame, labels: DataFrame) -> DataFrame:
    """Postings of groups with the smallest and largest component among a group's members."""
    of = member.select("group", "set_key").join(labels, "set_key").groupBy("group").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    return cut(posting.join(of, "group"), "op7-known")


def _spanning(known: DataFrame) -> DataFrame:
    """Shingles whose groups are in several components: the commonest, how many groups aren't in it, and all."""
    # the commonest component by two sums, so that no task holds a shingle's whole list
    per = known.groupBy("token", "low").agg(F.count("*").alias("k"), F.sum((F.col("low") != F.col("high")).cast("int")).alias("split"))
    best = per.groupBy("token").agg(F.max_by("low", F.struct("k", "low")).alias("mode"), F.max("k").alias("most"), F.sum("k").alias("all"), F.sum("split").alias("split"))
    few = F.col("all") - F.col("most") + F.col("split")
    return best.select("token", "mode", few.alias("few"), "all").where("few > 0")


def near_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every document."""
    table = shingle_table(docs, words)
    rows = cut(table.where(F.col("kind") == DOCUMENT).select("doc_id", "n_shingles", "set_key"), "op7-documents")
    sets = candidate_sets(table, percent)
    # what no later job reads leaves the shared folder: the shingles are the largest of these tables
    drop(table)
    labels = linked_components(sets, percent)
    drop(sets)
    whole = rows.where("n_shingles > 0").join(labels, "set_key", "left").select("doc_id", "n_shingles", F.coalesce("comp", "set_key").alias("comp"))
    whole = cut(whole, "op7-whole")
    found = join_spread(whole, whole.groupBy("comp").agg(F.min("doc_id").alias("component_id")), "comp").select("doc_id", "n_shingles", "component_id")
    return found.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
