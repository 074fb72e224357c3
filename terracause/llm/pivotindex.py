"""Operator 11: exact top-k search by inner product over a pivot-distance index.

Components become integers, floor(64 x); scores are integer inner products. Every vector
gets one more component that makes all norms equal, so the largest product is the smallest
distance, and triangle inequalities hold. A vector's key is its nearest pivot and its
distance from it; rings of distances around a pivot are annuli. Of each annulus the nearest
and farthest distance from every pivot are measured over all its rows: a query's distance
to a row is at least its distance from those, so an annulus has a greatest possible score.

A query visits annuli in falling order of that score, a few in the first round and
``WIDER`` times as many in each later one, and stops at the first that can't reach its
(k + 1)-th best score so far: nothing is left out. Ties count as reached.

Bounds: pivots and edges of rings come from about ``SAMPLE`` vectors (a rate by hash of the
row), at most ``PIVOTS`` pivots and ``ANNULI`` annuli; the driver holds these and two
distances for each pair of them. A task compares one block of an annulus (about
``BLOCK_ROWS`` rows) with one group of queries (about ``GROUP_ROWS``), so that neither a
crowded annulus nor many queries gather in a task. Of equal vectors the k + 1 rows with the
smallest ids are kept, which are all that can be found; equal queries are asked once.

Defined cases: vectors that are null or hold null or non-finite components take no part,
nor do rows without an id; shorter vectors are filled up with zeros (so an empty one scores 0);
components are kept within a bound at which all scores fit a long (3.8e8 for 64 of them); a row is no neighbour
of itself, but rows that share its id are, and each of them has ranks of its own; equal
scores are ordered by id; with fewer candidates than asked for all are returned; other
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terracause.llm.components import join_spread
from terracause.llm.shared import cut
from terracause.llm.vectortree import kmeans, matrix, widened

SCALE = 64
SAMPLE = 20_000
PIVOTS = 32
ANNULI = 1_024
#: Rows of an annulus, as long as there are fewer than ``ANNULI``.
ANNULUS_ROWS = 2_048
BLOCK_ROWS = 16_384
GROUP_ROWS = 16_384
#: Each round visits this many times the annuli of the one before.
WIDER = 4


def quantised(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and x, the integer components, of the rows that take part."""
    v = F.col(vector)
    good = df.where("vec_id is not null").where(v.isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda c: c.cast("double")).alias("x"))
    good = good.where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))))
    wide = good.agg(F.max(F.size("x"))).first()[0] or 0
    most = min((1 << 31) - 1, math.isqrt(((1 << 63) - 1) // max(wide, 1)))
    within = lambda c: F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(c * SCALE))).cast("int")
    return good.select("vec_id", F.concat(F.transform("x", within), F.array_repeat(F.lit(0), F.lit(wide) - F.size("x"))).alias("x"))


@dataclass
class Index:
    """Pivots, the edges of the rings of each, and over all rows of each annulus the nearest and farthest distance from each pivot."""

    square: float
    pivots: np.ndarray
    edges: np.ndarray
    annuli: np.ndarray | None = None
    near: np.ndarray | None = None
    far: np.ndarray | None = None
    blocks: np.ndarray | None = None

    def distances(self, wide: np.ndarray) -> np.ndarray:
        square = (wide * wide).sum(1)[:, None] - 2 * wide @ self.pivots.T + (self.pivots * self.pivots).sum(1)
        return np.sqrt(np.maximum(square, 0))

    def key(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The annulus of each row, and its distances from all pivots."""
        d = self.distances(widened(x, self.square))
        pivot = d.argmin(1)
        ring = (d[np.arange(len(d)), pivot][:, None] > self.edges[pivot]).sum(1)
        return (pivot * (self.edges.shape[1] + 1) + ring).astype(np.int32), d

    def reach(self, q: np.ndarray) -> np.ndarray:
        """The greatest score that each annulus can hold for each query (queries x annuli), a little too large rather than too small."""
        d = self.distances(np.concatenate([q, np.zeros((len(q), 1))], axis=1))
        norm = (q * q).sum(1)
        least = np.zeros((len(q), len(self.annuli)))
        for p in range(len(self.pivots)):
            least = np.maximum(least, np.maximum(self.near[:, p] - d[:, p, None], d[:, p, None] - self.far[:, p]))
        scale = self.square + norm[:, None] + 1
        least = np.maximum(least - 1e-7 * np.sqrt(scale), 0)
        return (self.square + norm[:, None] - least * least) / 2 + 1e-9 * scale


def plan(sample: np.ndarray, rows: int, square: float, annulus_rows: int = ANNULUS_ROWS) -> Index:
    """Pivots are centres of the sample; rings of a pivot hold about as many of its sample rows each."""
    annuli = min(ANNULI, max(1, math.ceil(rows / annulus_rows)))
    wide = widened(sample, square)
    pivots, nearest = kmeans(wide, min(PIVOTS, math.ceil(math.sqrt(annuli))), np.random.default_rng(7))
    rings = math.ceil(annuli / len(pivots))
    index = Index(square, pivots, np.zeros((len(pivots), 0)))
    d = index.distances(wide)
    index.edges = np.array([np.quantile(d[nearest == p, p], np.arange(1, rings) / rings) for p in range(len(pivots))]).reshape(len(pivots), rings - 1)
    return index


def scores(q: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products: by doubles where these hold all sums exactly."""
    return q @ x.T if exact else q.astype(np.int64) @ x.astype(np.int64).T


def best_of(q: np.ndarray, bounds: np.ndarray, x: np.ndarray, ids: np.ndarray, members: np.ndarray, k: int, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and score of the ``k`` best rows for each query that reach its bound."""
    s = scores(q, x, exact)
    limit = bounds
    if s.shape[1] > k:
        limit = np.maximum(bounds, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
    query, row = np.nonzero(s >= limit[:, None])
    score = s[query, row]
    order = np.lexsort((members[row], ids[row], -score, query))
    query, row, score = query[order], row[order], score[order]
    nth = np.arange(len(query)) - np.searchsorted(query, query)
    return query[nth < k], row[nth < k], score[nth < k].astype(np.int64)


def top_k(df: DataFrame, every: int = 20, k: int = 20, annulus_rows: int = ANNULUS_ROWS, block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` rows with the highest scores for each row whose id is divisible by ``every``."""
    spark = df.sparkSession
    rows = cut(quantised(df).select(F.monotonically_increasing_id().alias("member"), "vec_id", "x"), "op11-rows")
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    about = rows.agg(F.count("*").alias("n"), F.max(square).alias("square"), F.max(F.array_max(F.transform("x", F.abs))).alias("most"), F.max(F.size("x")).alias("wide")).first()
    none = "query_id long, rank int, vec_id long, score long"
    if not about.n:
        return spark.createDataFrame([], none)
    if not about.wide:
        rows, about = rows.withColumn("x", F.array(F.lit(0))), about.asDict() | {"wide": 1, "most": 0, "square": 0.0}
    else:
        about = about.asDict()
    exact = about["wide"] * about["most"] ** 2 < 1 << 53
    rate = F.lit(min(1 << 30, math.ceil((1 << 30) * SAMPLE / about["n"])))
    sample = rows.where(F.pmod(F.xxhash64("member"), F.lit(1 << 30)) < rate).select("x").toPandas()["x"]
    start = np.stack(sample.to_numpy()).astype(float) if len(sample) else np.zeros((1, about["wide"]))
    index = plan(start, about["n"], about["square"], annulus_rows)
    held = spark.sparkContext.broadcast(index)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(held.value.key(matrix(b.column(2)))[0]), *b.columns], ["annulus", "member", "vec_id", "x"])

    # of equal vectors no more than k + 1 can be among the best
    same = Window.partitionBy("x").orderBy("vec_id", "member")
    few = rows.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k + 1).select("member", "vec_id", "x")
    keyed = cut(few.mapInArrow(put, "annulus int, member long, vec_id long, x array<int>"), "op11-index")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                annulus, d = held.value.key(matrix(b.column(0)))
                order = np.argsort(annulus, kind="stable")
                first = np.flatnonzero(np.diff(annulus[order], prepend=-1))
                near, far = np.minimum.reduceat(d[order], first), np.maximum.reduceat(d[order], first)
                count = np.diff(first, append=len(order))
                p = d.shape[1]
                cols = [np.repeat(annulus[order][first], p), np.tile(np.arange(p, dtype=np.int32), len(first)), near.ravel(), far.ravel(), np.repeat(count, p)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["annulus", "pivot", "near", "far", "n"])

    # at most as many rows as annuli times pivots
    found = keyed.select("x").mapInArrow(spans, "annulus int, pivot int, near double, far double, n long").groupBy("annulus", "pivot").agg(F.min("near").alias("near"), F.max("far").alias("far"), F.sum("n").alias("n")).orderBy("annulus", "pivot").toPandas()
    p = len(index.pivots)
    index.annuli = found["annulus"].to_numpy()[::p]
    index.near, index.far = found["near"].to_numpy().reshape(-1, p), found["far"].to_numpy().reshape(-1, p)
    index.blocks = np.maximum(1, -(-found["n"].to_numpy()[::p] // block_rows))
    held = spark.sparkContext.broadcast(index)

    asked = rows.where(F.col("vec_id") % every == 0)
    askers = asked.groupBy("x").agg(F.min("member").alias("asker"))
    state = cut(askers.select("asker", "x", F.lit(float("-inf")).alias("bound")), "op11-asked")
    groups = max(1, math.ceil(state.count() / group_rows))
    number = F.create_map(*[F.lit(int(v)) for kv in zip(index.annuli, index.blocks, strict=True) for v in kv])[F.col("annulus")]
    # equal vectors share a block
    placed = keyed.withColumn("block", F.pmod(F.xxhash64("x"), number).cast("int")).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    keys = ["annulus", "block", "grp"]

    def ask(first: int, width: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = held.value
            for b in batches:
                for a in range(0, b.num_rows, 1024):
                    part = b.slice(a, 1024)
                    reach = index.reach(matrix(part.column(1)))
                    order = np.argsort(-reach, axis=1, kind="stable")[:, first : first + width]
                    wanted = np.take_along_axis(reach, order, 1) >= part.column(2).to_numpy()[:, None]
                    query, place = np.nonzero(wanted)
                    spot = order[query, place]
                    times = index.blocks[spot]
                    block = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    query = pa.array(np.repeat(query, times))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(index.annuli[spot], times).astype(np.int32)), pa.array(block.astype(np.int32)), *[c.take(query) for c in part.columns]], ["annulus", "block", "asker", "x", "bound"])

        return run

    def open_(seen: int):
        """Whether a query has annuli left that can reach its bound."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                more = np.zeros(b.num_rows, bool)
                for a in range(0, b.num_rows, 1024):
                    reach = held.value.reach(matrix(b.column(1).slice(a, 1024)))
                    if reach.shape[1] > seen:
                        nxt = -np.partition(-reach, seen, axis=1)[:, seen]
                        more[a : a + 1024] = nxt >= b.column(2).slice(a, 1024).to_numpy()
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(more)], ["asker", "x", "bound", "more"])

        return run

    def search(members: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["asker", "score", "vec_id", "member"]
        if not members.num_rows or not queries.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.int64())] * 4, names)
        x, ids, own = matrix(members["x"].combine_chunks()), members["vec_id"].to_numpy(), members["member"].to_numpy()
        q, who, bounds = matrix(queries["x"].combine_chunks()), queries["asker"].to_numpy(), queries["bound"].to_numpy()
        out = [[], [], [], []]
        for a in range(0, len(q), 256):
            query, row, score = best_of(q[a : a + 256], bounds[a : a + 256], x, ids, own, k + 1, exact)
            for to, values in zip(out, (who[a : a + 256][query], score, ids[row], own[row]), strict=True):
                to.append(values)
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in out], names)

    order = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id", "member")
    done, before, seen, width = [], None, 0, 1
    while True:
        asks = state.select("asker", "x", "bound").mapInArrow(ask(seen, width), "annulus int, block int, asker long, x array<int>, bound double").withColumn("grp", F.pmod(F.xxhash64("asker"), F.lit(groups)).cast("int"))
        got = placed.groupBy(keys).cogroup(asks.groupBy(keys)).applyInArrow(search, "asker long, score long, vec_id long, member long")
        if before is not None:
            got = before.select("asker", "score", "vec_id", "member").unionByName(got)
        best = cut(got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1), "op11-best")
        seen, width = seen + width, width * WIDER
        bound = best.where(F.col("rank") == k + 1).select("asker", F.col("score").cast("double").alias("bound"))
        later = state.select("asker", "x").join(bound, "asker", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
        state = cut(later.mapInArrow(open_(seen), "asker long, x array<int>, bound double, more boolean"), "op11-open")
        done.append(best.join(state.where("not more").select("asker"), "asker", "left_semi"))
        state = state.where("more")
        if state.isEmpty():
            break
        before = best.join(state.select("asker"), "asker", "left_semi")
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    # k + 1 rows of an asker at most
    lists = whole.groupBy("asker").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score", "member"))).alias("best"))
    who = join_spread(asked.select("x", F.col("member").alias("own"), F.col("vec_id").alias("query_id")), askers, "x").select("own", "query_id", "asker")
    each = join_spread(cut(who, "op11-who"), cut(lists, "op11-lists"), "asker")
    others = F.slice(F.filter("best", lambda b: b["member"] != F.col("own")), 1, k)
    out = each.select("query_id", F.posexplode(others).alias("_i", "_b"))
    return out.select("query_id", (F.col("_i") + 1).cast("int").alias("rank"), F.col("_b.vec_id").alias("vec_id"), F.col("_b.score").alias("score"))


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda c: NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
