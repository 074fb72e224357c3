"""Operator 5: approximate nearest neighbours by a hierarchical k-means tree.

Nearness is the inner product. Vectors get one more component that makes all norms equal,
so the largest inner product is the smallest distance, and a k-means tree is built on
them. A query walks the tree best bin first: a priority queue holds nodes by the distance
to their centre, and leaves are visited in that order. How many leaves is calibrated: on
queries drawn from the fitting sample, visits widen until the wanted recall is reached.

Every row is put into a leaf. Leaves are searched in blocks of about ``BLOCK_ROWS`` rows,
so a leaf that holds a third of all rows is many blocks; equal vectors of a block are
compared once. The first of a query's leaves give a bound that rows of the later ones have
to reach, so those return few rows. Scores are inner products of the original vectors in
double precision.

Bounds: the tree is fitted on at most ``SAMPLE`` vectors, drawn by a hash of their id; its
leaves are at most ``SAMPLE / LEAF_SAMPLE``. Indexing and search cover every row.

Defined cases: vectors that are null, zero, of another length than the commonest, or hold
null or non-finite components take no part; components of any numeric type are read (floats
as they are, others as doubles); a row is no neighbour of itself, but rows that share its id
are, and each of them has ranks of its own; equal scores are ordered by id; with fewer candidates than
asked for all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terracause.llm.shared import cut

SAMPLE = 40_000
LEAF_SAMPLE = 400
BRANCHES = 16
BLOCK_ROWS = 4_096
CALIBRATION = 256
RECALL = 0.98
#: The share of a query's leaves that is searched for its bound.
FIRST = 0.125


@dataclass
class Tree:
    """Centres of the children of each inner node; a child below zero is leaf -1 - child."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaves: int = 0

    def grow(self, x: np.ndarray, target: int, rng: np.random.Generator) -> int:
        if len(x) <= target:
            self.leaves += 1
            return -self.leaves
        centres, near = kmeans(x, min(BRANCHES, math.ceil(len(x) / target)), rng)
        if len(centres) < 2:
            self.leaves += 1
            return -self.leaves
        node = len(self.centres)
        self.centres.append(centres)
        self.children.append([])
        self.children[node] = [self.grow(x[near == i], target, rng) for i in range(len(centres))]
        return node

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest centre at every node."""
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))] if self.centres else []
        while todo:
            node, rows = todo.pop()
            near = distances(x[rows], self.centres[node]).argmin(1)
            for i, child in enumerate(self.children[node]):
                some = rows[near == i]
                if len(some) and child < 0:
                    out[some] = -1 - child
                elif len(some):
                    todo.append((child, some))
        return out

    def visit(self, q: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves in best-bin-first order."""
        if not self.centres:
            return [0]
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if node < 0:
                out.append(-1 - node)
                continue
            for d, child in zip(distances(q[None], self.centres[node])[0].tolist(), self.children[node], strict=True):
                heapq.heappush(queue, (d, child))
        return out


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres * centres).sum(1) - 2 * x @ centres.T


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd's algorithm from distinct rows; empty centres go."""
    different = np.unique(x[rng.permutation(len(x))[: 64 * k]], axis=0)
    centres = different[rng.permutation(len(different))[:k]]
    for _ in range(rounds):
        near = distances(x, centres).argmin(1)
        used, near = np.unique(near, return_inverse=True)
        sums = np.zeros((len(used), x.shape[1]))
        np.add.at(sums, near, x)
        centres = sums / np.bincount(near)[:, None]
    near = distances(x, centres).argmin(1)
    used, near = np.unique(near, return_inverse=True)
    return centres[used], near


def widened(x: np.ndarray, square: float) -> np.ndarray:
    """Vectors with the component that gives all the squared norm ``square``."""
    return np.concatenate([x, np.sqrt(np.maximum(square - (x * x).sum(1), 0))[:, None]], axis=1)


def calibrate(tree: Tree, x: np.ndarray, square: float, k: int, rng: np.random.Generator) -> int:
    """Fewest leaves whose visits find the wanted share of the ``k`` best scores in the sample."""
    rows = rng.permutation(len(x))[:CALIBRATION]
    leaf = tree.assign(widened(x, square))
    orders = [tree.visit(np.append(x[r], 0.0), tree.leaves) for r in rows]
    found = np.zeros(tree.leaves)
    for r, order in zip(rows, orders, strict=True):
        score = x @ x[r]
        score[r] = -np.inf
        best = np.argpartition(-score, min(k, len(x) - 1))[:k] if len(x) > k else np.arange(len(x))
        step = np.empty(tree.leaves, int)
        step[order] = np.arange(len(order))
        found += np.cumsum(np.bincount(step[leaf[best]], minlength=tree.leaves)) / len(best)
    enough = np.flatnonzero(found / max(1, len(rows)) >= RECALL)
    return int(enough[0]) + 1 if len(enough) else tree.leaves


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


class Kinds:
    """The distinct vectors of a block, each with its rows in order of their ids."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray):
        order = np.lexsort((rows, ids))
        rows, ids, x = rows[order], ids[order], x[order]
        _, first, same = np.unique(x, axis=0, return_index=True, return_inverse=True)
        by = np.argsort(same.ravel(), kind="stable")
        self.vectors, self.rows, self.ids, self.counts = x[first], rows[by], ids[by], np.bincount(same.ravel())
        self.starts = np.cumsum(self.counts) - self.counts

    def best(self, qs: np.ndarray, vs: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the rows ``qs`` that ask: row, id and score of the ``k`` best other rows here that reach its bound."""
        rough = vs @ self.vectors.T
        n = rough.shape[1]
        limit = bounds if n <= k + 1 else np.maximum(bounds, -np.partition(-rough, k, axis=1)[:, k])
        slack = 1e-9 * (1 + np.abs(rough).max(1))
        row, kind = np.nonzero(rough >= (limit - slack)[:, None])
        exact = np.einsum("ij,ij->i", self.vectors[kind], vs[row])
        times = np.minimum(self.counts[kind], k + 1)
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        place = np.repeat(self.starts[kind], times) + nth
        ids = self.ids[place]
        row, score = np.repeat(row, times), np.repeat(exact, times)
        keep = (self.rows[place] != qs[row]) & (score >= bounds[row])
        row, ids, score = row[keep], ids[keep], score[keep]
        order = np.lexsort((ids, -score, row))
        row, ids, score = row[order], ids[order], score[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        return qs[row[nth < k]], ids[nth < k], score[nth < k]


def usable(df: DataFrame) -> DataFrame:
    """A number of its own, vec_id and embedding of the rows that take part."""
    x = F.col("embedding")
    if not isinstance(df.schema["embedding"].dataType.elementType, T.FloatType):
        df = df.withColumn("embedding", x.cast("array<double>"))
    good = df.where("vec_id is not null and embedding is not null").where(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))).where(F.exists(x, lambda v: v != 0))
    good = good.select(F.monotonically_increasing_id().alias("member"), F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    sizes = good.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    return good.where(F.size("embedding") == (sizes[0]["size"] if sizes else -1))


def nearest(df: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest rows found for each row whose id is divisible by ``every``."""
    spark = df.sparkSession
    good = usable(df)
    kind = good.schema["embedding"].dataType.simpleString()
    square = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    most = good.agg(F.max(square)).first()[0] or 0.0
    some = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    rng = np.random.default_rng(1)
    tree, visits = Tree(), 1
    if len(some):
        x = np.stack(some["embedding"].to_numpy()).astype(np.float64)
        tree.grow(widened(x, most), LEAF_SAMPLE, rng)
        visits = calibrate(tree, x, most, k, rng)
    held = spark.sparkContext.broadcast(tree)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaf = held.value.assign(widened(matrix(b.column(2)), most))
                yield pa.RecordBatch.from_arrays([pa.array(leaf), *b.columns], ["leaf", "member", "vec_id", "embedding"])

    index = cut(good.mapInArrow(put, f"leaf int, member long, vec_id long, embedding {kind}"), "op5")
    # at most as many rows as the tree has leaves
    blocks = {r["leaf"]: math.ceil(r["count"] / BLOCK_ROWS) for r in index.groupBy("leaf").count().collect()}
    sizes = spark.sparkContext.broadcast(blocks)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for asker, q, vector in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), matrix(b.column(2)), strict=True):
                spots = [(leaf, i, step) for step, leaf in enumerate(held.value.visit(np.append(vector, 0.0), visits)) for i in range(sizes.value.get(leaf, 0))]
                leaf, block, step = np.array(spots, np.int32).reshape(-1, 3).T
                n = len(spots)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(vector)), pa.array(np.tile(vector, n).astype(np.float32 if kind == "array<float>" else np.float64)))
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(block), pa.array(step), pa.array(np.full(n, asker, np.int64)), pa.array(np.full(n, q, np.int64)), vectors], ["leaf", "block", "step", "asker", "query_id", "vector"])

    number = F.create_map(*[F.lit(v) for kv in blocks.items() for v in kv])[F.col("leaf")] if blocks else F.lit(1)
    rows = index.withColumn("block", F.pmod(F.xxhash64("member", F.lit(11)), number).cast("int"))
    asked = cut(index.where(F.col("vec_id") % every == 0).select("member", "vec_id", "embedding").mapInArrow(walk, f"leaf int, block int, step int, asker long, query_id long, vector {kind}"), "op5-asked")

    def search(members: pa.Table, queries: pa.Table) -> pa.Table:
        if not members.num_rows or not queries.num_rows:
            return pa.table({"asker": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        kinds = Kinds(members["member"].to_numpy(), members["vec_id"].to_numpy(), matrix(members["embedding"].combine_chunks()))
        names = dict(zip(queries["asker"].to_pylist(), queries["query_id"].to_pylist(), strict=True))
        qs, vs, bounds = queries["asker"].to_numpy(), matrix(queries["vector"].combine_chunks()), queries["bound"].to_numpy()
        found = [kinds.best(qs[a : a + 512], vs[a : a + 512], bounds[a : a + 512], k) for a in range(0, len(qs), 512)]
        asker, near, score = (np.concatenate([f[i] for f in found]) for i in range(3))
        return pa.table({"asker": asker, "query_id": pa.array([names[a] for a in asker.tolist()], pa.int64()), "vec_id": near, "score": score})

    keys, out = ["leaf", "block"], "asker long, query_id long, vec_id long, score double"
    look = lambda queries: rows.groupBy(keys).cogroup(queries.groupBy(keys)).applyInArrow(search, out)
    order = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id")
    top = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    early = F.col("step") < max(1, math.ceil(visits * FIRST))
    start = cut(top(look(asked.where(early).withColumn("bound", F.lit(float("-inf"))))), "op5-first")
    bound = start.where(F.col("rank") == k).select("asker", F.col("score").alias("bound"))
    late = asked.where(~early).join(bound, "asker", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    return top(start.select("asker", "query_id", "vec_id", "score").unionByName(look(late))).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
