"""Graphs as stacked matrices: one row a graph, and many graphs at a time in NumPy.

A graph has at most variables squared times (lags + 1) edges, so its row is small however
many graphs there are; no task gathers more than a batch of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAPH = ["row", "col", "replicate"]
#: Graphs whose matrices are worked on together.
CHUNK = 512


def place_of(name: str, names: list[str]) -> Column:
    """The place of a column's value in a list of names; -1 where it isn't there."""
    return F.array_position(F.array(*map(F.lit, names)), F.col(name)).cast("int") - 1


def graph_rows(edges: DataFrame, names: list[str]) -> DataFrame:
    """One row a graph: its deepest lag, and its edges as places in the stacked matrices with their weights. Edges of other variables don't count."""
    lag = F.col("lag").cast("int") if "lag" in edges.columns else F.lit(0)
    rows = edges.select(*GRAPH, lag.alias("lag"), place_of("parent", names).alias("_p"), place_of("child", names).alias("_c"), "weight").where("_p >= 0 and _c >= 0")
    at = (F.col("lag") * len(names) + F.col("_c")) * len(names) + F.col("_p")
    return rows.groupBy(*GRAPH).agg(F.max("lag").alias("lags"), F.collect_list(F.struct(at.cast("int").alias("at"), F.col("weight").cast("double").alias("weight"))).alias("cells"))


def matrices(cells: pa.Array, d: int, lags: int) -> np.ndarray:
    """Graphs x (lags + 1) x child x parent; edges that are there twice add up."""
    out = np.zeros((len(cells), (lags + 1) * d * d))
    flat = cells.flatten()
    owner = np.repeat(np.arange(len(cells)), np.diff(cells.offsets.to_numpy()))
    np.add.at(out, (owner, flat.field("at").to_numpy()), flat.field("weight").to_numpy(zero_copy_only=False))
    return out.reshape(len(cells), lags + 1, d, d)


def inverses(m: np.ndarray) -> np.ndarray:
    """The inverse of each matrix; NaN for singular ones."""
    good = np.isfinite(m).all((1, 2))
    out = np.full(m.shape, np.nan)
    try:
        out[good] = np.linalg.inv(m[good])
    except np.linalg.LinAlgError:
        for i in np.flatnonzero(good):
            try:
                out[i] = np.linalg.inv(m[i])
            except np.linalg.LinAlgError:
                continue
    return out


def multipliers(b: np.ndarray) -> np.ndarray:
    """(I - B)^-1 of each matrix: the sum of its powers where these end (acyclic graphs, so that what isn't reached is exactly 0), else the inverse."""
    d = b.shape[-1]
    out, power = np.eye(d) + b, b
    for _ in range(d - 2):
        power = power @ b
        out = out + power
    endless = ((power @ b) != 0).any((1, 2)) | ~np.isfinite(out).all((1, 2))
    if endless.any():
        out[endless] = inverses(np.eye(d) - b[endless])
    return out


def reduced(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(I - B0)^-1 and A_l = (I - B0)^-1 B_l of each graph."""
    first = multipliers(b[:, 0])
    return first, np.einsum("nij,nljk->nlik", first, b[:, 1:])


def radii(a: np.ndarray) -> np.ndarray:
    """Largest absolute eigenvalue of each companion matrix; 0 without lags, NaN where a matrix isn't finite."""
    n, lags, d, _ = a.shape
    out = np.zeros(n)
    if not lags:
        return out
    companion = np.zeros((n, lags * d, lags * d))
    companion[:, :d] = a.transpose(0, 2, 1, 3).reshape(n, d, lags * d)
    companion[:, d:, : (lags - 1) * d] = np.eye((lags - 1) * d)
    good = np.isfinite(companion).all((1, 2))
    out[~good] = np.nan
    if good.any():
        out[good] = np.abs(np.linalg.eigvals(companion[good])).max(1)
    return out


def impulse(first: np.ndarray, a: np.ndarray, horizon: int) -> np.ndarray:
    """Theta_0 = (I - B0)^-1 and Theta_h = sum over l of A_l Theta_{h-l}: graphs x (horizon + 1) x target x source."""
    out = np.zeros((len(first), horizon + 1, *first.shape[1:]))
    out[:, 0] = first
    for h in range(1, horizon + 1):
        for lag in range(1, min(h, a.shape[1]) + 1):
            out[:, h] += a[:, lag - 1] @ out[:, h - lag]
    return out


def map_graphs(rows: DataFrame, schema: str, work) -> DataFrame:
    """``work`` on chunks of rows as Arrow tables by column name; it gives columns in the order of the schema."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK):
                out = work(batch.slice(a, CHUNK))
                if out is not None and len(out[0]):
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in out], names)

    return rows.mapInArrow(run, schema)


def keys_of(batch: pa.RecordBatch, take: np.ndarray, names: tuple[str, ...] = ("row", "col", "replicate")) -> list[pa.Array]:
    """Key columns of the graphs at ``take``."""
    return [batch.column(batch.schema.get_field_index(c)).take(pa.array(take)) for c in names]


def finite(x: np.ndarray) -> pa.Array:
    """Doubles; null where not finite."""
    return pa.array(x, mask=~np.isfinite(x))
