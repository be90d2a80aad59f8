"""Approximate nearest neighbours by low-dimensional stable projections.

Vectors are projected by ``m`` independent normal (2-stable) directions.  The
squared projected distance of two vectors at distance ``d`` is ``d**2`` times a
chi-square variable of ``m`` degrees of freedom.  A query takes vectors in the
order of their projected distance, verifies each by its true distance, and
stops when the next projected distance ``r`` gives ``r**2 / d_k**2`` above the
chi-square quantile of ``confidence``: a vector nearer than the k-th found one
would then have been met with at least that probability.

The projected points are indexed by a kd-tree in two parts.  Its upper part,
fitted on at most ``sample`` vectors, cuts the space into cells of about
``cell_rows`` vectors; all vectors are dealt to their cells by Spark.  In a
cell, a task builds the lower part down to leaves of ``leaf`` vectors and visits
leaves in the order of their boxes' distance.  A query first searches its own
cell; its k-th distance then tells which cells' boxes the stopping test still
admits, and it visits just these.

Queries travel in groups by their own cell, so a task holds one cell and the
queries of one other cell.  Equal vectors are one point with the ``k + 1``
smallest of their ids: more can't be among the k nearest of any query.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftwise.llm.staging import free_name, ready, stage


@dataclass(frozen=True)
class Index:
    m: int = 8
    confidence: float = 0.98
    sample: int = 1 << 16
    cell_rows: int = 1 << 14
    leaf: int = 64
    seed: int = 11

    def directions(self, dim: int) -> np.ndarray:
        return np.random.Generator(np.random.PCG64(self.seed)).standard_normal((dim, self.m))


def chi_square_quantile(p: float, m: int) -> float:
    """Quantile of the chi-square law with an even number of degrees of freedom."""
    if m % 2:
        raise ValueError("m must be even")

    def beyond(x: float) -> float:
        return math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))

    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beyond(mid) > 1 - p else (lo, mid)
    return hi


@dataclass(frozen=True)
class Cells:
    """A complete binary tree of splits: node ``i`` has the children ``2 i + 1`` and ``2 i + 2``."""

    depth: int
    dims: np.ndarray
    splits: np.ndarray
    lower: np.ndarray  # boxes of the cells
    upper: np.ndarray

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.dims[node]] >= self.splits[node])
        return node - ((1 << self.depth) - 1)

    def reached(self, point: np.ndarray, radius2: float) -> np.ndarray:
        gap = np.maximum(0, np.maximum(self.lower - point, point - self.upper))
        return np.flatnonzero((gap * gap).sum(axis=1) <= radius2)


def fit_cells(points: np.ndarray, m: int, depth: int) -> Cells:
    """Median splits on the widest dimension of the sample."""
    inner = (1 << depth) - 1
    dims, splits = np.zeros(max(inner, 1), dtype=np.int64), np.zeros(max(inner, 1))
    lower, upper = np.full((2 * inner + 1, m), -np.inf), np.full((2 * inner + 1, m), np.inf)
    held = {0: points}
    for i in range(inner):
        own = held.pop(i)
        if len(own):
            dims[i] = np.argmax(own.max(axis=0) - own.min(axis=0))
            splits[i] = np.median(own[:, dims[i]])
        right = own[:, dims[i]] >= splits[i]
        for child, rows in ((2 * i + 1, own[~right]), (2 * i + 2, own[right])):
            held[child] = rows
            lower[child], upper[child] = lower[i], upper[i]
        upper[2 * i + 1, dims[i]] = lower[2 * i + 2, dims[i]] = splits[i]
    return Cells(depth, dims, splits, lower[inner:], upper[inner:])


def _leaves(points: np.ndarray, leaf: int) -> list[np.ndarray]:
    """The lower part of the tree: rows of each leaf, by median splits on the widest dimension."""
    todo, out = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            out.append(rows)
            continue
        own = points[rows]
        d = np.argmax(own.max(axis=0) - own.min(axis=0))
        order = np.argsort(own[:, d], kind="stable")
        todo += [rows[order[:len(rows) // 2]], rows[order[len(rows) // 2:]]]
    return out


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), dim)


class Cell:
    """The vectors of one cell, ready to be searched."""

    def __init__(self, vectors: np.ndarray, ids: list[list[int]], directions: np.ndarray, leaf: int):
        self.vectors, self.ids = vectors.astype(np.float64), ids
        points = self.vectors @ directions
        leaves = _leaves(points, leaf) if len(points) else []
        self.leaves = leaves
        self.lower = np.array([points[x].min(axis=0) for x in leaves])
        self.upper = np.array([points[x].max(axis=0) for x in leaves])

    def search(self, own: int, vector: np.ndarray, point: np.ndarray, k: int, bound: float, limit: float) -> list[tuple[float, int]]:
        """Up to k (distance, id), nearest first, other than the query's own id.

        ``bound`` is a distance that k known neighbours don't exceed; ``limit``
        the quantile of the stopping test.
        """
        best: list[tuple[float, int]] = []
        if not self.leaves:
            return best
        gap = np.maximum(0, np.maximum(self.lower - point, point - self.upper))
        r2 = (gap * gap).sum(axis=1)
        for i in np.argsort(r2, kind="stable"):
            if r2[i] > limit * bound * bound:
                break
            rows = self.leaves[i]
            diff = self.vectors[rows] - vector
            dist = np.sqrt((diff * diff).sum(axis=1))
            near = np.flatnonzero(dist <= bound)
            if len(near):
                best += [(float(dist[j]), x) for j in near for x in self.ids[rows[j]] if x != own]
                best = sorted(best)[:k]
                if len(best) == k:
                    bound = min(bound, best[-1][0])
        return best


def usable(embedding: Column, dim: int) -> Column:
    """Vectors of ``dim`` finite components, not all of them zero."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(embedding.isNotNull() & (F.size(embedding) == dim) & fine & F.exists(embedding, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, k: int, dim: int, index: Index = Index()) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query among all other rows.

    ``vectors`` needs ``vec_id`` and ``embedding`` and may have any other
    columns; ``is_query`` tells the queries by ``vec_id``.  Rows without an id,
    and vectors that are null, zero, of another length or hold a null or
    non-finite component take no part.  Repeated rows count once; rows of the
    query's id are its own.  Ties go to the smaller id.  An empty table gives no
    rows.
    """
    ready(vectors)
    limit = chi_square_quantile(index.confidence, index.m)
    directions = index.directions(dim)
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"), dim)).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).distinct()
    rows = stage(rows, "vectors")
    order = Window.partitionBy("embedding").orderBy("vec_id")
    points = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    points = stage(points, "points")
    n = points.count()
    depth = min(max(0, math.ceil(math.log2(max(1, n) / index.cell_rows))), int(math.log2(index.sample)) - 4)
    share = F.shiftrightunsigned(F.xxhash64("embedding"), 11).cast("double") / float(1 << 53)
    sampled = points.where(share < 0.9 * index.sample / max(n, 1)).select("embedding") if depth else points.limit(0).select("embedding")
    taken = np.array([r[0] for r in sampled.collect()], dtype=np.float64).reshape(-1, dim) @ directions
    cells = fit_cells(taken, index.m, depth)

    def dealt(df: DataFrame) -> DataFrame:
        name = free_name(df, "cell")
        fields = df.schema.fields

        def run(batches):
            for batch in batches:
                found = cells.of(_matrix(pa.chunked_array([batch.column("embedding")]), dim) @ directions)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[*batch.schema.names, name])
        return df.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + f", {name} bigint")

    dealt_points = stage(dealt(points), "cells")
    queries = stage(dealt(rows.where(is_query).select(F.col("vec_id").alias("query_id"), "embedding")).withColumnRenamed("cell", "home"), "queries")
    found = "query_id bigint, vec_id bigint, score double"

    def search(reached: DataFrame) -> DataFrame:
        """Search each cell for the queries that reach it: rows (cell, home, query_id, embedding, bound)."""
        pairs = reached.select(F.col("cell").alias("inner"), F.col("home").alias("outer")).distinct()
        inside = dealt_points.join(pairs, F.col("cell") == F.col("inner")).select("inner", "outer", "embedding", "ids")
        return reached.groupBy("cell", "home").cogroup(inside.groupBy("inner", "outer")).applyInArrow(_searcher(dim, directions, index.leaf, k, limit), found)

    first = stage(search(queries.withColumn("cell", F.col("home")).withColumn("bound", F.lit(float("inf")))), "first")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    kth = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    bounded = queries.join(kth, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))

    def other_cells(batches):
        for batch in batches:
            points_ = _matrix(pa.chunked_array([batch.column("embedding")]), dim) @ directions
            reach = [cells.reached(p, limit * b * b * (1 + 1e-9)) for p, b in zip(points_, batch.column("bound").to_pylist(), strict=True)]
            home = batch.column("home").to_pylist()
            reach = [x[x != h] for x, h in zip(reach, home, strict=True)]
            take = pa.array(np.repeat(np.arange(len(reach)), [len(x) for x in reach]))
            yield pa.RecordBatch.from_arrays([*(c.take(take) for c in batch.columns), pa.array(np.concatenate([*reach, np.zeros(0, np.int64)]), pa.int64())], names=[*batch.schema.names, "cell"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in bounded.schema.fields)
    second = search(bounded.mapInArrow(other_cells, kinds + ", cell bigint"))
    ranked = first.unionByName(second).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _searcher(dim: int, directions: np.ndarray, leaf: int, k: int, limit: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(queries: pa.Table, inside: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if queries.num_rows and inside.num_rows:
            cell = Cell(_matrix(inside["embedding"], dim), inside["ids"].to_pylist(), directions, leaf)
            vectors = _matrix(queries["embedding"], dim).astype(np.float64)
            for own, vector, point, bound in zip(queries["query_id"].to_pylist(), vectors, vectors @ directions, queries["bound"].to_pylist(), strict=True):
                out += [(own, x, d) for d, x in cell.search(own, vector, point, k, bound, limit)]
        columns = list(zip(*out, strict=True)) if out else [()] * 3
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "vec_id", "score"])
    return run
