"""Exact k-nearest-neighbour search over embedding tables.

Vectors and queries are dealt into blocks of bounded size; every pair of a
query block and a vector block is one group, whose task computes all distances
of the two blocks and keeps the k best of each query.  The final
``row_number() <= k`` per query then sees at most (vector blocks x k) rows per
query, with a map-side ``WindowGroupLimit`` in front of the shuffle.  A small
query set is one block, and no vector is copied; a large one costs what an exact
search of all pairs must cost, spread over all tasks.

Distances are squared Euclidean ("l2", the vector store default) summed
dimension by dimension in index order, so results are reproducible to the
last bit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERY_BLOCK, VECTOR_BLOCK = 256, 8192  # rows; bounds a task's distances to 16 MB


def _dealt(df: DataFrame, id_col: str, block: str, rows: int) -> tuple[DataFrame, int]:
    blocks = max(1, -(-df.count() // rows))
    return df.withColumn(block, F.pmod(F.xxhash64(id_col), F.lit(blocks))), blocks


def knn(vectors: DataFrame, id_col: str, vec_col: str, queries: DataFrame, qid_col: str, qvec_col: str,
        k: int, query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """Exact k nearest vectors per query: (query id, rank, vector id, distance).

    Ties are broken by the vector id.  Ids keep their types, whatever they are.
    """
    qid_type, id_type = queries.schema[qid_col].dataType, vectors.schema[id_col].dataType
    schema = T.StructType([T.StructField("query_id", qid_type), T.StructField(id_col, id_type),
                           T.StructField("distance", T.DoubleType())])
    q, q_blocks = _dealt(queries.select(F.col(qid_col).alias("_qid"), F.col(qvec_col).alias("_qv")), "_qid", "_qb", query_block)
    v, v_blocks = _dealt(vectors.select(F.col(id_col).alias("_id"), F.col(vec_col).alias("_v")), "_id", "_vb", vector_block)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q, v = q.withColumn("_vb", every(v_blocks)), v.withColumn("_qb", every(q_blocks))

    def search(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or held.empty:
            return pd.DataFrame({"query_id": [], id_col: [], "distance": []})
        held = held.sort_values("_id", kind="stable")
        mat, vecs = (np.stack([np.asarray(x, dtype=np.float64) for x in col]) for col in (asked["_qv"], held["_v"]))
        dist = np.zeros((len(mat), len(vecs)))
        for j in range(mat.shape[1]):  # sequential sum in dimension order
            d = vecs[:, j] - mat[:, j:j + 1]
            dist += d * d
        best = np.argsort(dist, axis=1, kind="stable")[:, :k]  # ties stay in id order
        rows = np.repeat(np.arange(len(mat)), best.shape[1])
        return pd.DataFrame({"query_id": asked["_qid"].to_numpy()[rows], id_col: held["_id"].to_numpy()[best.ravel()],
                             "distance": dist[rows, best.ravel()]})

    partial = q.groupBy("_qb", "_vb").cogroup(v.groupBy("_qb", "_vb")).applyInPandas(search, schema)
    w = Window.partitionBy("query_id").orderBy("distance", id_col)
    return (partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .withColumn("rank", F.col("rank").cast("long")))
