"""Cosine similarity and dense retrieval."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Questions are sent to every task, so their number is bounded; more are answered in rounds.
QUERIES_IN_ROUND = 20_000


def cosine(a: Column, b: Column) -> Column:
    """0 where the lengths differ or a vector is zero."""
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    wide = lambda c: F.transform(c, lambda x: x.cast("double"))
    dot = add(F.zip_with(wide(a), wide(b), lambda x, y: x * y))
    norm = F.sqrt(add(F.transform(wide(a), lambda x: x * x))) * F.sqrt(add(F.transform(wide(b), lambda x: x * x)))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot / norm)


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", embedding: str = "embedding", query_id: str = "query_id") -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest of each query by cosine; rounded to 6 digits, ties by id.

    Queries go to the workers in rounds of bounded size; each batch of vectors sends on only its own k best for each
    query, so the shuffle is k rows for each query and batch.
    """
    rows = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(embedding).cast("array<double>").alias("e")).toArrow()
    out = None
    for lo in range(0, max(rows.num_rows, 1), QUERIES_IN_ROUND):
        part = rows.slice(lo, QUERIES_IN_ROUND)
        ids = part.column("query_id").to_numpy()
        matrix = _matrix(part.column("e"))
        found = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e")).mapInArrow(_nearest(ids, matrix, k), "query_id long, vec_id long, score double")
        out = found if out is None else out.unionByName(found)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    values = np.asarray(flat.flatten().to_numpy(zero_copy_only=False)).reshape(n, -1) if n else np.zeros((0, 1))
    norm = np.sqrt((values * values).sum(1, keepdims=True))
    return np.divide(values, norm, out=np.zeros_like(values), where=norm > 0)


def _nearest(ids: np.ndarray, queries: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            own, vectors = batch.column("vec_id").to_numpy(), _matrix(batch.column("e"))
            for lo in range(0, len(ids), 512):
                scores = np.round(queries[lo : lo + 512] @ vectors.T, 6)
                order = np.lexsort((np.broadcast_to(own, scores.shape), -scores), axis=1)[:, :k]
                yield pa.RecordBatch.from_pydict({
                    "query_id": pa.array(np.repeat(ids[lo : lo + 512], order.shape[1]), pa.int64()), "vec_id": pa.array(own[order].ravel(), pa.int64()),
                    "score": pa.array(np.take_along_axis(scores, order, 1).ravel(), pa.float64()),
                })

    return run
