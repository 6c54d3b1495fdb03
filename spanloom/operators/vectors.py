"""Exact nearest vectors of a query set, in blocks of queries against all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries of a block: what is broadcast.
BLOCK = 2048
#: Queries and rows that are held against each other at once: what a worker holds does not grow with either.
TILE = 512
#: Distances are compared at this many decimals.
PLACES = 9


def _unit(vectors: pa.Array) -> np.ndarray:
    if not len(vectors):
        return np.zeros((0, 1))
    if vectors.null_count == 0 and vectors.flatten().null_count == 0 and len(set(np.diff(vectors.offsets))) == 1:
        flat = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1).astype(np.float64)
    else:
        flat = np.stack([np.asarray(v, np.float64) for v in vectors.to_pylist()])
    return flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-300)


def _nearest(sent, k: int):
    """(id, vector, group) to those rows of a task that can be among the ``k`` nearest of a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked, groups = sent.value
        # The least distances so far of each query.
        near = np.full((len(ids), k), np.inf)
        for whole in batches:
            for low in range(0, whole.num_rows, TILE):
                batch = whole.slice(low, TILE)
                own, group = batch.column(0).to_numpy(), np.array(batch.column(2).to_pylist(), object)
                rows = _unit(batch.column(1)).T
                for at in range(0, len(ids), TILE):
                    part = slice(at, at + TILE)
                    far = 1 - asked[part] @ rows
                    far[(ids[part, None] == own[None, :]) | (groups[part, None] != group[None, :])] = np.inf
                    near[part] = np.partition(np.concatenate([near[part], far], axis=1), k - 1, axis=1)[:, :k]
                    # Ties at the last place all stay: which of them count is decided by id at the end.
                    q, r = np.nonzero((far <= near[part].max(axis=1, keepdims=True) + 1.1 * 10.0**-PLACES) & np.isfinite(far))
                    if len(q):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[part][q]), pa.array(own[r]), pa.array(far[q, r])], names=["query_id", "vec_id", "dist"])

    return run


def nearest(queries: DataFrame, rows: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(query_id, vec_id, dist, place): the ``k`` nearest of (id, vector, group) rows of each query's group, itself left out.

    Ties go to the smaller id. Queries come to the driver a block at a time; rows stay where they are and are passed over once a block.
    """
    spark, out, held = rows.sparkSession, None, []

    def searched() -> DataFrame:
        sent = spark.sparkContext.broadcast((np.array([q[0] for q in held]), _unit(pa.array([q[1] for q in held])), np.array([q[2] for q in held], object)))
        got = rows.mapInArrow(_nearest(sent, k), "query_id long, vec_id long, dist double")
        return got if out is None else out.unionByName(got)

    for r in queries.toLocalIterator():
        held.append(tuple(r))
        if len(held) == block:
            out, held = searched(), []
    if held or out is None:
        if not held:
            return spark.createDataFrame([], "query_id long, vec_id long, dist double, place int")
        out = searched()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("dist", PLACES), "vec_id"))
    return out.withColumn("place", place).where(F.col("place") <= k)
