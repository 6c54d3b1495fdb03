"""Nearest vectors: ties at the last place, and what a worker holds."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from spanloom.operators import vectors


def test_ties_are_of_rounded_distances(spark):
    # Row 1 is farther than row 2 by 5e-11, which does not count: the smaller id goes first.
    df = spark.createDataFrame([(20, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (1, [1.0, 1e-5], 0)], "id long, vector array<double>, group int").coalesce(1)
    assert [r.vec_id for r in vectors.nearest(df.where("id = 20"), df, 1).collect()] == [1]


def test_a_worker_holds_tiles():
    rng = np.random.default_rng(1)
    n = 10_000
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(list(rng.normal(size=(n, 8)).astype(np.float32))), pa.array([0] * n)], names=["id", "vector", "group"])
    unit = vectors._unit(batch.column(1))
    sent = SimpleNamespace(value=(np.arange(2048), unit[:2048], np.zeros(2048, object)))
    tracemalloc.start()
    best: dict = {}
    for b in vectors._nearest(sent, 3)(iter([batch])):
        for q, r, d in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if q % 400 == 0:
                best.setdefault(q, []).append((round(d, 9), r))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for q, rows in best.items():
        far = np.round(1 - unit @ unit[q], 9)
        far[q] = np.inf
        assert [r for _, r in sorted(rows)[:3]] == list(np.lexsort((np.arange(n), far))[:3])
    assert len(best) == 6 and peak < 40_000_000
