"""Every query of the catalogue against the checking engine, on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

from spanloom.operators import vectors
from spanloom.plans import catalog, composed

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda x: str(round(x, 8)) if isinstance(x, float) else str(x)
    return sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    want = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(columns, want.fetchall())


def test_sink_paths_by_brute_force(spark):
    """Breadth-first searches over dictionaries, from every entry."""
    part = spark.read.parquet(f"{SF}/part.parquet").collect()
    sinks = {r.p_partkey for r in part if r.p_type == "PROMO"}
    after: dict = {}
    for r in composed.call_graph(spark, SF).collect():
        after.setdefault(r.caller, []).append(r.callee)
    want = {}
    for entry in (r.p_partkey for r in part if r.p_size == 1):
        level, seen, found, deep = {entry: (entry,)}, {entry}, [], False
        for depth in range(9):
            found += [(depth, steps, node) for node, steps in level.items() if node in sinks]
            open_ = {n: s for n, s in level.items() if n not in sinks}
            if depth == 8:
                deep = bool(open_)
                break
            new: dict = {}
            for node, steps in open_.items():
                for callee in after.get(node, []):
                    if callee not in seen:
                        new[callee] = min(new.get(callee, (*steps, callee)), (*steps, callee))
            seen |= set(new)
            level = new
        marks = ",".join([*["depth_capped"] * deep, *["paths_capped"] * (len(found) > 32)])
        for depth, steps, node in sorted(found)[:32]:
            want[entry, node] = (depth, ">".join(map(str, steps)), marks)
    got = {(r.entry, r.terminal): (r.depth, r.steps, r.limitations) for r in catalog.queries()["p_sink_paths"](spark, SF).collect()}
    assert got == want and want


def test_nearest_in_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)], i % 2) for i in range(200)] + [(200, [0.0] * 4, 0)]
    df = spark.createDataFrame(rows, "id long, vector array<float>, group int")
    got = {}
    for r in vectors.nearest(df.where("id % 20 = 0"), df.repartition(5), 7, block=3).collect():
        got.setdefault(r.query_id, {})[r.place] = r.vec_id
    unit = {i: np.array(v) / max(np.linalg.norm(v), 1e-300) for i, v, _ in rows}
    for i, _, g in rows[::20]:
        near = sorted((round(1 - unit[i] @ unit[j], 9), j) for j, _, h in rows if j != i and h == g)[:7]
        assert [got[i][k + 1] for k in range(7)] == [j for _, j in near]
    assert vectors.nearest(df.where("false"), df, 3).count() == 0


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
