"""Joins that make pairs, by loops over all of them, and how far they are spread."""

from collections import Counter

from spanloom.operators import pairs
from spanloom.plans import catalog


def test_within_by_loops(spark):
    rows = [(i, f"f{i % 2}", i * 7 % 30, i * 7 % 30 + i % 10) for i in range(160)] + [(3, "f1", 5, 9), (900, "f0", 20, 12), (901, "f0", 24, 11), (902, None, 1, 2), (None, "f0", 1, 5), (903, "f0", None, None)]
    df = spark.createDataFrame(rows, "id long, file string, a long, b long")
    full = [r for r in rows if None not in r]
    want = Counter((x[0], y[0]) for x in full for y in full if x[1] == y[1] and x[2] <= y[2] and x[3] >= y[3] and x[0] != y[0])
    got = Counter(tuple(r) for r in pairs.within(df, 13, block=3).collect())
    assert got == want and (901, 900) not in got and got


def test_sharing_by_loops(spark):
    rows = [(i % 90, t) for i in range(200) for t in {f"t{i % 4}", f"t{i % 7}"}] + [(None, "t1"), (5, None), (7, ""), (8, "")]
    of: dict = {}
    for i, t in rows:
        if i is not None and t is not None:
            of.setdefault(i, set()).add(t)
    want = Counter((a, b) for a in of for b in of if a != b and of[a] & of[b])
    got = Counter(tuple(r) for r in pairs.sharing(spark.createDataFrame(rows, "id long, token string"), block=4).collect())
    assert got == want and got


def test_a_key_is_spread_over_tasks(spark):
    df = spark.range(400).selectExpr("id", "'f' AS file", "1L AS a", "2L AS b")
    made = pairs.within(df, 0, block=20).rdd.mapPartitions(lambda r: [sum(1 for _ in r)]).collect()
    assert sum(made) == 400 * 399 and sum(n > 0 for n in made) > 5


def test_related_entities_are_those_of_any_line(spark):
    sf = "/root/testdata/sf0.001"
    last = {r.p_partkey: r.p_name.rpartition(" ")[2] for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    got = Counter(tuple(r) for r in catalog.queries()["q_related_entities"](spark, sf).select("span_id", "target").collect())
    assert got == Counter((a, b) for a in last for b in last if a != b and last[a] == last[b]) and got
