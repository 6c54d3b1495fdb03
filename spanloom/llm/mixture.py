"""Mixing sources to target weights by the cube method (Deville and Tille, 2004).

A source's target over its size is how often each of its documents is taken on average. The whole part is taken
outright; the rest is one inclusion probability, which the cube method turns into 0 or 1 for each document: the
probabilities of the undecided documents move along a direction that changes neither the expected number of words nor
that of documents (the null space of the two constraints), and a move ends when a document is decided. The
direction is the projection of the largest undecided document onto that space: it is decided early, while many others
share what it is off, and what stays undecided at the end are the shortest documents.

Blocks of a source fly apart from each other, all under both constraints; what each leaves undecided (at most two
documents) flies on in blocks of leftovers, until a source has one block left. Only what that leaves is landed: of two
documents one is taken, by their probabilities, which keeps the number of documents; a last one by its own. The last block is drawn
again while a document that no others can make up for leaves it off its totals (rejective sampling).

Defined results: null and blank texts have size 0; a null source is a source, ordered last; rows with equal or null
doc_id are documents of their own; an empty table gives an empty result; other columns are not looked at. The random
numbers come from the source and block, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import WORD, Scratch, text_of

WEIGHTS, CAP, BLOCK, FAN = (1, 2, 3), 3, 1024, 512
#: A landing is drawn anew, at most so often, while it is off by more than this share of the words or this many documents.
DRAWS, WORDS_OFF, DOCS_OFF = 64, 0.001, 1.0


def word_count(text: str | Column = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def _running(df: DataFrame, order: list[Column], sums: dict[str, str | Column], keep) -> DataFrame:
    """``df`` with columns of the sums over all rows before each row by ``order``, without gathering rows in one task.

    Rows are sorted into ranges and stored; a row's sum is that of the ranges before (one row a range) and that in its range.
    """
    cut = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    cut = keep(cut, "ranges")
    totals = cut.groupBy("_part").agg(*[F.sum(v).alias(f"_t_{k}") for k, v in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    bases = totals.select("_part", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.join(F.broadcast(bases), "_part").withColumns({k: F.col(f"_b_{k}") + F.coalesce(F.sum(v).over(inside), F.lit(0)) for k, v in sums.items()})
    return cut.drop("_part", *[f"_b_{k}" for k in sums])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, n, source_size, target) from rows of (source, size); the table is stored.

    Targets are the smaller of ``cap`` times the size and a common level times the weight. Sources are taken in
    the order of the level at which they reach their cap; the level is what the capped ones before leave, by weight.
    """
    keep = Scratch()
    by_name = [F.col("source").asc_nulls_last()]
    per = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    per = _running(per, by_name, {"place": F.lit(1)}, keep)
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
    per = per.withColumn("full", F.lit(cap) * F.col("source_size")).withColumn("at", F.col("full") / F.col("w"))
    per = keep(_running(per, [F.col("at"), *by_name], {"before": F.col("full"), "before_w": F.col("w")}, keep), "levels")
    whole, every_w = per.agg(F.sum("source_size"), F.sum("w")).first()
    per = per.withColumn("level", (F.lit(whole or 0) - F.col("before")) / (F.lit(every_w or 1) - F.col("before_w")))
    # The first source whose cap is above the level that is left for it sets the level of it and of all after it.
    final = per.where(F.col("at") > F.col("level")).agg(F.min(F.struct("at", F.col("source").isNull(), "source", "level"))["level"].alias("final")).first()["final"]
    target = F.col("full").cast("double") if final is None else F.when(F.col("at") <= final, F.col("full").cast("double")).otherwise(F.col("w") * F.lit(final))
    return keep.result(per.select("source", "n", "source_size", target.alias("target")), "targets")


EPSILON = 1e-9


def fly(sizes: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The probabilities after the flight, for sizes in falling order; at most two stay undecided.

    A move takes the largest undecided document ``i`` that can move and the direction ``e_i - w * (a + b * size)``, with ``a``
    and ``b`` such that it sums to nothing over documents and over words.
    """
    p = np.where(p <= EPSILON, 0.0, np.where(p >= 1 - EPSILON, 1.0, p))
    open_ = np.flatnonzero((p > 0) & (p < 1))
    q, x = p[open_], sizes[open_].astype(np.float64)
    while len(open_) > 2:
        # Long documents give way more than short ones, which are thus there to the end.
        w = (x / max(x[0], 1.0)) ** 2 + 1e-3
        whole = w.sum()
        mean = (w @ x) / whole
        off = x - mean
        spread = (w * off) @ off
        ratio = off / spread if spread > 1e-12 * whole * (1 + mean * mean) else np.zeros(len(x))
        # How far each document's own probability moves in its direction: nothing if it alone carries all differences of size.
        i = int(np.argmax(1 - w * (1 / whole + off * ratio) > 1e-6))
        u = -w * (1 / whole + off * ratio[i])
        u[i] += 1.0
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - q) / u, np.where(u < 0, -q / u, np.inf)).min()
            down = np.where(u > 0, q / u, np.where(u < 0, (q - 1) / u, np.inf)).min()
        q = q + (up if rng.random() * (up + down) < down else -down) * u
        done = (q <= EPSILON) | (q >= 1 - EPSILON)
        p[open_[done]] = np.round(q[done])
        open_, q, x = open_[~done], q[~done], x[~done]
    p[open_] = q
    return p


def land(sizes: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decides the last undecided documents: two at a time against each other, which keeps the number of documents."""
    p = p.copy()
    while len(open_ := np.flatnonzero((p > EPSILON) & (p < 1 - EPSILON))):
        if len(open_) == 1:
            p[open_[0]] = float(rng.random() < p[open_[0]])
            break
        a, b = open_[-2:]
        up, down = min(1 - p[a], p[b]), min(p[a], 1 - p[b])
        step = up if rng.random() * (up + down) < down else -down
        p[a], p[b] = p[a] + step, p[b] - step
    return np.round(p)


def drawn(sizes: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A flight and landing of a whole block: the first one near both totals, else the nearest of ``DRAWS``."""
    words, n = max(p @ sizes, 1.0), p.sum()
    best, least = p, np.inf
    for _ in range(DRAWS):
        out = land(sizes, fly(sizes, p, rng), rng)
        off = max(abs(out @ sizes - p @ sizes) / words / WORDS_OFF, abs(out.sum() - n) / DOCS_OFF)
        if off < least:
            best, least = out, off
        if off <= 1:
            break
    return best


def _flight(block: pd.DataFrame) -> pd.DataFrame:
    first = block.iloc[0]
    # Long documents first: what is left to land is short.
    block = block.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
    seed = xxhash.xxh3_64_intdigest(f"{first['source'] is None}:{first['source']}:{first['round']}:{first['block']}")
    sizes = block["size"].to_numpy(np.float64)
    p, rng = block["p"].to_numpy(np.float64), np.random.default_rng(seed)
    block["p"] = drawn(sizes, p, rng) if first["blocks"] <= 1 else fly(sizes, p, rng)
    return block


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id_col, size, source_size, target, copies, taken) for each row of ``docs``."""
    keep = Scratch()
    sizes = keep(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), F.xxhash64(text_of(text_col)).alias("h")), "sizes")
    targets = keep.also(source_targets(sizes, weights, cap)).withColumnRenamed("source", "s")
    n = targets.count()
    joined = (sizes.join(F.broadcast(targets) if n <= 50_000 else targets, F.col("source").eqNullSafe(F.col("s")), "left")).drop("s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = joined.withColumn("rate", rate).withColumn("whole", F.floor(F.col("rate") + 1e-9)).withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))
    blocks = F.ceil(F.col("n") / block).cast("long")
    joined = joined.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("doc_id", "size", "h"), F.col("blocks"))).withColumn("round", F.lit(0))
    open_ = joined.select("doc_id", "source", "size", "source_size", "target", "whole", "p", "blocks", "block", "round")
    schema = open_.schema
    settled = []
    most = targets.agg(F.max("n")).first()[0] or 0
    rounds, b = 1, -(-most // block)
    while b > 1:
        rounds, b = rounds + 1, -(-b // FAN)
    for r in range(rounds):
        flown = keep(open_.groupBy("source", "blocks", "block").applyInPandas(_flight, schema), "flown")
        decided = (F.col("p") == 0) | (F.col("p") == 1)
        settled.append(flown.where(decided))
        open_ = flown.where(~decided).withColumn("blocks", F.ceil(F.col("blocks") / FAN).cast("long")).withColumn("block", F.floor(F.col("block") / FAN).cast("long")).withColumn("round", F.lit(r + 1))
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    copies = F.col("whole") + F.col("p").cast("long")
    return keep.result(out.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken")), "mix")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``.

    Texts are shuffled once, by id and size; rows that share both share their copies, and the first ones by the hash of the
    text get what does not divide.
    """
    text = options.get("text_col", "text")
    key = lambda size: F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("none")), size).alias("_mix_key")
    taken = mix_sources(docs, id_col=id_col, **options).groupBy(key(F.col("size"))).agg(F.sum("copies").alias("_mix_copies"), F.count("*").alias("_mix_rows")).where("_mix_copies > 0")
    joined = docs.select("*", key(word_count(text))).join(taken, "_mix_key")
    # One key of the join and the window: the rows are dealt out once.
    place = F.row_number().over(Window.partitionBy("_mix_key").orderBy(F.xxhash64(text)))
    own = F.floor(F.col("_mix_copies") / F.col("_mix_rows")) + (F.col("_mix_place") <= F.col("_mix_copies") % F.col("_mix_rows")).cast("long")
    joined = joined.withColumn("_mix_place", place).withColumn("_mix_own", own).where("_mix_own > 0")
    return joined.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_own")))).select(*docs.columns)
