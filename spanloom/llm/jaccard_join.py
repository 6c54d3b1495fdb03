"""N-gram Jaccard self-join of documents by chosen paths (Christiani, Pagh and Sivertsen, 2018).

Documents with the same set of five-word shingles form one class, represented by its smallest doc_id. Each of
several runs sends a class down the paths named by its sampled shingles: shingle ``s`` of a set of ``n`` is sampled
if a hash of the run, the path so far and ``s`` is below ``1 / (threshold * n)``, so that similar sets expect to
share at least one path. Buckets of up to ``bucket`` classes are compared by brute force. Of larger ones, those in which
many pairs are similar are compared in blocks of ``BLOCK``, once for all runs that found the same group; the others are split
again on newly sampled shared shingles, and what is still larger at the last depth is compared in blocks too, so no
bucket is capped. Every link is verified on the whole shingle sets.

Similar sets share most of their paths, sets with a line in common a few. A class leaves the large buckets if fewer than
``least_shared`` of its paths end in them (a pair that shares more has one in a small bucket), and it is not compared
at all if fewer of its paths meet others.

Recall: sets at the threshold expect at least one shared sample a depth, and a path that is split again can end at each of
them: a run finds a pair whose buckets are all large with probability ``s(depth)``, where ``s(0) = 1`` and
``s(d) = 1 - exp(-s(d - 1))``. ``runs_for`` repeats runs until half of the misses that the target recall allows are left at the
last depth; ``least_shared`` keeps to the other half and what the runs leave of theirs.

Defined results: null, empty and blank texts have no shingles, are a class of their own each and link with nothing;
texts of one to four words are one shingle, their whole word sequence; rows with a null id come back with null class
and zero links; repeated rows come back as often as they came; rows of one id with different texts are different documents,
told apart by the hashes of their texts; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import HOT_SHARE, Scratch, drop_stored, join_bounded, join_split, stored
from spanloom.llm.components import connected_components
from spanloom.llm.kernels import mix, shingle_sets

THRESHOLD, TARGET_RECALL, BUCKET, DEPTH, BLOCK = 0.8, 0.9999, 256, 3, 1024
#: Keys of at most 16 bytes that are broadcast to find their texts or rows; more are shuffled with these.
KEYS = 500_000
#: Values that are intersected at once, about.
VALUES = 4_000_000
#: Large buckets with at least this share of similar pairs are not split: comparing all pairs is at most so much more than the links.
DENSE, SEEN = 0.25, 16


def _found(depth: int) -> float:
    """A run misses a pair at the threshold with probability exp of less this: no shared sample leads to a shared leaf."""
    found = 1.0
    for _ in range(depth - 1):
        found = 1 - math.exp(-found)
    return found


def runs_for(target_recall: float, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold, split at every depth, is missed with probability below ``1 - target_recall``."""
    return math.ceil(math.log(1 - target_recall) / -_found(depth))


def least_shared(target_recall: float, runs: int, depth: int = DEPTH) -> int:
    """Keys of the first depth that a pair at the threshold shares, unless it is one of the misses that the runs leave to the target.

    What it shares is a sum of independent events that are expected ``runs`` times at least: fewer are no likelier than by Poisson.
    """
    left, k = 1 - target_recall - math.exp(-_found(depth) * runs), 0
    term = math.exp(-runs)
    while left >= term:
        left -= term
        k += 1
        term *= runs / k
    return max(k, 1)


def _sampled(doc: np.ndarray, grams: np.ndarray, sizes: np.ndarray, seed: np.ndarray | np.uint64, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(document index, path key) of the sampled shingles."""
    v = mix(grams ^ seed)
    limit = np.minimum(1.0 / (threshold * np.maximum(sizes, 1)), 1.0) * 2.0**64
    hit = v.astype(np.float64) <= limit[doc]
    return doc[hit], mix(v[hit] + np.uint64(1))


def _lists(doc: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    order = np.argsort(doc, kind="stable")
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[order], np.arange(n + 1)), pa.int32()), pa.array(values[order].view(np.int64)))


def _signatures(threshold: float, runs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                offsets, grams = shingle_sets(part.column(2))
                sizes = np.diff(offsets)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                seals = np.array([np.frombuffer(xxhash.xxh3_128_digest(grams[a:b].tobytes()), np.int64) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]).reshape(-1, 2)
                with np.errstate(over="ignore"):
                    got = [_sampled(doc, grams, sizes, mix(np.array([r + 1], np.uint64))[0], threshold) for r in range(runs)]
                keys = _lists(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]), len(sizes))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(seals[:, 0]), pa.array(seals[:, 1]), pa.array(sizes.astype(np.int64)), keys], names=["id", "h", "s1", "s2", "n", "keys"])

    return run


def _children(threshold: float):
    """(rep, text, paths) to rows of (key, rep, n): the next keys of each path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                offsets, grams = shingle_sets(part.column(1))
                paths = [np.asarray(p, np.int64).view(np.uint64) for p in part.column(2).to_pylist()]
                ids = part.column(0).to_numpy()
                keys, reps, ns = [], [], []
                for i, own in enumerate(paths):
                    s = grams[offsets[i] : offsets[i + 1]]
                    for p in own:
                        with np.errstate(over="ignore"):
                            _, k = _sampled(np.zeros(len(s), np.int64), s, np.array([len(s)]), mix(np.array([p], np.uint64))[0], threshold)
                        keys.append(k)
                        reps.append(np.full(len(k), ids[i]))
                        ns.append(np.full(len(k), len(s), np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(reps)), pa.array(np.concatenate(ns))], names=["key", "rep", "n"])

    return run


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, text, leaves) to (rep, leaves, shingles)."""
    for batch in batches:
        for start in range(0, batch.num_rows, 200):
            part = batch.slice(start, 200)
            offsets, grams = shingle_sets(part.column(1))
            sets = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(grams.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), sets], names=["rep", "leaves", "shingles"])


def _products(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets (each of distinct values), by products of 0/1 matrices of shared values."""
    n = len(sets)
    out = np.zeros((n, n), np.int32)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values, where, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    place = np.cumsum(shared) - 1
    keep = shared[where]
    owner, column = owner[keep], place[where[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    step = max(1, 4_000_000 // n)
    for low in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(column, [low, low + step])
        block = np.zeros((n, min(step, int(shared.sum()) - low)), np.float32)
        block[owner[a:b], column[a:b] - low] = 1
        out += (block @ block.T).astype(np.int32)
    return out


def _common(sets: list[np.ndarray], values: int = VALUES) -> np.ndarray:
    """Sizes of all intersections of the sets, by shares of about ``values`` values to bound memory."""
    k = sum(map(len, sets)) // values + 1
    if k == 1:
        return _products(sets)
    return sum(_products([s[s % k == r] for s in sets]) for r in range(k))


def _compare(leaf: int, cross: bool, reps: np.ndarray, blocks: np.ndarray, leaves: list[np.ndarray], sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rep, links that this leaf owns, root): a link belongs to the smallest leaf that both classes are in."""
    reps, first = np.unique(reps, return_index=True)
    blocks, leaves, sets = blocks[first], [leaves[i] for i in first], [sets[i] for i in first]
    sizes = np.array([len(s) for s in sets])
    inter = _common(sets)
    # Integer arithmetic in thousandths: no rounding decides whether a pair is at the threshold.
    link = inter * 1000 >= round(threshold * 1000) * (sizes[:, None] + sizes[None, :] - inter)
    np.fill_diagonal(link, False)
    if cross:
        link &= blocks[:, None] != blocks[None, :]
    earlier = [x[x < leaf] for x in leaves]
    owned = link & (_common(earlier) == 0) if sum(map(len, earlier)) else link
    root = np.arange(len(reps))
    while True:
        low = np.where(link, root[None, :], len(reps)).min(axis=1, initial=len(reps))
        new = np.minimum(root, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    some = link.any(axis=1)
    return reps[some], owned.sum(axis=1)[some], reps[root[some]]


def _brute(threshold: float):
    """Rows sorted by (leaf, i, j): compares each group as it ends; a group may span batches."""

    def flush(key, held):
        reps = np.concatenate([b.column("rep").to_numpy() for b in held])
        if len(reps) < 2:
            return None
        blocks = np.concatenate([b.column("block").to_numpy() for b in held])
        parts = {}
        for name in ("leaves", "shingles"):
            parts[name] = []
            for b in held:
                c = b.column(name)
                flat, off = c.flatten().to_numpy(), c.offsets.to_numpy()
                parts[name] += [flat[x - off[0] : y - off[0]] for x, y in zip(off[:-1], off[1:], strict=True)]
        got = _compare(key[0], key[1] != key[2], reps, blocks, parts["leaves"], parts["shingles"], threshold)
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in got], names=["rep", "links", "root"]) if len(got[0]) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("leaf", "i", "j")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                now = tuple(int(x) for x in keys[:, a])
                if now != key:
                    if held and (out := flush(key, held)):
                        yield out
                    key, held = now, []
                held.append(batch.slice(a, b - a))
        if held and (out := flush(key, held)):
            yield out

    return run


def _dense(large: DataFrame, classes: DataFrame) -> DataFrame:
    """Keys of the buckets in (key, rep) in which a ``DENSE`` share of the pairs of up to ``SEEN`` classes have half of their keys in common."""
    drawn = F.array_distinct(F.array(*[F.min_by("rep", F.xxhash64("rep", "key", F.lit(i))) for i in range(SEEN)]))
    seen = large.groupBy("key").agg(drawn.alias("reps")).select("key", F.explode("reps").alias("rep"))
    seen = join_bounded(classes.select("rep", "keys"), seen, ["rep"], "inner", seen.count()).groupBy("key").agg(F.collect_list("keys").alias("k"))
    alike = "aggregate(k, 0, (s, a) -> s + size(filter(k, b -> 2 * size(array_intersect(a, b)) >= greatest(size(a), size(b)))) - 1)"
    return seen.where(F.expr(f"{alike} >= {DENSE} * size(k) * (size(k) - 1)")).select("key")


def _merged(rows: DataFrame, keep: Scratch) -> DataFrame:
    """(leaf, c, rep) of large buckets (key, rep): those with the same first class are one if that is at most twice the largest."""
    sums = rows.groupBy("key").agg(F.min("rep").alias("a"), F.count("*").alias("c"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(7))).alias("y"))
    firsts = keep(sums.groupBy("a", "c", "x", "y").agg(F.min("key").alias("key")).select("key", "a", "c"), "firsts")
    count = firsts.count()
    named = keep(join_bounded(rows, firsts, ["key"], "inner", count), "named")
    groups = named.groupBy("a", "rep").agg(F.lit(1)).groupBy("a").agg(F.count("*").alias("all"))
    groups = groups.join(firsts.groupBy("a").agg(F.max("c").alias("most"), F.min("key").alias("leaf")), "a").withColumn("one", F.expr("all <= 2 * most"))
    named = join_bounded(named, groups, ["a"], "inner", count)
    one = named.where("one").select("leaf", F.col("all").alias("c"), "rep").distinct()
    return one.unionByName(named.where("not one").select(F.col("key").alias("leaf"), "c", "rep"))


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL, bucket: int = BUCKET, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, rep_id, class_id, n_links, text_hash, rep_hash, class_hash) for each row of ``docs``.

    ``rep_id``: the smallest id with the same shingle set; ``n_links``: how many other shingle sets are at least
    ``threshold`` similar; ``class_id``: the smallest id of the connected group of equal and linked documents. The hashes
    of the texts of the row, of ``rep_id`` and of ``class_id`` tell rows apart that share an id.
    """
    spark = docs.sparkSession
    keep = Scratch()
    # Half of the misses allowed are left to what is dropped for having few keys in common.
    runs = runs_for((1 + target_recall) / 2, depth)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    texts = rows.where("id is not null")
    seals = keep(texts.select("id", "h", "text").mapInArrow(_signatures(threshold, runs), "id long, h long, s1 long, s2 long, n long, keys array<long>"), "seals")
    # Equal sets have equal keys; empty sets are all equal, but no copies of each other.
    equal = seals.where("n > 0").groupBy("s1", "s2").agg(F.min(F.struct("id", "h")).alias("r"), F.first("n").alias("n"), F.count("*").alias("c"), F.first("keys").alias("keys"))
    # Numbered as they are written: the numbers are those of the stored table.
    classes = keep(equal.select(F.monotonically_increasing_id().alias("rep"), "s1", "s2", "n", "c", F.col("r.id").alias("rep_id"), F.col("r.h").alias("rep_hash"), "keys"), "classes")
    sources = texts.withColumnsRenamed({"id": "rep_id", "h": "rep_hash"})
    repeated = keep(seals.groupBy(F.col("id").alias("rep_id"), F.col("h").alias("rep_hash")).agg(F.count("*").alias("rows")).where("rows > 1").drop("rows"), "repeated")
    n_repeated = repeated.count()

    def with_text(wanted: DataFrame, count: int, limit: int) -> DataFrame:
        """``wanted`` (rep, ...) with the text of each class, which is the only row of its id and hash or one of equal rows."""
        named = wanted.join(classes.select("rep", "rep_id", "rep_hash"), "rep")
        # Where the keys are few enough, texts of other classes stay where they are.
        held = join_bounded(sources, named.select("rep_id", "rep_hash"), ["rep_id", "rep_hash"], "left_semi", count, KEYS) if limit < count <= KEYS else sources
        if not n_repeated:
            return join_bounded(held, named, ["rep_id", "rep_hash"], "inner", count, limit)
        again = join_bounded(named, repeated, ["rep_id", "rep_hash"], "left_semi", n_repeated)
        once = join_bounded(named, repeated, ["rep_id", "rep_hash"], "left_anti", n_repeated)
        met = [join_bounded(held, x, ["rep_id", "rep_hash"], "inner", count, limit) for x in (once, again)]
        return met[0].unionByName(met[1].dropDuplicates(["rep"]))

    least = least_shared(target_recall, runs, depth)
    level = stored(classes.select(F.explode("keys").alias("key"), "rep", "n"), "paths")
    leaf_rows, whole, used = [], [], [level]
    # A class with no other of a size that allows the threshold leaves its bucket (lossless).
    near = F.expr(f"filter(m, x -> exists(m, y -> y.rep != x.rep and least(x.n, y.n) * 1000 >= {round(threshold * 1000)} * greatest(x.n, y.n)))")

    def parts(rows: DataFrame, weight: int) -> DataFrame:
        """Adds the buckets of ``rows`` (key, rep, n) that are compared as they are to the leaves; the rows of larger ones."""
        hot = stored(rows.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > bucket), "hot")
        # Where their keys are few enough to broadcast, only rows of small buckets are shuffled.
        few, total = hot.count() <= KEYS, rows.count()
        often = F.col("c") > F.lit(total * HOT_SHARE)
        rest = rows.join(F.broadcast(hot if few else hot.where(often)).select("key"), "key", "left_anti")
        rest = rest if few else rest.join(hot.select("key"), "key", "left_anti")
        small = rest.groupBy("key").agg(F.collect_list(F.struct("n", "rep")).alias("m")).where("size(m) > 1")
        small = small.select("key", F.array_sort(F.transform(near, lambda x: x["rep"])).alias("m")).where("size(m) > 1")
        # Buckets of the same classes are compared once; ``w``: how many keys of the first depth they stand for.
        leaf_rows.append(stored(small.groupBy("m").agg(F.min("key").alias("leaf"), (F.count("*") * weight).alias("w")), "leaves"))
        large = rows.join(F.broadcast(hot.select("key")), "key", "left_semi") if few else join_split(rows, hot, "key", "c", total, "left_semi")
        used.extend([hot, leaf_rows[-1], stored(large, "large")])
        return used[-1]

    large = parts(level, 1)
    wide = large.groupBy("rep").agg(F.count("*").alias("w"))
    # A pair that shares ``least`` keys and none of a small bucket shares them all in large ones: other classes leave these,
    # which may be small without them.
    risky = wide.where(F.col("w") >= least).select("rep")
    level = stored(join_bounded(large, risky, ["rep"], "left_semi", risky.count()), "paths")
    used.append(level)
    large = parts(level, 0)
    for d in range(1, depth + 1):
        if d == depth:
            whole.append(large)
            break
        dense = keep(_dense(large, classes), "dense")
        n_dense = dense.count()
        whole.append(join_bounded(large, dense, ["key"], "left_semi", n_dense))
        again = stored(join_bounded(large, dense, ["key"], "left_anti", n_dense).groupBy("rep").agg(F.collect_set("key").alias("paths")), "again")
        used.append(again)
        count = again.count()
        if not count:
            break
        level = stored(with_text(again, count, 50_000).select("rep", "text", "paths").mapInArrow(_children(threshold), "key long, rep long, n long"), "paths")
        used.append(level)
        large = parts(level, 0)
    leaves, heavy = leaf_rows[0], whole[0]
    for more in leaf_rows[1:]:
        leaves = leaves.unionByName(more)
    for more in whole[1:]:
        heavy = heavy.unionByName(more)

    # A class that has too few keys in common with whatever others there are leaves the small ones.
    small = leaves.select("leaf", "w", F.explode("m").alias("rep"))
    held = small.select("rep", "w").unionByName(wide).groupBy("rep").agg(F.sum("w").alias("w")).where(F.col("w") >= least).select("rep")
    held = keep(held, "held")
    small = join_bounded(small.select("leaf", "rep"), held, ["rep"], "left_semi", held.count())
    small = small.groupBy("leaf").agg(F.array_sort(F.collect_set("rep")).alias("m")).where("size(m) > 1")
    # Leaves with the same first class are mostly one group seen in several runs: they are compared as one where that is no
    # more than twice the largest of them. Every pair of a leaf is a pair of the group.
    groups = small.groupBy(F.col("m")[0].alias("a")).agg(F.collect_list(F.struct("leaf", "m")).alias("own"), F.max(F.size("m")).alias("most"))
    groups = groups.withColumn("all", F.array_distinct(F.flatten("own.m")))
    merged = F.when(F.size("all") <= 2 * F.col("most"), F.array(F.struct(F.array_min("own.leaf").alias("leaf"), F.col("all").alias("m")))).otherwise(F.col("own"))
    small = groups.select(F.explode(merged).alias("x")).select("x.leaf", F.size("x.m").cast("long").alias("c"), F.explode("x.m").alias("rep"))
    pairs = stored(small.unionByName(_merged(keep(heavy.select("key", "rep"), "heavy"), keep)), "pairs")
    for t in used:
        drop_stored(t)
    involved = pairs.groupBy("rep").agg(F.collect_set("leaf").alias("leaves"))
    sets = with_text(involved, pairs.select("rep").distinct().count(), 100_000).select("rep", "text", "leaves").mapInArrow(_with_sets, "rep long, leaves array<long>, shingles array<long>")
    sizes = pairs.where(F.col("c") > bucket).select("leaf", "c").distinct()
    placed = sets.select("rep", "leaves", "shingles", F.explode("leaves").alias("leaf")).join(F.broadcast(sizes) if sizes.count() <= 50_000 else sizes, "leaf", "left")
    m = F.ceil(F.coalesce(F.col("c"), F.lit(1)) / max(bucket, BLOCK)).cast("long")
    placed = placed.withColumn("m", m).withColumn("block", F.pmod(F.xxhash64("rep"), "m"))
    placed = placed.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    placed = placed.select("leaf", F.least("o", "block").alias("i"), F.greatest("o", "block").alias("j"), "block", "rep", "leaves", "shingles")
    found = placed.repartition("leaf", "i", "j").sortWithinPartitions("leaf", "i", "j").mapInArrow(_brute(threshold), "rep long, links long, root long")
    found = keep(found, "links")
    drop_stored(pairs)
    components = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("rep").agg(F.sum("links").alias("n_links")).join(components.select(F.col("node").alias("rep"), "component"), "rep", "left")
    linked = keep(linked.join(classes.select("rep", "rep_id", "rep_hash"), "rep"), "groups")
    firsts = linked.groupBy("component").agg(F.min(F.struct("rep_id", "rep_hash")).alias("top"))
    named = linked.select("rep", "n_links", "component").join(firsts, "component").select("rep", "n_links", "top")
    of_class = classes.select("rep", "s1", "s2", "c", "rep_id", "rep_hash").join(named, "rep", "left")
    of_class = of_class.select("s1", "s2", "c", "rep_id", "rep_hash", F.coalesce("top.rep_id", "rep_id").alias("class_id"), F.coalesce("top.rep_hash", "rep_hash").alias("class_hash"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    of_class = keep(of_class, "classes")
    out = join_split(seals.where("n > 0").select("id", "h", "s1", "s2"), of_class, ["s1", "s2"], "c", seals.count())
    names = ["id", "h", "rep_id", "rep_hash", "class_id", "class_hash", "n_links"]
    alone = lambda df, h: df.select("id", "h", F.col("id").alias("rep_id"), F.col("h").alias("rep_hash"), F.col("id").alias("class_id"), F.col("h").alias("class_hash"), F.lit(0).cast("long").alias("n_links"))
    out = out.select(*names).unionByName(alone(seals.where("n = 0"), "h")).unionByName(alone(rows.where("id is null"), "h"))
    return keep.result(out.select(F.col("id").alias(id_col), "rep_id", "class_id", "n_links", F.col("h").alias("text_hash"), "rep_hash", "class_hash"), "near")


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without those that equal or resemble one of a smaller (id, text): one row of each group stays.

    Rows with a null id stay, as do all empty and blank texts; of rows with equal id and text one stays.
    """
    found = stored(jaccard_join(docs, id_col=id_col, text_col=text_col, **options), "found")
    key = [F.col(id_col).alias("_n_id"), F.col("text_hash").alias("_n_h")]
    gone = found.where(F.col(id_col).isNotNull() & ((F.col(id_col) != F.col("class_id")) | (F.col("text_hash") != F.col("class_hash")))).select(*key)
    again = found.where(F.col(id_col).isNotNull()).groupBy(*key).agg(F.count("*").alias("_n_c")).where("_n_c > 1").select("_n_id", "_n_h")
    gone, again = stored(gone.distinct(), "gone"), stored(again, "again")
    on = (F.col(id_col) == F.col("_n_id")) & (F.xxhash64(text_col) == F.col("_n_h"))
    small = lambda t: F.broadcast(t) if t.count() <= 200_000 else t
    kept = docs.join(small(gone), on, "left_anti")
    if again.isEmpty():
        return kept
    again = small(again)
    repeated = kept.join(again, on, "left_semi").withColumn("_n_h", F.xxhash64(text_col)).dropDuplicates([id_col, "_n_h"]).drop("_n_h")
    return kept.join(again, on, "left_anti").unionByName(repeated)
