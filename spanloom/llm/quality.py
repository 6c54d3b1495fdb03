"""Quality rules with robust multivariate outliers. DataFrame functions only.

Base rules count words, symbols, repeated lines and words in repeated three-word windows of every whole text. Texts
that pass them are held against their language and source: the minimum covariance determinant of each group's transformed
statistics (log of the mean word length; roots of the shares of symbols, repeated lines and repeated words) is
sought by concentration steps, each of which refits mean and covariance to the ``(n + p + 1) / 2`` texts of the group that
are nearest by the last fit. Three starts (medians with median absolute deviations, medians with the added deviations alone,
mean and covariance) take steps until the determinant no longer falls; of all fits the one with the smallest is kept. A text
whose squared Mahalanobis distance from it is above ``CUTOFF``, the 0.999 quantile of the chi-squared distribution with four
degrees of freedom, goes.

A small group cannot tell its own covariance: each group's fit is shrunk towards the medians and median absolute deviations
of all texts, which count as ``PRIOR`` texts of the group, so that the influence falls steadily as the group grows. Every
statistic has a variance of its own added, so that a group whose texts have no symbols at all does not reject the first one that
has some; it is small enough for each statistic to reject a text by itself. Statistics are rounded to
1/1024 and summed as integers; distances are ranked in logarithmic bins, a core ends with a whole bin: reruns agree whatever the partitioning.

Cost: texts are read once; all later passes run on the table of statistics, and groups are only ever summed, so one source
may hold any share of the rows.

Defined results: null and blank texts have no words and fail the base rules; a null language or source counts as an
empty one; rows with null or equal ids are judged each by itself; an empty table gives an empty result; other columns are
not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import SPACE, Scratch, join_bounded, stored, text_of

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Added standard deviations of the four statistics; what corrects the spread of the nearest half (four normal variables);
#: the squared distance beyond which texts go; how many texts of a group the common prior counts for.
FLOORS, SPREAD, CUTOFF, PRIOR = (0.1, 0.04, 0.18, 0.15), 2.109, 18.467, 20
#: A start goes on while a step lowers its log determinant by more than this.
FALL = 1e-3
SCALE, DIMS = 1024, 4
PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]
SUMS = ["n", *[f"s{i}" for i in range(DIMS)], *[f"q{i}{j}" for i, j in PAIRS]]
#: Bits of a packed window that hold its place; longer texts are sorted unpacked.
PLACE = 22


def _trimmed_words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with _words, n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words."""
    df = docs.withColumn("_t", text_of(text_col)).withColumn("_w", _trimmed_words(F.col("_t"))).withColumn("n_words", F.size("_w").cast("long"))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    df = df.withColumn("_l", lines)
    mask = (1 << PLACE) - 1
    at = lambda i: F.col("_w")[i]
    # Each three-word window as a hash whose low bits are its place: equal windows stand together once sorted.
    packed = F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long")))
    short = F.col("n_words").between(3, mask)
    df = df.withColumn("_s", F.when(short, F.sort_array(packed)))
    place = lambda x: x.bitwiseAND(F.lit(mask)).cast("int")
    bits = lambda x: x.bitwiseAND(F.lit(~mask))
    # Windows that share their bits with a neighbour, in runs of equal bits.
    df = df.withColumn("_r", F.filter("_s", lambda x, i: ((i > 0) & (bits(x) == bits(F.get("_s", i - 1)))) | F.coalesce(bits(x) == bits(F.get("_s", i + 1)), F.lit(False))))

    def other(x: Column, y: Column) -> Column:
        """Equal bits of different windows."""
        a, b = place(x), place(y)
        return (bits(x) == bits(y)) & ((at(a) != at(b)) | (at(a + 1) != at(b + 1)) | (at(a + 2) != at(b + 2)))

    # A run whose neighbours are all equal windows holds one window; a text with any other run is sorted by the windows themselves.
    clash = F.size(F.filter("_r", lambda x, i: (i > 0) & other(x, F.get("_r", i - 1)))) > 0
    df = df.withColumn("_full", (F.col("n_words") > mask) | clash)
    full = F.array_sort(F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.struct(F.concat_ws(" ", at(i), at(i + 1), at(i + 2)).alias("g"), i.alias("i"))))
    df = df.withColumn("_f", F.when(F.col("_full"), full))
    long_twice = F.transform(F.filter("_f", lambda x, i: F.coalesce(F.get("_f", i - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get("_f", i + 1)["g"] == x["g"], F.lit(False))), lambda x: x["i"])
    places = F.sort_array(F.when(F.col("_full"), long_twice).otherwise(F.transform("_r", place)))
    df = df.withColumn("_p", F.coalesce(places, F.array().cast("array<int>")))
    covered = F.aggregate("_p", F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")), lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])
    return df.select(
        *docs.columns,
        "n_words",
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )


def _vector(words: Column) -> list[Column]:
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    raw = [F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(words, F.lit(1))), share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")]
    return [F.round(x * SCALE).cast("long") for x in raw]


def _sums() -> list[Column]:
    """Count, sums and sums of products of the statistics."""
    return [F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(DIMS)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in PAIRS]]


def _factored(fit: DataFrame) -> DataFrame:
    """(g, start, m*, l*, logdet) from means m* and covariances c*, in units of 1: l* is the lower Cholesky factor."""
    for i in range(DIMS):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            fit = fit.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    logdet = sum((2 * F.log(F.col(f"l{i}{i}")) for i in range(DIMS)), F.lit(0.0))
    return fit.withColumn("logdet", logdet).select("g", "start", *[f"m{i}" for i in range(DIMS)], *[f"l{i}{j}" for i, j in PAIRS], "logdet")


def _fit(sums: DataFrame, spread: float, prior: DataFrame) -> DataFrame:
    """The fit to the rows that ``sums`` (g, start, n, s*, q*) adds up, with the one row of ``prior`` as ``PRIOR`` rows more."""
    both = sums.join(F.broadcast(prior), F.lit(True))
    own, more = F.col("n") / (F.col("n") + PRIOR), PRIOR / (F.col("n") + PRIOR)
    middle = [(own * F.col(f"s{i}") / F.col("n") / SCALE + more * F.col(f"m0{i}")).alias(f"m{i}") for i in range(DIMS)]
    cov = lambda i, j: (F.col(f"q{i}{j}") / F.col("n") - (F.col(f"s{i}") / F.col("n")) * (F.col(f"s{j}") / F.col("n"))) / SCALE**2 * spread
    return _factored(both.select("g", "start", *middle, *[(own * cov(i, j) + (more * F.col(f"v0{i}") + FLOORS[i] ** 2 if i == j else 0)).alias(f"c{i}{j}") for i, j in PAIRS]))


def _medians(rows: DataFrame, of: list[Column], name: str) -> DataFrame:
    """(g, name0, ...): the lower medians of whole numbers in each group, by counts of their values."""
    values = rows.select("g", F.posexplode(F.array(*of)).alias("i", "v")).groupBy("g", "i", "v").agg(F.count("*").alias("c"))
    by = Window.partitionBy("g", "i")
    upper = values.withColumn("upto", F.sum("c").over(by.orderBy("v"))).withColumn("all", F.sum("c").over(by)).where(2 * F.col("upto") >= F.col("all"))
    return upper.groupBy("g").agg(*[F.min(F.when(F.col("i") == i, F.col("v"))).alias(f"{name}{i}") for i in range(DIMS)])


def _spreads(points: DataFrame, groups: int, keep: Scratch) -> DataFrame:
    """(g, e*, d*): medians and median absolute deviations of each group."""
    middle = keep(_medians(points, [F.col(f"x{i}") for i in range(DIMS)], "e"), "medians")
    off = join_bounded(points, middle, ["g"], "inner", groups)
    return keep(middle.join(_medians(off, [F.abs(F.col(f"x{i}") - F.col(f"e{i}")) for i in range(DIMS)], "d"), "g"), "medians")


def _variance(i: int, mad: float) -> Column:
    return F.pow(1.4826 * mad * F.col(f"d{i}") / SCALE, F.lit(2.0))


def _starts(points: DataFrame, groups: int, prior: DataFrame, keep: Scratch) -> DataFrame:
    both = _spreads(points, groups, keep)
    centre = [(F.col(f"e{i}") / SCALE).alias(f"m{i}") for i in range(DIMS)]
    diagonal = lambda mad: [(_variance(i, mad) + FLOORS[i] ** 2 if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in PAIRS]
    robust = [_factored(both.select("g", F.lit(k).alias("start"), *centre, *diagonal(mad))) for k, mad in ((0, 1.0), (1, 0.0))]
    return robust[0].unionByName(robust[1]).unionByName(_fit(points.groupBy("g").agg(*_sums()).withColumn("start", F.lit(2)), 1.0, prior))


def _core(points: DataFrame, fits: DataFrame, groups: int, prior: DataFrame) -> DataFrame:
    """For each of ``fits``, the fit to the half of its group that is nearest by it. One pass over the points."""
    near = _measured(points, fits, groups).withColumn("bin", F.floor(F.log2(1 + F.col("d2")) * 64).cast("int"))
    by = Window.partitionBy("g", "start")
    bins = near.groupBy("g", "start", "bin").agg(*_sums()).withColumn("before", F.sum("n").over(by.orderBy("bin")) - F.col("n")).withColumn("all", F.sum("n").over(by))
    core = bins.where(F.col("before") < F.floor((F.col("all") + DIMS + 1) / 2))
    return _fit(core.groupBy("g", "start").agg(*[F.sum(c).alias(c) for c in SUMS]), SPREAD, prior)


def _least_fit(points: DataFrame, groups: int, keep: Scratch) -> DataFrame:
    """(g, m*, l*): the fit of the smallest determinant of each group, over all starts and steps."""
    common = _spreads(points.withColumn("g", F.lit("all")), 1, keep)
    prior = keep(common.select(*[(F.col(f"e{i}") / SCALE).alias(f"m0{i}") for i in range(DIMS)], *[_variance(i, 1.0).alias(f"v0{i}") for i in range(DIMS)]), "prior")
    fits = [keep(_core(points, keep(_starts(points, groups, prior, keep), "starts"), groups, prior), "fit")]
    while fits[-1].count():
        last = fits[-1].select("g", "start", F.col("logdet").alias("was"))
        # Stored before it is filtered: a condition on logdet would be pushed down with all it is made of.
        new = keep(_core(points, fits[-1], groups, prior), "fit")
        fits.append(keep(new.join(last, ["g", "start"]).where(F.col("logdet") < F.col("was") - FALL).drop("was"), "fit"))
    place = F.row_number().over(Window.partitionBy("g").orderBy("logdet", "start"))
    return keep(reduce(DataFrame.unionByName, fits).withColumn("place", place).where("place = 1").drop("place", "start", "logdet"), "fit")


def _measured(rows: DataFrame, fit: DataFrame, groups: int) -> DataFrame:
    """The rows with their squared distance d2 by the fit of their group, or by each of its starts."""
    df = join_bounded(rows, fit, ["g"], "inner", groups * 3)
    for i in range(DIMS):
        y = F.col(f"x{i}") / SCALE - F.col(f"m{i}")
        for k in range(i):
            y = y - F.col(f"l{i}{k}") * F.col(f"y{k}")
        df = df.withColumn(f"y{i}", y / F.col(f"l{i}{i}"))
    return df.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(DIMS)), F.lit(0.0))).select(*rows.columns, *[c for c in fit.columns if c == "start"], "d2")


def quality(docs: DataFrame, cutoff: float = CUTOFF, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id_col, counts, base_failed, distance, kept, text_hash) for each row of ``docs``."""
    keep = Scratch()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), F.col(text_col).alias("text"))
    counts = base_counts(rows).withColumn("text_hash", F.xxhash64(text_of())).drop("text")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    group = F.concat_ws(":", F.length("lang"), "lang", "source").alias("g")
    stats = keep(counts.withColumn("base_failed", failed).select("*", group, *[x.alias(f"x{i}") for i, x in enumerate(_vector(F.col("n_words")))]), "stats")
    sound = stats.where("not base_failed")
    groups = sound.select("g").distinct().count()
    fit = _least_fit(keep(sound.select("g", *[f"x{i}" for i in range(DIMS)]), "points"), groups, keep)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept", "text_hash"]
    good = _measured(sound, fit, groups).withColumn("distance", F.col("d2")).withColumn("kept", F.col("d2") <= cutoff).select(F.col("id").alias(id_col), *names)
    bad = stats.where("base_failed").withColumn("distance", F.lit(None).cast("double")).withColumn("kept", F.lit(False)).select(F.col("id").alias(id_col), *names)
    return keep.result(good.unionByName(bad), "quality")


def quality_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    judged = stored(quality(docs, id_col=id_col, text_col=text_col, **options).where("not kept").select(F.col(id_col).alias("_q_id"), F.col("text_hash").alias("_q_hash")).distinct(), "rejected")
    n = judged.count()
    on = F.col(id_col).eqNullSafe(F.col("_q_id")) & (F.xxhash64(text_of(text_col)) == F.col("_q_hash"))
    return docs.join(F.broadcast(judged) if n <= 200_000 else judged, on, "left_anti")
