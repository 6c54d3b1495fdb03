"""Toxicity by class-conditional Kneser-Ney models of characters within words.

Two models, of toxic and of ordinary text, give each character of a word after the four before it (starts and ends of
words are characters too). Their counts come from a bounded sample of labelled documents. What a class has not seen
enough falls back on one shared distribution after three characters: continuation counts, the number of different
characters that come before, over all documents, labelled or not. Because both models share it, an expression that
neither class has seen tells nothing, and a rare one little.

A toxic text is mostly ordinary words. Beside the length-normalised difference of the two log-likelihoods, its evidence is
thus the log-likelihood ratio of a mixture, in which each word comes from the toxic model with a small share and else
from the ordinary one. A logistic curve of these two, fitted on sampled documents that the model they are scored with has
not seen (``FOLDS`` folds), gives a score of 0 to 1; of the shares in ``SHARES`` the one with the least loss on folds that the
curve has not seen is taken. Labels of held-out documents are never read; labels, lang, source and doc_id are no inputs of a score.

Bounds: ``sample`` documents a class, those with the smallest hashes of their ids, and of these as many as hold ``chars``
characters. Continuation counts are kept for contexts that the sample has.

Defined results: null and blank texts have evidence 0 and still get a score; without labels of both classes the score is
the smoothed share of toxic labels; null doc_ids are scored and never held out; documents with more than one label use the
largest, labelled ids with several texts the smallest text; repeated rows get a row each; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import Scratch, text_of
from spanloom.llm.kernels import gram_hashes, mix, split_words

ORDER, SAMPLE, CUT = 5, 2500, 0.7
#: Characters a word may continue with, for the uniform share at the end of the fallback.
ALPHABET = 256
#: Characters of the sampled documents of a class; folds of the sample; shares of toxic words to choose from.
SAMPLE_CHARS, FOLDS, SHARES = 12_000_000, 4, (0.1, 0.01, 0.001, 0.0001)
MIXED = [f"mixed{i}" for i in range(len(SHARES))]
SCORED = "id long, evidence double, score double, " + ", ".join(f"{c} double" for c in MIXED)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every character after a start: (place of its word, hashes of 5 characters, their first 4, the last 4, the middle 3)."""
    pad = "\x02" * (ORDER - 1)
    chars = np.frombuffer("".join([f"{pad}{w}\x03" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    start = chars == 2
    word = np.cumsum(start & np.concatenate([[True], ~start[:-1]])) - 1
    codes = mix(chars + np.uint64(1))
    five, four, three = gram_hashes(codes, 5), gram_hashes(codes, 4), gram_hashes(codes, 3)
    at = np.flatnonzero(~start)
    at = at[at >= ORDER - 1]
    return word[at], five[at - 4], four[at - 4], four[at - 3], three[at - 3]


def _clean(word: str) -> str:
    return word.replace("\x02", "\x1a").lower()


def _distinct(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(offsets, distinct words, the word at each place)."""
    offsets, flat = split_words(texts)
    coded = flat.dictionary_encode()
    return offsets, [_clean(w) for w in coded.dictionary.to_pylist()], coded.indices.to_numpy() if len(flat) else np.zeros(0, np.int64)


def _types(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct 5-grams of a task's texts with their last four and middle three characters."""
    held, pending, n = np.zeros((0, 3), np.uint64), [], 0

    def merged() -> np.ndarray:
        rows = np.concatenate([held, *pending])
        return rows[np.unique(rows[:, 0], return_index=True)[1]]

    seen: set[str] = set()
    for batch in batches:
        for low in range(0, batch.num_rows, 1000):
            _, words, _ = _distinct(batch.column(0).slice(low, 1000))
            words = [w for w in words if w not in seen]
            if len(seen) > 300_000:
                seen.clear()
            seen.update(words)
            _, five, _, last, middle = _grams(words)
            pending.append(np.stack([five, last, middle], axis=1))
            n += len(five)
            if n > 1_000_000:
                held, pending, n = merged(), [], 0
    rows = merged().view(np.int64)
    for low in range(0, len(rows), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[low : low + 50_000, c])) for c in range(3)], names=["five", "last", "middle"])


def _counted(words: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 5-grams with their first four, last four and middle three characters, and their counts in either class."""
    parts = []
    for low in range(0, max(len(words), 1), 30_000):
        part = words.iloc[low : low + 30_000]
        word, five, ctx, last, middle = _grams([_clean(w) for w in part["word"]])
        n, toxic = part["n"].to_numpy(np.float64)[word], part["toxic"].to_numpy()[word]
        parts.append(_summed(five, ctx, last, middle, np.stack([n * (toxic == 0), n * (toxic == 1)])))
        if len(parts) == 4:
            parts = [_summed(*(np.concatenate(x, axis=-1) for x in zip(*parts, strict=True)))]
    return _summed(*(np.concatenate(x, axis=-1) for x in zip(*parts, strict=True)))


def _summed(five, ctx, last, middle, counts):
    keys, first, where = np.unique(five, return_index=True, return_inverse=True)
    return keys, ctx[first], last[first], middle[first], np.stack([np.bincount(where, c, len(keys)) for c in counts])


class Model:
    """Differences of the class log-probabilities: of the 5-grams that a class has seen, and of contexts for the others."""

    def __init__(self, words: pd.DataFrame, shared: pd.DataFrame):
        """words: (word, toxic, n). shared: (last, middle, n), continuation counts."""
        keys, ctx, last, middle, counts = _counted(words)
        ctxs, ctx_of = np.unique(ctx, return_inverse=True)
        shared = shared.sort_values("last")
        s_last, s_n = shared["last"].to_numpy(np.int64).view(np.uint64), shared["n"].to_numpy(np.float64)
        order = np.argsort(s_last)
        s_last, s_n, s_mid = s_last[order], s_n[order], shared["middle"].to_numpy(np.int64).view(np.uint64)[order]
        mids, mid_of = np.unique(s_mid, return_inverse=True)
        mid_n, mid_types = np.bincount(mid_of, s_n, len(mids)), np.bincount(mid_of, minlength=len(mids))

        def found(of: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
            if not len(keys):
                return np.zeros(len(of))
            at = np.minimum(np.searchsorted(keys, of), len(keys) - 1)
            return np.where(keys[at] == of, values[at], 0.0)

        d = 0.75
        c, total, kinds = found(last, s_last, s_n), found(middle, mids, mid_n), found(middle, mids, mid_types)
        fallback = np.where(total > 0, (np.maximum(c - d, 0) + d * kinds / ALPHABET) / np.maximum(total, 1), 1 / ALPHABET)
        logs, rests = [], []
        for k in (0, 1):
            c = counts[k]
            once, twice = (c == 1).sum(), (c == 2).sum()
            dk = once / (once + 2 * twice) if once and twice else 0.75
            total = np.bincount(ctx_of, c, len(ctxs))
            rest = np.where(total > 0, np.bincount(ctx_of, np.minimum(c, dk), len(ctxs)) / np.maximum(total, 1e-9), 1.0)
            seen = np.where(total[ctx_of] > 0, np.maximum(c - dk, 0) / np.maximum(total[ctx_of], 1e-9), 0.0)
            logs.append(np.log(seen + rest[ctx_of] * fallback))
            rests.append(np.log(rest))
        self.keys, self.values = keys, (logs[1] - logs[0]).astype(np.float32)
        self.ctxs, self.ctx_values = ctxs, (rests[1] - rests[0]).astype(np.float32)

    def evidence(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(difference, characters) of each word."""
        word, five, ctx, _, _ = _grams(words)
        if not len(self.keys):
            return np.zeros(len(words)), np.bincount(word, minlength=len(words)).astype(float)
        a = np.minimum(np.searchsorted(self.keys, five), len(self.keys) - 1)
        b = np.minimum(np.searchsorted(self.ctxs, ctx), len(self.ctxs) - 1)
        own = np.where(self.keys[a] == five, self.values[a], np.where(self.ctxs[b] == ctx, self.ctx_values[b], 0.0))
        return np.bincount(word, own, len(words)), np.bincount(word, minlength=len(words)).astype(float)


def _evidence(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(difference per character, log-likelihood ratio of the mixture of each share) of each text."""
    offsets, words, place = _distinct(texts)
    own, chars = model.evidence(words) if words else (np.zeros(0), np.zeros(0))
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    # A text's words are added up in their order: its sums do not depend on the texts beside it.
    sums = lambda x: np.bincount(doc, x[place], len(offsets) - 1)
    mixed = np.stack([sums(np.logaddexp(np.log1p(-e), np.log(e) + own)) for e in SHARES])
    return sums(own) / np.maximum(sums(chars), 1), mixed


def features(evidence: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(evidence)), evidence * 10, np.clip(mixed, -30, 30) / 5], axis=1)


def _logistic(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))


def _chosen_share(fitted: pd.DataFrame, y: np.ndarray, weight: np.ndarray) -> int:
    """The share whose curve, fitted on the other folds, has the least loss."""
    fold, losses = fitted["fold"].to_numpy(), []
    for c in MIXED:
        x, p = features(fitted["evidence"].to_numpy(), fitted[c].to_numpy()), np.zeros(len(y))
        for k in np.unique(fold):
            p[fold == k] = _logistic(x[fold == k], fit_logistic(x[fold != k], y[fold != k], weight[fold != k]))
        losses.append(-(weight * np.log(np.clip(np.where(y == 1, p, 1 - p), 1e-6, 1))).sum())
    return int(np.argmin(losses))


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (w * (y - p)) - ridge * beta
        h = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _scored(model: Model, beta: np.ndarray, share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                evidence, mixed = _evidence(part.column(1), model)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(evidence), pa.array(_logistic(features(evidence, mixed[share]), beta)), *map(pa.array, mixed)], names=["id", "evidence", "score", *MIXED])

    return run


def _broadcast_map(spark, make, *parts):
    """The models travel as one broadcast value, not with every task."""
    sent = spark.sparkContext.broadcast(parts)
    return lambda batches: make(*sent.value)(batches)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id_col, held_out, evidence, score, predicted) for each row of ``docs``."""
    spark, keep = docs.sparkSession, Scratch()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)").where(~held_out("id"))
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    picked = None
    for k in (0, 1):
        own = known.where(F.col("toxic") == k).orderBy(F.xxhash64("id"), "id").limit(sample)
        picked = own if picked is None else picked.unionByName(own)
    # At most 2 * sample ids.
    picked = rows.join(F.broadcast(picked), "id").groupBy("id", "toxic").agg(F.min("text").alias("text"))
    upto = F.sum(F.length(text_of("text"))).over(Window.partitionBy("toxic").orderBy(F.xxhash64("id"), "id"))
    picked = keep(picked.withColumn("upto", upto).where(F.col("upto") <= chars).drop("upto").withColumn("fold", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(FOLDS))), "sample")
    counted = picked.select("toxic", "fold", F.explode(F.split(text_of("text"), r"[\x20\x09-\x0D]+")).alias("word")).where("word != ''").groupBy("word", "toxic", "fold").agg(F.count("*").alias("n"))
    words = counted.toArrow().to_pandas()
    if set(totals) != {0, 1} or words["toxic"].nunique() < 2:
        share = (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 1)
        flat = rows.select(F.col("id"), F.lit(0.0).alias("evidence"), F.lit(float(share)).alias("score"))
        return _named(flat, cut, id_col)
    types = rows.select("text").mapInArrow(_types, "five long, last long, middle long").groupBy("five").agg(F.first("last").alias("last"), F.first("middle").alias("middle"))
    continued = types.groupBy("last").agg(F.count("*").alias("n"), F.first("middle").alias("middle"))
    wanted = spark.createDataFrame(pa.table({"middle": np.unique(_counted(words)[3]).view(np.int64)}))
    shared = continued.join(F.broadcast(wanted), "middle", "left_semi").toArrow().to_pandas()

    fitted = []
    for fold in range(FOLDS):
        model = Model(words[words["fold"] != fold].groupby(["word", "toxic"], as_index=False)["n"].sum(), shared)
        got = picked.where(F.col("fold") == fold).select("id", "text").mapInArrow(_broadcast_map(spark, _scored, model, np.zeros(3), 0), SCORED)
        fitted.append(got.join(picked.select("id", "toxic", "fold"), "id").toArrow().to_pandas())
    fitted = pd.concat(fitted).sort_values("id")
    y = fitted["toxic"].to_numpy(np.float64)
    weight = np.where(y == 1, totals[1] / max(1, (y == 1).sum()), totals[0] / max(1, (y == 0).sum()))
    weight /= weight.mean()
    share = _chosen_share(fitted, y, weight)
    beta = fit_logistic(features(fitted["evidence"].to_numpy(), fitted[MIXED[share]].to_numpy()), y, weight)
    model = Model(words.groupby(["word", "toxic"], as_index=False)["n"].sum(), shared)
    return _named(keep.result(rows.mapInArrow(_broadcast_map(spark, _scored, model, beta, share), SCORED).select("id", "evidence", "score"), "scores"), cut, id_col)


def _named(scored: DataFrame, cut: float, id_col: str) -> DataFrame:
    return scored.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "evidence", "score", (F.col("score") >= cut).cast("int").alias("predicted"))
