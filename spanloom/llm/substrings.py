"""Substring deduplication with sharded Aho-Corasick automata of repeated phrases.

A window is 50 consecutive words; a word goes if a window that covers it also starts in a document with a smaller id.

1. Copies. Documents with the same words are one class; its smallest id stands for it, and the others lose every
   window they have, whatever the rest of the corpus holds.
2. Candidates. Of the 26 phrases of 25 words in a window, winnowing selects one by its hash alone, so equal windows
   select equal phrases. Phrases selected in one class only cannot lie in a repeated window as its selected phrase.
3. Confirmation. The windows whose selected phrase recurs are counted by hash and keep the smallest id they start in:
   their owner. Windows that a single class has drop out.
4. Automata. Each run of confirmed windows in its owner gives patterns: its selected phrases, with up to 25 words on
   either side. Documents are dealt to shards with the patterns that candidates say may occur there; a shard compiles its
   automaton of pyahocorasick and streams its documents through it. Each occurrence is widened word by word along the
   owner's text, as far as both agree, and 50 agreeing words or more go if the owner's id is smaller.

Step 4 compares words, not hashes. Nothing is gathered in the driver; an automaton is bounded by its shard.

Defined results: null and blank texts have no words and lose none; rows with a null id are compared with nothing and lose
nothing; rows with equal ids are one document for owners (nothing is removed on account of the same id) and each has
its row; other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import SPACE, Scratch, drop_stored, join_bounded, join_split, stored, text_of
from spanloom.llm.kernels import gram_hashes, split_words, word_hashes

WINDOW, PHRASE = 50, 25
#: Words of a shard, about.
SHARD_WORDS = 400_000


def selected(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` grams: the place of its smallest hash, the leftmost one on ties."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    # Smallest of doubling spans (a sparse table): hash first, then place.
    best, span = np.arange(len(grams)), 1
    while span * 2 <= width:
        a, b = best[:-span], best[span:]
        best = np.where(grams[a] <= grams[b], a, b)
        span *= 2
    a, b = best[:n], best[width - span : width - span + n]
    return np.where(grams[a] <= grams[b], a, b)


def _pieces(batches: Iterator[pa.RecordBatch], size: int = 500):
    for batch in batches:
        for low in range(0, batch.num_rows, size):
            part = batch.slice(low, size)
            offsets, flat = split_words(part.column("text"))
            yield part, offsets, flat


def _phrases(window: int, phrase: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, offsets, flat in _pieces(batches):
            words, ids = word_hashes(flat), part.column("id").to_numpy()
            keys, owners = [], []
            for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                if b - a >= window:
                    grams = gram_hashes(words[a:b], phrase)
                    keys.append(np.unique(grams[np.unique(selected(grams, window - phrase + 1))]))
                    owners.append(np.full(len(keys[-1]), ids[i]))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners))], names=["key", "id"])

    return run


def _candidates(words: np.ndarray, keys: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of the windows whose selected phrase is among the sorted keys, their hashes, places of the phrases)."""
    grams = gram_hashes(words, phrase)
    place = selected(grams, window - phrase + 1)
    at = np.searchsorted(keys, grams[place])
    hit = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == grams[place]) if len(keys) else np.zeros(len(place), bool)
    starts = np.flatnonzero(hit)
    return starts, gram_hashes(words, window)[starts], place[starts]


def _sorted_keys(x: np.ndarray) -> np.ndarray:
    return np.sort(np.asarray(x, np.int64).view(np.uint64))


def _windows(window: int, phrase: int):
    """(id, text, keys) to (window hash, id), each window once a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, offsets, flat in _pieces(batches, 200):
            words, ids, keys = word_hashes(flat), part.column("id").to_numpy(), part.column("keys")
            got, owners = [], []
            for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                _, hashes, _ = _candidates(words[a:b], _sorted_keys(keys[i].values.to_numpy()), window, phrase)
                got.append(np.unique(hashes))
                owners.append(np.full(len(got[-1]), ids[i]))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got).view(np.int64)), pa.array(np.concatenate(owners))], names=["w", "id"])

    return run


def _patterns(window: int, phrase: int):
    """(id, text, hashes of the windows it owns) to (key, owner, left words, phrase, right words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = window - phrase
        for part, offsets, flat in _pieces(batches, 200):
            words, ids, own = word_hashes(flat), part.column("id").to_pylist(), part.column("hashes")
            out = []
            for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                mine, w = _sorted_keys(own[i].values.to_numpy()), words[a:b]
                grams, hashes = gram_hashes(w, phrase), gram_hashes(w, window)
                at = np.searchsorted(mine, hashes)
                starts = np.flatnonzero((at < len(mine)) & (mine[np.minimum(at, len(mine) - 1)] == hashes))
                places = selected(grams, reach + 1)[starts]
                text = flat.slice(a, b - a).to_pylist()
                seen: set[tuple] = set()
                for p in np.unique(places).tolist():
                    # The run of owned windows around the phrase bounds how far an occurrence may be widened.
                    around = starts[places == p] if len(places) < 64 else starts[np.searchsorted(starts, max(0, p - reach)) : np.searchsorted(starts, p + 1)]
                    low, high = int(around[0]), int(around[-1]) + window
                    low, high = max(low, p - reach), min(high, p + window)
                    row = (" ".join(text[low:p]), " ".join(text[p : p + phrase]), " ".join(text[p + phrase : high]))
                    if row not in seen:
                        seen.add(row)
                        out.append((int(grams[p].view(np.int64)), ids[i], *row))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 5, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=["key", "owner", "left", "phrase", "right"])

    return run


def _agreeing(padded: str, words: list[str], step: int, at: int) -> int:
    """How many of a pattern's words on one side (padded by spaces) the document repeats from word ``at`` on."""
    n = 0
    for x in padded[1:-1].split(" ")[::step]:
        if not 0 <= at < len(words) or words[at] != x:
            break
        at += step
        n += 1
    return n


def _missing(text: str, ends: list[int], gone: bytearray, a: int, b: int, reach: int) -> tuple[str, str]:
    """How a right side has to start, or a left side to end, to reach the nearest word that stays (padded by spaces)."""
    if gone.find(0, a, b) >= 0:
        return " ", " "  # inside the phrase: any will do
    x, y = gone.find(0, b, b + reach), gone.rfind(0, max(0, a - reach), a)
    # No side holds a line break.
    return text[ends[b - 1] : ends[x] + 1] if x >= 0 else "\n", text[ends[y - 1] if y else 0 : ends[a - 1] + 1] if y >= 0 else "\n"


def _occurrences(automaton, words: list[str], doc_id: int, window: int) -> bytearray:
    """A byte for each word: 1 for words that go.

    Patterns that cannot reach a word that stays are passed over; each side of the others is compared as one string
    first, and word by word where that differs.
    """
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1).tolist()  # the space behind each word
    text, gone = " " + " ".join(words) + " ", bytearray(len(words))
    for end, (key, size, patterns) in automaton.iter(text):
        stop = bisect_left(ends, end) + 1  # the pattern ends with a space, which stands at ``end``
        first, need = end + 1 - len(key), None
        for owner, left, n_left, right, n_right in patterns:
            if owner >= doc_id:
                continue
            need = need or _missing(text, ends, gone, stop - size, stop, window)
            if not (right.startswith(need[0]) or left.endswith(need[1])):
                continue
            a, b, begin = stop - size, stop, first + 1 - len(left)
            if n_left:
                a -= n_left if begin >= 0 and text.startswith(left, begin) else _agreeing(left, words, -1, a - 1)
            if n_right:
                b += n_right if text.startswith(right, end) else _agreeing(right, words, 1, b)
            if b - a >= window:
                gone[a:b] = b"\1" * (b - a)
                need = None
    return gone


def _stream(window: int):
    """Rows sorted by (shard, kind): a shard's patterns, then its documents. Yields the document's kept words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        shard, automaton, found = None, None, {}
        for batch in batches:
            out = []
            for now, kind, doc_id, h, left, phrase, right in zip(*(batch.column(c).to_pylist() for c in ("shard", "kind", "id", "h", "left", "phrase", "right")), strict=True):
                if now != shard:
                    shard, automaton, found = now, None, {}
                if kind == 0:
                    left, right = (f" {x} " if x else " " for x in (left, right))
                    found.setdefault(f" {phrase} ", []).append((doc_id, left, left.count(" ") - 1, right, right.count(" ") - 1))
                    continue
                if automaton is None:
                    automaton = ahocorasick.Automaton()
                    for k, v in found.items():
                        automaton.add_word(k, (k, k.count(" ") - 1, sorted(v, key=lambda x: (-x[2] - x[4], x[0]))))  # the widest first
                    found = {}
                    automaton.make_automaton()
                words = split_words(pa.array([phrase]))[1].to_pylist()
                gone = _occurrences(automaton, words, doc_id, window) if len(automaton) else bytearray(len(words))
                if any(gone):
                    out.append((doc_id, h, " ".join(w for w, g in zip(words, gone, strict=True) if not g), sum(gone)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["id", "h", "kept", "n_removed"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, id_col: str = "doc_id", text_col: str = "text", texts_too: bool = True) -> DataFrame:
    """(id_col, n_words, n_removed, kept_sha256, kept_text) for each row of ``docs``; stored without kept_text unless ``texts_too``."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    words = F.array_remove(F.split(text_of(), SPACE), "")
    facts = rows.select("id", "h", words.alias("w")).select("id", "h", F.size("w").alias("n"), F.md5(F.array_join("w", " ")).alias("seal"))
    keep = Scratch()
    named = keep(facts, "facts").where(F.col("id").isNotNull() & (F.col("n") >= window))
    first = named.groupBy("seal").agg(F.min("id").alias("rep"), F.max("id").alias("last"), F.count("*").alias("c")).where("rep < last")
    # Documents that are not the first of their class lose all their words.
    copies = keep(join_split(named, first, "seal", "c", named.count()).where("id != rep").select("id", "h").distinct(), "copies")
    singles = join_bounded(rows.where("id is not null"), copies, ["id", "h"], "left_anti", copies.count(), 200_000)

    keys = stored(singles.mapInArrow(_phrases(window, phrase), "key long, id long"), "phrases")
    again = keys.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("key")
    by_doc = stored(keys.join(again, "key").groupBy("id").agg(F.collect_set("key").alias("keys")), "candidates")
    drop_stored(keys)
    texts = stored(join_bounded(singles, by_doc, ["id"], "inner", by_doc.count(), 5_000).select("id", "h", "text", "keys").dropDuplicates(["id", "h"]), "texts")
    drop_stored(by_doc)
    counted = texts.mapInArrow(_windows(window, phrase), "w long, id long").groupBy("w").agg(F.min("id").alias("owner"), F.max("id").alias("last"))
    owned = stored(counted.where("owner < last").groupBy("owner").agg(F.collect_list("w").alias("hashes")), "owned")
    by_owner = texts.join(owned.withColumnRenamed("owner", "id"), "id").select("id", "text", "hashes")
    patterns = stored(by_owner.mapInArrow(_patterns(window, phrase), "key long, owner long, left string, phrase string, right string"), "patterns")
    drop_stored(owned)

    # Shards of about SHARD_WORDS words; documents and the patterns that may occur in them meet there.
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    shard = F.pmod(F.xxhash64("id"), F.lit(max(1, int(chars / 6 / SHARD_WORDS)))).cast("int").alias("shard")
    routes = texts.select(shard, F.explode("keys").alias("key"), "id").groupBy("shard", "key").agg(F.max("id").alias("top"))
    none = F.lit("")
    dealt = routes.join(patterns, "key").where("owner < top").select("shard", F.lit(0).alias("kind"), F.col("owner").alias("id"), F.lit(0).cast("long").alias("h"), "left", "phrase", "right")
    dealt = dealt.unionByName(texts.select(shard, F.lit(1).alias("kind"), "id", "h", none.alias("left"), F.col("text").alias("phrase"), none.alias("right")))
    cut = keep(dealt.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(_stream(window), "id long, h long, kept string, n_removed long"), "cut")
    drop_stored(patterns)
    drop_stored(texts)

    nothing = [F.lit(None).cast("string").alias("kept"), F.lit(None).cast("long").alias("n_removed"), F.lit(True).alias("all_gone")]
    marks = cut.select("id", "h", "kept", "n_removed", F.lit(False).alias("all_gone")).unionByName(copies.select("id", "h", *nothing))
    out = rows.join(marks, ["id", "h"], "left").select("id", "n_removed", "kept", F.coalesce("all_gone", F.lit(False)).alias("gone"), words.alias("w"))
    n = F.size("w").cast("long")
    out = out.select("id", n.alias("n_words"), F.when(F.col("gone"), n).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"), F.when(F.col("gone"), "").otherwise(F.coalesce("kept", F.array_join("w", " "))).alias("kept_text"))
    out = out.select(F.col("id").alias(id_col), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), "kept_text")
    return out if texts_too else keep.result(out.drop("kept_text"), "kept")
