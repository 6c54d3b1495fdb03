"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are short and documents long, so a document is searched in overlapping windows sized for the items: items are
partitioned by their number of shingles (doubling sizes), and a partition whose largest item has ``u`` shingles sees
windows of ``2u`` shingles, one every ``u``. An item that a document holds lies whole in one of these windows. There,
containment ``t`` of an item of ``q`` shingles gives a Jaccard similarity of ``s >= t / (2u / q + 1 - t)``, at least
``0.8 / (4 + 1 - 0.8) = 0.19``, and ``bands`` bands of one MinHash value each collide with probability
``1 - (1 - s) ** bands``: 0.9999 or more with 48.

A band of one value collides only where the window holds the item's own smallest shingle under that hash. So windows
without any item's smallest shingle need no sketch; leaving them out loses nothing. Candidates are verified exactly: the
share of the item's distinct five-word shingles, as strings, that the whole document holds must be 0.8 or more.

Defined results: null and blank texts hold nothing; items without words are contained nowhere; a document or item of one
to four words is one shingle, its whole word sequence; rows with null ids are compared as any other and keep the null;
repeated rows give a row each, repeated items one; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import stored
from spanloom.llm.kernels import SHINGLE, doc_grams, mix, split_words, word_hashes

BANDS, THRESHOLD = 48, 0.8
#: Items are indexed and broadcast in blocks of about this many characters of text; each block is one pass over the documents.
BLOCK_CHARS = 16_000_000


def _shingle_strings(words: list[str], k: int) -> set[str]:
    return {" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {" ".join(words)} if words else set()


def _text_grams(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(offsets, documents, hashes, words, offsets of the hashes); a text of fewer than k words has one hash."""
    offsets, flat = split_words(texts)
    words = word_hashes(flat)
    doc, grams = doc_grams(words, offsets, k)
    sizes = np.diff(offsets)
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    if len(short):
        extra = np.array([mix(np.array([np.bitwise_xor.reduce(words[offsets[i] : offsets[i + 1]] * np.arange(1, sizes[i] + 1, dtype=np.uint64))]))[0] for i in short], np.uint64)
        doc, grams = np.concatenate([doc, short]), np.concatenate([grams, extra])
        order = np.argsort(doc, kind="stable")
        doc, grams = doc[order], grams[order]
    return offsets, doc, grams, flat, np.searchsorted(doc, np.arange(len(offsets)))


class ItemIndex:
    """MinHash sketches of the items, by partitions of size."""

    def __init__(self, items: list[tuple], k: int, bands: int):
        self.k = k
        self.seeds = mix(np.arange(1, bands + 1, dtype=np.uint64))
        texts = pa.array([t for _, t in items], pa.string())
        _, doc, grams, _, cuts = _text_grams(texts, k)
        self.strings = [_shingle_strings(split_words(pa.array([t or ""]))[1].to_pylist(), k) for _, t in items]
        self.ids = [i for i, _ in items]
        sizes = np.array([len(s) for s in self.strings], np.int64)
        partition = np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)
        self.parts = []
        for p in np.unique(partition[sizes > 0]).tolist():
            own = np.flatnonzero((partition == p) & (sizes > 0))
            low = np.array([[mix(grams[cuts[i] : cuts[i + 1]] ^ s).min() for s in self.seeds] for i in own], np.uint64)
            least = np.array([[grams[cuts[i] : cuts[i + 1]][mix(grams[cuts[i] : cuts[i + 1]] ^ s).argmin()] for s in self.seeds] for i in own], np.uint64)
            bands_of = []
            for b in range(bands):
                order = np.argsort(low[:, b], kind="stable")
                bands_of.append((low[order, b], own[order]))
            self.parts.append((1 << p, np.unique(least), bands_of))
        self.anchors = np.unique(np.concatenate([p[1] for p in self.parts])) if self.parts else np.zeros(0, np.uint64)

    def candidates(self, grams: np.ndarray) -> set[int]:
        """Items that share a band with a window of these shingles in text order."""
        found: set[int] = set()
        for u, anchors, bands in self.parts:
            at = np.searchsorted(anchors, grams)
            hits = np.flatnonzero(anchors[np.minimum(at, len(anchors) - 1)] == grams)
            # Windows start at multiples of u and are 2u long: a place lies in two of them.
            for w in np.unique(np.concatenate([hits // u, np.maximum(hits // u - 1, 0)])).tolist() if len(hits) else ():
                sketch = mix(grams[w * u : w * u + 2 * u][None, :] ^ self.seeds[:, None]).min(axis=1)
                for value, (low, own) in zip(sketch, bands, strict=True):
                    a, b = np.searchsorted(low, value), np.searchsorted(low, value, "right")
                    if b > a:
                        found.update(own[a:b].tolist())
        return found


def _search(sent, threshold: float):
    """Looks for the items of an index that was broadcast."""
    thousandths = round(threshold * 1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        k, anchors = index.k, index.anchors
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                offsets, doc, grams, flat, cuts = _text_grams(part.column(1), k)
                at = np.searchsorted(anchors, grams)
                hit = anchors[np.minimum(at, len(anchors) - 1)] == grams if len(anchors) else np.zeros(len(grams), bool)
                ids, hashes, out = part.column(0), part.column(2), []
                for i in np.unique(doc[hit]).tolist():
                    found = index.candidates(grams[cuts[i] : cuts[i + 1]])
                    if found:
                        own = _shingle_strings(flat.slice(offsets[i], offsets[i + 1] - offsets[i]).to_pylist(), k)
                        for j in sorted(found):
                            n, shared = len(index.strings[j]), len(index.strings[j] & own)
                            if shared * 1000 >= thousandths * n:
                                out.append((ids[i].as_py(), hashes[i].as_py(), index.ids[j], shared, n))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["doc_id", "h", "item_id", "n_shared", "n_shingles"])

    return run


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", with_hash: bool = False) -> DataFrame:
    """(id_col, item_id_col, n_shared, n_shingles, containment): each item found in each row of ``docs``; ``with_hash`` adds text_hash."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    wanted = items.select(F.col(item_id_col).cast("long").alias("i"), F.col(item_text_col).cast("string").alias("t")).distinct().orderBy("i", "t")
    schema = "doc_id long, h long, item_id long, n_shared long, n_shingles long"
    spark, out, block, chars = docs.sparkSession, None, [], 0

    def searched() -> DataFrame:
        """One pass for the items held by now, whose index is built once and broadcast."""
        part = rows.mapInArrow(_search(spark.sparkContext.broadcast(ItemIndex(block, k, bands)), threshold), schema)
        return part if out is None else out.unionByName(part)

    for r in wanted.toLocalIterator():  # a block of items at a time
        if block and chars + len(r["t"] or "") > BLOCK_CHARS:
            out, block, chars = searched(), [], 0
        block.append((r["i"], r["t"]))
        chars += len(r["t"] or "")
    if block or out is None:
        out = searched()
    found = [F.col("doc_id").alias(id_col), F.col("item_id").alias(item_id_col), "n_shared", "n_shingles", (F.col("n_shared") / F.col("n_shingles")).alias("containment")]
    return out.select(*found, *([F.col("h").alias("text_hash")] if with_hash else []))


def clean_rows(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no item, told apart by id (null included) and text."""
    found = contaminated(docs, items, id_col=id_col, text_col=text_col, with_hash=True, **options)
    gone = stored(found.select(F.col(id_col).alias("_c_id"), F.col("text_hash").alias("_c_h")).distinct(), "contaminated")
    on = F.col(id_col).eqNullSafe(F.col("_c_id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("_c_h"))
    return docs.join(F.broadcast(gone) if gone.count() <= 200_000 else gone, on, "left_anti")
