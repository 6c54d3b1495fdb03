"""Token ids as flat unsigned integer files with 64-bit document offsets, read back memory-mapped.

A data set is a folder of shards, ascending by doc_id across and within shards. Shard files:
``<name>.bin`` ids, little-endian ``uint16`` if the vocabulary fits, else ``uint32``; ``<name>.idx`` ``int64`` offsets,
one more than documents, counted from the shard's start; ``<name>.ids`` the doc_ids as an Arrow file. The manifest
lists the shards that were committed and each one's base: the prefix sum of ids in the shards before it.

A task writes its shard under a name of its own and reports it with its result, so an attempt that is lost or runs
twice leaves a file that no manifest names.

Defined results: null texts are empty, and an empty text is its end id alone; null doc_ids come first; repeated
doc_ids are all kept, side by side; an empty table makes a data set of no shards. Other columns are not looked at.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import fresh_path, shared_dir, stored
from spanloom.llm.files import make_folder, mapped, whole, writer
from spanloom.llm.kernels import split_words

END_ID = 2
MANIFEST = "shard int, name string, width int, n_docs long, n_tokens long, base long"


#: Texts that tell whether a tokenizer drops white space: words apart by blanks, line breaks and tabs, first, last and doubled.
PROBES = ("a b", " the end", "the end ", "one\ntwo", "one\t two  three", "Don't stop, now: 3 x 4", "\n\nüber die\r\n")


class WordEncoder:
    """Encodes texts word by word, each distinct word once; whole texts where the tokenizer's ids depend on white space.

    Where the vocabulary's pre-tokenizer drops white space, no token or normalisation reaches across it, so the ids of a
    text are those of its words, one after the other. The first ``keep`` distinct words are remembered for as long as
    the worker lives, frequent ones among them; later ones are encoded batch by batch.
    """

    def __init__(self, path: str, keep: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Word by word is right only where white space is dropped: two texts of the same words have to have the same ids.
        self.by_word = all(self.tokenizer.encode(a, add_special_tokens=False).ids == [x for w in a.split() for x in self.tokenizer.encode(w, add_special_tokens=False).ids] for a in PROBES)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.keep = keep
        self.known: dict[str, int] = {}
        self.sizes = np.zeros(0, np.int64)
        self.flat = np.zeros(0, f"<u{self.width}")

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts, without end ids."""
        if not self.by_word:
            every = [e.ids for e in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            return np.concatenate([[0], np.cumsum([len(e) for e in every])]).astype(np.int64), np.fromiter((x for e in every for x in e), f"<u{self.width}", sum(map(len, every)))
        offsets, words = split_words(texts)
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        known = self.known
        new = [w for w in distinct if w not in known]
        sizes, flat = [self.sizes], [self.flat]
        for low in range(0, len(new), 10_000):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(new[low : low + 10_000], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flat.append(np.fromiter((x for e in ids for x in e), f"<u{self.width}", int(sizes[-1].sum())))
        own_sizes, own_flat = (np.concatenate(sizes), np.concatenate(flat)) if new else (self.sizes, self.flat)
        fresh = dict(zip(new, range(len(self.sizes), len(own_sizes)), strict=True))
        starts = np.cumsum(own_sizes) - own_sizes
        place = np.fromiter((known[w] if w in known else fresh[w] for w in distinct), np.int64, len(distinct))[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        if new and len(known) < self.keep:
            known.update(fresh)
            self.sizes, self.flat = own_sizes, own_flat
        long = own_sizes[place]
        ends = np.cumsum(long)
        total = int(ends[-1]) if len(ends) else 0
        ids = own_flat[np.repeat(starts[place] - (ends - long), long) + np.arange(total)]
        return np.concatenate([[0], ends])[offsets], ids


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of a tokenizer file, with the words that it knows by now."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _write(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, name, doc_ids, lengths, n = encoder(tokenizer), f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}", [], [], 0
        out = None
        for batch in batches:
            for low in range(0, batch.num_rows, 1500):
                part = batch.slice(low, 1500)
                out = out or writer(f"{folder}/{name}.bin")
                offsets, ids = encode(part.column(1))
                ids = np.insert(ids, offsets[1:], end_id)
                out.write(ids.astype(f"<u{encode.width}", copy=False).tobytes())
                lengths.append(np.diff(offsets) + 1)
                doc_ids.append(part.column(0).cast(pa.int64()))
                n += len(ids)
        if out is None:
            return
        out.close()
        with writer(f"{folder}/{name}.idx") as f:
            f.write(np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype("<i8").tobytes())
        keys = pa.table({"doc_id": pa.chunked_array(doc_ids)})
        with writer(f"{folder}/{name}.ids") as f, pa.ipc.new_file(f, keys.schema) as w:
            w.write_table(keys)
        yield pa.RecordBatch.from_pylist([{"shard": int(name[:6]), "name": name, "width": encode.width, "n_docs": len(keys), "n_tokens": n}], pa.schema([("shard", pa.int32()), ("name", pa.string()), ("width", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return run


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, DataFrame]:
    """Writes the data set and returns its folder and manifest (one row a shard; bases by prefix sums)."""
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "tokens")
    make_folder(folder)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # Equal doc_ids are ordered by text, so that reruns write the same ids.
    ordered = rows.repartitionByRange(F.col("id"), F.xxhash64("text")).sortWithinPartitions("id", "text")
    shards = stored(ordered.mapInArrow(_write(folder, tokenizer, end_id), "shard int, name string, width int, n_docs long, n_tokens long"), "shards")
    base, lines = 0, []
    for r in sorted(shards.collect(), key=lambda r: r["shard"]):  # one row a shard
        lines.append((*r, base))
        base += r["n_tokens"]
    manifest = spark.createDataFrame(lines, MANIFEST)
    manifest.coalesce(1).write.parquet(f"{folder}/manifest")
    return folder, manifest


def open_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, offsets = mapped(f"{folder}/{r['name']}.bin", f"<u{r['width']}"), mapped(f"{folder}/{r['name']}.idx", "<i8")
                keys = pa.ipc.open_file(pa.BufferReader(whole(f"{folder}/{r['name']}.ids"))).read_all()["doc_id"]
                for low in range(0, r["n_docs"], 10_000):
                    cuts = np.asarray(offsets[low : low + 10_001])
                    sums = [zlib.crc32(np.asarray(ids[a:b]).astype("<u4").tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([keys.slice(low, len(sums)).combine_chunks(), pa.array(cuts[:-1] + r["base"]), pa.array(np.diff(cuts)), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    shared_dir(spark)
    shards = open_tokens(spark, folder)
    # AQE would put these small rows into one task: a shard each is the unit of work.
    return shards.repartition(max(1, shards.count()), "shard").mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")
