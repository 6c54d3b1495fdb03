"""WARC archives of captured pages, with an external merge of their indexes into globally ordered capture histories.

Writing: a task writes the captures it holds as one archive, a gzip member a record, and a capture run: its index lines
sorted by URL key, timestamp and page. A payload that an earlier page (by page_id) has is written as a revisit record,
which keeps the HTTP header, with the full payload's length, and the payload's digest.

Merging: runs are merged by loser trees of at most ``FAN_IN`` runs; while there are more, groups of them are merged into
longer runs. The last merge is dealt out by key ranges, cut at keys from a bounded sample of run keys: a task seeks its
range in every run by binary search, so ranges are in order across tasks and a URL captured very often spreads over
several of them. Each capture gets its place in the whole order and in its URL's history.

Reading: the merged index names archive, offset and length of every record; records are read archive by archive.

Files are named by attempt, and only names that a finished task reports are read, so lost tasks leave nothing behind
that counts. Paths are local or any URI that pyarrow opens.

Defined results: a null payload is empty; equal empty payloads are equal payloads; a null page_id is a page of its own and
always a response; a null URL is the empty URL; rows with the same page_id and payload are all responses; an empty table
gives no archives and an empty result; other columns are not looked at.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import fresh_path, join_bounded, stored
from spanloom.llm.files import make_folder, opened, writer

FAN_IN, SPLIT_SAMPLE, RUN_KEYS = 64, 10_000, 32
EPOCH = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
_SAFE = "!$&'()*+,/:;=?@[]~%._-#|"


def url_key(url: str) -> str:
    """Host labels from the right, then path and query in lower case: captures of a site sort together. Malformed URLs as they are."""
    try:
        parts = urlsplit(url.strip() if "://" in url else "//" + url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return quote(url.strip().lower(), safe=_SAFE) or ")/"
    key = ",".join(reversed(host.removeprefix("www.").split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return quote(key.lower(), safe=_SAFE)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, when: datetime.datetime, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member: a response record, or a revisit if ``refers_to`` names the page that has the payload."""
    digest = payload_digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'null:' + uuid.uuid4().hex if page_id is None else page_id}>", f"WARC-Date: {when:%Y-%m-%dT%H:%M:%SZ}", f"WARC-Target-URI: {quote(url, safe=chr(33) + '#$%&()*+,/:;=?@[]~._-|' + chr(39))}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 2, mtime=0)


def parse_record(member: bytes) -> dict:
    """The record's fields; a response's payload is checked against its digest."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (payload_digest(payload) != digest or len(payload) != size):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not fit its digest")
    page = lambda x: None if x is None or ":null:" in x else int(x.strip("<>").rpartition(":")[2])
    return {"page_id": page(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": page(fields.get("WARC-Refers-To"))}


def _line(key: str, stamp: str, page_id: int | None, archive: str, offset: int, length: int) -> bytes:
    """Sorts by key, timestamp, page. Keys hold no white space; pages are shifted so that negative ones sort first."""
    return f"{key} {stamp} {-1 if page_id is None else page_id + 2**63:021d} {archive} {offset} {length}\n".encode()


def _save_run(folder: str, name: str, lines) -> tuple[int, list[str]]:
    n, keys, step = 0, [], 1
    with writer(f"{folder}/{name}.cdx") as f:
        for line in lines:
            if n % step == 0:
                keys.append(line.rsplit(b" ", 3)[0].decode())
                if len(keys) == 2 * RUN_KEYS:
                    keys, step = keys[::2], step * 2
            f.write(line)
            n += 1
    return n, keys


_RUN = pa.schema([("name", pa.string()), ("n", pa.int64()), ("keys", pa.list_(pa.string()))])


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, at, lines = uuid.uuid4().hex, None, 0, []
        for batch in batches:
            # Few records at once are Python objects.
            for r in (r for low in range(0, batch.num_rows, 64) for r in batch.slice(low, 64).to_pylist()):
                out = out or writer(f"{folder}/{name}.warc.gz")
                when = EPOCH + datetime.timedelta(seconds=(r["page_id"] or 0) % 2**31)
                member = record(r["page_id"], r["url"], when, r["payload"], r["refers_to"])
                out.write(member)
                lines.append(_line(url_key(r["url"]), f"{when:%Y%m%d%H%M%S}", r["page_id"], name, at, len(member)))
                at += len(member)
        if out is not None:
            out.close()
            n, keys = _save_run(folder, name, sorted(lines))
            yield pa.RecordBatch.from_pylist([{"name": name, "n": n, "keys": keys}], _RUN)

    return run


class LoserTree:
    """Merges sorted iterators. Inner nodes hold the losers of their matches; the overall winner stands apart."""

    def __init__(self, runs: list[Iterator[bytes]]):
        self.runs, self.k = runs, len(runs)
        self.heads: list[bytes | None] = [next(r, None) for r in runs]
        self.losers = [-1] * self.k
        self.winner = -1
        for leaf in range(self.k):
            self._play(leaf)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _play(self, leaf: int) -> None:
        """From a leaf to the root; at an empty node of the building phase the player waits for its opponent."""
        now, node = leaf, (leaf + self.k) // 2
        while node:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = now
                return
            if self._beats(other, now):
                self.losers[node], now = now, other
            node //= 2
        self.winner = now

    def __iter__(self) -> Iterator[bytes]:
        while self.k and self.heads[self.winner] is not None:
            yield self.heads[self.winner]
            self.heads[self.winner] = next(self.runs[self.winner], None)
            self._play(self.winner)


def run_lines(uri: str, low: bytes = b"", high: bytes | None = None, block: int = 1 << 18) -> Iterator[bytes]:
    """The lines of a run from ``low`` (included) to ``high``; the start is found by binary search."""
    system, path = opened(uri)
    with system.open_input_file(path) as f:
        size = f.size()

        def after(at: int) -> tuple[int, bytes]:
            """Place and text of the first line that starts at or after a place."""
            start = at
            if at:
                f.seek(at - 1)
                while (piece := f.read(4096)) and b"\n" not in piece:
                    at += len(piece)
                start = at - 1 + piece.index(b"\n") + 1 if piece else size
            f.seek(start)
            line = b""
            while (piece := f.read(4096)):
                line += piece
                if b"\n" in piece:
                    break
            return start, line.partition(b"\n")[0]

        a, b = 0, size
        while low and a < b:
            m = (a + b) // 2
            start, line = after(m)
            if start < size and line < low:
                a = start + len(line) + 1
            else:
                b = m
        start = after(a)[0] if a < size else size
        f.seek(start)
        rest = b""
        while (piece := f.read(block)):
            lines = (rest + piece).split(b"\n")
            rest = lines.pop()
            for line in lines:
                if high is not None and line >= high:
                    return
                yield line + b"\n"


def _merge_groups(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                name = uuid.uuid4().hex
                n, keys = _save_run(folder, name, LoserTree([run_lines(f"{folder}/{x}.cdx") for x in r["names"]]))
                yield pa.RecordBatch.from_pylist([{"name": name, "n": n, "keys": keys}], _RUN)

    return run


_MERGED = pa.schema([("range", pa.int64()), ("at", pa.int64()), ("url_key", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _merge_range(folder: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                low, high = (r["low"] or "").encode(), None if r["high"] is None else r["high"].encode()
                rows: list[tuple] = []
                for at, line in enumerate(LoserTree([run_lines(f"{folder}/{x}.cdx", low, high) for x in names])):
                    key, stamp, page, archive, offset, length = line.decode().split()
                    rows.append((r["range"], at, key, stamp, None if page.startswith("-") else int(page) - 2**63, archive, int(offset), int(length)))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _MERGED.types, strict=True)], schema=_MERGED)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _MERGED.types, strict=True)], schema=_MERGED)

    return run


def merge_runs(spark: SparkSession, folder: str, runs: DataFrame, fan_in: int = FAN_IN, ranges: int | None = None) -> DataFrame:
    """The captures of all runs in one order, each with its ``place`` in it and ``nth`` in its URL's history."""
    while (count := runs.count()) > fan_in:
        place = F.row_number().over(Window.orderBy("name")) - 1  # one row a run
        groups = runs.select("name", F.floor(place / fan_in).alias("g")).groupBy("g").agg(F.collect_list("name").alias("names"))
        runs = stored(groups.repartition(max(1, -(-count // fan_in)), "g").select("names").mapInArrow(_merge_groups(folder), "name string, n long, keys array<string>"), "runs")
    names = sorted(r["name"] for r in runs.select("name").collect())  # at most fan_in
    keys = runs.select(F.explode("keys").alias("key")).distinct().orderBy(F.xxhash64("key"), "key").limit(SPLIT_SAMPLE)
    sample = sorted(r["key"] for r in keys.collect())
    total = runs.agg(F.sum("n")).first()[0] or 0
    wanted = ranges or max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // 2000)))
    cuts = sorted({sample[len(sample) * i // wanted] for i in range(1, wanted)} - {sample[0]} if sample else set())
    bounds = list(zip([None, *cuts], [*cuts, None], strict=True))
    parts = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(bounds)], "range long, low string, high string")
    merged = stored(parts.repartition(len(bounds), "range").mapInArrow(_merge_range(folder, names), "range long, at long, url_key string, timestamp string, page_id long, archive string, offset long, length long"), "merged")
    # Bases of the ranges, and of a URL in them: prefix sums over one row a range, or a URL and range.
    base = merged.groupBy("range").agg(F.count("*").alias("n")).select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("base"))
    firsts = merged.groupBy("url_key", "range").agg(F.min("at").alias("first"), F.count("*").alias("c"))
    firsts = firsts.withColumn("before", F.sum("c").over(Window.partitionBy("url_key").orderBy("range")) - F.col("c")).drop("c")
    out = merged.join(F.broadcast(base), "range").join(firsts, ["url_key", "range"])
    return out.select((F.col("base") + F.col("at")).alias("place"), (F.col("before") + F.col("at") - F.col("first")).alias("nth"), "url_key", "timestamp", "page_id", "archive", "offset", "length")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes archives and capture runs; returns the runs (name, n, keys)."""
    make_folder(folder)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    twice = rows.where(F.col("page_id").isNotNull() & (F.col("size") >= min_bytes)).groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("digest", "size", "first")
    twice = stored(twice, "copies")
    joined = join_bounded(rows, twice, ["digest", "size"], "left", twice.count())
    refers = F.when(F.col("page_id") > F.col("first"), F.col("first"))
    return stored(joined.select("page_id", "url", "payload", refers.alias("refers_to")).mapInArrow(_write(folder), "name string, n long, keys array<string>"), "runs")


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        for batch in batches:
            out = []
            for r in (r for low in range(0, batch.num_rows, 1000) for r in batch.slice(low, 1000).to_pylist()):
                if r["archive"] != name:
                    name = r["archive"]
                    system, path = opened(f"{folder}/{name}.warc.gz")
                    f = system.open_input_file(path)
                f.seek(r["offset"])
                out.append(parse_record(f.read(r["length"])) | {k: r[k] for k in ("url_key", "timestamp", "place", "nth")})
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url_key", pa.string()), ("timestamp", pa.string()), ("place", pa.int64()), ("nth", pa.int64())]))

    return run


def read_archives(index: DataFrame, folder: str, archives: int | None = None) -> DataFrame:
    """Every record that the merged index names, parsed, with its place in the capture order.

    The index rows are small and the records are not: the number of tasks is that of the archives (counted where it is not
    given), which keeps the rows from being put into few tasks by their own size.
    """
    if archives is None:
        archives = index.select("archive").distinct().count()
    small = index.select("archive", "offset", "length", "url_key", "timestamp", "place", "nth")
    return small.repartition(max(1, archives), "archive").sortWithinPartitions("archive", "offset").mapInArrow(_read(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, timestamp string, place long, nth long")


def archive_round_trip(pages: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Writes the pages, merges the capture index and reads all records back."""
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    runs = write_archives(pages, folder, **columns)
    return read_archives(merge_runs(spark, folder, runs), folder, runs.count())
