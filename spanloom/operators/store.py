"""Tables of snapshots: insert-ignore, last-writer-wins, audits, and staged publishing with a manifest that makes a snapshot visible."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The tables of a store. Those of a snapshot are partitioned by sha; a reader sees the partitions that manifests name.
SCHEMAS = {
    "commit_ref": "sha string, parent_shas array<string>, ingested_at timestamp",
    "facts": "path string, module string, fact string, kind string, fq string, name string, target string, receiver string, start_line int, end_line int, fingerprint string, data string, oid string",
    "code_span": "span_id string, lang string, span_kind string, fq_symbol_path string, structural_fingerprint string, normalization_version int",
    "span_occurrence": "span_id string, file_path string, start_line int, end_line int, raw_text string",
    "artifact": "artifact_id string, kind string, logical_key string, extractor_id string, extractor_version string, prompt_version string, model_id string, versions map<string,string>, payload string, confidence double, is_deterministic boolean",
    "derived_from": "artifact_id string, span_id string, role string",
    "snapshot_entry": "logical_key string, artifact_id string",
    "embedding": "artifact_id string, model_id string, vector array<float>",
    "rag_chunk": "file_path string, start_line int, end_line int, raw_text string, model_id string, vector array<float>",
    "branch_ref": "name string, head_sha string, updated_at timestamp",
}


def set_aside(df: DataFrame, name: str) -> DataFrame:
    """Writes a table that is read more than once into the folder all executors share, and reads it again."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spanloom-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes a table that :func:`set_aside` wrote."""
    sc = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


class GroundingError(ValueError):
    """An artifact without evidence, or another broken rule."""


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows of ``new`` to append: keys that ``old`` lacks, the first of each by ``order``."""
    first = new.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
    return first.join(old, keys, "left_anti")


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The table after the upsert: the last row of each key, new ones before old ones."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    by = Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc(order))
    return both.withColumn("_rn", F.row_number().over(by)).where("_rn = 1").drop("_rn", "_new")


def orphans(artifacts: DataFrame, derived: DataFrame) -> DataFrame:
    return artifacts.join(derived, "artifact_id", "left_anti")


def audit(artifacts: DataFrame, derived: DataFrame, spans: DataFrame) -> None:
    """Raises unless every artifact is grounded, every edge has its ends, and the columns hold what they may."""
    wrong = {
        "artifact without evidence": orphans(artifacts, derived),
        "edge without span": derived.join(spans, "span_id", "left_anti"),
        "edge without artifact": derived.join(artifacts, "artifact_id", "left_anti"),
        "confidence outside 0 to 1": artifacts.where("not (confidence between 0 and 1)"),
        "deterministic artifact with a model": artifacts.where("is_deterministic and (prompt_version != '' or model_id != '')"),
    }
    for what, rows in wrong.items():
        if not rows.isEmpty():
            raise GroundingError(what)


class Store:
    """A folder of Parquet tables. Each write of a table for a snapshot is a folder of its own; a manifest lists those that count.

    A manifest is written last and whole (under another name, then renamed), so that a snapshot is seen with all its tables or
    not at all, and a run that is lost leaves folders that no manifest names. Later passes over a snapshot (embeddings,
    descriptions) write a new manifest that names what was there and what they add.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.path}/manifest"))

    def manifests(self) -> dict[str, dict]:
        """sha: its manifest. Small: one file a snapshot."""
        out = {}
        for status in self._fs.listStatus(self._path(f"{self.path}/manifest")):
            name = status.getPath().getName()
            if name.endswith(".json"):
                out[name.removesuffix(".json")] = json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/manifest/{name}", wholetext=True).collect()))
        return out

    def has(self, sha: str) -> bool:
        return bool(self._fs.exists(self._path(f"{self.path}/manifest/{sha}.json")))

    def latest(self) -> str | None:
        """The snapshot published last; of those of one moment the smallest sha."""
        shas = [(m["ingested_at"], s) for s, m in self.manifests().items()]
        return min((s for t, s in shas if t == max(shas)[0]), default=None)

    def stage(self, table: str, df: DataFrame, sha: str) -> str:
        """Writes a part of a snapshot's table, unseen as yet; returns its folder's name."""
        folder = f"{table}/sha={sha}/run={uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        return folder

    def staged(self, table: str, *folders: str) -> DataFrame:
        """The rows of staged parts, with the sha that their folders name."""
        read = self.spark.read.schema(SCHEMAS[table] + ", sha string, run string").option("basePath", f"{self.path}/{table}")
        return read.parquet(*[f"{self.path}/{x}" for x in folders]).drop("run")

    def publish(self, sha: str, parts: dict[str, list[str]], **facts) -> None:
        """Makes the staged parts a snapshot, together with what an earlier manifest of it names."""
        old = self.manifests().get(sha, {"parts": {}})
        merged = {t: [*old["parts"].get(t, []), *parts.get(t, [])] for t in {*old["parts"], *parts}}
        self._put(f"manifest/{sha}.json", {**old, **facts, "parts": merged})

    def _put(self, name: str, body: dict) -> None:
        temporary = f"{self.path}/{name}.{uuid.uuid4().hex}.tmp"
        out = self._fs.create(self._path(temporary))
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        self._fs.delete(self._path(f"{self.path}/{name}"), False)
        self._fs.rename(self._path(temporary), self._path(f"{self.path}/{name}"))

    def table(self, name: str, sha: str | None = None) -> DataFrame:
        """A table's rows with their sha, of one snapshot or of all."""
        folders = [x for s, m in self.manifests().items() if sha in (None, s) for x in m["parts"].get(name, [])]
        return self.staged(name, *folders) if folders else self.spark.createDataFrame([], SCHEMAS[name] + ", sha string")

    def cursor(self, branch: str) -> str | None:
        """Where a branch was left."""
        place = f"{self.path}/branch/{branch.replace('/', '%2F')}"
        if not self._fs.exists(self._path(place)):
            return None
        return json.loads("".join(r[0] for r in self.spark.read.text(place, wholetext=True).collect()))["head_sha"]

    def move_cursor(self, branch: str, sha: str) -> None:
        self._fs.mkdirs(self._path(f"{self.path}/branch"))
        self._put(f"branch/{branch.replace('/', '%2F')}", {"head_sha": sha})
