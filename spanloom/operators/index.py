"""Indexing a commit: blobs, facts (taken over from a parent snapshot where files are unchanged), artifacts, audits, publishing."""

from __future__ import annotations

import datetime
import json
import tomllib
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import identity
from spanloom.operators import extract, parse, sinks, store
from spanloom.sources import git

SINK_RULES = (".kb/sinks.json", ".kb/sinks.yaml")


@dataclass
class IndexResult:
    sha: str
    mode: str
    files: int = 0
    parsed: int = 0
    reused: int = 0
    spans: int = 0
    artifacts: int = 0
    gaps: list[str] = field(default_factory=list)


def discover_root(paths: list[str]) -> str:
    """``src`` if any path is below it, else the repository's own root."""
    return "src" if any(p.startswith("src/") for p in paths) else ""


def framework_versions(texts: dict[str, str]) -> dict[str, str]:
    """Versions that lock files pin, else what the project file asks for."""
    wanted, found = ("fastapi", "pydantic", "sqlalchemy"), {}
    for name in ("uv.lock", "poetry.lock"):
        for p in tomllib.loads(texts[name]).get("package", []) if name in texts else []:
            if (key := str(p.get("name", "")).lower()) in wanted and "version" in p:
                found.setdefault(key, str(p["version"]))
    for spec in tomllib.loads(texts["pyproject.toml"]).get("project", {}).get("dependencies", []) if "pyproject.toml" in texts else []:
        for name in wanted:
            if spec.replace("-", "_").lower().startswith(name):
                found.setdefault(name, f"spec:{spec}")
    return found


def sink_rules(texts: dict[str, str]) -> list[tuple[str, list[str]]]:
    """The rules of the repository's override file, as JSON or, where a YAML reader is installed, YAML."""
    for name in SINK_RULES:
        if name in texts:
            if name.endswith(".json"):
                return sinks.registry(json.loads(texts[name]))
            try:
                import yaml
            except ImportError as e:
                raise ValueError(f"{name} needs a YAML reader; write it as {SINK_RULES[0]}") from e
            return sinks.registry(yaml.safe_load(texts[name]))
    return sinks.registry()


def grounded(artifacts: DataFrame, prompt: str = "", model: str = "", confidence: str = "1.0") -> tuple[DataFrame, DataFrame]:
    """(artifact, derived_from) rows of what extractors return: the ids, and an edge a span."""
    ids = identity.artifact_id(F.transform("evidence", lambda e: e["span_id"]), F.col("logical_key"), F.col("extractor_id"), F.col("extractor_version"), F.lit(prompt), F.lit(model), F.col("versions"))
    rows = artifacts.withColumn("artifact_id", ids)
    table = rows.select("artifact_id", "kind", "logical_key", "extractor_id", "extractor_version", F.lit(prompt).alias("prompt_version"), F.lit(model).alias("model_id"), "versions", "payload", F.expr(confidence).cast("double").alias("confidence"), F.lit(not model).alias("is_deterministic"))
    return table, rows.select("artifact_id", F.explode("evidence").alias("e")).select("artifact_id", "e.span_id", "e.role")


def occurrences(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """(span_id, file_path, start_line, end_line, raw_text): the first place of each span."""
    at = extract.spans(facts).groupBy("span_id").agg(F.min(F.struct("path", "start_line", "end_line")).alias("p")).select("span_id", "p.*")
    lines = F.slice(F.split("source", "\n"), F.col("start_line"), F.greatest(F.lit(1), F.col("end_line") - F.col("start_line") + 1))
    return at.join(sources.select("path", "source"), "path").select("span_id", F.col("path").alias("file_path"), "start_line", "end_line", F.array_join(lines, "\n").alias("raw_text"))


def parent_of(st: store.Store, repo: str, sha: str, parent: str | None, root: str) -> str | None:
    """The snapshot to take facts from: the given one, which has to be indexed, else the first indexed parent; none if the root moved."""
    if parent is not None and not st.has(parent):
        raise ValueError(f"parent {parent} is not indexed")
    found = parent or next((p for p in git.parents(repo, sha) if st.has(p)), None)
    return found if found is None or st.manifests()[found].get("root") == root else None


def index_commit(spark: SparkSession, st: store.Store, repo: str, revision: str, incremental: bool = False, parent: str | None = None, root: str | None = None) -> IndexResult:
    """Indexes a commit. Facts of files whose blobs the parent snapshot has are taken over; the result is that of a full run."""
    sha = git.resolve(repo, revision)
    files = git.blobs(spark, repo, sha).persist()
    paths = [r["path"] for r in files.select("path").collect()]  # the tree's names, one a file
    root = discover_root(paths) if root is None else root
    own = files.where(F.col("path").startswith(f"{root}/")) if root else files
    own = own.withColumn("module", identity.module_name(F.col("path"), F.lit(root))).where("module != '' or path like '%__init__.py'")
    before = parent_of(st, repo, sha, parent, root) if incremental or parent is not None else None
    kept = st.table("facts", before).drop("sha").join(own.select("path", "oid"), ["path", "oid"], "left_semi") if before else None
    fresh = own.join(kept.select("path").distinct(), "path", "left_anti") if before else own
    parsed = parse.facts(fresh).join(fresh.select("path", "oid"), "path").select(*[c.split()[0] for c in store.SCHEMAS["facts"].split(", ")])
    parts = {"facts": [st.stage("facts", parsed.unionByName(kept) if before else parsed, sha)]}
    facts = st.staged("facts", parts["facts"][0]).drop("sha").persist()
    texts = {r["path"]: r["source"] for r in git.blobs(spark, repo, sha, suffix="", only=["uv.lock", "poetry.lock", "pyproject.toml", *SINK_RULES]).collect()}  # five files at most
    first = f"{st.path}/extracted/{sha}-{uuid.uuid4().hex}"

    def keep(made: DataFrame) -> DataFrame:
        made.coalesce(max(1, spark.sparkContext.defaultParallelism)).write.parquet(first)
        return spark.read.schema(made.schema).parquet(first)

    made = extract.extract_all(facts, framework_versions(texts), sink_rules(texts), keep)
    artifacts, derived = grounded(made)
    spans = extract.spans(facts).select("span_id", F.lit("python").alias("lang"), F.col("kind").alias("span_kind"), F.col("fq").alias("fq_symbol_path"), F.col("fingerprint").alias("structural_fingerprint"), F.lit(identity.NORMALIZATION_VERSION).alias("normalization_version")).dropDuplicates(["span_id"])
    for name, rows in (("code_span", spans), ("span_occurrence", occurrences(facts, own)), ("artifact", artifacts)):
        parts[name] = [st.stage(name, rows, sha)]
    artifacts = st.staged("artifact", parts["artifact"][0]).drop("sha")
    parts["derived_from"] = [st.stage("derived_from", derived, sha)]
    parts["snapshot_entry"] = [st.stage("snapshot_entry", artifacts.select("logical_key", "artifact_id"), sha)]
    store.audit(artifacts, st.staged("derived_from", *parts["derived_from"]).drop("sha"), st.staged("code_span", *parts["code_span"]).drop("sha"))
    when = datetime.datetime.now(datetime.UTC)
    commit = spark.createDataFrame([(sha, git.parents(repo, sha), when)], store.SCHEMAS["commit_ref"])
    parts["commit_ref"] = [st.stage("commit_ref", commit, sha)]
    st.publish(sha, parts, root=root, ingested_at=when.isoformat(), parents=git.parents(repo, sha))
    total, n_fresh = own.count(), fresh.count()
    files.unpersist()
    result = IndexResult(sha, "incremental" if before else "full", total, n_fresh, total - n_fresh, facts.where("fact = 'span'").count(), artifacts.count(), sorted(r["path"] for r in facts.where("fact = 'gap'").select("path").collect()))
    facts.unpersist()
    return result


def changed_spans(st: store.Store, left: str, right: str) -> DataFrame:
    """Spans that ``left`` has and ``right`` lacks."""
    return st.table("code_span", left).select("span_id").distinct().join(st.table("code_span", right).select("span_id"), "span_id", "left_anti")


def invalidated(st: store.Store, old: str, new: str) -> DataFrame:
    """Logical keys of ``old`` that rest on a span which ``new`` lacks."""
    gone = changed_spans(st, old, new)
    return st.table("derived_from", old).drop("sha").join(gone, "span_id", "left_semi").join(st.table("snapshot_entry", old).drop("sha"), "artifact_id").select("logical_key").distinct()
