"""Serving a snapshot: what a line rests on, what is known of a target, what resembles a query. Each is one plan.

A unit is (logical_key, kind, method, confidence, freshness, summary, payload, provenance, cost). A target that nothing matches, and
a snapshot that is not there, give an empty answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from spanloom.operators.store import Store
from spanloom.providers import EmbeddingProvider

BUDGET, TOP = 2000, 8


def _get(path: str) -> Column:
    return F.get_json_object("payload", path)


def summary() -> Column:
    """One line of an artifact, by its kind."""
    lines = {
        "import_edge": F.concat(_get("$.importer"), F.lit(" imports "), _get("$.imported")),
        "call_edge": F.concat(_get("$.caller"), F.lit(" calls "), _get("$.callee"), F.lit(" ("), _get("$.resolution"), F.lit(")")),
        "api_route": F.concat(_get("$.method"), F.lit(" "), _get("$.path"), F.lit(" handled by "), _get("$.handler")),
        "entity": F.concat(_get("$.framework"), F.lit(" entity "), _get("$.qualified_name")),
        "event_handler": F.concat(_get("$.handler"), F.lit(" handles "), F.array_join(F.from_json(_get("$.families"), "array<string>"), ", ")),
        "public_symbol": F.concat(_get("$.public_qualified_name"), F.lit(" is exported as "), F.coalesce(_get("$.symbol_kind"), F.lit("name"))),
        "process_path": F.concat(_get("$.entrypoint_reference"), F.lit(" reaches "), _get("$.sink.name"), F.lit(" at "), _get("$.terminal"), F.lit(" in "), _get("$.depth"), F.lit(" steps")),
        "description": _get("$.summary"),
        "decision": _get("$.summary"),
    }
    out = F.col("logical_key")
    for kind, line in lines.items():
        out = F.when(F.col("kind") == kind, F.coalesce(line, F.col("logical_key"))).otherwise(out)
    return out


def units(st: Store, sha: str) -> DataFrame:
    """All artifacts of a snapshot as units. Provenance is gathered by artifact on its own key before it meets them."""
    artifacts = st.table("artifact", sha).drop("sha")
    newest = st.table("snapshot_entry").join(st.table("commit_ref").select("sha", "ingested_at"), "sha")
    newest = newest.groupBy("logical_key").agg(F.max_by("sha", F.struct("ingested_at", "sha")).alias("latest"))
    at = st.table("span_occurrence", sha).select("span_id", "file_path", "start_line", "end_line")
    ground = st.table("derived_from", sha).drop("sha").join(at, "span_id", "left").groupBy("artifact_id").agg(F.array_sort(F.collect_list(F.struct("file_path", "start_line", "end_line", "role", "span_id"))).alias("provenance"))
    fresh = F.when(F.col("latest") == sha, "current").otherwise(F.concat(F.lit("stale@"), F.substring("latest", 1, 12)))
    rows = artifacts.join(ground, "artifact_id").join(newest, "logical_key")
    rows = rows.select("logical_key", "kind", F.when(F.col("is_deterministic"), "deterministic").otherwise("llm-grounded").alias("method"), "confidence", fresh.alias("freshness"), summary().alias("summary"), "payload", "provenance", "artifact_id")
    return rows.withColumn("cost", F.floor((F.length("logical_key") + F.length("summary") + F.length("payload") + F.length(F.to_json("provenance"))) / 4))


def trimmed(rows: DataFrame, budget: int, limit: int | None = None) -> DataFrame:
    """The first units by confidence, kind and key whose costs fit the budget, at least one; ``omitted`` and ``total_matched`` on each row.

    As each unit costs a token or more, no more than ``budget`` of them can fit: the running sum is over so many rows at most.
    """
    total = rows.groupBy().agg(F.count("*").alias("total_matched"))
    best = rows.orderBy(F.desc("confidence"), "kind", "logical_key").limit(min(budget + 1, limit or budget + 1))
    by = Window.orderBy(F.desc("confidence"), "kind", "logical_key")
    best = best.withColumn("spent", F.sum(F.greatest(F.col("cost"), F.lit(1))).over(by)).withColumn("place", F.row_number().over(by)).where((F.col("place") == 1) | (F.col("spent") <= budget))
    best = best.withColumn("kept", F.max("place").over(Window.partitionBy()))
    return best.join(F.broadcast(total), F.lit(True)).withColumn("omitted", F.col("total_matched") - F.col("kept")).drop("spent", "kept")


def resolved_keys(st: Store, sha: str, target: str) -> DataFrame:
    """(logical_key): the first tier that has any: the key itself, keys that begin so, what rests on the file, on the module or below it."""
    keys = st.table("snapshot_entry", sha).select("logical_key", "artifact_id").distinct()
    at = st.table("derived_from", sha).select("artifact_id", "span_id")
    in_file = st.table("span_occurrence", sha).where(F.col("file_path") == target).select("span_id")
    below = st.table("code_span", sha).where((F.col("fq_symbol_path") == target) | F.startswith("fq_symbol_path", F.lit(f"{target}."))).select("span_id")
    on = lambda spans: at.join(spans, "span_id", "left_semi").select("artifact_id").distinct().join(keys, "artifact_id").select("logical_key").distinct()
    tiers = [keys.where(F.col("logical_key") == target).select("logical_key"), keys.where(F.startswith("logical_key", F.lit(target))).select("logical_key"), on(in_file), on(below)]
    every = None
    for i, t in enumerate(tiers):
        t = t.withColumn("tier", F.lit(i))
        every = t if every is None else every.unionByName(t)
    best = every.groupBy().agg(F.min("tier").alias("best"))
    return every.join(F.broadcast(best), F.col("tier") == F.col("best")).select("logical_key").distinct()


def get_knowledge(st: Store, target: str, sha: str | None = None, token_budget: int = BUDGET) -> DataFrame:
    sha = sha or st.latest() or ""
    return trimmed(units(st, sha).join(resolved_keys(st, sha, target), "logical_key", "left_semi"), token_budget)


def find_provenance(st: Store, file: str, line: int, sha: str | None = None) -> DataFrame:
    """(span_id, fq, start_line, end_line, role, unit columns): spans that hold a line, narrowest first, and what rests on them."""
    sha = sha or st.latest() or ""
    at = st.table("span_occurrence", sha).where((F.col("file_path") == file) & (F.col("start_line") <= line) & (F.col("end_line") >= line)).select("span_id", "start_line", "end_line")
    names = st.table("code_span", sha).select("span_id", F.col("fq_symbol_path").alias("fq"))
    held = st.table("derived_from", sha).select("artifact_id", "span_id", "role")
    rows = at.join(names, "span_id").join(held, "span_id", "left").join(units(st, sha), "artifact_id", "left")
    return rows.orderBy(F.expr("end_line - start_line"), "fq", "logical_key")


def embed_text() -> Column:
    """What of an artifact is embedded: its kind, its line and its key's words."""
    return F.concat_ws(" ", F.replace("kind", F.lit("_"), F.lit(" ")), summary(), F.regexp_replace("logical_key", "[^A-Za-z0-9]+", " "))


def _embedded(rows: DataFrame, provider: EmbeddingProvider, text: str) -> DataFrame:
    @F.pandas_udf(ArrayType(FloatType()))
    def embed(x):
        import pandas as pd

        return pd.Series(provider.embed(x.fillna("").tolist()))

    return rows.withColumn("vector", embed(F.col(text))).withColumn("model_id", F.lit(provider.model_id))


def embed_snapshot(st: Store, sha: str, provider: EmbeddingProvider) -> int:
    """Embeds the artifacts that have no vector of this model yet; returns how many."""
    have = st.table("embedding", sha).where(F.col("model_id") == provider.model_id).select("artifact_id")
    wanted = st.table("artifact", sha).join(have, "artifact_id", "left_anti").select("artifact_id", embed_text().alias("text"))
    n = wanted.count()
    if n:
        st.publish(sha, {"embedding": [st.stage("embedding", _embedded(wanted, provider, "text").select("artifact_id", "model_id", "vector"), sha)]})
    return n


def index_chunks(st: Store, sha: str, sources: DataFrame, provider: EmbeddingProvider, lines: int = 40, overlap: int = 10) -> int:
    """Overlapping line windows of (path, source), embedded: the plain retrieval that knowledge is compared with."""
    cut = F.split("source", "\n")
    rows = sources.select("path", cut.alias("l"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size("l") - lines) / (lines - overlap)).cast("int")))
    rows = rows.select("path", "l", F.explode(starts).alias("w")).withColumn("start_line", F.col("w") * (lines - overlap) + 1)
    rows = rows.select(F.col("path").alias("file_path"), "start_line", F.least(F.col("start_line") + lines - 1, F.size("l")).alias("end_line"), F.array_join(F.slice("l", F.col("start_line"), F.lit(lines)), "\n").alias("raw_text")).where("trim(raw_text) != ''")
    folder = st.stage("rag_chunk", _embedded(rows, provider, "raw_text").select("file_path", "start_line", "end_line", "raw_text", "model_id", "vector"), sha)
    st.publish(sha, {"rag_chunk": [folder]})
    return st.staged("rag_chunk", folder).count()


def _distance(vector: list[float]) -> Column:
    asked = F.array(*[F.lit(float(x)) for x in vector])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(F.col("vector"), F.col("vector"))) * F.sqrt(dot(asked, asked))
    return F.when(norms > 0, 1 - dot(F.col("vector"), asked) / norms).otherwise(F.lit(1.0))


def rag_retrieve(st: Store, query: str, provider: EmbeddingProvider, sha: str | None = None, k: int = 5) -> DataFrame:
    sha = sha or st.latest() or ""
    rows = st.table("rag_chunk", sha).where(F.col("model_id") == provider.model_id)
    return rows.withColumn("distance", _distance(provider.embed([query])[0])).orderBy("distance", "file_path", "start_line").limit(k).drop("vector")


def search_knowledge(st: Store, query: str, provider: EmbeddingProvider, sha: str | None = None, k: int = TOP, token_budget: int = BUDGET) -> DataFrame:
    """The ``k`` units nearest to the query, within the budget; ``total_matched`` is at most ``k``."""
    sha = sha or st.latest() or ""
    near = st.table("embedding", sha).where(F.col("model_id") == provider.model_id).withColumn("distance", _distance(provider.embed([query])[0]))
    keys = near.join(st.table("snapshot_entry", sha).select("artifact_id", "logical_key"), "artifact_id").orderBy("distance", "logical_key").limit(k).select("artifact_id")
    return trimmed(units(st, sha).join(F.broadcast(keys), "artifact_id", "left_semi"), token_budget)  # k keys
