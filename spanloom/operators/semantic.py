"""Descriptions and decisions by a language model, kept only as far as the code bears them out.

A model's answer is JSON with a summary and claims, each about a symbol. A claim stays if the last identifier of its symbol is a
token of the evidence's source or names. Nothing is stored if no claim stays; confidence is kept / (kept + dropped + 1).
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import identity
from spanloom.operators import extract, parse
from spanloom.operators.index import changed_spans, discover_root, grounded
from spanloom.operators.store import Store, audit
from spanloom.providers import LLMProvider, PRProvider
from spanloom.sources import git

IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
#: Kinds that are described; limits of a prompt, of its evidence and of what is stored.
KINDS = ("api_route", "entity", "process_path", "event_handler")
PROMPT, SPANS, SUMMARY, FILES, MESSAGE = 6000, 40, 500, 20, 4000
CONFIDENCE = "cast(get_json_object(payload, '$.n_claims') as double) / (cast(get_json_object(payload, '$.n_claims') as double) + cast(get_json_object(payload, '$.dropped_claims') as double) + 1)"
ASK = "Describe {what} below from its facts and source only. Answer with JSON: {{\"summary\": str, \"claims\": [{{\"text\": str, \"symbol\": str}}]}}; each claim names a symbol of the source.\n\n"


def answered(text: str) -> dict | None:
    """The JSON object of an answer, also from within other text; None if there is none."""
    start, end = text.find("{"), text.rfind("}")
    try:
        got = json.loads(text[start : end + 1]) if 0 <= start < end else None
    except ValueError:
        return None
    return got if isinstance(got, dict) else None


def validate_claims(claims: list, sources: list[str], names: list[str]) -> tuple[list[dict], list[dict]]:
    """(kept, dropped): claims whose symbol ends in an identifier of the sources or names."""
    known = {t for text in [*sources, *names] for t in IDENTIFIER.findall(text or "")}
    kept, dropped = [], []
    for c in claims:
        if isinstance(c, dict):
            last = IDENTIFIER.findall(c["symbol"])[-1:] if isinstance(c.get("symbol"), str) else []
            (kept if last and last[0] in known else dropped).append(c)
    return kept, dropped


def packed(head: str, blocks: list[str], limit: int = PROMPT) -> str:
    """The head and as many whole blocks as fit; the first always."""
    out = head
    for i, b in enumerate(blocks):
        if i and len(out) + len(b) > limit:
            break
        out += b + "\n\n"
    return out


def _asked(provider: LLMProvider):
    """(key, target, target_kind, facts, spans) to (logical_key, payload, evidence) of the answers that hold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, target, kind, facts, spans in zip(b["key"], b["target"], b["target_kind"], b["facts"], b["spans"], strict=True):
                spans = list(spans)[:SPANS]
                if not spans:
                    continue
                prompt = packed(ASK.format(what=f"the {kind} {target}") + (facts or "") + "\n\n", [f"# {s['fq']}\n{s['text']}" for s in spans])
                data = answered(provider.complete(prompt))
                if data is None:
                    continue
                kept, dropped = validate_claims(data.get("claims") or [], [s["text"] for s in spans], [s["fq"] for s in spans])
                if kept:
                    payload = {"target_logical_key": target, "target_kind": kind, "summary": str(data.get("summary", ""))[:SUMMARY], "claims": kept, "dropped_claims": len(dropped), "n_claims": len(kept)}
                    rows.append((key, json.dumps(payload, ensure_ascii=False), [{"span_id": s["span_id"], "role": "describes"} for s in spans]))
            yield pd.DataFrame(rows, columns=["logical_key", "payload", "evidence"])

    return run


def _grounds(st: Store, sha: str) -> DataFrame:
    """(span_id, kind, fq, file, start_line, text) of a snapshot's spans."""
    names = st.table("code_span", sha).select("span_id", F.col("span_kind").alias("kind"), F.col("fq_symbol_path").alias("fq"))
    return st.table("span_occurrence", sha).select("span_id", F.col("file_path").alias("file"), "start_line", F.col("raw_text").alias("text")).join(names, "span_id").where("kind != 'import'")


def _write(st: Store, sha: str, made: DataFrame, kind: str, extractor: str, model: str, version: str) -> tuple[int, int]:
    """Stages, audits and publishes answers as artifacts of one kind; returns how many, and how many claims were dropped."""
    folder = f"{st.path}/answers/{uuid.uuid4().hex}"
    made.write.parquet(folder)  # a model is asked once
    rows = st.spark.read.parquet(folder).withColumns({"kind": F.lit(kind), "extractor_id": F.lit(extractor), "extractor_version": F.lit(version)})
    rows = rows.withColumn("versions", F.coalesce("versions", F.create_map().cast("map<string,string>")) if "versions" in rows.columns else F.create_map().cast("map<string,string>"))
    artifacts, derived = grounded(rows, version, model, CONFIDENCE)
    parts = {"artifact": [st.stage("artifact", artifacts, sha)], "derived_from": [st.stage("derived_from", derived, sha)], "snapshot_entry": [st.stage("snapshot_entry", artifacts.select("logical_key", "artifact_id"), sha)]}
    stored = st.staged("artifact", *parts["artifact"]).drop("sha")
    audit(stored, st.staged("derived_from", *parts["derived_from"]).drop("sha"), st.table("code_span", sha).drop("sha"))
    n, dropped = stored.agg(F.count("*"), F.coalesce(F.sum(F.get_json_object("payload", "$.dropped_claims").cast("long")), F.lit(0))).first()
    if n:
        st.publish(sha, parts)
    return n, dropped


def describe_snapshot(st: Store, sha: str, provider: LLMProvider, version: str = "2") -> tuple[int, int]:
    """Describes routes, entities, paths and handlers, then modules, packages (which see their modules' summaries) and the whole.

    Returns (descriptions, dropped claims). Each stage reads what the one before stored.
    """
    schema = "logical_key string, payload string, evidence array<struct<span_id:string,role:string>>"
    spans = _grounds(st, sha)
    said = lambda kind: st.table("artifact", sha).where((F.col("kind") == "description") & (F.get_json_object("payload", "$.target_kind") == kind)).select(F.get_json_object("payload", "$.target_logical_key").alias("of"), F.get_json_object("payload", "$.summary").alias("said"))
    listed = lambda: F.array_sort(F.collect_list(F.struct("fq", "span_id", "text")))
    form = lambda c: F.transform(c, lambda x: F.struct(x["span_id"].alias("span_id"), x["fq"].alias("fq"), x["text"].alias("text")))

    def of_artifacts() -> DataFrame:
        own = st.table("artifact", sha).where(F.col("kind").isin(*KINDS)).select("artifact_id", "logical_key", "kind", "payload")
        ground = st.table("derived_from", sha).select("artifact_id", "span_id").join(spans.drop("kind"), "span_id").groupBy("artifact_id").agg(listed().alias("s"))
        return own.join(ground, "artifact_id").select(F.concat(F.lit("desc:"), "logical_key").alias("key"), F.col("logical_key").alias("target"), F.col("kind").alias("target_kind"), F.substring("payload", 1, 1500).alias("facts"), form("s").alias("spans"))

    def of_modules() -> DataFrame:
        module = spans.where("kind = 'module'").select("file", F.col("fq").alias("module"))
        rows = spans.join(module, "file").where("fq = module or kind in ('class', 'function')").groupBy("module", "file").agg(listed().alias("s"))
        return rows.select(F.concat(F.lit("desc:module:"), "module").alias("key"), F.col("module").alias("target"), F.lit("module").alias("target_kind"), F.to_json(F.struct("module", "file")).alias("facts"), form("s").alias("spans"))

    def of_packages() -> DataFrame:
        module = spans.where("kind = 'module'")
        members = module.withColumn("package", F.when(F.col("file").endswith("__init__.py"), F.col("fq")).otherwise(F.regexp_extract("fq", r"^(.*)\.[^.]*$", 1))).where("package != ''")
        rows = members.join(said("module"), F.col("fq") == F.col("of"), "left").groupBy("package").agg(listed().alias("s"), F.array_sort(F.collect_list(F.struct(F.col("fq").alias("module"), "said"))).alias("m"))
        return rows.select(F.concat(F.lit("desc:package:"), "package").alias("key"), F.col("package").alias("target"), F.lit("package").alias("target_kind"), F.substring(F.to_json("m"), 1, 3000).alias("facts"), form("s").alias("spans"))

    def of_repository() -> DataFrame:
        top = spans.where("kind = 'module' and (file like '%__init__.py' or instr(fq, '.') = 0)").orderBy("fq").limit(SPANS)
        rows = top.groupBy().agg(listed().alias("s")).where("size(s) > 0")
        overview = said("package").groupBy().agg(F.array_sort(F.collect_list(F.struct("of", "said"))).alias("m"))
        return rows.join(overview, F.lit(True)).select(F.lit("desc:repo").alias("key"), F.lit("repo").alias("target"), F.lit("repo").alias("target_kind"), F.substring(F.to_json("m"), 1, 3000).alias("facts"), form("s").alias("spans"))

    told, lost = 0, 0
    for stage in (of_artifacts, of_modules, of_packages, of_repository):
        made = stage().mapInPandas(_asked(provider), schema)
        n, dropped = _write(st, sha, made, "description", "llm_describe", provider.model_id, version)
        told, lost = told + n, lost + dropped
    return told, lost


@dataclass
class MineResult:
    scanned: int = 0
    mined: int = 0
    merges: int = 0
    unindexed: int = 0
    already_mined: int = 0
    dropped_claims: int = 0
    enriched: int = 0
    fetch_failed: int = 0


def mine_history(spark: SparkSession, st: Store, repo: str, provider: LLMProvider, start: str, max_commits: int = 20, force: bool = False, requests: PRProvider | None = None, version: str = "2") -> MineResult:
    """Decisions of at most ``max_commits`` commits of the first-parent chain from ``start`` on, on the spans that each changed.

    Merges, commits that are not indexed, those mined before and those that change no span are passed over without asking anyone.
    """
    out, at = MineResult(), git.resolve(repo, start)
    while at is not None and out.scanned < max_commits:
        sha, parents = at, git.parents(repo, at)
        at, out.scanned = (parents[0] if parents else None), out.scanned + 1
        if len(parents) > 1:
            out.merges += 1
        elif not st.has(sha):
            out.unindexed += 1
        elif not force and not st.table("snapshot_entry", sha).where(F.col("logical_key") == f"decision:{sha}").isEmpty():
            out.already_mined += 1
        else:
            _mine(spark, st, repo, provider, sha, parents[0] if parents else None, requests, version, out)
    return out


def _mine(spark, st, repo, provider, sha, parent, requests, version, out: MineResult) -> None:
    spans = _grounds(st, sha)
    if parent is not None:
        if st.has(parent):
            new = changed_spans(st, sha, parent)
        else:
            files = git.blobs(spark, repo, parent)
            root = discover_root([r["path"] for r in files.select("path").collect()])
            old = extract.spans(parse.facts(files.withColumn("module", identity.module_name(F.col("path"), F.lit(root))))).select("span_id")
            new = st.table("code_span", sha).select("span_id").distinct().join(old, "span_id", "left_anti")
        spans = spans.join(new, "span_id", "left_semi")
    total = spans.count()
    if not total:
        return
    rows = [r.asDict() for r in spans.orderBy("file", "start_line", "span_id").limit(SPANS).collect()]
    files = [r["file"] for r in spans.select("file").distinct().orderBy("file").limit(FILES).collect()]
    author, when, message = git.git(repo, "show", "-s", "--format=%an%x1f%aI%x1f%B", sha).split("\x1f", 2)
    number = git.pull_number(message.strip().split("\n")[0]) if requests is not None else None
    pull = requests.fetch(number) if number is not None else None
    out.fetch_failed += number is not None and pull is None
    more = f"Pull request: {pull.title}\n{pull.body}"[:MESSAGE] if pull else ""
    prompt = packed(ASK.format(what="the decision that this commit makes") + message[:MESSAGE] + "\n" + more + "\nFiles: " + ", ".join(files) + "\n\n", [f"# {r['fq']}\n{r['text']}" for r in rows])
    data = answered(provider.complete(prompt))
    kept, dropped = validate_claims((data or {}).get("claims") or [], [r["text"] for r in rows], [r["fq"] for r in rows])
    out.dropped_claims += len(dropped)
    if data is None or not kept:
        return
    payload = {"sha": sha, "message": message.strip(), "author": author, "authored_at": when, "summary": str(data.get("summary", ""))[:SUMMARY], "claims": kept, "dropped_claims": len(dropped), "n_claims": len(kept), "files_changed": files, "total_changed_spans": total, "limitations": ["grounding_capped"] if total > SPANS else []}
    if pull:
        payload |= {"pr_number": pull.number, "pr_title": pull.title, "pr_author": pull.author}
    versions = {"pr_text": hashlib.sha256(more.encode()).hexdigest()[:12]} if pull else {}
    made = spark.createDataFrame([(f"decision:{sha}", json.dumps(payload, ensure_ascii=False), [{"span_id": r["span_id"], "role": "changed"} for r in rows], versions)], "logical_key string, payload string, evidence array<struct<span_id:string,role:string>>, versions map<string,string>")
    _write(st, sha, made, "decision", "llm_mine", provider.model_id, version)
    out.mined += 1
    out.enriched += pull is not None
