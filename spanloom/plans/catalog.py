"""The query catalogue: one query an operator, over the stand-in model, for Spark and for the checking engine."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.plans.dialect import Duck, Spark
from spanloom.plans.model import span_id, with_parts

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
TEXTS: dict[str, Callable] = {}


def q(name: str):
    def put(f):
        TEXTS[f"q_{name}"] = f
        return f

    return put


def plain(**texts: str) -> None:
    for name, text in texts.items():
        TEXTS[f"q_{name}"] = lambda d, text=text: text


MODULE = "replace(substr(path, 1, length(path) - 3), '/', '.')"

plain(
    scan_files="SELECT sha, count(*) AS n_files, CAST(sum(length(raw)) AS BIGINT) AS n_chars FROM file GROUP BY sha",
    first_party_root="SELECT sha, CASE WHEN max(CASE WHEN substr(path, 1, 3) = 'en/' THEN 1 ELSE 0 END) = 1 THEN 'en' ELSE '' END AS root FROM file GROUP BY sha",
    module_names=f"SELECT path, {MODULE} AS module, CASE WHEN substr(path, 1, 3) = 'en/' THEN substr(path, 4) END AS below_root FROM file",
    parent_basename="SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, regexp_extract(path, '([^/]*)$', 1) AS basename FROM file",
    package_members="SELECT p.package, f.path FROM (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS package FROM file) p JOIN file f ON regexp_extract(f.path, '^(.*)/[^/]*$', 1) = p.package",
    changed_files="SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM (SELECT lang, sha, concat(lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS STRING)) AS k, raw FROM file WHERE sha = 'src1') a FULL OUTER JOIN (SELECT concat(lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS STRING)) AS k, raw FROM file WHERE sha = 'src2') b ON a.k = b.k WHERE a.raw IS DISTINCT FROM b.raw",
    incremental_union="SELECT lang, count(*) AS n, count(DISTINCT raw) AS texts FROM (SELECT lang, raw FROM file WHERE sha = 'src1' UNION ALL SELECT lang, raw FROM file WHERE sha = 'src2') u GROUP BY lang",
    occurrence_first="SELECT span_id, sha, path, start_line FROM (SELECT span_id, f.sha, f.path, c.start_line, row_number() OVER (PARTITION BY span_id, f.sha ORDER BY f.path, c.start_line) AS rn FROM chunk c JOIN file f ON f.doc_id = c.doc_id) x WHERE rn = 1",
    span_dedup="SELECT span_id, min(doc_id) AS first_doc, count(*) AS n FROM chunk GROUP BY span_id",
    span_identity="SELECT doc_id, chunk_idx, span_id FROM chunk",
    distinct_identity="SELECT count(DISTINCT span_id) AS ids, count(*) AS occurrences FROM chunk",
    text_fingerprint="SELECT fingerprint, count(*) AS n FROM chunk GROUP BY fingerprint",
    insert_ignore="SELECT sha, count(*) AS n FROM (SELECT DISTINCT sha FROM artifact WHERE sha >= '1995-01') n WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT sha FROM artifact WHERE sha < '1996-01') o WHERE o.sha = n.sha) GROUP BY sha",
    keep_first="SELECT logical_key, artifact_id FROM (SELECT logical_key, artifact_id, row_number() OVER (PARTITION BY logical_key ORDER BY created_at, artifact_id) AS rn FROM artifact) x WHERE rn = 1",
    upsert_latest="SELECT sha, logical_key, artifact_id FROM (SELECT sha, logical_key, artifact_id, row_number() OVER (PARTITION BY sha, logical_key ORDER BY artifact_id DESC) AS rn FROM artifact) x WHERE rn = 1",
    role_first_wins="SELECT artifact_id, span_id, role FROM derived",
    grounded_only="SELECT a.artifact_id, a.kind FROM artifact a WHERE EXISTS (SELECT 1 FROM derived d WHERE d.artifact_id = a.artifact_id)",
    orphans="SELECT a.artifact_id FROM artifact a LEFT ANTI JOIN derived d ON d.artifact_id = a.artifact_id",
    check_constraints="SELECT l_orderkey, l_linenumber, l_partkey, l_discount FROM lineitem WHERE NOT (l_discount BETWEEN 0 AND 0.05) OR (l_returnflag = 'R' AND l_linestatus = 'O')",
    referential_audit="SELECT 'span' AS side, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey) UNION ALL SELECT 'artifact', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)",
    is_indexed="SELECT c.sha, CASE WHEN s.sha IS NULL THEN 0 ELSE 1 END AS indexed FROM (SELECT sha FROM commit_ref UNION ALL SELECT 'none' AS sha) c LEFT JOIN (SELECT DISTINCT sha AS sha FROM snapshot) s ON s.sha = c.sha",
    exact_lookup="SELECT sha, artifact_id, kind FROM artifact WHERE logical_key = 'cust:7'",
    in_list_semi="SELECT artifact_id, kind FROM artifact WHERE kind IN ('1-URGENT', '2-HIGH') AND logical_key IN ('cust:1', 'cust:2', 'cust:3', 'cust:4', 'cust:5')",
    prefix_match="SELECT DISTINCT logical_key FROM artifact WHERE logical_key LIKE 'cust:1%'",
    module_subtree="SELECT span_id, fq FROM span WHERE span_kind = 'ECONOMY' OR fq LIKE 'ECONOMY.%'",
    spans_at_location="SELECT span_id, fq, start_line, end_line FROM span WHERE file = 'Brand#12' AND start_line <= 20 AND end_line >= 20",
    artifacts_on_span="SELECT s.sha, s.logical_key, d.span_id, d.role FROM snapshot s JOIN derived d ON d.artifact_id = s.artifact_id",
    provenance="SELECT s.logical_key, d.span_id, d.role, p.file, p.start_line FROM snapshot s JOIN derived d ON d.artifact_id = s.artifact_id JOIN span p ON p.span_id = d.span_id WHERE s.sha = '1996-05'",
    grounding_spans="SELECT s.sha, s.logical_key, p.fq, d.role FROM snapshot s JOIN artifact a ON a.artifact_id = s.artifact_id JOIN derived d ON d.artifact_id = a.artifact_id JOIN span p ON p.span_id = d.span_id",
    span_locations="SELECT c.span_id, f.path, c.start_line, c.end_line FROM chunk c JOIN file f ON f.doc_id = c.doc_id WHERE f.sha = 'src3'",
    latest_snapshot="SELECT sha, ingested_at FROM commit_ref ORDER BY ingested_at DESC, sha LIMIT 1",
    latest_per_key="SELECT logical_key, sha FROM (SELECT a.logical_key, a.sha, row_number() OVER (PARTITION BY a.logical_key ORDER BY c.ingested_at DESC, a.sha) AS rn FROM artifact a JOIN commit_ref c ON c.sha = a.sha) x WHERE rn = 1",
    freshness="SELECT s.sha, s.logical_key, CASE WHEN s.sha = l.latest THEN 'current' ELSE concat('stale@', l.latest) END AS freshness FROM snapshot s JOIN (SELECT logical_key, max(sha) AS latest FROM snapshot GROUP BY logical_key) l ON l.logical_key = s.logical_key",
    invalidate_one_hop="SELECT DISTINCT s.logical_key FROM snapshot s JOIN derived d ON d.artifact_id = s.artifact_id WHERE d.span_id IN (SELECT p_partkey FROM part WHERE p_size = 10)",
    call_resolve="SELECT e.caller, e.callee, CASE WHEN a.file = b.file THEN 'same_module' WHEN a.span_kind = b.span_kind THEN 'self' ELSE 'imported' END AS resolution FROM edge e JOIN span a ON a.span_id = e.caller JOIN span b ON b.span_id = e.callee",
    import_alias="SELECT p.page_id, s.s_suppkey FROM (SELECT page_id, regexp_extract(url, '/([0-9]+)', 1) AS n FROM pages) p JOIN supplier s ON CAST(s.s_suppkey AS STRING) = substr(p.n, 1, 2)",
    ambiguous_lookup="SELECT short, min(span_id) AS span_id, CASE WHEN count(*) > 1 THEN 1 ELSE 0 END AS ambiguous FROM (SELECT span_id, regexp_extract(fq, '([^ .]*)$', 1) AS short FROM span) x GROUP BY short",
    fallback_join="SELECT d.doc_id, coalesce(l.quality, -1) AS quality, CASE WHEN l.doc_id IS NULL THEN 'approximate' ELSE 'exact' END AS span_mapping FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    related_entities="SELECT DISTINCT a.span_id, b.span_id AS target FROM (SELECT span_id, regexp_extract(fq, '([^ .]*)$', 1) AS token FROM span) a JOIN (SELECT span_id, regexp_extract(fq, '([^ .]*)$', 1) AS token FROM span) b ON a.token = b.token AND a.span_id <> b.span_id",
    surface_resolve="SELECT c_custkey, CASE WHEN o_custkey IS NULL THEN c_mktsegment ELSE 'seen' END AS c_mktsegment FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) o ON o_custkey = c_custkey",
    sink_registry_merge="SELECT coalesce(o.name, b.name) AS name, coalesce(o.pattern, b.pattern) AS pattern FROM (SELECT r_name AS name, concat(r_name, '.*') AS pattern FROM region) b FULL OUTER JOIN (SELECT n_name AS name, concat('*.', n_name) AS pattern FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'ASIA', 'override') o ON o.name = b.name",
    path_edges="SELECT l_orderkey, step, next_step FROM (SELECT l_orderkey, l_partkey AS step, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS next_step FROM lineitem) x WHERE next_step IS NOT NULL",
    topn_cap="SELECT caller, callee, n, CASE WHEN n > 4 THEN 1 ELSE 0 END AS capped FROM (SELECT caller, callee, row_number() OVER (PARTITION BY caller ORDER BY callee) AS rn, count(*) OVER (PARTITION BY caller) AS n FROM edge) x WHERE rn <= 4",
    counts_by_kind="SELECT a.kind, count(*) AS n FROM snapshot s JOIN artifact a ON a.artifact_id = s.artifact_id WHERE a.kind <> '5-LOW' GROUP BY a.kind",
    distinct_keys="SELECT DISTINCT logical_key, kind FROM artifact",
    module_targets="SELECT file, count(*) AS n, coalesce(min(CASE WHEN span_kind = 'ECONOMY' THEN fq END), min(fq)) AS module FROM span GROUP BY file",
    repo_target="SELECT span_kind, min(span_id) AS span_id FROM span GROUP BY span_kind",
    edge_directions="SELECT a.file, CAST(sum(CASE WHEN a.file = b.file THEN 1 ELSE 0 END) AS BIGINT) AS internal, CAST(sum(CASE WHEN a.file <> b.file THEN 1 ELSE 0 END) AS BIGINT) AS outgoing FROM edge e JOIN span a ON a.span_id = e.caller JOIN span b ON b.span_id = e.callee GROUP BY a.file",
    package_rollup="SELECT DISTINCT a.span_kind AS from_package, b.span_kind AS to_package FROM edge e JOIN span a ON a.span_id = e.caller JOIN span b ON b.span_id = e.callee WHERE a.span_kind <> b.span_kind",
    index_counters="SELECT count(*) AS scanned, CAST(sum(CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS parsed, CAST(sum(CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS reused FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    classify_signals="SELECT p_partkey, CASE WHEN p_size > 40 THEN 'dataclass' WHEN p_type = 'PROMO' THEN 'orm' WHEN p_retailprice > 1500 THEN 'model' ELSE 'none' END AS framework, CASE WHEN (CASE WHEN p_size > 40 THEN 1 ELSE 0 END) + (CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END) + (CASE WHEN p_retailprice > 1500 THEN 1 ELSE 0 END) > 1 THEN 1 ELSE 0 END AS many FROM part",
    confidence="SELECT c_mktsegment, round(sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) / (count(*) + 1), 6) AS confidence FROM customer GROUP BY c_mktsegment",
    judge_means="SELECT d.lang, round(avg(CAST(l.quality AS DOUBLE)), 6) AS accuracy, round(avg(CAST(l.toxic AS DOUBLE)), 6) AS hallucination FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY d.lang",
    recall_at_k="SELECT a.artifact_id, count(DISTINCT b.span_id) AS hits FROM (SELECT artifact_id, span_id FROM derived WHERE role = 'R') a JOIN (SELECT artifact_id, span_id FROM derived) b ON a.artifact_id = b.artifact_id AND a.span_id = b.span_id GROUP BY a.artifact_id",
    summarize="SELECT artifact_id, CASE WHEN kind = '1-URGENT' THEN concat('urgent ', logical_key) WHEN kind = '2-HIGH' THEN concat('high ', coalesce(sha, '?')) ELSE kind END AS summary FROM artifact",
    embed_text="SELECT artifact_id, concat_ws(' ', kind, CASE WHEN price > 100000 THEN logical_key END, sha) AS text FROM artifact",
    truncate="SELECT conv_id, turn, substr(text, 1, 60) AS head FROM conversations",
    classify_case="SELECT event_id, CASE WHEN value > 90 THEN 'path' WHEN event_type = 'click' THEN 'body' WHEN user_id % 2 = 0 THEN 'query' ELSE 'unknown' END AS param FROM events",
    subject_number="SELECT page_id, regexp_extract(url, '([0-9]+)$', 1) AS n FROM pages",
    url_slug="SELECT page_id, regexp_extract(url, '^https?://([^/]+)/', 1) AS host, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS slug FROM pages",
    version_coalesce="SELECT o.o_orderkey, coalesce(CASE WHEN o.o_orderstatus = 'O' THEN 'lock' END, CASE WHEN o.o_totalprice > 200000 THEN 'spec' END, 'unknown') AS version FROM orders o",
    token_budget="SELECT artifact_id, sha FROM (SELECT artifact_id, sha, sum(cost) OVER (PARTITION BY sha ORDER BY price DESC, artifact_id ROWS UNBOUNDED PRECEDING) AS spent, row_number() OVER (PARTITION BY sha ORDER BY price DESC, artifact_id) AS rn FROM (SELECT artifact_id, sha, price, length(concat(kind, logical_key, sha)) AS cost FROM artifact) x) y WHERE rn = 1 OR spent <= 300",
    prompt_pack="SELECT conv_id, count(*) AS kept FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS spent, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) x WHERE rn = 1 OR spent <= 600 GROUP BY conv_id",
    ordinals="SELECT l_orderkey, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_extendedprice, l_linenumber) - 1 AS ordinal FROM lineitem",
    chunk_windows="SELECT doc_id, chunk_idx, start_line, end_line, length(raw) AS n_chars FROM window_",
    rank_units="SELECT sha, logical_key, row_number() OVER (PARTITION BY sha ORDER BY confidence DESC, kind, logical_key) AS place FROM unit",
    embed_pending="SELECT v.vec_id FROM embeddings v LEFT JOIN labels l ON l.doc_id = v.vec_id WHERE l.toxic IS DISTINCT FROM 1",
    find_provenance="SELECT s.logical_key, p.span_id, d.role FROM span p JOIN derived d ON d.span_id = p.span_id JOIN snapshot s ON s.artifact_id = d.artifact_id WHERE p.file = 'Brand#13' AND p.start_line <= 25 AND p.end_line >= 25 AND s.sha >= '1997-01'",
    cursor_advance="SELECT sha, lag(sha) OVER (ORDER BY sha) AS cursor_before FROM commit_ref",
    snapshot_equality="SELECT count(*) AS differing FROM ((SELECT raw FROM file WHERE sha = 'src1' EXCEPT ALL SELECT raw FROM file WHERE sha = 'src2') UNION ALL (SELECT raw FROM file WHERE sha = 'src2' EXCEPT ALL SELECT raw FROM file WHERE sha = 'src1')) x",
    watch_decision="SELECT event_id, CASE WHEN event_type = before THEN 'idle' WHEN value < 10 THEN 'already_indexed' WHEN before IS NULL THEN 'fresh' WHEN value < 80 THEN 'catch_up' ELSE 'jump' END AS decision FROM (SELECT event_id, event_type, value, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) x",
    reusable_spans="SELECT c.span_id, f.path FROM chunk c JOIN file f ON f.doc_id = c.doc_id",
)
#: The checking engine has LEFT ANTI JOIN under the name ANTI JOIN.
BOTH = {"LEFT ANTI JOIN": "ANTI JOIN"}


@q("scan_prefix")
def _(d):
    return f"SELECT path FROM file WHERE {d.starts('path', chr(39) + 'fr/src1' + chr(39))}"


@q("affix_predicates")
def _(d):
    return f"SELECT p_partkey, CASE WHEN {d.starts('p_brand', chr(39) + 'Brand#1' + chr(39))} THEN 1 ELSE 0 END AS starts, CASE WHEN {d.ends('p_brand', chr(39) + '3' + chr(39))} THEN 1 ELSE 0 END AS ends FROM part"


@q("changed_spans")
def _(d):
    return "SELECT DISTINCT span_id FROM (SELECT c.span_id FROM chunk c JOIN file f ON f.doc_id = c.doc_id WHERE f.sha = 'src1' EXCEPT SELECT c.span_id FROM chunk c JOIN file f ON f.doc_id = c.doc_id WHERE f.sha = 'src2') x"


@q("changed_span_rows")
def _(d):
    return "SELECT f.path, c.span_id, c.start_line FROM chunk c JOIN file f ON f.doc_id = c.doc_id WHERE f.sha = 'src5' AND f.lang IN ('en', 'de')"


@q("artifact_identity")
def _(d):
    ids = f"concat({d.set_join('lpad(CAST(span_id AS STRING), 8, ' + chr(39) + '0' + chr(39) + ')')}, chr(31))"
    return f"SELECT a.artifact_id, {d.sha('concat(' + chr(39) + '2' + chr(39) + ', chr(31), CAST(n AS STRING), chr(31), replace(ids, ' + chr(39) + ',' + chr(39) + ', chr(31)), a.logical_key, chr(31), a.kind, chr(31))')} AS identity FROM artifact a JOIN (SELECT artifact_id, count(DISTINCT span_id) AS n, {ids} AS ids FROM derived GROUP BY artifact_id) g ON g.artifact_id = a.artifact_id"


@q("canonical_json")
def _(d):
    return "SELECT p_partkey, concat('{\"brand\":\"', p_brand, '\",\"size\":', CAST(p_size AS STRING), ',\"type\":\"', p_type, '\"}') AS canonical FROM part"


@q("digest12")
def _(d):
    return f"SELECT doc_id, substr({d.sha('text')}, 1, 12) AS digest FROM documents"


@q("json_field")
def _(d):
    return f"SELECT event_id, {d.json('props', 'k')} AS k FROM events"


@q("resolve_target")
def _(d):
    tiers = [("logical_key = 'cust:1'", 1), (d.starts("logical_key", "'cust:1'"), 2), ("kind = 'cust:1'", 3)]
    parts = " UNION ALL ".join(f"SELECT DISTINCT logical_key, {t} AS tier FROM artifact WHERE {c}" for c, t in tiers)
    return f"SELECT logical_key, tier FROM (SELECT logical_key, tier, min(tier) OVER () AS best FROM ({parts}) u) x WHERE tier = best"


@q("call_edges")
def _(d):
    return f"SELECT l_partkey, l_suppkey, {d.set_join('CAST(l_linenumber AS STRING)')} AS lines FROM lineitem GROUP BY l_partkey, l_suppkey"


@q("adjacency")
def _(d):
    return f"SELECT caller, {d.set_join('CAST(callee AS STRING)')} AS callees FROM edge GROUP BY caller"


@q("entrypoints")
def _(d):
    pair = "concat(p_type, '|', p_brand)"
    return f"SELECT p_size, {d.set_join(pair)} AS refs, min({pair}) AS primary_ref FROM part GROUP BY p_size"


@q("event_registrations")
def _(d):
    return f"SELECT user_id, {d.list_join('concat(lpad(CAST(event_id AS STRING), 12, ' + chr(39) + '0' + chr(39) + '), ' + chr(39) + ':' + chr(39) + ', event_type)')} AS registrations FROM events GROUP BY user_id"


@q("longest_prefix")
def _(d):
    return f"SELECT page_id, prefix FROM (SELECT page_id, prefix, row_number() OVER (PARTITION BY page_id ORDER BY length(prefix) DESC, prefix) AS rn FROM pages JOIN (SELECT 'http' AS prefix UNION ALL SELECT 'https://' UNION ALL SELECT 'http://www.' UNION ALL SELECT 'https://www.' UNION ALL SELECT 'https://blog.') m ON {d.starts('url', 'prefix')}) x WHERE rn = 1"


@q("relative_module")
def _(d):
    seg = d.all_matches("fq", "[^.]+")
    return f"SELECT span_id, CASE WHEN start_line % 4 >= {d.size(seg)} THEN NULL ELSE {d.join_items(d.part(seg, '1', f'CAST({d.size(seg)} - start_line % 4 AS INT)'), chr(39) + '.' + chr(39))} END AS base FROM span"


@q("tokens")
def _(d):
    return f"SELECT token, count(*) AS n FROM (SELECT {d.explode(d.all_matches('text', '[A-Za-z_][A-Za-z0-9_]*'))} AS token FROM documents) x GROUP BY token"


@q("innermost_identifier")
def _(d):
    return f"SELECT p_partkey, {d.last(d.all_matches('concat(p_type, p_brand, p_name)', '[A-Za-z_][A-Za-z0-9_]*'))} AS inner_name FROM part"


@q("validate_claims")
def _(d):
    toks = lambda side: f"SELECT DISTINCT conv_id, {'turn' if side == 'assistant' else 'turn + 1'} AS turn, {d.explode(d.all_matches('text', '[A-Za-z_][A-Za-z0-9_]*'))} AS token FROM conversations WHERE role = '{side}'"
    return f"SELECT a.conv_id, a.turn, CAST(sum(CASE WHEN b.token IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN b.token IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS dropped FROM ({toks('assistant')}) a LEFT JOIN ({toks('user')}) b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.token = b.token GROUP BY a.conv_id, a.turn"


@q("estimate_tokens")
def _(d):
    return "SELECT artifact_id, CAST(floor(length(concat('{\"kind\":\"', kind, '\",\"key\":\"', logical_key, '\"}')) / 4) AS BIGINT) AS tokens FROM artifact"


@q("extract_json")
def _(d):
    return "SELECT event_id, regexp_extract(concat('text ', props, ' more'), '[{].*[}]', 0) AS body FROM events"


@q("path_params")
def _(d):
    return f"SELECT page_id, {d.join_items(d.all_matches('url', '/([a-z]+)', 1), chr(39) + ',' + chr(39))} AS params FROM pages"


@q("knowledge_units")
def _(d):
    return f"SELECT u.sha, u.logical_key, u.kind, u.confidence, d.provenance FROM unit u JOIN (SELECT artifact_id, {d.list_join('concat(lpad(CAST(span_id AS STRING), 12, ' + chr(39) + '0' + chr(39) + '), ' + chr(39) + ':' + chr(39) + ', role)')} AS provenance FROM derived GROUP BY artifact_id) d ON d.artifact_id = u.artifact_id"


def _served(picked: str) -> str:
    # A unit costs more than one token, so that no more than the budget's number of them can be served: windows see so many rows.
    cost = "CAST(floor(length(concat(sha, logical_key, kind, summary)) / 4) AS BIGINT)"
    return f"SELECT sha, logical_key, kind, confidence FROM (SELECT *, sum({cost}) OVER (ORDER BY confidence DESC, kind, logical_key ROWS UNBOUNDED PRECEDING) AS spent, row_number() OVER (ORDER BY confidence DESC, kind, logical_key) AS rn FROM (SELECT * FROM ({picked}) p ORDER BY confidence DESC, kind, logical_key LIMIT 401) t) x WHERE rn = 1 OR spent <= 400"


@q("get_knowledge")
def _(d):
    return _served("SELECT * FROM unit WHERE logical_key LIKE 'cust:%' AND sha = (SELECT max(sha) FROM commit_ref)")


@q("first_parent_chain")
def _(d):
    return "SELECT sha, parent, step FROM (SELECT sha, lag(sha) OVER (ORDER BY sha) AS parent, row_number() OVER (ORDER BY sha DESC) - 1 AS step FROM commit_ref) x WHERE step < 50"


@q("x_tumbling")
def _(d):
    return "SELECT substr(CAST(ts AS STRING), 1, 13) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY substr(CAST(ts AS STRING), 1, 13), event_type"


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A text over the given tables and the stand-in model."""
    sql = with_parts(text, Spark())
    used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", sql)]
    sql = sql.replace("{", "{{").replace("}", "}}")
    sql = re.sub(r"\b(FROM|JOIN) (" + "|".join(used) + r")\b", r"\1 {\2}", sql)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def run_text(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run_sql(spark, sf_dir, TEXTS[name](Spark()))


def duck_text(name: str) -> str:
    sql = with_parts(TEXTS[name](Duck()), Duck())
    for a, b in BOTH.items():
        sql = sql.replace(a, b)
    return sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from spanloom.plans import composed

    return {**{name: run_text(name) for name in TEXTS}, **composed.QUERIES}


def oracle_sql() -> dict[str, str]:
    from spanloom.plans import composed

    return {**{name: duck_text(name) for name in TEXTS}, **composed.ORACLES}
