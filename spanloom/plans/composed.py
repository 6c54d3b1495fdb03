"""Queries that run the library's operators on the given tables, and the answers of another engine, written apart from them.

Sources are made of table rows, so that what parsing has to find is known from the tables: each part is a module with a class,
functions, routes and imports of the parts that follow it in an order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import identity
from spanloom.operators import edges, extract, pairs, parse, sinks, store, vectors
from spanloom.plans import catalog
from spanloom.plans.dialect import Duck
from spanloom.plans.model import with_parts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def call_graph(spark: SparkSession, sf: str) -> DataFrame:
    """(caller, callee) part keys: parts that follow each other in an order."""
    lines = _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("callee"))
    return lines.withColumnRenamed("l_partkey", "caller").join(after, ["l_orderkey", "l_linenumber"]).where("caller != callee").select("caller", "callee").distinct()


#: The same edges in SQL.
EDGES = "edge AS (SELECT DISTINCT a.l_partkey AS caller, b.l_partkey AS callee FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey)"


def sources(spark: SparkSession, sf: str) -> DataFrame:
    """(path, module, source): a module a part. Even parts import the names they call, odd ones the modules."""
    parts = _table(spark, sf, "part").select("p_partkey", "p_size", "p_type")
    called = call_graph(spark, sf).groupBy(F.col("caller").alias("p_partkey")).agg(F.array_sort(F.collect_list("callee")).alias("callees"))
    rows = parts.join(called, "p_partkey", "left").withColumn("callees", F.coalesce("callees", F.array().cast("array<bigint>")))
    # Parsing is the costly step: several tasks a core, dealt before the texts are made.
    rows = rows.repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    even, n = F.col("p_partkey") % 2 == 0, F.col("p_partkey").cast("string")
    text = lambda form: F.array_join(F.transform("callees", lambda c: F.format_string(form, c, c)), "")
    imports = F.when(even, text("from shop.p%d import f%d\n")).otherwise(text("import shop.p%d as m%d\n"))
    body = F.when(even, F.array_join(F.transform("callees", lambda c: F.format_string("    f%d(x)\n", c)), "")).otherwise(F.array_join(F.transform("callees", lambda c: F.format_string("    m%d.f%d(x)\n", c, c)), ""))
    sink = F.when(F.col("p_type") == "PROMO", "    session.commit()\n").otherwise("")
    route = F.when(F.col("p_size") == 1, F.concat(F.lit("@app.get('/p/"), n, F.lit("/{x}')\n"))).otherwise("")
    source = F.concat(imports, F.lit("\n\n"), route, F.lit("def f"), n, F.lit("(x):\n"), body, sink, F.lit("    return x\n\n\nclass Row"), n, F.lit("(BaseModel):\n    size: int = "), F.col("p_size").cast("string"), F.lit("\n"))
    return rows.select(F.concat(F.lit("shop/p"), n, F.lit(".py")).alias("path"), F.concat(F.lit("shop.p"), n).alias("module"), source.alias("source"))


def _facts(spark: SparkSession, sf: str, *only: str, prints: bool = False) -> DataFrame:
    return parse.facts(sources(spark, sf), only, prints)


def _over(facts: DataFrame, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What is made of facts by several readings of them: files are parsed once, facts kept until the result is there."""
    kept = store.set_aside(facts, "facts")
    out = store.set_aside(made(kept), "made")
    store.drop(kept)
    return out


@query(f"WITH {EDGES} SELECT concat('shop.p', caller, '.f', caller) AS caller, concat('shop.p', callee, '.f', callee) AS callee, 'imported' AS resolution FROM edge")
def p_call_edges(spark, sf):
    """J2, J3, K6: parsing, bindings and resolution of calls."""
    facts = _facts(spark, sf, "span:module", "span:class", "span:function", "span:method", "binding", "call")
    return _over(facts, lambda f: edges.call_edges(f).select("caller", "callee", "resolution"))


@query(f"WITH {EDGES} SELECT concat('shop.p', caller) AS importer, concat('shop.p', callee) AS imported FROM edge")
def p_import_edges(spark, sf):
    """K1."""
    return _over(_facts(spark, sf, "span:module", "binding"), lambda f: edges.import_edges(f).select("importer", "imported"))


@query(f"WITH {EDGES}, n AS (SELECT caller, count(*) AS c FROM edge GROUP BY caller) SELECT p_partkey, 3 + coalesce(c, 0) AS n_spans, coalesce(c, 0) AS n_imports, CASE WHEN p_size = 1 THEN 1 ELSE 0 END AS n_routes FROM part LEFT JOIN n ON caller = p_partkey")
def p_file_facts(spark, sf):
    """J1, J4: spans, imports and routes of each file."""
    count = lambda c: F.sum(F.expr(c).cast("long"))
    rows = _facts(spark, sf, "span", "route").groupBy("module").agg(count("fact = 'span'").alias("n_spans"), count("fact = 'span' and kind = 'import'").alias("n_imports"), count("fact = 'route'").cast("int").alias("n_routes"))
    return rows.select(F.regexp_extract("module", "([0-9]+)$", 1).cast("long").alias("p_partkey"), "n_spans", "n_imports", "n_routes")


@query("SELECT concat('api:GET /p/', p_partkey, '/{x}') AS logical_key, concat('shop.p', p_partkey, '.f', p_partkey) AS handler, 1 AS n_evidence FROM part WHERE p_size = 1")
def p_routes(spark, sf):
    """K2: routes as artifacts with their handler as evidence."""
    facts = _facts(spark, sf, "span:class", "span:function", "span:method", "prefix", "route", prints=True)
    return _over(facts, lambda f: extract.routes(f).select("logical_key", F.get_json_object("payload", "$.handler").alias("handler"), F.size("evidence").alias("n_evidence")))


@query("SELECT concat('entity:shop.p', p_partkey, '.Row', p_partkey) AS logical_key, 'pydantic' AS framework, 'size' AS field, 'false' AS required FROM part")
def p_entities(spark, sf):
    """K3."""
    get = lambda p: F.get_json_object("payload", p)
    facts = _facts(spark, sf, "span:class", "class", prints=True)
    return _over(facts, lambda f: extract.entities(f).select("logical_key", get("$.framework").alias("framework"), get("$.fields[0].name").alias("field"), get("$.fields[0].required").alias("required")))


@query()
def p_sink_paths(spark, sf):
    """L1 at its depth of 8, from every part that begins its file to the parts of the sink kind. Tested against brute force."""
    part = _table(spark, sf, "part").select("p_partkey", "p_size", "p_type")
    found = sinks.sink_paths(call_graph(spark, sf), part.where("p_size = 1").select(F.col("p_partkey").alias("entry")), part.where("p_type = 'PROMO'").select(F.col("p_partkey").alias("node"), F.lit("commit").alias("sink")))
    return found.select("entry", "terminal", "depth", F.array_join(F.transform("steps", lambda s: s.cast("string")), ">").alias("steps"), F.array_join("limitations", ",").alias("limitations"))


@query("SELECT a.p_partkey AS outer_id, b.p_partkey AS inner_id FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size <= b.p_size AND a.p_size + a.p_partkey % 10 >= b.p_size + b.p_partkey % 10 AND a.p_partkey <> b.p_partkey")
def p_interval_join(spark, sf):
    """D7 over all files: spans within spans, met by file and range of lines."""
    spans = _table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("file"), F.col("p_size").cast("long").alias("a"), (F.col("p_size") + F.col("p_partkey") % 10).alias("b"))
    return pairs.within(spans, 9)


@query()
def q_related_entities(spark, sf):
    """D13 in another plan than its text in the catalogue: no pairs are held against each other to drop those found twice."""
    rows = catalog.run_sql(spark, sf, "SELECT span_id AS id, regexp_extract(fq, '([^ .]*)$', 1) AS token FROM span")
    return pairs.sharing(rows).select(F.col("a").alias("span_id"), F.col("b").alias("target"))


def _asked(spark: SparkSession, sf: str, k: int, within: bool) -> DataFrame:
    rows = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", (F.col("label") if within else F.lit(0)).alias("group"))
    return vectors.nearest(rows.where("id % 20 = 0"), rows, k)


def _asked_sql(k: int, extra: str = "") -> str:
    return f"SELECT q.vec_id AS query_id, e.vec_id, list_cosine_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS dist FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id{extra} QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(dist, 9), e.vec_id) <= {k}"


@query(f"SELECT query_id, vec_id, round(dist, 6) AS dist FROM ({_asked_sql(10)}) x")
def p_vector_topk(spark, sf):
    """G4, M2: the ten nearest of every vector whose id is divisible by 20."""
    return _asked(spark, sf, 10, False).select("query_id", "vec_id", F.round("dist", 6).alias("dist"))


@query(f"SELECT query_id, vec_id, round(dist, 6) AS dist FROM ({_asked_sql(5, ' AND e.label = q.label')}) x")
def p_rag_retrieve(spark, sf):
    """M4: the five nearest within the query's own label, for the same queries."""
    return _asked(spark, sf, 5, True).select("query_id", "vec_id", F.round("dist", 6).alias("dist"))


UNITS = "SELECT u.* FROM unit u JOIN newest n ON n.logical_key = u.logical_key AND n.top LIKE concat('%|', u.sha)"


@query(with_parts(f"SELECT query_id, logical_key, sha FROM (SELECT h.query_id, u.*, row_number() OVER (PARTITION BY h.query_id ORDER BY confidence DESC, kind, u.logical_key) AS rn, sum(CAST(floor(length(concat(sha, u.logical_key, kind, summary)) / 4) AS BIGINT)) OVER (PARTITION BY h.query_id ORDER BY confidence DESC, kind, u.logical_key) AS spent FROM ({_asked_sql(8)}) h JOIN ({UNITS}) u ON u.logical_key = concat('cust:', CAST(h.vec_id AS VARCHAR))) x WHERE rn = 1 OR spent <= 60", Duck()))
def p_search_knowledge(spark, sf):
    """N3: the units of the eight nearest of each query vector, within a budget of tokens."""
    hits = _asked(spark, sf, 8, False).select("query_id", F.concat(F.lit("cust:"), F.col("vec_id").cast("string")).alias("logical_key"))
    rows = catalog.run_sql(spark, sf, UNITS).join(hits, "logical_key")
    by = Window.partitionBy("query_id").orderBy(F.desc("confidence"), "kind", "logical_key")
    cost = F.floor(F.length(F.concat("sha", "logical_key", "kind", "summary")) / 4)
    rows = rows.withColumn("rn", F.row_number().over(by)).withColumn("spent", F.sum(cost).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("rn = 1 or spent <= 60").select("query_id", "logical_key", "sha")


@query("SELECT o_orderkey AS artifact_id, sha256(concat('2', chr(31), CAST(count(DISTINCT l_partkey) AS VARCHAR), chr(31), string_agg(DISTINCT concat(sha256(CAST(l_partkey AS VARCHAR)), chr(31)), '' ORDER BY concat(sha256(CAST(l_partkey AS VARCHAR)), chr(31))), 'cust:', CAST(any_value(o_custkey) AS VARCHAR), chr(31), any_value(o_orderpriority), chr(31), '1', chr(31), chr(31), chr(31), '{\"status\":\"', any_value(o_orderstatus), '\"}', chr(31))) AS identity FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def p_artifact_ids(spark, sf):
    """I1 to I3: artifact ids by the library's functions."""
    ground = _table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.sha2(F.col("l_partkey").cast("string"), 256)).alias("ids"))
    rows = _table(spark, sf, "orders").join(ground, "o_orderkey")
    made = identity.artifact_id(F.col("ids"), F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")), F.col("o_orderpriority"), F.lit("1"), F.lit(""), F.lit(""), F.create_map(F.lit("status"), "o_orderstatus"))
    return rows.select(F.col("o_orderkey").alias("artifact_id"), made.alias("identity"))


@query("WITH c AS (SELECT *, concat('shop.', replace(lower(p_type), ' ', '_'), '.', p_brand, '.', p_name) AS dotted FROM part) SELECT p_partkey, 'economy' AS sink FROM c WHERE dotted LIKE 'shop.economy.%' UNION ALL SELECT p_partkey, 'brand12' FROM c WHERE dotted LIKE 'shop.standard.Brand#12.%' UNION ALL SELECT p_partkey, 'last' FROM c WHERE regexp_extract(dotted, '([^.]*)$', 1) = (SELECT min(regexp_extract(dotted, '([^.]*)$', 1)) FROM c)")
def p_sink_match(spark, sf):
    """D16, I16: calls against rules by equi-joins on their names and prefixes."""
    calls = _table(spark, sf, "part").select("p_partkey", F.concat(F.lit("shop."), F.replace(F.lower("p_type"), F.lit(" "), F.lit("_")), F.lit("."), "p_brand", F.lit("."), "p_name").alias("target"))
    calls = calls.withColumn("name", F.regexp_extract("target", r"([^.]*)$", 1))
    last = calls.agg(F.min("name")).first()[0]
    rules = sinks.rules_table(spark, [("economy", ["shop.economy.*"]), ("brand12", ["shop.standard.Brand#12.*"]), ("last", [f"*.{last}"])])
    return sinks.match_calls(calls, rules).select("p_partkey", "sink").distinct()
