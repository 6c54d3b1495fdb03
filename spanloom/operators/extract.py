"""Extractors: artifacts with their evidence, made of fact tables by joins.

An artifact is (kind, logical_key, extractor_id, extractor_version, versions, payload, evidence): ``payload`` is JSON, ``evidence`` an
array of (span_id, role) whose first role of a span counts. No artifact is without evidence. Nothing here looks at sources
again: each extractor is a plan over the facts, so that files parsed now and facts taken over from a parent snapshot give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.identity import span_id
from spanloom.operators import edges, sinks

ARTIFACT = ["kind", "logical_key", "extractor_id", "extractor_version", "versions", "payload", "evidence"]
CLASS = "decorators array<string>, bases array<string>, tablename string, fields array<struct<name:string,annotation:string,has_default:boolean,callee:string>>, relationships array<struct<name:string,target:string>>"
ROUTE = "method string, raw_path string, decorator_object string, response_model string, response_model_base string, status_code int, include_in_schema boolean, return_type string, params array<struct<name:string,annotation:string,has_default:boolean>>"
REGISTRATION = "family string, form string, event string, fields array<string>, mode string, target string, decorator_object string, registration_module string, registration_line int, limitations array<string>"
NO_ROWS = "array<struct<span_id:string,role:string>>"
#: Annotations of scalar parameters, and what marks an optional one.
SCALARS = ("str", "int", "float", "bool", "bytes", "datetime", "date", "UUID", "Decimal")
OPTIONAL = ("Optional[", "| None", "None |")


def spans(facts: DataFrame) -> DataFrame:
    """(span_id, module, kind, fq, name, start_line, ...) of all span facts; the last definition of a name counts for look-ups."""
    rows = facts.where("fact = 'span'").withColumn("span_id", span_id(F.lit("python"), F.col("kind"), F.col("fq"), F.col("fingerprint")))
    last = F.row_number().over(Window.partitionBy("module", "kind", "fq").orderBy(F.desc("start_line"), F.desc("span_id")))
    return rows.withColumn("latest", last == 1)


def _evidence(*parts: Column) -> Column:
    """Evidence of several arrays in order, each span with its first role."""
    every = F.concat(*[F.coalesce(p, F.array().cast(NO_ROWS)) for p in parts])
    return F.filter(every, lambda x, i: ~F.exists(F.slice(every, F.lit(1), i), lambda y: y["span_id"] == x["span_id"]))


def _edge(span: str, role: str) -> Column:
    return F.when(F.col(span).isNotNull(), F.array(F.struct(F.col(span).alias("span_id"), F.lit(role).alias("role"))))


def _roles(span_ids: str, role: str) -> Column:
    return F.transform(span_ids, lambda s: F.struct(s.alias("span_id"), F.lit(role).alias("role")))


def _none_if_empty(condition: Column, text: str) -> Column:
    return F.when(condition, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))


def _artifacts(df: DataFrame, kind: str, extractor: str, version: str, key: Column, payload: list[Column], evidence: Column, versions: Column | None = None) -> DataFrame:
    none = F.create_map().cast("map<string,string>")
    made = df.select(F.lit(kind).alias("kind"), key.alias("logical_key"), F.lit(extractor).alias("extractor_id"), F.lit(version).alias("extractor_version"), (none if versions is None else versions).alias("versions"), F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}).alias("payload"), evidence.alias("evidence"))
    return made.where("size(evidence) > 0")


def _versions(names: list[str], known: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for n in names for x in (n, known.get(n, "unknown"))])


def imports(facts: DataFrame, versions: dict[str, str] | None = None) -> DataFrame:
    """import:{importer}->{imported}, on the import statements."""
    found = edges.import_edges(facts)
    at = spans(facts).where("kind = 'import'").select(F.col("module").alias("importer"), F.col("start_line").alias("line"), "span_id")
    on = found.withColumn("line", F.explode("lines")).join(at, ["importer", "line"]).groupBy("importer", "imported").agg(F.array_sort(F.collect_set("span_id")).alias("ids"))
    df = found.join(on, ["importer", "imported"])
    return _artifacts(df, "import_edge", "imports", "1", F.concat(F.lit("import:"), "importer", F.lit("->"), "imported"), [F.col("importer"), F.col("imported"), F.col("lines"), F.lit("exact").alias("span_mapping")], _roles("ids", "import_statement"))


def calls(facts: DataFrame, versions: dict[str, str] | None = None) -> DataFrame:
    """call:{caller}->{callee}, on both."""
    found = edges.call_edges(facts)
    ids = spans(facts).where("latest").select("module", "kind", "fq", "span_id")
    caller = ids.select(F.col("module").alias("caller_module"), F.col("kind").alias("caller_kind"), F.col("fq").alias("caller"), F.col("span_id").alias("caller_span"))
    callee = ids.select(F.col("module").alias("callee_module"), F.col("kind").alias("callee_kind"), F.col("fq").alias("callee"), F.col("span_id").alias("callee_span"))
    df = found.join(caller, ["caller_module", "caller_kind", "caller"]).join(callee, ["callee_module", "callee_kind", "callee"])
    payload = [F.col(c) for c in ("caller", "caller_kind", "caller_module", "callee", "callee_module", "callee_kind", "resolution", "lines")]
    return _artifacts(df, "call_edge", "calls", "1", F.concat(F.lit("call:"), "caller", F.lit("->"), "callee"), payload, _evidence(_edge("caller_span", "caller"), _edge("callee_span", "callee")))


def _classes_by_name(facts: DataFrame) -> DataFrame:
    """(short, targets, target_ids): all classes of a short name, in order of their paths."""
    rows = spans(facts).where("kind = 'class' and latest")
    return rows.groupBy(F.col("name").alias("short")).agg(F.array_sort(F.collect_set(F.struct("fq", "module", "span_id"))).alias("targets"))


def routes(facts: DataFrame, versions: dict[str, str] | None = None) -> DataFrame:
    """api:{METHOD} {path}, on the handler and on every class that the response model may be."""
    prefix = facts.where("fact = 'prefix'").groupBy(F.col("name").alias("var")).agg(F.array_sort(F.collect_list(F.struct("path", F.get_json_object("data", "$.order").cast("int").alias("o"), "start_line", "target"))).alias("p"), F.max(F.col("target").isNull()).alias("open_prefix"))
    prefix = prefix.select("var", "open_prefix", F.when(F.col("open_prefix"), "").otherwise(F.array_join("p.target", "")).alias("prefix"))
    own = spans(facts).where("latest").select("module", F.col("kind").alias("k"), "fq", "span_id")
    df = facts.where("fact = 'route'").select("path", "module", F.col("kind").alias("k"), "fq", "start_line", F.from_json("data", ROUTE).alias("r")).select("path", "module", "k", "fq", "start_line", "r.*")
    df = df.join(own, ["module", "k", "fq"]).join(prefix, F.col("decorator_object") == F.col("var"), "left").join(_classes_by_name(facts), F.col("response_model_base") == F.col("short"), "left")
    df = df.withColumn("full", F.concat(F.coalesce("prefix", F.lit("")), "raw_path")).withColumn("open_prefix", F.coalesce("open_prefix", F.lit(False)))
    named = F.transform(F.regexp_extract_all("raw_path", F.lit(r"\{([^}:]*)"), F.lit(1)), lambda x: x)
    scalar = lambda a: F.coalesce(a.isin(*SCALARS), F.lit(False))
    place = lambda p: F.when(F.array_contains(named, p["name"]), "path").when(F.coalesce(F.rlike(p["annotation"], F.lit("^[A-Z]")), F.lit(False)) & ~scalar(p["annotation"]), "body").when(p["has_default"] | scalar(p["annotation"]), "query").otherwise("unknown")
    params = F.transform("params", lambda p: F.struct(p["name"].alias("name"), p["annotation"].alias("annotation"), p["has_default"].alias("has_default"), place(p).alias("in")))
    generic = F.coalesce(F.contains("response_model", F.lit("[")), F.lit(False))
    missing = F.concat(_none_if_empty(generic, "generic_response_model"), _none_if_empty(F.col("response_model_base").isNotNull() & F.col("targets").isNull(), "response_model_not_first_party"), _none_if_empty(F.col("open_prefix"), "dynamic_prefix"))
    targets = F.coalesce("targets", F.array().cast("array<struct<fq:string,module:string,span_id:string>>"))
    payload = [F.col("method"), F.col("full").alias("path"), F.col("raw_path"), F.col("decorator_object"), F.col("fq").alias("handler"), F.col("module").alias("handler_module"), F.col("status_code"), F.col("include_in_schema"), F.col("response_model"), F.col("response_model_base"), F.col("targets").isNotNull().alias("response_model_resolved"), (F.size(targets) > 1).alias("response_model_ambiguous"), F.transform(targets, lambda t: F.struct(t["module"].alias("module"), t["fq"].alias("fq_symbol_path"))).alias("response_model_targets"), F.col("return_type"), params.alias("params"), (~F.col("open_prefix")).alias("prefix_resolved"), F.lit("exact").alias("span_mapping"), missing.alias("limitations")]
    # A handler that is its own response model's name is evidence as the model.
    df = df.withColumn("rn", F.row_number().over(Window.partitionBy("method", "full").orderBy("path", "start_line", "fq"))).where("rn = 1")
    return _artifacts(df, "api_route", "fastapi_contract", "1", F.concat(F.lit("api:"), "method", F.lit(" "), "full"), payload, _evidence(_edge("span_id", "handler"), _roles("targets.span_id", "response_model")), _versions(["fastapi", "pydantic"], versions or {}))


def _entity_rows(facts: DataFrame) -> DataFrame:
    """Classes that are entities, classified, with the fields that count."""
    own = spans(facts).where("kind = 'class' and latest").select("module", "fq", "span_id")
    df = facts.where("fact = 'class'").withColumn("rn", F.row_number().over(Window.partitionBy("module", "fq").orderBy(F.desc("start_line")))).where("rn = 1")
    df = df.select("module", "fq", "name", F.from_json("data", CLASS).alias("c")).select("module", "fq", "name", "c.*").join(own, ["module", "fq"])
    column = lambda f: F.coalesce(f["callee"].isin("Column", "mapped_column"), F.lit(False)) | F.coalesce(F.startswith(f["annotation"], F.lit("Mapped[")), F.lit(False))
    df = df.withColumns({
        "is_dataclass": F.exists("decorators", lambda d: F.rlike(d, F.lit(r"(^|\.)dataclass$"))),
        "has_columns": F.exists("fields", column),
        "is_pydantic": F.exists("bases", lambda b: b.isin("BaseModel", "BaseSettings")),
    }).withColumn("is_sqlalchemy", F.col("tablename").isNotNull() | F.col("has_columns"))
    df = df.withColumn("framework", F.when(F.col("is_dataclass"), "dataclass").when(F.col("is_sqlalchemy"), "sqlalchemy").when(F.col("is_pydantic"), "pydantic")).where("framework is not null")
    counts = lambda f: ~F.rlike(f["name"], F.lit("^__.*__$")) & F.when(F.col("framework") == "sqlalchemy", column(f)).otherwise(f["annotation"].isNotNull())
    optional = lambda a: F.coalesce(sum((F.contains(a, F.lit(m)).cast("int") for m in OPTIONAL), F.lit(0)) > 0, F.lit(False))
    kept = F.transform(F.filter("fields", counts), lambda f: F.struct(f["name"].alias("name"), f["annotation"].alias("annotation"), f["has_default"].alias("has_default"), (~f["has_default"] & ~optional(f["annotation"])).alias("required"), F.when(f["annotation"].isNotNull(), "annotated").otherwise("column").alias("source")))
    signals = F.concat(_none_if_empty(F.col("is_dataclass"), "dataclass_decorator"), _none_if_empty(F.col("tablename").isNotNull(), "sqlalchemy_tablename"), _none_if_empty(F.col("has_columns"), "sqlalchemy_column_field"), _none_if_empty(F.col("is_pydantic"), "pydantic_base"))
    many = F.col("is_dataclass").cast("int") + F.col("is_sqlalchemy").cast("int") + F.col("is_pydantic").cast("int") > 1
    return df.withColumns({"kept": kept, "signals": signals, "limitations": _none_if_empty(many, "multiple_framework_signals")})


def entities(facts: DataFrame, versions: dict[str, str] | None = None) -> DataFrame:
    """entity:{fq}, on the class and on every entity that its fields or relationships name."""
    df = _entity_rows(facts)
    word = lambda a: F.regexp_extract_all(a, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))
    of_fields = F.flatten(F.transform(F.filter("kept", lambda f: f["annotation"].isNotNull()), lambda f: F.transform(word(f["annotation"]), lambda t: F.struct(t.alias("name"), F.lit("field_type").alias("via")))))
    of_relations = F.transform(F.filter("relationships", lambda r: r["target"].isNotNull()), lambda r: F.struct(F.regexp_extract(F.regexp_replace(r["target"], "[\"']", ""), r"([^.]*)$", 1).alias("name"), F.lit("relationship").alias("via")))
    refs = df.select("module", "fq", F.posexplode(F.concat(of_fields, of_relations)).alias("place", "ref")).select("module", "fq", "place", "ref.*")
    targets = df.select(F.col("name"), F.col("fq").alias("target_fq"), F.col("module").alias("target_module"), F.col("span_id").alias("target_span"))
    met = refs.join(targets, "name").where("fq != target_fq")
    ambiguous = F.size(F.collect_set("target_fq").over(Window.partitionBy("module", "fq", "place"))) > 1
    met = met.withColumn("ambiguous", ambiguous).withColumn("rn", F.row_number().over(Window.partitionBy("module", "fq", "target_fq").orderBy("place"))).where("rn = 1")
    related = met.groupBy("module", "fq").agg(F.array_sort(F.collect_list(F.struct("place", "target_fq", "name", "via", "target_module", "ambiguous", "target_span"))).alias("related"))
    df = df.join(related, ["module", "fq"], "left").withColumn("related", F.coalesce("related", F.array().cast("array<struct<place:int,target_fq:string,name:string,via:string,target_module:string,ambiguous:boolean,target_span:string>>")))
    shown = F.transform("related", lambda r: F.struct(r["name"].alias("name"), r["via"].alias("via"), r["target_fq"].alias("target_fq"), r["target_module"].alias("target_module"), r["ambiguous"].alias("ambiguous")))
    payload = [F.col("framework"), F.col("name").alias("class_name"), F.col("fq").alias("qualified_name"), F.col("module"), F.col("bases"), F.col("kept").alias("fields"), F.col("tablename"), F.col("relationships"), shown.alias("related_entities"), F.col("signals").alias("detection_signals"), F.lit("exact").alias("span_mapping"), F.col("limitations")]
    known = versions or {}
    of = F.when(F.col("framework") == "dataclass", F.create_map().cast("map<string,string>")).when(F.col("framework") == "sqlalchemy", _versions(["sqlalchemy"], known)).otherwise(_versions(["pydantic"], known))
    return _artifacts(df, "entity", "entities", "2", F.concat(F.lit("entity:"), "fq"), payload, _evidence(_edge("span_id", "class_definition"), _roles("related.target_span", "related_entity")), of)


def _listened(facts: DataFrame) -> DataFrame:
    """Registrations by calls at module level, on the handlers that they resolve to."""
    functions = spans(facts).where("kind = 'function' and latest and get_json_object(data, '$.top') = 'true'").select(F.col("module").alias("handler_module"), F.col("name").alias("handler_name"), F.col("fq").alias("handler"))
    last = F.row_number().over(Window.partitionBy("module", "name").orderBy(F.desc("start_line")))
    symbols = facts.where("fact = 'binding' and kind = 'symbol'").withColumn("rn", last).where("rn = 1").select("module", "name", F.col("receiver").alias("from_module"), F.col("target").alias("symbol"))
    heard = facts.where("fact = 'listen'").select("module", "kind", "name", F.col("target").alias("given"), "data")
    proven = heard.where("kind = 'name'").join(symbols, ["module", "name"]).where("from_module = 'sqlalchemy.event' and symbol = 'listen'").select(*heard.columns)
    heard = heard.where("kind = 'attribute' and name = 'listen'").unionByName(proven)
    local = heard.join(functions, (F.col("module") == F.col("handler_module")) & (F.col("given") == F.col("handler_name")))
    bound = symbols.withColumnRenamed("name", "given")
    far = heard.join(functions.select(F.col("handler_module").alias("module"), F.col("handler_name").alias("given")), ["module", "given"], "left_anti").join(bound, ["module", "given"]).join(functions, (F.col("from_module") == F.col("handler_module")) & (F.col("symbol") == F.col("handler_name")))
    columns = [F.col("handler_module").alias("module"), F.lit("function").alias("kind"), F.col("handler").alias("fq"), F.col("module").alias("site"), "data"]
    return local.select(*columns).unionByName(far.select(*columns))


def events(facts: DataFrame, versions: dict[str, str] | None = None) -> DataFrame:
    """event:{handler}, on the handler, its class, the classes it listens to and the modules that register it."""
    own = spans(facts).where("latest")
    sites = own.where("kind = 'module'").select(F.col("module").alias("site"), F.col("span_id").alias("site_span"))
    decorated = facts.where("fact = 'registration'").withColumn("place", F.monotonically_increasing_id()).select("module", "kind", "fq", F.lit(None).cast("string").alias("site"), "data", "place")
    rows = decorated.unionByName(_listened(facts).withColumn("place", F.lit(None).cast("long"))).withColumn("r", F.from_json("data", REGISTRATION)).join(sites, "site", "left")
    classes = _classes_by_name(facts)
    sqlalchemy = F.startswith("r.family", F.lit("sqlalchemy"))
    rows = rows.withColumn("short", F.when(sqlalchemy, F.regexp_extract("r.target", r"([^.]*)$", 1))).join(classes, "short", "left")
    targets = F.coalesce("targets", F.array().cast("array<struct<fq:string,module:string,span_id:string>>"))
    shown = F.struct(
        *[F.col(f"r.{c}").alias(c) for c in ("family", "form", "event", "fields", "mode", "target")], F.col("targets").isNotNull().alias("target_resolved"), (F.size(targets) > 1).alias("target_ambiguous"),
        F.transform(targets, lambda t: F.struct(t["module"].alias("module"), t["fq"].alias("fq_symbol_path"))).alias("target_targets"), *[F.col(f"r.{c}").alias(c) for c in ("decorator_object", "registration_module", "registration_line")],
    )
    missing = F.concat("r.limitations", _none_if_empty(sqlalchemy & F.col("r.target").isNotNull() & F.col("targets").isNull(), "target_not_first_party"))
    item = F.struct((F.col("r.form") == "call").alias("o1"), F.coalesce("place", F.lit(0)).alias("o2"), F.coalesce("r.registration_module", F.lit("")).alias("o3"), F.coalesce("r.registration_line", F.lit(0)).alias("o4"), F.coalesce("r.event", F.lit("")).alias("o5"), F.to_json(shown, {"ignoreNullFields": "false"}).alias("json"), missing.alias("missing"), targets.alias("targets"), "site_span", F.col("r.family").alias("family"), F.col("r.form").alias("form"), F.col("r.event").alias("event"))
    df = rows.groupBy("module", "kind", "fq").agg(F.array_sort(F.collect_list(item)).alias("x"))
    ids = own.select("module", "kind", "fq", "span_id")
    owners = own.where("kind = 'class'").select(F.col("fq").alias("owner"), F.col("span_id").alias("owner_span"), F.col("module").alias("owner_module"))
    df = df.join(ids, ["module", "kind", "fq"]).withColumn("owner", F.when(F.exists("x.family", lambda f: F.startswith(f, F.lit("pydantic_"))), F.regexp_replace("fq", r"\.[^.]*$", "")))
    df = df.join(owners.withColumnRenamed("owner_module", "module"), ["module", "owner"], "left")
    families = F.array_sort(F.array_distinct("x.family"))
    signals = F.array_sort(F.array_distinct(F.transform("x", lambda r: F.concat(r["family"], F.lit("_"), r["form"]))))
    payload = [F.col("fq").alias("handler"), F.col("module").alias("handler_module"), F.when(F.col("owner_span").isNotNull(), F.col("owner")).alias("owner_class"), families.alias("families"), F.transform("x.json", lambda j: F.parse_json(j)).alias("registrations"), signals.alias("detection_signals"), F.lit("exact").alias("span_mapping"), F.flatten("x.missing").alias("limitations")]
    # Of each registration, its target classes and then its site.
    found = F.flatten(F.transform("x", lambda r: F.concat(F.transform(r["targets"], lambda t: F.struct(t["span_id"].alias("span_id"), F.lit("target_class").alias("role"))), F.when(r["site_span"].isNotNull(), F.array(F.struct(r["site_span"].alias("span_id"), F.lit("registration_site").alias("role")))).otherwise(F.array().cast(NO_ROWS)))))
    known = versions or {}
    names = F.array_distinct(F.transform(families, lambda f: F.regexp_extract(f, "^([a-z]+)_", 1)))
    of = F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.coalesce(F.get(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in ({"": ""} | known).items()]), lambda e: e["k"] == n), 0)["v"], F.lit("unknown")))))
    return _artifacts(df, "event_handler", "events", "3", F.concat(F.lit("event:"), "fq"), payload, _evidence(_edge("span_id", "handler"), _edge("owner_span", "owner_class"), found), of)


def surface(facts: DataFrame, versions: dict[str, str] | None = None) -> DataFrame:
    """surface:{package}.{name}: what a package exports, on its definition and on the import that brings it in."""
    own = spans(facts)
    packages = facts.where("fact = 'span' and kind = 'module'").where(F.col("path").rlike(r"(^|/)__init__\.py$")).select(F.col("module").alias("package")).distinct()
    tops = own.where("latest and kind in ('class', 'function') and get_json_object(data, '$.top') = 'true'")
    tops = tops.withColumn("rn", F.row_number().over(Window.partitionBy("module", "name").orderBy(F.desc("start_line")))).where("rn = 1").select(F.col("module").alias("def_module"), F.col("name").alias("def_name"), F.col("fq").alias("def_fq"), F.col("kind").alias("def_kind"), F.col("span_id").alias("def_span"), F.get_json_object("data", "$.signature").alias("signature"))
    listed = facts.where("fact = 'exports'").select(F.col("module").alias("package"), F.from_json("data", "names array<string>, dynamic boolean").alias("a")).select("package", "a.*")
    state = packages.join(listed, "package", "left").withColumn("has_all", F.col("names").isNotNull()).withColumn("dynamic", F.coalesce("dynamic", F.lit(False)))
    by_all = state.where("has_all").select("package", "has_all", "dynamic", F.explode(F.array_distinct("names")).alias("name"))
    by_name = state.where("not has_all").join(tops, F.col("package") == F.col("def_module")).where("def_name not like '\\_%'").select("package", "has_all", "dynamic", F.col("def_name").alias("name"))
    wanted = by_all.unionByName(by_name)
    last = F.row_number().over(Window.partitionBy("module", "name").orderBy(F.desc("start_line"), F.desc("fq")))
    again = facts.where("fact = 'reexport'").withColumn("rn", last).where("rn = 1").select(F.col("module").alias("package"), "name", F.col("receiver").alias("from_module"), F.col("target").alias("symbol"), F.col("fq").alias("import_fq"))
    lines = own.where("kind = 'import'").select(F.col("module").alias("package"), F.col("fq").alias("import_fq"), F.col("span_id").alias("import_span"))
    here = tops.select(F.col("def_module").alias("package"), F.col("def_name").alias("name"), *[F.col(c).alias(f"here_{c}") for c in ("def_fq", "def_kind", "def_span", "signature")])
    there = tops.select(F.col("def_module").alias("from_module"), F.col("def_name").alias("symbol"), *[F.col(c).alias(f"there_{c}") for c in ("def_fq", "def_kind", "def_span", "signature")])
    modules = facts.where("fact = 'span' and kind = 'module'").select("module").distinct()
    df = wanted.join(here, ["package", "name"], "left").join(again, ["package", "name"], "left").join(lines, ["package", "import_fq"], "left").join(there, ["from_module", "symbol"], "left")
    df = df.join(modules.select(F.col("module").alias("as_module"), F.lit(True).alias("is_module")), F.concat_ws(".", "from_module", "symbol") == F.col("as_module"), "left").join(modules.select(F.col("module").alias("from_m"), F.lit(True).alias("from_known")), F.col("from_module") == F.col("from_m"), "left")
    at_home, brought = F.col("here_def_span").isNotNull(), F.col("import_fq").isNotNull()
    resolved = ~at_home & F.col("there_def_span").isNotNull()
    # Submodules, and names of own modules that are neither class nor function, are no symbols of the surface.
    df = df.where(at_home | (brought & (resolved | F.col("from_module").isNull() | (F.col("is_module").isNull() & F.col("from_known").isNull()))))
    loose = ~at_home & ~resolved
    pick = lambda c: F.when(at_home, F.col(f"here_{c}")).otherwise(F.col(f"there_{c}"))
    missing = F.concat(_none_if_empty(F.col("dynamic"), "dynamic_all"), _none_if_empty(loose & F.col("from_module").isNull(), "relative_import_unresolved"), _none_if_empty(loose & F.col("from_module").isNotNull(), "definition_not_first_party"))
    payload = [F.concat_ws(".", "package", "name").alias("public_qualified_name"), F.col("name"), pick("def_kind").alias("symbol_kind"), F.col("package").alias("exporting_module"), F.when(at_home, F.col("package")).otherwise(F.col("from_module")).alias("defining_module"), pick("def_fq").alias("defining_fq_symbol_path"), F.when(F.col("has_all"), "all").otherwise("naming").alias("exported_via"), (~at_home).alias("is_reexport"), pick("signature").alias("signature"), F.when(loose, "approximate").otherwise("exact").alias("span_mapping"), missing.alias("limitations")]
    evidence = F.when(at_home, _edge("here_def_span", "definition")).otherwise(_evidence(_edge("import_span", "re_export"), _edge("there_def_span", "definition")))
    return _artifacts(df, "public_symbol", "library_surface", "1", F.concat(F.lit("surface:"), "package", F.lit("."), "name"), payload, evidence)


def paths(facts: DataFrame, prior: DataFrame, rules: list[tuple[str, list[str]]] | None = None, max_depth: int = 8, max_paths: int = 32) -> DataFrame:
    """process:{entry}->{sink}@{terminal}: the shortest call paths from routes and handlers to sinks, on all their steps."""
    return sinks.process_paths(facts, prior, rules, max_depth, max_paths, _artifacts, spans)


#: Extractors that need facts only, in their order; the paths read what these made.
EXTRACTORS: dict[str, Callable[..., DataFrame]] = {"imports": imports, "fastapi_contract": routes, "entities": entities, "events": events, "library_surface": surface, "calls": calls}


def extract_all(facts: DataFrame, versions: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df.persist()) -> DataFrame:
    """The artifacts of all extractors. ``keep`` stores those that the paths read, which would else be made once for each use."""
    out = None
    for name in EXTRACTORS:
        made = EXTRACTORS[name](facts, versions)
        out = made if out is None else out.unionByName(made)
    out = keep(out)
    return out.unionByName(paths(facts, out, rules))
