"""Column builders for content-addressed identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the identity rules: the field separator and the rules' versions.
SEPARATOR = "\x1f"
NORMALIZATION_VERSION, ARTIFACT_ID_VERSION = 1, 2


def _fields(*columns: Column) -> Column:
    """Each field followed by the separator, the last one too."""
    return F.concat(*[c for x in columns for c in (x, F.lit(SEPARATOR))])


def span_id(lang: Column, kind: Column, fq: Column, fingerprint: Column, version: int = NORMALIZATION_VERSION) -> Column:
    """SHA-256, in hex, of version, language, kind, symbol path and hex fingerprint: no location."""
    return F.sha2(_fields(F.lit(str(version)), lang, kind, fq, F.lower(fingerprint)), 256)


def canonical_json(versions: Column) -> Column:
    """Key-sorted compact JSON of a map of strings; ``{}`` for an empty or null map."""
    entries = F.array_sort(F.map_entries(F.coalesce(versions, F.create_map().cast("map<string,string>"))))
    # JSON's own escapes: backslash (first) and quote, five short ones, and the other control characters by their code.
    short = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\t": "\\t", "\r": "\\r", "\b": "\\b", "\f": "\\f"}
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(e).alias("e")) for c, e in {**short, **{chr(i): f"\\u{i:04x}" for i in range(32) if chr(i) not in short}}.items()])
    quoted = lambda x: F.when(F.rlike(x, F.lit(r'[\\"\x00-\x1F]')), F.aggregate(pairs, x, lambda a, p: F.replace(a, p["c"], p["e"]))).otherwise(x)
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(F.lit('"'), quoted(e["key"]), F.lit('":"'), quoted(e["value"]), F.lit('"'))), ","), F.lit("}"))


def artifact_id(span_ids: Column, logical_key: Column, extractor: Column, extractor_version: Column, prompt_version: Column, model_id: Column, versions: Column) -> Column:
    """SHA-256, in hex, over the distinct sorted evidence and what made the artifact. No evidence is an error."""
    ids = F.array_sort(F.array_distinct(span_ids))
    evidence = F.concat(F.array_join(ids, SEPARATOR), F.lit(SEPARATOR))
    body = F.concat(_fields(F.lit(str(ARTIFACT_ID_VERSION)), F.size(ids).cast("string")), evidence, _fields(logical_key, extractor, extractor_version, prompt_version, model_id, canonical_json(versions)))
    return F.when(F.size(ids) == 0, F.raise_error(F.lit("an artifact needs evidence"))).otherwise(F.sha2(body, 256))


def digest12(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 12)


def module_name(path: Column, root: Column) -> Column:
    """Dotted module of a path: root stripped, ``__init__`` dropped."""
    below = F.when((root != "") & F.startswith(path, F.concat(root, F.lit("/"))), F.substr(path, F.length(root) + 2)).otherwise(path)
    return F.replace(F.regexp_replace(below, r"(/?__init__)?\.py$", ""), F.lit("/"), F.lit("."))
