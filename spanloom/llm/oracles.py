"""DuckDB SQL of the queries that SQL can express. The others are tested against brute force."""

from __future__ import annotations

from spanloom.llm import licenses

ORACLES: dict[str, str] = {}


def license_sql() -> str:
    rows = []
    for name, text in licenses.TEMPLATES.items():
        k, own = licenses.shingles(text)
        width, step = licenses.window_of(len(own))
        rows += [f"('{name}', {k}, {len(own)}, {width}, {step}, '{s}')" for s in own]
    return f"""
WITH template(license, k, n, width, step, shingle) AS (VALUES {", ".join(rows)}),
doc AS (SELECT DISTINCT doc_id, text, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
place AS (SELECT doc_id, text, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM doc CROSS JOIN (SELECT DISTINCT k FROM template) ks),
gram AS (SELECT doc_id, text, k, i - 1 AS p, array_to_string(w[i:i + k - 1], ' ') AS shingle FROM place),
hit AS (SELECT doc_id, text, license, n, width, step, p, gram.shingle FROM gram JOIN template USING (k, shingle)),
wide AS (SELECT doc_id, text, license, n, step, shingle, unnest(generate_series(greatest(0, CAST(ceil((p - width + 1) / step) AS BIGINT)), p // step)) AS k FROM hit),
held AS (SELECT doc_id, text, license, n, step, k, count(DISTINCT shingle) AS n_shared FROM wide GROUP BY ALL HAVING count(DISTINCT shingle) * 1000 >= n * 800)
SELECT doc_id, license, max(n_shared) AS n_shared, CAST(any_value(n) AS BIGINT) AS n_shingles, CAST(arg_max(k * step, n_shared * 1000000000 - k * step) AS BIGINT) AS first_word
FROM held GROUP BY doc_id, text, license
"""


ORACLES["op1_license_scan"] = license_sql()
ORACLES["op5_decontamination"] = r"""
WITH item AS (SELECT DISTINCT item_id, text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
q AS (SELECT item_id, text, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS shingle FROM item),
sized AS (SELECT *, count(*) OVER (PARTITION BY item_id, text) AS n FROM q),
doc AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
d AS (SELECT r, doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS shingle FROM doc)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n) AS n_shingles, count(*) / any_value(n) AS containment
FROM d JOIN sized USING (shingle) GROUP BY r, doc_id, item_id, text HAVING count(*) * 1000 >= any_value(n) * 800
"""
