"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score. DataFrame functions only.

Base kinds (email, ip, card, phone) are reported whenever their pattern and validator agree; nearby words only move their
score. Added kinds are reported if their score, after the words nearby, reaches ``ACCEPT``: ``iban`` (a country's length, mod-97),
``dni`` (mod-23), ``nir`` (mod-97), ``ssn`` (ranges), ``tel``, a national phone number, which has no checksum and so needs a
word such as "phone" nearby, and ``secret``, a key of a known form or a long value assigned to a name such as "token". Words
before and after a span count: those of its kind raise its score, those that speak against it (an order's number, a sample)
lower it. Added spans do not displace base spans, and a ``tel`` or national id that overlaps one is dropped.

Matches of a kind are leftmost and do not overlap; offsets are code points, found by splitting the text at the matches.
The Java patterns are those of the contract with possessive repeats and look-behinds where these cannot change a match,
so that no text makes matching quadratic or deep.

Defined results: null and blank texts have no spans, and the digest of nothing; rows with null or equal ids get a row each;
other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import text_of

#: Fixed values of the contract: kinds in their order.
KINDS = ("email", "ip", "card", "phone")
ADDED = ("iban", "dni", "nir", "ssn", "tel", "secret")
#: Lengths of IBANs by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ DZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    # The length is that of the country, so that what follows an IBAN is not taken for a part of it.
    "iban": r"(?<![A-Za-z0-9])(?:" + "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + r")(?![A-Za-z0-9])",
    "dni": r"(?<![A-Za-z0-9])[0-9]{8}-?[A-Z](?![A-Za-z0-9])",
    "nir": r"(?<![A-Za-z0-9])[12] ?[0-9]{2} ?(?:0[1-9]|1[0-2]) ?[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])",
    "tel": r"\(?0[0-9]{1,4}\)?[ /-][0-9][0-9 -]{4,12}[0-9]",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[oprsu]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,200}+|xox[abprs]-[A-Za-z0-9-]{10,200}+|eyJ[A-Za-z0-9_-]{8,4000}+\.[A-Za-z0-9_-]{8,4000}+\.[A-Za-z0-9_-]{8,4000}+|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----|(?i:[a-z0-9_-]{0,20}(?:token|secret|passwd|password|pwd|api[_-]?key|access[_-]?key|auth[_-]?key)[\"']?[ ]{0,3}[=:][ ]{0,3}[\"']?[a-z0-9+/_.~=-]{16,4000}+))",
}
#: What a text must hold for a kind's pattern to be tried.
NEEDS = {"email": "@", "phone": "[+]", "ip": "[.]", "ssn": "[0-9]-", "dni": "[0-9]{8}", "nir": "[12] ?[0-9]{2} ?[01]"}
OCTETS = r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"
#: Score of a kind by itself, what words nearby add or take, and those words, lower case.
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.7, "dni": 0.6, "nir": 0.6, "ssn": 0.4, "tel": 0.3, "secret": 0.7}
NEARBY, AGAINST, REACH, ACCEPT = 0.2, 0.3, 40, 0.5
CONTEXT = {
    "email": "mail|contact|kontakt|correo|courriel",
    "ip": r"\bip\b|host|server|address|adresse",
    "card": "card|visa|credit|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "dni": r"\bdni\b|\bnif\b|identidad|documento",
    "nir": r"\bnir\b|\bins[ée]e\b|s[ée]cu|assur",
    "ssn": r"\bssn\b|social|security|\btin\b|taxpayer",
    "tel": "phone|tel|call|mobile|fax|handy",
    "secret": "key|token|secret|password|bearer|credential",
}
CONTRARY = r"\bisbn\b|\binvoice|\border (?:no|number|id)|\brechnung|\bfacture|\bfactura|\bexample\b|\bsample\b|\bplaceholder\b|\bdummy\b|\bversion\b"
#: Different characters that a secret holds at least.
VARIETY = 8


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """The Luhn check of a string of digits: every second one from the right is doubled."""
    backwards = F.reverse(x)

    def value(i: Column) -> Column:
        d = (F.ascii(F.substring(backwards, i, F.lit(1))) - 48) * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(x)), F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def mod97(x: Column) -> Column:
    """The ISO 7064 check of an IBAN without blanks: first four characters last, letters from 10 up."""
    turned = F.concat(F.substr(x, F.lit(5)), F.substr(x, F.lit(1), F.lit(4)))

    def step(r: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, r * 100 + (c - 55)).otherwise(r * 10 + (c - 48)) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(x)), F.lit(0), step) == 1


def _valid(kind: str, x: Column) -> Column:
    n = F.length(_digits(x))
    if kind == "ip":
        return F.rlike(x, F.lit(OCTETS))
    if kind == "card":
        return n.between(14, 19) & luhn(_digits(x))
    if kind == "phone":
        return n.between(10, 15)
    if kind == "iban":
        plain = F.replace(x, F.lit(" "), F.lit(""))
        return F.length(plain).between(15, 34) & mod97(plain)
    if kind == "dni":
        # The control letters by the number's remainder of 23.
        return F.substr(F.lit("TRWAGMYFPDXBNJZSQVHLCKE"), (_digits(x).cast("long") % 23 + 1).cast("int"), F.lit(1)) == F.right(x, F.lit(1))
    if kind == "nir":
        d = _digits(x)
        return F.substr(d, F.lit(14), F.lit(2)).cast("long") == 97 - F.substr(d, F.lit(1), F.lit(13)).cast("long") % 97
    if kind == "tel":
        return n.between(9, 12)
    if kind == "secret":
        return F.size(F.array_distinct(F.split(x, ""))) > VARIETY
    return F.lit(True)


def _proposed(text: Column, kind: str) -> Column:
    """Array of (kind's place, kind, start, end, value): all matches of the kind that its validator confirms."""
    pattern = F.lit(PATTERNS[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    if kind in NEEDS:
        found = F.when(F.rlike(text, F.lit(NEEDS[kind])), found).otherwise(F.array().cast("array<string>"))
    return found


def _placed(found: Column, pieces: Column, kind: str) -> Column:
    """Adds up the lengths of the pieces between matches and of the matches before."""
    order = (KINDS + ADDED).index(kind)
    empty = F.array().cast("array<struct<start:int,place:int,kind:string,end:int,value:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.length(x["match"])
        span = F.struct(start.alias("start"), F.lit(order).alias("place"), F.lit(kind).alias("kind"), end.alias("end"), x["match"].alias("value"))
        out = F.when(_valid(kind, x["match"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    pairs = F.zip_with(found, F.slice(pieces, 1, F.size(found)), lambda m, p: F.struct(p.alias("piece"), m.alias("match")))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda a: a["out"])


def _score(text: Column, x: Column, kind: str | None = None) -> Column:
    start, end = x["start"], x["end"]
    near = F.lower(F.concat_ws("\n", F.substring(text, F.greatest(F.lit(1), start - REACH + 1), F.least(F.lit(REACH), start)), F.substring(text, end + 1, F.lit(REACH))))
    score = F.lit(0.0)
    for k in (kind,) if kind else KINDS + ADDED:
        score = F.when(x["kind"] == k, F.lit(SCORES[k]) + F.when(F.rlike(near, F.lit(CONTEXT[k])), NEARBY).otherwise(0.0)).otherwise(score)
    return F.round(score - F.when(F.rlike(near, F.lit(CONTRARY)), AGAINST).otherwise(0.0), 2)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, n_added, n_found, base_sha256, spans, scores) for each row of ``docs``.

    ``n_added`` counts the spans of added kinds, ``n_found`` all spans.
    ``spans`` and ``scores`` are joined by commas, in order of start and kind; a span is ``kind:start:end``.
    """
    df = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    for k in KINDS + ADDED:
        df = df.withColumn(f"_f{k}", _proposed(F.col("t"), k))
    for k in KINDS + ADDED:
        pieces = F.split("t", PATTERNS[k], -1)
        df = df.withColumn(f"_s{k}", F.when(F.size(f"_f{k}") > 0, _placed(F.col(f"_f{k}"), pieces, k)).otherwise(F.array().cast("array<struct<start:int,place:int,kind:string,end:int,value:string>>")))
    df = df.withColumn("_base", F.array_sort(F.concat(*[F.col(f"_s{k}") for k in KINDS])))
    apart = lambda x: ~F.exists("_base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))

    def accepted(kind: str) -> Column:
        enough = lambda x: _score(F.col("t"), x, kind) >= ACCEPT
        return F.filter(f"_s{kind}", enough if kind in ("iban", "secret") else lambda x: enough(x) & apart(x))

    added = [accepted(k) for k in ADDED]
    some = sum((F.size(f"_s{k}") for k in ADDED), F.lit(0)) > 0
    df = df.withColumn("_all", F.when(some, F.array_sort(F.concat("_base", *added))).otherwise(F.col("_base")))
    text = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    joined = lambda c: F.array_join(F.transform(c, text), ",")
    return df.select(
        F.col("id").alias(id_col),
        *[F.size(f"_s{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        (F.size("_all") - F.size("_base")).cast("long").alias("n_added"),
        F.size("_all").cast("long").alias("n_found"),
        F.sha2(joined("_base"), 256).alias("base_sha256"),
        joined("_all").alias("spans"),
        F.array_join(F.transform("_all", lambda x: _score(F.col("t"), x).cast("string")), ",").alias("scores"),
    )
