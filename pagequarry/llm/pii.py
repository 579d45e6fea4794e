"""Personal data: patterns propose, checksums confirm, nearby words adjust a score.

Spark functions only.  Every pattern is written with possessive quantifiers and
starts only where a run of its characters starts, so a text costs its length, not
its square, and long matches don't recurse.

Kinds: email, ip, card and phone are always kept when their checks pass.  iban
(mod-97) and ssn (no checksum) are kept when their score reaches keep_score; an
ssn does so only beside words that speak for it.

Defined results: a null or empty text has no spans; a very long one is searched whole,
at a cost that grows with its length.  Repeated rows are treated each, an empty table
stays empty.  Result columns replace input columns of the same name; others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_or_empty
from .spans import listed, with_matches

KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE = 4

#: Lengths of IBANs, by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_LISTED = "|".join(f"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\\x20?+[A-Z0-9]){{{n - 4}}}+" for n, codes in IBAN_LENGTHS.items())
_KNOWN = " ".join(IBAN_LENGTHS.values()).replace(" ", "|")

#: iban: as many signs as the country's have, so that a word after it isn't taken in; of other countries a run.
#: \G lets a match start where the one before ended, though that is within a run.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_LISTED}|(?!{_KNOWN})[A-Z]{{2}}[0-9]{{2}}(?:\x20?+[A-Z0-9]){{11,30}}+)(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Score of a confirmed proposal, and words nearby that speak for it.
SCORES = {"email": 0.7, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
WORDS_FOR = {
    "email": "mail|contact|write|address|kontakt|correo|courriel",
    "ip": "host|server|address|addr|login|client|node",
    "card": "card|visa|master|credit|debit|payment|karte|tarjeta|carte",
    "phone": "phone|tel|call|mobile|fax|telefon|movil|appel",
    "iban": "iban|account|bank|konto|cuenta|compte",
    "ssn": "ssn|social|security",
}
WORDS_AGAINST = "version|invoice|order|serial|isbn|release|build"
STEP = 0.2


def _valid(kind: str) -> str:
    """SQL over x.value."""
    digits = "regexp_replace(x.value, '[^0-9]', '')"
    if kind == "ip":
        part = "trim(leading '0' from p)"
        return f"forall(split(x.value, '[.]'), p -> length({part}) <= 3 and coalesce(try_cast({part} as int), 0) <= 255)"
    if kind == "card":
        return f"length({digits}) between 14 and 19 and luhn_check({digits})"
    if kind == "phone":
        return f"length({digits}) between 10 and 15"
    if kind == "iban":
        packed = "replace(x.value, ' ', '')"
        turned = f"concat(substring({packed}, 5), substring({packed}, 1, 4))"
        step = "case when c between '0' and '9' then (a * 10 + ascii(c) - 48) % 97 when c = '' then a else (a * 100 + ascii(c) - 55) % 97 end"
        return f"aggregate(split({turned}, ''), 0, (a, c) -> {step}) = 1"
    return "true"


def _score(kind: str) -> str:
    near = "lower(concat(x.before, ' ', x.after))"
    return (
        f"cast(round(greatest(0.0D, least(1.0D, {SCORES[kind]}D + case when {near} rlike '{WORDS_FOR[kind]}' then {STEP}D else 0.0D end "
        f"- case when {near} rlike '{WORDS_AGAINST}' then {STEP}D else 0.0D end)), 2) as double)"
    )


def _guards(text: str) -> dict[str, Column]:
    t = F.col(text)
    digit = t.rlike("[0-9]")
    return {"email": t.contains("@"), "ip": t.contains(".") & digit, "card": digit, "phone": t.contains("+"), "iban": digit, "ssn": t.contains("-") & digit}


def find_pii(df: DataFrame, text: str = "text", spans: str = "pii_spans", keep_score: float = 0.5) -> DataFrame:
    """df with spans: array<struct<start, kind_no, end, kind, score>>, sorted by start, then kind."""
    df = df.withColumn("__text", text_or_empty(text))
    guards = _guards("__text")
    parts = []
    for no, kind in enumerate(KINDS):
        column = f"__{kind}"
        df = with_matches(df, "__text", column, PATTERNS[kind], guards[kind])
        made = f"transform(filter({column}, x -> {_valid(kind)}), x -> named_struct('start', x.start, 'kind_no', {no}, 'end', x.end, 'kind', '{kind}', 'score', {_score(kind)}))"
        df = df.withColumn(column, F.expr(made if no < BASE else f"filter({made}, y -> y.score >= {keep_score})"))
        parts.append(column)
    return df.withColumn(spans, F.sort_array(F.concat(*map(F.col, parts)))).drop("__text", *parts)


def redact(df: DataFrame, text: str = "text", spans: str = "pii_spans") -> DataFrame:
    """df whose texts have <KIND> in place of each span; spans that overlap or touch become one, named after the first.

    A text without spans stays as it is, null included.
    """
    kind = "array<struct<start:int,end:int,kind:string>>"
    last = "element_at(a, -1)"
    merged = (
        f"aggregate({spans}, cast(array() as {kind}), (a, x) -> case "
        f"when size(a) > 0 and x.start < get(a, size(a) - 1).end then concat(slice(a, 1, size(a) - 1), "
        f"array(named_struct('start', {last}.start, 'end', greatest({last}.end, x.end), 'kind', {last}.kind))) "
        "else concat(a, array(named_struct('start', x.start, 'end', x.end, 'kind', x.kind))) end)"
    )
    df = df.withColumn("__merged", F.expr(f"case when size({spans}) > 0 then {merged} end"))
    pieces = f"transform(__merged, (x, i) -> concat(substring({text}, coalesce(get(__merged, i - 1).end, 0) + 1, x.start - coalesce(get(__merged, i - 1).end, 0)), '<', upper(x.kind), '>'))"
    tail = f"substring({text}, element_at(__merged, -1).end + 1)"
    return df.withColumn(text, F.expr(f"case when size(__merged) > 0 then concat(array_join({pieces}, ''), {tail}) else {text} end")).drop("__merged")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts of the four base kinds, base_sha256 and spans of every whole text of documents."""
    found = find_pii(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    found = found.withColumn("__base", F.expr(f"filter(pii_spans, x -> x.kind_no < {BASE})"))
    count = lambda k: F.expr(f"size(filter(pii_spans, x -> x.kind = '{k}'))").cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *map(count, KINDS[:BASE]),
        F.sha2(listed("__base", KINDS).cast("binary"), 256).alias("base_sha256"),
        listed("pii_spans", KINDS).alias("spans"),
    )
