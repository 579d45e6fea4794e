"""Secrets: fixed formats, and a battery of randomness tests over long tokens.

Spark functions only.  Fixed formats: assignments to names such as password, access
keys, long runs of hexadecimal digits.  Beyond them, every run of 20 or more
letters, digits and +/_=- is a candidate if it mixes letters and digits.  Dashes and
underscores part it and are left out; the encoding of the rest is inferred
(hexadecimal, base 32, base 64).

The null hypothesis is that a candidate is a natural identifier: names, words and
numbers put together.  Three tests ask whether it is further from that than chance
allows, each with the least departure from randomness that such identifiers have
(NATURAL): chi-squared uniformity of the symbols over the alphabet (against the
noncentral distribution of uneven symbols), runs of one class of signs (natural ones
change seldom between capitals, small letters and digits), and serial correlation of
neighbours (against a correlation as sequences have it).  A secret must pass all
three, so its p-value is the largest.  Over the candidates of a text the
Benjamini-Hochberg procedure, with weights in proportion to length, keeps the rate of
natural identifiers among what is told at `fdr`.  What it rejects as natural, holds
`least_bits` of its alphabet and overlaps no fixed format is a secret, kind random; its
score, 1 less the p-value, grows with the evidence.  The distributions are normal
approximations; a short token rarely has evidence enough.

Defined results: a null or empty text has no spans; a very long one is searched whole.
Repeated rows are treated each, an empty table stays empty.  Result columns replace
input columns of the same name; others pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_or_empty
from .spans import listed, with_matches

KINDS = ["assign", "access", "hex", "random"]
BASE = 3
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)""",
    "access": r"AKIA[A-Z0-9]{12,}+",
    "hex": r"[0-9a-f]{32,}+",
    "random": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+",
}
#: Alphabets in the order of their values; upper case is folded for hexadecimal.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


#: Of natural identifiers, by alphabet: excess of the symbols' chi-squared for each symbol, and share of neighbours of unlike class; and the correlation of sequences.
NATURAL = {"hex": (0.6, 0.25), "base32": (1.0, 0.12), "base64": (2.0, 0.3)}
NATURAL_SERIAL = 0.5


def _normal(z: str) -> str:
    """The normal distribution function by a logistic curve; off by less than 0.0002."""
    return f"(1 / (1 + exp(-1.5976D * ({z}) - 0.07056D * pow({z}, 3))))"


def _tested(column: str) -> str:
    """SQL: candidates of column with encoding, length, bits, and the p-value of the battery."""
    body = "translate(rtrim('=', x.value), '-_', '')"
    encoding = f"case when {body} rlike '^[0-9a-fA-F]+$' then 'hex' when {body} rlike '^[A-Z2-7]+$' then 'base32' else 'base64' end"
    one = f"transform({column}, x -> named_struct('start', x.start, 'end', x.end, 'body', {body}, 'encoding', {encoding}))"
    of = lambda values: "case x.encoding " + " ".join(f"when '{k}' then {v}" for k, v in values.items()) + " end"
    alphabet = of({k: f"'{v}'" for k, v in ALPHABETS.items()})
    signs = "filter(split(x.body, ''), c -> c <> '')"
    two = (
        f"transform({one}, x -> named_struct('start', x.start, 'end', x.end, 'encoding', x.encoding, 'width', length({alphabet}), "
        f"'v', transform(filter(split(case when x.encoding = 'hex' then lower(x.body) else x.body end, ''), c -> c <> ''), c -> instr({alphabet}, c) - 1), "
        f"'class', transform({signs}, c -> case when c between 'A' and 'Z' then 1 when c between 'a' and 'z' then 2 else 3 end)))"
    )
    three = (
        f"transform({two}, x -> named_struct('start', x.start, 'end', x.end, 'encoding', x.encoding, 'width', x.width, 'n', size(x.v), "
        "'squares', aggregate(sequence(0, x.width - 1), 0L, (a, s) -> a + cast(pow(size(filter(x.v, y -> y = s)), 2) as long)), "
        "'turns', size(filter(zip_with(x.class, slice(x.class, 2, size(x.class)), (p, q) -> p <> q), d -> d)), "
        "'mean', aggregate(x.v, 0D, (a, y) -> a + y) / greatest(size(x.v), 1), 'v', x.v))"
    )
    four = (
        f"transform({three}, x -> named_struct('start', x.start, 'end', x.end, 'n', x.n, 'bits', x.n * log2(x.width), 'turns', cast(x.turns as double), "
        f"'chi', x.width * x.squares / cast(x.n as double) - x.n, 'free', cast(x.width - 1 as double), 'excess', x.n * {of({k: f'{v[0]}D' for k, v in NATURAL.items()})}, "
        f"'rate', {of({k: f'{v[1]}D' for k, v in NATURAL.items()})}, "
        "'cov', aggregate(filter(zip_with(x.v, slice(x.v, 2, size(x.v)), (p, q) -> (p - x.mean) * (q - x.mean)), d -> d is not null), 0D, (a, y) -> a + y), "
        "'var', aggregate(x.v, 0D, (a, y) -> a + pow(y - x.mean, 2))))"
    )
    uneven = "(x.chi - x.free - x.excess) / sqrt(2 * (x.free + 2 * x.excess))"
    runs = "((x.n - 1) * x.rate + 0.5D - x.turns) / sqrt((x.n - 1) * x.rate * (1 - x.rate))"
    serial = f"case when x.var > 0 then (atanh(least(abs(x.cov / x.var), 0.999D)) - atanh({NATURAL_SERIAL}D)) * sqrt(x.n - 3) else 9D end"
    return f"transform(filter({four}, x -> x.n > 8), x -> named_struct('start', x.start, 'end', x.end, 'n', x.n, 'bits', x.bits, 'p', greatest({_normal(uneven)}, {_normal(runs)}, {_normal(serial)})))"


def find_secrets(df: DataFrame, text: str = "text", spans: str = "secret_spans", fdr: float = 0.05, least_bits: float = 90.0) -> DataFrame:
    """df with spans: array<struct<start, kind_no, end, kind, score>>; score is 1 for fixed formats, else 1 less the p-value of the battery."""
    df = df.withColumn("__text", text_or_empty(text))
    guards = {"assign": None, "access": F.col("__text").contains("AKIA"), "hex": F.col("__text").rlike("[0-9a-f]{32}"), "random": F.col("__text").rlike("[0-9]")}
    keep = {
        "assign": "length(regexp_extract(x.value, '[:=]\\\\x20*+[\"\\']?+([A-Za-z0-9+/_.=-]++)$', 1)) >= 8",
        "access": "length(x.value) >= 16",
        "hex": "length(x.value) >= 32",
    }
    for no, kind in enumerate(KINDS[:BASE]):
        df = with_matches(df, "__text", f"__{kind}", PATTERNS[kind], guards[kind])
        df = df.withColumn(
            f"__{kind}",
            F.expr(f"transform(filter(__{kind}, x -> {keep[kind]}), x -> named_struct('start', x.start, 'kind_no', {no}, 'end', x.end, 'kind', '{kind}', 'score', 1D))"),
        )
    df = df.withColumn("__base", F.concat(*[F.col(f"__{k}") for k in KINDS[:BASE]]))
    df = with_matches(df, "__text", "__random", PATTERNS["random"], guards["random"])
    mixed = "x.value rlike '[0-9]' and x.value rlike '[A-Za-z]' and not exists(__base, b -> b.start < x.end and x.start < b.end)"
    df = df.withColumn("__random", F.expr(f"filter(__random, x -> {mixed})"))
    tested = "cast(array() as array<struct<start:int,end:int,n:int,bits:double,p:double>>)"
    df = df.withColumn("__tested", F.expr(f"case when size(__random) > 0 then {_tested('__random')} else {tested} end"))
    # Weighted Benjamini-Hochberg: p over weight, in order; all up to the last one below its line are rejected.
    weight = "(x.n * size(__tested) / aggregate(__tested, 0D, (a, y) -> a + y.n))"
    df = df.withColumn(
        "__tested",
        F.expr(f"sort_array(transform(__tested, x -> named_struct('q', x.p / {weight}, 'start', x.start, 'end', x.end, 'bits', x.bits, 'p', x.p)))"),
    )
    line = f"coalesce(array_max(transform(__tested, (x, i) -> case when x.q <= (i + 1) * {fdr}D / size(__tested) then i end)), -1)"
    df = df.withColumn("__line", F.expr(line))
    df = df.withColumn(
        "__random",
        F.expr(
            f"transform(filter(__tested, (x, i) -> i <= __line and x.bits >= {least_bits}D), "
            f"x -> named_struct('start', x.start, 'kind_no', {BASE}, 'end', x.end, 'kind', 'random', 'score', 1 - x.p))"
        ),
    )
    done = df.withColumn(spans, F.sort_array(F.concat("__base", "__random")))
    return done.drop("__text", "__base", "__tested", "__line", *[f"__{k}" for k in KINDS])


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts of the three base kinds, base_sha256 and spans of every whole text of documents."""
    found = find_secrets(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    found = found.withColumn("__base", F.expr(f"filter(secret_spans, x -> x.kind_no < {BASE})"))
    count = lambda k: F.expr(f"size(filter(secret_spans, x -> x.kind = '{k}'))").cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *map(count, KINDS[:BASE]),
        F.sha2(listed("__base", KINDS).cast("binary"), 256).alias("base_sha256"),
        listed("secret_spans", KINDS).alias("spans"),
    )
