"""Toxicity: boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities of two lexicons (a short fixed one, and words that the
labelled sample shows to be toxic), how near they stand to second-person words, the
shares of capitals and punctuation, and rates of obfuscation (letters written as
digits or signs).  Labels come only from rows whose crc32(doc_id as text) mod 3 isn't
1, at most `bound` of them, chosen by a hash of doc_id; language, source and doc_id
are no inputs.  The lexicon is counted over all of that sample.  Three quarters of
it fit the trees, the rest the calibration.  Scoring is one pass without shuffle.

Defined results: a null text is scored as the empty text.  A null doc_id is never
held out.  Null labels don't count; of contradicting labels of a doc_id the larger
does.  Without labels of both classes every score is the sample's share of 1 (0
without labels).  Repeated rows are scored each, alike.  A very long text is scored
whole, by rates that don't grow with it.  An empty table gives no rows.  A column of
the input named like the score is replaced by it; all others pass through.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, small_batches, text_or_empty
from .gbt import BoostedTrees, Isotonic

#: Insults, and second-person words of the four languages.
INSULTS = frozenset("idiot moron stupid loser scum trash clown pathetic worthless disgusting dumb fool jerk creep garbage filth imbecile".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi vous votre vos usted ustedes tus contigo ti".split())
NEAR = 6
SAMPLE_BOUND = 20_000
LEXICON_WORDS = 300

_WORD = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"[A-Za-z]+[0-9@$!|*.\-]+[A-Za-z][A-Za-z0-9@$!|*.\-]*")
_READ_AS = str.maketrans("0134578@$!|", "oieastbasil")
_LONG = re.compile(r"([A-Za-z])\1\1")


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    """The dense features of one text."""
    data = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    signs = int(counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum())
    words = _WORD.findall(text.lower())
    n = max(len(words), 1)
    hits = [i for i, w in enumerate(words) if w in lexicon]
    fixed = sum(words[i] in INSULTS for i in hits)
    you = 0
    for i in hits:
        you += any(w in SECOND_PERSON for w in words[max(0, i - NEAR) : i + NEAR + 1])
    hidden = mixed = 0
    if counts[33:65].sum() > 0:
        for token in _MIXED.findall(text):
            read = re.sub("[^a-z]", "", token.lower().translate(_READ_AS))
            plain = re.sub("[^a-z]", "", token.lower())
            hit = (read in lexicon or plain in lexicon) and not any(w in lexicon for w in _WORD.findall(token.lower()))
            hidden += hit
            mixed += 1
    letters, size = max(upper + lower, 1), max(len(data), 1)
    weights = [lexicon[words[i]] for i in hits]
    total = len(hits) + hidden
    return [
        float(total),
        100 * total / n,
        100 * fixed / n,
        sum(weights) / n,
        max(weights, default=0.0),
        float(len({words[i] for i in hits})),
        100 * you / n,
        you / max(len(hits), 1),
        upper / letters,
        signs / size,
        float(counts[33]) / size,
        float(counts[42] + counts[64] + counts[36] + counts[35]) / size,
        100 * mixed / n,
        100 * hidden / n,
        len(_LONG.findall(text)) / n,
        float(np.log1p(len(words))),
    ]


class ToxicityModel:
    def __init__(self, lexicon: dict[str, float], prior: float, trees: BoostedTrees | None = None, scale: Isotonic | None = None):
        self.lexicon, self.prior, self.trees, self.scale = lexicon, prior, trees, scale

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None or not texts:
            return np.full(len(texts), self.prior)
        x = np.array([features(t or "", self.lexicon) for t in texts])
        p = self.trees.probability(x)
        # A thousandth of the uncalibrated value keeps the order within a calibrated step.
        return np.clip(0.999 * self.scale(p) + 0.001 * p, 0.0, 1.0)


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(labels: DataFrame, column: str, bound: int) -> DataFrame:
    """At most bound rows (doc_id, label) of rows that aren't held out, by a hash of doc_id."""
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~is_held_out())
    one = rows.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def learned_lexicon(sample: DataFrame, most: int = LEXICON_WORDS) -> dict[str, float]:
    """Words of a sample (text, label) that at least four fifths of the texts holding them are labelled 1 for, with their log odds."""
    totals = sample.agg(F.sum("label").alias("t"), F.count(F.lit(1)).alias("n")).first()
    toxic, n = int(totals.t or 0), int(totals.n)
    words = sample.select("label", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("word")).filter("word <> ''")
    counted = words.groupBy("word").agg(F.sum("label").alias("t"), F.count(F.lit(1)).alias("n"))
    kept = counted.filter((F.col("t") >= max(3, 0.01 * toxic)) & (F.col("t") >= 0.8 * F.col("n")))
    top = kept.orderBy(F.desc("t"), "word").limit(most).collect()
    lexicon = dict.fromkeys(INSULTS, 1.0)
    for r in top:
        lexicon[r.word] = float(np.log((r.t + 0.5) / (toxic + 1)) - np.log((r.n - r.t + 0.5) / (n - toxic + 1)))
    return lexicon


def fit_toxicity(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_BOUND) -> ToxicityModel:
    """docs: doc_id, text.  labels: doc_id, toxic.  bound: the most labelled rows that are used."""
    small_batches(docs.sparkSession)
    chosen = labelled_sample(labels, "toxic", bound)
    # At most bound rows of two numbers: small enough to broadcast.
    sample = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
    lexicon = learned_lexicon(sample)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def dense(column: pa.Array) -> pa.Array:
        return pa.array([features(t or "", lexicon) for t in column.to_pylist()], pa.list_(pa.float64()))

    rows = sample.select("doc_id", "label", dense("text").alias("x"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(bound).toPandas()  # a labelled doc_id may stand on very many rows
    rows = rows.sort_values("doc_id", kind="stable")
    y = rows["label"].to_numpy(dtype=float)
    prior = float(y.mean()) if len(y) else 0.0
    if len(y) < 8 or y.min() == y.max():
        return ToxicityModel(lexicon, prior)
    x = np.stack(rows["x"].to_numpy())
    keep = rows["doc_id"].to_numpy(dtype=np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(62) != 0
    trees = BoostedTrees(least=max(2, min(20, len(y) // 40))).fit(x[keep], y[keep])
    p = trees.probability(x[~keep])
    return ToxicityModel(lexicon, prior, trees, Isotonic().fit(p, y[~keep]))


def score_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text", score: str = "toxicity") -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)  # some tens of kilobytes, whatever the input

    @F.arrow_udf(T.DoubleType())
    def run(column: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(column.to_pylist()), pa.float64())

    return df.withColumn(score, run(text_or_empty(text)))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text of documents."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_toxicity(docs, model, score="score")
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
