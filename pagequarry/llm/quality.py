"""Quality by hierarchical empirical Bayes: documents, paths, hosts, all.

A classifier of dense features of the text gives each document's evidence, a
probability p.  Sums of p over hosts and over paths (a host's parts) are grouped
aggregations over all documents.  A host's rate is shrunk towards the rate of all, a
path's towards its host's; how much is estimated from the data (the variance between
hosts, and between paths within hosts, beyond what chance explains), so a site with
few documents says little and one with many says what they show.  The document itself
is left out of its host's and path's sums.  A document's odds are those of its
evidence times the ratio of its path's odds to the odds of all.

The classifier is fitted on at most `bound` labelled rows whose crc32(doc_id as text)
mod 3 isn't 1, chosen by a hash.  In `documents`, host is source, path is source
and lang.  Sums are partial before they are shuffled, so a host with a third of all
rows is one row a task; texts aren't shuffled.

Defined results: a null text is empty.  Null hosts and paths are groups of their own.
Null labels don't count; of contradicting labels of one id the larger does.  Without
labels of both classes the evidence is the sample's rate (0.5 without labels).
Repeated rows count each.  A very long text is read whole.  An empty table gives no
rows.  Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, small_batches, text_or_empty, written
from .gbt import BoostedTrees, Isotonic
from .toxicity import is_held_out, labelled_sample

SAMPLE_BOUND = 20_000
_CAPS = re.compile(r"\b[A-Z]{3,}\b")


def features(text: str) -> list[float]:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    counts = np.bincount(data, minlength=256)
    size = max(len(data), 1)
    words = text.split()
    n = max(len(words), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    return [
        float(np.log1p(len(words))),
        len(data) / n,
        len(set(words)) / n,
        len(set(lines)) / max(len(lines), 1),
        n / max(len(lines), 1),
        upper / max(upper + lower, 1),
        int(counts[48:58].sum()) / size,
        int(counts[35:39].sum() + counts[42] + counts[64] + counts[94] + counts[126]) / size,
        float(counts[33]) / size,
        float(counts[124] + counts[60] + counts[62] + counts[123] + counts[125]) / size,
        int(counts[44] + counts[46]) / n,
        int(counts[128:].sum()) / size,
        len(_CAPS.findall(text)) / n,
        float(text.rstrip()[-1:] in ".!?\"'"),
    ]


class Evidence:
    def __init__(self, prior: float, trees: BoostedTrees | None = None, scale: Isotonic | None = None):
        self.prior, self.trees, self.scale = prior, trees, scale

    def probabilities(self, texts: list[str]) -> np.ndarray:
        if self.trees is None or not texts:
            return np.full(len(texts), self.prior)
        p = self.trees.probability(np.array([features(t) for t in texts]))
        return np.clip(0.98 * self.scale(p) + 0.02 * p, 0.005, 0.995)


def fit_evidence(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_BOUND) -> Evidence:
    small_batches(docs.sparkSession)
    chosen = labelled_sample(labels, "quality", bound)
    sample = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")  # bound rows of two numbers

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def dense(column: pa.Array) -> pa.Array:
        return pa.array([features(t or "") for t in column.to_pylist()], pa.list_(pa.float64()))

    rows = sample.select("doc_id", "label", dense("text").alias("x"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(bound).toPandas()  # a labelled doc_id may stand on very many rows
    rows = rows.sort_values("doc_id", kind="stable")
    y = rows["label"].to_numpy(dtype=float)
    prior = float(np.clip(y.mean(), 0.005, 0.995)) if len(y) else 0.5
    if len(y) < 8 or y.min() == y.max():
        return Evidence(prior)
    x = np.stack(rows["x"].to_numpy())
    keep = rows["doc_id"].to_numpy(dtype=np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(62) != 0
    trees = BoostedTrees(least=max(2, min(20, len(y) // 40))).fit(x[keep], y[keep])
    return Evidence(prior, trees, Isotonic().fit(trees.probability(x[~keep]), y[~keep]))


def _strength(groups: DataFrame, total: str, n: str, mean: Column, ceiling: float = 1e6) -> float:
    """Pseudo-counts of the prior, by moments: groups' rates vary about `mean` by chance (rate * (1 - rate) / n) and by what the prior allows."""
    rate = F.col(total) / F.col(n)
    row = groups.filter(F.col(n) > 0).agg(
        F.sum(F.col(n) * (rate - mean) ** 2).alias("spread"), F.sum(F.col(n)).alias("n"), F.count(F.lit(1)).alias("groups"), F.sum(F.col(n) * mean * (1 - mean)).alias("chance")
    ).first()
    if not row.n or row.groups < 2:
        return ceiling
    inner = row.chance / row.n
    between = max((row.spread - row.groups * inner) / row.n, 1e-9)
    return float(min(max(inner / between - 1, 1.0), ceiling))


def score_quality(df: DataFrame, evidence: Evidence, host: str = "source", path: str = "lang", text: str = "text") -> DataFrame:
    """df: doc_id, text, host, path.  -> doc_id, evidence, host_rate, path_rate, score."""
    shared = df.sparkSession.sparkContext.broadcast(evidence)  # some tens of kilobytes

    @F.arrow_udf(T.DoubleType())
    def run(column: pa.Array) -> pa.Array:
        return pa.array(shared.value.probabilities([t or "" for t in column.to_pylist()]), pa.float64())

    rows = df.select("doc_id", F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), run(text_or_empty(text)).alias("evidence"))
    rows = written(rows, "evidence")
    paths = rows.groupBy("host", "path").agg(F.sum("evidence").alias("path_sum"), F.count(F.lit(1)).alias("path_n"))
    hosts = paths.groupBy("host").agg(F.sum("path_sum").alias("host_sum"), F.sum("path_n").alias("host_n"))
    both = paths.withColumnRenamed("host", "own").join(hosts, F.col("own").eqNullSafe(F.col("host"))).drop("own")
    both = written(both, "sites")
    total = hosts.agg(F.sum("host_sum").alias("s"), F.sum("host_n").alias("n")).first()
    every = float(total.s / total.n) if total.n else 0.5
    of_host = _strength(both.select("host", "host_sum", "host_n").distinct(), "host_sum", "host_n", F.lit(every))
    of_path = _strength(both, "path_sum", "path_n", F.col("host_sum") / F.col("host_n"))
    named = both.select(F.col("host").alias("h"), F.col("path").alias("p"), "path_sum", "path_n", "host_sum", "host_n")
    joined = rows.join(named, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
    joined = joined.withColumn("host_rate", (F.col("host_sum") - F.col("evidence") + of_host * every) / (F.col("host_n") - 1 + of_host))
    joined = joined.withColumn("path_rate", (F.col("path_sum") - F.col("evidence") + of_path * F.col("host_rate")) / (F.col("path_n") - 1 + of_path))
    odds = lambda c: c / (1 - c)
    joined = joined.withColumn("odds", odds(F.col("evidence")) * odds(F.col("path_rate")) / odds(F.lit(every)))
    return joined.select("doc_id", "evidence", "host_rate", "path_rate", (F.col("odds") / (1 + F.col("odds"))).alias("score"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, evidence, host_rate, path_rate, score, predicted of every whole text of documents."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    evidence = fit_evidence(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_quality(docs, evidence)
    return scored.select("doc_id", is_held_out().alias("held_out"), "evidence", "host_rate", "path_rate", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
