"""Corpus pipeline: five stages over the documents table.

toxicity -> near duplicates -> benchmark decontamination -> personal data -> BPE.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and
returns a DataFrame that is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents: doc_id, text, lang, source, n_chars.

Defined results: rows with null or empty texts are clean and stay; an empty table
stays empty.  Rows with a null or repeated doc_id are treated like any other: every
stage decides row by row.  Rows without words are near duplicates of nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm import bpe, decontam, jaccard_join, pii, toxicity
from pagequarry.llm.common import documents, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on this stage's input, doesn't reject (score under 0.7)."""
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(docs.select(*COLUMNS), model, score="toxicity").filter("toxicity < 0.7").select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row: that with the least doc_id, null last, and of those the first that is read.

    Rows are told apart by a number of their own, written with them, so rows that share
    a doc_id are decided one by one, and texts aren't sorted or dealt out again.
    """
    rows = written(docs.select(*COLUMNS).withColumn("__row", F.monotonically_increasing_id()), "rows")
    groups = jaccard_join.near_duplicates(rows, doc_id="__row").select(F.col("doc_id").alias("__row"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "__row")
    first = rows.select("__row", "doc_id").join(groups, "__row").groupBy("component_id").agg(F.min_by("__row", order).alias("__row"))
    kept = written(first.select("__row"), "kept")
    few = kept.count() <= jaccard_join.BROADCAST_NODES  # 8 bytes each
    return rows.join(F.broadcast(kept) if few else kept, "__row", "left_semi").select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return docs.select(*COLUMNS, decontam.leak_count("text", items).alias("__leaks")).filter("__leaks = 0").select(*COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with <KIND> in place of personal data; n_chars is that of the new text where it changed."""
    found = pii.find_pii(docs.select(*COLUMNS))
    masked = pii.redact(found)
    n = F.when(F.size("pii_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", n).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids, decoded_sha256 of every document."""
    coded = bpe.encode_and_decode(docs.select("doc_id", "text", "lang", "source"))
    return coded.select(
        "doc_id",
        "lang",
        "source",
        F.size("token_ids").cast("long").alias("n_tokens"),
        "token_ids",
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", keep_civil),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_leaks),
    ("pii", mask_personal_data),
    ("bpe", tokenize),
]

#: The stages of toxicity and BPE can't be expressed in SQL; tests/llm checks them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
