"""BPE encoding and decoding of whole texts.

Each task walks a trie of the distinct words of its batches (see wordbpe.py);
there is no shuffle.  Encodings of words are kept between batches, bounded in bytes in
each Python worker, so a lost executor costs only its own tasks.

Defined results: a null or empty text has no ids and decodes to the empty text; the
ids column is never null.  Repeated rows are encoded each.  A very long text is
encoded whole, in memory of some times its size; a very long word isn't kept.  An
empty table stays empty.  A column of the input named like a result is replaced by
it; all others pass through untouched.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_bytes, documents, small_batches, text_slices, trim
from .wordbpe import coder

DEFAULT_VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_vocabulary(spark: SparkSession, path: str | None = None):
    """The vocabulary file's bytes as a broadcast; its size is checked."""
    small_batches(spark)
    with open(path or vocabulary_path(), "rb") as f:
        return broadcast_bytes(spark, f.read(), most=32 << 20)


@functools.lru_cache(maxsize=2)
def _spec(data: bytes) -> str:
    return data.decode()


def _together(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def encode(df: DataFrame, text: str = "text", ids: str = "token_ids", vocabulary: str | None = None) -> DataFrame:
    """df with the ids of each text as an array of integers."""
    shared = shared_vocabulary(df.sparkSession, vocabulary)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def run(column: pa.Array) -> pa.Array:
        c = coder(_spec(shared.value))
        return _together([c.encode_column(part) for part in text_slices(column)], pa.list_(pa.int32()))

    return df.withColumn(ids, run(F.col(text).cast("string")))


def decode(df: DataFrame, ids: str = "token_ids", decoded: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """df with the text that the ids stand for; null ids are empty, ids outside the vocabulary are left out."""
    shared = shared_vocabulary(df.sparkSession, vocabulary)

    @F.arrow_udf(T.StringType())
    def run(column: pa.Array) -> pa.Array:
        return coder(_spec(shared.value)).decode_column(column)

    return df.withColumn(decoded, run(F.col(ids)))


def encode_and_decode(df: DataFrame, text: str = "text", ids: str = "token_ids", decoded: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """encode and decode in one pass; the text decoded is made from the ids alone."""
    shared = shared_vocabulary(df.sparkSession, vocabulary)
    small_batches(df.sparkSession, 1_000, 2 << 20)  # a batch comes back as ids and text, some times its size
    kind = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("text", T.StringType())])
    arrow = pa.struct([("ids", pa.list_(pa.int32())), ("text", pa.string())])

    @F.arrow_udf(kind)
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = coder(_spec(shared.value))
        for column in columns:
            out = []
            for part in text_slices(column):
                found = c.encode_column(part)
                out.append(pa.StructArray.from_arrays([found, c.decode_column(found)], ["ids", "text"]))
            yield _together(out, arrow)
        c.forget()
        trim()

    both = df.withColumn("__coded", run(F.col(text).cast("string")))
    return both.withColumns({ids: F.col("__coded.ids"), decoded: F.col("__coded.text")}).drop("__coded")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text of documents."""
    coded = encode_and_decode(documents(spark, sf_dir).select("doc_id", "text"))
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("token_ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
