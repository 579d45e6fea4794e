"""Benchmark decontamination: which test items stand inside which documents.

Size-partitioned MinHash containment search.  Items are put in partitions by the
size of their shingle sets.  An item's sketch is its k least hashes, with k, the
same for a partition, more than a quarter of its largest set.  A document that holds
at least three quarters of an item lacks at most a quarter of its shingles, so it
holds at least k less that quarter of the sketch, that is one or more: no leak is
missed, however long the document.  Documents are probed shingle by shingle against
the sketches; what has enough sketch hits is verified by exact containment.

Documents are read once and aren't shuffled.  Items are broadcast in blocks of a
checked size; more items than fit in one block take more passes over the documents.

Defined results: null or empty texts hold nothing, and empty items stand nowhere.
Of fewer than five words the whole is one shingle.  Items with a null id count in
leak_count and are left out of find_leaks, whose rows name them; repeated documents
and items give a row each.  A very long text is one set, read whole.  Empty tables
give no rows.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, small_batches
from .shingles import shingle_sets

THRESHOLD_PERCENT = 75
#: Shingles of items in a block that is broadcast: 4 million of 8 bytes.
BLOCK_SHINGLES = 4_000_000


class SketchIndex:
    """Items of one block: shingle sets, and the sketches of each size partition."""

    def __init__(self, ids: list, sets: list[np.ndarray], percent: int):
        self.ids, self.sets = ids, sets
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        self.need = -(-percent * sizes // 100)  # shared shingles that make a leak
        spare = sizes - self.need
        partition = np.ceil(2 * np.log2(np.maximum(sizes, 1))).astype(int)
        keys, owners = [], []
        self.least = np.zeros(len(ids), dtype=np.int64)  # sketch hits that a leak has at least
        for p in np.unique(partition):
            members = np.flatnonzero(partition == p)
            k = int(spare[members].max()) + 1
            for i in members:
                sketch = sets[i][:k]  # sets are sorted, and their hashes random
                self.least[i] = len(sketch) - spare[i]
                keys.append(sketch)
                owners.append(np.full(len(sketch), i))
        flat = np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64)
        order = np.argsort(flat, kind="stable")
        self.keys, first = np.unique(flat[order], return_index=True)
        self.owners = (np.concatenate(owners) if owners else np.zeros(0, dtype=np.int64))[order]
        self.first = np.append(first, len(flat))
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[self._cell(self.keys)] = True

    @staticmethod
    def _cell(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(44)).astype(np.int64)

    def leaks(self, found: np.ndarray) -> list[tuple[int, int]]:
        """(item, shared shingles) of a document's sorted shingle set."""
        if not len(self.keys):
            return []
        maybe = found[self.seen[self._cell(found)]]
        at = np.searchsorted(self.keys, maybe)
        at = at[(at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == maybe)]
        if not len(at):
            return []
        hits = np.concatenate([self.owners[self.first[k] : self.first[k + 1]] for k in at])
        items, counts = np.unique(hits, return_counts=True)
        out = []
        for i in items[counts >= self.least[items]]:
            own = self.sets[i]
            where = np.searchsorted(found, own)
            shared = int((found[np.minimum(where, len(found) - 1)] == own).sum())
            if shared >= self.need[i]:
                out.append((int(i), shared))
        return out


def _sets(items: DataFrame, item_id: str, text: str, named: bool) -> DataFrame:
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def run(column: pa.Array) -> pa.Array:
        return pa.array([s.view(np.int64) for s in shingle_sets(column)], pa.list_(pa.int64()))

    rows = (items.filter(F.col(item_id).isNotNull()) if named else items).select(F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("text"))
    return rows.select("item_id", run("text").alias("set")).filter(F.size("set") > 0)


def _blocks(items: DataFrame, percent: int, block_shingles: int, named: bool = True):
    """Indexes of the items, each in a broadcast of a checked size, with the Arrow type of the ids."""
    spark = items.sparkSession
    small_batches(spark)
    sets = _sets(items, "item_id", "text", named)
    total = sets.agg(F.sum(F.size("set").cast("long")).alias("n")).first().n or 0
    blocks = int(2 * total // block_shingles) + 1
    sets = sets.withColumn("block", F.pmod(F.xxhash64("item_id", "set"), F.lit(blocks)))
    for b in range(blocks):
        rows = sets.filter(F.col("block") == b).select("item_id", "set").toArrow()
        order = np.argsort(np.array([str(x) for x in rows["item_id"].to_pylist()])) if rows.num_rows else []
        ids, values = rows["item_id"].to_pylist(), rows["set"].to_pylist()
        index = SketchIndex([ids[i] for i in order], [np.array(values[i], dtype=np.int64).view(np.uint64) for i in order], percent)
        if sum(map(len, index.sets)) > 4 * block_shingles:
            raise ValueError("a block of items is larger than may be broadcast")
        yield spark.sparkContext.broadcast(index), rows.schema.field("item_id").type


def leak_count(text: str, items: DataFrame, percent: int = THRESHOLD_PERCENT, block_shingles: int = BLOCK_SHINGLES) -> Column:
    """How many items stand in a text, as a column."""

    def counter(shared):
        @F.arrow_udf(T.LongType())
        def count(column: pa.Array) -> pa.Array:
            return pa.array([len(shared.value.leaks(found)) for found in shingle_sets(column)], pa.int64())

        return count

    out = F.lit(0).cast("long")
    for shared, _ in _blocks(items, percent, block_shingles, named=False):
        out = out + counter(shared)(F.col(text).cast("string"))
    return out


def find_leaks(docs: DataFrame, items: DataFrame, percent: int = THRESHOLD_PERCENT, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """docs: doc_id, text.  items: item_id, text.  -> doc_id, item_id, shared, item_shingles of each leak."""
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("item_id", items.schema["item_id"].dataType),
            T.StructField("shared", T.LongType()),
            T.StructField("item_shingles", T.LongType()),
        ]
    )
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = None
    for shared, id_type in _blocks(items, percent, block_shingles):

        def search(batches: Iterator[pa.RecordBatch], shared=shared, id_type=id_type) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                docs_at, found_items, counts = [], [], []
                for row, found in enumerate(shingle_sets(batch.column(1))):
                    for item, n in index.leaks(found):
                        docs_at.append(row)
                        found_items.append(item)
                        counts.append(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(docs_at, pa.int64())),
                        pa.array([index.ids[i] for i in found_items], id_type),
                        pa.array(counts, pa.int64()),
                        pa.array([len(index.sets[i]) for i in found_items], pa.int64()),
                    ],
                    ["doc_id", "item_id", "shared", "item_shingles"],
                )

        part = narrow.mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    return out


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, shared, item_shingles: every document that holds three quarters or more of an item of benchmark."""
    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: DuckDB: distinct five-word shingles of a table's texts.
SHINGLES_SQL = """
  SELECT DISTINCT {id}, unnest(CASE
    WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END) AS shingle
  FROM (SELECT {id}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM {table})
"""

ORACLE_SQL = f"""
WITH d AS ({SHINGLES_SQL.format(id="doc_id", table="documents")}),
b AS ({SHINGLES_SQL.format(id="item_id", table="benchmark")}),
n AS (SELECT item_id, count(*) AS item_shingles FROM b GROUP BY item_id)
SELECT doc_id, b.item_id, count(*) AS shared, any_value(item_shingles) AS item_shingles
FROM d JOIN b USING (shingle) JOIN n ON n.item_id = b.item_id
GROUP BY doc_id, b.item_id HAVING 100 * count(*) >= 75 * any_value(item_shingles)
"""
