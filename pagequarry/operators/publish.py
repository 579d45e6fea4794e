"""Publishing state: manifest, changed pages, sitemap shards, notification batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARD_URLS, BATCH_URLS, TOMBSTONE_DAYS = 45_000, 10_000, 30


def merge_manifest(manifest: DataFrame, current: DataFrame, today: str) -> DataFrame:
    """key, hash, lastmod, notified, missing_since, state.

    manifest: key, hash, lastmod, notified, missing_since.  current: key, hash.
    lastmod moves only with the hash; pages that are gone stay as tombstones for 30 days.
    """
    old = manifest.select("key", F.col("hash").alias("old_hash"), "lastmod", "notified", "missing_since")
    df = old.join(current.select("key", F.col("hash").alias("new_hash")), "key", "full_outer")
    day = F.to_date(F.lit(today))
    gone = F.col("new_hash").isNull()
    state = F.when(gone & (F.datediff(day, F.coalesce("missing_since", day)) >= TOMBSTONE_DAYS), "dropped").when(gone, "missing").when(F.col("old_hash").isNull(), "new").when(F.col("old_hash") != F.col("new_hash"), "changed").otherwise("same")
    df = df.withColumn("state", state)
    return df.select(
        "key",
        F.coalesce("new_hash", "old_hash").alias("hash"),
        F.when(F.col("state").isin("new", "changed"), day).otherwise(F.col("lastmod")).alias("lastmod"),
        "notified",
        F.when(gone, F.coalesce("missing_since", day)).alias("missing_since"),
        "state",
    )


def to_notify(merged: DataFrame) -> DataFrame:
    """Keys whose text isn't the one last notified."""
    return merged.filter("state <> 'dropped' and (notified is null or notified <> hash)").select("key", "state")


def numbered(df: DataFrame, order: str) -> DataFrame:
    """df with n from 0 in the order of a column, without one task for all rows: rows are dealt by ranges, counted by partition, and numbered within."""
    from .graph import settled

    dealt = settled(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__p", F.spark_partition_id()))
    counts = dealt.groupBy("__p").agg(F.count(F.lit(1)).alias("c"), F.min(order).alias("first")).orderBy("first", "__p").collect()  # one row a partition
    base, bases = 0, []
    for r in counts:
        bases.append((r["__p"], base))
        base += r.c
    known = df.sparkSession.createDataFrame(bases, "__p int, __base long")
    within = Window.partitionBy("__p").orderBy(order)
    return dealt.withColumn("n", F.row_number().over(within).cast("long") - 1).join(F.broadcast(known), "__p").withColumn("n", F.col("n") + F.col("__base")).drop("__p", "__base")


def shards(pages: DataFrame, url: str = "url", lastmod: str = "lastmod", size: int = SHARD_URLS) -> DataFrame:
    """url, lastmod, shard: addresses in order, `size` in a shard."""
    return numbered(pages.select(F.col(url).alias("url"), F.col(lastmod).alias("lastmod")), "url").select("url", "lastmod", F.floor(F.col("n") / size).cast("long").alias("shard"))


def shard_summary(sharded: DataFrame) -> DataFrame:
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).cast("long").alias("urls"), F.max("lastmod").alias("newest"))


def sitemap_xml(sharded: DataFrame) -> DataFrame:
    """shard, xml: a shard's entries are 45,000 at most."""
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    entry = F.concat(F.lit("<url><loc>"), safe, F.lit("</loc>"), F.when(F.col("lastmod").isNotNull(), F.concat(F.lit("<lastmod>"), F.col("lastmod").cast("string"), F.lit("</lastmod>"))).otherwise(F.lit("")), F.lit("</url>"))
    head, tail = '<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">', "</urlset>"
    return sharded.withColumn("e", entry).groupBy("shard").agg(F.concat(F.lit(head), F.array_join(F.sort_array(F.collect_list("e")), ""), F.lit(tail)).alias("xml"))


def batches(changed: DataFrame, key: str = "key", size: int = BATCH_URLS) -> DataFrame:
    """batch, urls: arrays of 10,000 at most for one request each."""
    return numbered(changed.select(key), key).groupBy(F.floor(F.col("n") / size).cast("long").alias("batch")).agg(F.sort_array(F.collect_list(key)).alias("urls"))
