"""Access logs and events as streams: windows per key with a watermark, keyed publishing state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.publish import merge_manifest
from ..sources.files import parse_log


def daily(df: DataFrame, ts: str, key: str, length: str = "1 day", slide: str | None = None) -> DataFrame:
    """window_start, key, n; the same expression for batch and stream."""
    w = F.window(F.col(ts).cast("timestamp"), length, slide) if slide else F.window(F.col(ts).cast("timestamp"), length)
    return df.groupBy(w.alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def sessions(df: DataFrame, ts: str, key: str, gap: str = "30 minutes") -> DataFrame:
    """key, session_start, n."""
    w = F.session_window(F.col(ts).cast("timestamp"), gap)
    return df.groupBy(w.alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("session_start"), "n")


def bot_windows(spark: SparkSession, folder: str, site: str = "", late: str = "2 days") -> DataFrame:
    """A stream of access-log files: hits and errors of each bot by day; events later than `late` are dropped by the watermark."""
    events = parse_log(spark.readStream.text(folder), site).withWatermark("ts", late)
    bad = ~F.col("status").between(200, 399)
    return events.groupBy(F.window("ts", "1 day").alias("w"), "bot").agg(F.count(F.lit(1)).alias("hits"), F.sum(bad.cast("long")).alias("errors")).select(F.col("w.start").alias("day"), "bot", "hits", "errors")


def event_windows(spark: SparkSession, path: str, schema, ts: str, key: str, late: str = "1 day") -> DataFrame:
    """A stream of event files (Parquet) counted by day and key."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path)
    return daily(stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late), ts, key)


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """What a stream gives once all files that are there are read."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def manifest_sink(state_path: str, today: Column | str, keep: int = 3):
    """A foreachBatch function that merges pages (key, hash) into the publishing state.

    Each batch makes a new generation of files from the newest finished one, whatever
    checkpoint it comes from; a batch that is run again finds its pages unchanged and
    changes nothing.  Dropped tombstones leave the state, so a page that comes back
    after them is new.  The last `keep` generations stay.
    """
    schema = "key string, hash string, lastmod date, notified string, missing_since date"

    def merge(batch: DataFrame, _epoch: int) -> None:
        spark = batch.sparkSession
        have = sorted(_generations(spark, state_path))
        old = spark.read.schema(schema).parquet(f"{state_path}/{have[-1]}") if have else spark.createDataFrame([], schema)
        merged = merge_manifest(old, batch.dropDuplicates(["key"]), today).filter("state <> 'dropped'").drop("state")
        merged.write.mode("overwrite").parquet(f"{state_path}/{have[-1] + 1 if have else 0}")
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(state_path)
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for g in have[: 1 - keep] if keep > 1 else have:
            fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{state_path}/{g}"), True)

    return merge


def _generations(spark: SparkSession, state_path: str) -> list[int]:
    """Numbers of the finished generations."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(state_path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [s.getPath() for s in fs.listStatus(folder)]
    return [int(p.getName()) for p in names if p.getName().isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
