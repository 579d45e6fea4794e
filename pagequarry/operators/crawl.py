"""Crawler logs: totals of bots, coverage of pages, addresses that prove who asks."""

from __future__ import annotations

import ipaddress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def totals(events: DataFrame) -> DataFrame:
    """Per bot: hits, good and bad answers, distinct addresses, readings of robots.txt."""
    ok = F.col("status").between(200, 399)
    return events.groupBy("bot").agg(
        F.count(F.lit(1)).cast("long").alias("hits"),
        F.count_if(ok).cast("long").alias("ok"),
        F.count_if(~ok).cast("long").alias("errors"),
        F.countDistinct("ip").cast("long").alias("addresses"),
        F.count_if(F.col("target").startswith("/robots.txt")).cast("long").alias("robots_hits"),
    )


def status_histogram(events: DataFrame) -> DataFrame:
    """bot, statuses: a map from status to hits."""
    each = events.groupBy("bot", "status").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("bot").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("statuses"))  # statuses are few


def coverage(pages: DataFrame, events: DataFrame) -> DataFrame:
    """Per bot: publishable pages, how many it fetched well, how many it never asked for."""
    open_keys = pages.filter("indexable").select("key").distinct()
    total = open_keys.agg(F.count(F.lit(1)).alias("publishable"))
    got = events.filter(F.col("status").between(200, 399)).select("bot", "key").distinct().join(open_keys, "key", "left_semi").groupBy("bot").agg(F.count(F.lit(1)).alias("fetched"))
    bots = events.select("bot").distinct()
    df = bots.join(got, "bot", "left").crossJoin(F.broadcast(total))
    return df.select("bot", "publishable", F.coalesce("fetched", F.lit(0)).alias("fetched"), (F.col("publishable") - F.coalesce("fetched", F.lit(0))).alias("unseen"))


@F.arrow_udf(T.StringType())
def ip_hex(ips: pa.Array) -> pa.Array:
    """An address as 32 hexadecimal digits, IPv4 mapped into IPv6; null for what is none."""
    return pa.array([_hex(x) for x in ips.to_pylist()], pa.string())


def _hex(ip: str | None) -> str | None:
    try:
        found = ipaddress.ip_address((ip or "").strip())
    except ValueError:
        return None
    return f"{int(found) + (0xFFFF << 32 if found.version == 4 else 0):032x}"


def ranges(spark: SparkSession, cidrs: list[tuple[str, str]]) -> DataFrame:
    """bot, low, high, block of networks, IPv4 and IPv6; published lists have some hundred rows.  block: the first 16 bits of the network's own kind, one row for each that it touches."""
    rows = []
    for bot, cidr in cidrs:
        net = ipaddress.ip_network(cidr, strict=False)
        low, high = _hex(str(net.network_address)), _hex(str(net.broadcast_address))
        at = 24 if net.version == 4 else 0
        first, last = int(low[at : at + 4], 16), int(high[at : at + 4], 16)
        rows += [(bot, low, high, f"{low[:at]}{block:04x}") for block in range(first, last + 1)]
    return spark.createDataFrame(rows, "bot string, low string, high string, block string")


def verify(events: DataFrame, networks: DataFrame) -> DataFrame:
    """bot, ip, verified.  The range join is an equi-join on the bot and the address's block (networks of `ranges`), then an exact test."""
    seen = events.select("bot", "ip").distinct().withColumn("n", ip_hex("ip"))
    seen = seen.withColumn("block", F.when(F.col("n").startswith("0" * 20 + "ffff"), F.substring("n", 1, 28)).otherwise(F.substring("n", 1, 4)))
    hit = seen.join(networks, ["bot", "block"]).filter(F.col("n").between(F.col("low"), F.col("high"))).select("bot", "ip").distinct().withColumn("verified", F.lit(True))
    return seen.join(hit, ["bot", "ip"], "left").select("bot", "ip", F.coalesce("verified", F.lit(False)).alias("verified"))
