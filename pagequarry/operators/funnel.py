"""From generated to indexed: steps, losses, engines, sections, near-page-one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import cell_number
from ..functions.url import prefixes, key_column


def steps(generated: DataFrame, publishable: DataFrame, listed: DataFrame | None = None, indexed: DataFrame | None = None, cited: DataFrame | None = None) -> DataFrame:
    """step_no, step, n, lost: keys that reach each step, given those before it.  One pass: sets are flags of a union, grouped by key."""
    sets = [("generated", generated), ("publishable", publishable), ("listed", listed), ("indexed", indexed), ("cited", cited)]
    used = [(n, s) for n, s in sets if s is not None]
    union = None
    for i, (_, s) in enumerate(used):
        part = s.select("key").distinct().select("key", F.lit(1 << i).alias("bit"))
        union = part if union is None else union.union(part)
    flags = union.groupBy("key").agg(F.sum("bit").alias("bits"))
    masks = [(1 << (i + 1)) - 1 for i in range(len(used))]
    counts = flags.agg(*[F.count_if(F.col("bits").bitwiseAND(m) == m).cast("long").alias(f"n{i}") for i, m in enumerate(masks)])
    rows = F.array(*[F.struct(F.lit(i).alias("step_no"), F.lit(n).alias("step"), F.col(f"n{i}").alias("n"), (F.col(f"n{max(i - 1, 0)}") - F.col(f"n{i}")).alias("lost")) for i, (n, _) in enumerate(used)])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def foreign(indexed: DataFrame, generated: DataFrame, host: str) -> DataFrame:
    """key, why: what engines know and the build hasn't: other-host, file, missing."""
    lost = indexed.select("key").distinct().join(generated.select("key"), "key", "left_anti")
    own = F.regexp_extract("key", "^//([^/]*)", 1) == host
    return lost.select("key", F.when(~own, "other-host").when(F.col("key").rlike(r"\.[a-z0-9]{2,5}$"), "file").otherwise("missing").alias("why"))


def causes(lost: DataFrame, findings: DataFrame, most: int = 50) -> DataFrame:
    """cause, pages, sample: codes that lost pages carry (a page may have several), the rest under `other`."""
    codes = findings.filter(F.col("code").isin("orphan", "unreachable", "near-duplicate", "thin", "deep", "no-title")).select("url", "code").distinct()
    df = lost.join(codes, "url", "left").select("url", F.coalesce("code", F.lit("other")).alias("cause"))
    w = Window.partitionBy("cause").orderBy("url")
    return df.withColumn("k", F.row_number().over(w)).groupBy("cause").agg(F.count(F.lit(1)).alias("pages"), F.sort_array(F.collect_list(F.when(F.col("k") <= most, F.col("url")))).alias("sample"))


def engine_buckets(seen: DataFrame, keys: DataFrame) -> DataFrame:
    """bucket, n: of keys, how many each set of engines (engine, key) knows: everywhere, only missing from one, in some, nowhere."""
    engines = seen.select("engine").distinct()
    total = engines.agg(F.count(F.lit(1)).alias("total"), F.array_sort(F.collect_set("engine")).alias("all"))  # engines are few
    per = seen.select("engine", "key").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.collect_set("engine").alias("has"))
    df = keys.select("key").distinct().join(per, "key", "left").crossJoin(F.broadcast(total))
    lacks = F.array_join(F.array_except("all", "has"), ",")
    bucket = F.when(F.col("n").isNull(), "nowhere").when(F.col("n") == F.col("total"), "everywhere").when(F.col("n") == F.col("total") - 1, F.concat(F.lit("missing:"), lacks)).otherwise("partly")
    return df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).cast("long").alias("n"))


def path_rollup(pages: DataFrame, key: str = "key", most: int = 3) -> DataFrame:
    """prefix, depth, pages of every folder up to a depth: ancestors are exploded in the row, then counted."""
    return pages.select(F.explode(prefixes(F.col(key))).alias("p")).select("p.*").filter(F.col("depth") <= most).groupBy("prefix", "depth").agg(F.count(F.lit(1)).cast("long").alias("pages"))


def section_gaps(pages: DataFrame, reached: DataFrame, key: str = "key", depth: int = 1, base: str = "") -> DataFrame:
    """segment, pages, reached, lost, highlight.  A section stands out with five pages or more, three lost, five pages elsewhere, and a loss rate half as high again as, and 20 points over, the rest's."""
    got = reached.select(key).distinct().withColumn("got", F.lit(1))
    rows = pages.select(key).distinct().join(got, key, "left").select(F.try_element_at(F.transform(F.filter(prefixes(F.col(key)), lambda p: p["depth"] == depth), lambda p: p["prefix"]), F.lit(1)).alias("segment"), "got")
    rows = rows.filter(F.col("segment").isNotNull() & F.col("segment").startswith(base))
    groups = rows.groupBy("segment").agg(F.count(F.lit(1)).cast("long").alias("pages"), F.count("got").cast("long").alias("reached"))
    groups = groups.withColumn("lost", F.col("pages") - F.col("reached"))
    total = groups.agg(F.sum("pages").alias("all_pages"), F.sum("lost").alias("all_lost"))
    df = groups.crossJoin(F.broadcast(total))  # one row
    others = F.col("all_pages") - F.col("pages")
    mine, rest = F.col("lost") / F.col("pages"), (F.col("all_lost") - F.col("lost")) / others
    high = (F.col("pages") >= 5) & (F.col("lost") >= 3) & (others >= 5) & (mine >= F.greatest(1.5 * rest, rest + 0.2))
    return df.select("segment", "pages", "reached", "lost", F.coalesce(high, F.lit(False)).alias("highlight"))


def section_base(pages: DataFrame, share: float = 0.8, most: int = 6) -> str:
    """The folder to start from: go down while one child holds `share` of the pages.  The loop runs on the counts of folders, not on pages."""
    from .graph import settled

    counts = settled(path_rollup(pages, most=most).filter("pages > 1"))
    base, size = "", pages.count()
    for depth in range(1, most + 1):
        best = counts.filter((F.col("depth") == depth) & F.col("prefix").startswith(base + "/")).orderBy(F.desc("pages"), "prefix").first()
        if best is None or best.pages < share * size:
            break
        base, size = best.prefix, best.pages
    return base


def near_page_one(rows: DataFrame, least: int = 50, low: float = 8.0, high: float = 20.0) -> DataFrame:
    """engine, key, impressions, position: positions weighted by impressions from 8 to 20, with 50 impressions or more."""
    good = rows.filter("impressions > 0")
    per = good.groupBy("engine", "key").agg(F.sum("impressions").alias("impressions"), F.sum(F.col("impressions") * F.col("position")).alias("w"))
    df = per.withColumn("position", F.col("w") / F.col("impressions"))
    return df.filter((F.col("impressions") >= least) & F.col("position").between(low, high)).select("engine", "key", "impressions", "position")


def column_by_content(df: DataFrame, rows: int = 50) -> str:
    """The column with most addresses among the first rows of an export; a header that says so breaks ties."""
    sample = df.limit(rows).collect()
    score = lambda c: (sum(str(r[c] or "").startswith(("http://", "https://", "/")) for r in sample), c.lower() in ("url", "page", "address", "top pages", "landing page"))
    return max(df.columns, key=score)


def read_export(table: DataFrame, source: str, site: str) -> DataFrame:
    """source, key, clicks, impressions, position, status of an export as strings."""
    url = column_by_content(table)
    pick = lambda *names: next((c for c in table.columns if any(n in c.lower() for n in names)), None)
    number = lambda c: cell_number(F.col(f"`{c}`")) if c else F.lit(None).cast("double")
    status = pick("status", "coverage", "state")
    address = F.when(F.col(f"`{url}`").startswith("/"), F.concat(F.lit(site.rstrip("/")), f"`{url}`")).otherwise(F.col(f"`{url}`"))
    return table.select(
        F.lit(source).alias("source"),
        key_column(address).alias("key"),
        number(pick("click")).alias("clicks"),
        number(pick("impression")).alias("impressions"),
        number(pick("position")).alias("position"),
        (F.col(f"`{status}`") if status else F.lit(None).cast("string")).alias("status"),
    ).filter("key <> ''")


def is_indexed_status(status: Column) -> Column:
    """Whether a status of an export means indexed: refusals are read before agreements."""
    low = F.lower(F.coalesce(status, F.lit("")))
    return F.when(low.rlike(r"not indexed|excluded|noindex|blocked|error|redirect|duplicate|discovered|crawled - currently|soft 404|не проиндексир|исключен"), False).when(low.rlike("indexed|valid|submitted|проиндексир|в поиске"), True)


def compare_runs(current: DataFrame, previous: DataFrame) -> DataFrame:
    """key, change: newly-lost or recovered between two runs' sets of lost keys."""
    gone = current.select("key").distinct().join(previous.select("key"), "key", "left_anti").select("key", F.lit("newly-lost").alias("change"))
    back = previous.select("key").distinct().join(current.select("key"), "key", "left_anti").select("key", F.lit("recovered").alias("change"))
    return gone.union(back)
