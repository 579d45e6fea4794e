"""What the hosting does to pages: headers that close them, and the forms of addresses it serves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.url import key_column, path_of
from ..model import finding
from .graph import few

def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def header_hits(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """url, directive, source, pattern: the first rule of X-Robots-Tag (files.header_table) that closes each page; a source that takes the header off again doesn't count for that page."""
    hit = pages.select("url", _path(F.col("url")).alias("path")).join(few(rules), F.regexp_like("path", F.col("regex")))
    by_source = hit.groupBy("url", "directive", "source").agg(F.min(F.when(F.col("closes"), F.struct("line", "pattern"))).alias("m"), F.max(~F.col("closes")).alias("reopened"))
    return by_source.filter("m is not null and not reopened").groupBy("url", "directive").agg(F.min(F.struct("m.line", "source", "m.pattern")).alias("m")).select("url", "directive", "m.source", "m.pattern")


def apply_header_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Parsed pages with the directives of headers added to `robots`."""
    said = header_hits(pages, rules).groupBy("url").agg(F.array_join(F.sort_array(F.collect_set("directive")), ",").alias("__said"))
    robots = F.concat_ws(",", F.when(F.col("robots") != "", F.col("robots")), "__said")
    return pages.join(said, "url", "left").withColumn("robots", F.when(F.col("__said").isNotNull(), robots).otherwise(F.col("robots"))).drop("__said")


def header_counts(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """source, pattern, directive, pages: how many pages each rule closes."""
    return header_hits(pages, rules).groupBy("source", "pattern", "directive").agg(F.count(F.lit(1)).alias("pages"))


#: The forms of an address, in the order of preference, and those that any static hosting serves.
FORMS = {"file": 0, "bare": 1, "slash": 2, "index": 3}
STATIC = ["file", "bare"]


def form(url: Column) -> Column:
    """file (ends with .html), index (ends with an index file), slash or bare."""
    path = _path(url)
    return F.when(path.rlike(r"(?i)(^|/)index\.html?$"), "index").when(path.rlike(r"(?i)\.html?$"), "file").when(path.endswith("/"), "slash").otherwise("bare")


def page_kinds(pages: DataFrame) -> DataFrame:
    """key, kind: folder (built as index.html) or flat; null where both are there, or the page isn't HTML."""
    name = F.lower(F.regexp_extract("path", "([^/]*)$", 1))
    kind = F.when(name.rlike(r"\.html?$"), F.when(name.startswith("index."), "folder").otherwise("flat"))
    return pages.groupBy("key").agg(F.when((F.count(F.lit(1)) == F.count(kind)) & (F.min(kind) == F.max(kind)), F.min(kind)).alias("kind"))


def link_forms(pages: DataFrame) -> DataFrame:
    """src, url, target, form of each link."""
    links = pages.select(F.col("key").alias("src"), "url", F.explode("links").alias("href"))
    return links.select("src", "url", key_column(F.col("href")).alias("target"), form(F.col("href")).alias("form"))


def settle_flat_urls(pages: DataFrame, site: str, rewrites: bool = False) -> DataFrame:
    """Pages with the address of each flat file in the form most links have; without links the file's own.  Forms that a static hosting doesn't serve have no vote, unless it rewrites addresses."""
    votes = link_forms(pages).filter(F.lit(rewrites) | F.col("form").isin(STATIC)).groupBy("target", "form").agg(F.count(F.lit(1)).alias("n"))
    order = F.create_map(*[F.lit(x) for kv in FORMS.items() for x in kv])[F.col("form")]
    best = votes.groupBy(F.col("target").alias("key")).agg(F.min_by("form", F.struct(-F.col("n"), order)).alias("__form"))
    flat = F.lower(F.regexp_extract("path", "([^/]*)$", 1)).rlike(r"^(?!index\.).*\.html?$")
    file_url = F.concat(F.lit(site.rstrip("/") + "/"), F.regexp_replace("path", "^/+", ""))
    chosen = F.coalesce("__form", F.lit("file"))
    url = F.when(~flat | chosen.isin("slash", "index"), F.col("url")).when(chosen == "bare", F.regexp_replace(file_url, r"(?i)\.html?$", "")).otherwise(file_url)
    return pages.join(best, "key", "left").withColumn("url", url).drop("__form")


def wrong_forms(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """wrong-link-form: links in a form that the hosting answers with 404 (a.html to a folder, a/ or a/index.html to a flat file), unless a redirect (regex) catches it."""
    linked = link_forms(pages).join(page_kinds(pages).withColumnRenamed("key", "target"), "target")
    tail = F.when((F.col("kind") == "folder") & (F.col("form") == "file"), ".html").when((F.col("kind") == "flat") & (F.col("form") == "slash"), "/").when((F.col("kind") == "flat") & (F.col("form") == "index"), "/index.html")
    wrong = linked.withColumn("tail", tail).filter("tail is not null").select("url", F.concat(F.regexp_replace(path_of(F.col("target")), "/+$", ""), "tail").alias("said")).distinct()
    if redirects is not None:
        wrong = wrong.join(few(redirects), F.regexp_like("said", F.col("regex")), "left_anti")
    return wrong.select(finding("warning", "wrong-link-form", F.concat("said", F.lit(" isn't served in this form")), subject=F.array("said")).alias("f")).select("f.*")


__all__ = ["apply_header_rules", "header_counts", "header_hits", "link_forms", "page_kinds", "settle_flat_urls", "wrong_forms"]
