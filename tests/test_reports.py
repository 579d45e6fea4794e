"""Crawler logs, exports, run comparisons and reports on rows written out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pagequarry.functions.register import register_udfs
from pagequarry.operators import compare, content, crawl, funnel, graph, keywords, machine, publish
from pagequarry.sources import files


def rows(df):
    return {tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.collect()}


def test_bots_are_verified_by_both_kinds_of_address(spark):
    events = spark.createDataFrame([("g", "66.249.64.9"), ("g", "66.249.80.1"), ("g", "2001:4860:4801:10::1"), ("g", "2001:4861::1"), ("b", "66.249.64.9"), ("g", "no address")], "bot string, ip string")
    networks = crawl.ranges(spark, [("g", "66.249.64.0/20"), ("g", "2001:4860:4801::/48"), ("b", "10.0.0.0/8")])
    assert rows(crawl.verify(events, networks).filter("verified")) == {("g", "66.249.64.9", True), ("g", "2001:4860:4801:10::1", True)}


def test_log_reports(spark):
    events = spark.createDataFrame([("g", 200, "//e/a"), ("g", 404, "//e/b"), ("g", 200, "//e/a"), ("x", 500, "//e/a")], "bot string, status int, key string")
    pages = spark.createDataFrame([("//e/a", True), ("//e/b", True), ("//e/c", False)], "key string, indexable boolean")
    assert {(r.bot, r.publishable, r.fetched, r.unseen) for r in crawl.coverage(pages, events).collect()} == {("g", 2, 1, 1), ("x", 2, 0, 2)}
    assert {r.bot: r.statuses for r in crawl.status_histogram(events).collect()} == {"g": {200: 2, 404: 1}, "x": {500: 1}}


def test_exports_statuses_and_runs(spark):
    table = spark.createDataFrame([("/a/", "1.234", "3,5", "Crawled - currently not indexed"), ("https://www.e.com/%D0%BE", "7", "12", "Submitted and indexed"), ("", "1", "1", "")], "`Top pages` string, Clicks string, `Avg position` string, Coverage string")
    got = funnel.read_export(table, "g", "https://e.com").withColumn("known", funnel.is_indexed_status(F.col("status"))).collect()
    assert {(r.key, r.position, r.known) for r in got} == {("//e.com/a", 3.5, False), ("//e.com/о", 12.0, True)}
    a, b = spark.createDataFrame([("x",), ("y",)], "key string"), spark.createDataFrame([("y",), ("z",)], "key string")
    assert rows(funnel.compare_runs(a, b)) == {("x", "newly-lost"), ("z", "recovered")}
    known = spark.createDataFrame([("//e.com/a",), ("//o.com/b",), ("//e.com/c.pdf",), ("//e.com/d",)], "key string")
    assert rows(funnel.foreign(known, spark.createDataFrame([("//e.com/a",)], "key string"), "e.com")) == {("//o.com/b", "other-host"), ("//e.com/c.pdf", "file"), ("//e.com/d", "missing")}
    lost = spark.createDataFrame([("u1",), ("u2",)], "url string")
    found = spark.createDataFrame([("u1", "orphan"), ("u1", "thin"), ("u1", "no-og")], "url string, code string")
    assert {(r.cause, r.pages) for r in funnel.causes(lost, found).collect()} == {("orphan", 1), ("thin", 1), ("other", 1)}


def test_ignore_orders_and_unique_codes(spark):
    found = spark.createDataFrame([("/a/x", "thin", "p1"), ("/b", "thin", "p1"), ("/b", "no-og", "p2"), ("/c", "thin", "p2")], "url string, code string, project string")
    told = compare.apply_ignore(found, {"thin": ["/a/*"], "*": ["/c"]}, F.col("url"))
    assert {r.url for r in told.filter("accepted").collect()} == {"/a/x", "/c"}
    with pytest.raises(ValueError, match="unknown codes: thinn"):
        compare.apply_ignore(found, {"thinn": ["*"]}, F.col("url"))
    assert rows(compare.unique_findings(found)) == {("p2", "no-og")}
    pages = spark.createDataFrame([("https://e.com/t/1", "//e.com/t/1"), ("https://e.com/t/2", "//e.com/t/2"), ("https://e.com/s", "//e.com/s")], "url string, key string")
    findings = spark.createDataFrame([("https://e.com/t/1", "thin"), ("https://e.com/t/2", "thin"), ("https://e.com/s", "no-h1"), ("", "no-robots")], "url string, code string")
    notes = spark.createDataFrame([("pattern", "/t/*", "thin", 2)], "scope string, value string, code string, pages long")
    assert {(r.scope, r.name, r.pages) for r in compare.work_orders(findings, notes, pages).collect()} == {("template", "/t/*", 2), ("page", "https://e.com/s", 1), ("site", "site", 1)}


def test_citations(spark):
    answers = spark.createDataFrame([("q", "a", 1, False, ["https://www.e.com/x", "https://r.org/1"]), ("q", "a", 2, False, ["https://r.org/2", "https://s.org"]), ("q", "a", 3, True, None)], "prompt string, provider string, run int, failed boolean, urls array<string>")
    (r,) = compare.citation_rates(answers, "e.com").collect()
    assert (r.runs, r.failed, r.cited, r.top_competitors) == (3, 1, 1, ["r.org", "s.org"])


def test_rules_of_hosts_sitemaps_and_tasks(spark):
    pages = spark.createDataFrame([("//a/x/1",), ("//b/x/1",)], "key string")
    rules = spark.createDataFrame([("a", "disallow", "/x", 2, "^/x"), ("b", "disallow", "/x", 2, "^/x"), ("b", "allow", "/x/1", 4, "^/x/1")], "host string, verb string, rule string, long int, regex string")
    assert rows(machine.blocked_by_host(pages, rules)) == {("//a/x/1", "a", "/x")}
    (shard,) = publish.sitemap_xml(spark.createDataFrame([("https://e.com/a?b&c", None, 0)], "url string, lastmod date, shard long")).collect()
    assert files.sitemap_entries(shard.xml.encode())[0] == [("https://e.com/a?b&c", "", [])]
    data = spark.createDataFrame([(1, "buy a red car"), (2, "how cars work"), (3, "")], "id long, kw string")
    assert {(r.id, r.path, r.intent) for r in keywords.tasks(data, "kw", "id").collect()} == {(1, "buy-a-red-car/index.md", "transactional"), (2, "how-cars-work/index.md", "informational")}
    matched = spark.createDataFrame([(1,)], "id long")
    assert {r.id for r in content.rows_without_page(data, matched, "id").collect()} == {2, 3}
    assert pages.select(graph.ancestors(F.lit("//h/a/b/c")).alias("x")).first().x == ["//h/a", "//h/a/b"]


def test_functions_in_sql(spark):
    register_udfs(spark)
    row = spark.sql("SELECT url_key('https://www.e.com/%D0%BE/') AS k, slugify('Кот дома') AS s, norm_number('1 500') AS n, fisher_p(3L, 4L, 1L, 4L) AS p").first()
    assert (row.k, row.s, row.n) == ("//e.com/о", "kot-doma", "1500") and row.p == pytest.approx(34 / 70)
