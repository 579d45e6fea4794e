"""Builds, baselines, runs, citations and projects compared."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import fisher_p
from ..functions.url import url_pattern
from ..model import CODES, finding, union_all
from .graph import few

SHRUNK_WORDS, SHRUNK_SHARE, TEMPLATE_PAGES, TEMPLATE_SHARE = 50, 0.5, 5, 0.5


def full_changes(old: DataFrame, new: DataFrame, key: str, hash_: str, words: str) -> DataFrame:
    """key, change, old_words, new_words: removed, added, changed of a full outer join; equal rows are left out."""
    a = old.select(F.col(key), F.col(hash_).alias("ha"), F.col(words).cast("long").alias("old_words"))
    b = new.select(F.col(key), F.col(hash_).alias("hb"), F.col(words).cast("long").alias("new_words"))
    df = a.join(b, key, "full_outer")
    change = F.when(F.col("hb").isNull(), "removed").when(F.col("ha").isNull(), "added").when(F.col("ha") != F.col("hb"), "changed")
    return df.select(key, change.alias("change"), "old_words", "new_words").filter("change is not null")


def redirected(removed: DataFrame, rules: DataFrame) -> DataFrame:
    """key, rule_no, target of removed pages (key, path): the first rule that fits.  rules (rule_no, regex, target) are the lines of a hosting file."""
    hit = removed.join(few(rules), F.regexp_like("path", F.col("regex")))
    first = hit.groupBy("key", "path").agg(F.min(F.struct("rule_no", "regex", "target")).alias("m")).select("key", "path", "m.*")
    # :splat, :name and $1 stand for the rule's first group.
    filled = F.expr("case when target rlike '(:[A-Za-z*]+|[$]1)' and regex like '%(?<%' then regexp_replace(target, '(:[A-Za-z]+[*+]?|[$]1)', regexp_extract(path, regex, 1)) else target end")
    return first.select("key", "rule_no", filled.alias("target"))


def build_diff(old: DataFrame, new: DataFrame, moved: DataFrame | None = None) -> DataFrame:
    """Findings between two builds of flagged pages: page-removed, page-redirected, page-closed, page-opened, nosnippet-added, text-shrunk, template-change, pages-added."""
    cols = ["key", "url", "title", "description", "indexable", "noindex", "draft", "nosnippet", "volume"]
    a = old.select("key", *[F.col(c).alias(f"o_{c}") for c in cols[1:]])
    b = new.select("key", *[F.col(c).alias(f"n_{c}") for c in cols[1:]])
    removed = a.join(b, "key", "left_anti")
    if moved is not None:
        removed = removed.join(moved.select("key", "target"), "key", "left")
    else:
        removed = removed.withColumn("target", F.lit(None).cast("string"))
    gone = removed.filter("target is null").select(finding(F.when(F.col("o_indexable"), "critical").otherwise("info"), "page-removed", "gone without a redirect", url="o_url").alias("f"))
    went = removed.filter("target is not null").select(finding("info", "page-redirected", F.concat(F.lit("goes to "), "target"), url="o_url").alias("f"))
    both = a.join(b, "key")
    why = F.when(F.col("n_noindex"), "noindex").when(F.col("n_draft"), "draft").otherwise("canonical or other")
    closed = both.filter("o_indexable and not n_indexable").select(finding("critical", "page-closed", F.concat(F.lit("closed: "), why), url="n_url").alias("f"))
    opened = both.filter("not o_indexable and n_indexable").select(finding("info", "page-opened", "open now", url="n_url").alias("f"))
    snip = both.filter("not o_nosnippet and n_nosnippet").select(finding("warning", "nosnippet-added", "snippets are forbidden now", url="n_url").alias("f"))
    less = both.filter((F.col("o_volume") >= SHRUNK_WORDS) & (F.col("n_volume") < SHRUNK_SHARE * F.col("o_volume")))
    shrunk = less.select(finding("warning", "text-shrunk", F.concat(F.col("o_volume").cast("string"), F.lit(" -> "), F.col("n_volume").cast("string")), url="n_url").alias("f"))
    fields = F.array(*[F.struct(F.lit(c).alias("field"), (~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}"))).alias("differs")) for c in ("title", "description")])
    each = both.select(url_pattern(F.col("key")).alias("pattern"), F.explode(fields).alias("x")).select("pattern", "x.*")
    groups = each.groupBy("pattern", "field").agg(F.count(F.lit(1)).alias("n"), F.count_if("differs").alias("d")).filter("d > 0")
    wide = (F.col("d") >= TEMPLATE_PAGES) & (F.col("d") >= TEMPLATE_SHARE * F.col("n"))
    changed = groups.select(finding(F.when(wide, "warning").otherwise("info"), "template-change", F.concat("field", F.lit(" differs on "), F.col("d").cast("string"), F.lit(" of "), F.col("n").cast("string")), url="pattern").alias("f"))
    added = b.join(a, "key", "left_anti").agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(finding("info", "pages-added", F.col("n").cast("string"), url=F.lit("")).alias("f"))
    return union_all([gone, went, closed, opened, snip, shrunk, changed, added]).select("f.*")


def multiset_diff(now: DataFrame, before: DataFrame, columns: list[str]) -> DataFrame:
    """The columns, and how many rows of them are new, fixed and unchanged: equal rows differ by their number only, so counts decide, and no row of a hot key meets another."""
    count = lambda df, name: df.groupBy(*columns).agg(F.count(F.lit(1)).alias(name))
    a, b = count(now, "__a"), count(before, "__b").select(*[F.col(c).alias(f"__{c}") for c in columns], "__b")
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns])
    zero = F.lit(0).cast("long")
    x, y = F.coalesce("__a", zero), F.coalesce("__b", zero)
    own = [F.when(F.col("__a").isNotNull(), F.col(c)).otherwise(F.col(f"__{c}")).alias(c) for c in columns]
    return a.join(b, on, "full_outer").select(*own, F.greatest(x - y, zero).alias("new"), F.greatest(y - x, zero).alias("fixed"), F.least(x, y).alias("unchanged"))


def new_findings(now: DataFrame, before: DataFrame, said: DataFrame | None = None) -> DataFrame:
    """new-finding: critical findings (url, code, message) of a build that the one before didn't have; said: url of pages whose closing was told already, for which noindex and nosnippet aren't told again."""
    key = lambda df: df.filter("level = 'critical'").groupBy("url", "code").agg(F.count(F.lit(1)).alias("n"), F.min("message").alias("message"))
    fresh = key(now).join(key(before).select("url", "code", F.col("n").alias("had")), ["url", "code"], "left").filter("had is null or had < n")
    if said is not None:
        told = said.select("url").distinct().withColumn("code", F.explode(F.array(F.lit("noindex"), F.lit("nosnippet"))))
        fresh = fresh.join(told, ["url", "code"], "left_anti")
    return fresh.select(finding("critical", "new-finding", F.concat("code", F.lit(": "), "message")).alias("f")).select("f.*")


def baseline(now: DataFrame, before: DataFrame) -> DataFrame:
    """level, code, key, state, added: as multiset_diff; of unchanged rows with a subject that grew the new members are `added` and the state is new."""
    order = Window.partitionBy("level", "code", "key").orderBy(F.size(F.coalesce("subject", F.array().cast("array<string>"))), F.array_join(F.coalesce("subject", F.array().cast("array<string>")), ","))
    number = lambda df, s: df.select("level", "code", "key", F.col("subject").alias(s), F.row_number().over(order).alias("occurrence"), F.lit(True).alias(f"has_{s}"))
    df = number(now, "s_now").join(number(before, "s_before"), ["level", "code", "key", "occurrence"], "full_outer")
    added = F.array_except(F.coalesce("s_now", F.array().cast("array<string>")), F.coalesce("s_before", F.array().cast("array<string>")))
    state = F.when(F.col("has_s_before").isNull(), "new").when(F.col("has_s_now").isNull(), "fixed").when((F.size(F.coalesce("s_before", F.array().cast("array<string>"))) > 0) & (F.size(added) > 0), "new").otherwise("unchanged")
    return df.select("level", "code", "key", state.alias("state"), F.when(F.col("has_s_before"), added).alias("added"))


def trend(runs: DataFrame, time: str, step: str, count: str) -> DataFrame:
    """Each run's counts with those of the run before."""
    w = Window.partitionBy(step).orderBy(time)
    return runs.select(time, step, count, (F.col(count) - F.lag(count).over(w)).alias("delta"))


def citation_rates(answers: DataFrame, domain: str) -> DataFrame:
    """prompt, provider, runs, failed, cited, top_competitors of answers (prompt, provider, run, failed, urls)."""
    host = lambda u: F.regexp_replace(F.regexp_extract(F.lower(u), r"^[a-z]+://([^/:?#]+)", 1), r"^www\.", "")
    own = lambda h: (h == domain) | h.endswith("." + domain)
    df = answers.withColumn("hosts", F.array_distinct(F.transform(F.coalesce("urls", F.array().cast("array<string>")), host)))
    base = df.groupBy("prompt", "provider").agg(F.count(F.lit(1)).alias("runs"), F.count_if("failed").alias("failed"), F.count_if(F.exists("hosts", own)).alias("cited"))
    rivals = df.select("prompt", "provider", F.explode("hosts").alias("h")).filter(~own(F.col("h")) & (F.col("h") != "")).groupBy("prompt", "provider", "h").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("prompt", "provider").orderBy(F.desc("n"), "h")
    top = rivals.withColumn("k", F.row_number().over(w)).filter("k <= 8").groupBy("prompt", "provider").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]).alias("top_competitors"))
    return base.join(top, ["prompt", "provider"], "left")


def compare_rates(current: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
    """keys, a, n1, b, n2, p: cited of runs now and before, with the exact two-sided p.  Input: keys, cited, runs."""
    now = current.select(*keys, F.col("cited").cast("long").alias("a"), F.col("runs").cast("long").alias("n1"))
    was = previous.select(*keys, F.col("cited").cast("long").alias("b"), F.col("runs").cast("long").alias("n2"))
    return now.join(was, keys).withColumn("p", fisher_p("a", "n1", "b", "n2"))


def common_patterns(findings: DataFrame, sizes: DataFrame, least_projects: int = 2) -> DataFrame:
    """code, projects, pages of codes in two projects or more.  findings: project, url, code; sizes: project, pages."""
    per = findings.select("project", "url", "code").distinct().groupBy("code", "project").agg(F.count(F.lit(1)).alias("n")).join(sizes, "project")
    out = per.groupBy("code").agg(F.count(F.lit(1)).cast("long").alias("projects"), F.sum("n").cast("long").alias("findings"), F.avg(F.col("n") / F.col("pages")).alias("avg_share"))
    return out.filter(F.col("projects") >= least_projects)


def unique_findings(findings: DataFrame) -> DataFrame:
    """project, code of codes that one project alone has."""
    per = findings.select("project", "code").distinct().groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("project").alias("project"))
    return per.filter("n = 1").select("project", "code")


def glob_regex(glob: str) -> str:
    import re

    out = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob)
    return f"^{out}$"


def apply_ignore(findings: DataFrame, rules: dict[str, list[str]], path: Column) -> DataFrame:
    """findings with `accepted`: rules are globs of paths for a code or for *; an unknown code is a ValueError."""
    if unknown := sorted(set(rules) - CODES - {"*"}):
        raise ValueError(f"unknown codes: {', '.join(unknown)}")
    hit = F.lit(False)
    for code, globs in rules.items():
        for g in globs:
            here = path.rlike(glob_regex(g))
            hit = hit | (here if code == "*" else here & (F.col("code") == code))
    return findings.withColumn("accepted", hit)


def work_orders(findings: DataFrame, notes: DataFrame, pages: DataFrame) -> DataFrame:
    """scope, name, codes, pages: findings of whole templates first, then of the site, then of single pages; an address is in one order of each code."""
    named = findings.join(pages.select("url", url_pattern(F.col("key")).alias("pattern")), "url", "left")
    wide = notes.filter("scope = 'pattern'").select(F.col("value").alias("pattern"), "code", F.lit(True).alias("wide"))
    df = named.join(wide, ["pattern", "code"], "left")
    scope = F.when(F.coalesce("url", F.lit("")) == "", "site").when(F.col("wide"), "template").otherwise("page")
    name = F.when(scope == "site", F.lit("site")).when(scope == "template", F.col("pattern")).otherwise(F.col("url"))
    out = df.groupBy(scope.alias("scope"), name.alias("name")).agg(F.sort_array(F.collect_set("code")).alias("codes"), F.countDistinct("url").alias("pages"))
    w = Window.partitionBy(F.lower("name")).orderBy("name")
    return out.withColumn("file", F.concat(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-"), F.when(F.row_number().over(w) > 1, F.concat(F.lit("-"), F.row_number().over(w).cast("string"))).otherwise(F.lit(""))))
