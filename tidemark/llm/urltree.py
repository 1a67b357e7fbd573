"""Operator 5 (DataFrame functions only): URL rules, and for other URLs a path-template tree.

Templates grow level by level under each host, as deep as several URLs share one; the rest of a URL that is alone is its
tail. A segment with a digit is variable, and so are all below a template that has many distinct ones for its URLs. Of other
sibling branches, those that are statistically like the rest of their siblings merge into one wildcard branch: neither the
share of bad ones among labelled URLs nor that of URLs that go on deeper differs, by a likelihood-ratio test of two
binomials. A branch without labels can't differ in them, so it joins siblings of its shape and is judged with them. A
template's purity is the share of bad ones among its labelled URLs, smoothed towards the purity of the template above it,
that of a host towards the whole table's; a URL whose template's purity reaches a bound is blocked.

URLs are counted once a distinct (host, path) before anything else, so a hot host or URL is reduced before the shuffle;
joins are on (host, template, segment) of tables read from files, which adaptive execution splits where they are skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Rules of the query (host, path, verdict), in their text form host/path.
RULES: list[tuple[str, str]] = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
#: Distinct segments from which all below a template are variable, and their least share of its URLs. Weight of the prior in
#: the smoothed purity, the purity from which a template is rejected, and the bound of the test (5 % of chi-square with one degree).
DISTINCT, SPREAD, PRIOR, REJECT, ALIKE = 8, 0.5, 8.0, 0.7, 3.841

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, with A-Z in lower case; empty for a null or where there is none."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def rule_of(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, from columns host and path; nulls where none fits. rules: a fixed short list."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(slash + path))
        name, verdict = F.when(fits, text).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def _likelihood(k: Column, n: Column) -> Column:
    """Logarithm of the greatest likelihood of k of n."""
    part = lambda x: F.when(x > 0, x * F.log(x / n)).otherwise(0.0)
    return F.when(n > 0, part(k) + part(n - k)).otherwise(0.0)


def differs(k: Column, n: Column, of: Column, all_: Column) -> Column:
    """Twice the log likelihood ratio of k of n against the rest of ``of`` of ``all_``."""
    k, n, of, all_ = (x.cast("double") for x in (k, n, of, all_))
    return 2 * (_likelihood(k, n) + _likelihood(of - k, all_ - n) - _likelihood(of, all_))


def template_verdicts(ws: Workspace, urls: DataFrame) -> DataFrame:
    """(host, path, good, bad), one row per distinct URL -> (host, path, template, purity)."""
    wild = lambda s: F.when(s.rlike("[0-9]"), "*").otherwise(s)
    smooth = lambda above: (F.col("bad") + PRIOR * above) / (F.col("good") + F.col("bad") + PRIOR)
    urls = ws.save(urls.select("host", "path", "good", "bad", F.filter(F.split("path", "/"), lambda s: s != "").alias("segments")), "urls")
    good, bad = (float(x or 0) for x in urls.agg(F.sum("good"), F.sum("bad")).first())
    hosts = urls.groupBy("host").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    hosts = ws.save(hosts.select("host", smooth(F.lit((bad + 1) / (good + bad + 2))).alias("purity")), "hosts")
    level = ws.save(urls.join(hosts, "host").select("host", "path", "good", "bad", "segments", F.lit("").alias("template"), "purity", F.lit(2).alias("leaves")), "level-0")
    finished, k = [], 0
    while True:
        over = (F.size("segments") <= k) | (F.col("leaves") == 1)
        tail = F.transform(F.slice("segments", k + 1, F.greatest(F.size("segments") - k, F.lit(0))), wild)
        finished.append(level.where(over).select("host", "path", F.concat("template", F.array_join(F.transform(tail, lambda s: F.concat(F.lit("/"), s)), "")).alias("template"), "purity"))
        now = level.where(~over).withColumn("segment", wild(F.get("segments", F.lit(k))))
        nodes = ws.save(now.groupBy("host", "template", "purity", "segment").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.sum((F.size("segments") > k + 1).cast("int")).alias("inner"), F.count("*").alias("leaves")), f"nodes-{k}")
        if not nodes.limit(1).count():
            break
        named = F.col("segment") != "*"
        all_ = nodes.where(named).groupBy("host", "template").agg(F.count("*").alias("kinds"), *[F.sum(c).alias(f"all_{c}") for c in ("good", "bad", "inner", "leaves")])
        both = nodes.join(ws.save(all_, f"all-{k}"), ["host", "template"], "left")
        variable = (F.col("kinds") >= DISTINCT) & (F.col("kinds") >= SPREAD * F.col("all_leaves"))
        labels, shape = differs(F.col("bad"), F.col("good") + F.col("bad"), F.col("all_bad"), F.col("all_good") + F.col("all_bad")), differs(F.col("inner"), F.col("leaves"), F.col("all_inner"), F.col("all_leaves"))
        alike = (F.col("kinds") > 1) & (labels <= ALIKE) & (shape <= ALIKE)
        mapped = ws.save(both.select("host", "template", "purity", "segment", "good", "bad", "leaves", F.when(named & ~(variable | alike), F.col("segment")).otherwise("*").alias("to")), f"mapped-{k}")
        merged = mapped.groupBy("host", "template", "purity", "to").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.sum("leaves").alias("leaves"))
        merged = ws.save(merged.select("host", "template", "to", smooth(F.col("purity")).alias("purity"), "leaves"), f"merged-{k}")
        known = mapped.select("host", "template", "segment", "to").join(merged, ["host", "template", "to"])
        joined = now.drop("purity", "leaves").join(ws.save(known, f"known-{k}"), ["host", "template", "segment"])
        k += 1
        level = ws.save(joined.select("host", "path", "good", "bad", "segments", F.concat("template", F.lit("/"), "to").alias("template"), "purity", "leaves"), f"level-{k}")
        ws.drop(*[f"{x}-{k - 1}" for x in ("nodes", "all", "mapped", "merged", "known")])
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    return out


def judge(pages: DataFrame, rules: list[tuple[str, str]], id: str = "page_id", url: str = "url", labels: DataFrame | None = None) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict, template, purity.

    A rule decides where one fits; else the URL's template: block if its purity reaches REJECT, allow otherwise. The labelled
    URLs are those that a rule decides and, if given, labels (id, bad 0 or 1; the least bad of a repeated id counts). A null
    URL or one without :// has an empty host and path; it is judged as the empty template. Paths of any depth have all their
    segments. Ties of equally long rules go to the later in order. Repeated rows, null ids and other columns change
    nothing; an empty table gives an empty result.
    """
    ws = Workspace(pages.sparkSession, "urls")
    rows = pages.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"))
    rows = rows.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    name, verdict = rule_of(rules)
    rows = rows.withColumn("rule", name).withColumn("said", verdict)
    bad = F.col("said") == "block"
    if labels is not None:
        rows = rows.join(labels.select(F.col("id"), F.col("bad").cast("int").alias("label")).groupBy("id").agg(F.min("label").alias("label")), "id", "left")
        bad = F.coalesce(F.col("label") == 1, bad)
    rows = ws.save(rows.withColumn("bad", bad), "rows")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    urls = rows.groupBy("host", "path").agg(count(~F.col("bad"))("good"), count(F.col("bad"))("bad"))
    known = ws.save(template_verdicts(ws, urls), "verdicts")
    out = rows.drop("bad").join(known, ["host", "path"], "left")
    return out.select(F.col("id").alias(id), "host", "path", "rule", F.coalesce("said", F.when(F.col("purity") >= REJECT, "block").otherwise("allow")).alias("verdict"), "template", "purity")
