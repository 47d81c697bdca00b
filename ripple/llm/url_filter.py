"""
URL filters: rules first, then a path-template tree for each host.

A url's path is a list of segments. Level by level, segments that vary are generalised: numbers, dates and codes by their shape,
and all that too small a share of the host's urls have into one wildcard. What remains is a template such as /en/{n}.

Urls that a rule decides are the labelled ones. Templates without labels of their own back off: the share of bad urls of a host's template is smoothed by
that of the same template in the host's domain (its last two names), this one by that in all hosts, and this one by a fixed prior.
Sibling templates of a host, which differ in one literal segment, are ordered by these shares, and neighbours whose shares are not statistically
different become one branch, so an unlabelled branch joins the labelled one that is nearest. A branch is rejected by its smoothed share.

Scale: urls are counted by (host, path) first, so later steps see distinct paths; every level is one aggregation and
one join on (host, prefix, segment). Every literal needs ``SHARE`` of its host's urls, so a host has a bounded number of templates and merging them is a
small group. Keys that hold more than a thousandth of the rows are joined apart (``common.join_split``), so no task gets a hot host or url.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import common

#: Segments that have levels of their own; what follows is one more segment.
LEVELS = 6
#: A literal segment needs this share of its host's urls, and so many of them.
SHARE, LEAST = 0.005, 3
#: Smoothing: a template's share counts like so many urls in the next narrower one; the share of all begins with PRIOR.
PRIOR, PRIOR_WEIGHT = 0.3, 4.0
#: Smoothed share of bad urls from which a template is rejected.
REJECT = 0.6
#: Siblings are merged below this difference, in standard errors.
DIFFERENT = 1.96


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    def __str__(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest fitting rule as a string, or null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(str(r)), str(r))):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(str(rule))).otherwise(found)
    return found


def form(segment: Column) -> Column:
    """What stands for a segment in a template if it is frequent enough: numbers, dates and codes as wildcards, a numbered file by its suffix, else itself."""
    return (
        F.when(segment.rlike(r"^[0-9]+$"), "{n}")
        .when(segment.rlike(r"^[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2})?$"), "{date}")
        .when(segment.rlike(r"^[0-9a-fA-F-]{8,}$") & segment.rlike(r"[0-9]"), "{code}")
        .when(segment.rlike(r"^[0-9]+\.[A-Za-z]{2,5}$"), F.concat(F.lit("{n}."), F.lower(F.substring_index(segment, ".", -1))))
        .when(segment.rlike(r"^[{*]"), "*")
        .otherwise(segment)
    )


def templates(paths: DataFrame) -> DataFrame:
    """paths: host, path, n, labelled, bad (a row for each host and path). Adds ``template``."""
    split = F.filter(F.split("path", "/"), lambda s: s != "")
    segs = F.when(F.size(split) > LEVELS, F.concat(F.slice(split, 1, LEVELS), F.array(F.array_join(F.slice(split, LEVELS + 1, 1 << 20), "/")))).otherwise(split)
    rows = paths.withColumn("segs", F.transform(segs, form)).withColumn("template", F.lit(""))
    deepest = rows.agg(F.max(F.size("segs"))).first()[0] or 0  # LEVELS + 1 at most
    hosts = rows.groupBy("host").agg(F.sum("n").alias("host_n"))
    total = paths.count()
    key = ["host", "template", "seg"]
    for level in range(deepest):
        rows = rows.withColumn("seg", F.get("segs", F.lit(level)))
        varies = F.col("seg").isin("{n}", "{date}", "{code}", "*")
        seen = rows.where(F.col("seg").isNotNull() & ~varies).groupBy(*key).agg(F.sum("n").alias("seg_n"), F.count("*").alias("paths"))
        literal = seen.join(hosts, "host").where((F.col("seg_n") >= LEAST) & (F.col("seg_n") >= SHARE * F.col("host_n"))).select(*key, F.lit(True).alias("literal"), "paths")
        literal = common.written(literal, "literals")
        rows = common.join_split(rows, literal, key, "paths", total)
        step = F.when(varies | F.col("literal"), F.col("seg")).otherwise(F.lit("*"))
        rows = rows.withColumn("template", F.when(F.col("seg").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), step))).drop("seg", "literal")
        if level % 2:
            rows = common.written(rows, "templates")  # a join splits its rows, so the plan doubles with every level
    return rows.drop("segs")


def backed_off(sums: DataFrame) -> DataFrame:
    """sums: host, template, labelled, bad -> host, template, labelled, bad, wide: the share of the template's domain, smoothed by that of all hosts."""
    spread = common.written(sums.withColumn("domain", F.substring_index("host", ".", -2)), "by-domain")
    total = spread.count()

    def smoothed(by: list[str], name: str, prior: Column) -> DataFrame:
        counts = [F.sum("labelled").alias("of"), F.sum("bad").alias("are"), F.count("*").alias("nodes")]
        share = (F.col("are") + prior * PRIOR_WEIGHT) / (F.col("of") + PRIOR_WEIGHT)
        held = F.first("everywhere").alias("everywhere") if "domain" in by else F.lit(0).alias("_")
        return common.written(spread.groupBy(*by).agg(*counts, held).select(*by, share.alias(name), "nodes"), name)

    spread = common.written(common.join_split(spread, smoothed(["template"], "everywhere", F.lit(PRIOR)), ["template"], "nodes", total), "by-template")
    return common.join_split(spread, smoothed(["domain", "template"], "wide", F.col("everywhere")), ["domain", "template"], "nodes", total).select("host", "template", "labelled", "bad", "wide")


def merge_siblings(rows: pd.DataFrame) -> pd.DataFrame:
    """
    template, labelled, bad, wide of one host -> template, merged (the templates of its branch), share (of bad ones in the branch, smoothed).

    A template counts ``PRIOR_WEIGHT`` urls of the wide share beside its own labelled ones. Templates that differ in one literal segment only are
    siblings. In order of their shares, neighbours whose shares differ by less than DIFFERENT standard errors become one branch.
    """
    group = {t: (t,) for t in rows["template"]}
    stats = {t: (a + PRIOR_WEIGHT, b + PRIOR_WEIGHT * w) for t, a, b, w in zip(rows["template"], rows["labelled"], rows["bad"], rows["wide"], strict=True)}
    pool = lambda ts: tuple(map(sum, zip(*(stats[x] for x in ts), strict=True)))
    siblings: dict[str, list[str]] = {}
    for t in sorted(stats):
        parts = t.split("/")
        for k, p in enumerate(parts):
            if p and p[0] not in "{*":
                siblings.setdefault("/".join(parts[:k] + ["*"] + parts[k + 1 :]), []).append(t)
    for name in sorted(siblings):
        members = [t for t in siblings[name] if len(group[t]) == 1]
        members.sort(key=lambda t: (stats[t][1] / stats[t][0], t))
        run: list[str] = []
        for t in members:
            if run:
                (n1, b1), (n2, b2) = pool(run), stats[t]
                pooled = (b1 + b2 + 1) / (n1 + n2 + 2)
                if abs(b1 / n1 - b2 / n2) >= DIFFERENT * math.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2)):
                    run = []
            run.append(t)
            for x in run:
                group[x] = tuple(run)
    out = [(t, "|".join(group[t]), b / n) for t in rows["template"] for n, b in [pool(group[t])]]
    return pd.DataFrame(out, columns=["template", "merged", "share"])


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url", label: Column | None = None) -> DataFrame:
    """
    All rows and columns of ``pages`` with host, path, rule, template, bad_share and verdict (block or allow). ``label`` says
    which rows are known (true: bad, false: good, null: not known); by default, rows that a rule decides are.

    Rows without a host (null urls) are one host with one empty template; repeated rows each count; an empty table gives no rows. Columns of these names
    in ``pages`` are replaced.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.withColumns({"host": host, "path": path})
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    decided = F.element_at(F.create_map(*[F.lit(x) for r in rules for x in (str(r), r.verdict)]), F.col("rule")) if rules else F.lit(None).cast("string")
    rows = rows.withColumns({"_decided": decided, "_bad": label if label is not None else decided == "block"})
    counted = common.written(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("_bad").alias("labelled"), F.count_if("_bad").alias("bad")), "paths")
    total = counted.agg(F.sum("n")).first()[0] or 0
    named = common.written(templates(counted), "templates")
    sums = backed_off(named.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.count("*").alias("paths")))

    def merge(key, group):
        return merge_siblings(group.sort_values("template")).assign(host=key[0])

    judged = ship(sums).groupBy("host").applyInPandas(merge, "template string, merged string, share double, host string")
    judged = common.written(judged.join(named.groupBy("host", "template").agg(F.count("*").alias("paths")), ["host", "template"]), "judged")
    of_path = common.written(common.join_split(named, judged, ["host", "template"], "paths", named.count()).select("host", "path", "n", "template", "merged", F.col("share").alias("bad_share")), "verdicts")
    verdict = F.coalesce("_decided", F.when(F.col("bad_share") >= REJECT, "block").otherwise("allow"))
    out = common.join_split(rows.drop("template", "merged", "bad_share", "verdict"), of_path, ["host", "path"], "n", total)
    return out.withColumn("verdict", verdict).drop("_decided", "_bad")


def held_out_agreement(pages: DataFrame, rules: tuple[Rule, ...] = RULES, folds: int = 5) -> tuple[int, float]:
    """
    (urls, share on which the tree agrees with the rule) for hosts that the tree gets no label of: those whose crc32 modulo ``folds`` is
    0. Says how far labels carry over from other hosts.
    """
    held = F.pmod(F.crc32(host_and_path(F.col("url"))[0]), F.lit(folds)) == 0
    host, path = host_and_path(F.col("url"))
    found = rule_of(host, path, rules)
    bad = F.element_at(F.create_map(*[F.lit(x) for r in rules for x in (str(r), r.verdict == "block")]), found)
    got = judge_urls(pages.select("url", bad.alias("truth"), held.alias("held")), (), label=F.when(~F.col("held"), F.col("truth")))
    n, agree = got.where("held and truth is not null").agg(F.count("*"), F.avg(((F.col("verdict") == "block") == F.col("truth")).cast("double"))).first()
    return n, agree


def op6_urls(spark, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", "template", "bad_share")
