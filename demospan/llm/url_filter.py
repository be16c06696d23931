"""URL filter: a tree of path templates per host, judged by the labelled share of bad pages.

At each level where paths part, siblings whose share of bad labels does not differ from the other siblings' merge into a wildcard
(numbers always do). A path segment that differs stays, however small its share of the pages, if enough labels
show it; with fewer labels it must also be common among its siblings.
A template is rejected when its share of bad labels, smoothed towards its host's and that towards the
overall share, exceeds a limit. Hand-written rules come first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, cut

#: with fewer labels than EVIDENCE a literal branch must hold 1 / RARE of its node's pages
RARE, EVIDENCE = 50, 5
#: chi-square of one degree of freedom at 5 %
DIFFERS = 3.841
SMOOTHING = 8.0
REJECT_ABOVE = 0.5
ANY = "*"


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; a rule is ``host/path start``."""
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r), r)):  # the longest is put on last, so it is tried first
        own, _, start = r.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(rules[r])).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """Path segments with each run of digits as ``<n>``."""
    return F.filter(F.split(F.regexp_replace(path, "[0-9]+", "<n>"), "/", -1), lambda s: s != "")


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("pages", "labelled", "bad")]


def _shared(a: Column, b: Column) -> Column:
    """How many elements at the start of two arrays are the same."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    differs = F.array_position(same, F.lit(False)).cast("int")
    return F.when(differs > 0, differs - 1).otherwise(F.size(same))


def templates(paths: DataFrame) -> DataFrame:
    """``template`` for ``host, segs, pages, labelled, bad``, a row for each distinct host and segs.

    In each round a node first goes down to where its paths part, in one step however far that is: the greatest
    of its paths shows it. Then its branches are judged. So there is a round, checkpointed, for each level at
    which paths really part; paths that have ended are kept aside.
    """
    columns = [*paths.columns, "template"]
    now = cut(paths.withColumns({"template": F.lit(""), "rest": F.col("segs")}))
    ended = []
    while True:
        ended.append(now.where(F.size("rest") == 0).select(*columns))
        now = now.where(F.size("rest") > 0)
        if now.isEmpty():
            break
        great = now.groupBy("host", "template").agg(F.max("rest").alias("great"))
        along = now.join(great, ["host", "template"]).withColumn("along", _shared(F.col("rest"), F.col("great")))
        # paths that lie wholly on the greatest one end on it; the others show where it is left first
        parts = along.groupBy("host", "template").agg(F.min(F.when(F.col("along") < F.size("rest"), F.col("along"))).alias("parts"))
        parts = parts.join(great, ["host", "template"]).withColumn("parts", F.coalesce("parts", F.size("great"))).drop("great")
        down = now.join(parts, ["host", "template"]).withColumns({"own": F.least("parts", F.size("rest"))})
        slash = lambda x: F.concat(F.lit("/"), F.array_join(x, "/"))
        down = down.withColumns({
            "template": F.when(F.col("own") > 0, F.concat("template", slash(F.slice("rest", F.lit(1), F.col("own"))))).otherwise(F.col("template")),
            "rest": F.slice("rest", F.col("own") + 1, F.greatest(F.size("rest") - F.col("own"), F.lit(0))),
        })
        down = cut(down.select(*columns, "rest"))
        ended.append(down.where(F.size("rest") == 0).select(*columns))
        deep = down.where(F.size("rest") > 0).withColumn("seg", F.get("rest", F.lit(0)))
        branch = deep.groupBy("host", "template", "seg").agg(*_sums())
        node = branch.groupBy("host", "template").agg(*[F.sum(c).alias("all_" + c) for c in ("pages", "labelled", "bad")], F.count("*").alias("branches"))
        bad, good = F.col("bad").cast("double"), (F.col("labelled") - F.col("bad")).cast("double")
        other_bad = (F.col("all_bad") - F.col("bad")).cast("double")
        other_good = (F.col("all_labelled") - F.col("all_bad")).cast("double") - good
        cross = bad * other_good - good * other_bad
        spread = (bad + good) * (other_bad + other_good) * (bad + other_bad) * (good + other_good)
        differs = cross * cross * F.col("all_labelled").cast("double") > spread * F.lit(DIFFERS)
        common = F.col("pages") * RARE >= F.col("all_pages")
        literal = (F.col("branches") == 1) | (differs & (common | (F.col("labelled") >= EVIDENCE)))
        chosen = branch.join(node, ["host", "template"]).select(
            "host", "template", "seg", F.when(literal, F.col("seg")).otherwise(F.lit(ANY)).alias("step")
        )
        moved = deep.join(chosen, ["host", "template", "seg"])
        now = cut(
            moved.withColumns({"template": F.concat("template", F.lit("/"), "step"), "rest": F.slice("rest", F.lit(2), F.size("rest"))})
            .select(*columns, "rest")
        )
    return reduce(DataFrame.union, ended)


def judged(pages: DataFrame, labels: DataFrame, rules: dict[str, str]) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, bad_share``: a row for each row of ``pages``.

    ``labels`` has ``page_id`` and ``bad`` (0 or 1); pages without one count for the tree but not for the
    share; several labels of a page all count. Urls that are null or have no ``://`` have an empty host and
    path and are judged by the template of that empty host. Repeated rows are judged each; null ids too,
    which no label fits. An empty table gives no rows; other columns are ignored.
    """
    url = F.col("url").cast("string")
    rows = pages.select(pages["page_id"].cast("bigint").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("segs", segments(F.col("path")))
    marks = labels.where("bad IS NOT NULL").groupBy("page_id").agg(F.count("*").alias("labelled"), F.sum(F.col("bad").cast("bigint")).alias("bad"))
    paths = (
        rows.join(marks, "page_id", "left")
        .groupBy("host", "segs")
        .agg(F.count("*").alias("pages"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("labelled", "bad")])
    )
    tree = templates(paths)
    hosts = tree.groupBy("host").agg(F.sum("labelled").alias("host_labelled"), F.sum("bad").alias("host_bad"))
    everything = hosts.agg(F.sum("host_labelled"), F.sum("host_bad")).first()
    overall = float(everything[1] or 0) / float(everything[0]) if everything[0] else 0.0
    m = F.lit(SMOOTHING)
    share = lambda bad, n, prior: (F.col(bad).cast("double") + m * prior) / (F.col(n).cast("double") + m)
    stats = (
        tree.groupBy("host", "template")
        .agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
        .join(hosts, "host")
        .select("host", "template", share("bad", "labelled", share("host_bad", "host_labelled", F.lit(overall))).alias("bad_share"))
    )
    verdicts = tree.select("host", "segs", "template").join(stats, ["host", "template"])
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_share") > REJECT_ABOVE, "block").otherwise("allow")
    return rows.join(verdicts, ["host", "segs"]).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(ruled, own).alias("verdict"), "template", "bad_share"
    )
