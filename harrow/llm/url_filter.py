"""URL filter: rules, and a path-template tree per host with labelled purity. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.llm.common import discard, materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stand for a variable segment, and for a literal segment whose branches were merged.
WILD, MERGED = "*", "+"
#: Segments that are variable by their form: a number, with an ending or without.
NUMBER = r"^[0-9]+(\.[A-Za-z0-9]+)?$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end.

    Null, and a url without ``://``: both empty.
    """
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(whole, pattern, 1), UPPER, LOWER), F.regexp_extract(whole, pattern, 2)


def matching_rule(host: Column, path: Column, rules: list[str]) -> Column:
    """The longest rule ``host/path`` that fits the host or a parent domain of it and starts the path; else null.

    ``rules`` is a list of the job's settings, compiled into one expression.
    """
    whens: Column | None = None
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{rest}")
        whens = F.when(fits, F.lit(rule)) if whens is None else whens.when(fits, F.lit(rule))
    return F.lit(None).cast("string") if whens is None else whens


def _at(segments: Column, level: int, max_depth: int) -> Column:
    """Segment number ``level`` (from 1); the last level takes all that is left."""
    if level < max_depth:
        return F.get(segments, F.lit(level - 1))
    tail = F.slice(segments, level, F.greatest(F.size(segments), F.lit(1)))
    return F.when(F.size(segments) >= level, F.array_join(tail, "/"))


def _marked(template: str, level: int, mark: str) -> Column:
    """A template with another segment number ``level`` (from 1)."""
    return F.transform(template, lambda s, i: F.when(i == level - 1, F.lit(mark)).otherwise(s))


def _met(rows: DataFrame, facts: DataFrame, keys: list[str], hot_rows: int) -> DataFrame:
    """``rows`` with the columns of ``facts``, null where there are none; ``facts`` have one row a key, and ``weight``, its number of rows.

    Keys of ``hot_rows`` or more rows number at most all rows / ``hot_rows``, which bounds what is broadcast. The rest meet by a
    shuffle, in which no key has more rows; rows of hot keys and those with a null key are spread over all tasks.
    """
    named = F.struct(*(c for c in facts.columns if c not in (*keys, "weight")))
    hot = facts.where(F.col("weight") >= hot_rows).select(*keys, named.alias("hot"))
    cold = facts.where(F.col("weight") < hot_rows).select(*keys, F.lit(0).cast("long").alias("spread"), named.alias("cold"))
    free = reduce(lambda c, k: c | F.col(k).isNull(), keys, F.col("hot").isNotNull())
    found = rows.join(F.broadcast(hot), keys, "left").withColumn("spread", F.when(free, F.xxhash64(F.monotonically_increasing_id())).otherwise(F.lit(0).cast("long")))
    found = found.join(cold, [*keys, "spread"], "left").withColumn("fact", F.coalesce("hot", "cold"))
    return found.select(*rows.columns, "fact.*")


def path_templates(urls: DataFrame, max_depth: int = 6, min_children: int = 8, min_share: float = 0.05, hot_rows: int = 1 << 20) -> DataFrame:
    """``urls`` (host, path, any other columns) with a column ``template``: array of segments, variable ones as ``*``.

    The tree is built level by level: at a node (host and template so far) with ``min_children`` or more different
    next segments, those that fewer than ``min_share`` of its rows have are variable, and numbers are everywhere. A node
    keeps at most 1 / min_share literals, so the table of literals stays small beside the urls. One host or branch may
    hold a large part of all rows: segments of ``hot_rows`` rows or more, or of a ten-thousandth of all if that is more, are
    broadcast, so they are ten thousand at most, and their rows are spread. Segments past ``max_depth`` count as one. A
    column ``template`` of ``urls`` is replaced.
    """
    kept = [c for c in urls.columns if c.lower() != "template"]
    rows = urls.select(
        F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col("host"), F.array().cast("array<string>").alias("template"),
        F.filter(F.split("path", "/"), lambda s: s != "").alias("segments"),
    )
    rows = materialise(rows, "url-templates")
    deepest, total = rows.agg(F.max(F.least(F.size("segments"), F.lit(max_depth))), F.count(F.lit(1))).first()
    hot_rows = max(hot_rows, -(-total // 10_000))
    for level in range(1, (deepest or 0) + 1):
        rows = rows.withColumn("next", _at(F.col("segments"), level, max_depth))
        children = rows.where("next IS NOT NULL").groupBy("host", "template", "next").agg(F.count(F.lit(1)).alias("n"))
        children = materialise(children, "url-children")
        nodes = children.groupBy("host", "template").agg(F.sum("n").alias("all_n"), F.count(F.lit(1)).alias("kinds"), F.count(F.lit(1)).alias("weight"))
        literal = ((F.col("kinds") < min_children) | (F.col("n") >= min_share * F.col("all_n"))) & ~F.col("next").rlike(NUMBER)
        judged = _met(children, nodes, ["host", "template"], hot_rows).select("host", "template", "next", F.col("n").alias("weight"), literal.alias("literal"))
        segment = F.when(F.col("literal"), F.col("next")).otherwise(F.lit(WILD))
        grown = F.when(F.col("next").isNull(), F.col("template")).otherwise(F.array_append("template", segment))
        below = _met(rows, judged.where(F.col("literal") | (F.col("weight") >= hot_rows)), ["host", "template", "next"], hot_rows)
        rows = materialise(below.select("row", "host", grown.alias("template"), "segments"), "url-templates")
        discard(children)
    return rows.select("row.*", "template")


def _misfit(shapes: DataFrame, pseudo: float) -> DataFrame:
    """host, merged, kinds, misfit: the chi-squared statistic of each branch's suffixes against those of its model branches.

    With shares b of the branch and p of the model, smoothed over all suffixes of the group, it is m * (sum of b^2 / p - 1) for
    m = rows of the branch * rows of the model / their sum.
    """
    group, same = Window.partitionBy("host", "masked"), Window.partitionBy("host", "masked", "suffix")
    model = (F.col("n") > 0) | (F.col("all_n") == 0)
    shapes = shapes.withColumn("model", F.coalesce(F.sum(F.when(model, F.col("c"))).over(same), F.lit(0))).withColumn("first", F.row_number().over(same.orderBy("merged")))
    shapes = shapes.withColumn("kinds", F.sum(F.when(F.col("first") == 1, 1).otherwise(0)).over(group))
    share = (F.col("model") + pseudo) / (F.col("all_own") + pseudo * F.col("kinds"))
    rows = shapes.groupBy("host", "merged", "own", "all_own", "kinds").agg(F.sum(F.pow(F.col("c") / F.col("own"), 2) / share).alias("ratio"))
    both = F.col("own") * F.col("all_own") / (F.col("own") + F.col("all_own"))
    return rows.select("host", "merged", "kinds", (both * (F.col("ratio") - 1)).alias("misfit"))


def merged_templates(rows: DataFrame, max_depth: int = 6, z: float = 2.0, pseudo: float = 1.0) -> DataFrame:
    """host, template, rows, labelled, bad, merged: each template's counts and the class it is merged into.

    ``rows`` have host, template and bad (true, false, or null without a label). From the last segment to the first,
    templates of a host that differ only in the literal there, and so agree in all that is below it, are compared.
    Labelled ones whose share of bad rows is within ``z`` standard errors of the share of all of them merge. One without
    labels has its structure compared with that of the labelled ones, or of all where none is labelled: which share of all rows below
    its literal has this continuation, within ``z`` standard errors, and how often each template that the continuation was made
    of occurs, by a chi-squared statistic within ``z`` deviations of its mean. If both agree and no labelled one stands apart, it
    joins, as the literal then makes no difference. Others stay as they are. A node has few literals (1 / min_share), so groups of
    siblings are small.
    """
    stats = rows.groupBy("host", "template").agg(F.count(F.lit(1)).alias("rows"), F.count("bad").alias("labelled"), F.count_if(F.col("bad")).alias("bad"))
    stats = materialise(stats.withColumn("merged", F.col("template")), "url-classes")
    deepest = stats.agg(F.max(F.least(F.size("template"), F.lit(max_depth)))).first()[0] or 0
    for level in range(deepest, 0, -1):
        here = F.get("merged", F.lit(level - 1))
        masked = _marked("merged", level, MERGED)
        stats = stats.withColumn("masked", F.when(here.isNotNull() & (here != WILD), masked)).withColumn("node", F.slice("merged", 1, level))
        below = stats.where("masked IS NOT NULL").groupBy("host", "node").agg(F.sum("rows").alias("below"))
        branch = stats.where("masked IS NOT NULL").groupBy("host", "masked", "merged", "node").agg(
            F.sum("labelled").alias("n"), F.sum("bad").alias("k"), F.sum("rows").alias("own")
        ).join(below, ["host", "node"])
        of = lambda c: F.coalesce(F.sum(F.when(F.col("n") > 0, F.col(c))), F.sum(c))
        pool = branch.groupBy("host", "masked").agg(
            F.sum("n").alias("all_n"), F.sum("k").alias("all_k"), of("own").alias("all_own"), of("below").alias("all_below")
        )
        share = (F.col("all_k") + pseudo) / (F.col("all_n") + 2 * pseudo)
        off = F.abs((F.col("k") + pseudo) / (F.col("n") + 2 * pseudo) - share)
        alike = (F.col("n") > 0) & (off <= z * F.sqrt(share * (1 - share) / F.col("n")))
        part = (F.col("all_own") + pseudo) / (F.col("all_below") + 2 * pseudo)
        fits = F.abs(F.col("own") / F.col("below") - part) <= z * F.sqrt(part * (1 - part) * (1 / F.col("below") + 1 / F.col("all_below")))
        judged = materialise(branch.join(pool, ["host", "masked"]).withColumns({"alike": alike, "part_fits": fits}), "url-branches")
        shapes = stats.where("masked IS NOT NULL").groupBy("host", "merged", F.expr(f"slice(template, {level + 1}, greatest(size(template), 1))").alias("suffix")).agg(F.sum("rows").alias("c"))
        judged = judged.join(_misfit(shapes.join(judged, ["host", "merged"]), pseudo), ["host", "merged"])
        freedom = F.col("kinds") - 1
        siblings = Window.partitionBy("host", "masked")
        judged = judged.withColumn("agreed", F.coalesce(F.bool_and(F.when(F.col("n") > 0, F.col("alike"))).over(siblings), F.lit(True)))
        joins = F.col("alike") | ((F.col("n") == 0) & F.col("agreed") & F.col("part_fits") & (F.col("misfit") <= freedom + z * F.sqrt(2 * freedom)))
        moves = judged.select("host", "merged", F.when(joins, F.col("masked")).alias("to"))
        moved = stats.join(moves, ["host", "merged"], "left").select("host", "template", "rows", "labelled", "bad", F.coalesce("to", "merged").alias("merged"))
        stats = materialise(moved, "url-classes")
    return stats


def template_purity(classes: DataFrame, pseudo: float = 1.0, weight: float = 4.0) -> DataFrame:
    """host, template, rows, merged, labelled, purity of :func:`merged_templates`: the smoothed share of bad labels.

    A host's purity is (bad + pseudo) / (labelled + 2 * pseudo). That of each node below, down to the merged template, is
    (bad + weight * purity of the node above) / (labelled + weight) over all labels under the node. A template
    that has no labels even after merging is like none that has, so those above say nothing of it: its purity is one half.
    """
    merged = classes.groupBy("host", "merged").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    paths = merged.select("host", "merged", "labelled", "bad", F.explode(F.sequence(F.lit(0), F.size("merged"))).alias("level"))
    paths = materialise(paths.withColumn("node", F.expr("slice(merged, 1, level)")), "url-nodes")
    nodes = paths.groupBy("host", "node").agg(F.sum("labelled").alias("n"), F.sum("bad").alias("k"))
    steps = paths.join(nodes, ["host", "node"]).groupBy("host", "merged").agg(F.array_sort(F.collect_list(F.struct("level", "n", "k"))).alias("steps"))
    down = lambda above, s: F.when(s["level"] == 0, (s["k"] + pseudo) / (s["n"] + 2 * pseudo)).otherwise((s["k"] + weight * above) / (s["n"] + weight))
    purity = steps.select("host", "merged", F.aggregate("steps", F.lit(0.5), down).alias("purity"))
    known = classes.select("host", "template", "rows", "merged").join(purity, ["host", "merged"]).join(merged.drop("bad"), ["host", "merged"])
    return known.withColumn("purity", F.when(F.col("labelled") > 0, F.col("purity")).otherwise(0.5))


def judge_urls(pages: DataFrame, rules: dict[str, str], threshold: float = 0.8, max_depth: int = 6, hot_rows: int = 1 << 20) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity, one row per page.

    ``rules``: ``host/path`` -> ``allow`` or ``block``; the longest that fits gives the verdict and labels the url.
    Urls without a rule are blocked if their template's smoothed purity of blocked labels reaches ``threshold``, else
    allowed. Null urls and such without ``://`` have empty host and path, and fit no rule. Repeated rows give
    a row each; null page_ids are kept; an empty table gives no rows; other columns are left out; urls of any
    length count whole.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("rule", matching_rule(F.col("host"), F.col("path"), list(rules)))
    given = reduce(lambda c, r: c.when(F.col("rule") == r, F.lit(rules[r])), rules, F.when(F.lit(False), F.lit("")))
    rows = path_templates(urls, max_depth, hot_rows=hot_rows).withColumn("given", given).withColumn("bad", F.col("given") == "block")
    classes = merged_templates(rows, max_depth)
    total = classes.agg(F.sum("rows")).first()[0] or 0
    purity = template_purity(classes).select("host", "template", "purity", F.col("rows").alias("weight"))
    verdict = F.coalesce("given", F.when(F.col("purity") >= threshold, F.lit("block")).otherwise(F.lit("allow")))
    return _met(rows, purity, ["host", "template"], max(hot_rows, -(-total // 10_000))).select(
        "page_id", "host", "path", "rule", verdict.alias("verdict"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity"
    )
