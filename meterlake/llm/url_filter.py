"""URL filter: allow and block rules first, then a path-template tree judged by labelled purity.

Rules fit a host and its subdomains and a path prefix; they are joined on host suffixes, and of the rules
that fit, the longest wins. Other pages get the verdict of their template. Per host and level of the path,
segments with fewer than ``SUPPORT`` pages become wildcards (``*``, with a file ending kept), and so do others
at a place that varies, so ids and dates generalise while section names stay. A segment with support stays where the
segments with support are few for their pages (no more of them than each has pages on average), where it
has a ``SHARE`` of its node's pages, or where its share of bad labels differs from its siblings' by more than
chance explains in so many of them. Branches merge from the leaves up: of the children of one node, ordered by share of bad labels,
neighbours merge that do not differ significantly (two-proportion z below ``Z``), but for those that differ from the rest of
their class. A node whose children are one class becomes a branch itself and is compared with its siblings in turn; where
they are several classes, each is a branch, for good, and so is the node above not one. A branch is rejected when its smoothed share of bad labels,
``(bad + strength * prior) / (labelled + strength)``, reaches ``reject``; prior is the share over all labels.

Everything is DataFrame operations: counts are aggregated before they are shuffled, and pages meet counts in
plain joins, so a hot host is split like any skewed key.

Defined results: a null url, or one without ``://``, has empty host and path; it fits no rule of a non-empty
host; pages without labels in their branch get the prior; children without labels follow their siblings where these are one class, else they are branches without labels; repeated rows are judged alike; paths deeper than
``DEPTH`` segments share one rest wildcard (``**``) below it where fewer than ``SUPPORT`` pages go deeper; empty tables give empty results; other columns are
kept (those named like an output are replaced).
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .spark_tools import BROADCAST_KEYS, Scratch

DEPTH = 8
SUPPORT, SHARE = 20, 0.02
Z = 1.96
STRENGTH = 10.0
REJECT = 0.5


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), ascii_uppercase, ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(verdict, "host/path") pairs as rows (rule, rule_host, rule_path, rule_verdict)."""
    return spark.createDataFrame([(r, r.partition("/")[0], "/" + r.partition("/")[2], v) for v, r in rules], "rule string, rule_host string, rule_path string, rule_verdict string")


def match_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, rule_verdict): the longest rule of each distinct host and path that one fits."""
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    small = rules.count() <= BROADCAST_KEYS
    long = pages.select("host", "path").distinct().withColumn("rule_host", F.explode(suffixes))
    fits = long.join(F.broadcast(rules) if small else rules, "rule_host").where("startswith(path, rule_path)")
    best = F.max(F.struct(F.length("rule").alias("size"), "rule", "rule_verdict")).alias("best")
    return fits.groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.rule_verdict")


def wildcard(segment: Column) -> Column:
    return F.concat(F.lit("*"), F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1))


def templates(paths: DataFrame, support: int = SUPPORT, share: float = SHARE, labels: DataFrame | None = None, z: float = Z) -> DataFrame:
    """(host, path, pages) to the same rows with template; level by level from the host down.
    ``labels``: (host, path, bad 0/1 or null)."""
    scratch = Scratch(paths.sparkSession, "templates")
    segments = F.filter(F.split("path", "/", -1), lambda s: s != "")
    if labels is None:
        marked = paths.withColumns({"marks": F.lit(0).cast("long"), "bad": F.lit(0).cast("long")})
    else:
        by_path = labels.groupBy("host", "path").agg(F.count("bad").alias("marks"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
        marked = paths.join(by_path, ["host", "path"], "left").fillna(0, ["marks", "bad"])
    rows = scratch.table(marked.withColumns({"segments": segments, "template": F.lit(""), "done": F.lit(False)}))
    deepest = rows.agg(F.max(F.size("segments"))).first()[0] or 0
    total = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    for k in range(1, deepest + 1):
        if k > DEPTH and rows.where(~F.col("done") & (F.size("segments") >= k)).isEmpty():
            break
        here = rows.withColumn("segment", F.when((F.size("segments") >= k) & ~F.col("done"), F.col("segments")[k - 1]))
        children = here.where("segment is not null").groupBy("host", "template", "segment").agg(F.sum("pages").alias("n"), F.sum("marks").alias("marks"), F.sum("bad").alias("bad"))
        held = F.col("n") >= support
        nodes = children.groupBy("host", "template").agg(F.sum("n").alias("total"), F.count_if(held).alias("several"), total(F.when(held, F.col("n"))).alias("supported"), F.sum("marks").alias("all_marks"), F.sum("bad").alias("all_bad"))
        rest, rest_bad, pooled = F.col("all_marks") - F.col("marks"), F.col("all_bad") - F.col("bad"), F.try_divide("all_bad", "all_marks")
        gap = F.abs(F.try_divide("bad", "marks") - F.try_divide(rest_bad, rest))
        spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), "marks") + F.try_divide(F.lit(1.0), rest)))
        # The largest of so many chance values is about sqrt(2 ln of their number).
        differs = F.coalesce((gap > 0) & (gap >= (z + F.sqrt(2 * F.log(F.col("several").cast("double")))) * spread), F.lit(False))
        few = F.col("several").cast("double") * F.col("several") <= F.col("supported")
        kept = children.where(held).join(nodes, ["host", "template"]).where((F.col("n") >= share * F.col("total")) | few | differs).select("host", "template", "segment", F.lit(True).alias("literal"))
        named = here.join(kept, ["host", "template", "segment"], "left")
        new = F.concat("template", F.lit("/"), F.when(F.col("literal"), F.col("segment")).otherwise(wildcard(F.col("segment"))))
        more = F.col("segment").isNotNull()
        columns = ["host", "path", "pages", "marks", "bad", "segments", "done"]
        rows = scratch.table(named.select(*columns, F.when(more, new).otherwise(F.col("template")).alias("template")))
        if k >= DEPTH:
            deeper = F.size("segments") > k
            going = rows.where(deeper & ~F.col("done")).groupBy("host", "template").agg(F.sum("pages").alias("going"))
            ends = deeper & ~F.col("done") & (F.coalesce("going", F.lit(0)) < support)
            closed = rows.join(going, ["host", "template"], "left").withColumn("ends", ends)
            rows = scratch.table(closed.select(*[c for c in columns if c != "done"], (F.col("done") | F.col("ends")).alias("done"), F.when(F.col("ends"), F.concat("template", F.lit("/**"))).otherwise(F.col("template")).alias("template")))
    return rows.select("host", "path", "template")


def _differs(n: Column, bad: Column, other_n: Column, other_bad: Column, z: float) -> Column:
    """Two-proportion test; false where a side has no labels."""
    pooled = F.try_divide(bad + other_bad, n + other_n)
    gap = F.abs(F.try_divide(bad, n) - F.try_divide(other_bad, other_n))
    spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), n) + F.try_divide(F.lit(1.0), other_n)))
    return F.coalesce((gap > 0) & (gap >= z * spread), F.lit(False))


def branches(leaf: DataFrame, scratch: Scratch, z: float = Z) -> DataFrame:
    """(host, template, n, bad) to (host, template, branch), merged from the deepest templates up."""
    # A page may be where others have a directory: the dot at the end keeps it a child of its own.
    rows = leaf.withColumns({"node": F.concat("template", F.lit("/.")), "branch": F.lit(None).cast("string")})
    rows = scratch.table(rows.withColumn("depth", F.size(F.split("node", "/", -1)) - 1))
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    above = F.regexp_extract("node", r"^(.*)/[^/]*$", 1)
    for k in range(deepest, 0, -1):
        here = rows.where(F.col("branch").isNull() & (F.col("depth") == k)).groupBy("host", "node").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("parent", above)
        order = Window.partitionBy("host", "parent").orderBy(F.col("n") == 0, F.try_divide("bad", "n"), "node")
        apart = _differs(F.col("n"), F.col("bad"), F.lag("n").over(order), F.lag("bad").over(order), z)
        here = here.withColumn("apart", apart.cast("int")).withColumn("class", F.when(F.col("n") > 0, F.sum("apart").over(order)).otherwise(-1))
        group = Window.partitionBy("host", "parent", "class")
        rest_n, rest_bad = F.sum("n").over(group) - F.col("n"), F.sum("bad").over(group) - F.col("bad")
        here = here.withColumn("own", _differs(F.col("n"), F.col("bad"), rest_n, rest_bad, z))
        name = F.when(F.col("own") | (F.col("class") < 0), F.col("node")).otherwise(F.concat("parent", F.lit("/{"), F.col("class").cast("string"), F.lit("}")))
        here = here.withColumn("name", name)
        # Branches that are settled further down keep the nodes above them from becoming branches.
        settled = rows.where("branch is not null").select("host", F.array_join(F.slice(F.split("node", "/", -1), 1, k), "/").alias("parent")).distinct().withColumn("split", F.lit(True))
        several = here.groupBy("host", "parent").agg((F.countDistinct(F.when(F.col("n") > 0, F.col("name"))) > 1).alias("several"))
        named = here.join(several, ["host", "parent"]).join(settled, ["host", "parent"], "left")
        named = named.select("host", "node", "parent", F.when(F.col("several") | F.col("split"), F.col("name")).alias("settled_as"))
        joined = rows.join(named, ["host", "node"], "left")
        rows = scratch.table(
            joined.select(
                "host", "template", "n", "bad", F.coalesce("branch", "settled_as").alias("branch"),
                F.when(F.col("parent").isNotNull() & F.col("settled_as").isNull(), F.col("parent")).otherwise(F.col("node")).alias("node"),
                F.when(F.col("parent").isNotNull() & F.col("settled_as").isNull(), F.lit(k - 1)).otherwise(F.col("depth")).alias("depth"),
            )
        )
    return rows.select("host", "template", F.coalesce("branch", "node").alias("branch"))


def judge(labelled: DataFrame, scratch: Scratch, z: float = Z, strength: float = STRENGTH, reject: float = REJECT) -> DataFrame:
    """(host, template, bad) labelled rows to (host, template, branch, purity, template_verdict)."""
    leaf = scratch.table(labelled.groupBy("host", "template").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")))
    whole = leaf.agg(F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad"))
    prior = F.coalesce(F.try_divide("all_bad", "all_n"), F.lit(0.0))
    named = branches(leaf, scratch, z)
    merged = named.join(leaf, ["host", "template"]).groupBy("host", "branch").agg(F.sum("n").alias("branch_n"), F.sum("bad").alias("branch_bad"))
    out = named.join(merged, ["host", "branch"]).join(F.broadcast(whole))  # whole is one row
    purity = (F.col("branch_bad") + strength * prior) / (F.col("branch_n") + strength)
    return out.select("host", "template", "branch", purity.alias("purity"), F.when(purity >= reject, "block").otherwise("allow").alias("template_verdict"))


def filter_urls(pages: DataFrame, rules: DataFrame, labels: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, template, purity and verdict. ``labels``: (host, path, bad 0/1 or null)."""
    scratch = Scratch(pages.sparkSession, "urls")
    labels = labels.select("host", "path", "bad")
    names = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "template", "purity", "verdict")]
    parsed = pages.select(*names).withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))
    paths = scratch.table(parsed.groupBy("host", "path").agg(F.count("*").alias("pages")))
    placed = scratch.table(templates(paths, labels=labels))
    verdicts = judge(placed.join(labels, ["host", "path"], "left"), scratch)
    by_path = placed.join(verdicts, ["host", "template"]).join(match_rules(paths, rules), ["host", "path"], "left")
    by_path = scratch.table(by_path.select("host", "path", "rule", "template", "purity", F.coalesce("rule_verdict", "template_verdict").alias("verdict")))
    scratch.drop_all(by_path)
    return parsed.join(by_path, ["host", "path"]).select(*names, "host", "path", "rule", "template", "purity", "verdict")
