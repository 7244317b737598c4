"""URL filters: listed rules first, then a tree of path templates for each host.

A url's path is cut into segments and digit runs, variable by nature, become `#`. Within a host the tree is walked from the root, as deep as the paths go. A segment that holds too small
a share of its parent's pages is variable and becomes `*`, unless its labelled pages are enough and differ significantly from its siblings'; others stay.
Then siblings whose labelled shares of bad pages don't differ are merged into one branch, whose children the next level counts together: first those that
don't differ from the pool of all such, then, on either side of it, those that don't differ from the pool of the side. A branch that
differs from every pool stays alone, and one without labels merges with none. A template is rejected if its share of bad labelled pages, smoothed by the share of all, reaches a threshold.
The tree works on counts by (host, shape), which a partial aggregation makes before any shuffle, so a hot host costs no more than its shapes.

Nulls: a null url, or one without `://`, has empty host and path; it belongs to the template of the empty host. Empty tables give empty
results, repeated pages are judged alike, and other columns of the input are ignored, so their names can't clash. Labels are optional.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


@dataclass(frozen=True)
class UrlRule:
    rule: str
    verdict: str


@dataclass(frozen=True)
class Templates:
    """literal_share, literal_pages: least share of the parent's pages, and least pages, that keep a segment. own_labelled: labelled pages from which a rarer branch can be told from its siblings.
    merge_z: branches closer than this many standard errors merge. prior_pages: weight of the prior, the share of bad pages in all. reject: least smoothed share to reject."""

    literal_share: float = 0.02
    literal_pages: int = 3
    merge_z: float = 1.96
    prior_pages: float = 20.0
    reject: float = 0.5
    own_labelled: int = 10


def host(url: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), upper, lower)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(rules: list[UrlRule], host: Column, path: Column) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits; null where none does."""
    found = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.rule)):
        name, slash, rest = r.rule.partition("/")
        fits = (host == name) | host.endswith(f".{name}")
        if slash:
            fits = fits & path.startswith(f"/{rest}")
        found, verdict = F.when(fits, F.lit(r.rule)).otherwise(found), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return found, verdict


def shape(path: Column) -> Column:
    return F.regexp_replace(path, "[0-9]+", "#")


def differs(n: Column, k: Column, all_n: Column, all_k: Column, how: Templates) -> Column:
    """Whether k bad of n labelled pages differ significantly from the rest of all."""
    n, k, all_n, all_k = (c.cast("double") for c in (n, k, all_n, all_k))
    rest_n, pooled = all_n - n, F.when(all_n > 0, all_k / F.when(all_n > 0, all_n)).otherwise(0.0)
    error = F.sqrt(pooled * (1 - pooled) * (F.when(n > 0, 1 / F.when(n > 0, n)).otherwise(0.0) + F.when(rest_n > 0, 1 / F.when(rest_n > 0, rest_n)).otherwise(0.0)))
    apart = (n > 0) & (rest_n > 0) & (F.abs(k / F.when(n > 0, n) - (all_k - k) / F.when(rest_n > 0, rest_n)) > how.merge_z * error)
    return F.coalesce(apart, F.lit(False))


def merged_branches(branches: DataFrame, how: Templates) -> DataFrame:
    """branches: host, template (of the parent), step, labelled, bad, a row each. Adds group: of the branches that are merged with it, or null.

    A group's name begins with ?, which no path has: ?m for those like the pool of all, ?l and ?h for those alike below and above it.
    """
    family = Window.partitionBy("host", "template")

    def pool(which: Column, window=family) -> tuple[Column, Column]:
        return F.sum(F.when(which, F.col("labelled")).otherwise(0)).over(window), F.sum(F.when(which, F.col("bad")).otherwise(0)).over(window)

    def beside(which: str, n: Column, k: Column) -> tuple[Column, Column]:
        """A pool with the branch itself, whether it is in it or not."""
        return n + F.when(F.col(which), 0).otherwise(F.col("labelled")), k + F.when(F.col(which), 0).otherwise(F.col("bad"))

    some = F.col("labelled") > 0
    n, k = pool(some)
    rows = branches.withColumn("_near", some & ~differs(F.col("labelled"), F.col("bad"), n, k, how))
    n, k = pool(F.col("_near"))
    rows = rows.withColumn("_n", n).withColumn("_k", k)
    rows = rows.withColumn("_core", some & (F.col("_n") > 0) & ~differs(F.col("labelled"), F.col("bad"), *beside("_near", F.col("_n"), F.col("_k")), how))
    n, k = pool(some)
    above = F.col("bad") * F.when(F.col("_n") > 0, F.col("_n")).otherwise(n) > F.col("labelled") * F.when(F.col("_n") > 0, F.col("_k")).otherwise(k)
    rows = rows.withColumn("_side", F.when(~some, "?u").when(F.col("_core"), "?m").when(above, "?h").otherwise("?l"))
    n, k = pool(some, Window.partitionBy("host", "template", "_side"))
    alike = some & (F.col("_core") | ~differs(F.col("labelled"), F.col("bad"), n, k, how))
    rows = rows.withColumn("group", F.when(alike, F.col("_side")))
    size = F.count("*").over(Window.partitionBy("host", "template", "group"))
    return rows.withColumn("_size", size).select(*branches.columns, F.when(F.col("_size") > 1, F.col("group")).alias("group"))


def past_chains(tree: DataFrame, how: Templates) -> DataFrame:
    """tree (host, template, _parts, _at, pages) with the templates of all branches gone on to where they part: the segments that all paths of a branch share are one step.

    What all share is what the least and the greatest of them share. An only child keeps its segment if its pages are enough, and has no sibling to be merged with.
    """
    rest = F.slice("_parts", F.col("_at") + 1, F.greatest(F.size("_parts") - F.col("_at"), F.lit(0)))
    span = tree.groupBy("host", "template").agg(F.min(rest).alias("_low"), F.max(rest).alias("_high"), F.sum("pages").alias("_all"))
    apart = F.array_position(F.zip_with("_low", "_high", lambda x, y: x.eqNullSafe(y)), F.lit(False))
    shared = F.slice("_low", 1, F.when(apart > 0, apart.cast("int") - 1).otherwise(F.size("_low")))
    keep = F.col("_all") >= how.literal_pages
    span = stored(span.select("host", "template", shared.alias("_shared"), F.transform(shared, lambda x: F.when(keep, x).otherwise(F.lit("*"))).alias("_steps")).where(F.size("_shared") > 0))
    longer = F.when(F.col("_steps").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), F.array_join("_steps", "/")))
    return tree.join(span, ["host", "template"], "left").withColumns({"template": longer, "_at": F.col("_at") + F.coalesce(F.size("_shared"), F.lit(0))}).drop("_shared", "_steps")


def template_tree(shapes: DataFrame, how: Templates) -> DataFrame:
    """shapes: host, shape, pages, labelled, bad. Adds template. A round is a few jobs for one fork of each path; stretches without forks are one step, and a branch of one shape is finished at once, so long paths add no rounds."""
    size, at = F.size("_parts"), F.col("_at")
    tree = shapes.withColumn("_parts", F.split(F.regexp_replace("shape", "^/", ""), "/", -1)).withColumn("template", F.lit("")).withColumn("_at", F.lit(0))
    done = []
    while True:
        tree = stored(past_chains(tree, how).withColumn("_seg", F.when(size > at, F.get("_parts", at)).otherwise(F.lit(""))))
        child = tree.groupBy("host", "template", "_seg").agg(F.sum("pages").alias("_n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.count("*").alias("_shapes"))
        parent = tree.groupBy(F.col("host").alias("_h"), F.col("template").alias("_t")).agg(F.sum("pages").alias("_all"), F.sum("labelled").alias("_all_l"), F.sum("bad").alias("_all_b"), F.count("*").alias("_all_shapes"))
        # stored: else the join stands in one stage with the aggregation, and a hot host's partition can't be split
        child = child.join(stored(parent), (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")))
        frequent = (F.col("_n") >= how.literal_pages) & (F.col("_n") >= how.literal_share * F.col("_all"))
        own = (F.col("labelled") >= how.own_labelled) & differs(F.col("labelled"), F.col("bad"), F.col("_all_l"), F.col("_all_b"), how)
        child = stored(child.select("host", "template", "_seg", F.when(frequent | own, F.col("_seg")).otherwise(F.lit("*")).alias("step"), "labelled", "bad", (F.col("_all_shapes") == 1).alias("_alone")))
        branches = child.where("NOT _alone").groupBy("host", "template", "step").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
        groups = merged_branches(branches, how).where("group IS NOT NULL").select("host", "template", "step", "group")
        steps = child.join(groups, ["host", "template", "step"], "left").select("host", "template", "_seg", F.coalesce("group", "step").alias("_step"), "_alone")
        rest = F.transform(F.slice("_parts", at + 1, F.greatest(size - at, F.lit(0))), lambda x: F.when(F.col("pages") >= how.literal_pages, x).otherwise(F.lit("*")))
        longer = F.when(F.col("_alone"), F.concat("template", F.lit("/"), F.array_join(rest, "/"))).otherwise(F.concat("template", F.lit("/"), "_step"))
        tree = tree.join(steps, ["host", "template", "_seg"])
        tree = stored(tree.withColumn("template", F.when(size <= at, F.col("template")).otherwise(longer)).withColumn("_ended", F.col("_alone") | (size <= at)).withColumn("_at", at + 1).drop("_step", "_seg", "_alone"))
        more = tree.where("NOT _ended")  # paths that end at the next level count there among their siblings
        if more.where(size > at).isEmpty():
            done.append(tree)
            break
        done.append(tree.where("_ended"))
        tree = more.drop("_ended")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("_parts", "_at", "_ended")


def judge(pages: DataFrame, rules: list[UrlRule], labels: DataFrame | None = None, how: Templates = Templates(), page_id: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, template, verdict, a row for each page. labels: label_id, bad (0 or 1), by the last number of a path; at most a row an id counts."""
    rows = pages.select(F.col(page_id), F.col("url"))
    rows = rows.select(page_id, host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    known, said = matched(rules, F.col("host"), F.col("path"))
    rows = rows.withColumn("rule", known).withColumn("_said", said).withColumn("shape", shape(F.col("path")))
    number = F.expr(r"try_cast(regexp_extract(path, '([0-9]+)[^0-9]*$', 1) AS bigint)")
    counted = rows.select("host", "shape", number.alias("label_id"))
    if labels is None:
        counted = counted.withColumn("bad", F.lit(None).cast("int"))
    else:
        one = labels.where("label_id IS NOT NULL").groupBy("label_id").agg(F.max("bad").alias("bad"))
        # pages without a number meet no label and need not be dealt by one
        counted = counted.where("label_id IS NOT NULL").join(one, "label_id", "left").unionByName(counted.where("label_id IS NULL").withColumn("bad", F.lit(None).cast("int")))
    shapes = counted.groupBy("host", "shape").agg(F.count("*").alias("pages"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    shapes = stored(shapes)
    tree = template_tree(shapes, how)
    templates = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    prior = shapes.agg(F.coalesce(F.try_divide(F.sum("bad"), F.sum("labelled")), F.lit(0.0)).alias("_prior"))
    scored = templates.join(F.broadcast(prior))  # one row
    share = (F.col("bad") + how.prior_pages * F.col("_prior")) / (F.col("labelled") + F.lit(how.prior_pages))
    scored = scored.select("host", "template", share.alias("bad_share"))
    by_shape = tree.select("host", "shape", "template").join(scored, ["host", "template"])
    out = rows.join(by_shape, ["host", "shape"], "left")
    decided = F.coalesce("_said", F.when(F.col("bad_share") >= how.reject, F.lit("block")).otherwise(F.lit("allow")))
    return out.select(page_id, "host", "path", "rule", "template", "bad_share", decided.alias("verdict"))
