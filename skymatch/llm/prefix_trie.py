"""A trie of conversation prefixes, and totals of its subtrees by message passing from the leaves.

`numbered` puts the turns of each conversation in order, `spliced` lets conversations begin with turns of others, `trie` makes the nodes. A node is a
distinct sequence of first turns; it is known by its depth and 128 bits, the exclusive or of hashes of its turns with their places, so a node's parent is found without looking at the conversation.

Subtree totals travel by leaf peeling. Every node sends its total to its parent once its counter of children that haven't is 0. Between a node and the child
that most conversations go on to, the sum needs no message, so what is peeled are the paths that such children make, each with a counter of the paths that hang from it: a path
of which n conversations are members hangs from one with 2 n or more, hence log2(conversations) + 1 rounds are enough, however long conversations are. A round is one job
over the paths that aren't finished. Inside a path, sums are a window over its nodes.

No window, and no other group, holds all turns of a conversation or all nodes of a path: they go by parts of PART turns, with a second window over the parts' sums.
Members' ids are joined to texts of at most PART ids before they are shuffled, and each task hashes its nodes' texts as they pass.

Nulls: a null role or text is empty, a null turn comes first, rows without conv_id belong to no conversation. Turns of equal number stand in the order of the first 64
characters of role and text, then of a digest of both; repeated rows are turns like others. An empty table gives no node, not even a root. Other columns are ignored, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Turns, nodes or ids that a group holds at most.
PART = 4096


def running(df: DataFrame, group: list[str], part: str, order: list[Column], values: dict[str, Column], total: Callable[[Column], Column], add: Callable[[Column, Column], Column], one_part: bool = False) -> DataFrame:
    """df with the running totals of values within groups, by order. Parts, ascending, cut a group where it is cut by order; df is read twice. one_part: no group is known to have several, so nothing is carried between them."""
    inside = Window.partitionBy(*group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if one_part:
        return df.withColumns({n: total(v).over(inside) for n, v in values.items()})
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*group, part).agg(*(total(v).alias(f"_{n}") for n, v in values.items()), F.lit(True).alias("_more"))
    carried = sums.select(*group, part, *(total(F.col(f"_{n}")).over(before).alias(f"_{n}") for n in values), F.lag("_more").over(Window.partitionBy(*group).orderBy(part)).alias("_more")).where("_more")
    out = df.withColumns({n: total(v).over(inside) for n, v in values.items()}).join(carried, [*group, part], "left")
    return out.withColumns({n: F.coalesce(add(F.col(n), F.col(f"_{n}")), F.col(n), F.col(f"_{n}")) for n in values}).drop("_more", *(f"_{n}" for n in values))


def numbered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, pos (from 1), digest (of role and text), chars (code points of the text): a row for each turn. The result is stored."""
    who, what = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.left(who, F.lit(64)).alias("role"), F.left(what, F.lit(64)).alias("text"),
        F.md5(F.concat(F.length(who).cast("string"), F.lit(":"), who, what).cast("binary")).alias("digest"), F.length(what).cast("long").alias("chars"),
    )
    order = [F.col("turn").asc_nulls_first(), "role", "text", "digest"]
    rows = stored(rows)  # the ranges are found by a look of their own, which should read no text
    equal = rows.groupBy(*rows.columns).agg(F.count("*").alias("times"))
    ranges = stored(equal.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()))
    last = running(ranges, ["conv_id"], "part", order, {"last": F.col("times")}, F.sum, lambda a, b: a + b)
    # equal turns, however many, in blocks, so that no array of them all is made
    blocks = last.withColumn("first", F.col("last") - F.col("times")).withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / PART), F.floor((F.col("last") - 1) / PART))))
    places = F.sequence(F.greatest("first", F.col("block") * PART) + 1, F.least("last", (F.col("block") + 1) * PART))
    return stored(blocks.select("conv_id", F.explode(places).alias("pos"), "digest", "chars"))


def spliced(positions: DataFrame, base: Column, shared: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt: the first `shared` turns (at most `most`) of conversation `base` (all if fewer, none if absent), then the own turns after the first `shared`. Both are expressions over conv_id.

    Returns positions as from numbered, and conv_id, length of all conversations, also of those left without turns.
    """
    own = positions.groupBy("conv_id").agg(F.max("pos").alias("n"))
    plan = own.select("conv_id", "n", base.alias("base"), shared.cast("long").alias("shared"))
    plan = plan.join(own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left").withColumn("head", F.least("shared", F.coalesce("base_n", F.lit(0))))
    plan = stored(plan.select("conv_id", "base", "shared", "head", (F.col("head") + F.greatest(F.col("n") - F.col("shared"), F.lit(0))).alias("length")))
    heads = positions.where(F.col("pos") <= most).withColumnRenamed("conv_id", "base")
    lent = plan.join(heads, "base").where(F.col("pos") <= F.col("head")).select("conv_id", "pos", "digest", "chars")
    kept = positions.join(plan, "conv_id").where(F.col("pos") > F.col("shared")).select("conv_id", (F.col("pos") - F.col("shared") + F.col("head")).alias("pos"), "digest", "chars")
    return lent.unionByName(kept), plan.select("conv_id", "length")


def hashed(ids: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """depth, k1, k2, ends_sha256 of rows (depth, k1, k2, ids) that come with a node's rows one after another: SHA-256 of the ids, comma-joined."""
    node, h, out = None, None, []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["depth", "k1", "k2", "ends_sha256"])

    for rows in ids:
        for *key, text in zip(*(c.to_pylist() for c in rows.columns)):
            if key == node:
                h.update(b"," + text.encode())
                continue
            if node:
                out.append((*node, h.hexdigest()))
            node, h = key, hashlib.sha256(text.encode())
        if len(out) >= 10_000:
            yield batch()
            out = []
    if node:
        out.append((*node, h.hexdigest()))
        yield batch()


def ends(paths: DataFrame) -> DataFrame:
    """depth, k1, k2, ends_sha256 of nodes where conversations end: SHA-256 of their ids, ascending, comma-joined."""
    chunks = paths.where("last").groupBy("depth", "k1", "k2", F.floor(F.col("conv_id") / PART).alias("chunk")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    dealt = chunks.repartition("depth", "k1", "k2").sortWithinPartitions("depth", "k1", "k2", "chunk")
    return dealt.select("depth", "k1", "k2", "ids").mapInArrow(hashed, "depth long, k1 long, k2 long, ends_sha256 string")


def peeled(paths: DataFrame) -> DataFrame:
    """Of paths (path, parent_path, parent, saved), the stored rows with saved and leaves of all that hangs from them. One round for each level of paths."""
    children = paths.where(F.col("parent_path").isNotNull()).groupBy(F.col("parent_path").alias("path")).agg(F.count("*").alias("waiting"))
    left = stored(paths.join(children, "path", "left").select("path", "parent_path", "parent", "saved", F.lit(1).cast("long").alias("leaves"), F.coalesce("waiting", F.lit(0)).alias("waiting")))
    finished = []
    while True:
        finished.append(left.where("waiting = 0"))
        rest = left.where("waiting > 0")
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, finished).drop("waiting")
        sent = finished[-1].groupBy(F.col("parent_path").alias("path")).agg(F.sum("saved").alias("_saved"), F.sum("leaves").alias("_leaves"), F.count("*").alias("_sent"))
        none = F.lit(0)
        left = stored(
            rest.join(sent, "path", "left").select(
                "path", "parent_path", "parent", (F.col("saved") + F.coalesce("_saved", none)).alias("saved"),
                (F.col("leaves") + F.coalesce("_leaves", none)).alias("leaves"), (F.col("waiting") - F.coalesce("_sent", none)).alias("waiting"),
            )
        )


def trie(positions: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of conversations (positions: conv_id, pos, digest, chars; lengths: conv_id, length).

    conv_id, the smallest member; depth; parent_conv_id, that of the parent; n_convs, members; n_children; n_leaves, childless nodes of the subtree, the node
    included; saved_tokens, summed over the subtree, (n_convs - 1) times the characters of a node's last turn; ends_sha256 of the members that end here.
    """
    turns = positions.join(lengths, "conv_id").select("conv_id", F.col("pos").alias("depth"), "chars", (F.col("pos") == F.col("length")).alias("last"), *(F.xxhash64(F.lit(seed), "pos", "digest").alias(n) for seed, n in ((1, "h1"), (2, "h2"))))
    zero = F.lit(0).cast("long")
    roots = lengths.select("conv_id", zero.alias("depth"), zero.alias("chars"), (F.col("length") == 0).alias("last"), zero.alias("h1"), zero.alias("h2"))
    steps = stored(turns.unionByName(roots).withColumn("part", F.floor(F.col("depth") / PART)))
    short = steps.where("part > 0").isEmpty()  # then no conversation and no path has two parts
    paths = stored(running(steps, ["conv_id"], "part", [F.col("depth")], {"k1": F.col("h1"), "k2": F.col("h2")}, F.bit_xor, lambda a, b: a.bitwiseXOR(b), short))

    node = ["depth", "k1", "k2"]
    made = paths.groupBy(*node).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.max("h1").alias("h1"), F.max("h2").alias("h2"))
    nodes = stored(made.select("conv_id", *node, "n_convs", ((F.col("n_convs") - 1) * F.col("chars")).alias("own"), F.col("k1").bitwiseXOR(F.col("h1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("h2")).alias("p2")))
    # the heavy child goes on with most members; of several, with the smallest id
    below = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    below = below.agg(F.count("*").alias("n_children"), F.max(F.struct("n_convs", F.bitwise_not("conv_id").alias("c"))).alias("heavy"))
    above = stored(nodes.select(*node, F.col("conv_id").alias("parent_conv_id")).join(below, node).select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), "parent_conv_id", "n_children", F.bitwise_not("heavy.c").alias("heavy")))
    linked = nodes.join(above.drop("n_children"), ["depth", "p1", "p2"], "left").withColumn("light", ~F.col("conv_id").eqNullSafe(F.col("heavy")))
    linked = stored(linked.drop("heavy", "p1", "p2").join(above.select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), "n_children"), node, "left"))

    # the head of a node's path: the last light node that its conversation has come through
    light = linked.where("light").select(*node, F.struct("depth", F.col("conv_id").alias("c")).alias("at"))
    headed = stored(paths.select("conv_id", "part", *node).join(light, node, "left").select("conv_id", "part", "depth", "at"))
    heads = running(headed, ["conv_id"], "part", [F.col("depth")], {"path": F.col("at")}, F.max, lambda a, b: F.greatest(a, b), short)
    placed = stored(linked.join(heads.select("conv_id", "depth", "path"), ["conv_id", "depth"]).withColumn("id", F.struct("depth", F.col("conv_id").alias("c"))))

    own = placed.groupBy("path").agg(F.sum("own").alias("saved"))
    hung = placed.where("light").select(F.col("path"), F.when(F.col("depth") > 0, F.struct((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("c"))).alias("parent"))
    hung = hung.join(placed.select(F.col("id").alias("parent"), F.col("path").alias("parent_path")), "parent", "left")
    done = peeled(own.join(hung, "path"))

    sent = done.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("id")).agg(F.sum("saved").alias("in_saved"), F.sum("leaves").alias("in_leaves"))
    totals = stored(placed.join(sent, "id", "left").withColumns({"saved": F.col("own") + F.coalesce("in_saved", zero), "leaves": F.coalesce("in_leaves", zero), "part": -F.floor(F.col("depth") / PART)}).drop("in_saved", "in_leaves", "id", "own"))
    out = running(totals, ["path"], "part", [F.desc("depth")], {"saved_tokens": F.col("saved"), "n_leaves": F.col("leaves")}, F.sum, lambda a, b: a + b, short)
    return out.join(ends(paths), node, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), (F.col("n_leaves") + 1).alias("n_leaves"), "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
