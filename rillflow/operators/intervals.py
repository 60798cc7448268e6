"""Forests as intervals: each node's subtree is a run of preorder numbers, so that "upstream of" is a join of ranges and no walk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.operators.graph import _doubled, cut

#: Preorder numbers of one key of the range join.
BUCKET = 1024


def running_total(df: DataFrame, by: list[Column], weight: str, name: str) -> DataFrame:
    """df with name, the sum of weight over all rows that sort before a row; by should tell rows apart.

    Rows are dealt by range, summed within a range and moved by the ranges' totals, of which there is one a partition; no task holds the whole order, nor all rows of one key.
    """
    keyed = df.withColumn("_k", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(by)]))
    parts = cut(keyed.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_k").withColumn("_p", F.spark_partition_id()))
    totals = parts.groupBy("_p").agg(F.sum(weight).alias("_s"))
    moved = totals.select("_p", (F.sum("_s").over(Window.orderBy("_p")) - F.col("_s")).alias("_o"))
    earlier = F.sum(weight).over(Window.partitionBy("_p").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1))
    return parts.withColumn("_b", F.coalesce(earlier, F.lit(0))).join(F.broadcast(moved), "_p").select(*df.columns, (F.col("_b") + F.col("_o")).alias(name))


def rooted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, parent, outlet, depth and size, the nodes of its subtree with itself, of each node of a forest. Nodes that lead to a cycle go.

    Pointers are doubled. In round k a node takes what its pointer knows of outlet and depth, and gives what it has counted, its descendants of less than 2 ** k steps, to the node 2 ** k steps below:
    rounds are the logarithm of the depth, and counts are added before they are shuffled. A pointer that is left when it spans more steps than there are nodes is on a cycle.
    """
    at = nodes.select("node").distinct().join(edges.select(F.col("src").alias("node"), F.col("dst").alias("parent")), "node", "left")
    at = cut(at.select("node", "parent", F.col("parent").alias("ptr"), F.coalesce("parent", "node").alias("outlet"), F.col("parent").isNotNull().cast("long").alias("depth"), F.lit(1).cast("long").alias("size")))
    for _ in range(at.count().bit_length() + 1):
        if not at.where("ptr IS NOT NULL").take(1):
            break
        more = at.where("ptr IS NOT NULL").groupBy(F.col("ptr").alias("node")).agg(F.sum("size").alias("_more"))
        far = at.select(F.col("node").alias("ptr"), F.col("ptr").alias("_p"), F.col("outlet").alias("_o"), F.col("depth").alias("_d"))
        at = at.join(more, "node", "left").join(far, "ptr", "left")
        at = cut(at.select("node", "parent", F.col("_p").alias("ptr"), F.coalesce("_o", "outlet").alias("outlet"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"), (F.col("size") + F.coalesce("_more", F.lit(0))).alias("size")))
    return at.where("ptr IS NULL").drop("ptr")


def forest_intervals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, outlet, depth, first and size of each node of a forest: its subtree is the nodes of the outlet numbered first to first + size - 1.

    Numbers are preorder, siblings by id: a node's is the sum of the offsets on its way down, an offset one more than the sizes of earlier siblings. Nodes that lead to a cycle go.
    Nodes without edges are outlets of themselves. An edge table with two ways down from a node is an error.
    """
    if edges.groupBy("src").count().where("count > 1").take(1):
        raise ValueError("a node has two ways down")
    tree = cut(rooted(nodes, edges))
    below = running_total(tree.where("parent IS NOT NULL").select("node", "parent", "size"), [F.col("parent"), F.col("node")], "size", "_before")
    least = below.groupBy("parent").agg(F.min("_before").alias("_least"))
    offset = below.join(least, "parent").select("node", (F.col("_before") - F.col("_least") + 1).alias("_off"))
    at = tree.join(offset, "node", "left").select("node", F.col("parent").alias("ptr"), F.coalesce("_off", F.lit(0)).cast("long").alias("first"))
    rounds = (tree.agg(F.max("depth")).first()[0] or 0).bit_length() + 1
    first = _doubled(at, {"first": lambda own, behind: own + F.coalesce(behind, F.lit(0))}, rounds)
    return tree.select("node", "outlet", "depth", "size").join(first.select("node", "first"), "node").select("node", "outlet", "depth", "first", "size")


def upstream_in_forest(intervals: DataFrame, starts: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """start, node and depth of all nodes upstream of the starts (node), themselves included, from forest_intervals().

    One equi-join on runs of bucket numbers: a start goes to the runs that its interval touches, of which the first and last alone hold other nodes, so what is looked at is the result and at most two runs a start.
    """
    key = lambda c: F.floor(c / F.lit(bucket)).cast("long")
    last = F.col("first") + F.col("size") - 1
    s = intervals.join(starts.select("node").distinct(), "node", "left_semi")
    s = s.select(F.col("node").alias("start"), "outlet", F.col("first").alias("_a"), last.alias("_z"), F.col("depth").alias("_d"), F.explode(F.sequence(key(F.col("first")), key(last))).alias("_b"))
    hit = intervals.withColumn("_b", key(F.col("first"))).join(s, ["outlet", "_b"]).where(F.col("first").between(F.col("_a"), F.col("_z")))
    return hit.select("start", "node", (F.col("depth") - F.col("_d")).alias("depth"))


def lies_upstream(intervals: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (low, high) with upstream: whether high is upstream of low, or low itself; missing where either is in no tree."""
    a = intervals.select(F.col("node").alias("low"), F.col("outlet").alias("_o"), F.col("first").alias("_f"), F.col("size").alias("_s"))
    b = intervals.select(F.col("node").alias("high"), F.col("outlet").alias("_p"), F.col("first").alias("_g"))
    within = (F.col("_o") == F.col("_p")) & (F.col("_g") >= F.col("_f")) & (F.col("_g") < F.col("_f") + F.col("_s"))
    return pairs.join(a, "low", "left").join(b, "high", "left").select(*pairs.columns, within.alias("upstream"))
