"""River graphs as edge tables: edge src -> dst flows downstream. Outlets double pointers, so they end after the logarithm of the depth; upstream sets go level by level."""

from __future__ import annotations

import itertools
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir. Only a local master may do without: it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def edges_from_nextdown(nodes: DataFrame, node: str, nextdown: str) -> DataFrame:
    """src, dst; 0, missing and self references are no edges."""
    return nodes.where((F.col(nextdown) != 0) & (F.col(nextdown) != F.col(node))).select(F.col(node).alias("src"), F.col(nextdown).alias("dst"))


def renamed_nodes(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges with nodes renamed by (old, new)."""
    a, b = names.select(F.col("old").alias("src"), F.col("new").alias("_a")), names.select(F.col("old").alias("dst"), F.col("new").alias("_b"))
    return edges.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("_a", "src").alias("src"), F.coalesce("_b", "dst").alias("dst"))


def outlets(nodes: DataFrame, edges: DataFrame, length: str | None = None) -> DataFrame:
    """node, outlet, depth (edges to it) and distance (sum of the edges' length) of each node of a forest; nodes on or above a cycle have no outlet."""
    step = edges.select("src", "dst", (F.col(length) if length else F.lit(1.0)).cast("double").alias("d"))
    at = nodes.select("node").join(step, F.col("node") == F.col("src"), "left").select("node", F.col("dst").alias("ptr"), F.lit(1).cast("long").alias("depth"), F.coalesce("d", F.lit(0.0)).alias("distance"))
    at = at.withColumn("depth", F.when(F.col("ptr").isNull(), 0).otherwise(F.col("depth"))).withColumn("ptr", F.coalesce("ptr", "node"))
    at = cut(at)
    for _ in range(nodes.count().bit_length() + 1):  # doubling passes any depth in so many rounds; what still moves then is on a cycle
        far = at.select(F.col("node").alias("ptr"), F.col("ptr").alias("_p"), F.col("depth").alias("_d"), F.col("distance").alias("_x"))
        new = cut(at.join(far, "ptr", "left").select("node", F.coalesce("_p", "ptr").alias("new"), "ptr", (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"), (F.col("distance") + F.coalesce("_x", F.lit(0.0))).alias("distance")))
        moved = bool(new.where("new <> ptr").take(1))
        at = new.select("node", F.col("new").alias("ptr"), "depth", "distance")
        if not moved:
            break
    ends = nodes.select("node").join(edges.select(F.col("src").alias("node")), "node", "left_anti").select(F.col("node").alias("ptr"), F.lit(True).alias("_end"))
    at = at.join(ends, "ptr", "left")
    ok = F.col("_end")
    return at.select("node", F.when(ok, F.col("ptr")).alias("outlet"), F.when(ok, F.col("depth")).alias("depth"), F.when(ok, F.col("distance")).alias("distance"))


def upstream(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """start, node and depth of all nodes upstream of the starts (node), themselves included; level by level, least depth. For any graph; of forests intervals.upstream_in_forest() finds them without a walk."""
    level = starts.select(F.col("node").alias("start"), "node", F.lit(0).cast("long").alias("depth"))
    seen = level = cut(level.distinct())
    for d in itertools.count(1):
        level = level.join(edges, F.col("node") == F.col("dst")).select("start", F.col("src").alias("node"), F.lit(d).cast("long").alias("depth")).distinct()
        level = cut(level.join(seen.select("start", "node"), ["start", "node"], "left_anti"))
        if not level.take(1):
            break
        seen = cut(seen.unionByName(level))
    return seen


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and component (its least node), for any graph: least labels travel along edges and jump to their labels' labels."""
    both = cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    lab = cut(nodes.select("node", F.col("node").alias("label")))
    while True:
        near = both.join(lab, F.col("dst") == F.col("node")).groupBy("src").agg(F.min("label").alias("m"))
        new = lab.join(near, F.col("node") == F.col("src"), "left").select("node", "label", F.least("label", F.coalesce("m", "label")).alias("m"))
        jump = new.select(F.col("node").alias("m"), F.col("m").alias("mm"))
        new = cut(new.join(jump, "m", "left").select("node", "label", F.least("m", F.coalesce("mm", "m")).alias("new")))
        if not new.where("new <> label").take(1):
            return new.select("node", F.col("new").alias("component"))
        lab = new.select("node", F.col("new").alias("label"))


def _doubled(at: DataFrame, marks: dict, rounds: int) -> DataFrame:
    """at (node, ptr, marks) after pointer doubling: each round a node takes its pointer's pointer, and marks of what lies behind it; marks: name -> (own, behind) -> new. Ends when no pointer is left."""
    at = cut(at)
    for _ in range(rounds):
        if not at.where("ptr IS NOT NULL").take(1):
            break
        far = at.select(F.col("node").alias("ptr"), F.col("ptr").alias("_p"), *[F.col(m).alias(f"_{m}") for m in marks])
        at = cut(at.join(far, "ptr", "left").select("node", F.col("_p").alias("ptr"), *[f(F.col(m), F.col(f"_{m}")).alias(m) for m, f in marks.items()]))
    return at


def on_cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes on cycles, not those that only lead to one.

    Where each node has one way down, as in a river, pointers are doubled until they span more steps than there are nodes: where they end then is on a cycle, and each node of a cycle is such an end.
    Other graphs are peeled: sources and sinks go until there is none.
    """
    e = cut(edges.select("src", "dst").distinct())
    if not e.groupBy("src").count().where("count > 1").take(1):
        at = e.select(F.col("src").alias("node"), F.col("dst").alias("ptr"))
        ends = _doubled(at, {}, e.count().bit_length() + 1)
        return nodes.select("node").join(ends.where("ptr IS NOT NULL").select(F.col("ptr").alias("node")).distinct(), "node", "left_semi")
    while True:
        kept = e.join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst")
        kept = cut(kept)
        if kept.count() == e.count():
            return nodes.join(e.select(F.col("src").alias("node")).distinct(), "node", "left_semi").select("node")
        e = kept


def gauges_below(nodes: DataFrame, edges: DataFrame, gauges: DataFrame) -> DataFrame:
    """node, first and last: the first gauge at or below each node, and the last one strictly below it, else itself if it is one. Missing where there is none.

    A forest's pointers are doubled with two marks, the nearest and the furthest gauge of the steps that a pointer spans; rounds are the logarithm of the depth. On a cycle, last is some gauge of it.
    """
    mark = gauges.select(F.col("node"), F.col("node").alias("first")).distinct()
    at = nodes.select("node").join(mark, "node", "left").join(edges.select(F.col("src").alias("node"), F.col("dst").alias("ptr")), "node", "left").withColumn("last", F.col("first"))
    marks = {"first": lambda own, behind: F.coalesce(own, behind), "last": lambda own, behind: F.coalesce(behind, own)}
    return _doubled(at.select("node", "ptr", "first", "last"), marks, nodes.count().bit_length() + 1).select("node", "first", "last")


def pruned(nodes: DataFrame, edges: DataFrame, gauges: DataFrame, least: int = 10) -> DataFrame:
    """Nodes upstream of any gauge, with the outlet of what is left of their basin, which is its last gauge, the number of its nodes, and the outlet that it had; basins of fewer nodes go, and so do nodes that lead to a cycle."""
    keep = gauges_below(nodes, edges, gauges).where("first IS NOT NULL").select("node", F.col("last").alias("outlet"))
    whole = outlets(nodes, edges).where("outlet IS NOT NULL").select("node", F.col("outlet").alias("original"))
    big = keep.groupBy("outlet").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    return keep.join(big, "outlet").join(whole, "node").select("node", "outlet", "size", "original")


def first_gauge_below(nodes: DataFrame, edges: DataFrame, gauges: DataFrame) -> DataFrame:
    """node and gauge: the first gauge at or below each node; nodes without one are left out."""
    return gauges_below(nodes, edges, gauges).where("first IS NOT NULL").select("node", F.col("first").alias("gauge"))


def require_one_outlet(nodes: DataFrame, edges: DataFrame) -> None:
    """An error, with some of them, if there are components without an outlet or with several."""
    ends = nodes.select("node").join(edges.select(F.col("src").alias("node")), "node", "left_anti").withColumn("_end", F.lit(1))
    per = components(nodes, edges).join(ends, "node", "left").groupBy("component").agg(F.count("_end").alias("outlets")).where("outlets <> 1")
    if rows := per.orderBy("component").take(5):
        raise ValueError(f"components with other than one outlet: {[tuple(r) for r in rows]}")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    i = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_in"))
    o = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out"))
    d = nodes.select("node").join(i, "node", "left").join(o, "node", "left").fillna(0)
    return d.withColumns({"source": F.col("n_in") == 0, "sink": F.col("n_out") == 0})


def graph_summary(nodes: DataFrame, edges: DataFrame, distance: str | None = None, area: str | None = None, flags: tuple[str, ...] = ()) -> DataFrame:
    """One row: nodes, edges, components, density (edges over ordered pairs of nodes), sources, sinks, the least, largest and mean distance of edges, the mean area of nodes, and n_<flag>, the nodes with each flag."""
    n, x = F.count("*"), F.lit(None).cast("double")
    own = nodes.agg(n.alias("nodes"), F.avg(area or x).alias("mean_area"), *[F.count_if(F.coalesce(F.col(f).cast("boolean"), F.lit(False))).alias(f"n_{f}") for f in flags])
    d = F.col(distance) if distance else x
    between = edges.agg(n.alias("edges"), F.min(d).alias("distance_min"), F.max(d).alias("distance_max"), F.avg(d).alias("distance_mean"))
    ends = degrees(nodes, edges).agg(F.count_if("source").alias("sources"), F.count_if("sink").alias("sinks"))
    parts = components(nodes, edges).agg(F.count_distinct("component").alias("components"))
    one = own.crossJoin(between).crossJoin(ends).crossJoin(parts)  # a row each
    pairs = (F.col("nodes") * (F.col("nodes") - 1)).cast("double")
    return one.withColumn("density", F.when(pairs > 0, F.col("edges") / F.when(pairs > 0, pairs)).otherwise(0.0))


def numbered(nodes: DataFrame, basin: str) -> DataFrame:
    """Places 0..n-1 by id in each basin."""
    return nodes.withColumn("place", (F.row_number().over(Window.partitionBy(basin).orderBy("node")) - 1).cast("long"))


def inflow_slots(edges: DataFrame, places: DataFrame, slots: int = 2) -> DataFrame:
    """Places of up to slots upstream nodes of each node, with a mask."""
    up = edges.join(places.select(F.col("node").alias("src"), "place"), "src").groupBy(F.col("dst").alias("node")).agg(F.sort_array(F.collect_list("place")).alias("all"))
    s = F.slice("all", 1, slots)
    return up.select("node", F.concat(s, F.array_repeat(F.lit(0).cast("long"), F.lit(slots) - F.size(s))).alias("inflow"), F.transform(F.sequence(F.lit(1), F.lit(slots)), lambda i: i <= F.size("all")).alias("mask"))


def upstream_sum(values: DataFrame, edges: DataFrame, value: str = "value") -> DataFrame:
    """Each receiver's sum over its senders; 0 without any."""
    s = edges.join(values.select(F.col("node").alias("src"), F.col(value).alias("_v")), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("_v").alias("_s"))
    return values.select("node").join(s, "node", "left").select("node", F.coalesce("_s", F.lit(0.0)).alias(value))


def khop_mix(values: DataFrame, edges: DataFrame, weights: list[float], value: str = "value") -> DataFrame:
    """Weighted sum of the value and its 1..k-hop upstream sums."""
    out, hop = values.select("node", (F.col(value) * weights[0]).alias("mix")), values
    for w in weights[1:]:
        hop = upstream_sum(hop, edges, value)
        out = out.join(hop.select("node", (F.col(value) * w).alias("_h")), "node").select("node", (F.col("mix") + F.col("_h")).alias("mix"))
    return out
