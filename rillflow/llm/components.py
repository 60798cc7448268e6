"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import shuffle_partitions, written


def _few(df: DataFrame, parts: int | None) -> DataFrame:
    return df if parts is None else df.coalesce(parts)


def _star(edges: DataFrame, large: bool, parts: int | None) -> DataFrame:
    """One star step on edges (u, v), u > v: links the larger (or smaller) neighbours of each node with its smallest one.

    The smallest neighbours are written first, so that both sides of the join are plain tables, whose hot nodes Spark can split.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = written(_few(both.groupBy("u").agg(F.min("v").alias("m")), parts), "least").withColumn("m", F.least("m", "u"))
    out = both.join(least, "u")
    if large:
        out = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return written(_few(out.where("u <> v").distinct(), parts), "edges")


def components(links: DataFrame, task_rows: int | None = None) -> DataFrame:
    """doc and component (its smallest doc) of each node of the links (a, b). With task_rows tables are written by tasks of about so many rows, where else each shuffle partition makes a file, however small."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    parts = None if task_rows is None else min(shuffle_partitions(links.sparkSession), -(-edges.count() // task_rows) or 1)
    mark = None
    while True:
        edges = _star(_star(edges, True, parts), False, parts)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    stars = edges.groupBy("u").agg(F.min("v").alias("v"))
    return written(_few(stars.select(F.col("u").alias("doc"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("doc"), F.col("v").alias("component")).distinct()), parts), "components")
