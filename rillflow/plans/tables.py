"""Domain tables derived from the given ones, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def obs(self) -> DataFrame:
        """subbasin, date, source, value, flags from events."""
        e = self.raw("events")
        return e.select(
            "event_id", F.col("user_id").alias("subbasin"), F.col("ts").cast("timestamp").alias("ts"), F.to_date("ts").alias("date"), F.col("event_type").alias("source"), "value", F.get_json_object("props", "$.k").cast("long").alias("flags")
        )

    def daily(self) -> DataFrame:
        """One value a subbasin and day."""
        return self.obs().groupBy("subbasin", "date").agg(F.round(F.avg("value"), 6).alias("value"))

    def reach(self) -> DataFrame:
        """node, nextdown: a forest over the subbasins of events."""
        r = self.raw("events").select(F.col("user_id").alias("node")).distinct()
        return r.withColumn("nextdown", F.when(F.col("node") >= 5, F.floor(F.col("node") / 5).cast("long")))

    def edges(self) -> DataFrame:
        return self.reach().where("nextdown IS NOT NULL AND nextdown <> node").select(F.col("node").alias("src"), F.col("nextdown").alias("dst"))

    def pred_obs(self) -> DataFrame:
        """subbasin, basin, date, obs, pred, std from orders and their lines."""
        lines = self.raw("lineitem").groupBy("l_orderkey").agg(
            F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("pred"), F.stddev_pop("l_extendedprice").alias("std")
        )
        o = self.raw("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).join(self.raw("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        return o.select(F.col("o_custkey").alias("subbasin"), F.col("c_nationkey").alias("basin"), F.to_date("o_orderdate").alias("date"), "o_orderkey", F.col("o_totalprice").alias("obs"), "pred", "std")

    def swot(self) -> DataFrame:
        """reach_id, ts, wse, width, slope, wse_u, q from lineitem."""
        c = {"l_partkey": "reach_id", "l_shipdate": "ts", "l_extendedprice": "wse", "l_quantity": "width", "l_tax": "slope", "l_discount": "wse_u", "l_linenumber": "q", "l_orderkey": "key"}
        return self.raw("lineitem").select(*[F.col(a).alias(b) for a, b in c.items()])

    def attrs(self) -> DataFrame:
        return self.raw("part").select(F.col("p_partkey").alias("subbasin"), F.col("p_retailprice").alias("area"), F.col("p_brand").alias("brand"), F.col("p_size").alias("bits"))

    def points(self) -> DataFrame:
        e = self.raw("embeddings")
        return e.select(F.col("vec_id").alias("id"), (F.get("embedding", F.lit(0)).cast("double") * 100).alias("x"), (F.get("embedding", F.lit(1)).cast("double") * 100).alias("y"))

    def mixture(self) -> DataFrame:
        e = self.raw("embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("e"))
        return e.select("id", F.slice("e", 1, 8).alias("mu"), F.transform(F.slice("e", 9, 8), lambda v: F.abs(v) + 0.1).alias("sigma"), F.slice("e", 17, 8).alias("log_pi"), F.get("e", F.lit(24)).alias("y"))


OBS = "SELECT event_id, user_id AS subbasin, ts, CAST(ts AS DATE) AS date, event_type AS source, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS flags FROM events"
DAILY = f"SELECT subbasin, date, round(avg(value), 6) AS value FROM ({OBS}) GROUP BY ALL"
REACH = "SELECT DISTINCT user_id AS node, CASE WHEN user_id >= 5 THEN user_id // 5 END AS nextdown FROM events"
EDGES = f"SELECT node AS src, nextdown AS dst FROM ({REACH}) WHERE nextdown IS NOT NULL AND nextdown <> node"
PRED_OBS = """SELECT o_custkey AS subbasin, c_nationkey AS basin, CAST(o_orderdate AS DATE) AS date, o_orderkey, o_totalprice AS obs, pred, std FROM orders
  JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS pred, stddev_pop(l_extendedprice) AS std FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
  JOIN customer ON c_custkey = o_custkey"""
SWOT = "SELECT l_partkey AS reach_id, l_shipdate AS ts, l_extendedprice AS wse, l_quantity AS width, l_tax AS slope, l_discount AS wse_u, l_linenumber AS q, l_orderkey AS key FROM lineitem"
ATTRS = "SELECT p_partkey AS subbasin, p_retailprice AS area, p_brand AS brand, p_size AS bits FROM part"
POINTS = "SELECT vec_id AS id, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y FROM embeddings"
MIXTURE = """SELECT vec_id AS id, embedding[1:8]::DOUBLE[] AS mu, list_transform(embedding[9:16]::DOUBLE[], lambda v: abs(v) + 0.1) AS sigma, embedding[17:24]::DOUBLE[] AS log_pi,
  embedding[25]::DOUBLE AS y FROM embeddings"""
