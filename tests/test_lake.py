import datetime as dt

import pytest
from pyspark.sql import functions as F

from rillflow.operators.clean import require_none
from rillflow.sources import lake
from rillflow.streaming import ingest

D = [dt.date(2020, 12, 30) + dt.timedelta(i) for i in range(5)]


def frame(spark, basin, rows, cols="subbasin string, date date, v double"):
    return lake.prepared([spark.createDataFrame(rows, cols)], basin)


def test_upsert_is_idempotent_and_grows_the_schema(spark, tmp_path):
    k = lake.Lake(spark, str(tmp_path))
    k.append(frame(spark, "b1", [("s1", D[0], 1.0), ("s1", D[3], 2.0)]), "a")
    k.append(frame(spark, "b2", [("s1", D[0], 9.0)]), "a")
    new = frame(spark, "b1", [("s1", D[0], None, 5), ("s2", D[4], 3.0, 6)], "subbasin string, date date, v double, w int")
    for _ in range(2):
        k.upsert(new, "a")
        got = sorted((r.basin, r.subbasin, r.date, r.v, r.w) for r in k.read("a").collect())
        assert got == [("b1", "s1", D[0], None, 5), ("b1", "s1", D[3], 2.0, None), ("b1", "s2", D[4], 3.0, 6), ("b2", "s1", D[0], 9.0, None)]
    with pytest.raises(ValueError):
        k.upsert(new.unionByName(new), "a")
    assert k.sources() == ["a"] and k.partitions("a") == [("b1", 2020), ("b1", 2021), ("b2", 2020)]


def test_overwrite_removes_years_that_are_gone(spark, tmp_path):
    k = lake.Lake(spark, str(tmp_path))
    k.append(frame(spark, "b1", [("s1", D[0], 1.0), ("s1", D[4], 2.0)]), "a")
    k.append(frame(spark, "b2", [("s1", D[4], 3.0)]), "a")
    k.overwrite(frame(spark, "b1", [("s1", D[0], 7.0)]), "a")
    assert sorted((r.basin, r.v) for r in k.read("a").collect()) == [("b1", 7.0), ("b2", 3.0)]


def test_reads_prune_and_bounds_are_included(spark, tmp_path):
    k = lake.Lake(spark, str(tmp_path))
    k.append(frame(spark, "b1", [("s1", d, float(i)) for i, d in enumerate(D)]), "a")
    df = k.read("a", basin="b1", subbasins=["s1"], start="2020-12-31", end="2021-01-01")
    assert sorted(r.v for r in df.collect()) == [1.0, 2.0]
    assert "year" in df._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]
    assert k.read("a", subbasins=["none"]).count() == 0
    k.insert_absent(frame(spark, "b1", [("s1", D[0], 50.0), ("s3", D[0], 60.0)]), "a")
    assert sorted(r.v for r in k.read("a").collect()) == [0.0, 1.0, 2.0, 3.0, 4.0, 60.0]
    before, after = k.compact("a")
    assert after <= before and k.read("a").count() == 6


def test_static_graph_and_guards(spark, tmp_path):
    k = lake.Lake(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        k.read_static()
    with pytest.raises(ValueError):
        k.write_static(spark.range(1))
    k.write_static(spark.createDataFrame([("s1", 1.0)], "subbasin string, area double"))
    assert k.read_static().count() == 1
    n = spark.createDataFrame([("b", 1), ("b", 2)], "basin string, node int")
    e = spark.createDataFrame([("b", 1, 2)], "basin string, src int, dst int")
    lake.graph_json(n, e).select("graph").coalesce(1).write.text(str(tmp_path / "g"))
    nodes, edges = lake.read_graph(spark, str(tmp_path / "g"))
    assert nodes.count() == 2 and [tuple(r) for r in edges.collect()] == [("1", "2")]
    with pytest.raises(ValueError):
        require_none(n, "sites that are not in the graph")
    lake.write_sites(spark.createDataFrame([("b", "s"), ("b", "s")], "basin string, subbasin string"), str(tmp_path / "sites"))
    assert lake.read_sites(spark, str(tmp_path / "sites")).count() == 1


def test_streams_give_what_batches_give(spark, tmp_path):
    rows = [("b1", "s1", dt.datetime(2020, 1, 1, 3), 0.5, 1.0), ("b1", "s1", dt.datetime(2020, 1, 1, 9), 0.1, 2.0), ("b1", "s2", dt.datetime(2020, 1, 2, 9), None, 3.0)]
    df = spark.createDataFrame(rows, "basin string, subbasin string, ts timestamp, u double, v double")
    df = df.withColumn("date", F.to_date("ts")).withColumn("year", F.year("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    k = lake.Lake(spark, str(tmp_path / "lake"))
    ingest.upsert_stream(stream, k, "a", str(tmp_path / "c1"), "ts").awaitTermination()
    assert sorted(r.v for r in k.read("a").collect()) == [2.0, 3.0]
    q = ingest.best_daily(stream, "subbasin", "ts", "u", "1 day").writeStream.outputMode("complete").format("memory").queryName("best").trigger(availableNow=True).start()
    q.awaitTermination()
    assert ("s1", 2.0) in {(r.subbasin, r.v) for r in spark.table("best").collect()}
