import datetime as dt

import pytest
from pyspark.sql import functions as F

from rillflow.operators import features, ingest, samples, stats
from rillflow.sources import lake

D = [dt.date(2020, 12, 30) + dt.timedelta(i) for i in range(6)]


def test_export_of_new_basins_and_batches(spark, tmp_path):
    k = lake.Lake(spark, str(tmp_path))
    for basin in ("b1", "b2"):
        k.append(lake.prepared([spark.createDataFrame([("s1", D[1], 1.0), ("s1", D[3], 2.0)], "subbasin string, date date, v double")], basin), "a")
    k.append(lake.prepared([spark.createDataFrame([("s1", D[3], 7)], "subbasin string, date date, w int")], "b1"), "c")
    sites = spark.createDataFrame([("b1", "s1"), ("b1", "s2"), ("b2", "s1")], "basin string, subbasin string")
    k.export(["a", "c"], sites.where("basin = 'b1'"), "2020-12-30", "2021-01-02")
    first = sorted(map(tuple, k.cube().where("basin = 'b1'").select("subbasin", "date", "a__v", "c__w").collect()))
    assert first == [("s1", D[0], None, None), ("s1", D[1], 1.0, None), ("s1", D[2], None, None), ("s1", D[3], 2.0, 7), *[("s2", d, None, None) for d in D[:4]]]
    k.overwrite(lake.prepared([spark.createDataFrame([("s1", D[1], 5.0)], "subbasin string, date date, v double")], "b1"), "a")
    k.export(["a", "c"], sites, "2020-12-30", "2021-01-02")
    assert {r.basin for r in k.exported().collect()} == {"b1", "b2"}
    assert k.cube().where("basin = 'b1' AND a__v = 2").count() == 1 and k.cube().where("basin = 'b2'").count() == 4
    batch = spark.createDataFrame([("b1", "s2", D[i], float(i), 1) for i in (2, 3, 4)], "basin string, subbasin string, date date, a__v double, new int")
    k.write_batch(batch)
    got = sorted(map(tuple, k.cube().where("basin = 'b1' AND subbasin = 's2'").select("date", "a__v", "new").collect()))
    assert got == [(D[0], None, None), (D[1], None, None), (D[2], 2.0, 1), (D[3], 3.0, 1)]
    assert k.cube().where("basin = 'b1' AND a__v = 2 AND subbasin = 's1'").count() == 1 and k.cube().count() == 12
    with pytest.raises(ValueError):
        k.write_batch(batch.where(F.col("date") != D[3]))
    with pytest.raises(ValueError):
        k.write_batch(batch.withColumn("subbasin", F.lit("s9")))


def test_scans_and_site_lists(spark, tmp_path):
    a = spark.createDataFrame([(1, -9.0, "x"), (2, 3.0, "y")], "reach_id long, wse double, more string")
    a.write.parquet(str(tmp_path / "r1"))
    a.drop("more").withColumn("reach_id", F.col("reach_id") + 10).write.parquet(str(tmp_path / "r2"))
    df = lake.scan(spark, [str(tmp_path / "r1"), str(tmp_path / "r2")], ["reach_id"], F.col("wse") != -9.0)
    assert sorted(r.reach_id for r in df.collect()) == [2, 12]
    assert "PushedFilters: [IsNotNull(wse), Not(EqualTo(wse,-9.0))]" in df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    for i in (1, 2):
        spark.createDataFrame([("001", "a", str(i)), ("002", None, "0")], "id string, b string, c string").write.option("header", "true").csv(str(tmp_path / f"c{i}"))
    assert [tuple(r) for r in lake.scan_csv(spark, [str(tmp_path / "c1"), str(tmp_path / "c2")], ["id", "b"]).collect()] == [("001", "a")]
    train, test = (spark.createDataFrame(x, "basin string, subbasin string") for x in ([("b", "2"), ("b", "1")], [("b", "2"), ("c", "3")]))
    assert sorted((r.basin, r.subbasins) for r in lake.sites_by_basin(train, test, "predict").collect()) == [("b", ["1", "2"]), ("c", ["3"])]
    assert [r.subbasins for r in lake.sites_by_basin(train, test, "train").collect()] == [["1", "2"]]
    lake.write_index(train, str(tmp_path / "index"))
    assert [r.value for r in spark.read.text(str(tmp_path / "index")).orderBy("value").collect()] == ["1", "2"]
    rows = spark.createDataFrame([("b", "s", D[0], None, None), ("b", "s", D[1], None, 1.0)], "basin string, subbasin string, date date, v double, w double")
    assert [r.date for r in lake.present(rows).collect()] == [D[1]]


def test_source_flags_fill_and_groups(spark):
    columns = {"a": ["x"], "b": ["y", "z"]}
    assert ingest.split_sources(columns, {"a": False, "b": True}) == ({"a": ["x"]}, {"b": ["y", "z"]})
    with pytest.raises(ValueError):
        ingest.split_sources(columns, {"a": False})
    with pytest.raises(TypeError):
        ingest.split_sources(columns, {"a": False, "b": 1})
    df = spark.createDataFrame([("a", None), ("a", 2.0), ("b", 3.0)], "k string, v double")
    assert sorted(r.v for r in ingest.filled(df, ["v"]).collect()) == [0.0, 2.0, 3.0]
    out = ingest.by_group(df, ["k"], lambda p: p.assign(v=p["v"].sum()).head(1), "k string, v double")
    assert sorted(map(tuple, out.collect())) == [("a", 2.0), ("b", 3.0)]


def test_batches_beyond_their_size_are_errors_and_scales_can_be_given(spark):
    b = spark.createDataFrame([(0, 0, 1)], "batch long, slot long, sample_id long")
    n = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (1, 2, 3.0)], "sample_id long, place long, value double")
    e = spark.createDataFrame([(1, 0, 1)], "sample_id long, src long, dst long")
    r = features.collated(b, n, e, 4).first()
    assert (r.real, r.value, r.src, r.dst, r.edge_mask) == (3, [1.0, 2.0, 3.0, 0.0], [0, 3, 3, 3], [1, 3, 3, 3], [True, False, False, False])
    with pytest.raises(Exception, match="more than 2"):
        features.collated(b, n, e, 2).collect()
    d = spark.createDataFrame([("b", "s", D[0], 1.0), ("b", "s", D[1], 3.0)], "basin string, subbasin string, date date, x double")
    f = features.Features(["x", "gone"])
    table, scales = features.feature_table(d, f, [("2020-12-30", "2020-12-31")])
    assert sorted((r.x, r.gone) for r in table.collect()) == [(-1.0, None), (1.0, None)]
    again, _ = features.feature_table(d, f, [("2020-12-31", "2020-12-31")], known=scales)
    assert [(r.x, r.gone) for r in again.collect()] == [(1.0, None)]


def test_resized_batches_have_their_first_entries(spark):
    b = spark.createDataFrame([(0, 0, 1), (0, 1, 2)], "batch long, slot long, sample_id long")
    n = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (2, 0, 3.0), (2, 1, 4.0)], "sample_id long, place long, value double")
    e = spark.createDataFrame([(1, 0, 1), (2, 0, 1)], "sample_id long, src long, dst long")
    r = features.collated(b, n, e, 3, resized=True).first()
    assert (r.real, r.value, r.graph_idx, r.node_mask) == (4, [1.0, 2.0, 3.0], [0, 0, 1], [True] * 3)
    assert (r.src, r.dst, r.edge_mask) == ([0, 2, 4], [1, 3, 4], [True, True, False])
    r = features.collated(b, n, e, 1, resized=True).first()
    assert (r.real, r.value, r.src, r.edge_mask) == (4, [1.0], [0], [True])


def test_predict_writes_rows_without_observations(spark, tmp_path):
    d = spark.createDataFrame([("b", 1.0, 2.0), ("b", None, 2.0), ("b", 1.0, None)], "k string, obs double, pred double")
    assert features.evaluated(d, "k", str(tmp_path / "p"), predict_only=True) is None
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    bulk, _ = features.evaluated(d, "k", str(tmp_path / "e"))
    assert bulk.first().num_obs == 1 and spark.read.parquet(str(tmp_path / "e")).count() == 1


def test_places_of_categories_and_shards(spark):
    df = spark.createDataFrame([(x,) for x in ("c", "a", None, "b", "a")], "v string").repartition(3)
    assert sorted(map(tuple, stats.categories(df, "v").collect())) == [(0, "a"), (1, "b"), (2, "c")]
    s = spark.range(1000).select(F.col("id").alias("sample_id"), (F.col("id") % 7 + 1).alias("nodes"))
    b = samples.packed_batches(s, 20, shard_rows=100)
    assert b.select("shard").distinct().count() == 10 and b.count() == 1000
    assert b.groupBy("shard", "batch").agg(F.sum("nodes").alias("n")).agg(F.max("n")).first()[0] <= 19
    assert samples.packed_batches(s.limit(0), 20).count() == 0
