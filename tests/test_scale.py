"""Operators on hand-made cases: lake ids and zones, halo blocks, gauges and cycles, quantiles, coverage, curve."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rillflow.operators import features, graph, matching, metrics, samples, windows
from rillflow.plans import training
from rillflow.plans.tables import Tables
from rillflow.sources.lake import Lake, aligned, calendar, prepared

DAILY = "basin string, subbasin string, date string, x double"


def daily(spark, rows):
    return spark.createDataFrame(rows, DAILY).withColumn("date", F.to_date("date")).withColumn("year", F.year("date"))


def test_ids_keep_their_zeros(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    a, b = "01013500", "1013500"
    rows = [(a, "01", "2020-01-01", 1.0), (a, "02", "2020-01-01", 2.0), (a, "01", "2021-01-01", 3.0), (b, "01", "2020-01-01", 9.0), ("x=y/z", "01", "2020-01-01", 8.0)]
    lake.append(daily(spark, rows), "s")
    got = lambda **w: sorted((r.basin, r.subbasin, str(r.date), r.x) for r in lake.read("s", **w).collect())
    assert got(basin=a) == rows[:2] + rows[2:3] or sorted(rows[:3]) == got(basin=a)
    assert lake.partitions("s") == [(a, 2020), (a, 2021), (b, 2020), ("x=y/z", 2020)]
    lake.insert_absent(daily(spark, [(a, "01", "2020-01-01", 7.0), (a, "03", "2020-01-01", 7.0)]), "s")
    lake.upsert(daily(spark, [(a, "01", "2020-01-01", 5.0)]), "s")
    assert got(basin=a) == sorted([(a, "01", "2020-01-01", 5.0), *rows[1:3], (a, "03", "2020-01-01", 7.0)])
    before, after = lake.compact("s")
    assert after <= before and len(got()) == 6
    lake.export(["s"], spark.createDataFrame([(a, "01"), (a, "02")], "basin string, subbasin string"), "2020-01-01", "2020-01-02")
    cube = {(r.basin, r.subbasin, str(r.date)): r.s__x for r in lake.cube().collect()}
    assert cube == {(a, "01", "2020-01-01"): 5.0, (a, "01", "2020-01-02"): None, (a, "02", "2020-01-01"): 2.0, (a, "02", "2020-01-02"): None}
    assert [r.basin for r in lake.exported().collect()] == [a]
    lake.write_batch(daily(spark, [(a, "02", "2020-01-01", 4.0), (a, "02", "2020-01-02", 6.0)]).drop("year").withColumnRenamed("x", "s__x"))
    assert {r.s__x for r in lake.cube().where("subbasin = '02'").collect()} == {4.0, 6.0}
    lake.overwrite(daily(spark, [(a, "01", "2020-01-01", 0.0)]), "s")
    assert got(basin=a) == [(a, "01", "2020-01-01", 0.0)] and len(got(basin=b)) == 1
    lake.record(spark.createDataFrame([(a, "01", "s", True)], "basin string, subbasin string, source string, has_data boolean").withColumn("processed_at", F.current_timestamp()))
    left = [x.name for x in (tmp_path / "lake").iterdir()]
    assert not [x for x in left if x.startswith("_staged")] and spark.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled") == "true"


def test_two_rows_for_a_key_leave_nothing_behind(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    with pytest.raises(ValueError, match="two rows"):
        lake.upsert(daily(spark, [("a", "1", "2020-01-01", 1.0)] * 2), "s")
    assert list((tmp_path / "lake").iterdir()) == []


def test_days_are_utc_in_any_zone(spark):
    frame = spark.sql("SELECT '1' AS subbasin, TIMESTAMP'2020-01-01 02:00:00+00:00' AS date, 1.0 AS x")
    empty = spark.createDataFrame([], "subbasin string, date timestamp, gone double")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        r = prepared([empty, frame], "b").selectExpr("string(date) AS d", "year", "basin").first()
        assert tuple(r) == ("2020-01-01", 2020, "b") and "gone" not in prepared([empty, frame], "b").columns
        assert str(prepared([spark.sql("SELECT '1' AS subbasin, DATE'2020-01-01' AS date")], "b").first().date) == "2020-01-01"
        with pytest.raises(ValueError):
            prepared([empty], "b")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_sources_meet_in_one_shuffle(spark):
    one = lambda k: spark.createDataFrame([(i, i % 3, float(k)) for i in range(k, 9)], "subbasin int, date int, v double")
    df = aligned({f"s{k}": one(k) for k in range(5)})
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {(r.subbasin, r.date): tuple(r)[2:] for r in df.collect()} == {(i, i % 3): tuple(float(k) if i >= k else None for k in range(5)) for i in range(9)}


@pytest.mark.parametrize("length", [1, 3, 40])
def test_halo_blocks(spark, length):
    n = 100
    dense = spark.createDataFrame([(s, i, None if i % 7 == s else float(i)) for s in range(2) for i in range(n)], "s int, i int, v double").withColumn("date", F.date_add(F.lit("1969-12-01").cast("date"), F.col("i")))
    b = samples.halo_blocks(dense, ["s"], "date", ["v"], length)
    stored = b.agg(F.sum(F.size("d"))).first()[0]
    assert stored <= 2 * n * (1 + (length - 1) / max(2 * length, 16)) + 2 * length
    got = {(r.s, r.i): r.v_seq for r in samples.sequences(dense, "s", "date", ["v"], length).withColumn("i", F.date_diff("date", F.lit("1969-12-01").cast("date"))).collect()}
    assert got == {(s, i): [None if j % 7 == s else float(j) for j in range(i - length + 1, i + 1)] for s in range(2) for i in range(length - 1, n)}


def test_nodes_of_a_sample_are_found_by_number(spark):
    """Node 4 has no rows, node 2 none in the sample's block, 9 is no node of the basin; places do not follow ids."""
    days = [f"2020-01-{d:02}" for d in range(1, 29)]
    rows = [("b", n, d, float(100 * n + i)) for n in (1, 2, 3, 9) for i, d in enumerate(days) if n != 2 or i < 8]
    dense = spark.createDataFrame(rows, "basin string, subbasin long, date string, v double").withColumn("date", F.to_date("date"))
    index = spark.createDataFrame([(0, "b", "2020-01-20"), (1, "b", "2020-01-03"), (2, "b", "2021-01-01")], "sample_id long, basin string, end_date string").withColumn("end_date", F.to_date("end_date"))
    places = spark.createDataFrame([("b", 3, 0), ("b", 1, 1), ("b", 4, 2), ("b", 2, 3)], "basin string, node long, place long")
    out = features.assembled(index, dense, places, ["v"], ["v"], spark.createDataFrame([(1,), (4,)], "subbasin long"), 2, days=2)
    assert "element_at" not in out._jdf.queryExecution().analyzed().toString()  # which looks through a map from its start, for each node
    got, none = {r.sample_id: r for r in out.collect()}, [None, None]
    assert [r.subbasin for r in got.values()] == [[3, 1, 4, 2]] * 3
    assert got[0].x_v == [[318.0, 319.0], [118.0, 119.0], none, none] and got[0].y_v == [[None], [119.0], [None], [None]]
    assert got[1].x_v == [[301.0, 302.0], [101.0, 102.0], none, [201.0, 202.0]] and got[2].x_v == [none] * 4
    even = features.assembled(index, dense.where("subbasin IN (1, 3)"), places.where("node IN (1, 3)"), ["v"], ["v"], places.selectExpr("node AS subbasin"), 2, days=2)
    assert {r.sample_id: r.x_v for r in even.collect()} == {0: got[0].x_v[:2], 1: got[1].x_v[:2], 2: [none] * 2}


def test_nested_arrays_as_one_tensor():
    v = features.tensor(pa.array([[[1.0, None], [3.0, 4.0]]]))
    assert v.shape == (1, 2, 2) and np.isnan(v[0, 0, 1]) and v[0, 1].tolist() == [3.0, 4.0]
    assert features.tensor(pa.array([True, False])).tolist() == [True, False]
    with pytest.raises(ValueError):
        features.tensor(pa.array([[1.0], [2.0, 3.0]]))


def test_samples_do_not_depend_on_the_order_of_events(spark, tmp_path):
    """Sums of three and more values a day have other last digits in another order."""
    src, got = "/root/testdata/sf0.001", []
    for k, order in enumerate((F.col("event_id"), -F.col("event_id"))):
        os.makedirs(tmp_path / f"{k}")
        for t in ("customer", "supplier"):
            os.symlink(f"{src}/{t}.parquet", tmp_path / f"{k}" / f"{t}.parquet")
        events = spark.read.parquet(f"{src}/events.parquet").withColumn("event_type", F.lit("view"))
        events.coalesce(1).sortWithinPartitions(order).write.parquet(str(tmp_path / f"{k}" / "events.parquet"))
        got.append(sorted((r.batch, r.x_sat) for r in training.collated_samples(Tables(spark, str(tmp_path / f"{k}"))).collect()))
    assert str(got[0]) == str(got[1])


def test_a_batch_that_is_too_large(spark):
    s = spark.createDataFrame([(0, "b", "2020-01-01", ["n"] * 4, [[1.0]] * 4, [[2.0]] * 4, [], [])], "sample_id long, basin string, end_date string, subbasin array<string>, x_v array<array<double>>, y_v array<array<double>>, src array<long>, dst array<long>")
    b = spark.createDataFrame([(0, 0, 0, 0)], "shard int, batch int, slot int, sample_id long")
    ok = features.collated_samples(b, s, 5, {"a": ["v"]}, ["v"]).first()
    assert ok.real == 4 and ok.x_a == [[[1.0]] * 4 + [[0.0]]] and ok.src == [4] * 5 and ok.node_mask == [True] * 4 + [False]
    with pytest.raises(Exception, match="more than 3"):
        features.collated_samples(b, s, 3, {"a": ["v"]}, ["v"]).collect()


def test_gauges_of_a_chain_and_nested_ones(spark):
    n = spark.range(151).select(F.col("id").alias("node"))
    e = spark.range(150).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    g = spark.createDataFrame([(10,), (50,), (149,)], "node long")
    want = {i: (next((x for x in (10, 50, 149) if x >= i), None), 149 if i <= 149 else None) for i in range(151)}
    assert {r.node: (r.first, r.last) for r in graph.gauges_below(n, e, g).collect()} == want
    kept = graph.pruned(n, e, g, 5).collect()
    assert {r.node for r in kept} == set(range(150)) and {(r.outlet, r.size, r.original) for r in kept} == {(149, 150, 150)}


def test_cycles_with_tails_and_branches(spark):
    pairs = [(1, 2), (2, 3), (3, 1), (9, 8), (8, 1), (20, 21), (30, 30)]
    n = spark.createDataFrame([(i,) for i in {x for p in pairs for x in p} | {99}], "node long")
    on = lambda p: {r.node for r in graph.on_cycles(n, spark.createDataFrame(p, "src long, dst long")).collect()}
    assert on(pairs) == {1, 2, 3, 30} and on([*pairs, (9, 20), (2, 21)]) == {1, 2, 3, 30} and on([(20, 21)]) == set()


def test_quantiles_by_rank(spark):
    rnd = random.Random(1)
    v = [rnd.choice([rnd.random(), 0.5, None, float("nan")]) for _ in range(500)]
    df = spark.createDataFrame([(x, i) for i, x in enumerate(v)], "v double, i int").repartition(5)
    there = [x for x in v if x is not None and x == x]
    q = {f"q{k}": k / 100 for k in (0, 25, 50, 67, 100)}
    r = windows.exact_quantiles(df, {n: (F.col("v"), x) for n, x in q.items()} | {"i": (F.col("i"), 0.5), "none": (F.lit(None).cast("double"), 0.5)}).first()
    assert all(abs(r[n] - np.quantile(there, x)) < 1e-12 for n, x in q.items()) and r["i"] == 249.5 and r["none"] is None


def test_metrics_of_flat_observations(spark):
    flat = [("a", 2.0, 2.0 + i % 2) for i in range(10)] + [("b", 2.0, 2.0)] * 10
    r = {x.k: x for x in metrics.skill(spark.createDataFrame(flat, "k string, obs double, pred double"), ["k"]).collect()}
    assert (r["a"].R2, r["b"].R2) == (0.0, 1.0) and r["a"].NSE is None
    assert all(r[k][m] is None for k in "ab" for m in ("KGE", "kge_r", "kge_alpha", "kge_beta"))


def test_covered_areas(spark):
    rings = {"box": ([(0.5, 0.5), (3.5, 0.5), (3.5, 2.25), (0.5, 2.25)], 3 * 1.75), "diamond": ([(2, 0), (4, 2), (2, 4), (0, 2)], 8.0), "back": ([(0, 2), (2, 4), (4, 2), (2, 0)], 8.0), "dent": ([(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)], 10.0)}
    df = spark.createDataFrame([(z, [{"x": float(a), "y": float(b)} for a, b in r]) for z, (r, _) in rings.items()], "zone string, ring array<struct<x:double,y:double>>")
    cells = spark.createDataFrame([(10 * i + j, i + 0.5, j + 0.5) for i in range(-1, 6) for j in range(-1, 6)], "cell int, x double, y double")
    w = matching.coverage_weights(cells, df, 1.0).collect()
    for z, (_, area) in rings.items():
        assert abs(sum(r.w for r in w if r.zone == z) - area) < 1e-9
    at = {(r.zone, r.cell): r.w for r in w}
    assert abs(at["box", 0] - 0.25) < 1e-12 and abs(at["diamond", 1] - 0.5) < 1e-12 and abs(at["diamond", 11] - 1) < 1e-12 and ("diamond", 0) not in at


def test_shares_are_worked_out_once_a_place(spark):
    text = matching.covered(F.col("ring"), *[F.col(c) for c in ("x0", "y0", "x1", "y1")])._jc.toString()
    assert text.count("least") < 20  # each bound value once, not once a use
    ring = [{"x": float(a), "y": float(b)} for a, b in [(0.25, 0), (20, 0), (20, 1), (0.25, 1)]]
    rings = spark.createDataFrame([("r", ring)], "zone string, ring array<struct<x:double,y:double>>")
    cells = spark.createDataFrame([(i, 0.5 + i % 4 * 10, 0.5) for i in range(40)], "cell int, x double, y double")
    got = matching.coverage_weights(cells, rings, 1.0)
    assert {(r.cell, r.zone): r.w for r in got.collect()} == {(i, "r"): {0: 0.75, 1: 1.0}[i % 4] for i in range(40) if i % 4 < 2}


def test_curve_and_batches(spark):
    grid = spark.createDataFrame([(16 * i + j, i, j) for i in range(16) for j in range(16)], "id int, x int, y int")
    path = sorted((r.k, r.x, r.y) for r in grid.withColumn("k", matching.hilbert_key(F.col("x"), F.col("y"), 4)).collect())
    assert [k for k, _, _ in path] == list(range(256)) and all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(path, path[1:], strict=False))
    got = matching.spatial_batches(grid.select("id", F.col("x").cast("double").alias("x"), F.lit(3.0).alias("y")), 50).groupBy("batch").count().collect()
    assert sorted(tuple(r) for r in got) == [(0, 50), (1, 50), (2, 50), (3, 50), (4, 50), (5, 6)]
    assert calendar(spark, "2020-01-01", "2020-01-03").count() == 3
