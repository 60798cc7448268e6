import pytest
from pyspark.sql import functions as F

from rillflow.operators import graph, matching, metrics, samples, windows


def nodes(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "node long")


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def test_chain_of_150_and_two_roots(spark):
    e = edges(spark, [(i, i + 1) for i in range(150)] + [(200, 201)])
    got = {r.node: (r.outlet, r.depth) for r in graph.outlets(nodes(spark, [*range(151), 200, 201]), e).collect()}
    assert got[0] == (150, 150) and got[150] == (150, 0) and got[200] == (201, 1)


def test_cycles(spark):
    n, e = nodes(spark, range(6)), edges(spark, [(0, 1), (1, 2), (2, 0), (3, 0), (2, 4)])
    assert {r.node for r in graph.on_cycles(n, e).collect()} == {0, 1, 2}
    assert {r.node for r in graph.outlets(n, e).where("outlet IS NULL").collect()} >= {0, 1, 3}
    got = {r.node: r.component for r in graph.components(n, e).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 5}


def test_edges_drop_self_loops_and_missing(spark):
    df = spark.createDataFrame([(1, 2), (2, 2), (3, 0), (4, None)], "node long, nextdown long")
    assert [tuple(r) for r in graph.edges_from_nextdown(df, "node", "nextdown").collect()] == [(1, 2)]


def test_first_gauge_and_slots(spark):
    e = edges(spark, [(1, 3), (2, 3), (9, 3), (3, 4)])
    got = {r.node: r.gauge for r in graph.first_gauge_below(nodes(spark, [1, 2, 3, 4, 9]), e, nodes(spark, [3, 4])).collect()}
    assert got == {1: 3, 2: 3, 3: 3, 9: 3, 4: 4}
    places = spark.createDataFrame([(1, 0), (2, 1), (9, 7)], "node long, place long")
    assert {r.node: (r.inflow, r.mask) for r in graph.inflow_slots(e.where("dst = 3"), places).collect()} == {3: ([0, 1], [True, True])}


def test_metrics_of_too_few_and_of_flat_sites(spark):
    rows = [("few", 1.0, 1.0)] * 8 + [("flat", 2.0, float(i + 1)) for i in range(9)] + [("fit", float(i + 1), float(i + 1)) for i in range(9)] + [("fit", 0.0, 5.0), ("fit", None, 5.0)]
    got = {r.s: r for r in metrics.skill(spark.createDataFrame(rows, "s string, obs double, pred double"), ["s"]).collect()}
    assert got["few"].NSE is None and got["few"].num_obs == 8
    assert got["flat"].NSE is None and got["fit"].NSE == 1.0 and got["fit"].num_obs == 9 and abs(got["fit"].KGE - 1) < 1e-9 and abs(got["fit"].r - 1) < 1e-9


def test_mad_of_zero_rejects_and_softmax_sums_to_one(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 1.0), ("a", 9.0), ("b", None), ("b", 700.0), ("b", 800.0), ("c", None)], "g string, v double")
    assert not any(r.ok for r in windows.robust_mask(df.where("g = 'a'"), "g", "v", 3.0).collect())
    sums = {r.g: r.s for r in windows.segment_softmax(df, "g", "v").groupBy("g").agg(F.sum("weight").alias("s")).collect()}
    assert abs(sums["a"] - 1) < 1e-9 and abs(sums["b"] - 1) < 1e-9 and sums["c"] == 0


def test_packing_holds_each_sample_once_within_the_budget(spark):
    df = spark.createDataFrame([(i, i % 9 + 1) for i in range(500)], "sample_id long, nodes long")
    got = samples.packed_batches(df, 12, shards=5).toPandas()
    assert sorted(got.sample_id) == list(range(500)) and got.groupby(["shard", "batch"]).nodes.sum().max() <= 11
    with pytest.raises(ValueError):
        samples.packed_batches(df, 9)


def test_joins_in_space(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 10.0)], "id long, x double, y double")
    b = spark.createDataFrame([(1, 0.9, 0.0), (2, -0.9, 0.0), (3, 1.5, 0.0)], "rid long, rx double, ry double")
    assert sorted((r.id, r.rid) for r in matching.buffer_join(a, b, 1.0, "left").collect() if r.rid) == [(1, 1), (1, 2)]
    assert matching.buffer_join(a, b, 1.0, "left").count() == 3
    assert sorted(r.rid for r in matching.nearest_join(a, b, 2.0).collect()) == [1, 2]
    cells = spark.createDataFrame([(i, 0.5 + i, 0.5) for i in range(4)], "cell long, x double, y double")
    ring = spark.sql("SELECT 'z' AS zone, array(named_struct('x', 0D, 'y', 0D), named_struct('x', 2.5D, 'y', 0D), named_struct('x', 2.5D, 'y', 1D), named_struct('x', 0D, 'y', 1D)) AS ring")
    assert {r.cell: round(r.w, 6) for r in matching.coverage_weights(cells, ring, 1.0).collect()} == {0: 1.0, 1: 1.0, 2: 0.5}
    line = spark.sql("SELECT array(named_struct('x', 0D, 'y', 0D), named_struct('x', 10D, 'y', 0D)) AS line, 2.5D AS x, 3D AS y UNION ALL SELECT array(named_struct('x', 0D, 'y', 0D), named_struct('x', 10D, 'y', 0D)), -4D, 0D")
    assert sorted(round(r[0], 6) for r in line.select(matching.point_on_line()).collect()) == [0.01, 0.25]


def test_every_query_has_its_columns_in_both_engines():
    from rillflow.plans import registry

    assert set(registry.ORACLES) <= set(registry.QUERIES) and len(registry.QUERIES) > 55
