"""Each registered query against its SQL twin on the small tables."""

import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from rillflow.operators import metrics, stats, windows
from rillflow.plans import reaches, regions, registry, training

assert training and regions and reaches  # their queries are in the registry too
SF = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 3) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return str(x) if hasattr(x, "isoformat") else x


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    found = con.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    df = registry.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*names).collect()), key=str)
    assert got == sorted((tuple(plain(x) for x in r) for r in found.fetchall()), key=str)


def test_batch_predictions_round_halves_as_their_sql(spark):
    """All four digits, where test_query_equals_its_sql looks at three."""
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    names = ["basin", "subbasin", "date", "pred_k"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({registry.ORACLES['batch_predictions']})").fetchall()
    got = registry.QUERIES["batch_predictions"](spark, SF).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    halves = spark.createDataFrame([(127.38205,), (122.71285,), (-0.00005,), (None,), (float("nan"),), (2.0,)], "x double")
    want = [con.execute("SELECT round(?::DOUBLE, 4)", [r.x]).fetchone()[0] for r in halves.collect()]
    assert str([r.x for r in registry.rounded_as_sql(halves, ["x"]).collect()]) == str(want)


def test_metrics_by_hand(spark):
    """Ten pairs, worked out from the definitions in plain Python."""
    o = [1.0, 2.0, 4.0, 3.0, 5.0, 7.0, 6.0, 9.0, 8.0, 10.0]
    p = [1.5, 2.0, 3.0, 4.0, 6.0, 6.0, 7.0, 8.0, 9.0, 12.0]
    df = spark.createDataFrame([("a", x, y, 0.5) for x, y in zip(o, p, strict=True)] + [("a", 3.0, 3.0, None), ("b", 1.0, 2.0, 0.1)], "k string, obs double, pred double, std double")
    ten = df.where("std IS NOT NULL")
    mo, mp = sum(o) / 10, sum(p) / 10
    errors = sorted(abs((y - x - (mp - mo)) / mo) for x, y in zip(o, p, strict=True))
    at = 0.67 * 9
    want = errors[int(at)] + (at - int(at)) * (errors[int(at) + 1] - errors[int(at)])
    sse = sum((x - y) ** 2 for x, y in zip(o, p, strict=True))
    for keys in (["k"], []):
        r = metrics.skill(ten.where("k = 'a'"), keys).first()
        assert abs(r["sigE"] - want) < 1e-9 and abs(r["rRMSE"] - 100 * math.sqrt(sse / 10) / mp) < 1e-9
    prob = {r.k: r for r in metrics.probabilistic_skill(df, ["k"], "obs", "pred", "std").collect()}
    total = sum((x - mo) ** 2 for x in o)
    assert abs(prob["a"].nse_prob - (1 - (sse + 10 * 0.25) / total)) < 1e-9 and abs(prob["a"].msess - (1 - (sse + 2.5) / 2 / total)) < 1e-9
    assert prob["b"].nse_prob is None
    loss = metrics.losses(ten.unionByName(spark.createDataFrame([("c", 2.0, 2.0, 0.0), ("b", None, 1.0, 0.0)], ten.schema)), "obs", "pred", "k").first()
    a, b = sse / 10 / (math.sqrt(total / 10) + 0.1) ** 2, 0.5 / 0.1**2  # of b one row of two counts; c is left out
    assert abs(loss.nse_loss - (a + b) / 2) < 1e-9


def test_rows_before_with_ties(spark):
    values = [5, 1, 3, 3, 9, 1, 1, 7] * 5
    df = spark.createDataFrame([(x,) for x in values], "v long").repartition(4)
    got = {r.v: (r.b, r.b_ties) for r in windows.rows_before(df, [F.col("v")], "b").collect()}
    assert got == {v: (sum(x < v for x in values), values.count(v)) for v in set(values)}


def test_scales_of_flat_and_ranged_variables(spark):
    df = spark.createDataFrame([("b", 3.0), ("b", 3.0)], "basin string, x double")
    s = stats.scale(stats.merged_stats(stats.partial_stats(df, "basin", ["x"])), log=["x"]).first()
    assert abs(s["scale"] - 1e-6) < 1e-7
    r = stats.static_scale(spark.createDataFrame([(1.0,), (5.0,)], "x double"), ["x"], ranged=["x"]).first()
    assert (r["offset"], r["scale"]) == (1.0, 4.0)
