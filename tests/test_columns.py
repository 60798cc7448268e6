import math

import pytest
from pyspark.sql import functions as F

from rillflow.functions import columns as C
from rillflow.operators import stats

c = F.col


def test_filters_keep_the_stated_sides(spark):
    df = spark.createDataFrame([(1.0, 4.0), (1.0, 5.0), (1.0, 6.0), (1.0, None)], "x double, k double")
    got = df.select(*[C.value_filter(c("x"), c("k"), op, 5.0).alias(op) for op in ("less_than", "greater_than", "equals")]).collect()
    assert [tuple(r) for r in got] == [(None, 1.0, 1.0), (None, None, None), (1.0, None, 1.0), (None, None, 1.0)]
    with pytest.raises(ValueError):
        C.value_filter(c("x"), c("k"), "near", 1)


def test_clip_blanks_instead_of_moving(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (2.0,), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in df.select(C.clip_to_null(C.no_nan(c("x")), 0, 1)).collect()] == [None, 0.0, None, None, None]
    assert [r[0] for r in df.select(C.clip_to_null(C.no_nan(c("x")), lo=0)).collect()] == [None, 0.0, 2.0, None, None]


def test_normalise_and_back(spark):
    df = spark.createDataFrame([(0.0,), (1.5,), (1000.0,), (None,)], "x double")
    for log in (True, False):
        for size in (0.0, 2.5):
            z = C.normalised(c("x"), F.lit(0.3), F.lit(size), F.lit(log))
            back = [r[0] for r in df.select(C.denormalised(z, F.lit(0.3), F.lit(size), F.lit(log))).collect()]
            assert back[3] is None and all(abs(a - b) < 1e-6 for a, b in zip(back, (0.0, 1.5, 1000.0), strict=False))


def test_encodings_of_missing_values(spark):
    df = spark.createDataFrame([("a", 5), (None, None)], "k string, b long")
    got = df.select(*C.one_hot(c("k"), "k", ["a", "b"]), *C.bit_columns(c("b"), "b", [0, 1, 2])).collect()
    assert [tuple(r) for r in got] == [(1.0, 0.0, 1, 0, 1), (0.0, 0.0, None, None, None)]
    with pytest.raises(ValueError):
        C.one_hot(c("k"), "k", [])


def test_mixture_of_one_part_is_a_log_normal(spark):
    df = spark.createDataFrame([([2.0], [0.5], [-7.0], 2.5)], "mu array<double>, s array<double>, p array<double>, y double")
    mean, std, nll = df.select(C.mixture_mean(c("mu"), c("s"), c("p"), 0.5, 0.25), C.mixture_std(c("mu"), c("s"), c("p"), 0.5, 0.25), C.mixture_nll(c("y"), c("mu"), c("s"), c("p"))).first()
    m, v = 2.0 * 0.5 + 0.25, (0.5 * 0.5) ** 2
    assert abs(mean - (math.exp(m + v / 2) - 1)) < 1e-9 and abs(std - math.sqrt(math.expm1(v) * math.exp(2 * m + v))) < 1e-9 and abs(nll - (0.5 + math.log(0.5) + 0.5 * math.log(2 * math.pi))) < 1e-9


def test_padding(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "x array<double>")
    assert tuple(df.select(C.padded(c("x"), 3), C.padding_mask(c("x"), 3)).first()) == ([1.0, 2.0, 1.0], [True, True, False])
    with pytest.raises(Exception, match="more than 1 values"):
        df.select(C.padded(c("x"), 1)).collect()


def test_dates_digits_and_lists(spark):
    df = spark.sql("SELECT timestamp'2020-01-01 12:00:00' AS noon, timestamp'2020-01-01 11:59:59' AS before, 74230900123L AS id, '[1, 2]' AS l")
    got = df.select(C.nearest_day(c("noon")), C.nearest_day(c("before")), C.reach_type(c("id")), C.region_code(c("id")), C.parsed_ids(c("l"))).first()
    assert (str(got[0]), str(got[1]), *got[2:]) == ("2020-01-02", "2020-01-01", 3, 74, [1, 2])


def test_projection_keeps_area(spark):
    df = spark.createDataFrame([(10.0, 50.0)], "lon double, lat double")
    x0, y0, x1, y1 = df.select(*C.equal_area(c("lon"), c("lat")), *C.equal_area(c("lon") + 0.01, c("lat") + 0.01)).first()
    phi, a, e2 = math.radians(50.005), 6378137.0, 0.08181919084262149**2
    w = math.sqrt(1 - e2 * math.sin(phi) ** 2)
    truth = (a / w * math.cos(phi)) * (a * (1 - e2) / w**3) * math.radians(0.01) ** 2
    assert abs((x1 - x0) * (y1 - y0) / truth - 1) < 1e-6


def test_merged_statistics_equal_direct_ones(spark):
    df = spark.createDataFrame([(i % 3, float(i) if i % 7 else None, math.nan if i % 5 == 0 else -float(i)) for i in range(60)], "basin int, a double, b double")
    direct = stats.partial_stats(df.withColumn("basin", F.lit(0)), "basin", ["a", "b"]).drop("basin")
    merged = stats.merged_stats(stats.partial_stats(df, "basin", ["a", "b"]))
    key = lambda t: sorted(tuple(x if x is None else (x if isinstance(x, str) else round(x, 6)) for x in r) for r in t.select("var", *stats.PARTIAL).collect())
    assert key(direct) == key(merged)
    known = stats.partial_stats(df.where("basin = 1"), "basin", ["a"])
    assert {(r.basin, r["var"]) for r in stats.partial_stats(df, "basin", ["a", "b"], known).collect()} == {(0, "a"), (2, "a"), (0, "b"), (1, "b"), (2, "b")}
