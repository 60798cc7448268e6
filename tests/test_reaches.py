"""Reach samples, geometry, chunks, densities, screens and records on hand-made cases."""

import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from rillflow.functions import columns as C
from rillflow.operators import clean, features, graph, matching, metrics, samples, stats, windows
from rillflow.sources import lake

SHAPE = ("h", "w", "s")
SCALES = {"h": (1.0, 2.0, False), "w": (0.5, 1.0, True), "s": (0.0, 0.0, False)}


def reaches(spark, rows, **k):
    df = spark.createDataFrame(rows, "site string, day int, h double, w double, s double, y double")
    return {r.site: r for r in samples.reach_samples(df, "site", "day", ["h", "w", "s"], ["y"], SHAPE, SCALES, k.pop("size", 40), **k).collect()}


def natural(h, w, s):
    return h * 2 + 1, math.expm1(w + 0.5), s


def mask(xs, limit):
    logs = [math.log1p(x + abs(min(xs))) for x in xs]
    mid = statistics.median(logs)
    mad = statistics.median(abs(v - mid) for v in logs)
    return [mad > 0 and 0.6745 * (v - mid) / mad < limit for v in logs]


def test_reach_samples_against_brute_force(spark):
    rnd = random.Random(5)
    rows = [("a", d, rnd.gauss(0, 1), rnd.uniform(0, 3), rnd.choice([0.0, 1e-4, 2e-4, -1e-5]), rnd.choice([None, 1.0 * d])) for d in range(60)]
    rows += [("a", 60, 400.0, 1.0, 1e-4, 5.0), ("b", 0, 1.0, 1.0, 1e-4, 1.0)]
    rows += [("c", d, rnd.gauss(0, 1), 1.0 + d / 10, 1e-4, 1.0) for d in range(20)] + [("c", 20, 0.0, None, 1e-4, 1.0)]  # a missing width: no mask
    rows += [("d", d, rnd.gauss(0, 1), 1.0 + d / 10, 1e-4, 1.0) for d in range(12)] + [("d", 12, float("nan"), 1.0, 1e-4, 1.0), ("d", 13, 1.0, 1.0, 1e-4, None)]
    got = reaches(spark, rows, limit=3.0)
    assert set(got) == {"a", "d"}
    for site in got:
        days = [r for r in rows if r[0] == site and r[5] is not None and not math.isnan(r[2])]
        shape = [natural(*r[2:5]) for r in days]
        ok = [w > 0 and s > 0 and x and y for (_, w, s), x, y in zip(shape, mask([h for h, _, _ in shape], 3.0), mask([w for _, w, _ in shape], 3.0), strict=True)]
        kept = [(r, n) for r, n, k in zip(days, shape, ok, strict=True) if k]
        r, pad = got[site], 40 - len(kept)
        assert r.n == len(kept) and list(r["mask"]) == [1] * len(kept) + [0] * pad
        assert r.x == [list(k[2:5]) for k, _ in kept] + [[1.0] * 3] * pad and r.y == [[k[5]] for k, _ in kept] + [[1.0]] * pad
        for x, n in zip(r.hws, [n for _, n in kept] + [(1.0,) * 3] * pad, strict=True):
            assert x == pytest.approx(n)


def test_reach_samples_too_long_and_empty(spark):
    rows = [("a", d, math.sin(d), 1 + math.cos(d), 1e-4, 1.0) for d in range(30)]
    with pytest.raises(Exception, match="more than the size"):
        reaches(spark, rows, size=12)
    assert reaches(spark, []) == {}


def test_deviation_of_plain_and_log_variables(spark):
    one = spark.range(1)
    std = lambda *a: one.select(C.denormalised_std(F.lit(0.2), F.lit(0.4), F.lit(0.1), F.lit(2.0), *a)).first()[0]
    lognormal = lambda m, s: math.sqrt((math.exp(s * s) - 1) * math.exp(2 * m + s * s))
    assert std() == std(F.lit(True)) == pytest.approx(lognormal(0.5, 0.8))
    assert std(F.lit(True), False) == pytest.approx(lognormal(0.3, 0.4)) and std(F.lit(False)) == pytest.approx(0.8)
    with pytest.raises(ValueError, match="kind"):
        C.require_plain(["area", "kind"], ["kind"])
    df = spark.createDataFrame([("b", "s", dt.date(2020, 1, 1), 1.0)], "basin string, subbasin string, date date, kind double")
    with pytest.raises(ValueError, match="kind"):
        features.feature_table(df, features.Features(numeric=["kind"], one_hot={"kind": [1.0]}), [("2020-01-01", "2020-01-02")])


def test_manning_soft_keeps_dry_reaches(spark):
    df = spark.createDataFrame([(1.0, 10.0, -5.0, 1e-4), (1e6, 10.0, 1.0, 1e-4), (1.0, 0.0, 1.0, 1e-4), (1.0, 10.0, 1.0, -1e-4)], "a double, w double, d double, s double")
    got = [r[0] for r in df.select(C.manning_soft(*[F.col(c) for c in "awds"], F.lit(0.03))).collect()]
    q = lambda a, w, s: a ** (5 / 3) * w ** (-2 / 3) * math.sqrt(s) / 0.03
    assert got[0] == pytest.approx(q(1e-6 + math.log1p(math.exp(-49.0)), 10.0, 1e-4)) and got[1] == pytest.approx(q(1e6 + 10, 10.0, 1e-4)) and got[2:] == [None, None]


def test_days_in_another_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        r = spark.sql("SELECT timestamp'2020-01-01 02:00:00Z' AS t").select(C.utc_day(F.col("t")).alias("d"), C.epoch_days(C.utc_day(F.col("t"))).alias("n")).first()
        assert (r.d, r.n) == (dt.date(2020, 1, 1), 18262)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


POINT = "array<struct<x:double,y:double>>"


def xy(*points):
    return [{"x": float(a), "y": float(b)} for a, b in points]


def test_lines(spark):
    bent = xy((0, 0), (3, 0), (3, 4))
    rows = [(bent, xy((0, 1), (9, 9)), 0.5), (bent, xy((3, 5)), 0.0), (bent, None, 1.0), (xy((2, 2), (2, 2)), xy((0, 0)), 0.3), (xy((7, 7)), xy((0, 0)), 0.3), (xy((0, 0), (0, 0), (4, 0)), None, 0.25), (None, None, 0.5)]
    df = spark.createDataFrame(rows, f"line {POINT}, below {POINT}, share double")
    got = df.select(C.oriented(F.col("line"), F.col("below")).alias("o"), C.along(F.col("line"), F.col("share")).alias("p"), C.middle_vertex(F.col("line")).alias("m")).collect()
    plain = lambda p: p and (p.x, p.y)
    assert [r.o and plain(r.o[0]) for r in got] == [(3, 4), (0, 0), (0, 0), (2, 2), (7, 7), (0, 0), None]
    assert [plain(r.p) for r in got] == [(3, 0.5), (0, 0), (3, 4), None, None, (1, 0), None]
    assert [plain(r.m) for r in got] == [(3, 0), (3, 0), (3, 0), (2, 2), (7, 7), (0, 0), None]


def test_centroids(spark):
    far = 1e7
    rings = [xy((0, 0), (4, 0), (4, 2), (0, 2)), xy((0, 0), (4, 0), (4, 2), (0, 2), (0, 0)), xy((0, 2), (4, 2), (4, 0), (0, 0)), xy((0, 0), (4, 0), (8, 0)), xy((3, 5)), xy((far, far), (far + 3, far), (far, far + 3)), [], None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rings)], f"i int, ring {POINT}")
    got = [r.c and (r.c.x, r.c.y) for r in df.select("i", C.centroid(F.col("ring")).alias("c")).orderBy("i").collect()]
    assert got == [(2, 1), (2, 1), (2, 1), (4, 0), (3, 5), (far + 1, far + 1), None, None]


def test_chunks_of_the_largest_groups_first(spark):
    df = spark.createDataFrame([(g, i) for g, n in (("a", 2), ("b", 5), ("c", 5), ("d", 1)) for i in range(n)], "g string, i int").repartition(5)
    got = {(r.g, r.i): r.chunk for r in windows.numbered_chunks(df, "g", "i", 2).collect()}
    assert [got["b", 0], got["b", 2], got["b", 4], got["c", 0], got["c", 4], got["a", 1], got["d", 0]] == [0, 1, 2, 3, 5, 6, 7]
    assert len(got) == 13 and windows.numbered_chunks(df.limit(0), "g", "i", 2).count() == 0


def test_cumulative_density_of_odd_values(spark):
    df = spark.createDataFrame([(x, 2) for x in (0.0, 1.0, 1.0, 10.0, None, float("nan"), float("inf"), float("-inf"))] + [(99.0, 1), (99.0, None)], "x double, n int")
    got = metrics.cumulative_density(df, "x", 10, "n").orderBy("bin").collect()
    assert [r.density for r in got] == [0.25] + [0.75] * 8 + [1.0] and [r.edge for r in got] == [float(i) for i in range(1, 11)]
    flat = metrics.cumulative_density(spark.createDataFrame([(3.0,)] * 4, "x double"), "x", 4).orderBy("bin").collect()
    assert [(r.edge, r.density) for r in flat] == [(2.75, 0.0), (3.0, 0.0), (3.25, 1.0), (3.5, 1.0)]
    assert metrics.cumulative_density(df.limit(0), "x").count() == 0


def test_graph_summary_of_few_nodes(spark):
    n = spark.createDataFrame([(1, True), (2, None), (3, False)], "node long, gauge boolean")
    e = spark.createDataFrame([(1, 2)], "src long, dst long")
    r = graph.graph_summary(n, e, flags=("gauge",)).first()
    assert (r.nodes, r.edges, r.components, r.sources, r.sinks, r.n_gauge, r.mean_area, r.distance_mean) == (3, 1, 2, 2, 2, 1, None, None) and r.density == pytest.approx(1 / 6)
    none = graph.graph_summary(n.limit(0), e.limit(0)).first()
    assert (none.nodes, none.edges, none.components, none.density) == (0, 0, 0, 0.0)


def test_statistics_of_missing_basins_are_an_error(spark):
    parts = stats.partial_stats(spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 9.0)], "basin string, x double"), "basin", ["x"])
    basins = lambda *names: spark.createDataFrame([(n,) for n in names], "basin string")
    r = stats.merged_stats(parts, basins("a", "b", "b")).first()
    assert (r["count"], r["sum"], r["max"]) == (2, 4.0, 3.0)
    with pytest.raises(ValueError, match="z"):
        stats.merged_stats(parts, basins("a", "z"))


def test_grid_weights_at_the_tolerance(spark):
    grid = spark.createDataFrame([(1, 0.1, 0.1), (2, 0.2, 0.1), (3, 0.3, 0.1), (4, None, 0.1)], "cell int, x double, y double")
    w = spark.createDataFrame([(0.1, 0.1095, 5.0), (0.0999, 0.1001, 6.0), (0.1995, 0.1, 7.0), (0.311, 0.1, 8.0)], "x double, y double, w double")
    assert {r.cell: r.w for r in matching.grid_weights(w, grid).collect()} == {1: 5.0, 2: 7.0, 3: None, 4: None}


def test_boxes_by_squares(spark):
    rnd = random.Random(3)
    pts = [(i, rnd.uniform(-5, 5), rnd.uniform(-5, 5)) for i in range(200)]
    boxes = [(i, x, x + rnd.uniform(0, 4), y, y + rnd.uniform(0, 4)) for i, x, y in pts[:40]] + [(99, 2.0, 1.0, 0.0, 1.0)]
    got = matching.cells_in_boxes(spark.createDataFrame(pts, "cell int, x double, y double"), spark.createDataFrame(boxes, "box int, x0 double, x1 double, y0 double, y1 double"), 0.7)
    assert sorted(tuple(r) for r in got.collect()) == sorted((c, b) for c, x, y in pts for b, x0, x1, y0, y1 in boxes if x0 <= x <= x1 and y0 <= y <= y1)


def test_unions_and_screens(spark):
    a, b = spark.createDataFrame([(1, 2.0)], "site int, x double"), spark.createDataFrame([("n", 3)], "name string, site int")
    assert [tuple(r) for r in clean.unioned({"p": a, "q": b}).orderBy("site").collect()] == [(1, 2.0, "p", None), (3, None, "q", "n")]
    with pytest.raises(ValueError):
        clean.unioned({})
    g = spark.createDataFrame([(1, 2.0, 0.0, "Big Slough"), (2, 0.5, 11.0, None), (3, 0.5, 9.0, "x"), (4, 5.0, 5.0, "River"), (None, 5.0, 5.0, "River")], "site int, m double, p double, name string")
    bad = spark.createDataFrame([(4,), (4,), (None,)], "site int")
    assert [r.site for r in clean.gauge_screen(g, "m", "p", "name", bad=bad).collect()] == [2, None]
    r = {r.k: r for r in clean.group_summary(spark.createDataFrame([("a", 1.0), ("a", None), ("b", 5.0)], "k string, v double"), ["k"], "v", F.col("v") > 0).collect()}
    assert (r["a"].n, r["a"].n_valid, r["a"].observed, r["a"]["any"], r["a"]["all"]) == (2, 1, 0.5, True, False) and r["b"]["all"]


def test_records_are_put_in_place(spark, tmp_path):
    k = lake.Lake(spark, str(tmp_path))
    row = lambda *r: spark.createDataFrame([(*x, dt.datetime(2020, 1, 1), y) for *x, y in r], "basin string, subbasin string, source string, processed_at timestamp, has_data boolean")
    k.rewrite_records(row(("0101", "s1", "a", True), ("0101", "s2", "a", True), ("0202", "s3", "a", True)))
    k.rewrite_records(row(("0101", "s1", "a", False), ("0202", "s3", "b", False)))
    assert sorted(map(tuple, k.status().select("basin", "subbasin", "a", "b").collect())) == [("0101", "s1", False, None), ("0101", "s2", True, None), ("0202", "s3", True, False)]
    assert k._partitioned(f"{k.root}/processing").count() == 4 and k.status("0202").count() == 1
    with pytest.raises(ValueError, match="two records"):
        k.rewrite_records(row(("0101", "s1", "a", True), ("0101", "s1", "a", False)))
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("_staged")]
