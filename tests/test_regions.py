"""Forests by intervals, nearest search in crowds, footprints, the memory stream, losses and checks on hand-made cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rillflow.operators import clean, footprints, graph, intervals, matching, metrics, samples

RING = "zone string, ring array<struct<x:double,y:double>>"
LINE = "id long, line array<struct<x:double,y:double>>"


def xy(points):
    return [{"x": float(a), "y": float(b)} for a, b in points]


def test_intervals_of_a_forest(spark):
    rnd = random.Random(1)
    down = {i: rnd.choice(range(i)) for i in range(1, 120) if i % 40} | {i: i - 1 for i in range(121, 190)} | {i: 300 for i in range(301, 420)}  # trees, a chain, a star
    nodes = sorted(set(down) | set(down.values()) | {999})
    n = spark.createDataFrame([(i,) for i in nodes], "node long")
    own = graph.cut(intervals.forest_intervals(n, spark.createDataFrame(list(down.items()), "src long, dst long")))

    def path(i):
        out = [i]
        while out[-1] in down:
            out.append(down[out[-1]])
        return out

    want = {(below, i, d) for i in nodes for d, below in enumerate(path(i))}
    for bucket in (1, 3, intervals.BUCKET):
        assert {tuple(r) for r in intervals.upstream_in_forest(own, n, bucket).collect()} == want
    rows = own.collect()
    assert {r.node: (r.outlet, r.depth, r["size"]) for r in rows} == {i: (path(i)[-1], len(path(i)) - 1, sum(b == i for b, _, _ in want)) for i in nodes}
    assert len({(r.outlet, r["first"]) for r in rows}) == len(nodes)
    pairs = spark.createDataFrame([(300, 301), (301, 300), (999, 999), (0, 999), (120, 189), (5, 4444)], "low long, high long")
    assert {(r.low, r.high): r.upstream for r in intervals.lies_upstream(own, pairs).collect()} == {(300, 301): True, (301, 300): False, (999, 999): True, (0, 999): False, (120, 189): True, (5, 4444): None}


def test_nodes_above_a_cycle_have_no_interval_and_two_ways_down_are_an_error(spark):
    n = spark.createDataFrame([(i,) for i in range(5)], "node long")
    e = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 4)], "src long, dst long")
    assert {r.node for r in intervals.forest_intervals(n, e).collect()} == {3, 4}
    with pytest.raises(ValueError, match="two ways"):
        intervals.forest_intervals(n, spark.createDataFrame([(0, 1), (0, 2)], "src long, dst long"))
    assert intervals.forest_intervals(n.limit(0), e.limit(0)).count() == 0


def test_one_outlet_each(spark):
    n = spark.createDataFrame([(i,) for i in range(4)], "node long")
    graph.require_one_outlet(n, spark.createDataFrame([(0, 1), (2, 1)], "src long, dst long"))
    with pytest.raises(ValueError, match="one outlet"):
        graph.require_one_outlet(n, spark.createDataFrame([(0, 1), (0, 2)], "src long, dst long"))


@pytest.mark.parametrize("others", [False, True])
def test_nearest_in_a_crowd(spark, others):
    rnd = random.Random(7)
    spots = [(i, round(rnd.random() * 3, 2), round(rnd.random() * 0.4, 2)) for i in range(400)] + [(900, 40.0, 40.0), (901, 40.0, 40.0), (902, 41.5, 40.0), (903, 60.0, 60.0)]
    df = spark.createDataFrame(spots, "id int, x double, y double")
    right = df.select(F.col("id").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    want = set()
    for i, x, y in spots:
        near = [(((x - a) * (x - a) + (y - b) * (y - b)) ** 0.5, j) for j, a, b in spots if not (others and i == j)]
        want |= {(i, j) for d, j in near if d <= 5 and d == min(near)[0]}
    got = matching.nearest_join(df, right, 5.0, others, crowd=4)
    assert {(r.id, r.rid) for r in got.collect()} == want and got.count() == len(want)
    assert got.columns == ["id", "x", "y", "rid", "rx", "ry", "distance"]


def test_right_outer_buffer(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0)], "id int, x double, y double")
    b = spark.createDataFrame([(1, 0.5, 0.0), (2, 9.0, 9.0)], "rid int, rx double, ry double")
    assert {(r.rid, r.id) for r in matching.buffer_join(a, b, 1.0, "right").collect()} == {(1, 1), (2, None)}


def test_points_inside_rings(spark):
    rings = {"box": [(0, 0), (4, 0), (4, 4), (0, 4)], "next": [(4, 0), (8, 0), (8, 4), (4, 4), (4, 0)], "dent": [(0, 0), (0, 4), (2, 1), (4, 4), (4, 0)], "flat": [(0, 0), (1, 1)]}
    r = spark.createDataFrame([(z, xy(p)) for z, p in rings.items()], RING)
    p = spark.createDataFrame([(1, 2.0, 2.0), (2, 2.0, 0.5), (3, 4.0, 1.0), (4, 9.0, 9.0), (5, 0.5, 2.0), (6, 0.0, 1.0)], "id long, x double, y double")
    assert {tuple(x) for x in footprints.points_inside(p, r, 1.5).collect()} == {(1, "box"), (2, "box"), (2, "dent"), (3, "next"), (5, "box"), (5, "dent"), (6, "box"), (6, "dent")}


def test_a_zone_of_two_rings_and_points_of_whole_cells(spark):
    """A ring within a ring is a hole; points lie in cells that no edge meets, on borders of cells and far away. Nothing is grouped once points and zones have met."""
    rnd = random.Random(3)
    r = spark.createDataFrame([("hole", xy([(-5, -5), (9, -5), (9, 9), (-5, 9)])), ("hole", xy([(0.5, 1), (6, 1), (6, 6.25)])), ("tip", xy([(0, 0), (8, 0.1), (0, 0.2)]))], RING)
    spots = [(x / 2, y / 2) for x in range(-12, 22) for y in range(-12, 22)] + [(rnd.uniform(-6, 10), rnd.uniform(-6, 10)) for _ in range(300)] + [(float("nan"), 1.0), (1.0, float("nan")), (1e9, 1.0)]
    rings = {"hole": [[(-5, -5), (9, -5), (9, 9), (-5, 9)], [(0.5, 1), (6, 1), (6, 6.25)]], "tip": [[(0, 0), (8, 0.1), (0, 0.2)]]}

    def inside(x, y, parts):
        n = 0
        for p in parts:
            for (ax, ay), (bx, by) in zip(p, p[1:] + p[:1], strict=True):
                (lx, ly), (rx, ry) = ((ax, ay), (bx, by)) if ax < bx else ((bx, by), (ax, ay))
                n += lx != rx and lx <= x < rx and ly + (x - lx) * ((ry - ly) / (rx - lx)) > y
        return n % 2 == 1

    want = {(i, z) for i, (x, y) in enumerate(spots) for z, parts in rings.items() if inside(x, y, parts)}
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)], "id long, x double, y double")
    for size in (0.7, 1.0, 5.0):
        got = footprints.points_inside(df, r, size)
        assert {tuple(x) for x in got.collect()} == want and got.count() == len(want)
    assert "Aggregate [id" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_segments_pass_few_cells(spark):
    """A slanted segment passes the cells along it, not all of its box; a pair that shares several cells comes once."""
    s = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 100.0), (2, 0.0, 5.0, 40.0, 5.0), (3, 2.0, 0.0, 2.0, 30.0), (4, 2.0, 2.0, 2.0, 2.0)], "id long, ax double, ay double, bx double, by double")
    got = {r.id: r["count"] for r in footprints.passed_cells(s, 4.0).groupBy("id").count().collect()}
    assert got[1] <= 3 * 26 and (got[2], got[3], got[4]) == (11, 8, 1)
    rnd = random.Random(4)
    lines = {i: [(rnd.uniform(-9, 9), rnd.uniform(-9, 9)) for _ in range(2)] for i in range(60)} | {60: [(-8, 0), (8, 0)], 61: [(4, -8), (4, 8)]}
    boxes = {i: (x, x + rnd.uniform(0, 6), y, y + rnd.uniform(0, 6)) for i in range(40) for x, y in [(rnd.uniform(-9, 9), rnd.uniform(-9, 9))]} | {40: (-4.0, 4.0, -4.0, 4.0)}
    want = {}
    for i, ((ax, ay), (bx, by)) in lines.items():
        for k, (x0, x1, y0, y1) in boxes.items():
            t, u = 0.0, 1.0
            for a, b, lo, hi in ((ax, bx, x0, x1), (ay, by, y0, y1)):
                if a == b:
                    u = u if lo <= a <= hi else -1.0
                else:
                    t, u = max(t, min((lo - a) / (b - a), (hi - a) / (b - a))), min(u, max((lo - a) / (b - a), (hi - a) / (b - a)))
            if t < u:
                want[i, k] = (ax + t * (bx - ax), ay + t * (by - ay), ax + u * (bx - ax), ay + u * (by - ay))
    df = spark.createDataFrame([(i, xy(p)) for i, p in lines.items()], LINE)
    out = footprints.clipped_lines(df, spark.createDataFrame([(k, *b) for k, b in boxes.items()], "box long, x0 double, x1 double, y0 double, y1 double"), 1.5).collect()
    assert {(r.id, r.box): (r.ax, r.ay, r.bx, r["by"]) for r in out} == want and len(out) == len(want)


def test_lines_and_rings_that_meet_rings(spark):
    r = spark.createDataFrame([("dent", xy([(0, 0), (0, 4), (2, 1), (4, 4), (4, 0)])), ("far", xy([(20, 20), (21, 20), (21, 21)]))], RING)
    lines = {1: [(1, 0.5), (2, 0.5)], 2: [(1.5, 3), (2.5, 3)], 3: [(-1, 2), (9, 2)], 4: [(4, 4), (5, 9)], 5: [(-1, 9), (9, 9)], 6: [(0, 5), (0, 4.5)], 7: [(2, 9), (2, 3), (2, 0.9)]}
    df = spark.createDataFrame([(i, xy(p)) for i, p in lines.items()], LINE)
    assert {tuple(x) for x in footprints.lines_meeting(df, r, 1.0).collect()} == {(i, "dent") for i in (1, 3, 4, 7)}
    around = spark.createDataFrame([(1, xy([(-9, -9), (9, -9), (9, 9), (-9, 9)])), (2, xy([(1, 0.2), (2, 0.2), (2, 0.4)])), (3, xy([(1.8, 3), (2.2, 3), (2, 3.5)]))], LINE)
    assert {tuple(x) for x in footprints.lines_meeting(around, r, 1.0, closed=True).collect()} == {(1, "dent"), (2, "dent")}


def test_lines_that_meet_rings_by_passed_cells(spark):
    rnd = random.Random(6)
    lines = {i: [(rnd.uniform(-9, 9), rnd.uniform(-9, 9)) for _ in range(2)] for i in range(80)}
    boxes = {f"{k}": (x, y, x + 2, y + 1) for k in range(20) for x, y in [(rnd.randint(-9, 9), rnd.randint(-9, 9))]}

    def meets(a, b, x0, y0, x1, y1):
        t, u = 0.0, 1.0
        for p, q, lo, hi in ((a[0], b[0], x0, x1), (a[1], b[1], y0, y1)):
            t, u = max(t, min((lo - p) / (q - p), (hi - p) / (q - p))), min(u, max((lo - p) / (q - p), (hi - p) / (q - p)))
        return t <= u

    r = spark.createDataFrame([(k, xy([(b[0], b[1]), (b[2], b[1]), (b[2], b[3]), (b[0], b[3])])) for k, b in boxes.items()], RING)
    out = footprints.lines_meeting(spark.createDataFrame([(i, xy(p)) for i, p in lines.items()], LINE), r, 1.0)
    assert {tuple(x) for x in out.collect()} == {(i, k) for i, p in lines.items() for k, b in boxes.items() if meets(*p, *b)}
    assert "RepartitionByExpression [_cx" in out._jdf.queryExecution().optimizedPlan().toString()


def test_clipped_lines(spark):
    df = spark.createDataFrame([(1, xy([(-1, 1), (5, 1), (5, 9)])), (2, xy([(1, -1), (1, 1)])), (3, xy([(0, 4), (4, 8)])), (4, xy([(0, 0)]))], LINE)
    box = spark.createDataFrame([("b", 0.0, 4.0, 0.0, 4.0)], "box string, x0 double, x1 double, y0 double, y1 double")
    got = {(x.id, x.k): (x.ax, x.ay, x.bx, x["by"]) for x in footprints.clipped_lines(df, box, 1.5).collect()}
    assert got == {(1, 0): (0.0, 1.0, 4.0, 1.0), (2, 0): (1.0, 0.0, 1.0, 1.0)}


def test_memory_of_rows_out_of_order(spark, tmp_path):
    """Rows in any order over several batches give what the whole series in order gives; a late one is dropped."""
    from rillflow.streaming.ingest import memory_stream

    rnd, start = random.Random(5), dt.datetime(2024, 1, 1)
    rows = [(f"s{i % 3}", start + dt.timedelta(hours=i // 2, milliseconds=i % 5), None if i % 4 == 0 else float(i)) for i in range(120)]
    order = sorted(range(120), key=lambda i: i + rnd.randrange(12))  # at most 12 rows, 6 hours, out of order
    batches = [[rows[i] for i in order[k : k + 30]] for k in range(0, 120, 30)] + [[("s0", start + dt.timedelta(hours=20), -1.0), ("s9", start + dt.timedelta(days=9), 1.0)]]
    inbox = tmp_path / "in"
    inbox.mkdir()
    schema = "site string, ts timestamp, v double"
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(inbox))
    for part in ([0, 1, 2], [3, 4]):  # run, stop and go on from the checkpoint
        for k in part:
            spark.createDataFrame(batches[k], schema).coalesce(1).write.parquet(str(tmp_path / f"b{k}"))
            next((tmp_path / f"b{k}").glob("*.parquet")).rename(inbox / f"{k}.parquet")
        q = memory_stream(source, "site", "ts", "v", "12 hours").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()
    want = []
    for s in ("s0", "s1", "s2"):
        last = at = None
        for _, t, v in sorted((r for r in rows if r[0] == s), key=lambda r: r[1]):
            if v is not None:
                last, at = v, t
            want.append((s, t, last, None if at is None else round((t - at).total_seconds() / 86400, 9)))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(((r.site, r.ts, r["last"], None if r.staleness_days is None else round(r.staleness_days, 9)) for r in got), key=str) == sorted(want, key=str)


def test_losses_over_targets_and_without_pairs(spark):
    losses = spark.createDataFrame([("q", 3.0), ("s", None), ("w", 9.0), ("u", 7.0)], "target string, loss double")
    assert metrics.loss_over_targets(losses, {"q": 1.0, "s": 0.5, "w": 0.0}).first()["loss"] == 1.5
    none = spark.createDataFrame([("a", 1, None, 1.0)], "k string, i int, o double, p double")
    assert metrics.spin_up_loss(none, "o", "p", "k", "i").first()["spin_up_nse"] is None
    assert metrics.mixture_loss(none, F.col("p"), F.col("o") > 0).first()["gmm_nll"] == 0.0


def test_filters_shares_and_splits(spark):
    df = spark.createDataFrame([(1.0, float("nan"), "2020-01-01"), (2.0, None, "2020-06-01"), (None, None, "2021-01-01")], "a double, b double, day string")
    with pytest.raises(ValueError, match="not both"):
        clean.value_filters(df, [{"column": "a", "operation": "equals", "value": 1.0}])
    two = [{"column": "a", "operation": "equals", "value": 1.0, "feature_list": ["a"]}, {"column": "a", "operation": "equals", "value": 1.0, "feature_list": ["day"]}]
    assert [(r.a, r.day) for r in clean.value_filters(df, two).collect()] == [(None, None), (2.0, "2020-06-01"), (None, "2021-01-01")]
    assert {r.variable: (round(r.missing, 6), r.has_gap, r.mostly_missing) for r in clean.missing_shares(df, ["a", "b"]).collect()} == {"a": (0.333333, True, False), "b": (1.0, True, True)}
    assert clean.missing_shares(df.limit(0), ["a"]).first().missing is None
    got = samples.split_by_dates(df, "day", {"train": ("2020-01-01", "2020-06-01"), "test": ("2020-06-01", "2020-12-31")})
    assert sorted((r.day, r.role) for r in got.collect()) == [("2020-01-01", "train"), ("2020-06-01", "test"), ("2020-06-01", "train")]
