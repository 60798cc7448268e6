"""Registered queries of forests by intervals, footprints, streams, losses and checks, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.functions import columns as C
from rillflow.operators import clean, footprints, graph, intervals, metrics, samples
from rillflow.plans.registry import query, rounded, rounded_as_sql
from rillflow.plans.tables import EDGES, MIXTURE, POINTS, PRED_OBS, REACH, SWOT, Tables
from rillflow.streaming import ingest as streams

# --------------------------------------------------------------------------- forests

_UP = f"WITH RECURSIVE r AS (SELECT node AS start, node, 0 AS d FROM ({REACH}) UNION ALL SELECT r.start, e.src, r.d + 1 FROM r JOIN ({EDGES}) e ON e.dst = r.node)"


@query(f"{_UP} SELECT start, node, d::BIGINT AS depth FROM r")
def upstream_pairs(t: Tables) -> DataFrame:
    """Of every node."""
    return intervals.upstream_in_forest(intervals.forest_intervals(t.reach(), t.edges()), t.reach())


@query(f"{_UP} SELECT start AS node, count(*) AS size, max(d)::BIGINT AS height FROM r GROUP BY 1")
def subtree_sizes(t: Tables) -> DataFrame:
    own = intervals.forest_intervals(t.reach(), t.edges())
    height = intervals.upstream_in_forest(own, own).groupBy(F.col("start").alias("node")).agg(F.max("depth").alias("height"))
    return own.select("node", "size").join(height, "node")


@query(f"{_UP} SELECT low, high, n IS NOT NULL AS upstream FROM (SELECT DISTINCT s_nationkey AS low, s_suppkey AS high FROM supplier) LEFT JOIN (SELECT start, node, 1 AS n FROM r) ON start = low AND node = high WHERE low IN (SELECT start FROM r) AND high IN (SELECT start FROM r)")
def lies_upstream(t: Tables) -> DataFrame:
    pairs = t.raw("supplier").select(F.col("s_nationkey").alias("low"), F.col("s_suppkey").alias("high")).distinct()
    return intervals.lies_upstream(intervals.forest_intervals(t.reach(), t.edges()), pairs).where("upstream IS NOT NULL")


# --------------------------------------------------------------------------- footprints

_ZONES = "SELECT s_suppkey AS zone, (s_suppkey * 37 % 41 - 20)::DOUBLE AS cx, (s_suppkey * 53 % 37 - 18)::DOUBLE AS cy, 1 + s_nationkey / 10.0::DOUBLE AS r FROM supplier"
_CORNERS = "[{'x': cx - r, 'y': cy - r}, {'x': cx + r, 'y': cy - r}, {'x': cx + r, 'y': cy + r}, {'x': cx, 'y': cy - r / 2}, {'x': cx - r, 'y': cy + r}]"
_RINGED = f"SELECT zone, ring[k].x AS px, ring[k].y AS py, ring[k % 5 + 1].x AS qx, ring[k % 5 + 1].y AS qy FROM (SELECT zone, {_CORNERS} AS ring FROM ({_ZONES})), (SELECT unnest([1, 2, 3, 4, 5]) AS k)"
_LEFT = f"SELECT zone, least(px, qx) AS lx, greatest(px, qx) AS rx, CASE WHEN px < qx THEN py ELSE qy END AS ly, CASE WHEN px < qx THEN qy ELSE py END AS ry FROM ({_RINGED}) WHERE px <> qx"
_INSIDE = f"SELECT id, zone FROM ({POINTS}) JOIN ({_LEFT}) ON x >= lx AND x < rx AND ly + (x - lx) * ((ry - ly) / (rx - lx)) > y GROUP BY 1, 2 HAVING count(*) % 2 = 1"
_LINES = f"SELECT a.id, a.x AS ax, a.y AS ay, b.x AS dx, b.y AS dy FROM ({POINTS}) a JOIN ({POINTS}) b ON b.id = a.id + 1"


def _zones(t: Tables) -> DataFrame:
    k, n = F.col("s_suppkey").cast("long"), F.col("s_nationkey")
    z = t.raw("supplier").select(k.alias("zone"), (k * 37 % 41 - 20).cast("double").alias("cx"), (k * 53 % 37 - 18).cast("double").alias("cy"), (1 + n / F.lit(10.0)).alias("r"))
    x, y, r = F.col("cx"), F.col("cy"), F.col("r")
    corners = [(x - r, y - r), (x + r, y - r), (x + r, y + r), (x, y - r / 2), (x - r, y + r)]
    return z.select("zone", F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in corners]).alias("ring"))


def _lines(t: Tables) -> DataFrame:
    a, b = t.points(), t.points().select((F.col("id") - 1).alias("id"), F.struct("x", "y").alias("_to"))
    return a.join(b, "id").select("id", F.array(F.struct("x", "y"), "_to").alias("line"))


@query(_INSIDE)
def points_in_footprints(t: Tables) -> DataFrame:
    return footprints.points_inside(t.points(), _zones(t), 1.0)


def _sides(a: str, b: str, p: str, q: str) -> str:
    side = lambda u, v, w: f"sign(({v}x - {u}x) * ({w}y - {u}y) - ({v}y - {u}y) * ({w}x - {u}x))"
    return f"{side(a, b, p)} * {side(a, b, q)} <= 0"


_MET = " AND ".join(f"greatest(a{c}, d{c}) >= least(p{c}, q{c}) AND greatest(p{c}, q{c}) >= least(a{c}, d{c})" for c in "xy") + f" AND {_sides('a', 'd', 'p', 'q')} AND {_sides('p', 'q', 'a', 'd')}"


@query(f"SELECT DISTINCT id, zone FROM ({_LINES}) JOIN ({_RINGED}) ON {_MET} UNION SELECT id, zone FROM ({_INSIDE}) WHERE id IN (SELECT id FROM ({_LINES}))")
def lines_meeting_footprints(t: Tables) -> DataFrame:
    return footprints.lines_meeting(_lines(t), _zones(t), 4.0)


def _times(c: str) -> tuple[str, str]:
    a, z = f"(c{c} - r - a{c}) / nullif(d{c} - a{c}, 0)", f"(c{c} + r - a{c}) / nullif(d{c} - a{c}, 0)"
    return f"coalesce(least({a}, {z}), 0)", f"coalesce(greatest({a}, {z}), 1)"


_HIT = " AND ".join(f"greatest(a{c}, d{c}) >= c{c} - r AND least(a{c}, d{c}) <= c{c} + r" for c in "xy")
_CUT = f"SELECT *, greatest(0, {_times('x')[0]}, {_times('y')[0]}) AS t, least(1, {_times('x')[1]}, {_times('y')[1]}) AS u FROM ({_LINES}) JOIN ({_ZONES}) ON {_HIT}"


@query(f"SELECT id, zone AS box, round(ax + t * (dx - ax), 4) AS ax, round(ay + t * (dy - ay), 4) AS ay, round(ax + u * (dx - ax), 4) AS bx, round(ay + u * (dy - ay), 4) AS \"by\" FROM ({_CUT}) WHERE t < u")
def lines_clipped(t: Tables) -> DataFrame:
    boxes = footprints.envelopes(_zones(t), "zone", "ring").withColumnRenamed("zone", "box")
    return rounded_as_sql(footprints.clipped_lines(_lines(t), boxes, 4.0).drop("k"), ["ax", "ay", "bx", "by"])


# --------------------------------------------------------------------------- streams

_CLICKS = "SELECT user_id, ts, CASE WHEN event_type = 'click' THEN value END AS v FROM events"


@query(f"""SELECT site, epoch_us(ts) AS t, l.v AS last, round((epoch_us(ts) - epoch_us(l.ts)) / 86400e6, 6) AS staleness_days FROM (SELECT CAST(user_id AS VARCHAR) AS site, ts,
  last_value(CASE WHEN v IS NOT NULL THEN {{'v': v, 'ts': ts}} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, v NULLS FIRST ROWS UNBOUNDED PRECEDING) AS l FROM ({_CLICKS}))
  WHERE epoch_us(ts) < ((SELECT epoch_us(max(ts)) FROM events) // 1000 - 86400000) * 1000""")
def memory_of_stream(t: Tables) -> DataFrame:
    """The events as a stream, run to its end: what the watermark has passed by then."""
    rows = t.spark.readStream.schema(t.raw("events").schema).parquet(f"{t.dir}/events.parque[t]")
    rows = rows.select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "click", F.col("value")).alias("v"))
    folder = f"{graph.shared_folder(t.spark)}/memory-{uuid.uuid4().hex}"
    out = streams.memory_stream(rows, "user_id", "ts", "v", "1 day").select("site", F.unix_micros("ts").alias("t"), "last", "staleness_days")
    run = out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start(f"{folder}/rows")
    run.awaitTermination()
    return rounded(t.spark.read.schema(out.schema).parquet(f"{folder}/rows"), ["staleness_days"], 6)


# --------------------------------------------------------------------------- losses, checks and splits


@query(f"""SELECT round(avg(nullif(l, 0)), 6) AS spin_up_nse FROM (SELECT sum(w * e) / sum(w) / (coalesce(stddev_pop(obs), 0) + 0.1) ** 2 AS l FROM (SELECT subbasin, obs, (obs - pred) ** 2 AS e,
  1 / (1 + exp(-CASE WHEN n > 1 THEN -10 + 20 * i / (n - 1)::DOUBLE ELSE -10 END)) AS w FROM (SELECT *, count(*) OVER s AS n, row_number() OVER (PARTITION BY subbasin ORDER BY o_orderkey) - 1 AS i
  FROM ({PRED_OBS}) WINDOW s AS (PARTITION BY subbasin))) GROUP BY subbasin)""")
def spin_up_loss(t: Tables) -> DataFrame:
    return rounded(metrics.spin_up_loss(t.pred_obs(), "obs", "pred", "subbasin", "o_orderkey"), ["spin_up_nse"], 6)


@query(f"""SELECT round(-sum(CASE WHEN y > 0 THEN ll END) / (count(CASE WHEN y > 0 THEN 1 END) + 1e-8), 4) AS gmm_nll FROM (SELECT y, ln(list_sum([exp(log_pi[k] - ln(sigma[k]) - 0.9189385332046727
  - 0.5 * greatest(least((y - mu[k]) / sigma[k], 20), -20) ** 2) FOR k IN range(1, 9)])) - ln(list_sum([exp(p) FOR p IN log_pi])) AS ll FROM ({MIXTURE}))""")
def mixture_loss(t: Tables) -> DataFrame:
    return rounded(metrics.mixture_loss(t.mixture(), C.mixture_nll(F.col("y"), F.col("mu"), F.col("sigma"), F.col("log_pi")), F.col("y") > 0), ["gmm_nll"])


@query("""SELECT variable, round(1 - n / c, 6) AS missing, n < c AS has_gap, 1 - n / c > 0.99 AS mostly_missing FROM (SELECT count(*)::DOUBLE AS c,
  count(CASE WHEN event_type = 'click' THEN value END) AS click, count(CASE WHEN event_type = 'absent' THEN value END) AS absent, count(value) AS value FROM events)
  UNPIVOT (n FOR variable IN (click, absent, value))""")
def missing_shares(t: Tables) -> DataFrame:
    e = t.obs().select(F.when(F.col("source") == "click", F.col("value")).alias("click"), F.when(F.col("source") == "absent", F.col("value")).alias("absent"), "value")
    return rounded(clean.missing_shares(e, ["click", "absent", "value"]), ["missing"], 6)


@query(f"SELECT key, q, CASE WHEN width > 10 THEN wse END AS wse, CASE WHEN width > 10 AND slope < 0.05 THEN width END AS width FROM ({SWOT})")
def filtered_by_controls(t: Tables) -> DataFrame:
    rules = [{"column": "width", "operation": "less_than", "value": 10, "feature_group": "shape"}, {"column": "slope", "operation": "greater_than", "value": 0.05, "feature_list": ["width"]}]
    return clean.value_filters(t.swot(), rules, {"shape": ["wse", "width"]}).select("key", "q", "wse", "width")


_RANGES = {"train": ("1992-01-01", "1995-06-30"), "validate": ("1995-01-01", "1996-12-31"), "test": ("1997-01-01", "1998-12-31")}


@query(" UNION ALL ".join(f"SELECT o_orderkey, '{role}' AS role FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '{a}' AND DATE '{z}'" for role, (a, z) in _RANGES.items()))
def split_by_dates(t: Tables) -> DataFrame:
    orders = t.raw("orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    return samples.split_by_dates(orders, "date", _RANGES).select("o_orderkey", "role")


@query("SELECT c_custkey AS subbasin, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'test' ELSE 'train' END AS role FROM customer")
def split_by_match(t: Tables) -> DataFrame:
    return samples.split_by_match(t.raw("customer").select(F.col("c_custkey").alias("subbasin")), t.raw("orders").select(F.col("o_custkey").alias("subbasin")))
