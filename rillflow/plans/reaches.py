"""Registered queries of reach samples, geometry, lakes, dates, lists, chunks and records, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.functions import columns as C
from rillflow.operators import clean, graph, ingest, matching, metrics, samples, stats, windows
from rillflow.plans.regions import _RINGED, _zones
from rillflow.plans.registry import _P, _PARTS, _WALK, _parts, query, rounded, unequal
from rillflow.plans.tables import ATTRS, DAILY, EDGES, MIXTURE, OBS, POINTS, PRED_OBS, REACH, SWOT, Tables
from rillflow.sources import lake

# --------------------------------------------------------------------------- reach samples

_SIZE, _LEAST, _LIMIT = 128, 10, 3.0
_VALID = f"SELECT *, wse * 2 + 10 AS h, width * 0.5 AS w, slope AS s FROM ({SWOT}) WHERE wse IS NOT NULL AND wse_u > 0"
_WITHIN = "coalesce(0.6745 * d{0} / nullif(median(abs(d{0})) OVER (PARTITION BY reach_id), 0) < 3, false)"
_LOGS = f"SELECT *, ln(1 + h + abs(min(h) OVER p)) AS lh, ln(1 + w + abs(min(w) OVER p)) AS lw, count(CASE WHEN w > 0 AND s > 0 THEN 1 END) OVER p AS good FROM ({_VALID}) WINDOW p AS (PARTITION BY reach_id)"
_DEVS = f"SELECT *, lh - median(lh) OVER (PARTITION BY reach_id) AS dh, lw - median(lw) OVER (PARTITION BY reach_id) AS dw FROM ({_LOGS})"
_HELD = f"SELECT * FROM (SELECT *, {_WITHIN.format('h')} AS okh, {_WITHIN.format('w')} AS okw FROM ({_DEVS})) WHERE good >= {_LEAST} AND w > 0 AND s > 0 AND okh AND okw"
_FLAT = "list_concat(list_transform(flatten(list([{0}] ORDER BY ts, key, q)), lambda v: round(v, 4)), list_transform(range({1} * ({2} - count(*))), lambda i: 1.0::DOUBLE))"


@query(f"""SELECT reach_id, count(*) AS n, {_FLAT.format('wse, width, slope', 3, _SIZE)} AS x, {_FLAT.format('h, w, s', 3, _SIZE)} AS hws, {_FLAT.format('wse_u', 1, _SIZE)} AS y, count(*) AS held
  FROM ({_HELD}) GROUP BY reach_id HAVING count(*) >= {_LEAST}""")
def reach_samples(t: Tables) -> DataFrame:
    """Each row of a reach is a day of its own, in order of time, key and number."""
    d = t.swot().where("wse_u > 0").withColumn("day", F.struct("ts", "key", "q"))
    scales = {"wse": (10.0, 2.0, False), "width": (0.0, 0.5, False), "slope": (0.0, 1.0, False)}
    r = samples.reach_samples(d, "reach_id", "day", ["wse", "width", "slope"], ["wse_u"], ("wse", "width", "slope"), scales, _SIZE, _LEAST, _LIMIT)
    flat = lambda c: F.transform(F.flatten(c), lambda v: F.round(v, 4)).alias(c)
    return r.select("reach_id", F.col("n").cast("long").alias("n"), flat("x"), flat("hws"), flat("y"), F.aggregate("mask", F.lit(0).cast("long"), lambda a, m: a + m).alias("held"))


@query(f"SELECT s.key, s.q, s.reach_id, s.wse, s.width, a.area, a.brand FROM ({SWOT}) s JOIN ({ATTRS}) a ON a.subbasin = s.reach_id WHERE s.wse_u > 0.02 AND s.slope > 0")
def flat_observations(t: Tables) -> DataFrame:
    d = t.swot().withColumns({"wse_u": C.clip_to_null(F.col("wse_u"), 0.0200001), "slope": C.sentinel_to_null(F.col("slope"), 0.0), "subbasin": F.col("reach_id")})
    return samples.flat_observations(d, "wse_u", ["wse", "width", "slope"], t.attrs()).select("key", "q", "reach_id", "wse", "width", "area", "brand")


@query("SELECT o_orderkey AS sample_id, ('0x' || substr(md5('0/' || o_orderkey || '/3'), 1, 8))::BIGINT AS draw FROM orders ORDER BY 2, 1")
def epoch_order(t: Tables) -> DataFrame:
    s = t.raw("orders").select(F.col("o_orderkey").alias("sample_id"))
    return samples.epoch_order(s, 3).withColumn("draw", samples.hashed_order(F.col("sample_id"), F.lit(3)))


@query(f"SELECT c_custkey AS subbasin, CASE WHEN ('0x' || substr(md5('0/' || c_custkey), 1, 8))::BIGINT < {int(0.8 * 2**32)} THEN 'train' ELSE 'test' END AS role FROM customer")
def random_split(t: Tables) -> DataFrame:
    return samples.random_split(t.raw("customer").select(F.col("c_custkey").alias("subbasin")), 0.8)


# --------------------------------------------------------------------------- scales, hydraulics, dates, lists


@query(f"""SELECT id, round(CASE WHEN id % 2 = 0 THEN sqrt((exp(s * s) - 1) * exp(2 * m + s * s)) ELSE sigma[1] * 0.5 END, 6) AS std,
  round(CASE WHEN id % 2 = 0 THEN sqrt((exp(sigma[1] ** 2) - 1) * exp(2 * (mu[1] + 0.1) + sigma[1] ** 2)) ELSE sigma[1] * 0.5 END, 6) AS std_unscaled FROM (SELECT *, mu[1] * 0.5 + 0.1 AS m, sigma[1] * 0.5 AS s FROM ({MIXTURE}))""")
def natural_deviations(t: Tables) -> DataFrame:
    mu, sigma, log = F.get("mu", 0), F.get("sigma", 0), F.col("id") % 2 == 0
    std = lambda scaled: C.denormalised_std(mu, sigma, F.lit(0.1), F.lit(0.5), log, scaled)
    return rounded(t.mixture().select("id", std(True).alias("std"), std(False).alias("std_unscaled")), ["std", "std_unscaled"], 6)


@query(f"""SELECT o_orderkey, round((pred - obs) / ((pred + obs) / 2), 6) AS difference, round(obs / area, 6) AS unit, round(CASE WHEN area <> 0 THEN obs END, 2) AS back
  FROM (SELECT o_orderkey, obs, pred, nullif(subbasin % 4, 0) * 1.5 AS area FROM ({PRED_OBS}))""")
def unit_discharges(t: Tables) -> DataFrame:
    p = t.pred_obs().withColumn("area", (F.col("subbasin") % 4) * 1.5)
    unit = C.unit_discharge(F.col("obs"), F.col("area"))
    df = p.select("o_orderkey", C.relative_difference(F.col("pred"), F.col("obs")).alias("difference"), unit.alias("unit"), C.discharge_of(unit, F.col("area")).alias("back"))
    return rounded(rounded(df, ["difference", "unit"], 6), ["back"], 2)


@query(f"""SELECT key, q, round(CASE WHEN width > 0 AND slope >= 0 THEN pow(1e-6 + greatest(a, 0) + ln(1 + exp(-abs(a))), 5 / 3.0) * pow(width, -2 / 3.0) * sqrt(slope) / 0.03 END, 4) AS discharge
  FROM (SELECT *, 1 + width * (wse_u - 0.05) AS a FROM ({SWOT}))""")
def manning_soft_q(t: Tables) -> DataFrame:
    q = C.manning_soft(F.lit(1.0), F.col("width"), F.col("wse_u") - 0.05, F.col("slope"), F.lit(0.03))
    return rounded(t.swot().select("key", "q", q.alias("discharge")), ["discharge"])


@query("""SELECT event_id, CAST(ts AS DATE) AS day, CAST(ts + INTERVAL 12 HOUR AS DATE) AS nearest, year(ts) AS year, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS days,
  (CAST(ts AS DATE) + INTERVAL 7 DAY)::DATE AS week_on, date_trunc('month', ts)::DATE AS month FROM events""")
def date_parts(t: Tables) -> DataFrame:
    ts, day = F.col("ts"), C.utc_day(F.col("ts"))
    return t.obs().select(
        "event_id", day.alias("day"), C.nearest_day(ts).alias("nearest"), F.year(day).cast("long").alias("year"), C.epoch_days(day).cast("long").alias("days"), F.date_add(day, 7).alias("week_on"), F.to_date(F.date_trunc("month", day)).alias("month")
    )


@query(f"SELECT key, q, reach_id % 10 AS kind, key + reach_id AS total, list_concat([key, reach_id], [1, 1]) AS ids, key // 1000000000 AS region FROM ({SWOT})")
def ids_in_lists(t: Tables) -> DataFrame:
    """Ids written as a list's text, read back, summed, and padded to four."""
    ids = C.parsed_ids(F.concat(F.lit("["), F.col("key").cast("string"), F.lit(", "), F.col("reach_id").cast("string"), F.lit("]")))
    return t.swot().withColumn("ids", ids).select(
        "key", "q", C.reach_type(F.col("reach_id")).alias("kind"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"), C.padded(F.col("ids"), 4, 1).cast("array<bigint>").alias("ids"), C.region_code(F.col("key")).alias("region")
    )


@query(f"SELECT event_id, list_transform([sin(p), cos(p), sin(p / 100), cos(p / 100)], lambda v: round(v, 6) + 0.0) AS code FROM (SELECT event_id, flags::DOUBLE AS p FROM ({OBS}))")
def position_codes(t: Tables) -> DataFrame:
    return t.obs().select("event_id", F.transform(C.sinusoidal(F.col("flags").cast("double"), 4), lambda v: F.round(v, 6) + F.lit(0.0)).alias("code"))


# --------------------------------------------------------------------------- geometry

_CROSS = "px * qy - qx * py"


@query(f"SELECT zone, round(sum((px + qx) * ({_CROSS})) / (3 * sum({_CROSS})), 6) AS x, round(sum((py + qy) * ({_CROSS})) / (3 * sum({_CROSS})), 6) AS y FROM ({_RINGED}) GROUP BY zone")
def ring_centroids(t: Tables) -> DataFrame:
    return rounded(_zones(t).select("zone", C.centroid(F.col("ring")).alias("c")).select("zone", "c.x", "c.y"), ["x", "y"], 6)


_FOUR = f"SELECT a.id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS \"by\", c.x AS cx, c.y AS cy, d.x AS dx, d.y AS dy FROM ({POINTS}) a JOIN ({POINTS}) b ON b.id = a.id + 1 JOIN ({POINTS}) c ON c.id = a.id + 2 JOIN ({POINTS}) d ON d.id = a.id + 3"
_TURNED = f"""SELECT id, dx, dy, turned, CASE WHEN turned THEN bx ELSE ax END AS ax, CASE WHEN turned THEN "by" ELSE ay END AS ay, CASE WHEN turned THEN ax ELSE bx END AS bx, CASE WHEN turned THEN ay ELSE "by" END AS "by"
  FROM (SELECT *, (ax - cx) ** 2 + (ay - cy) ** 2 < (bx - cx) ** 2 + ("by" - cy) ** 2 AS turned FROM ({_FOUR}))"""
_SHARE = """greatest(0.01, least(0.99, ((dx - ax) * (bx - ax) + (dy - ay) * ("by" - ay)) / ((bx - ax) ** 2 + ("by" - ay) ** 2)))"""


@query(f"SELECT id, round(f, 6) AS share, round(ax + f * (bx - ax), 4) AS x, round(ay + f * (\"by\" - ay), 4) AS y, round(bx, 4) AS mid_x, turned FROM (SELECT *, {_SHARE} AS f FROM ({_TURNED}))")
def sites_on_lines(t: Tables) -> DataFrame:
    """Lines of two points, turned towards the line below, which begins at the point after; the site is the fourth point, moved onto the line."""
    p = F.struct("x", "y")
    at = lambda k, n: t.points().select((F.col("id") - k).alias("id"), p.alias(n))
    d = t.points().select("id", p.alias("a")).join(at(1, "b"), "id").join(at(2, "c"), "id").join(at(3, "d"), "id")
    d = d.select("id", F.array("a", "b").alias("raw"), F.array("c").alias("below"), F.col("d.x").alias("px"), F.col("d.y").alias("py")).withColumn("line", C.oriented(F.col("raw"), F.col("below")))
    d = d.withColumn("share", matching.point_on_line("line", "px", "py")).withColumn("to", C.along(F.col("line"), F.col("share")))
    out = d.select("id", "share", "to.x", "to.y", C.middle_vertex(F.col("line"))["x"].alias("mid_x"), (F.get("line", 0) != F.get("raw", 0)).alias("turned"))
    return rounded(rounded(out, ["share"], 6), ["x", "y", "mid_x"])


@query(f"""SELECT a.id, w.w FROM (SELECT id, round(x * 10) / 10.0 AS x, round(y * 10) / 10.0 AS y FROM ({POINTS})) a LEFT JOIN (SELECT g.id, min_by(w, [abs(g.x - b.x), abs(g.y - b.y), b.x, b.y]) AS w
  FROM (SELECT id, round(x * 10) / 10.0 AS x, round(y * 10) / 10.0 AS y FROM ({POINTS})) g JOIN (SELECT round(x * 10) / 10.0 + (id % 5 - 2) * 0.006 AS x, round(y * 10) / 10.0 + (id % 3 - 1) * 0.007 AS y, max(id) AS w FROM ({POINTS}) GROUP BY 1, 2) b
    ON abs(g.x - b.x) <= 0.01 AND abs(g.y - b.y) <= 0.01 GROUP BY 1) w ON w.id = a.id""")
def grid_weights(t: Tables) -> DataFrame:
    """Cells on a grid of a tenth; weights beside it, two fifths of them too far."""
    snap = lambda c: F.round(F.col(c) * 10) / 10.0
    grid = t.points().select(F.col("id").alias("cell"), snap("x").alias("x"), snap("y").alias("y"))
    near = t.points().groupBy((snap("x") + (F.col("id") % 5 - 2) * 0.006).alias("x"), (snap("y") + (F.col("id") % 3 - 1) * 0.007).alias("y")).agg(F.max("id").alias("w"))
    return matching.grid_weights(near, grid, 0.01).select(F.col("cell").alias("id"), "w")


_BATCHED = f"SELECT start AS node, max_by(node, d) AS batch FROM ({_WALK} SELECT * FROM r) GROUP BY 1"


@query(f"""SELECT g.batch, e.src AS "from", e.dst AS "to", round(a.x, 4) AS x, round(a.y, 4) AS y, round(b.x - a.x, 4) AS dx, round(b.y - a.y, 4) AS dy, e.src % 10 / 10.0::DOUBLE AS weight
  FROM ({EDGES}) e JOIN ({_BATCHED}) g ON g.node = e.src JOIN ({_BATCHED}) h ON h.node = e.dst JOIN ({POINTS}) a ON a.id = e.src JOIN ({POINTS}) b ON b.id = e.dst WHERE e.src % 4 <> 0""")
def map_arrows(t: Tables) -> DataFrame:
    """Batches are the trees; every fourth edge is a padded one."""
    tree = graph.outlets(t.reach(), t.edges()).select("node", F.col("outlet").alias("batch"))
    nodes = graph.numbered(tree, "batch")
    place = lambda c: nodes.select(F.col("node").alias(c), F.col("place").alias(f"_{c}"), *(["batch"] if c == "src" else []))
    e = t.edges().join(place("src"), "src").join(place("dst"), "dst")
    e = e.select("batch", F.col("_src").alias("src"), F.col("_dst").alias("dst"), (F.col("src") % 4 != 0).alias("mask"), (F.col("src") % 10 / 10.0).alias("weight"))
    out = matching.edge_vectors(e, nodes.withColumnRenamed("node", "site"), t.points().withColumnRenamed("id", "site"), "weight")
    return rounded(out, ["x", "y", "dx", "dy"])


# --------------------------------------------------------------------------- lakes, chunks, densities, summaries


@query(f"""SELECT key, q, round(wse - median(wse) OVER p, 4) AS d_wse, round(width - median(width) OVER p, 4) AS d_area,
  round((wse - median(wse) OVER p) * 0.5 * (width + median(width) OVER p) + 3e-5, 2) AS d_volume FROM ({SWOT}) WINDOW p AS (PARTITION BY reach_id)""")
def lake_volumes(t: Tables) -> DataFrame:
    df = windows.volume_change(t.swot(), "reach_id", "wse", "width")
    return rounded(rounded(unequal(df, ["d_volume"], 3e-5), ["d_wse", "d_area"]), ["d_volume"], 2).select("key", "q", "d_wse", "d_area", "d_volume")


_CHUNKS = "SELECT o_orderkey, o_custkey, count(*) OVER (PARTITION BY o_custkey) AS n, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 AS c FROM orders"


@query(f"SELECT o_orderkey, (dense_rank() OVER (ORDER BY n DESC, o_custkey, c) - 1)::BIGINT AS chunk FROM ({_CHUNKS})")
def largest_first_chunks(t: Tables) -> DataFrame:
    return windows.numbered_chunks(t.raw("orders"), "o_custkey", "o_orderkey", 4).select("o_orderkey", "chunk")


_SPAN = "SELECT o_totalprice AS x, min(o_totalprice) OVER () AS lo, max(o_totalprice) OVER () AS hi FROM orders WHERE o_custkey > 1"


@query(f"""WITH b AS (SELECT least(floor((x - lo) / (hi - lo) * 200), 199)::INTEGER AS bin, count(*) AS n FROM ({_SPAN}) GROUP BY 1), s AS (SELECT any_value(lo) AS lo, any_value(hi) AS hi, count(*) AS c FROM ({_SPAN}))
  SELECT k::INTEGER AS bin, round(lo + (k + 1) * (hi - lo) / 200 + 1e-6, 4) AS edge, round(sum(coalesce(n, 0)) OVER (ORDER BY k) / c::DOUBLE, 8) AS density FROM (SELECT unnest(range(200)) AS k) CROSS JOIN s LEFT JOIN b ON b.bin = k""")
def cumulative_density(t: Tables) -> DataFrame:
    return rounded(rounded(unequal(metrics.cumulative_density(t.raw("orders"), "o_totalprice", 200, "o_custkey"), ["edge"], 1e-6), ["edge"]), ["density"], 8)


@query(f"""SELECT n.nodes, n.mean_area, n.n_gauge, n.n_reservoir, e.*, d.sources, d.sinks, c.components, round(e.edges / (n.nodes * (n.nodes - 1))::DOUBLE, 8) AS density FROM
  (SELECT count(*) AS nodes, round(avg(node * 1.5), 4) AS mean_area, count(CASE WHEN node % 7 = 0 THEN 1 END) AS n_gauge, count(CASE WHEN node % 5 = 0 THEN 1 END) AS n_reservoir FROM ({REACH})) n,
  (SELECT count(*) AS edges, min(src - dst)::DOUBLE AS distance_min, max(src - dst)::DOUBLE AS distance_max, round(avg(src - dst), 4) AS distance_mean FROM ({EDGES})) e,
  (SELECT count(CASE WHEN node NOT IN (SELECT dst FROM ({EDGES})) THEN 1 END) AS sources, count(CASE WHEN node NOT IN (SELECT src FROM ({EDGES})) THEN 1 END) AS sinks FROM ({REACH})) d,
  (SELECT count(DISTINCT batch) AS components FROM ({_BATCHED})) c""")
def graph_summary(t: Tables) -> DataFrame:
    nodes = t.reach().select("node", (F.col("node") * 1.5).alias("area"), (F.col("node") % 7 == 0).alias("gauge"), (F.col("node") % 5 == 0).alias("reservoir"))
    e = t.edges().withColumn("distance", (F.col("src") - F.col("dst")).cast("double"))
    return rounded(rounded(graph.graph_summary(nodes, e, "distance", "area", ("gauge", "reservoir")), ["mean_area", "distance_mean"]), ["density"], 8)


@query(f"""SELECT source, count(*) AS n, count(value) AS n_valid, round(count(value) / count(*)::DOUBLE, 6) AS observed, round(avg(value), 4) AS mean, bool_or(coalesce(value > 400, false)) AS "any", bool_and(coalesce(value > 400, false)) AS "all"
  FROM (SELECT source, CASE WHEN flags % 3 <> 0 THEN value END AS value FROM ({OBS})) GROUP BY source""")
def group_summary(t: Tables) -> DataFrame:
    d = t.obs().withColumn("value", F.when(F.col("flags") % 3 != 0, F.col("value")))
    return rounded(rounded(clean.group_summary(d, ["source"], "value", F.col("value") > 400), ["observed"], 6), ["mean"])


@query(f"""SELECT subbasin, date, o_orderkey, obs, (SELECT round(sqrt(avg((o - p) ** 2)), 4) FROM ({_P}) WHERE subbasin = 7 HAVING count(*) > 8) AS "RMSE" FROM ({PRED_OBS}) WHERE subbasin = 7 AND date BETWEEN DATE '1992-01-01' AND DATE '1996-12-31' ORDER BY date, o_orderkey""")
def series_with_metric(t: Tables) -> DataFrame:
    p = t.pred_obs().select("subbasin", "date", "o_orderkey", "obs", "pred")
    scores = metrics.skill(p, ["subbasin"], metrics={"RMSE": metrics.METRICS["RMSE"]})
    return rounded(ingest.one_series(p, "subbasin", 7, "date", "1992-01-01", "1996-12-31", scores, "RMSE"), ["RMSE"]).select("subbasin", "date", "o_orderkey", "obs", "RMSE")


@query(f"SELECT var, sum(count)::BIGINT AS count, round(min(min), 4) AS min, round(max(max), 4) AS max, round(sum(sum), 2) AS sum FROM ({_PARTS}) WHERE basin IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3 AND n_nationkey IN (SELECT c_nationkey FROM customer JOIN orders ON o_custkey = c_custkey)) GROUP BY var")
def training_statistics(t: Tables) -> DataFrame:
    """Of the training basins alone; all of them have statistics."""
    basins = t.raw("nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("basin"))
    there = t.raw("customer").join(t.raw("orders"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("basin"))
    return rounded(rounded(stats.merged_stats(_parts(t), ingest.common(basins, there, ["basin"])).select("var", "count", "min", "max", "sum"), ["min", "max"]), ["sum"], 2)


@query(f"""SELECT subbasin, round(CASE WHEN n > 8 THEN 1 - e / v END, 6) AS nse_prob, round(CASE WHEN n > 8 THEN 1 - e / (2 * v) END, 6) AS msess FROM (SELECT subbasin, count(*) AS n, sum((obs - pred) ** 2) + sum(std * std) AS e, var_pop(obs) * count(*) AS v
  FROM ({PRED_OBS}) WHERE obs > 0.001 AND pred > 0.001 AND std IS NOT NULL GROUP BY 1)""")
def probabilistic_metrics(t: Tables) -> DataFrame:
    return rounded(metrics.probabilistic_skill(t.pred_obs(), ["subbasin"], "obs", "pred", "std"), ["nse_prob", "msess"], 6)


# --------------------------------------------------------------------------- screens, names, parts


@query("SELECT p_partkey AS site, p_name FROM part WHERE (p_retailprice / 1000 > 1 OR p_size > 10) AND p_name NOT ILIKE '%cold%' AND p_name NOT ILIKE '%gear%' AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09 AND l_quantity > 48)")
def screened_gauges(t: Tables) -> DataFrame:
    g = t.raw("part").select(F.col("p_partkey").alias("site"), "p_name", (F.col("p_retailprice") / 1000).alias("mean"), F.col("p_size").alias("most"))
    bad = t.raw("lineitem").where("l_discount > 0.09 AND l_quantity > 48").select(F.col("l_partkey").alias("site"))
    return clean.gauge_screen(g, "mean", "most", "p_name", ("COLD", "gear"), bad).select("site", "p_name")


@query("SELECT p_partkey, TRY_CAST(substr(p_brand, 7) AS BIGINT) AS brand FROM part WHERE p_size % 3 <> 0")
def numeric_ids(t: Tables) -> DataFrame:
    p = t.raw("part").select("p_partkey", F.when(F.col("p_size") % 3 != 0, F.expr("substr(p_brand, 7)")).otherwise(F.col("p_name")).alias("brand"))
    return clean.numeric_only(p, ["brand"])


@query(f"SELECT subbasin AS site, coalesce(s_acctbal, area) AS area_river, bits AS bits_river FROM ({ATTRS}) LEFT JOIN supplier ON s_suppkey = subbasin")
def overridden_areas(t: Tables) -> DataFrame:
    lookup = t.raw("supplier").select(F.col("s_suppkey").alias("subbasin"), F.col("s_acctbal").alias("area"))
    d = clean.with_suffix(matching.overridden(t.attrs(), lookup, "subbasin", "area"), ["area", "bits"], "_river")
    return d.select(F.col("subbasin").alias("site"), "area_river", "bits_river")


@query(f"SELECT CASE WHEN src % 7 = 0 THEN src + 100000 ELSE src END AS src, CASE WHEN dst % 7 = 0 THEN dst + 100000 ELSE dst END AS dst FROM ({EDGES})")
def renamed_gauges(t: Tables) -> DataFrame:
    """Edges from a table of next nodes, its gauges under new names."""
    names = t.reach().where("node % 7 = 0").select(F.col("node").alias("old"), (F.col("node") + 100000).alias("new"))
    return graph.renamed_nodes(graph.edges_from_nextdown(t.reach(), "node", "nextdown"), names)


@query(f"SELECT DISTINCT c_custkey AS node FROM customer WHERE c_custkey NOT IN (SELECT node FROM ({REACH}))")
def sites_off_graph(t: Tables) -> DataFrame:
    return clean.missing_from(t.raw("customer").select(F.col("c_custkey").alias("node")), t.reach(), "node")


@query("SELECT 'customer' AS region, c_custkey AS site, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier")
def union_of_regions(t: Tables) -> DataFrame:
    a = t.raw("customer").select(F.col("c_custkey").alias("site"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = t.raw("supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("site"))
    return clean.unioned({"customer": a, "supplier": b}, "region").select("region", "site", "balance", "segment")


# --------------------------------------------------------------------------- through a lake


def _one(source: str) -> str:
    return f"SELECT subbasin, date, round(avg(value), 6) AS value FROM ({OBS}) WHERE source = '{source}' GROUP BY ALL"


@query(f"""SELECT lpad((subbasin % 7)::VARCHAR, 3, '0') AS basin, subbasin, date, coalesce(v.value, c.value, p.value) AS value, v.value AS viewed, year(date)::INTEGER AS year
  FROM ({_one('click')}) c FULL JOIN ({_one('view')}) v USING (subbasin, date) FULL JOIN ({_one('purchase')}) p USING (subbasin, date) WHERE date >= (SELECT min(date) FROM ({DAILY})) + 3""")
def lake_round_trip(t: Tables) -> DataFrame:
    """One source of a lake with basin ids that begin with zeros: clicks appended, views put over them, purchases added where there is no row, parts compacted, days from the fourth on read back."""
    k = lake.Lake(t.spark, f"{graph.shared_folder(t.spark)}/lake-{uuid.uuid4().hex}")
    days = t.obs().where(F.col("source").isin("click", "view", "purchase")).groupBy("source", "subbasin", "date").agg(F.round(F.avg("value"), 6).alias("value"))
    days = days.withColumns({"basin": F.lpad((F.col("subbasin") % 7).cast("string"), 3, "0"), "year": F.year("date")})
    part = lambda s: days.where(F.col("source") == s).drop("source")
    k.append(part("click"), "all")
    k.upsert(part("view").withColumn("viewed", F.col("value")), "all")
    k.insert_absent(part("purchase"), "all")
    k.compact("all")
    first = t.daily().agg(F.date_add(F.min("date"), 3)).first()[0]
    return k.read("all", start=str(first)).select("basin", "subbasin", "date", "value", "viewed", "year")


@query("""SELECT lpad(c_nationkey::VARCHAR, 3, '0') AS basin, o_custkey AS subbasin, arg_max(good, (o_orderkey % 3)) FILTER (o_orderkey % 3 < 2) AS a, max(good) FILTER (o_orderkey % 3 = 2) AS b
  FROM (SELECT c_nationkey, o_custkey, o_orderkey, max(o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%') OVER (PARTITION BY o_custkey, o_orderkey % 3) AS good FROM orders JOIN customer ON c_custkey = o_custkey) GROUP BY 1, 2""")
def rewritten_records(t: Tables) -> DataFrame:
    """Records of source a are put in place twice, the later ones win; b once."""
    o = t.raw("orders").join(t.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = o.groupBy(F.lpad(F.col("c_nationkey").cast("string"), 3, "0").alias("basin"), F.col("o_custkey").alias("subbasin"), (F.col("o_orderkey") % 3).alias("k")).agg(F.max(F.col("o_orderpriority").rlike("^[12]")).alias("has_data"), F.max("o_orderdate").alias("processed_at"))
    k = lake.Lake(t.spark, f"{graph.shared_folder(t.spark)}/lake-{uuid.uuid4().hex}")
    for i, source in enumerate("aab"):
        k.rewrite_records(rows.where(F.col("k") == i).select("basin", "subbasin", F.lit(source).alias("source"), "processed_at", "has_data"))
    return k.status().select("basin", "subbasin", "a", "b")
