"""Registered queries of source joins, picks, feature builds, samples, batches and evaluation, with their SQL twins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillflow.functions import columns as C
from rillflow.operators import features, graph, ingest, metrics, samples
from rillflow.plans.registry import DENSE, dense_export, query, rounded, rounded_as_sql, unequal
from rillflow.plans.tables import ATTRS, DAILY, EDGES, OBS, POINTS, PRED_OBS, REACH, SWOT, Tables
from rillflow.sources import lake

# --------------------------------------------------------------------------- joins of sources


@query("SELECT o_orderkey, n_regionkey FROM orders JOIN supplier ON s_suppkey = o_custkey JOIN nation ON n_nationkey = s_nationkey")
def id_chain(t: Tables) -> DataFrame:
    first = t.raw("supplier").withColumnRenamed("s_suppkey", "o_custkey")
    then = t.raw("nation").withColumnRenamed("n_nationkey", "s_nationkey")
    return ingest.translated(t.raw("orders"), [(first, "o_custkey", "s_nationkey"), (then, "s_nationkey", "n_regionkey")]).select("o_orderkey", "n_regionkey")


@query("SELECT c_nationkey AS shard, c_custkey AS key, c_acctbal, o_orderkey, o_totalprice FROM customer JOIN (SELECT * FROM orders JOIN (SELECT c_custkey AS k, c_nationkey AS s FROM customer) ON k = o_custkey) ON o_custkey = c_custkey AND s = c_nationkey")
def inner_by_shard(t: Tables) -> DataFrame:
    c = t.raw("customer").select(F.col("c_nationkey").alias("shard"), F.col("c_custkey").alias("key"), "c_acctbal")
    o = t.raw("orders").withColumnRenamed("o_custkey", "key").join(c.select("shard", "key"), "key").select("shard", "key", "o_orderkey", "o_totalprice")
    return ingest.inner_by_shard(c, o, "shard", "key")


@query(f"SELECT o_orderkey, round(obs * area + 3e-5, 2) AS obs_total, round(pred * area + 3e-5, 2) AS pred_total FROM ({PRED_OBS}) LEFT JOIN ({ATTRS}) USING (subbasin)")
def total_discharge(t: Tables) -> DataFrame:
    df = ingest.total_from_specific(t.pred_obs(), t.attrs(), "subbasin", {"obs_total": "obs", "pred_total": "pred"})
    return rounded(unequal(df, ["obs_total", "pred_total"], 3e-5), ["obs_total", "pred_total"], 2).select("o_orderkey", "obs_total", "pred_total")


@query("""SELECT lat, month, total, round(mean, 4) AS mean FROM (SELECT l_suppkey * 1000 AS lat, date_trunc('month', l_shipdate)::DATE AS month, sum(l_quantity) AS total FROM lineitem WHERE l_linenumber <= 4 GROUP BY ALL)
  JOIN (SELECT l_suppkey * 1000 AS lat, date_trunc('month', l_shipdate)::DATE AS month, avg(l_extendedprice) AS mean FROM lineitem WHERE l_linenumber > 4 GROUP BY ALL) USING (lat, month)""")
def merged_grids(t: Tables) -> DataFrame:
    li = t.raw("lineitem").select(ingest.cell_key(F.col("l_suppkey")).alias("lat"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("month"), "l_quantity", "l_extendedprice", "l_linenumber")
    a = li.where("l_linenumber <= 4").groupBy("lat", "month").agg(F.sum("l_quantity").alias("total"), F.count("*").alias("number"))
    b = li.where("l_linenumber > 4").groupBy("lat", "month").agg(F.avg("l_extendedprice").alias("mean"), F.count("*").alias("number"))
    return rounded(ingest.merged_grids(a, b, ["lat", "month"], ["number"]), ["mean"])


@query(f"SELECT bits AS site, CAST(ts AS DATE) AS date, median(wse) AS wse, median(width) AS width FROM ({SWOT}) JOIN ({ATTRS}) ON subbasin = reach_id GROUP BY ALL")
def reach_series_median(t: Tables) -> DataFrame:
    series = ingest.series_by_id(t.attrs().select(F.col("bits").alias("site"), F.col("subbasin").alias("reach_id")), t.swot(), "reach_id", "site")
    return ingest.daily_median(series.withColumn("date", F.to_date("ts")), "site", "date", ["wse", "width"])


@query("SELECT p_partkey AS reach, s_suppkey % 7 AS station_zone, c_acctbal AS attr FROM part LEFT JOIN supplier ON s_suppkey = p_partkey JOIN customer ON c_custkey = p_partkey")
def stations_on_matches(t: Tables) -> DataFrame:
    stations = t.raw("supplier").select(F.col("s_suppkey").alias("station"), (F.col("s_suppkey") % 7).alias("station_zone"))
    m = t.raw("part").select(F.col("p_partkey").alias("reach"), F.col("p_partkey").alias("station"))
    out = ingest.with_stations(m, stations, t.raw("customer").select(F.col("c_custkey").alias("reach"), F.col("c_acctbal").alias("attr")), "station", "reach")
    return out.select("reach", "station_zone", "attr")


_MATCH = "SELECT DISTINCT l_suppkey AS site, l_partkey AS reach, l_linenumber AS kind, p_retailprice AS reach_area, 1000.0 + l_suppkey AS area FROM lineitem JOIN part ON p_partkey = l_partkey"


@query(f"""WITH m AS (SELECT *, abs((reach_area - area) / ((reach_area + area) / 2)) AS diff FROM ({_MATCH})),
  l AS (SELECT site, list_sort(list(DISTINCT reach + 1000)) AS lakes FROM m WHERE kind = 3 GROUP BY 1),
  u AS (SELECT site, list_sort(list(id)) AS units FROM (SELECT site, unnest([reach % 3, reach % 4]) AS id FROM (SELECT DISTINCT site, reach FROM m)) WHERE id <> 0 GROUP BY 1)
  SELECT site, CASE WHEN river THEN reach END AS reach, coalesce(lake_reaches, []) AS lake_reaches, coalesce(lakes, []) AS lakes, coalesce(units, []) AS units FROM (
    SELECT site, bool_or(kind = 1) AS river, min_by(reach, (diff, reach)) FILTER (diff < 0.3) AS reach, list_sort(list(DISTINCT reach) FILTER (kind = 3)) AS lake_reaches FROM m GROUP BY 1)
  LEFT JOIN l USING (site) LEFT JOIN u USING (site)""")
def best_pairs(t: Tables) -> DataFrame:
    p = t.raw("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("reach_area"))
    m = t.raw("lineitem").join(p, "l_partkey").select(F.col("l_suppkey").alias("site"), F.col("l_partkey").alias("reach"), F.col("l_linenumber").alias("kind"), "reach_area", (F.col("l_suppkey") + 1000.0).alias("area")).distinct()
    ids = t.raw("part").select(F.col("p_partkey").alias("reach"))
    return ingest.best_pairs(m, ids.withColumn("lake", F.col("reach") + 1000), ids.withColumn("ids", F.array(F.col("reach") % 3, F.col("reach") % 4)))


@query(f"SELECT subbasin, round(avg(obs), 4) AS obs, round(avg(pred) + 3e-7, 4) AS pred FROM ({PRED_OBS}) GROUP BY 1")
def site_means(t: Tables) -> DataFrame:
    return rounded(unequal(ingest.site_means(t.pred_obs(), "subbasin", ["obs", "pred"]), ["pred"], 3e-7), ["obs", "pred"])


@query(f"SELECT id % 10 AS region, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM ({POINTS}) GROUP BY 1")
def footprints(t: Tables) -> DataFrame:
    return ingest.bounds(t.points().withColumn("region", F.col("id") % 10), ["region"])


@query(f"SELECT id, x, y FROM ({POINTS}) WHERE x BETWEEN -10 AND 5 AND y BETWEEN -5 AND 20")
def region_filter(t: Tables) -> DataFrame:
    return ingest.in_region(t.points(), -10, -5, 5, 20)


@query(f"""SELECT a.subbasin, round((q - area) / ((q + area) / 2), 6) AS error, greatest(least(s, 10), -10)::DOUBLE AS score FROM ({ATTRS}) a
  JOIN (SELECT l_partkey AS subbasin, max(l_extendedprice) AS q FROM lineitem GROUP BY 1) USING (subbasin) JOIN (SELECT c_custkey AS subbasin, c_acctbal / 500 AS s FROM customer) USING (subbasin)""")
def error_table(t: Tables) -> DataFrame:
    g = t.raw("lineitem").groupBy(F.col("l_partkey").alias("subbasin")).agg(F.max("l_extendedprice").alias("q"))
    s = t.raw("customer").select(F.col("c_custkey").alias("subbasin"), (F.col("c_acctbal") / 500).alias("score"))
    return rounded(ingest.error_table(t.attrs(), g, s, "subbasin", "area", "q", "score"), ["error"], 6)


# --------------------------------------------------------------------------- picks, sets, text


@query(f"""WITH n AS (SELECT subbasin, source, count(*) AS c FROM ({OBS}) GROUP BY ALL), b AS (SELECT subbasin, min(source) AS source FROM (SELECT *, max(c) OVER (PARTITION BY subbasin) AS m FROM n) WHERE c = m GROUP BY 1)
  SELECT event_id, subbasin, source FROM ({OBS}) JOIN b USING (subbasin, source)""")
def longest_series(t: Tables) -> DataFrame:
    return ingest.longest_series(t.obs(), "subbasin", "source").select("event_id", "subbasin", "source")


@query("SELECT c_custkey, c_mktsegment FROM customer ORDER BY CASE WHEN c_mktsegment = 'FURNITURE' THEN 0 ELSE 1 END, c_mktsegment")
def first_then_rest(t: Tables) -> DataFrame:
    return ingest.first_then_rest(t.raw("customer"), "c_mktsegment", "FURNITURE").select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey, first_value(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS outlet FROM customer")
def outlet_by_area(t: Tables) -> DataFrame:
    return ingest.outlet_by_area(t.raw("customer"), "c_nationkey", "c_custkey", "c_acctbal").select("c_custkey", "outlet")


@query(f"SELECT subbasin, date, value FROM ({DAILY}) WHERE subbasin = 7 AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' ORDER BY date")
def one_series(t: Tables) -> DataFrame:
    return ingest.one_series(t.daily(), "subbasin", 7, "date", "2024-01-05", "2024-01-20").select("subbasin", "date", "value")


@query("SELECT c_custkey AS site FROM customer WHERE c_acctbal > 0 UNION SELECT o_custkey FROM orders WHERE o_totalprice > 200000")
def predict_sites(t: Tables) -> DataFrame:
    train = t.raw("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("site"))
    return ingest.all_sites(train, t.raw("orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("site")), ["site"])


@query(f"SELECT p_partkey AS site FROM part INTERSECT SELECT node FROM ({REACH})")
def common_sites(t: Tables) -> DataFrame:
    return ingest.common(t.raw("part").select(F.col("p_partkey").alias("site")), t.reach().select(F.col("node").alias("site")), ["site"])


@query(f"""SELECT event_id, i - 1 - coalesce(l, 0) AS gap, round(1 / (i - coalesce(l, 0))::DOUBLE, 6) AS share FROM (
  SELECT event_id, i, max(CASE WHEN flags < 50 THEN i END) OVER (PARTITION BY subbasin ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM (
    SELECT *, row_number() OVER (PARTITION BY subbasin ORDER BY event_id) AS i FROM ({OBS})))""")
def gap_share(t: Tables) -> DataFrame:
    return rounded(ingest.gap_share(t.obs(), "subbasin", "event_id", F.col("flags") < 50).select("event_id", "gap", "share"), ["share"], 6)


@query("""SELECT part_of, count(*) AS n, min(num) AS least, min(stem) AS stem FROM (SELECT trim(unnest(string_split(p_name || '; ' || p_type, ';'))) AS part_of, TRY_CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT) AS num, string_split(p_type || ' ' || p_brand, ' ')[2] AS stem
  FROM part WHERE p_type ILIKE '%o%' AND starts_with(p_brand, 'Brand#')) WHERE part_of <> '' GROUP BY 1""")
def text_columns(t: Tables) -> DataFrame:
    c = F.col
    p = t.raw("part").where(c("p_type").ilike("%o%") & c("p_brand").startswith("Brand#"))
    p = p.select(F.concat_ws("; ", "p_name", "p_type").alias("parts"), ingest.number_in(c("p_brand")).alias("num"), ingest.name_of_parts(F.concat_ws(" ", "p_type", "p_brand"), " ", 2, 1).alias("stem"))
    return ingest.listed(p, "parts", "part_of").groupBy("part_of").agg(F.count("*").alias("n"), F.min("num").alias("least"), F.min("stem").alias("stem"))


@query(f"""SELECT subbasin, round(CASE WHEN count(*) > 8 THEN avg(abs(obs - pred)) END, 4) AS MAE, round(CASE WHEN count(*) > 8 THEN sqrt(avg((obs - pred) ** 2)) END, 4) AS RMSE,
  round(CASE WHEN count(*) > 8 THEN 1 - sum((ln(obs) - ln(pred)) ** 2) / nullif(var_pop(ln(obs)) * count(*), 0) END, 4) AS "logNSE", round(CASE WHEN count(*) > 10 THEN 1 - sum((log10(obs) - log10(pred)) ** 2) / nullif(var_pop(log10(obs)) * count(*), 0) END, 4) AS log_r2
  FROM ({PRED_OBS}) WHERE obs > 0.001 AND pred > 0.001 GROUP BY 1""")
def error_metrics(t: Tables) -> DataFrame:
    a = metrics.skill(t.pred_obs(), ["subbasin"], metrics={m: metrics.METRICS[m] for m in ("MAE", "RMSE", "logNSE")})
    return rounded(a.join(metrics.log_r2(t.pred_obs(), ["subbasin"], "obs", "pred"), "subbasin", "left"), ["MAE", "RMSE", "logNSE", "log_r2"])


# --------------------------------------------------------------------------- training tables

_STATIC = features.Features(["area"], {"brand": ["Brand#11", "Brand#23", "Brand#45"]}, {"bits": [0, 2, 5]}, {"area": (None, 1800)}, ["area"])


@query(f"""WITH a AS (SELECT subbasin, CASE WHEN area <= 1800 THEN area END AS area, brand, bits FROM ({ATTRS}))
  SELECT subbasin, round(ln(1 + area) - (SELECT avg(ln(1 + area)) FROM a), 6) AS area, {', '.join(f"(brand = 'Brand#{b}')::INT::DOUBLE AS \"brand_Brand#{b}\"" for b in (11, 23, 45))}, {', '.join(f'((bits >> {b}) & 1)::BIGINT AS bits_bit_{b}' for b in (0, 2, 5))} FROM a""")
def encoded_static(t: Tables) -> DataFrame:
    return rounded(features.static_features(t.attrs(), "subbasin", _STATIC), ["area"], 6)


@query(f"""WITH d AS (SELECT c_nationkey AS basin, o_custkey AS subbasin, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_totalprice BETWEEN 2000 AND 300000 THEN o_totalprice END AS price, o_orderkey::DOUBLE AS shift, o_orderstatus AS status
    FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderdate >= DATE '1994-01-01' AND CAST(o_orderdate AS DATE) <= DATE '1997-12-31'),
  s AS (SELECT avg(ln(1 + price)) AS po, stddev_pop(ln(1 + price)) AS ps, avg(shift) AS so, stddev_pop(shift) AS ss FROM d)
  SELECT basin, subbasin, date, round((ln(1 + price) - po) / ps, 5) AS price, round((shift - so) / ss, 5) AS shift, (status = 'F')::INT::DOUBLE AS "status_F", (status = 'O')::INT::DOUBLE AS "status_O" FROM d, s""")
def feature_table(t: Tables) -> DataFrame:
    o = t.raw("orders").join(t.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
    d = o.select(F.col("c_nationkey").alias("basin"), F.col("o_custkey").alias("subbasin"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").cast("double").alias("shift"), F.col("o_orderstatus").alias("status"))
    f = features.Features(["price", "shift"], {"status": ["F", "O"]}, ranges={"price": (2000, 300000)}, log=["price"])
    return rounded(features.feature_table(d, f, [("1994-01-01", "1995-12-31"), ("1996-01-01", "1997-12-31")])[0], ["price", "shift"], 5)


@query(f"""WITH d AS ({DENSE}), w AS (SELECT subbasin, date, list(value) OVER v AS x, count(*) OVER v AS n FROM d WINDOW v AS (PARTITION BY subbasin ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
  n AS (SELECT s.subbasin, s.subbasin % 20 AS basin, c_acctbal AS a, s.subbasin IN (SELECT s_suppkey FROM supplier) AS inside FROM (SELECT DISTINCT subbasin FROM ({OBS})) s LEFT JOIN customer ON c_custkey = s.subbasin),
  i AS (SELECT basin, date AS end_date FROM n JOIN d USING (subbasin) GROUP BY ALL HAVING bool_or(value IS NOT NULL) AND date >= (SELECT min(date) FROM d) + 3)
  SELECT i.basin, end_date, list(subbasin ORDER BY subbasin) AS subbasin, list(x ORDER BY subbasin) AS x_value, list([CASE WHEN inside THEN x[3] END] ORDER BY subbasin) AS y_value, list(a ORDER BY subbasin) AS s_a
  FROM i JOIN n ON n.basin = i.basin JOIN w USING (subbasin) WHERE w.date = end_date GROUP BY ALL""")
def basin_samples(t: Tables) -> DataFrame:
    dense = dense_export(t).withColumn("basin", F.col("subbasin") % 20)
    nodes = dense.select("basin", F.col("subbasin").alias("node")).distinct()
    static = t.raw("customer").select(F.col("c_custkey").alias("subbasin"), F.col("c_acctbal").alias("a"))
    index = samples.sample_index(dense, ["value"], 3, str(t.daily().agg(F.min("date")).first()[0]))
    out = features.assembled(index, dense, graph.numbered(nodes, "basin"), ["value"], ["value"], t.raw("supplier").select(F.col("s_suppkey").alias("subbasin")), 3, static)
    return out.drop("sample_id")


@query("""WITH l AS (SELECT l_orderkey AS k, l_orderkey // 4 AS batch, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS place, l_quantity AS v FROM lineitem),
  s AS (SELECT k, batch, count(*) AS n FROM l GROUP BY ALL), o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY batch ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off, sum(n) OVER (PARTITION BY batch)::BIGINT AS real,
    (dense_rank() OVER (PARTITION BY batch ORDER BY k) - 1)::BIGINT AS g FROM s),
  v AS (SELECT batch, any_value(real) AS real, list(v ORDER BY k, place) AS v, list(g ORDER BY k, place) AS g FROM l JOIN o USING (k, batch) GROUP BY 1),
  e AS (SELECT batch, list(off + place ORDER BY k, place) AS src, list(off + place + 1 ORDER BY k, place) AS dst FROM l JOIN o USING (k, batch) WHERE place < n - 1 GROUP BY 1)
  SELECT batch, real, list_resize(v, 32, 0) AS value, list_resize(g, 32, 0) AS graph_idx, list_resize(coalesce(src, []), 32, real) AS src, list_resize(coalesce(dst, []), 32, real) AS dst,
    [i < real for i in range(32)] AS node_mask, [i < len(coalesce(src, [])) for i in range(32)] AS edge_mask FROM v LEFT JOIN e USING (batch)""")
def collated_batches(t: Tables) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity")
    n = t.raw("lineitem").select(F.col("l_orderkey").alias("sample_id"), (F.row_number().over(w) - 1).cast("long").alias("place"), F.col("l_quantity").cast("double").alias("value"))
    last = n.groupBy("sample_id").agg(F.max("place").alias("m"))
    e = n.join(last, "sample_id").where("place < m").select("sample_id", F.col("place").alias("src"), (F.col("place") + 1).alias("dst"))
    b = last.select("sample_id", F.floor(F.col("sample_id") / 4).cast("long").alias("batch"), F.col("sample_id").alias("slot"))
    return features.collated(b, n, e, 32, resized=True)  # its SQL resizes lists, so four orders of more than 32 lines are no error


_NODES = f"SELECT s.subbasin, s.subbasin % 5 AS basin, c_acctbal AS a, s.subbasin IN (SELECT s_suppkey FROM supplier) AS inside, (row_number() OVER (PARTITION BY s.subbasin % 5 ORDER BY s.subbasin) - 1)::BIGINT AS place FROM (SELECT DISTINCT subbasin FROM ({OBS})) s LEFT JOIN customer ON c_custkey = s.subbasin"
_TWO = f"SELECT subbasin, date, CAST(avg(value) FILTER (source = 'view') AS DOUBLE) AS v, CAST(avg(flags) FILTER (source <> 'view') AS DOUBLE) AS k FROM ({OBS}) GROUP BY ALL"
_TWO_DENSE = f"SELECT s.subbasin, s.basin, s.date, t.v, t.k FROM (SELECT n.subbasin, n.basin, c.date FROM ({_NODES}) n CROSS JOIN (SELECT unnest(generate_series((SELECT min(date) FROM ({DAILY})), (SELECT max(date) FROM ({DAILY})), INTERVAL 1 DAY))::DATE AS date) c) s LEFT JOIN ({_TWO}) t USING (subbasin, date)"
_BATCH = 3


def _whole(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Sample index and whole samples of five basins with two variables, static attributes, edges and inflow."""
    two = t.obs().groupBy("subbasin", "date").agg(C.mean_in_order(F.when(F.col("source") == "view", F.col("value")), F.col("event_id")).alias("v"), F.avg(F.when(F.col("source") != "view", F.col("flags"))).alias("k"))
    days = t.daily().agg(F.explode(F.sequence(F.min("date"), F.max("date"))).alias("date"))
    dense = lake.dense(two, two, days).withColumn("basin", F.col("subbasin") % 5)
    places = graph.numbered(t.reach().select("node", (F.col("node") % 5).alias("basin")), "basin")
    inner = t.edges().where("src % 5 = dst % 5")
    at = lambda x: places.select(F.col("node").alias(x), F.col("place").alias(f"_{x}"))
    edges = inner.join(at("src"), "src").join(at("dst"), "dst").select((F.col("src") % 5).alias("basin"), F.col("_src").alias("src"), F.col("_dst").alias("dst"))
    static = t.raw("customer").select(F.col("c_custkey").alias("subbasin"), F.col("c_acctbal").alias("a"))
    index = graph.cut(samples.sample_index(dense, ["v", "k"], 4, str(t.daily().agg(F.min("date")).first()[0])))
    subset = t.raw("supplier").select(F.col("s_suppkey").alias("subbasin"))
    return index, features.assembled(index, dense, places, ["v", "k", "absent"], ["v", "k"], subset, 4, static, edges=edges, inflow=graph.inflow_slots(inner, places))


def _collated(t: Tables) -> DataFrame:
    index, whole = _whole(t)
    b = index.select("sample_id", F.floor(F.col("sample_id") / _BATCH).cast("long").alias("batch"), (F.col("sample_id") % _BATCH).alias("slot"))
    most = t.reach().groupBy(F.col("node") % 5).count().agg(F.max("count")).first()[0]
    return features.collated_samples(b, whole, _BATCH * most + 2, {"sat": ["v", "absent"], "flag": ["k"]}, ["v", "k"], ["a"], fill=-1.0)


_INDEX = f"""SELECT row_number() OVER (ORDER BY basin, date) - 1 AS i, basin, date AS end_date FROM (SELECT basin, date FROM ({_TWO_DENSE}) GROUP BY ALL HAVING bool_or(v IS NOT NULL OR k IS NOT NULL) AND date >= (SELECT min(date) FROM ({DAILY})) + 4)"""
_COLLATED = f"""WITH n AS MATERIALIZED ({_NODES}), d AS MATERIALIZED ({_TWO_DENSE}), i AS MATERIALIZED ({_INDEX}), size AS (SELECT {_BATCH} * max(c) + 2 AS size FROM (SELECT count(*) AS c FROM n GROUP BY basin)),
  s AS (SELECT i // {_BATCH} AS batch, i % {_BATCH} AS slot, i.basin, end_date, n.subbasin, n.place, n.a, n.inside FROM i JOIN n USING (basin)),
  p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY slot, place) - 1 AS pos, count(*) OVER (PARTITION BY batch) AS real FROM s),
  o AS MATERIALIZED (SELECT batch, slot, min(pos) AS off FROM p GROUP BY ALL),
  w AS MATERIALIZED (SELECT p.batch, p.pos, t.t, d.v, d.k, p.inside FROM p CROSS JOIN (SELECT unnest(range(4)) AS t) t JOIN d ON d.subbasin = p.subbasin AND d.date = p.end_date - 3 + t.t::INTEGER),
  c AS (SELECT batch, t, list([v, NULL::DOUBLE] ORDER BY pos) AS sat, list([k] ORDER BY pos) AS flag, list(CASE WHEN inside THEN v END ORDER BY pos) AS yv, list(CASE WHEN inside THEN k END ORDER BY pos) AS yk FROM w GROUP BY ALL),
  x AS (SELECT batch, list(list_concat(sat, list_transform(range(size - len(sat)), lambda z: [-1::DOUBLE, -1])) ORDER BY t) AS x_sat, list(list_concat(flag, list_transform(range(size - len(flag)), lambda z: [-1::DOUBLE])) ORDER BY t) AS x_flag,
    [list_resize(max_by(yv, t), any_value(size), -1)] AS y_v, [list_resize(max_by(yk, t), any_value(size), -1)] AS y_k FROM c, size GROUP BY 1),
  e AS MATERIALIZED (SELECT p.batch, p.slot, p.pos - p.place + a.place AS src, p.pos - p.place + b.place AS dst FROM p JOIN ({EDGES}) e ON e.src = p.subbasin JOIN n a ON a.subbasin = e.src JOIN n b ON b.subbasin = e.dst WHERE a.basin = b.basin),
  g AS (SELECT batch, list(src ORDER BY slot, src, dst) AS src, list(dst ORDER BY slot, src, dst) AS dst FROM e GROUP BY 1),
  f AS (SELECT batch, dst AS pos, list(src ORDER BY src)[1:2] AS l FROM e GROUP BY ALL),
  q AS (SELECT p.batch, list([coalesce(l[1], real), coalesce(l[2], real)] ORDER BY pos) AS l, list([coalesce(len(l) >= 1, false), coalesce(len(l) >= 2, false)] ORDER BY pos) AS m FROM p LEFT JOIN f USING (batch, pos) GROUP BY 1),
  m AS (SELECT batch, any_value(real) AS real, list(basin ORDER BY pos) AS basin, list(subbasin ORDER BY pos) AS subbasin, list(end_date ORDER BY pos) AS end_date, list([a] ORDER BY pos) AS s, list(slot ORDER BY pos) AS idx FROM p GROUP BY 1)
  SELECT m.batch, m.real, m.basin, m.subbasin, m.end_date, x_sat, x_flag, y_v, y_k, list_concat(m.s, list_transform(range(size - m.real), lambda z: [-1::DOUBLE])) AS s, list_resize(coalesce(g.src, []), size, m.real) AS src, list_resize(coalesce(g.dst, []), size, m.real) AS dst,
    list_resize(m.idx, size, 0) AS graph_idx, list_transform(range(size), lambda z: z < m.real) AS node_mask, list_transform(range(size), lambda z: z < coalesce(len(g.src), 0)) AS edge_mask,
    list_concat(q.l, list_transform(range(size - m.real), lambda z: [m.real, m.real])) AS inflow, list_concat(q.m, list_transform(range(size - m.real), lambda z: [false, false])) AS inflow_mask
  FROM m JOIN x USING (batch) JOIN q USING (batch) LEFT JOIN g USING (batch), size"""


@query(_COLLATED)
def collated_samples(t: Tables) -> DataFrame:
    return _collated(t)


def _mean_model(batch: dict) -> dict:
    """Predicts from the last two days of each node and its attribute, with a deviation for one target."""
    v, k = np.nan_to_num(batch["x_sat"][-2:, :, 0]), np.nan_to_num(batch["x_flag"][-2:, :, 0])
    return {"v": (0.01 * v.sum(0) + 0.1, 0.5 + 0 * v[0]), "k": k.mean(0) + np.nan_to_num(batch["s"][:, 0]) / 1000}


@query(f"""WITH d AS MATERIALIZED ({_TWO_DENSE}), n AS ({_NODES}), i AS ({_INDEX})
  SELECT i.basin, n.subbasin, i.end_date AS date, CASE WHEN inside THEN round(exp(2 * b.v + 1) - 1, 4) END AS obs_v, round(exp(2 * (0.01 * (coalesce(a.v, 0) + coalesce(b.v, 0)) + 0.1) + 1) - 1, 4) AS pred_v,
    round(sqrt((exp(1.0) - 1) * exp(2 * (2 * (0.01 * (coalesce(a.v, 0) + coalesce(b.v, 0)) + 0.1) + 1) + 1)), 4) AS pred_v_std, CASE WHEN inside THEN round(b.k * 3 + 7, 4) END AS obs_k, round(((coalesce(a.k, 0) + coalesce(b.k, 0)) / 2 + coalesce(n.a, 0) / 1000) * 3 + 7, 4) AS pred_k
  FROM i JOIN n USING (basin) JOIN d b ON b.subbasin = n.subbasin AND b.date = i.end_date JOIN d a ON a.subbasin = n.subbasin AND a.date = i.end_date - 1""".replace("exp(2 * b.v + 1)", "exp(2 * b.v / 100 + 1)"))
def batch_predictions(t: Tables) -> DataFrame:
    """The whole path: daily sources, sample index, halo blocks, whole samples, collated batches, a model, natural units."""
    small = _collated(t).withColumn("y_v", F.transform("y_v", lambda d: F.transform(d, lambda v: v / 100)))
    out = features.batch_predictions(small, _mean_model, {"v": (1.0, 2.0, True), "k": (7.0, 3.0, False)}, deviation=True)
    return rounded_as_sql(out, ["obs_v", "pred_v", "pred_v_std", "obs_k", "pred_k"]).select("basin", "subbasin", "date", "obs_v", "pred_v", "pred_v_std", "obs_k", "pred_k")


_PAIR = """SELECT c_nationkey AS basin, o_orderkey, o_totalprice AS obs, exp(11 + 0.5 * (o_totalprice / 200000 - 0.1 * c_nationkey / 25)) - 1 AS pred FROM orders JOIN customer ON c_custkey = o_custkey"""


def _scored(t: Tables) -> DataFrame:
    o = t.raw("orders").join(t.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
    z = C.normalised(F.col("o_totalprice"), F.lit(11.0), F.lit(0.5), F.lit(True))
    d = o.select(F.col("c_nationkey").alias("basin"), "o_orderkey", (F.col("o_totalprice") / 200000).alias("a"), (F.col("c_nationkey") / 25).alias("b"), z.alias("y"))
    return features.predictions(d, ["basin", "o_orderkey"], ["a", "b"], "y", (11.0, 0.5, True), lambda x: x["a"] - 0.1 * x["b"])


@query(f"SELECT basin, o_orderkey, round(obs, 3) AS obs, round(pred, 3) AS pred FROM ({_PAIR})")
def predictions(t: Tables) -> DataFrame:
    return rounded(_scored(t), ["obs", "pred"], 3)


@query(f"""SELECT basin, CASE WHEN count(*) > 0 THEN count(*) END AS num_obs, round(CASE WHEN count(*) > 8 THEN 1 - sum((obs - pred) ** 2) / (var_pop(obs) * count(*)) END, 4) AS "NSE",
  round(CASE WHEN count(*) > 8 THEN 1 - sqrt((corr(obs, pred) - 1) ** 2 + (stddev_pop(pred) / stddev_pop(obs) - 1) ** 2 + (avg(pred) / avg(obs) - 1) ** 2) END, 4) AS "KGE" FROM ({_PAIR}) GROUP BY GROUPING SETS ((), (basin))""")
def evaluated(t: Tables) -> DataFrame:
    bulk, sites = features.evaluated(_scored(t), "basin")
    return rounded(sites.unionByName(bulk.withColumn("basin", F.lit(None).cast("int"))), ["NSE", "KGE"])
