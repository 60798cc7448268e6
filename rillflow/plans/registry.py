"""Registered queries on the given tables, and their SQL twins. Floats are rounded on both sides, as their sums depend on order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.functions import columns as C
from rillflow.operators import clean, graph, matching, metrics, samples, stats, windows
from rillflow.plans.tables import ATTRS, DAILY, EDGES, MIXTURE, OBS, POINTS, PRED_OBS, REACH, SWOT, Tables
from rillflow.sources import lake

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, names: list[str], digits: int = 4) -> DataFrame:
    """Rounded; nothing is left of a zero's sign."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in names})


def rounded_as_sql(df: DataFrame, names: list[str], digits: int = 4) -> DataFrame:
    """Rounded as the SQL twins round doubles: whole multiples of the last digit, halves away from zero. Where a value has halves of that digit, F.round() goes by its shortest decimal form, which may lie on the other side."""
    unit = 10.0**digits

    def one(c: Column) -> Column:
        v = F.abs(c) * unit
        return F.signum(c) * (F.rint(v) + F.when(v - F.rint(v) == 0.5, 1.0).otherwise(0.0)) / unit + F.lit(0.0)  # rint() goes to the even side of a half; F.round() would go by way of decimals

    return df.withColumns({c: one(F.col(c).cast("double")) for c in names})


def unequal(df: DataFrame, names: list[str], by: float) -> DataFrame:
    """Moved by a little, so that halves of the last digit round alike in any engine."""
    return df.withColumns({c: F.col(c) + by for c in names})


# --------------------------------------------------------------------------- cleaning


@query(f"SELECT reach_id, date, wse, wse_u FROM (SELECT *, CAST(ts AS DATE) AS date, row_number() OVER (PARTITION BY reach_id, CAST(ts AS DATE) ORDER BY wse_u, wse, ts) AS n FROM ({SWOT})) WHERE n = 1")
def daily_best_obs(t: Tables) -> DataFrame:
    return clean.best_observation(t.swot(), "reach_id", "ts", "wse_u", "wse").select("reach_id", "date", "wse", "wse_u")


@query(f"""SELECT key, q, CASE WHEN wse BETWEEN 20000 AND 60000 THEN wse END AS wse, CASE WHEN wse_u > 0.05 THEN width END AS width_lt, CASE WHEN wse_u < 0.05 THEN width END AS width_gt,
  CASE WHEN wse_u <> 0.05 THEN width END AS width_eq, CASE WHEN slope <> 0 THEN slope END AS slope FROM ({SWOT})""")
def clip_and_filter(t: Tables) -> DataFrame:
    c = F.col
    return t.swot().select(
        "key", "q", C.clip_to_null(c("wse"), 20000, 60000).alias("wse"), C.value_filter(c("width"), c("wse_u"), "less_than", 0.05).alias("width_lt"), C.value_filter(c("width"), c("wse_u"), "greater_than", 0.05).alias("width_gt"),
        C.value_filter(c("width"), c("wse_u"), "equals", 0.05).alias("width_eq"), C.sentinel_to_null(c("slope"), 0.0).alias("slope"),
    )


@query(f"SELECT reach_id, key, q, width, slope FROM ({SWOT}) WHERE width > 0 AND slope > 0 AND wse_u < 0.05 AND q < 6 AND reach_id IN (SELECT reach_id FROM ({SWOT}) WHERE width > 0 AND slope > 0 AND wse_u < 0.05 AND q < 6 GROUP BY 1 HAVING count(*) >= 10)")
def physical_screen(t: Tables) -> DataFrame:
    return clean.enough_rows(clean.quality_gate(t.swot(), "q", "wse_u", 6, 0.05), "reach_id", "width", "slope", 10).select("reach_id", "key", "q", "width", "slope")


@query(f"SELECT o_orderkey, CASE WHEN s_suppkey IS NOT NULL THEN obs END AS obs, pred FROM (SELECT o_orderkey, subbasin, obs, round(pred + 3e-7, 4) AS pred FROM ({PRED_OBS}) WHERE date BETWEEN DATE '1995-01-01' AND DATE '1997-12-31') LEFT JOIN supplier ON s_suppkey = subbasin")
def targets_of_subset(t: Tables) -> DataFrame:
    df = clean.time_slice(t.pred_obs(), "date", [("1995-01-01", "1996-06-30"), ("1996-01-01", "1997-12-31")])
    df = clean.blank_outside(df, t.raw("supplier").select(F.col("s_suppkey").alias("subbasin")), "subbasin", ["obs"])
    return rounded(unequal(df, ["pred"], 3e-7), ["pred"]).select("o_orderkey", "obs", "pred")


# --------------------------------------------------------------------------- windows


@query(f"""SELECT key, q, round(wse - median(wse) OVER w, 4) AS d_wse, round(width - median(width) OVER w, 4) AS d_width,
  round((wse - median(wse) OVER w) * (width + median(width) OVER w) / 2 + 3e-5, 2) AS d_area FROM ({SWOT}) WINDOW w AS (PARTITION BY reach_id)""")
def median_deviation(t: Tables) -> DataFrame:
    df = windows.trapezoid_change(windows.median_deviation(t.swot(), "reach_id", ["wse", "width"]), "reach_id", "wse", "width")
    return rounded(rounded(unequal(df, ["d_area"], 3e-5), ["d_wse", "d_width"]), ["d_area"], 2).select("key", "q", "d_wse", "d_width", "d_area")


@query(f"SELECT key, q, round(log10(wse / median(wse) OVER (PARTITION BY reach_id)), 6) AS rel FROM ({SWOT})")
def relative_change(t: Tables) -> DataFrame:
    return rounded(windows.relative_change(t.swot(), "reach_id", "wse"), ["rel"], 6).select("key", "q", "rel")


@query(f"""SELECT subbasin, date, round(avg(value) OVER (PARTITION BY subbasin ORDER BY date RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) + 3e-10, 4) AS value_7d,
  round(avg(value) OVER (PARTITION BY subbasin ORDER BY date RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW) + 3e-10, 4) AS value_30d FROM ({DAILY})""")
def rolling_means(t: Tables) -> DataFrame:
    df = windows.rolling_means(t.daily(), "subbasin", "date", "value", [7, 30])
    return rounded(unequal(df, ["value_7d", "value_30d"], 3e-10), ["value_7d", "value_30d"]).select("subbasin", "date", "value_7d", "value_30d")


_CLICK = f"SELECT subbasin, date, max(CASE WHEN source = 'click' THEN value END) AS a, max(CASE WHEN flags < 50 THEN value END) AS b FROM ({OBS}) GROUP BY ALL"


@query(f"""SELECT subbasin, date, l.a AS last_a, l.b AS last_b, CAST(date - l.d AS INTEGER) AS staleness, l IS NOT NULL AS seen, round(exp(-0.5 * (date - l.d)), 6) AS decay FROM (
  SELECT subbasin, date, last_value(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN {{'d': date, 'a': a, 'b': b}} END IGNORE NULLS) OVER (PARTITION BY subbasin ORDER BY date ROWS UNBOUNDED PRECEDING) AS l FROM ({_CLICK}))""")
def obs_memory(t: Tables) -> DataFrame:
    df = t.obs().groupBy("subbasin", "date").agg(F.max(F.when(F.col("source") == "click", F.col("value"))).alias("a"), F.max(F.when(F.col("flags") < 50, F.col("value"))).alias("b"))
    df = windows.observation_memory(df, "subbasin", "date", ["a", "b"])
    return df.select("subbasin", "date", "last_a", "last_b", "staleness", "seen", F.round(windows.staleness_gates(F.col("staleness"), 3)["decay"], 6).alias("decay"))


@query(f"""SELECT key, q, coalesce(0.6745 * d / nullif(m, 0) < 1.5, false) AS ok FROM (SELECT *, median(abs(d)) OVER (PARTITION BY reach_id) AS m FROM (
  SELECT *, x - median(x) OVER (PARTITION BY reach_id) AS d FROM (SELECT *, ln(1 + wse + abs(min(wse) OVER (PARTITION BY reach_id))) AS x FROM ({SWOT}))))""")
def robust_mask(t: Tables) -> DataFrame:
    return windows.robust_mask(t.swot(), "reach_id", "wse", 1.5).select("key", "q", "ok")


@query(f"SELECT event_id, round(coalesce(exp(value - m) / sum(exp(value - m)) OVER (PARTITION BY subbasin), 0), 8) AS weight FROM (SELECT *, max(value) OVER (PARTITION BY subbasin) AS m FROM ({OBS}))")
def segment_softmax(t: Tables) -> DataFrame:
    return rounded(windows.segment_softmax(t.obs(), "subbasin", "value"), ["weight"], 8).select("event_id", "weight")


@query(f"""SELECT event_id, round(1 / (1 + exp(-CASE WHEN n > 1 THEN -10 + 20 * i / (n - 1)::DOUBLE ELSE -10 END)), 8) AS weight FROM (
  SELECT event_id, count(*) OVER (PARTITION BY subbasin) AS n, row_number() OVER (PARTITION BY subbasin ORDER BY event_id) - 1 AS i FROM ({OBS}))""")
def position_weights(t: Tables) -> DataFrame:
    return rounded(windows.position_weights(t.obs(), "subbasin", "event_id"), ["weight"], 8).select("event_id", "weight")


@query(f"SELECT subbasin, n, CASE WHEN (row_number() OVER (ORDER BY n DESC, subbasin) - 1) % 5 = 4 THEN 'test' ELSE 'train' END AS split FROM (SELECT subbasin, count(*) AS n FROM ({OBS}) GROUP BY 1)")
def split_every_fifth(t: Tables) -> DataFrame:
    return windows.every_fifth(t.obs().groupBy("subbasin").agg(F.count("*").alias("n")), "n", "subbasin").select("subbasin", "n", "split")


@query("SELECT o_orderkey, CAST(ceil(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) / 4.0) AS BIGINT) AS chunk FROM orders")
def chunked_rows(t: Tables) -> DataFrame:
    return windows.chunked(t.raw("orders"), "o_custkey", "o_orderkey", 4).select("o_orderkey", "chunk")


@query("SELECT o_orderkey, n, coalesce(sum(n) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def collate_offsets(t: Tables) -> DataFrame:
    n = t.raw("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return windows.running_offset(t.raw("orders").join(n, F.col("o_orderkey") == F.col("l_orderkey")), "o_custkey", "o_orderkey", "n").select("o_orderkey", "n", "offset")


@query(f"SELECT subbasin, date, round((coalesce(a, 0) + coalesce(b, 0)) / greatest((a IS NOT NULL)::INT + (b IS NOT NULL)::INT, 1), 6) AS pooled FROM ({_CLICK})")
def pooled_sources(t: Tables) -> DataFrame:
    df = t.obs().groupBy("subbasin", "date").agg(F.max(F.when(F.col("source") == "click", F.col("value"))).alias("a"), F.max(F.when(F.col("flags") < 50, F.col("value"))).alias("b"))
    return rounded(windows.pooled_sources(df, ["a", "b"]), ["pooled"], 6).select("subbasin", "date", "pooled")


# --------------------------------------------------------------------------- statistics and encodings

_LINES = "SELECT c_nationkey AS basin, o_totalprice AS price, CAST(o_orderkey AS DOUBLE) - 3000 AS shifted FROM orders JOIN customer ON c_custkey = o_custkey"
_PARTS = f"""SELECT basin, var, count(x) AS count, sum(x) AS sum, sum(x * x) AS sum_sq, min(x) AS min, max(x) AS max, sum(CASE WHEN x >= 0 THEN ln(1 + x) END) AS log_sum,
  sum(CASE WHEN x >= 0 THEN ln(1 + x) * ln(1 + x) END) AS log_sum_sq, count(CASE WHEN x >= 0 THEN 1 END) AS positive_count
  FROM (SELECT basin, 'price' AS var, price AS x FROM ({_LINES}) UNION ALL SELECT basin, 'shifted', shifted FROM ({_LINES})) GROUP BY ALL"""


def _parts(t: Tables) -> DataFrame:
    df = t.raw("orders").join(t.raw("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("basin"), F.col("o_totalprice").alias("price"), (F.col("o_orderkey").cast("double") - 3000).alias("shifted"))
    return stats.partial_stats(df, "basin", ["price", "shifted"])


@query(f"SELECT basin, var, count, round(sum, 2) AS sum, round(sum_sq / 1e6, 2) AS sum_sq, min, max, round(log_sum, 4) AS log_sum, round(log_sum_sq, 4) AS log_sum_sq, positive_count FROM ({_PARTS})")
def basin_stats_partial(t: Tables) -> DataFrame:
    return rounded(rounded(_parts(t).withColumn("sum_sq", F.col("sum_sq") / 1e6), ["sum", "sum_sq"], 2), ["log_sum", "log_sum_sq"])


_SCALE = f"""SELECT var, var = 'price' AS log_norm, CASE WHEN var = 'price' THEN ls / pc ELSE s / c END AS offset_,
  CASE WHEN var = 'price' THEN sqrt(lq / pc - (ls / pc) * (ls / pc)) ELSE sqrt(q / c - (s / c) * (s / c)) END AS scale_
  FROM (SELECT var, sum(count) AS c, sum(sum) AS s, sum(sum_sq) AS q, sum(log_sum) AS ls, sum(log_sum_sq) AS lq, sum(positive_count) AS pc FROM ({_PARTS}) GROUP BY 1)"""


@query(f"SELECT var, log_norm, round(offset_, 6) AS \"offset\", round(scale_, 6) AS scale FROM ({_SCALE})")
def scale_final(t: Tables) -> DataFrame:
    return rounded(stats.scale(stats.merged_stats(_parts(t)), log=["price"]), ["offset", "scale"], 6)


@query(f"SELECT o_orderkey, round((ln(1 + o_totalprice) - offset_) / scale_, 6) AS z, round(o_totalprice, 4) AS back FROM orders, ({_SCALE}) WHERE var = 'price'")
def normalize_roundtrip(t: Tables) -> DataFrame:
    s = F.broadcast(stats.scale(stats.merged_stats(_parts(t)), log=["price"]).where("var = 'price'"))
    df = t.raw("orders").join(s)
    z = C.normalised(F.col("o_totalprice"), F.col("offset"), F.col("scale"), F.col("log_norm"))
    return rounded(rounded(df.select("o_orderkey", z.alias("z"), C.denormalised(z, F.col("offset"), F.col("scale"), F.col("log_norm")).alias("back")), ["z"], 6), ["back"])


@query(f"""SELECT 'area' AS var, true AS log_norm, round(avg(ln(1 + area)), 6) AS "offset", 1.0 AS scale FROM ({ATTRS})
  UNION ALL SELECT 'bits', false, round(avg(bits), 6), round(stddev_samp(bits), 6) FROM ({ATTRS})""")
def static_scale(t: Tables) -> DataFrame:
    return rounded(stats.static_scale(t.attrs(), ["area", "bits"], ["area"]), ["offset", "scale"], 6)


_BRANDS = ["Brand#11", "Brand#23", "Brand#45"]


@query("SELECT subbasin, " + ", ".join(f"CASE WHEN brand = '{b}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"brand_{b}\"" for b in _BRANDS) + ", " + ", ".join(f"((bits >> {i}) & 1)::BIGINT AS bits_bit_{i}" for i in (0, 2, 5)) + f" FROM ({ATTRS})")
def one_hot_and_bits(t: Tables) -> DataFrame:
    return t.attrs().select("subbasin", *C.one_hot(F.col("brand"), "brand", _BRANDS), *C.bit_columns(F.col("bits"), "bits", [0, 2, 5]))


@query(f"SELECT (row_number() OVER (ORDER BY brand) - 1)::INTEGER AS place, brand AS category FROM (SELECT DISTINCT brand FROM ({ATTRS}))")
def inferred_categories(t: Tables) -> DataFrame:
    return stats.categories(t.attrs(), "brand")


@query(f"SELECT b::INTEGER AS bit FROM (SELECT bit_or(bits) AS m FROM ({ATTRS})), (SELECT unnest(range(32)) AS b) WHERE (m >> b) & 1 = 1")
def inferred_bits(t: Tables) -> DataFrame:
    return stats.active_bits(t.attrs(), "bits")


# --------------------------------------------------------------------------- metrics

_P = f"SELECT subbasin, basin, obs AS o, pred AS p FROM ({PRED_OBS}) WHERE obs > 0.001 AND pred > 0.001"
_NAMES = ["NSE", "r", "KGE", "sigE", "rRMSE", "MAPE", "nBias", "RE", "RB", "agreement"]


def _metric_sql(key: str) -> str:
    g, by = (f"PARTITION BY {key}", f"GROUP BY {key}") if key else ("", "")
    k = f"{key}, " if key else ""
    eq = f"PARTITION BY {k}o", f"PARTITION BY {k}p"
    return f"""WITH d AS ({_P}), w AS (SELECT *, rank() OVER ({g} ORDER BY o) + (count(*) OVER ({eq[0]}) - 1) / 2 AS ro, rank() OVER ({g} ORDER BY p) + (count(*) OVER ({eq[1]}) - 1) / 2 AS rp,
      avg(o) OVER ({g}) AS mo, avg(p) OVER ({g}) AS mp FROM d),
    a AS (SELECT {k}count(*) AS n, sum((o - p) * (o - p)) AS sse, var_pop(o) AS vo, var_pop(p) AS vp, avg(o) AS ao, avg(p) AS ap, corr(o, p) AS c, corr(ro, rp) AS r, covar_pop(o, p) AS cv,
      quantile_cont(abs((p - mp - (o - mo)) / mo), 0.67) AS sige, avg(abs((p - o) / o)) AS mape, median((p - o) / o) AS nb, median(abs(ln(p / o))) AS al, median(ln(p / o)) AS ml FROM w {by})
    SELECT {k}n AS num_obs, round(1 - sse / nullif(vo * n, 0), 4) AS NSE, round(r, 4) + 0.0 AS r, round(1 - sqrt((c - 1) ** 2 + (sqrt(vp) / sqrt(vo) - 1) ** 2 + (ap / ao - 1) ** 2), 4) AS KGE, round(sige, 4) AS sigE,
      round(100 * sqrt(sse / n) / ap, 4) AS rRMSE, round(mape, 4) AS MAPE, round(nb, 4) + 0.0 AS nBias, round(100 * (exp(al) - 1), 4) AS RE, round(100 * sign(ml) * (exp(abs(ml)) - 1), 4) AS RB,
      round(1 - sse / n / nullif(vo + vp + (ao - ap) ** 2 + CASE WHEN c >= 0 THEN 0 ELSE 2 * abs(cv) END, 0), 4) + 0.0 AS agreement FROM a"""


_SITE_SQL = _metric_sql("subbasin")


@query(f"SELECT subbasin, num_obs, {', '.join(f'CASE WHEN num_obs > 8 THEN {m} END AS {m}' for m in _NAMES)} FROM ({_SITE_SQL})")
def site_metrics(t: Tables) -> DataFrame:
    df = metrics.skill(t.pred_obs(), ["subbasin"], metrics={k: metrics.METRICS[k] for k in ("num_obs", *_NAMES)})
    return rounded(df, _NAMES)


@query(_metric_sql("basin"))
def basin_metrics(t: Tables) -> DataFrame:
    return rounded(metrics.skill(t.pred_obs(), ["basin"], metrics={k: metrics.METRICS[k] for k in ("num_obs", *_NAMES)}), _NAMES)


@query(_metric_sql(""))
def bulk_metrics(t: Tables) -> DataFrame:
    return rounded(metrics.skill(t.pred_obs(), [], metrics={k: metrics.METRICS[k] for k in ("num_obs", *_NAMES)}), _NAMES)


@query(f"SELECT round(median(NSE), 4) AS NSE, round(median(KGE), 4) AS KGE, count(*) AS sites FROM ({_SITE_SQL}) WHERE num_obs >= 10")
def median_metrics(t: Tables) -> DataFrame:
    df = metrics.skill(t.pred_obs(), ["subbasin"], metrics={k: metrics.METRICS[k] for k in ("num_obs", "NSE", "KGE")})
    return rounded(metrics.median_skill(rounded(df, ["NSE", "KGE"]), ["NSE", "KGE"]), ["NSE", "KGE"])


@query(f"SELECT o_orderkey, round(cume_dist() OVER (ORDER BY obs), 8) AS cdf FROM ({PRED_OBS})")
def metric_ecdf(t: Tables) -> DataFrame:
    return rounded(metrics.empirical_cdf(t.pred_obs(), "obs"), ["cdf"], 8).select("o_orderkey", "cdf")


@query("SELECT quantile_cont(o_totalprice, 0.5) AS q50, round(quantile_cont(o_totalprice, 0.67), 4) AS q67 FROM orders")
def metric_quantiles(t: Tables) -> DataFrame:
    return rounded(metrics.quantiles(t.raw("orders"), "o_totalprice", [0.5, 0.67]), ["q67"])


@query("SELECT CASE WHEN x < 2 THEN 0 WHEN x >= 6 THEN 21 ELSE floor((x - 2) / 4 * 20) + 1 END::BIGINT AS bin, count(*) AS n FROM (SELECT log10(o_totalprice) AS x FROM orders) GROUP BY 1")
def metric_hist(t: Tables) -> DataFrame:
    return metrics.histogram(t.raw("orders"), "o_totalprice", 2.0, 6.0, 20, log=True)


@query("SELECT floor(log10(l_quantity) * 10)::BIGINT AS cx, floor(log10(l_extendedprice) * 10)::BIGINT AS cy, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) >= 5")
def density_2d(t: Tables) -> DataFrame:
    return metrics.density_2d(t.raw("lineitem"), "l_quantity", "l_extendedprice")


@query(f"""SELECT round(sum(sse) / sum(n) / 1e6, 2) AS mse, round(sum(sae) / sum(n), 2) AS mae, round(sum(sh) / sum(n), 2) AS huber, round(avg(nullif(sse / n / (dev + 0.1) ** 2, 0)), 4) AS nse_loss FROM (
  SELECT subbasin, count(*) AS n, sum((obs - pred) ** 2) AS sse, sum(abs(obs - pred)) AS sae, sum(CASE WHEN abs(obs - pred) <= 1 THEN 0.5 * (obs - pred) ** 2 ELSE abs(obs - pred) - 0.5 END) AS sh, stddev_pop(obs) AS dev
  FROM ({PRED_OBS}) GROUP BY 1)""")
def loss_table(t: Tables) -> DataFrame:
    return rounded(rounded(metrics.losses(t.pred_obs(), "obs", "pred", "subbasin").withColumn("mse", F.col("mse") / 1e6), ["mse", "mae", "huber"], 2), ["nse_loss"])


@query(f"""SELECT o.subbasin, round(n.m - o.m, 4) AS delta, c.n AS n FROM (SELECT subbasin, avg(obs) AS m FROM ({PRED_OBS}) GROUP BY 1) o JOIN (SELECT subbasin, avg(pred) AS m FROM ({PRED_OBS}) GROUP BY 1) n USING (subbasin)
  LEFT JOIN (SELECT subbasin, count(*) AS n FROM ({PRED_OBS}) GROUP BY 1) c USING (subbasin)""")
def delta_metric(t: Tables) -> DataFrame:
    m = t.pred_obs().groupBy("subbasin").agg(F.avg("obs").alias("a"), F.avg("pred").alias("b"), F.count("*").alias("n"))
    df = metrics.metric_change(m.select("subbasin", F.col("a").alias("m")), m.select("subbasin", F.col("b").alias("m")), "subbasin", "m", m.select("subbasin", "n"))
    return rounded(df, ["delta"]).select("subbasin", "delta", "n")


@query("SELECT feature, round(abs(avg(x)), 6) AS attribution FROM (SELECT 'l_tax' AS feature, l_tax AS x FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem UNION ALL SELECT 'l_quantity', l_quantity FROM lineitem) GROUP BY 1")
def mean_attribution(t: Tables) -> DataFrame:
    return rounded(metrics.attribution(t.raw("lineitem"), ["l_tax", "l_discount", "l_quantity"]), ["attribution"], 6)


@query(f"SELECT subbasin, count(*) AS n FROM ({OBS}) GROUP BY 1 ORDER BY n DESC, subbasin LIMIT 20")
def top_sites(t: Tables) -> DataFrame:
    return metrics.top_sites(t.obs().groupBy("subbasin").agg(F.count("*").alias("n")), "subbasin", "n", 20)


# --------------------------------------------------------------------------- lake

_RECORDS = "SELECT c_nationkey AS basin, o_custkey AS subbasin, 'src' || (o_orderkey % 3) AS source, o_orderdate AS processed_at, o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' AS has_data, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey"
_LATEST = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY basin, subbasin, source ORDER BY processed_at DESC, has_data DESC) AS n FROM ({_RECORDS})) WHERE n = 1"


def _records(t: Tables) -> DataFrame:
    o = t.raw("orders").join(t.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("c_nationkey").alias("basin"), F.col("o_custkey").alias("subbasin"), F.concat(F.lit("src"), (F.col("o_orderkey") % 3).cast("string")).alias("source"), F.col("o_orderdate").alias("processed_at"), F.col("o_orderpriority").rlike("^[12]").alias("has_data"))


@query(f"SELECT basin, subbasin, bool_or(has_data) FILTER (source = 'src0') AS src0, bool_or(has_data) FILTER (source = 'src1') AS src1, bool_or(has_data) FILTER (source = 'src2') AS src2 FROM ({_LATEST}) GROUP BY ALL")
def status_pivot(t: Tables) -> DataFrame:
    return lake.status_pivot(_records(t), ["src0", "src1", "src2"])


@query(f"SELECT basin, bool_and(has_data) AS all_data, count(DISTINCT CASE WHEN has_data THEN source END) AS sources, count(DISTINCT subbasin) AS subbasins FROM ({_LATEST}) GROUP BY 1")
def processed_basins(t: Tables) -> DataFrame:
    return lake.processed_basins(_records(t))


def _source(name: str) -> str:
    return f"SELECT subbasin, date, round(avg(value), 6) AS {name}__value FROM ({OBS}) WHERE source = '{name}' GROUP BY ALL"


_EVENTS = ("click", "error", "purchase", "signup", "view")


@query("SELECT * FROM " + " FULL JOIN ".join(f"({_source(s)})" + " USING (subbasin, date)" * (i > 0) for i, s in enumerate(_EVENTS)))
def source_align(t: Tables) -> DataFrame:
    one = lambda s: t.obs().where(F.col("source") == s).groupBy("subbasin", "date").agg(F.round(F.avg("value"), 6).alias("value"))
    return lake.aligned({s: one(s) for s in _EVENTS})


DENSE = f"""SELECT s.subbasin, c.date, d.value FROM (SELECT DISTINCT subbasin FROM ({OBS})) s CROSS JOIN (SELECT unnest(generate_series((SELECT min(date) FROM ({DAILY})), (SELECT max(date) FROM ({DAILY})), INTERVAL 1 DAY))::DATE AS date) c
  LEFT JOIN ({DAILY}) d ON d.subbasin = s.subbasin AND d.date = c.date"""


@query(DENSE)
def dense_export(t: Tables) -> DataFrame:
    d = t.daily()
    days = d.agg(F.explode(F.sequence(F.min("date"), F.max("date"))).alias("date"))
    return lake.dense(d, d, days)


_OLD = f"SELECT subbasin, date, round(avg(value), 6) AS value, count(*) AS extra FROM ({OBS}) WHERE source <> 'view' GROUP BY ALL"
_NEW = f"SELECT subbasin, date, CASE WHEN max(flags) >= 50 THEN round(avg(value), 6) END AS value, count(*) AS added FROM ({OBS}) WHERE source = 'view' GROUP BY ALL"


@query(f"SELECT subbasin, date, CASE WHEN n.added IS NOT NULL THEN n.value ELSE o.value END AS value, o.extra, n.added FROM ({_OLD}) o FULL JOIN ({_NEW}) n USING (subbasin, date)")
def upsert_result(t: Tables) -> DataFrame:
    value = F.round(F.avg("value"), 6)
    old = t.obs().where("source <> 'view'").groupBy("subbasin", "date").agg(value.alias("value"), F.count("*").alias("extra"))
    new = t.obs().where("source = 'view'").groupBy("subbasin", "date").agg(F.when(F.max("flags") >= 50, value).alias("value"), F.count("*").alias("added"))
    return lake.merged(old, new, ["subbasin", "date"])


@query(f"SELECT subbasin, date, CAST(date - lag(date) OVER (PARTITION BY subbasin ORDER BY date) AS INTEGER) AS step FROM ({DAILY}) QUALIFY step <> 1")
def daily_gaps(t: Tables) -> DataFrame:
    return lake.gaps(t.daily()).select("subbasin", "date", "step")


@query(f"SELECT count(DISTINCT basin) AS basins, count(DISTINCT subbasin) AS subbasins, min(date) AS first_day, max(date) AS last_day, round(avg((obs IS NULL)::INT), 6) AS missing_obs FROM ({PRED_OBS})")
def integrity_report(t: Tables) -> DataFrame:
    return rounded(lake.summary(t.pred_obs(), ["obs"]), ["missing_obs"], 6)


@query(f"SELECT DISTINCT subbasin FROM ({PRED_OBS}) WHERE subbasin NOT IN (SELECT s_suppkey FROM supplier)")
def not_in_static(t: Tables) -> DataFrame:
    return lake.not_in_static(t.pred_obs(), t.raw("supplier").select(F.col("s_suppkey").alias("subbasin")))


# --------------------------------------------------------------------------- graphs

_WALK = f"WITH RECURSIVE r AS (SELECT node AS start, node, 0 AS d FROM ({REACH}) UNION ALL SELECT r.start, e.dst, r.d + 1 FROM r JOIN ({EDGES}) e ON e.src = r.node)"


@query(f"{_WALK} SELECT start AS node, max_by(node, d) AS outlet, max(d)::BIGINT AS depth FROM r GROUP BY 1")
def outlets(t: Tables) -> DataFrame:
    return graph.outlets(t.reach(), t.edges()).select("node", "outlet", "depth")


@query(f"WITH RECURSIVE r AS (SELECT node AS start, node, 0.0::DOUBLE AS d, 0 AS k FROM ({REACH}) UNION ALL SELECT r.start, e.dst, r.d + (e.src % 7 + 1), r.k + 1 FROM r JOIN ({EDGES}) e ON e.src = r.node) SELECT start AS node, max(d) AS distance FROM r GROUP BY 1")
def downstream_distance(t: Tables) -> DataFrame:
    return graph.outlets(t.reach(), t.edges().withColumn("len", F.col("src") % 7 + 1), "len").select("node", "distance")


@query(f"WITH RECURSIVE r AS (SELECT node AS start, node, 0 AS d FROM ({REACH}) WHERE nextdown IS NULL UNION ALL SELECT r.start, e.src, r.d + 1 FROM r JOIN ({EDGES}) e ON e.dst = r.node) SELECT start, node, d::BIGINT AS depth FROM r")
def upstream_set(t: Tables) -> DataFrame:
    return graph.upstream(t.edges(), t.reach().where("nextdown IS NULL").select("node"))


@query(f"{_WALK} SELECT start AS node, max_by(node, d) AS component FROM r GROUP BY 1")
def components(t: Tables) -> DataFrame:
    return graph.components(t.reach(), t.edges())


@query(f"""SELECT node, coalesce(i.n, 0) AS n_in, coalesce(o.n, 0) AS n_out, coalesce(i.n, 0) = 0 AS source, coalesce(o.n, 0) = 0 AS sink FROM ({REACH})
  LEFT JOIN (SELECT dst AS node, count(*) AS n FROM ({EDGES}) GROUP BY 1) i USING (node) LEFT JOIN (SELECT src AS node, count(*) AS n FROM ({EDGES}) GROUP BY 1) o USING (node)""")
def degree_stats(t: Tables) -> DataFrame:
    return graph.degrees(t.reach(), t.edges())


_UP = f"SELECT DISTINCT start FROM ({_WALK} SELECT * FROM r) WHERE node IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 2000)"


_GAUGE = "SELECT s_suppkey AS node FROM supplier WHERE s_acctbal < 2000"


def _gauges(t: Tables) -> DataFrame:
    return t.raw("supplier").where("s_acctbal < 2000").select(F.col("s_suppkey").alias("node")).join(t.reach(), "node", "left_semi")


@query(f"""WITH RECURSIVE keep AS ({_UP}), e AS (SELECT src, dst FROM ({EDGES}) WHERE src IN (FROM keep) AND dst IN (FROM keep)),
  w AS (SELECT start, start AS node, 0 AS d FROM keep UNION ALL SELECT w.start, e.dst, w.d + 1 FROM w JOIN e ON e.src = w.node), o AS (SELECT start AS node, max_by(node, d) AS outlet FROM w GROUP BY 1),
  x AS (SELECT start AS node, max_by(node, d) AS original FROM ({_WALK} SELECT * FROM r) GROUP BY 1)
  SELECT node, outlet, count(*) OVER (PARTITION BY outlet) AS size, original FROM o JOIN x USING (node) QUALIFY size >= 3""")
def prune_to_gauges(t: Tables) -> DataFrame:
    return graph.pruned(t.reach(), t.edges(), _gauges(t), 3)


@query(f"""{_WALK} SELECT start AS node, min_by(node, d) FILTER (g) AS first, max_by(node, d) FILTER (g) AS last FROM (SELECT *, node IN ({_GAUGE}) AS g FROM r) GROUP BY 1""")
def gauges_below(t: Tables) -> DataFrame:
    return graph.gauges_below(t.reach(), t.edges(), _gauges(t))


_RING = "SELECT user_id AS src, max(CASE WHEN user_id % 7 < 3 THEN user_id - user_id % 7 + (user_id % 7 + 1) % 3 ELSE user_id - 1 END) AS dst FROM events GROUP BY 1"


@query(f"""WITH RECURSIVE e AS MATERIALIZED ({_RING}), w AS (SELECT src AS start, dst AS node, 1 AS d FROM e UNION ALL SELECT start, e.dst, d + 1 FROM w JOIN e ON e.src = w.node WHERE d < 8)
  SELECT DISTINCT start AS node FROM w WHERE node = start""")
def cycle_nodes(t: Tables) -> DataFrame:
    """Rings of three users, each with tails of four that lead into the ring."""
    u, r = F.col("user_id"), F.col("user_id") % 7
    e = t.raw("events").select(u.alias("src"), F.when(r < 3, u - r + (r + 1) % 3).otherwise(u - 1).alias("dst")).distinct()
    return graph.on_cycles(e.select(F.col("src").alias("node")), e)


@query(f"""WITH v AS (SELECT node, node::DOUBLE AS value FROM ({REACH})), a AS (SELECT v.node, coalesce(sum(u.value), 0) AS value FROM v LEFT JOIN ({EDGES}) e ON e.dst = v.node LEFT JOIN v u ON u.node = e.src GROUP BY 1),
  b AS (SELECT v.node, coalesce(sum(u.value), 0) AS value FROM v LEFT JOIN ({EDGES}) e ON e.dst = v.node LEFT JOIN a u ON u.node = e.src GROUP BY 1)
  SELECT v.node, round(v.value + 0.5 * a.value + 0.25 * b.value, 4) AS mix FROM v JOIN a USING (node) JOIN b USING (node)""")
def khop_upstream(t: Tables) -> DataFrame:
    return rounded(graph.khop_mix(t.reach().select("node", F.col("node").cast("double").alias("value")), t.edges(), [1.0, 0.5, 0.25]), ["mix"])


@query(f"""SELECT dst AS node, list_resize(l[1:2], 2, 0) AS inflow, [len(l) >= 1, len(l) >= 2] AS mask FROM (SELECT dst, list(place ORDER BY place) AS l FROM ({EDGES})
  JOIN (SELECT node, (row_number() OVER (PARTITION BY node % 5 ORDER BY node) - 1)::BIGINT AS place FROM ({REACH})) p ON p.node = src GROUP BY 1)""")
def inflow_slots(t: Tables) -> DataFrame:
    return graph.inflow_slots(t.edges(), graph.numbered(t.reach().withColumn("basin", F.col("node") % 5), "basin"))


# --------------------------------------------------------------------------- matching and space

_PAIRS = f"SELECT a.id, b.id AS rid, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM ({POINTS}) a JOIN ({POINTS}) b ON a.id <> b.id"


def _points(t: Tables) -> tuple[DataFrame, DataFrame]:
    p = t.points()
    return p, p.select(F.col("id").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"))


@query(f"SELECT id, rid, round(d, 4) AS distance FROM ({_PAIRS}) WHERE d <= 0.5")
def buffer_join(t: Tables) -> DataFrame:
    return rounded(matching.buffer_join(*_points(t), 0.5).where("id <> rid"), ["distance"]).select("id", "rid", "distance")


@query(f"SELECT id, rid, round(d, 4) AS distance FROM (SELECT *, rank() OVER (PARTITION BY id ORDER BY d) AS n FROM ({_PAIRS}) WHERE d <= 0.5) WHERE n = 1")
def nearest_join(t: Tables) -> DataFrame:
    a, b = _points(t)
    return rounded(matching.nearest_join(a, b, 0.5, others=True), ["distance"]).select("id", "rid", "distance")


@query("""WITH g AS (SELECT l_suppkey AS cell, date_trunc('month', l_shipdate)::DATE AS month, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL),
  w AS (SELECT l_suppkey AS cell, l_partkey % 10 AS zone, sum(l_quantity) AS w FROM lineitem GROUP BY ALL)
  SELECT zone, month, round(sum(w * v) / sum(w), 4) AS mean, round(greatest(sum(w * v * v) / sum(w) - (sum(w * v) / sum(w)) ** 2, 0) / 1e4, 2) AS var FROM g JOIN w USING (cell) GROUP BY ALL""")
def zonal_stats(t: Tables) -> DataFrame:
    li = t.raw("lineitem").withColumn("cell", F.col("l_suppkey"))
    grid = li.groupBy("cell", F.to_date(F.date_trunc("month", "l_shipdate")).alias("month")).agg(F.avg("l_extendedprice").alias("v"))
    weights = li.groupBy("cell", (F.col("l_partkey") % 10).alias("zone")).agg(F.sum("l_quantity").alias("w"))
    df = matching.zonal_stats(grid, weights, ["month"], "v")
    return rounded(rounded(df.withColumn("var", F.col("var") / 1e4), ["mean"]), ["var"], 2)


_CAND = "SELECT l_suppkey AS site, l_partkey AS reach, min(CASE WHEN l_linenumber < 6 THEN l_discount - 0.05 + l_tax / 100 END) AS diff, max(l_extendedprice) AS q FROM lineitem GROUP BY ALL"


@query(f"""SELECT site, reach FROM (SELECT *, row_number() OVER (PARTITION BY reach ORDER BY abs(diff) NULLS LAST, q DESC, site) AS m FROM (
  SELECT *, row_number() OVER (PARTITION BY site ORDER BY abs(diff) NULLS LAST, q DESC, reach) AS n FROM ({_CAND})) WHERE n = 1) WHERE m = 1""")
def best_match_two_pass(t: Tables) -> DataFrame:
    c = t.raw("lineitem").groupBy(F.col("l_suppkey").alias("site"), F.col("l_partkey").alias("reach")).agg(F.min(F.when(F.col("l_linenumber") < 6, F.col("l_discount") - 0.05 + F.col("l_tax") / 100)).alias("diff"), F.max("l_extendedprice").alias("q"))
    return matching.two_pass_match(c, "site", "reach", "diff", "q").select("site", "reach")


@query(f"SELECT a.id, b.id AS box FROM ({POINTS}) a JOIN ({POINTS}) b ON a.x BETWEEN b.x - 0.25 AND b.x + 0.25 AND a.y BETWEEN b.y - 0.25 AND b.y + 0.25")
def cells_in_boxes(t: Tables) -> DataFrame:
    p = t.points()
    boxes = p.select(F.col("id").alias("box"), (F.col("x") - 0.25).alias("x0"), (F.col("x") + 0.25).alias("x1"), (F.col("y") - 0.25).alias("y0"), (F.col("y") + 0.25).alias("y1"))
    return matching.cells_in_boxes(p.withColumnRenamed("id", "cell"), boxes, 0.25).select(F.col("cell").alias("id"), "box")


@query(f"SELECT r.node, r.nextdown, round(b.x - a.x, 4) AS dx, round(b.y - a.y, 4) AS dy FROM ({REACH}) r JOIN ({POINTS}) a ON a.id = r.node JOIN ({POINTS}) b ON b.id = r.nextdown")
def downstream_vectors(t: Tables) -> DataFrame:
    p = t.reach().join(t.points(), F.col("node") == F.col("id")).select("node", "nextdown", "x", "y")
    return rounded(matching.downstream_vectors(p), ["dx", "dy"])


@query(f"""WITH RECURSIVE p AS (SELECT *, floor((x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) * 65535)::BIGINT AS i, floor((y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()) * 65535)::BIGINT AS j FROM ({POINTS})),
  h AS (SELECT id, i, j, 0::BIGINT AS d, 32768::BIGINT AS s FROM p UNION ALL
    SELECT id, CASE WHEN j & s <> 0 THEN i WHEN i & s <> 0 THEN 65535 - j ELSE j END, CASE WHEN j & s <> 0 THEN j WHEN i & s <> 0 THEN 65535 - i ELSE i END,
      d + s * s * CASE WHEN i & s <> 0 AND j & s = 0 THEN 3 WHEN i & s <> 0 THEN 2 WHEN j & s <> 0 THEN 1 ELSE 0 END, s // 2 FROM h WHERE s > 0),
  b AS (SELECT p.id, x, y, (row_number() OVER (ORDER BY d, p.id) - 1) // 50 AS batch FROM p JOIN h ON h.id = p.id AND h.s = 0)
  SELECT id, batch, count(*) OVER (PARTITION BY batch) AS n, round(floor((min(x) OVER (PARTITION BY batch) - 0.1) / 0.1) * 0.1, 4) AS x0, round(ceil((max(y) OVER (PARTITION BY batch) + 0.1) / 0.1) * 0.1, 4) AS y1 FROM b""")
def spatial_batches(t: Tables) -> DataFrame:
    return rounded(matching.spatial_batches(t.points(), 50).select("id", "batch", "n", "x0", "y1"), ["x0", "y1"])


@query(f"""WITH r AS (SELECT id AS zone, [{{'x': x, 'y': y}}, {{'x': x + 9, 'y': y + 2}}, {{'x': x + 4, 'y': y + 3}}, {{'x': x + 7, 'y': y + 8}}, {{'x': x, 'y': y + 6}}] AS ring FROM ({POINTS})),
  c AS (SELECT id AS cell, floor(x) AS x0, floor(y) AS y0 FROM ({POINTS})),
  e AS (SELECT cell, zone, x0, y0, unnest(list_transform(range(5), lambda i: {{'ax': ring[i + 1].x, 'ay': ring[i + 1].y, 'bx': ring[(i + 1) % 5 + 1].x, 'by': ring[(i + 1) % 5 + 1].y}})) AS e FROM c JOIN r ON x0 < ring[1].x + 9 AND x0 + 1 > ring[1].x AND y0 < ring[1].y + 8 AND y0 + 1 > ring[1].y),
  s AS (SELECT cell, zone, y0, least(greatest(e.ax, x0), x0 + 1) AS a, least(greatest(e.bx, x0), x0 + 1) AS b, e.ay + (least(greatest(e.ax, x0), x0 + 1) - e.ax) * (e.by - e.ay) / nullif(e.bx - e.ax, 0) - y0 AS s, e.ay + (least(greatest(e.bx, x0), x0 + 1) - e.ax) * (e.by - e.ay) / nullif(e.bx - e.ax, 0) - y0 AS t FROM e),
  g AS (SELECT cell, zone, (b - a) * CASE WHEN s = t THEN least(greatest(s, 0), 1) ELSE (CASE WHEN t <= 0 THEN 0 WHEN t <= 1 THEN t * t / 2 ELSE t - 0.5 END - CASE WHEN s <= 0 THEN 0 WHEN s <= 1 THEN s * s / 2 ELSE s - 0.5 END) / (t - s) END AS part FROM s WHERE a <> b)
  SELECT cell, zone, round(abs(sum(part)), 5) AS w FROM g GROUP BY ALL HAVING abs(sum(part)) > 1e-6""")
def coverage(t: Tables) -> DataFrame:
    """Dented rings of five points, each moved to a point, over cells of 1 by 1; slanted edges by the antiderivative in SQL."""
    p, x, y = t.points(), F.col("x"), F.col("y")
    at = lambda i, j: F.struct((x + i).alias("x"), (y + j).alias("y"))
    rings = p.select(F.col("id").alias("zone"), F.array(at(0, 0), at(9, 2), at(4, 3), at(7, 8), at(0, 6)).alias("ring"))
    cells = p.select(F.col("id").alias("cell"), (F.floor("x") + 0.5).alias("x"), (F.floor("y") + 0.5).alias("y"))
    return rounded(matching.coverage_weights(cells, rings, 1.0).where("w > 1e-6"), ["w"], 5)


# --------------------------------------------------------------------------- samples, mixtures, hydraulics, scoring


_DAYS = f"SELECT subbasin % 5 AS basin, subbasin, date, CASE WHEN value > 10 THEN value END AS value FROM ({DAILY})"


@query(f"""SELECT (row_number() OVER (ORDER BY basin, date) - 1)::BIGINT AS sample_id, (dense_rank() OVER (ORDER BY basin) - 1)::BIGINT AS basin_idx, basin, date AS end_date FROM (
  SELECT basin, date FROM ({_DAYS}) GROUP BY ALL HAVING bool_or(value IS NOT NULL) AND date >= (SELECT min(date) FROM ({DAILY})) + 7)""")
def sample_index(t: Tables) -> DataFrame:
    d = t.daily().select((F.col("subbasin") % 5).alias("basin"), "subbasin", "date", F.when(F.col("value") > 10, F.col("value")).alias("value"))
    start = str(t.daily().agg(F.min("date")).first()[0])
    return samples.sample_index(d, ["value"], 7, start)


@query(f"SELECT subbasin, date, v AS value_seq FROM (SELECT subbasin, date, list(value) OVER w AS v, count(*) OVER w AS n FROM ({DENSE}) WINDOW w AS (PARTITION BY subbasin ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)) WHERE n = 7")
def sequences(t: Tables) -> DataFrame:
    return samples.sequences(dense_export(t), "subbasin", "date", ["value"], 7)


_DRAW = "('0x' || substr(md5('0/' || subbasin), 1, 8))::BIGINT"


@query(f"SELECT basin, subbasin, CASE WHEN n >= 5 AND row_number() OVER (PARTITION BY basin ORDER BY {_DRAW}, subbasin) > ceil(n * 0.7) THEN 'test' ELSE 'train' END AS role FROM (SELECT c_nationkey AS basin, c_custkey AS subbasin, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)")
def split_within_basin(t: Tables) -> DataFrame:
    return samples.split_within_basin(t.raw("customer").select(F.col("c_nationkey").alias("basin"), F.col("c_custkey").alias("subbasin")))


@query(f"SELECT subbasin, fold::INTEGER AS fold, CASE WHEN {_DRAW} % 4 = fold THEN 'test' ELSE 'train' END AS role FROM (SELECT c_custkey AS subbasin FROM customer), (SELECT unnest(range(4)) AS fold)")
def kfold(t: Tables) -> DataFrame:
    return samples.k_fold(t.raw("customer").select(F.col("c_custkey").alias("subbasin")))


@query()
def pack_batches(t: Tables) -> DataFrame:
    return samples.packed_batches(t.raw("lineitem").groupBy(F.col("l_orderkey").alias("sample_id")).agg(F.count("*").alias("nodes")), 33)


_LSE = "list_max({0}) + ln(list_sum(list_transform({0}, lambda v: exp(v - list_max({0})))))"


@query(f"""SELECT id, round(m - 1, 6) AS mean, round(sqrt(greatest(s - m * m, 1e-6)), 6) AS std FROM (SELECT id, list_sum(list_transform(range(8), lambda i: exp(0.5 * mu[i + 1] + 0.1 + 0.125 * sigma[i + 1] ** 2 + log_pi[i + 1] - z))) AS m,
  list_sum(list_transform(range(8), lambda i: exp(mu[i + 1] + 0.2 + 0.5 * sigma[i + 1] ** 2 + log_pi[i + 1] - z))) AS s FROM (SELECT *, {_LSE.format('log_pi')} AS z FROM ({MIXTURE})))""")
def mixture_moments(t: Tables) -> DataFrame:
    c = F.col
    return rounded(t.mixture().select("id", C.mixture_mean(c("mu"), c("sigma"), c("log_pi"), 0.5, 0.1).alias("mean"), C.mixture_std(c("mu"), c("sigma"), c("log_pi"), 0.5, 0.1).alias("std")), ["mean", "std"], 6)


@query(f"""SELECT id, round(z - ({_LSE.format('t')}), 6) AS nll FROM (SELECT id, {_LSE.format('log_pi')} AS z,
  list_transform(range(8), lambda i: log_pi[i + 1] - 0.5 * greatest(least((y - mu[i + 1]) / sigma[i + 1], 20), -20) ** 2 - ln(sigma[i + 1]) - 0.9189385332046727) AS t FROM ({MIXTURE}))""")
def mixture_nll(t: Tables) -> DataFrame:
    c = F.col
    return rounded(t.mixture().select("id", C.mixture_nll(c("y"), c("mu"), c("sigma"), c("log_pi")).alias("nll")), ["nll"], 6)


@query(f"SELECT key, q, round(CASE WHEN slope > 0 THEN pow(1000 + width * wse_u, 5 / 3.0) * pow(width, -2 / 3.0) * sqrt(slope) / 0.03 END, 4) AS discharge FROM ({SWOT})")
def manning_q(t: Tables) -> DataFrame:
    c = F.col
    return rounded(t.swot().select("key", "q", C.manning(F.lit(1000.0), c("width"), c("wse_u"), c("slope"), F.lit(0.03)).alias("discharge")), ["discharge"])


@query("SELECT l_orderkey, l_linenumber, round(3 + 2 * l_quantity - 10 * l_discount, 4) AS pred FROM lineitem")
def score_table(t: Tables) -> DataFrame:
    model = lambda x: 3 + 2 * x["l_quantity"] - 10 * x["l_discount"]
    df = t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return rounded(samples.scored(df, ["l_quantity", "l_discount"], model), ["pred"]).select("l_orderkey", "l_linenumber", "pred")


@query("SELECT vec_id AS id, round(6378137 * radians(lon), 2) AS x, round(6378137 * ln(tan(radians(lat) / 2 + pi() / 4)), 2) AS y FROM (SELECT vec_id, embedding[1]::DOUBLE * 100 AS lon, embedding[2]::DOUBLE * 60 AS lat FROM embeddings)")
def mercator(t: Tables) -> DataFrame:
    e = t.raw("embeddings")
    x, y = C.web_mercator(F.get("embedding", F.lit(0)).cast("double") * 100, F.get("embedding", F.lit(1)).cast("double") * 60)
    return rounded(e.select(F.col("vec_id").alias("id"), x.alias("x"), y.alias("y")), ["x", "y"], 2)


# --------------------------------------------------------------------------- flagship


@query(f"""WITH d AS ({DAILY}), m AS (SELECT *, value - median(value) OVER (PARTITION BY subbasin) AS dev FROM d), s AS (SELECT avg(dev) AS a, stddev_pop(dev) AS b FROM m)
  SELECT subbasin, count(*) AS n, round(max((dev - a) / b), 4) AS peak FROM m, s GROUP BY 1 ORDER BY peak DESC, subbasin LIMIT 20""")
def peak_deviations(t: Tables) -> DataFrame:
    """Daily values, deviation from the site's median, z-score by merged statistics, and the sites of the largest peaks."""
    d = windows.median_deviation(t.daily(), "subbasin", ["value"]).withColumn("basin", F.col("subbasin") % 5)
    s = F.broadcast(stats.scale(stats.merged_stats(stats.partial_stats(d, "basin", ["d_value"]))))
    z = d.join(s).withColumn("z", C.normalised(F.col("d_value"), F.col("offset"), F.col("scale"), F.col("log_norm")))
    return metrics.top_sites(rounded(z.groupBy("subbasin").agg(F.count("*").alias("n"), F.max("z").alias("peak")), ["peak"]), "subbasin", "peak", 20)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peak_deviations(Tables(spark, sf_dir))
