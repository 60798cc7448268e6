"""Joins and picks that bring sources to sites: id chains, station matches, series by translated id, outlets, regions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def translated(df: DataFrame, chain: list[tuple[DataFrame, str, str]], keep_unmatched: bool = False) -> DataFrame:
    """df with the ids that a chain of maps (map, from, to) leads to; an id may have several, rows without any go unless kept."""
    for ids, start, end in chain:
        df = df.join(ids.select(start, end).distinct(), start, "left")
    last = [end for _, _, end in chain][-1:]
    return df if keep_unmatched else df.dropna("any", subset=last)


def inner_by_shard(left: DataFrame, right: DataFrame, shard: str, key: str) -> DataFrame:
    """Rows of both that share key and shard: the shard is one more key of a single join."""
    return left.join(right, [shard, key], "inner")


def total_from_specific(df: DataFrame, area: DataFrame, site: str, columns: dict[str, str]) -> DataFrame:
    """Specific values (new name -> column) times the area of their site; sites without an area get none."""
    d = df.join(area.select(site, F.col("area").alias("_area")), site, "left")
    return d.withColumns({n: F.col(c) * F.col("_area") for n, c in columns.items()}).drop("_area")


def cell_key(degrees: Column, per_degree: int = 1000) -> Column:
    """A coordinate as a whole number, so that grids join by equality."""
    return F.round(degrees * per_degree).cast("long")


def merged_grids(left: DataFrame, right: DataFrame, keys: list[str], drop: list[str] = ()) -> DataFrame:
    """Two families of grids side by side at the cells and times both have, without bookkeeping columns."""
    return left.drop(*drop).join(right.drop(*drop), keys, "inner")


def series_by_id(ids: DataFrame, series: DataFrame, key: str, site: str) -> DataFrame:
    """The series of each site by its translated ids; a site may have several, and a series several sites."""
    return ids.select(site, key).dropna("any").distinct().join(series, key)


def daily_median(df: DataFrame, site: str, date: str, values: list[str]) -> DataFrame:
    return df.groupBy(site, date).agg(*[F.median(v).alias(v) for v in values])


def with_stations(matches: DataFrame, stations: DataFrame, attributes: DataFrame, station: str, site: str) -> DataFrame:
    """All matches of sites that have attributes, with their station where there is one."""
    return matches.join(stations, station, "left").join(attributes, site, "inner")


def best_pairs(df: DataFrame, lakes: DataFrame, rings: DataFrame, limit: float = 0.3) -> DataFrame:
    """One row a site of matches (site, reach, kind, reach_area, area).

    reach: that of the least relative difference of areas, below the limit, of sites with a river (kind 1); lake_reaches: reaches of kind 3; lakes: lake ids
    of those by lakes (reach, lake); units: the other ids of all reaches by rings (reach, ids), without zeros. Ties go to the smaller reach.
    """
    diff = F.abs((F.col("reach_area") - F.col("area")) / F.when(F.col("reach_area") + F.col("area") != 0, (F.col("reach_area") + F.col("area")) / 2))
    d = df.withColumn("_diff", diff)
    near = F.min(F.when(F.col("_diff") < limit, F.struct("_diff", "reach")))
    base = d.groupBy("site").agg(
        F.when(F.bool_or(F.col("kind") == 1), near)["reach"].alias("reach"), F.sort_array(F.collect_set(F.when(F.col("kind") == 3, F.col("reach")))).alias("lake_reaches")
    )
    pld = d.where("kind = 3").select("site", "reach").join(lakes, "reach").groupBy("site").agg(F.sort_array(F.collect_set("lake")).alias("lakes"))
    ids = d.select("site", "reach").dropna().distinct().join(rings, "reach").select("site", F.explode(F.array_remove("ids", F.lit(0).cast("long"))).alias("id")).groupBy("site").agg(F.sort_array(F.collect_list("id")).alias("units"))
    none = F.array().cast("array<bigint>")
    return base.join(pld, "site", "left").join(ids, "site", "left").withColumns({c: F.coalesce(c, none) for c in ("lakes", "units")})


def site_means(df: DataFrame, site: str, values: list[str]) -> DataFrame:
    return df.groupBy(site).agg(*[F.avg(v).alias(v) for v in values])


def bounds(df: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """The bounding box of each key's points; of all points without keys."""
    return df.groupBy(*keys).agg(F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"))


def in_region(df: DataFrame, x0: float, y0: float, x1: float, y1: float, x: str = "x", y: str = "y") -> DataFrame:
    return df.where(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))


def error_table(static: DataFrame, gauges: DataFrame, scores: DataFrame, site: str, static_q: str, gauge_q: str, metric: str, limit: float = 10.0) -> DataFrame:
    """error: the gauge's less the static value over their mean, beside a metric held within its limits; sites that all three have."""
    j = static.select(site, F.col(static_q).alias("_s")).join(gauges.select(site, F.col(gauge_q).alias("_g")), site).join(scores.select(site, metric), site)
    error = (F.col("_g") - F.col("_s")) / F.when(F.col("_g") + F.col("_s") != 0, (F.col("_g") + F.col("_s")) / 2)
    held = F.when(F.col(metric).isNotNull(), F.greatest(F.least(F.col(metric), F.lit(limit)), F.lit(-limit)))
    return j.select(site, error.alias("error"), held.alias(metric))


def longest_series(df: DataFrame, site: str, source: str) -> DataFrame:
    """Rows of the source with most rows at each site; ties go to the first source by name."""
    n = df.groupBy(site, source).agg(F.count("*").alias("_c"))
    best = n.groupBy(site).agg(F.max_by(source, F.struct("_c")).alias("_any"), F.max("_c").alias("_m"))
    first = n.join(best, site).where("_c = _m").groupBy(site).agg(F.min(source).alias(source))
    return df.join(first, [site, source], "left_semi")


def first_then_rest(df: DataFrame, key: str, first: str) -> DataFrame:
    """Rows in order of their key, those of one named key before all others."""
    return df.orderBy(F.when(F.col(key) == first, 0).otherwise(1), key)


def one_series(df: DataFrame, site: str, name, date: str, start: str, end: str, scores: DataFrame | None = None, metric: str | None = None) -> DataFrame:
    """The series of one site within two days, both included, in order; with scores (a row a site) also its metric, missing if the site has none."""
    if scores is not None:
        one = scores.where(F.col(site) == name).agg(F.max(metric).alias(metric))  # a row
        df = df.crossJoin(F.broadcast(one))
    return df.where((F.col(site) == name) & F.col(date).between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).orderBy(date)


def outlet_by_area(df: DataFrame, basin: str, site: str, area: str) -> DataFrame:
    """df with its basin's site of the largest area as outlet; ties go to the smaller id."""
    ranked = df.where(F.col(area).isNotNull()).groupBy(basin).agg(F.min(F.struct((-F.col(area)).alias("a"), F.col(site).alias("s")))["s"].alias("outlet"))
    return df.join(ranked, basin, "left")


def all_sites(train: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    return train.select(*keys).unionByName(test.select(*keys)).distinct()


def common(wanted: DataFrame, there: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.select(*keys).intersect(there.select(*keys))


def gap_share(df: DataFrame, site: str, date: str, valid: Column) -> DataFrame:
    """gap: steps skipped since the last valid one (a valid step after k skipped ones has k), share: 1 / (1 + gap); before any valid step all count."""
    d = df.withColumns({"_ok": F.coalesce(valid, F.lit(False)), "_i": F.row_number().over(Window.partitionBy(site).orderBy(date))})
    last = F.max(F.when(F.col("_ok"), F.col("_i"))).over(Window.partitionBy(site).orderBy(date).rowsBetween(Window.unboundedPreceding, -1))
    gap = (F.col("_i") - 1 - F.coalesce(last, F.lit(0))).cast("long")
    return d.withColumns({"gap": gap, "share": 1 / (1 + gap)}).drop("_ok", "_i")


def filled(df: DataFrame, columns: list[str], value: float = 0.0) -> DataFrame:
    """Missing climate values as a value."""
    return df.fillna(value, subset=columns)


def split_sources(columns: dict[str, list[str]], time_gaps: dict[str, bool]) -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    """Columns of dense sources and of those with gaps; the flags must be true or false and cover just the sources."""
    if wrong := set(columns) ^ set(time_gaps):
        raise ValueError(f"sources without a flag, or flags without a source: {sorted(wrong)}")
    if odd := sorted(k for k, v in time_gaps.items() if not isinstance(v, bool)):
        raise TypeError(f"flags must be true or false: {odd}")
    return {s: c for s, c in columns.items() if not time_gaps[s]}, {s: c for s, c in columns.items() if time_gaps[s]}


def listed(df: DataFrame, column: str, name: str, mark: str = ";") -> DataFrame:
    """One row for each part of a marked list, parts trimmed and empty ones left out."""
    return df.withColumn(name, F.explode(F.split(column, mark))).withColumn(name, F.trim(name)).where(F.col(name) != "")


def number_in(text: Column) -> Column:
    """The first whole number in a text, or missing."""
    return F.regexp_extract(text, r"(\d+)", 1).try_cast("long")


def name_of_parts(stem: Column, mark: str, first: int, count: int) -> Column:
    return F.array_join(F.slice(F.split(stem, mark), first, count), mark)


def by_group(df: DataFrame, keys: list[str], fn: Callable, schema: str) -> DataFrame:
    """fn from and to pandas frames for each key, for what has no expression; a group must fit in a task's memory."""
    return df.groupBy(*keys).applyInPandas(fn, schema)
