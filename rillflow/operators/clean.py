"""Cleaning and set operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.functions.columns import value_filter
from rillflow.operators.windows import first_per_key


def best_observation(df: DataFrame, site: str, ts: str, uncertainty: str, tie: str) -> DataFrame:
    """The observation of least uncertainty of each site and day; missing uncertainty last, ties by another column."""
    df = df.withColumn("date", F.to_date(ts))
    return first_per_key(df, [site, "date"], [F.col(uncertainty).asc_nulls_last(), F.col(tie), F.col(ts)])


def quality_gate(df: DataFrame, flags: str, uncertainty: str, flag_limit: int = 1 << 18, most: float = 0.20) -> DataFrame:
    return df.where((F.col(flags) < flag_limit) & (F.col(uncertainty) < most))


def value_filters(df: DataFrame, filters: list[dict], groups: dict[str, list[str]] | None = None) -> DataFrame:
    """Applies filters of a column, an operation and a value, each to a feature_list or to a feature_group of groups: exactly one of the two. Controls are read as they were before any filter."""
    controls = {f["column"]: F.col(f["column"]) for f in filters}
    held = df.withColumns({f"_control_{i}": c for i, c in enumerate(controls.values())})
    at = {name: F.col(f"_control_{i}") for i, name in enumerate(controls)}
    for f in filters:
        if ("feature_list" in f) == ("feature_group" in f):
            raise ValueError("a filter names a list of features or a group, and not both")
        names = f["feature_list"] if "feature_list" in f else (groups or {})[f["feature_group"]]
        held = held.withColumns({c: value_filter(F.col(c), at[f["column"]], f["operation"], f["value"]) for c in names})
    return held.drop(*[f"_control_{i}" for i in range(len(at))])


def missing_shares(df: DataFrame, columns: list[str], most: float = 0.99) -> DataFrame:
    """variable, missing (share of rows), has_gap (any missing) and mostly_missing (more than the limit) of each column, in one pass. Without rows the share is missing."""
    one = df.agg(F.count("*").alias("_n"), *[F.count(F.nanvl(F.col(c).cast("double"), F.lit(None))).alias(c) for c in columns])
    rows = one.unpivot("_n", columns, "variable", "_there")
    share = 1 - F.col("_there") / F.when(F.col("_n") > 0, F.col("_n"))
    return rows.select("variable", share.alias("missing"), (F.col("_there") < F.col("_n")).alias("has_gap"), F.coalesce(share > most, F.lit(False)).alias("mostly_missing"))


def enough_rows(df: DataFrame, site: str, width: str, slope: str, least: int = 10) -> DataFrame:
    """Physical rows (width and slope above 0) of sites that have enough of them."""
    df = df.where((F.col(width) > 0) & (F.col(slope) > 0))
    return df.join(df.groupBy(site).agg(F.count("*").alias("_c")).where(F.col("_c") >= least).select(site), site, "left_semi")


def time_slice(df: DataFrame, date: str, ranges: list[tuple[str, str]]) -> DataFrame:
    """Rows from the least start to the largest end, both included."""
    return df.where(F.col(date).between(F.lit(min(a for a, _ in ranges)).cast("date"), F.lit(max(z for _, z in ranges)).cast("date")))


def configured(df: DataFrame, columns: list[str]) -> DataFrame:
    """The configured columns; those that are absent are missing throughout."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in columns])


def blank_outside(df: DataFrame, sites: DataFrame, site: str, targets: list[str]) -> DataFrame:
    """Targets are missing at sites outside the list; inputs stay."""
    marked = sites.select(site).distinct().withColumn("_in", F.lit(True))
    df = df.join(marked, site, "left")
    return df.withColumns({c: F.when(F.col("_in"), F.col(c)) for c in targets}).drop("_in")


def with_suffix(df: DataFrame, columns: list[str], suffix: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{c}{suffix}" for c in columns})


def gauge_screen(df: DataFrame, mean: str, most: str, name: str, banned: tuple[str, ...] = ("slough", "canal"), bad: DataFrame | None = None, key: str = "site") -> DataFrame:
    """Gauges with a mean above 1 or a peak above 10, without those whose name has a banned word, in any case, and those of the list of bad ones."""
    df = df if bad is None else df.join(bad.select(key).distinct(), key, "left_anti")
    keep = (F.col(mean) > 1) | (F.col(most) > 10)
    for word in banned:
        keep = keep & ~F.coalesce(F.col(name), F.lit("")).ilike(f"%{word}%")
    return df.where(keep)


def numeric_only(df: DataFrame, columns: list[str], kind: str = "bigint") -> DataFrame:
    """Columns as numbers; rows where one is not a number go."""
    return df.withColumns({c: F.col(c).try_cast(kind) for c in columns}).dropna("any", subset=columns)


def missing_from(sites: DataFrame, graph: DataFrame, key: str) -> DataFrame:
    return sites.select(key).distinct().join(graph.select(key), key, "left_anti")


def require_none(df: DataFrame, message: str) -> None:
    if rows := df.take(5):
        raise ValueError(f"{message}: {[tuple(r) for r in rows]}")


def unioned(parts: dict[str, DataFrame], name: str = "part") -> DataFrame:
    """Parts of several regions under each other, with the region that a row is from; columns that a part lacks are missing in its rows."""
    if not parts:
        raise ValueError("no parts")
    marked = [df.withColumn(name, F.lit(region)) for region, df in parts.items()]
    out = marked[0]
    for df in marked[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def group_summary(df: DataFrame, keys: list[str], value: str, condition: Column) -> DataFrame:
    """n rows of each group, n_valid with a value, their share and mean, and whether any and all rows meet the condition; rows for which it is missing do not."""
    met, there = F.coalesce(condition, F.lit(False)), F.count(value)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), there.alias("n_valid"), (there / F.count("*")).alias("observed"), F.avg(value).alias("mean"), F.bool_or(met).alias("any"), F.bool_and(met).alias("all"))
