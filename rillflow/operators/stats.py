"""Mergeable statistics, scales and encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.operators.windows import rows_before

PARTIAL = ("count", "sum", "sum_sq", "min", "max", "log_sum", "log_sum_sq", "positive_count")


def unpivoted(df: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    return df.select(*keys, *[F.col(v).cast("double").alias(v) for v in variables]).unpivot(keys, variables, "var", "x")


def partial_stats(df: DataFrame, basin: str, variables: list[str], known: DataFrame | None = None) -> DataFrame:
    """Sufficient statistics of each basin and variable; those in known are left out. Log terms are over values of at least 0."""
    x = unpivoted(df, [basin], variables).where(F.col("x").isNotNull() & ~F.isnan("x"))
    if known is not None:
        x = x.join(known.select(basin, "var"), [basin, "var"], "left_anti")
    log = F.when(F.col("x") >= 0, F.log1p("x"))
    return x.groupBy(basin, "var").agg(
        F.count("x").alias("count"), F.sum("x").alias("sum"), F.sum(F.col("x") * F.col("x")).alias("sum_sq"), F.min("x").alias("min"), F.max("x").alias("max"),
        F.sum(log).alias("log_sum"), F.sum(log * log).alias("log_sum_sq"), F.count(log).alias("positive_count"),
    )


def merged_stats(parts: DataFrame, basins: DataFrame | None = None, basin: str = "basin") -> DataFrame:
    """Partial statistics of several basins as one row a variable. With basins, those alone, and one of them without statistics is an error."""
    if basins is not None:
        wanted = basins.select(basin).distinct()
        if lost := wanted.join(parts.select(basin).distinct(), basin, "left_anti").orderBy(basin).take(5):
            raise ValueError(f"basins without statistics: {[r[0] for r in lost]}")
        parts = parts.join(wanted, basin, "left_semi")
    kind = {"min": F.min, "max": F.max}
    return parts.groupBy("var").agg(*[kind.get(c, F.sum)(c).alias(c) for c in PARTIAL])


def scale(stats: DataFrame, log: list[str] = (), plain: list[str] = (), ranged: list[str] = ()) -> DataFrame:
    """offset and scale of each variable: by log, none, range or z, in this order of precedence; population variance. A tiny deviation counts as 1, of logs as 1e-6."""
    v = F.col("var")
    mean, log_mean = F.col("sum") / F.col("count"), F.col("log_sum") / F.col("positive_count")
    dev = lambda sq, n, m: F.sqrt(F.greatest(sq / n - m * m, F.lit(0.0)))
    whole = lambda s: F.when(s < 1e-9, 1.0).otherwise(s)
    is_log, is_plain, is_range = (v.isin(list(x)) if x else F.lit(False) for x in (log, plain, ranged))
    offset = F.when(is_log, log_mean).when(is_plain, 0.0).when(is_range, F.col("min")).otherwise(mean)
    size = (
        F.when(is_log, F.greatest(dev(F.col("log_sum_sq"), F.col("positive_count"), log_mean), F.lit(1e-6)))
        .when(is_plain, 1.0)
        .when(is_range, whole(F.col("max") - F.col("min")))
        .otherwise(whole(dev(F.col("sum_sq"), F.col("count"), mean)))
    )
    return stats.select("var", is_log.alias("log_norm"), offset.alias("offset"), size.alias("scale"))


def static_scale(df: DataFrame, variables: list[str], log: list[str] = (), ranged: list[str] = ()) -> DataFrame:
    """Scale of static attributes from the rows: sample deviation; log variables only have an offset, ranged ones least value and range."""
    x = unpivoted(df, [], variables).where(F.col("x").isNotNull())
    s = x.groupBy("var").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"), F.avg(F.when(F.col("x") >= 0, F.log1p("x"))).alias("l"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    is_log = F.col("var").isin(list(log)) if log else F.lit(False)
    is_range = F.col("var").isin(list(ranged)) if ranged else F.lit(False)
    span = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    size = F.when(~is_log & is_range, span).when(is_log | F.col("s").isNull() | (F.col("s") < 1e-9), 1.0).otherwise(F.col("s"))
    return s.select("var", is_log.alias("log_norm"), F.when(is_log, F.col("l")).when(is_range, F.col("lo")).otherwise(F.col("m")).alias("offset"), size.alias("scale"))


def categories(df: DataFrame, column: str) -> DataFrame:
    """Distinct values in ascending order with their places; repeats go before anything is ordered, and no task holds all values."""
    ranked = rows_before(df.where(F.col(column).isNotNull()).select(column).distinct(), [F.col(column)], "_b")
    return ranked.select(F.col("_b").cast("int").alias("place"), F.col(column).alias("category"))


def active_bits(df: DataFrame, column: str, bits: int = 31) -> DataFrame:
    """Bits that are set in any row."""
    all_ = df.agg(F.bit_or(F.col(column).cast("long")).alias("b"))
    return all_.select(F.explode(F.filter(F.sequence(F.lit(0), F.lit(bits)), lambda i: F.expr("b").bitwiseAND(F.pow(F.lit(2), i).cast("long")) > 0)).alias("bit"))
