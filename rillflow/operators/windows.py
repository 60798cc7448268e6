"""Window operators on site series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.operators.graph import cut


def median_deviation(df: DataFrame, site: str, columns: list[str]) -> DataFrame:
    """d_<column>: deviation from the site's median."""
    w = Window.partitionBy(site)
    return df.withColumns({f"d_{c}": F.col(c) - F.median(c).over(w) for c in columns})


def trapezoid_change(df: DataFrame, site: str, stage: str, width: str, name: str = "d_area") -> DataFrame:
    """Area change: stage deviation times the mean of width and its median."""
    w = Window.partitionBy(site)
    return df.withColumn(name, (F.col(stage) - F.median(stage).over(w)) * (F.col(width) + F.median(width).over(w)) / 2)


def volume_change(df: DataFrame, site: str, stage: str, area: str) -> DataFrame:
    """d_wse, d_area and d_volume of lakes: deviations from the site's medians, and the stage's times the mean of area and its median."""
    w = Window.partitionBy(site)
    stage_off, middle = F.col(stage) - F.median(stage).over(w), F.median(area).over(w)
    return df.withColumns({"d_wse": stage_off, "d_area": F.col(area) - middle, "d_volume": stage_off * 0.5 * (F.col(area) + middle)})


def relative_change(df: DataFrame, group: str, value: str, name: str = "rel") -> DataFrame:
    m = F.median(value).over(Window.partitionBy(group))
    return df.withColumn(name, F.when((F.col(value) > 0) & (m > 0), F.log10(F.col(value) / m)))


def rolling_means(df: DataFrame, site: str, date: str, value: str, days: list[int]) -> DataFrame:
    """Means over the given numbers of days that end at each row's day."""
    w = Window.partitionBy(site).orderBy(F.unix_date(date))
    return df.withColumns({f"{value}_{d}d": F.avg(value).over(w.rangeBetween(-(d - 1), 0)) for d in days})


def observation_memory(df: DataFrame, site: str, date: str, features: list[str]) -> DataFrame:
    """Last valid row of the site up to each day, steps since it, and whether there was one. A row is valid if no feature is missing."""
    valid = F.lit(True)
    for c in features:
        valid = valid & F.col(c).isNotNull()
    w = Window.partitionBy(site).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(valid, F.struct(F.col(date).alias("_d"), *features)), ignorenulls=True).over(w)
    df = df.withColumn("_last", last)
    return df.withColumns({**{f"last_{c}": F.col(f"_last.{c}") for c in features}, "staleness": F.date_diff(F.col(date), F.col("_last._d")), "seen": F.col("_last").isNotNull()}).drop("_last")


def staleness_gates(s: Column, limit: int) -> dict[str, Column]:
    return {"fresh": s == 0, "within": s <= limit, "decay": F.exp(-0.5 * s), "log_age": F.log1p(s)}


def segment_softmax(df: DataFrame, segment: str, score: str, name: str = "weight") -> DataFrame:
    """Stable softmax within a segment; missing scores get 0, also where all are missing."""
    w = Window.partitionBy(segment)
    e = F.exp(F.col(score) - F.max(score).over(w))
    return df.withColumn(name, F.coalesce(e / F.sum(e).over(w), F.lit(0.0)))


def robust_mask(df: DataFrame, group: str, value: str, limit: float, name: str = "ok") -> DataFrame:
    """Whether the modified z of log1p(x + |min|) is below the limit; one-sided. Where the median deviation is 0 all are rejected."""
    w = Window.partitionBy(group)
    df = df.withColumn("_x", F.log1p(F.col(value) + F.abs(F.min(value).over(w))))
    df = df.withColumn("_d", F.col("_x") - F.median("_x").over(w))
    df = df.withColumn("_m", F.median(F.abs("_d")).over(w))
    z = 0.6745 * F.col("_d") / F.when(F.col("_m") != 0, F.col("_m"))
    return df.withColumn(name, F.coalesce(z < limit, F.lit(False))).drop("_x", "_d", "_m")


def position_weights(df: DataFrame, sequence: str, order: str, name: str = "weight") -> DataFrame:
    """Spin-up weights sigmoid(linspace(-10, 10, L)) along each sequence."""
    w = Window.partitionBy(sequence)
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy(order)) - 1
    return df.withColumn(name, 1 / (1 + F.exp(-F.when(n > 1, -10 + 20 * i / F.when(n > 1, n - 1)).otherwise(-10.0))))


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a stated order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def ranked_values(df: DataFrame, key: Column) -> DataFrame:
    """_k, each distinct value of the key, with _before, the rows that sort before it, and _n, its rows.

    Counts of distinct values are dealt by range, summed within a partition and moved by the partitions' totals, of which there is one a partition; no task holds the whole order.
    """
    counts = df.groupBy(key.alias("_k")).agg(F.count("*").alias("_n"))
    parts = cut(counts.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_k").withColumn("_p", F.spark_partition_id()))
    totals = parts.groupBy("_p").agg(F.sum("_n").alias("_s"))
    moved = totals.select("_p", (F.sum("_s").over(Window.orderBy("_p")) - F.col("_s")).alias("_o"))
    earlier = F.sum("_n").over(Window.partitionBy("_p").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1))
    out = parts.withColumn("_b", F.coalesce(earlier, F.lit(0))).join(F.broadcast(moved), "_p")
    return out.select("_k", (F.col("_b") + F.col("_o")).alias("_before"), "_n")


def rows_before(df: DataFrame, by: list[Column], name: str) -> DataFrame:
    """df with name, the number of rows that sort before a row, and name_ties, of those that sort as it does."""
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(by)])
    ranked = ranked_values(df, key).select("_k", F.col("_before").alias(name), F.col("_n").alias(f"{name}_ties"))
    return df.withColumn("_k", key).join(ranked, "_k").drop("_k")


def exact_quantiles(df: DataFrame, wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """One row with a column for each name: the exact quantile of a value over all rows where it is there, interpolated between two ranks; missing without rows.

    All values are ranked at once, by name and value, so that there is one shuffle by value and one by range; then the two rows at a quantile's place are picked.
    """
    values = F.array(*[F.struct(F.lit(n).alias("name"), v.cast("double").alias("v")) for n, (v, _) in wanted.items()])
    rows = df.select(F.explode(values).alias("x")).select("x.name", "x.v").where(F.col("v").isNotNull() & ~F.isnan("v"))
    ranked = ranked_values(rows, F.struct("name", "v")).select("_k.name", "_k.v", "_before", "_n")
    per = ranked.groupBy("name").agg(F.min("_before").alias("first"), F.sum("_n").alias("all"))  # a row a name
    at = F.element_at(F.create_map(*[x for n, (_, q) in wanted.items() for x in (F.lit(n), F.lit(float(q)))]), F.col("name"))
    placed = ranked.join(F.broadcast(per.withColumn("h", at * (F.col("all") - 1))), "name").withColumn("i", F.col("_before") - F.col("first"))
    holds = lambda h: F.max(F.when((F.col("i") <= h) & (h < F.col("i") + F.col("_n")), F.col("v")))
    picked = placed.groupBy("name").agg(holds(F.floor("h")).alias("lo"), holds(F.ceil("h")).alias("hi"), F.first(F.col("h") - F.floor("h")).alias("w"))
    found = picked.select("name", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("w")).alias("v"))
    return found.agg(*[F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in wanted])


def every_fifth(df: DataFrame, size: str, key: str) -> DataFrame:
    """split: each fifth row by falling size is test."""
    n = F.col("_before") + F.row_number().over(Window.partitionBy(size, key).orderBy(key)) - 1
    return rows_before(df, [-F.col(size), F.col(key)], "_before").withColumn("split", F.when(n % 5 == 4, "test").otherwise("train")).drop("_before", "_before_ties")


def pooled_sources(df: DataFrame, sources: list[str], name: str = "pooled") -> DataFrame:
    """Mean of the valid sources of a row: sum over max(count, 1)."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in sources), F.lit(0.0))
    count = sum((F.col(c).isNotNull().cast("int") for c in sources), F.lit(0))
    return df.withColumn(name, total / F.greatest(count, F.lit(1)))


def running_offset(df: DataFrame, batch: str, order: str, size: str, name: str = "offset") -> DataFrame:
    """Nodes before each graph of its batch."""
    w = Window.partitionBy(batch).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(size).over(w), F.lit(0)))


def chunked(df: DataFrame, group: str, order: str, size: int, name: str = "chunk") -> DataFrame:
    """Batches of size rows inside each group."""
    return df.withColumn(name, F.ceil(F.row_number().over(Window.partitionBy(group).orderBy(order)) / size).cast("long"))


def numbered_chunks(df: DataFrame, group: str, order: str, size: int, name: str = "chunk") -> DataFrame:
    """Batches of size rows inside each group, numbered from 0 over all groups: largest groups first, ties by group. Batches are ranked, not rows, and no task holds all of them."""
    rows = chunked(df, group, order, size, "_c").withColumn("_n", F.count("*").over(Window.partitionBy(group)))
    heads = rows.select(group, "_n", "_c").distinct()
    placed = rows_before(heads, [-F.col("_n"), F.col(group), F.col("_c")], name).select(group, "_c", name)
    return rows.join(placed, [group, "_c"]).drop("_c", "_n")
