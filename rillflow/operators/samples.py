"""Training tables: eligible samples, sequences, splits, packing and scoring."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.functions import columns as C
from rillflow.operators.windows import robust_mask


def sample_index(df: DataFrame, targets: list[str], length: int, start: str, predict: bool = False) -> DataFrame:
    """sample_id, basin_idx, basin and end date: days from start + length on at which any target of any subbasin is there, or all such days to predict; numbered by basin, then day."""
    any_ = F.lit(predict)
    for t in targets:
        any_ = any_ | F.col(t).isNotNull()
    ok = df.groupBy("basin", "date").agg(F.bool_or(any_).alias("ok")).where(F.col("ok") & (F.col("date") >= F.date_add(F.to_date(F.lit(start)), length)))
    # numbers without a window over all rows: basins are few, days are numbered within them
    per = ok.groupBy("basin").agg(F.count("*").alias("n"))
    w = Window.orderBy("basin")
    per = per.select("basin", (F.row_number().over(w) - 1).cast("long").alias("basin_idx"), F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    day = F.row_number().over(Window.partitionBy("basin").orderBy("date")) - 1
    return ok.join(per, "basin").select((F.col("_before") + day).cast("long").alias("sample_id"), "basin_idx", "basin", F.col("date").alias("end_date"))


def halo_blocks(dense: DataFrame, keys: list[str], date: str, values: list[str], length: int, days: int | None = None) -> DataFrame:
    """keys, block, d and values: a dense series as arrays of consecutive days, with d, the days since 1970 of each entry.

    A block has so many days (twice the length by default) and, before them, the length - 1 days of the block before, so that each run of length days lies whole in the block of its last
    day. A value is stored 1 + (length - 1) / days times, not length times; it is shuffled by the first key and the block, so blocks of one first key and block stay together.
    """
    days = days or max(2 * length, 16)
    d = F.unix_date(F.col(date))
    own = F.floor(d / days).cast("int")
    last = F.floor((d + length - 1) / days).cast("int")  # of days shorter than the halo, some blocks behind
    rows = dense.select(*keys, d.alias("_d"), *values, F.explode(F.sequence(own, last)).alias("block"))
    rows = rows.repartition(keys[0], "block")
    series = rows.groupBy(*keys, "block").agg(F.sort_array(F.collect_list(F.struct("_d", *values))).alias("_r"))
    return series.select(*keys, "block", F.col("_r._d").alias("d"), *[F.col(f"_r.{v}").alias(v) for v in values])


def sequences(dense: DataFrame, site: str, date: str, values: list[str], length: int) -> DataFrame:
    """For each day of a dense series with length - 1 days behind it, the arrays of the last length values: slices of halo blocks, made behind the only shuffle."""
    b = halo_blocks(dense, [site], date, values, length).where(F.size("d") >= length)
    at = b.withColumn("_i", F.explode(F.sequence(F.lit(length), F.size("d"))))
    return at.select(site, F.date_from_unix_date(F.get("d", F.col("_i") - 1)).alias(date), *[F.slice(v, F.col("_i") - length + 1, length).alias(f"{v}_seq") for v in values])


def hashed_order(*columns: Column, seed: int = 0) -> Column:
    """A repeatable draw of 32 bits: the same in any engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), *[c.cast("string") for c in columns]).cast("binary")), 1, 8), 16, 10).cast("long")


def split_within_basin(sites: DataFrame, share: float = 0.7, least: int = 5, seed: int = 0) -> DataFrame:
    """role: in basins of enough sites a share by hash order is train and the rest test; others are all train."""
    w = Window.partitionBy("basin")
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy(hashed_order(F.col("subbasin"), seed=seed), "subbasin"))
    return sites.withColumn("role", F.when((n >= least) & (i > F.ceil(n * share)), "test").otherwise("train"))


def random_split(sites: DataFrame, share: float, seed: int = 0) -> DataFrame:
    return sites.withColumn("role", F.when(hashed_order(F.col("subbasin"), seed=seed) < int(share * 2**32), "train").otherwise("test"))


def split_by_match(sites: DataFrame, matches: DataFrame, key: str = "subbasin") -> DataFrame:
    """role: sites that have a match are test, the others train."""
    return sites.join(matches.select(key).distinct().withColumn("_m", F.lit(True)), key, "left").withColumn("role", F.when(F.col("_m"), "test").otherwise("train")).drop("_m")


def split_by_dates(df: DataFrame, date: str, ranges: dict[str, tuple[str, str]]) -> DataFrame:
    """One row a row and role whose range of days, both ends included, holds its day; ranges may overlap, and rows in none go."""
    holds = [F.when(F.col(date).between(F.lit(a).cast("date"), F.lit(z).cast("date")), F.lit(role)) for role, (a, z) in ranges.items()]
    return df.withColumn("role", F.explode(F.array_compact(F.array(*holds))))


def k_fold(sites: DataFrame, k: int = 4, seed: int = 0) -> DataFrame:
    """One row a site, fold and role."""
    return sites.withColumn("_f", hashed_order(F.col("subbasin"), seed=seed) % k).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("role", F.when(F.col("_f") == F.col("fold"), "test").otherwise("train")).drop("_f")


def epoch_order(samples: DataFrame, epoch: int, seed: int = 0) -> DataFrame:
    return samples.orderBy(hashed_order(F.col("sample_id"), F.lit(epoch), seed=seed), "sample_id")


def packed_batches(samples: DataFrame, budget: int, pool: int = 10, shards: int | None = None, shard_rows: int = 20_000, seed: int = 0) -> DataFrame:
    """shard, batch, slot of samples (sample_id, nodes): each batch takes a seed and then the largest that fits of the next pool, up to budget - 1 nodes.

    Shards of a hash are packed one by one, so a batch never spans two of them; without a number of shards it grows with the samples, some shard_rows each. A sample beyond the budget is an error.
    """
    n, most = samples.agg(F.count("*"), F.max("nodes")).first()
    if most is not None and most > budget - 1:
        raise ValueError("a sample is larger than the budget")
    shards = shards or max(1, -(-n // shard_rows))
    s = samples.select("sample_id", F.col("nodes").cast("long").alias("nodes")).withColumn("shard", F.pmod(F.xxhash64("sample_id", F.lit(seed)), F.lit(shards)).cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        queue = list(pdf.sort_values("sample_id")[["sample_id", "nodes"]].itertuples(index=False, name=None))
        out, batch = [], 0
        while queue:
            used, slot = 0, 0
            while queue:
                fits = [(n, -k) for k, (_, n) in enumerate(queue[:pool]) if used + n <= budget - 1]
                if not fits:
                    break
                k = 0 if slot == 0 else -max(fits)[1]
                i, n = queue.pop(k)
                out.append((int(pdf.shard.iloc[0]), batch, slot, i, n))
                used, slot = used + n, slot + 1
            batch += 1
        return pd.DataFrame(out, columns=["shard", "batch", "slot", "sample_id", "nodes"])

    return s.groupBy("shard").applyInPandas(pack, "shard int, batch int, slot int, sample_id long, nodes long")


def scored(df: DataFrame, features: list[str], model: Callable[[pd.DataFrame], pd.Series], name: str = "pred") -> DataFrame:
    """df with a model's prediction from the feature columns, batch by batch."""

    def run(batches):
        for pdf in batches:
            yield pdf.assign(**{name: model(pdf[features]).astype("float64")})

    return df.mapInPandas(run, df.limit(0).withColumn(name, F.lit(0.0)).schema)


def flat_observations(df: DataFrame, target: str, features: list[str], static: DataFrame) -> DataFrame:
    """Rows with the target and all features, with static attributes."""
    return df.dropna("any", subset=[target, *features]).join(static, "subbasin")


def reach_samples(
    df: DataFrame, site: str, date: str, features: list[str], targets: list[str], shape: tuple[str, str, str], scales: dict[str, tuple[float, float, bool]], size: int, least: int = 10, limit: float = 5.0, fill: float = 1.0
) -> DataFrame:
    """A row for each reach: n, and arrays of size days by day: x and y (features and targets, scaled as they come), mask, and hws (stage, width and slope, the columns of shape, in natural units).

    Days need the first feature and the first target. Reaches with fewer than least days of positive width and slope go; so do days of others, and days whose stage or width the robust mask rejects, and then
    reaches with fewer than least days left. A reach with a missing stage or width on any day has no robust mask, so it goes too. Places behind the n days hold fill, with a mask of 0; more than size days are an
    error. scales: offset, scale and log of the three. All is worked out behind one shuffle by reach.
    """
    stage, width, slope = shape
    h, w, s = (C.denormalised(C.no_nan(F.col(c).cast("double")), F.lit(scales[c][0]), F.lit(float(scales[c][1])), F.lit(scales[c][2])) for c in shape)
    there = lambda c: C.no_nan(F.col(c).cast("double")).isNotNull()
    d = df.where(there(features[0]) & there(targets[0])).withColumns({"_h": h, "_w": w, "_s": s})
    own = Window.partitionBy(site)
    physical = F.coalesce((F.col("_w") > 0) & (F.col("_s") > 0), F.lit(False))
    whole = F.count("_h").over(own) + F.count("_w").over(own) == 2 * F.count("*").over(own)
    d = d.withColumns({"_ok": physical, "_n": F.count_if(physical).over(own), "_all": whole})
    d = robust_mask(robust_mask(d, site, "_h", limit, "_mh"), site, "_w", limit, "_mw").where((F.col("_n") >= least) & F.col("_all") & F.col("_ok") & F.col("_mh") & F.col("_mw"))
    row = lambda names: F.array(*[F.col(c).cast("double") for c in names])
    rows = F.struct(date, row(features).alias("x"), row(targets).alias("y"), F.array("_h", "_w", "_s").alias("hws"))
    g = d.groupBy(site).agg(F.sort_array(F.collect_list(rows)).alias("_r")).where(F.size("_r") >= least)
    n = F.size("_r")
    fits = F.when(n <= size, n).otherwise(F.raise_error(F.format_string("a reach has %d days, more than the size", n)))
    padded = lambda c, k: F.concat(F.col(f"_r.{c}"), F.array_repeat(F.array_repeat(F.lit(fill), k), F.lit(size) - F.col("n"))).alias(c)
    mask = F.concat(F.array_repeat(F.lit(1).cast("tinyint"), F.col("n")), F.array_repeat(F.lit(0).cast("tinyint"), F.lit(size) - F.col("n"))).alias("mask")
    return g.withColumn("n", fits).select(site, "n", padded("x", len(features)), mask, padded("hws", 3), padded("y", len(targets)))
