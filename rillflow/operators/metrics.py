"""Skill metrics of predictions against observations, per site or in bulk, and summaries of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.operators.graph import cut
from rillflow.operators.windows import exact_quantiles, position_weights, rows_before

#: Rows count where observation and prediction are above LEAST, and sites where more than FEWEST rows do.
LEAST, FEWEST = 0.001, 8


def _prepared(df: DataFrame, keys: list[str], obs: str, pred: str) -> DataFrame:
    """Valid pairs o, p with what needs a window: average ranks and group means."""
    d = df.where((F.col(obs) > LEAST) & (F.col(pred) > LEAST) & ~F.isnan(obs) & ~F.isnan(pred)).withColumns({"o": F.col(obs).cast("double"), "p": F.col(pred).cast("double")})
    if not keys:  # one group of all rows: ranks by ranges of values, means joined as one row
        d = cut(d)  # read five times below
        d = rows_before(rows_before(d, [F.col("o")], "_o"), [F.col("p")], "_p")
        d = d.withColumns({"ro": F.col("_o") + (F.col("_o_ties") + 1) / 2, "rp": F.col("_p") + (F.col("_p_ties") + 1) / 2}).drop("_o", "_p", "_o_ties", "_p_ties")
        return d.crossJoin(F.broadcast(d.agg(F.avg("o").alias("mo"), F.avg("p").alias("mp"))))
    w = Window.partitionBy(*keys)
    rank = lambda c: F.rank().over(w.orderBy(c)) + (F.count("*").over(w.orderBy(c).rangeBetween(Window.currentRow, Window.currentRow)) - 1) / 2
    return d.withColumns({"ro": rank("o"), "rp": rank("p"), "mo": F.avg("o").over(w), "mp": F.avg("p").over(w)})


def _over(x: Column, y: Column) -> Column:
    return x / F.when(y != 0, y)


def _corr(x: str, y: str) -> Column:
    """Correlation; missing where one side does not vary."""
    return _over(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def _sse() -> Column:
    return F.sum((F.col("o") - F.col("p")) * (F.col("o") - F.col("p")))


def nse() -> Column:
    return 1 - _over(_sse(), F.var_pop("o") * F.count("o"))


def kge() -> Column:
    r, a, b = _corr("o", "p"), _over(F.stddev_pop("p"), F.stddev_pop("o")), _over(F.avg("p"), F.avg("o"))
    return 1 - F.sqrt((r - 1) * (r - 1) + (a - 1) * (a - 1) + (b - 1) * (b - 1))


def agreement() -> Column:
    """Index of agreement whose kappa term counts when the correlation is negative or missing."""
    r = _corr("o", "p")
    kappa = F.when(r >= 0, 0.0).otherwise(2 * F.abs(F.covar_pop("o", "p")))
    below = F.var_pop("o") + F.var_pop("p") + (F.avg("o") - F.avg("p")) * (F.avg("o") - F.avg("p")) + kappa
    return 1 - _over(_sse() / F.count("o"), below)


def r2() -> Column:
    """As NSE, but of flat observations 1 where all predictions are right and else 0."""
    return F.when(F.var_pop("o") == 0, F.when(_sse() == 0, 1.0).otherwise(0.0)).otherwise(nse())


def _signed(m: Column) -> Column:
    return 100 * F.signum(m) * (F.exp(F.abs(m)) - 1)


#: name -> (value of a pair, quantile, what the quantile becomes): metrics of an order of all pairs.
QUANTILES: dict[str, tuple[Callable[[], Column], float, Callable[[Column], Column]]] = {
    "sigE": (lambda: F.abs((F.col("p") - F.col("mp") - (F.col("o") - F.col("mo"))) / F.col("mo")), 0.67, lambda m: m),
    "nBias": (lambda: (F.col("p") - F.col("o")) / F.col("o"), 0.5, lambda m: m),
    "RE": (lambda: F.abs(F.ln(F.col("p") / F.col("o"))), 0.5, lambda m: 100 * (F.exp(m) - 1)),
    "RB": (lambda: F.ln(F.col("p") / F.col("o")), 0.5, _signed),
}


def _of_quantile(name: str) -> Callable[[], Column]:
    value, q, finish = QUANTILES[name]
    return lambda: finish(F.percentile(value(), q))


#: name -> Column builder over o, p, ro, rp, mo, mp; to add a metric is to add an entry.
METRICS: dict[str, Callable[[], Column]] = {
    "num_obs": lambda: F.count("o"),
    "R2": r2,
    "r": lambda: _corr("ro", "rp"),
    "NSE": nse,
    "KGE": kge,
    "kge_r": lambda: _corr("o", "p"),
    "kge_alpha": lambda: _over(F.stddev_pop("p"), F.stddev_pop("o")),
    "kge_beta": lambda: F.when(F.stddev_pop("o") != 0, _over(F.avg("p"), F.avg("o"))),
    "sigE": _of_quantile("sigE"),
    "rRMSE": lambda: 100 * _over(F.sqrt(_sse() / F.count("o")), F.avg("p")),
    "MAPE": lambda: F.avg(F.abs((F.col("p") - F.col("o")) / F.col("o"))),
    "nBias": _of_quantile("nBias"),
    "RE": _of_quantile("RE"),
    "RB": _of_quantile("RB"),
    "agreement": agreement,
    "MAE": lambda: F.avg(F.abs(F.col("p") - F.col("o"))),
    "RMSE": lambda: F.sqrt(_sse() / F.count("o")),
    "logNSE": lambda: 1 - _over(F.sum(F.pow(F.ln("o") - F.ln("p"), 2)), F.var_pop(F.ln("o")) * F.count("o")),
}


def skill(df: DataFrame, keys: list[str], obs: str = "obs", pred: str = "pred", metrics: dict[str, Callable[[], Column]] | None = None) -> DataFrame:
    """One row a key with each metric; without keys one row in bulk, whose quantiles are picked by rank. Metrics of too few pairs are missing."""
    d = _prepared(df, keys, obs, pred)
    chosen = METRICS if metrics is None else metrics
    ranked = [] if keys else [n for n, f in chosen.items() if n in QUANTILES and f is METRICS[n]]
    out = d.groupBy(*keys).agg(*[f().alias(n) for n, f in chosen.items() if n not in ranked], F.count("*").alias("_n"))
    if ranked:
        q = exact_quantiles(cut(d), {n: (QUANTILES[n][0](), QUANTILES[n][1]) for n in ranked})  # both sides have one row
        out = out.crossJoin(q.select(*[QUANTILES[n][2](F.col(n)).alias(n) for n in ranked]))
    return out.select(*keys, *[F.when((F.col("_n") > FEWEST) | F.lit(n == "num_obs"), F.col(n)).alias(n) for n in chosen])


def probabilistic_skill(df: DataFrame, keys: list[str], obs: str, pred: str, std: str) -> DataFrame:
    """nse_prob and msess: squared errors plus predicted variances against the variance of observations. Rows without a deviation do not count; too few rows give none."""
    valid = (F.col(obs) > LEAST) & (F.col(pred) > LEAST) & ~F.isnan(obs) & ~F.isnan(pred) & F.col(std).isNotNull() & ~F.isnan(std)
    d = df.where(valid).withColumns({"o": F.col(obs), "p": F.col(pred), "s": F.col(std)})
    total, error = F.var_pop("o") * F.count("o"), _sse() + F.sum(F.col("s") * F.col("s"))
    enough = lambda x: F.when(F.count("o") > FEWEST, x)
    return d.groupBy(*keys).agg(enough(1 - _over(error, total)).alias("nse_prob"), enough(1 - _over(error, 2 * total)).alias("msess"))


def log_r2(df: DataFrame, keys: list[str], obs: str, pred: str, most_without: int = 10) -> DataFrame:
    """log_r2: the share of variance of log10 observations that predictions explain, over more than so many pairs that are both above 0."""
    d = df.where((F.col(obs) > 0) & (F.col(pred) > 0)).select(*keys, F.log10(obs).alias("o"), F.log10(pred).alias("p"))
    return d.groupBy(*keys).agg(F.when(F.count("o") > most_without, nse()).alias("log_r2"))


def median_skill(per_site: DataFrame, metrics: list[str], least: int = 10) -> DataFrame:
    """Median of each metric over the sites with enough observations."""
    sites = per_site.where(F.col("num_obs") >= least)
    return exact_quantiles(sites, {m: (F.col(m), 0.5) for m in metrics}).crossJoin(sites.agg(F.count("*").alias("sites")))


def empirical_cdf(df: DataFrame, value: str) -> DataFrame:
    """cdf: the share of rows up to a row's value."""
    d = df.where(F.col(value).isNotNull())
    ranked = rows_before(d, [F.col(value)], "_before").crossJoin(F.broadcast(d.agg(F.count("*").alias("_all"))))
    return ranked.withColumn("cdf", (F.col("_before") + F.col("_before_ties")) / F.col("_all")).select(*d.columns, "cdf")


def quantiles(df: DataFrame, value: str, at: list[float]) -> DataFrame:
    """Exact quantiles of all rows, by rank; columns q50 and so on."""
    return exact_quantiles(df, {f"q{round(100 * q)}": (F.col(value), q) for q in at})


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int, log: bool = False) -> DataFrame:
    """Counts in equal bins, of the value or its log10; values outside go to bins 0 and bins + 1."""
    x = F.log10(value) if log else F.col(value)
    return df.where(x.isNotNull()).groupBy(F.width_bucket(x, F.lit(lo), F.lit(hi), F.lit(bins)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def cumulative_density(df: DataFrame, value: str, bins: int = 500, least: str | None = None) -> DataFrame:
    """bin, edge and density: the share of rows in bins up to each of so many equal ones between the least and the largest value. Missing, infinite and NaN values do not count, nor rows whose column least is not above 1.

    Bins without rows are there too. Where all values are one, bins reach half a unit to both sides.
    """
    x = F.col(value).cast("double")
    d = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")) & (F.lit(True) if least is None else F.col(least) > 1)).select(x.alias("_x"))
    ends = d.agg(F.min("_x").alias("a"), F.max("_x").alias("z"), F.count("*").alias("_all"))  # a row
    flat = F.when(F.col("a") == F.col("z"), 0.5).otherwise(0.0)
    ends = ends.select("_all", (F.col("a") - flat).alias("_lo"), (F.col("z") + flat).alias("_hi"))
    at = F.least(F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)).cast("int")
    held = d.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("_n"))
    every = ends.where("_all > 0").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(held, "bin", "left")  # as many rows as bins
    upto = F.sum(F.coalesce("_n", F.lit(0))).over(Window.orderBy("bin"))
    return every.select("bin", (F.col("_lo") + (F.col("bin") + 1) * (F.col("_hi") - F.col("_lo")) / bins).alias("edge"), (upto / F.col("_all")).alias("density"))


def density_2d(df: DataFrame, x: str, y: str, per_decade: int = 10, least: int = 5) -> DataFrame:
    """Counts in square log10 cells, those with enough rows."""
    cell = lambda c: F.floor(F.log10(c) * per_decade).cast("long")
    return df.where((F.col(x) > 0) & (F.col(y) > 0)).groupBy(cell(x).alias("cx"), cell(y).alias("cy")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def losses(df: DataFrame, obs: str, pred: str, node: str, huber: float = 1.0) -> DataFrame:
    """mse, mae, huber and the NSE loss: the mean over nodes of the squared error by row, of all rows of the node, over (deviation of observations + 0.1) squared; nodes of 0 are left out."""
    ok = F.col(obs).isNotNull() & F.col(pred).isNotNull()
    d = df.select(F.col(node).alias("k"), F.when(ok, F.col(obs)).alias("o"), F.when(ok, F.col(pred)).alias("p"))
    e = F.abs(F.col("o") - F.col("p"))
    per = d.groupBy("k").agg(F.count("o").alias("n"), F.count("*").alias("rows"), F.coalesce(_sse(), F.lit(0.0)).alias("sse"), F.sum(e).alias("sae"), F.sum(F.when(e <= huber, 0.5 * e * e).otherwise(huber * (e - 0.5 * huber))).alias("sh"), F.coalesce(F.stddev_pop("o"), F.lit(0.0)).alias("dev"))
    node_loss = F.col("sse") / F.col("rows") / ((F.col("dev") + 0.1) * (F.col("dev") + 0.1))
    n = F.sum("n")
    return per.agg((F.sum("sse") / n).alias("mse"), (F.sum("sae") / n).alias("mae"), (F.sum("sh") / n).alias("huber"), F.avg(F.when(node_loss != 0, node_loss)).alias("nse_loss"))


def spin_up_loss(df: DataFrame, obs: str, pred: str, node: str, order: str) -> DataFrame:
    """spin_up_nse: as the NSE loss, but squared errors count by their place in the node's sequence, by position_weights(), so that its last third decides. Rows without a pair are errors of 0."""
    d = position_weights(df.select(F.col(node).alias("k"), F.col(order).alias("_i"), F.col(obs).alias("o"), F.col(pred).alias("p")), "k", "_i", "w")
    ok = F.col("o").isNotNull() & F.col("p").isNotNull()
    square = F.when(ok, (F.col("o") - F.col("p")) * (F.col("o") - F.col("p"))).otherwise(0.0)
    per = d.groupBy("k").agg((F.sum(F.col("w") * square) / F.sum("w")).alias("mse"), F.coalesce(F.stddev_pop(F.when(ok, F.col("o"))), F.lit(0.0)).alias("dev"))
    loss = F.col("mse") / ((F.col("dev") + 0.1) * (F.col("dev") + 0.1))
    return per.agg(F.avg(F.when(loss != 0, loss)).alias("spin_up_nse"))


def mixture_loss(df: DataFrame, nll: Column, mask: Column) -> DataFrame:
    """gmm_nll: the mean negative log likelihood of the rows that the mask holds; 0 without any."""
    held = F.coalesce(mask & nll.isNotNull(), F.lit(False))
    return df.agg((F.coalesce(F.sum(F.when(held, nll)), F.lit(0.0)) / (F.sum(held.cast("double")) + 1e-8)).alias("gmm_nll"))


def loss_over_targets(losses: DataFrame, weights: dict[str, float], target: str = "target", loss: str = "loss") -> DataFrame:
    """loss: the mean over targets whose weight is not 0. A target without weight is left out; one without any pair, whose loss is missing, counts as 0."""
    chosen = [n for n, w in weights.items() if w != 0]
    return losses.where(F.col(target).isin(chosen)).agg(F.avg(F.coalesce(F.col(loss), F.lit(0.0))).alias("loss"))


def attribution(df: DataFrame, features: list[str]) -> DataFrame:
    """Absolute mean attribution of each feature, largest first."""
    x = df.select(*[F.col(c).cast("double").alias(c) for c in features]).unpivot([], features, "feature", "x")
    return x.groupBy("feature").agg(F.abs(F.avg(F.coalesce("x", F.lit(0.0)))).alias("attribution")).orderBy(F.desc("attribution"), "feature")


def metric_change(old: DataFrame, new: DataFrame, site: str, metric: str, counts: DataFrame) -> DataFrame:
    """Difference of a metric between two experiments at each common site, with observation counts."""
    both = old.select(site, F.col(metric).alias("old")).join(new.select(site, F.col(metric).alias("new")), site)
    return both.join(counts, site, "left").withColumn("delta", F.col("new") - F.col("old"))


def top_sites(df: DataFrame, site: str, by: str, n: int, ascending: bool = False) -> DataFrame:
    return df.orderBy(F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last(), site).limit(n)
