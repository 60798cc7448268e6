"""Column builders: cleaning, scaling, encodings, hydraulics, mixtures and dates. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def no_nan(c: Column) -> Column:
    """NaN as NULL; inside the engine missing values are NULL only."""
    return F.when(~F.isnan(c), c)


def clip_to_null(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Values outside [lo, hi] become missing; they are not moved to the bound."""
    ok = F.lit(True)
    if lo is not None:
        ok = ok & (c >= lo)
    if hi is not None:
        ok = ok & (c <= hi)
    return F.when(ok, c)


def value_filter(c: Column, control: Column, operation: str, value: float) -> Column:
    """Blanks c by a control column: less_than keeps control > value, greater_than keeps control < value, equals keeps control <> value (and a missing control)."""
    keep = {"less_than": control > value, "greater_than": control < value, "equals": control.isNull() | (control != value)}
    if operation not in keep:
        raise ValueError(f"unknown operation {operation}")
    return F.when(keep[operation], c)


def sentinel_to_null(c: Column, *sentinels) -> Column:
    return F.when(~c.isin(*sentinels), c)


def normalised(c: Column, offset: Column, scale: Column, log_norm: Column) -> Column:
    """(log1p(x) or x, less the offset) over the scale; a scale of 0 only subtracts."""
    x = F.when(log_norm, F.log1p(c)).otherwise(c) - offset
    return F.when(scale == 0, x).otherwise(x / F.when(scale != 0, scale))


def denormalised(c: Column, offset: Column, scale: Column, log_norm: Column, smearing: float = 1.0) -> Column:
    x = F.when(scale == 0, c).otherwise(c * scale) + offset
    return F.when(log_norm, F.expm1(x) * F.lit(smearing)).otherwise(x)


def denormalised_std(mu: Column, sigma: Column, offset: Column, scale: Column, log_norm: Column | None = None, scaled: bool = True) -> Column:
    """Standard deviation in original units. Log variables, and all without log_norm, are log-normals given by mu and sigma in scaled log units; of the others sigma times the scale is left.

    scaled=False takes mu and sigma of log variables as log units but for the offset, for scales that hold none.
    """
    m, s = (mu * scale + offset, sigma * scale) if scaled else (mu + offset, sigma)
    spread = F.sqrt(F.expm1(s * s) * F.exp(2 * m + s * s))
    return spread if log_norm is None else F.when(log_norm, spread).otherwise(sigma * scale)


def require_plain(names: list[str], encoded: list[str]) -> None:
    """An error if a name is that of an encoded column: those have no scale, so they are neither normalised nor brought back."""
    if odd := sorted(n for n in names if n in encoded):
        raise ValueError(f"encoded columns have no scale: {odd}")


def relative_difference(a: Column, b: Column) -> Column:
    return (a - b) / F.when(a + b != 0, (a + b) / 2)


def unit_discharge(q: Column, area: Column) -> Column:
    return q / F.when(area != 0, area)


def discharge_of(unit: Column, area: Column) -> Column:
    """The discharge that unit_discharge() has been made of; missing without an area."""
    return unit * F.when(area != 0, area)


def softplus(x: Column) -> Column:
    """ln(1 + exp(x)), also where exp(x) is too large."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def manning_soft(area0: Column, width: Column, dh: Column, slope: Column, n: Column, least: float = 1e-6) -> Column:
    """Discharge by Manning's equation with the area held above 0 by softplus, so that only width and slope can leave it missing."""
    a = least + softplus(area0 + width * dh)
    return F.when((width > 0) & (slope >= 0), F.pow(a, 5 / 3) * F.pow(width, -2 / 3) * F.sqrt(slope) / n)


def manning(area0: Column, width: Column, dh: Column, slope: Column, n: Column) -> Column:
    """Discharge of a reach from its base area, width, stage change, slope and roughness; missing where a root has no value."""
    a = area0 + width * dh
    return F.when((a > 0) & (width > 0) & (slope > 0), F.pow(a, 5 / 3) * F.pow(width, -2 / 3) * F.sqrt(slope) / n)


def one_hot(c: Column, name: str, categories: list) -> list[Column]:
    """One 0 / 1 column a category, by equality; a missing value is 0 in each."""
    if not categories:
        raise ValueError("an encoding must list its categories")
    return [F.when(c == F.lit(x), 1.0).otherwise(0.0).alias(f"{name}_{x}") for x in categories]


def bit_columns(c: Column, name: str, bits: list[int]) -> list[Column]:
    """One 0 / 1 column a bit; a missing value stays missing."""
    if not bits:
        raise ValueError("an encoding must list its bits")
    return [F.shiftright(c.cast("long"), b).bitwiseAND(F.lit(1)).cast("long").alias(f"{name}_bit_{b}") for b in bits]


def sinusoidal(position: Column, size: int) -> Column:
    """Position encoding: sines at even places, cosines at odd ones."""
    return F.array(*[(F.sin if i % 2 == 0 else F.cos)(position / F.lit(10000.0 ** (2 * (i // 2) / size))) for i in range(size)])


def _log_sum_exp(xs: Column) -> Column:
    top = F.array_max(xs)
    return top + F.ln(F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def _log_mean(mu: Column, sigma: Column, log_pi: Column, scale: float, offset: float) -> Column:
    """Log of the mean of exp(x), where x is a Gaussian mixture in scaled units; log weights are normalised first."""
    means = F.zip_with(mu, sigma, lambda m, s: m * scale + offset + 0.5 * (s * scale) * (s * scale))
    return _log_sum_exp(F.zip_with(means, log_pi, lambda m, p: m + p)) - _log_sum_exp(log_pi)


def mixture_mean(mu: Column, sigma: Column, log_pi: Column, scale: float = 1.0, offset: float = 0.0) -> Column:
    """Mean in natural units of a variable whose log1p, scaled, is a Gaussian mixture."""
    return F.exp(_log_mean(mu, sigma, log_pi, scale, offset)) - 1


def mixture_std(mu: Column, sigma: Column, log_pi: Column, scale: float = 1.0, offset: float = 0.0, floor: float = 1e-6) -> Column:
    """Deviation of the same: variances within the parts and between their means; the variance is floor at least."""
    z, mean = _log_sum_exp(log_pi), F.exp(_log_mean(mu, sigma, log_pi, scale, offset))
    within = F.zip_with(mu, sigma, lambda m, s: F.exp(2 * (m * scale + offset) + (s * scale) * (s * scale)) * F.expm1((s * scale) * (s * scale)))
    squares = F.zip_with(mu, sigma, lambda m, s: F.exp(2 * (m * scale + offset) + (s * scale) * (s * scale)))
    total = F.zip_with(F.zip_with(within, squares, lambda v, q: v + q), log_pi, lambda x, p: x * F.exp(p - z))
    return F.sqrt(F.greatest(F.aggregate(total, F.lit(0.0), lambda a, x: a + x) - mean * mean, F.lit(floor)))


def mixture_nll(y: Column, mu: Column, sigma: Column, log_pi: Column, limit: float = 20.0) -> Column:
    """Negative log likelihood of y; scaled residuals are held within the limit."""
    residual = F.zip_with(mu, sigma, lambda m, s: F.greatest(F.least((y - m) / s, F.lit(limit)), F.lit(-limit)))
    terms = F.zip_with(F.zip_with(residual, sigma, lambda r, s: -0.5 * r * r - F.ln(s) - 0.9189385332046727), log_pi, lambda t, p: t + p)
    return _log_sum_exp(log_pi) - _log_sum_exp(terms)


def mean_in_order(value: Column, order: Column) -> Column:
    """Aggregate: the mean, summed by order, so that its last digits do not depend on how rows are dealt."""
    rows = F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v")))))
    return F.aggregate(rows, F.lit(0.0), lambda a, x: a + x["v"]) / F.when(F.size(rows) > 0, F.size(rows))


def padded(xs: Column, size: int, fill: float = 1.0) -> Column:
    """An array at a fixed length; a longer one is an error."""
    n = F.size(xs)
    return F.when(n <= size, F.concat(xs, F.array_repeat(F.lit(fill), F.lit(size) - n))).otherwise(F.raise_error(F.lit(f"more than {size} values")))


def padding_mask(xs: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: i < F.size(xs))


def nearest_day(ts: Column) -> Column:
    """The nearest day; noon itself goes to the later day."""
    return F.to_date(ts + F.expr("INTERVAL 12 HOURS"))


def utc_day(ts: Column) -> Column:
    """The day in UTC of a moment, whatever the session's zone."""
    return F.to_date(F.to_utc_timestamp(ts, F.current_timezone()))


def epoch_days(day: Column) -> Column:
    """Days since 1970-01-01."""
    return F.unix_date(day)


def parsed_ids(c: Column) -> Column:
    """A list of whole numbers from its text, or missing."""
    return F.from_json(c, "array<bigint>")


def reach_type(reach_id: Column) -> Column:
    return reach_id % 10


def region_code(reach_id: Column) -> Column:
    return F.floor(reach_id / F.lit(10**9)).cast("long")



# --------------------------------------------------------------------------- geometry in closed form

# The authalic projection on the WGS84 ellipsoid at 30 degrees (EPSG:6933) and the spherical radius (EPSG:3857).
SEMI_MAJOR, ECCENTRICITY, TRUE_SCALE = 6378137.0, 0.08181919084262149, 30.0


def equal_area(lon: Column, lat: Column) -> tuple[Column, Column]:
    """x and y in metres of the cylindrical equal-area projection."""
    e, s = ECCENTRICITY, F.sin(F.radians(lat))
    import math

    s0 = math.sin(math.radians(TRUE_SCALE))
    k = math.cos(math.radians(TRUE_SCALE)) / math.sqrt(1 - e * e * s0 * s0)
    q = (1 - e * e) * (s / (1 - e * e * s * s) - F.ln((1 - e * s) / (1 + e * s)) / (2 * e))
    return SEMI_MAJOR * k * F.radians(lon), SEMI_MAJOR * q / (2 * k)


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return SEMI_MAJOR * F.radians(lon), SEMI_MAJOR * F.ln(F.tan(F.radians(lat) / 2 + 0.7853981633974483))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def middle_vertex(line: Column) -> Column:
    """The vertex in the middle of a line (array of points x, y); the later of two."""
    return F.get(line, F.floor(F.size(line) / 2).cast("int"))


def oriented(line: Column, below: Column) -> Column:
    """A line turned so that it runs downstream: its end lies at the start of the line below. It is turned if its start is nearer to that, and left as it is where there is no line below."""
    to = F.get(below, 0)
    gap = lambda p: distance(p["x"], p["y"], to["x"], to["y"])
    return F.when(gap(F.get(line, 0)) < gap(F.element_at(line, -1)), F.reverse(line)).otherwise(line)


def along(line: Column, share: Column) -> Column:
    """The point at a share, from 0 to 1, of a line's length; missing for lines without a length."""
    at = F.get(line, 0)
    parts = F.transform(F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0))), lambda p, i: F.struct(F.get(line, i)["x"].alias("ax"), F.get(line, i)["y"].alias("ay"), p["x"].alias("bx"), p["y"].alias("by")))
    size = lambda s: distance(s["ax"], s["ay"], s["bx"], s["by"])
    total = F.aggregate(parts, F.lit(0.0), lambda a, s: a + size(s))

    def step(acc: Column, s: Column) -> Column:
        inside = acc["left"].between(0.0, size(s)) & (size(s) > 0)
        t = acc["left"] / F.when(size(s) > 0, size(s))
        return F.struct((acc["left"] - size(s)).alias("left"), F.when(inside, s["ax"] + t * (s["bx"] - s["ax"])).otherwise(acc["x"]).alias("x"), F.when(inside, s["ay"] + t * (s["by"] - s["ay"])).otherwise(acc["y"]).alias("y"))

    last = F.element_at(line, -1)
    start = F.struct((share * total).alias("left"), F.when(share > 0, last["x"]).otherwise(at["x"]).cast("double").alias("x"), F.when(share > 0, last["y"]).otherwise(at["y"]).cast("double").alias("y"))
    return F.when(total > 0, F.aggregate(parts, start, step, lambda a: F.struct(a["x"].alias("x"), a["y"].alias("y"))))


def centroid(ring: Column) -> Column:
    """The centroid of a ring's area (array of points x, y, closed or not); of a ring without area the mean of its vertices."""
    o = F.get(ring, 0)
    n = F.size(ring)
    near = F.transform(ring, lambda p: F.struct((p["x"] - o["x"]).alias("x"), (p["y"] - o["y"]).alias("y")))  # from the first vertex: far from the origin products would lose digits
    none = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def edge(acc: Column, i: Column) -> Column:
        p, q = F.get(near, i), F.get(near, F.pmod(i + 1, n))
        turn = p["x"] * q["y"] - q["x"] * p["y"]
        return F.struct((acc["a"] + turn).alias("a"), (acc["x"] + (p["x"] + q["x"]) * turn).alias("x"), (acc["y"] + (p["y"] + q["y"]) * turn).alias("y"))

    mean = lambda c: o[c] + F.aggregate(near, F.lit(0.0), lambda a, p: a + p[c]) / n
    found = F.aggregate(F.sequence(F.lit(0), n - 1), none, edge, lambda a: F.struct(*[F.coalesce(o[c] + a[c] / F.when(a["a"] != 0, 3 * a["a"]), mean(c)).alias(c) for c in "xy"]))
    return F.when(n > 0, found)
