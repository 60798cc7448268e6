"""Matching of stations, reaches and grid cells."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.functions.columns import distance
from rillflow.operators.graph import cut
from rillflow.operators.windows import first_per_key, rows_before


def buffer_join(left: DataFrame, right: DataFrame, radius: float, how: str = "inner") -> DataFrame:
    """Pairs (id, x, y) x (rid, rx, ry) within the radius: an equi-join on grid cells as wide as the radius, the right side in its nine cells, then the exact distance."""
    cell = lambda c: F.floor(F.col(c) / F.lit(radius)).cast("long")
    a = left.withColumns({"_cx": cell("x"), "_cy": cell("y")})
    near = F.array(*[F.struct((cell("rx") + i).alias("_cx"), (cell("ry") + j).alias("_cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    b = right.withColumn("_c", F.explode(near)).select("*", "_c.*").drop("_c")
    hit = a.join(b, ["_cx", "_cy"]).drop("_cx", "_cy").withColumn("distance", distance(F.col("x"), F.col("y"), F.col("rx"), F.col("ry"))).where(F.col("distance") <= radius)
    if how == "inner":
        return hit
    if how == "right":
        return right.join(hit.drop("rx", "ry"), "rid", "left")
    return left.join(hit.drop("x", "y"), "id", "left")


def nearest_join(left: DataFrame, right: DataFrame, most: float, others: bool = False, crowd: int = 8) -> DataFrame:
    """The nearest right row (rid, rx, ry) of each left one (id, x, y) within the cut-off, with others only rows of another id; all ties stay. id tells left rows apart.

    Right rows at one place are one spot. Where cells as wide as the cut-off hold more than crowd spots, the search begins on cells that are halved until the fullest has about so many, and a row that
    has found no spot within a cell's width goes on to cells twice as wide: in dense places few spots are looked at, and no row looks beyond twice its distance.
    """
    spots = right.groupBy("rx", "ry").agg(F.min("rid").alias("_lo"), F.max("rid").alias("_hi")).where("rx IS NOT NULL AND ry IS NOT NULL")
    fullest = spots.groupBy(*[F.floor(F.col(c) / F.lit(most)).alias(c) for c in ("rx", "ry")]).count().agg(F.max("count")).first()[0] or 0
    rounds = 0
    while fullest > crowd * 4**rounds and rounds < 24:
        rounds += 1
    spots = cut(spots) if rounds else spots
    left_open, found = left.select("id", "x", "y"), None
    for k in range(rounds, -1, -1):
        hit = buffer_join(left_open, spots, most / 2**k)
        if others:
            hit = hit.where((F.col("_lo") != F.col("id")) | (F.col("_hi") != F.col("id")))
        if k:  # what is as far as the cells are wide may round to either side, so it is found in the next round
            hit = hit.where(F.col("distance") < F.lit(most / 2**k * (1 - 1e-9)))
        near = hit.withColumn("_n", F.rank().over(Window.partitionBy("id").orderBy("distance"))).where("_n = 1").select("id", "rx", "ry", "distance")
        near = cut(near) if rounds else near
        found = near if found is None else found.unionByName(near)
        if k:
            left_open = cut(left_open.join(near.select("id"), "id", "left_anti"))
    out = left.join(found, "id").join(right, ["rx", "ry"])
    return (out.where("id <> rid") if others else out).select(*left.columns, *right.columns, "distance")


def best_match(pairs: DataFrame, key: str, difference: str, tie: str) -> DataFrame:
    """The pair of least absolute difference of each key; missing ones last."""
    return first_per_key(pairs, [key], [F.abs(F.col(difference)).asc_nulls_last(), F.col(tie)])


def two_pass_match(pairs: DataFrame, site: str, reach: str, difference: str, mean_q: str) -> DataFrame:
    """The best reach of each site, then the best site of each reach; pairs without a difference by largest mean discharge."""
    order = lambda tie: [F.abs(F.col(difference)).asc_nulls_last(), F.col(mean_q).desc_nulls_last(), F.col(tie)]
    return first_per_key(first_per_key(pairs, [site], order(reach)), [reach], order(site))


def overridden(df: DataFrame, lookup: DataFrame, key: str, column: str) -> DataFrame:
    return df.join(lookup.select(key, F.col(column).alias("_o")), key, "left").withColumn(column, F.coalesce("_o", column)).drop("_o")


def downstream_vectors(points: DataFrame) -> DataFrame:
    """dx, dy from each node (node, nextdown, x, y) to the next one."""
    to = points.select(F.col("node").alias("nextdown"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    return points.join(to, "nextdown").select("node", "nextdown", (F.col("_x") - F.col("x")).alias("dx"), (F.col("_y") - F.col("y")).alias("dy"))


def edge_vectors(edges: DataFrame, nodes: DataFrame, points: DataFrame, weight: str | None = None) -> DataFrame:
    """Arrows for a map: x, y of the sending node and dx, dy to the receiving one, of the edges (batch, src, dst, mask) of collated batches whose mask is true. nodes (batch, place, site) tell the site of a place, points (site, x, y) where it is.

    Padded edges are left out, and so are edges of sites without a point.
    """
    at = nodes.join(points.select("site", "x", "y"), "site").select("batch", "place", "site", "x", "y")
    a = at.select("batch", F.col("place").alias("src"), F.col("site").alias("from"), "x", "y")
    b = at.select("batch", F.col("place").alias("dst"), F.col("site").alias("to"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    j = edges.where("mask").join(a, ["batch", "src"]).join(b, ["batch", "dst"])
    return j.select("batch", "from", "to", "x", "y", (F.col("_x") - F.col("x")).alias("dx"), (F.col("_y") - F.col("y")).alias("dy"), *([weight] if weight else []))


def zonal_stats(grid: DataFrame, weights: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Weighted mean and variance of a gridded value over each zone; missing cells are skipped. grid: cell, keys, value; weights: cell, zone, w."""
    j = grid.where(F.col(value).isNotNull()).join(weights, "cell")
    s = j.groupBy("zone", *keys).agg(F.sum("w").alias("_w"), F.sum(F.col("w") * F.col(value)).alias("_x"), F.sum(F.col("w") * F.col(value) * F.col(value)).alias("_q"))
    w = F.when(F.col("_w") != 0, F.col("_w"))
    return s.select("zone", *keys, (F.col("_x") / w).alias("mean"), F.greatest(F.col("_q") / w - (F.col("_x") / w) * (F.col("_x") / w), F.lit(0.0)).alias("var"))


def cells_in_boxes(cells: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """Cells (cell, x, y) inside boxes (box, x0, x1, y0, y1), by an equi-join on coarse squares and then the exact bounds."""
    band = lambda c: F.floor(F.col(c) / F.lit(size)).cast("long")
    b = boxes.where("x0 <= x1 AND y0 <= y1").withColumn("_b", F.explode(F.sequence(band("x0"), band("x1")))).withColumn("_c", F.explode(F.sequence(band("y0"), band("y1"))))
    hit = cells.withColumns({"_b": band("x"), "_c": band("y")}).join(b, ["_b", "_c"]).drop("_b", "_c")
    return hit.where(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))).select("cell", "box")


def covered(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The exact area that a ring (array of points; closed or not, of either direction, dents allowed) has within a box.

    Each edge adds, over the part of the box's x that it spans, the mean height that it has above the box's floor, held within the box; edges back take away. Of an edge that rises
    through the box's floor or ceiling the share below, within and above counts on its own, so the sum is exact.
    """
    n = F.size(ring)
    held, within = (lambda y: F.greatest(F.least(y, y1), y0)), (lambda x: F.greatest(F.least(x, x1), x0))

    def step(rows: Column, f: Callable[[Column], dict[str, Column]]) -> Column:
        """What f names of each row. A step binds its values: an expression that is used twice would be worked out twice."""
        return F.transform(rows, lambda e: F.struct(*[v.alias(k) for k, v in f(e).items()]))

    u, v = (lambda i: F.get(ring, i)), (lambda i: F.get(ring, (i + 1) % n))
    edges = step(F.sequence(F.lit(0), n - 1), lambda i: {"ax": u(i)["x"], "ay": u(i)["y"], "bx": v(i)["x"], "by": v(i)["y"]})
    edges = step(edges, lambda e: {c: e[c] for c in ("ax", "ay", "bx", "by")} | {"p": within(e["ax"]), "q": within(e["bx"]), "rise": (e["by"] - e["ay"]) / F.when(e["bx"] != e["ax"], e["bx"] - e["ax"])})
    at = lambda e, x, c: F.when(e[x] == e[f"{c}x"], e[f"{c}y"]).otherwise(e["ay"] + (e[x] - e["ax"]) * e["rise"])
    edges = step(edges, lambda e: {"wide": e["q"] - e["p"], "s": at(e, "p", "a"), "t": at(e, "q", "b")})
    edges = step(edges, lambda e: {c: e[c] for c in ("wide", "s", "t")} | {"hs": held(e["s"]), "ht": held(e["t"]), "span": F.when(F.abs(e["t"] - e["s"]) > 1e-13 * (y1 - y0), e["t"] - e["s"])})

    def part(e: Column) -> Column:
        inside = (e["ht"] - e["hs"]) / e["span"] * ((e["hs"] + e["ht"]) / 2 - y0)
        above = (F.greatest(e["t"], y1) - F.greatest(e["s"], y1)) / e["span"] * (y1 - y0)
        return F.coalesce(e["wide"] * F.coalesce(inside + above, held((e["s"] + e["t"]) / 2) - y0), F.lit(0.0))

    return F.abs(F.aggregate(edges, F.lit(0.0), lambda a, e: a + part(e)))


def coverage_weights(cells: DataFrame, rings: DataFrame, size: float) -> DataFrame:
    """Share of each grid cell (cell, x, y at its middle) inside each polygon (zone, ring: array of points), by exact areas.

    Places of cells and rings meet on coarse cells of 8 by 8; a place's share is worked out once, however many cells are there, and then goes to each of them.
    """
    axis = lambda c: F.transform("ring", lambda p: p[c])
    box = rings.where(F.size("ring") > 2).select("*", *[f(axis(c)).alias(f"{c}{n}") for c in "xy" for n, f in ((0, F.array_min), (1, F.array_max))])
    band = lambda c: F.floor(c / F.lit(size * 8)).cast("long")
    half = F.lit(size / 2)
    for c in "xy":
        box = box.withColumn(f"_{c}", F.explode(F.sequence(band(F.col(f"{c}0") - half), band(F.col(f"{c}1") + half))))
    pairs = cells.select("x", "y").distinct().withColumns({f"_{c}": band(F.col(c)) for c in "xy"}).join(box, ["_x", "_y"])
    near = (F.col("x") + half > F.col("x0")) & (F.col("x") - half < F.col("x1")) & (F.col("y") + half > F.col("y0")) & (F.col("y") - half < F.col("y1"))
    x, y = F.col("x"), F.col("y")
    share = covered(F.col("ring"), x - half, y - half, x + half, y + half) / (size * size)
    shares = pairs.where(near).select("x", "y", "zone", F.explode(F.filter(F.array(share), lambda w: w > 0)).alias("w"))  # a filter behind it would work it out twice
    return cells.join(shares, ["x", "y"]).select("cell", "zone", "w")


def point_on_line(line: str = "line", x: str = "x", y: str = "y", lo: float = 0.01, hi: float = 0.99):
    """Fraction along a line (array of points) that is nearest to a point, held within [lo, hi]."""
    n = F.size(line)
    seg = F.transform(
        F.sequence(F.lit(0), n - 2),
        lambda i: F.struct(F.get(line, i)["x"].alias("ax"), F.get(line, i)["y"].alias("ay"), F.get(line, i + 1)["x"].alias("bx"), F.get(line, i + 1)["y"].alias("by")),
    )
    length = lambda s: distance(s["ax"], s["ay"], s["bx"], s["by"])
    total = F.aggregate(F.transform(seg, length), F.lit(0.0), lambda a, v: a + v)

    def measured(acc, s):
        dx, dy, size = s["bx"] - s["ax"], s["by"] - s["ay"], length(s)
        t = F.greatest(F.least(F.coalesce(((F.col(x) - s["ax"]) * dx + (F.col(y) - s["ay"]) * dy) / F.when(size > 0, size * size), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
        d = distance(F.col(x), F.col(y), s["ax"] + t * dx, s["ay"] + t * dy)
        better = d < acc["best"]
        return F.struct(F.when(better, d).otherwise(acc["best"]).alias("best"), F.when(better, acc["done"] + t * size).otherwise(acc["at"]).alias("at"), (acc["done"] + size).alias("done"))

    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(0.0).alias("at"), F.lit(0.0).alias("done"))
    found = F.aggregate(seg, start, measured, lambda a: a["at"])
    return F.greatest(F.least(found / F.when(total > 0, total), F.lit(hi)), F.lit(lo))


def hilbert_key(x: Column, y: Column, bits: int = 16) -> Column:
    """The place of a cell (whole numbers below 2 ** bits) along the Hilbert curve, on which neighbours stay close."""
    n = 1 << bits

    def step(at: Column, s: Column) -> Column:
        right, up = at["x"].bitwiseAND(s) != 0, at["y"].bitwiseAND(s) != 0
        d = at["d"] + s * s * F.when(right & ~up, 3).when(right, 2).when(up, 1).otherwise(0)
        turned = lambda c: F.when(right & ~up, n - 1 - c).otherwise(c)
        return F.struct(F.when(up, at["x"]).otherwise(turned(at["y"])).alias("x"), F.when(up, at["y"]).otherwise(turned(at["x"])).alias("y"), d.alias("d"))

    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))
    return F.aggregate(F.array(*[F.lit(1 << k).cast("long") for k in reversed(range(bits))]), start, step, lambda at: at["d"])


def spatial_batches(points: DataFrame, batch: int, pad: float = 0.1, bits: int = 16) -> DataFrame:
    """points (id, x, y) in batches of exactly batch points along a Hilbert curve (the last has the rest), with n and their bounding boxes padded and snapped outward to the grid.

    Places on the curve are counted by range, so no task sees all points; a batch is a run of the curve, its box a group of batch points.
    """
    extent = points.agg(*[f(c).alias(f"_{c}{n}") for c in "xy" for n, f in ((0, F.min), (1, F.max))])
    cell = lambda c: F.floor(F.coalesce((F.col(c) - F.col(f"_{c}0")) / F.when(F.col(f"_{c}1") > F.col(f"_{c}0"), F.col(f"_{c}1") - F.col(f"_{c}0")), F.lit(0.0)) * ((1 << bits) - 1))
    keyed = points.crossJoin(F.broadcast(extent)).select(*points.columns, hilbert_key(cell("x"), cell("y"), bits).alias("_key"))
    labelled = rows_before(keyed, [F.col("_key"), F.col("id")], "_before").withColumn("batch", F.floor(F.col("_before") / batch).cast("long")).select(*points.columns, "batch")
    box = labelled.groupBy("batch").agg(
        *[(F.floor((F.min(c) - pad) / pad) * pad).alias(f"{c}0") for c in "xy"], *[(F.ceil((F.max(c) + pad) / pad) * pad).alias(f"{c}1") for c in "xy"], F.count("*").alias("n")
    )
    return labelled.join(box, "batch")


def grid_snapped(df: DataFrame, column: str, step: float = 0.1, tolerance: float = 0.01) -> DataFrame:
    """Integer grid keys of coordinates; those further from the grid than the tolerance go."""
    k = F.round(F.col(column) / step)
    return df.where(F.abs(F.col(column) - k * step) <= tolerance).withColumn(f"{column}_key", k.cast("long"))


def grid_weights(weights: DataFrame, grid: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Each grid cell (cell, x, y) with the weight w of the nearest weight (x, y, w) whose coordinates both are within the tolerance, missing where there is none; ties go to the smaller x, then y.

    An equi-join on squares as wide as the tolerance, each weight in its nine, so that none at a square's border is lost; then the exact bounds.
    """
    k = lambda c: F.floor(F.col(c) / F.lit(tolerance)).cast("long")
    near = F.array(*[F.struct((k("x") + i).alias("_cx"), (k("y") + j).alias("_cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    b = weights.withColumn("_c", F.explode(near)).select("_c._cx", "_c._cy", F.col("x").alias("_x"), F.col("y").alias("_y"), "w")
    dx, dy = F.abs(F.col("x") - F.col("_x")), F.abs(F.col("y") - F.col("_y"))
    hit = grid.select("cell", "x", "y", k("x").alias("_cx"), k("y").alias("_cy")).join(b, ["_cx", "_cy"]).where((dx <= tolerance) & (dy <= tolerance))
    best = hit.groupBy("cell").agg(F.min_by("w", F.struct(dx, dy, "_x", "_y")).alias("w"))
    return grid.join(best, "cell", "left")
