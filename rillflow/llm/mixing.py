"""Mixing sources to target weights by temperature.

Source token shares are raised to an exponent between 1 (as they are) and 0 (uniform) and normalised. The exponent is bisected to meet an entropy or a limit on how
often a source repeats. Weights are then realised within a token budget: the documents of a source lie in BLOCKS blocks by a hash; each epoch is a permutation of the blocks;
whole epochs first, then blocks of one more permutation while the budget lasts, then documents of the block at the border while it lasts.

Only sums per (source, block) are gathered, at most BLOCKS rows a source, so a hot source is as many keys as any other and no window spans a source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.llm.common import apart, written

BLOCKS, STEPS = 1024, 8


def count_words(text: str = "text") -> Column:
    """The number of words [^\\x20\\x09-\\x0D]+ of a text."""
    return F.size(F.array_remove(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def draw(*parts: Column) -> Column:
    """A 32-bit number from the md5 of the parts: the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *[p.cast("string") for p in parts]).cast("binary")), 1, 8), 16, 10).cast("long")


def source_key(source: str = "source") -> Column:
    """The source as a key: a null source is a source of its own."""
    s = F.col(source).cast("string")
    return F.when(s.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), s))


def entropy(shares: DataFrame, exponents: list[float]) -> list[float]:
    """Entropy (nats) of the shares raised to each exponent and normalised."""
    sums = []
    for i, a in enumerate(exponents):
        p = F.pow("share", F.lit(a))
        sums += [F.sum(p).alias(f"z{i}"), F.sum(p * F.ln("share") * a).alias(f"e{i}")]
    r = shares.agg(*sums).first()
    return [math.log(r[f"z{i}"]) - r[f"e{i}"] / r[f"z{i}"] for i in range(len(exponents))]


def repetition(shares: DataFrame, exponents: list[float], tokens: int, budget: int | None) -> list[float]:
    """Most epochs of any source under each exponent; without a budget, of the least one that holds each source once."""
    cells = []
    for i, a in enumerate(exponents):
        rate = F.pow("share", F.lit(a - 1))
        cells += [F.max(rate).alias(f"m{i}"), F.min(rate).alias(f"l{i}"), F.sum(F.pow("share", F.lit(a))).alias(f"z{i}")]
    r = shares.agg(*cells).first()
    return [r[f"m{i}"] / r[f"l{i}"] if budget is None else r[f"m{i}"] / r[f"z{i}"] * budget / tokens for i in range(len(exponents))]


def bisected(meets, steps: int = STEPS, fan: int = 15) -> float:
    """The least exponent in [0, 1] that meets a condition which holds from some exponent on; fan + 1 parts a job, four bisections at once."""
    lo, hi = 0.0, 1.0
    if meets([0.0])[0]:
        return 0.0
    for _ in range(steps):
        points = [lo + (hi - lo) * (i + 1) / (fan + 1) for i in range(fan)]
        ok = [*meets(points), True]
        k = ok.index(True)
        lo, hi = (points[k - 1] if k else lo), (points[k] if k < fan else hi)
    return hi


def mixed(docs: DataFrame, **targets) -> DataFrame:
    """The columns of docs, whatever their names, of mixed_sources(): one row for each copy of a document."""
    return apart(docs, ("doc_id", "text", "source"), lambda d: mixed_sources(d, **targets))


def mixed_sources(
    docs: DataFrame,
    max_repeat: float | None = 2.0,
    target_entropy: float | None = None,
    budget: int | None = None,
    seed: int = 0,
    tokens: Column | None = None,
) -> DataFrame:
    """The columns of docs with n_tokens, epoch, and block_rank, the order of its block in the epoch: one row for each copy of a document.

    Exactly one of max_repeat (the source that repeats most does so at most as often) and target_entropy (nats; the share entropy is raised to it, or to
    the uniform one if it is beyond that) is met by the exponent. Without a budget the least one is taken at which every source is used whole at least once, so no document is lost.

    Null texts have no tokens and go with their block; a source without tokens is used once. A null source is a source of its own. Rows that repeat a doc_id and text are copies of their
    own, in the same block. Columns named n_tokens, epoch or block_rank are replaced.
    """
    if (max_repeat is None) == (target_entropy is None):
        raise ValueError("give max_repeat or target_entropy")
    names = [c for c in docs.columns if c not in ("n_tokens", "epoch", "block_rank")]
    id_ = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    d = docs.select(*names).withColumns({"n_tokens": count_words() if tokens is None else tokens, "_s": source_key(), "_b": draw(F.lit(seed), id_) % BLOCKS})
    blocks = written(d.groupBy("_s", "_b").agg(F.sum("n_tokens").alias("size")), "blocks")
    per_source = blocks.groupBy("_s").agg(F.sum("size").alias("avail"))
    total = per_source.agg(F.sum("avail")).first()[0] or 0
    shares = written(per_source.where("avail > 0").withColumn("share", F.col("avail") / F.lit(float(max(1, total)))), "shares")
    if not shares.take(1):
        exponent = 1.0
    elif max_repeat is not None:
        exponent = bisected(lambda xs: [r <= max_repeat for r in repetition(shares, xs, total, budget)])
    else:  # entropy falls as the exponent grows: the largest that still reaches it
        exponent = 1 - bisected(lambda xs: [h >= target_entropy for h in entropy(shares, [1 - x for x in xs])])
    z = F.pow("share", F.lit(exponent))
    norm = shares.agg(F.sum(z), F.max(F.col("avail") / z)).first()
    whole = float(budget) if budget is not None else (norm[0] or 0.0) * (norm[1] or 0.0)
    target = F.round(z / F.lit(norm[0] or 1.0) * whole).cast("long")
    goals = shares.select("_s", "avail", target.alias("goal")).withColumns({"_full": F.floor(F.col("goal") / F.col("avail")), "_rest": F.col("goal") % F.col("avail")})
    # blocks of the last, partial epoch in order of its permutation
    rank = draw(F.lit(seed), F.col("_full"), F.col("_s"), F.col("_b"))
    plan = blocks.join(goals, "_s", "left").withColumns({"_full": F.coalesce("_full", F.lit(1)), "_rest": F.coalesce("_rest", F.lit(0))})
    before = F.sum("size").over(Window.partitionBy("_s").orderBy(rank, "_b").rowsBetween(Window.unboundedPreceding, -1))
    plan = plan.withColumn("_left", F.col("_rest") - F.coalesce(before, F.lit(0)))
    plan = written(plan.select("_s", "_b", "_full", F.when(F.col("_left") > 0, F.least("_left", "size")).otherwise(0).alias("_left"), ((F.col("_left") >= F.col("size")) & (F.col("_rest") > 0)).alias("_all")), "plan")
    d = d.join(plan, ["_s", "_b"])
    # of a block at the border, documents in an order of their own while the budget lasts
    border = (F.col("_left") > 0) & ~F.col("_all")
    order = [draw(F.lit(seed), F.lit("d"), F.col("_full"), id_), F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")))]
    at_border = d.where(border).withColumn("_sum", F.sum("n_tokens").over(Window.partitionBy("_s", "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    at_border = at_border.withColumn("_copies", F.col("_full") + (F.col("_sum") <= F.col("_left")).cast("int")).drop("_sum")
    rest = d.where(~border).withColumn("_copies", F.col("_full") + F.col("_all").cast("int"))
    out = rest.unionByName(at_border).where("_copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), (F.col("_copies") - 1).cast("int"))))
    return out.withColumn("block_rank", draw(F.lit(seed), F.col("epoch"), F.col("_s"), F.col("_b"))).select(*names, "n_tokens", "epoch", "block_rank")
