"""Hard negatives by angular triangle filtering.

Rows and anchors are integer vectors. Each has its angles to REFERENCES directions and its norm stored beside it. Rows are dealt by range of label, nearest direction and angle to it, and cut into windows of
WINDOW rows that lie close together; a window stores the least and largest angle to each direction and the least and largest norm. By the triangle inequality of angles, an anchor at angle a
to a direction is at |a - w| to a + w (and at most 2 pi - a - w) from a row at angle w, so cosines lie in an interval, and norms make of it bounds of the score, widened by more than what
rounding can do. Only windows whose bounds overlap what an anchor still looks for are scored, as integers, by matrix products that are exact.

Anchors are a hundredth of the rows. Blocks of anchors meet blocks of rows by an equi-join on the rows' block: first blocks that may hold the anchor's label, for the positives, then all blocks for the
negatives between the positives' bounds. Each pair of blocks returns the best few of an anchor; a window by anchor merges them. No task holds more than a pair of blocks.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillflow.llm.common import dropped, shuffle_partitions, written

#: Every so many ids is an anchor; ids that are this multiple get the next of so many labels.
ANCHOR, MOVED, LABELS = 100, 7, 10
POSITIVES, NEGATIVES = 5, 5
#: Negatives score from this share, in percent, of the positive's score up to 100.
LEAST = 80
SCALE = 256
REFERENCES, WINDOW, BLOCK, ANCHORS = 16, 256, 8192, 1024
#: What rounding of angles and cosines can move a cosine by, at most.
SLACK = 1e-6

BLOCKS = "block long, labels_from long, labels_to long, n int, step int, ids binary, labels binary, vectors binary, bounds binary"
BLOCK_NAMES = [c.split()[0] for c in BLOCKS.split(", ")]


def members(embeddings: DataFrame) -> DataFrame:
    """vec_id, label (moved), v: the integer components of the rows that take part."""
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))  # NaN is above infinity
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % MOVED == 0, (label + 1) % LABELS).otherwise(label)
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite
    return embeddings.select("vec_id", "label", "embedding").where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), v.alias("v"))


def directions(rows: DataFrame) -> np.ndarray:
    """REFERENCES unit vectors: rows of the least hashes of id and vector, as a bounded sample that only decides how well bounds prune."""
    found = [r.v for r in rows.where(F.exists("v", lambda x: x != 0)).orderBy(F.xxhash64("vec_id", "v"), "vec_id").select("v").limit(REFERENCES).collect()]
    dims = max(map(len, found), default=1)
    out = np.zeros((max(1, len(found)), dims))
    for i, x in enumerate(found):
        out[i, : len(x)] = x
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    out[norm[:, 0] == 0, 0] = 1
    return out / np.where(norm > 0, norm, 1)


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of integers as rows; shorter ones end in zeros."""
    n = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(n), int(n.max(initial=0))), np.int64)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def fitted(x: np.ndarray, dims: int) -> np.ndarray:
    """x with so many columns, more of them zeros."""
    return x if x.shape[1] == dims else np.hstack([x, np.zeros((len(x), dims - x.shape[1]), x.dtype)]) if x.shape[1] < dims else x[:, :dims]


def angles(v: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and angles to the directions; a vector of zeros has angle 0, which its norm makes no matter. Vectors may have more components than directions, and fewer."""
    dims = max(v.shape[1], unit.shape[1])
    x = fitted(v, dims).astype(np.float64)
    norm = np.sqrt((x * x).sum(1))
    cos = x @ fitted(unit, dims).T / np.where(norm > 0, norm, 1)[:, None]
    return norm, np.where(norm[:, None] > 0, np.arccos(np.clip(cos, -1, 1)), 0.0)


def packed(x: np.ndarray) -> bytes:
    """Integers in two bytes each if they fit, else in eight; the first byte says which."""
    small = not x.size or np.abs(x).max() < 1 << 15
    return (b"2" if small else b"8") + np.ascontiguousarray(x, "<i2" if small else "<i8").tobytes()


def unpacked(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw[1:], f"<i{raw[:1].decode()}").reshape(rows, -1) if rows else np.zeros((0, 0), np.int64)


def _dealt(unit: np.ndarray):
    """vec_id, label, v, the nearest direction and the angle to it."""

    def run(batches):
        for rb in batches:
            if rb.num_rows:
                angle = angles(matrix(rb.column("v")), unit)[1]
                near = angle.argmin(1)
                yield rb.append_column("near", pa.array(near.astype(np.int32))).append_column("angle", pa.array(angle[np.arange(len(near)), near]))

    return run


def _blocks(unit: np.ndarray, size: int, window: int):
    """The rows of a task, in order, as blocks of up to size rows with bounds of each window: least and largest norm, then least and largest angles."""

    def made(rb: pa.RecordBatch, k: int):
        v, ids, labels = matrix(rb.column("v")), rb.column("vec_id").to_numpy(), rb.column("label").to_numpy()
        norm, angle = angles(v, unit)
        at = np.arange(0, len(v), window)
        low, high = (np.hstack([f.reduceat(norm, at)[:, None], f.reduceat(angle, at)]) for f in (np.minimum, np.maximum))
        part = rb.column("part")[0].as_py()
        cells = [(part << 32) + k, int(labels.min()), int(labels.max()), len(v), window, ids.astype("<i8").tobytes(), labels.astype("<i8").tobytes(), packed(v), np.hstack([low, high]).tobytes()]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds, strict=True)], names=BLOCK_NAMES)

    def run(batches):
        held, n, k = [], 0, 0
        for rb in batches:
            while rb.num_rows:
                take = rb.slice(0, size - n)
                held.append(take)
                n, rb = n + take.num_rows, rb.slice(take.num_rows)
                if n == size:
                    yield made(pa.Table.from_batches(held).combine_chunks().to_batches()[0], k)
                    held, n, k = [], 0, k + 1
        if held:
            yield made(pa.Table.from_batches(held).combine_chunks().to_batches()[0], k)

    return run


def blocks_of(rows: DataFrame, unit: np.ndarray, size: int, window: int, name: str) -> DataFrame:
    """Blocks of rows (vec_id, label, v), near ones together: one a partition, of about size rows (rows with windows: fewer, where these make more tasks), two where a partition has more than twice that."""
    dealt = rows.mapInArrow(_dealt(unit), "vec_id long, label long, v array<long>, near int, angle double")
    by = ["label", "near", "angle", "vec_id"]
    n, most = rows.count(), shuffle_partitions(rows.sparkSession)
    parts = max(1, -(-n // size), min(most, -(-n // (size // 4))) if window > 1 else 1)
    ranged = dealt.repartitionByRange(max(parts, most), *by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id().cast("long"))
    return written(ranged.coalesce(parts).mapInArrow(_blocks(unit, 2 * size, window), BLOCKS), name)


class Block:
    """A block of rows or anchors, unpacked."""

    def __init__(self, row: dict, side: str):
        n = row[f"{side}n"]
        self.ids, self.labels = np.frombuffer(row[f"{side}ids"], "<i8"), np.frombuffer(row[f"{side}labels"], "<i8")
        self.v = unpacked(row[f"{side}vectors"], n)
        bounds = np.frombuffer(row[f"{side}bounds"])
        self.step = row[f"{side}step"]  # rows of a window
        self.bounds = bounds.reshape(-(-n // self.step), 2, -1)
        self.most = int(np.abs(self.v).max(initial=0))


def score_bounds(anchors: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score of each anchor with the rows of each window. anchors: norm and angles; windows: the least and largest of both."""
    a, low, high = anchors[:, None, 1:], windows[None, :, 0, 1:], windows[None, :, 1, 1:]
    near = np.maximum(np.maximum(a - high, low - a), 0).max(2)
    far = np.minimum(np.minimum(a + high, 2 * np.pi - a - low), np.pi).min(2)
    norm, n0, n1 = anchors[:, :1], windows[None, :, 0, 0], windows[None, :, 1, 0]
    c0, c1 = np.cos(np.maximum(far, near)) - SLACK, np.cos(near) + SLACK
    return np.floor(norm * c0 * np.where(c0 < 0, n1, n0)) - 1, np.ceil(norm * c1 * np.where(c1 > 0, n1, n0)) + 1


def scores(a: np.ndarray, b: np.ndarray, most: tuple[int, int]) -> np.ndarray:
    """Integer inner products; in floats where these hold them exactly."""
    dims = min(a.shape[1], b.shape[1])
    size = dims * most[0] * most[1]
    kind = np.float32 if size < 1 << 24 else np.float64 if size < 1 << 53 else np.int64 if size < 1 << 63 else object
    return (a[:, :dims].astype(kind) @ b[:, :dims].astype(kind).T).astype(np.int64)


def best(who: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Of each who the first k by falling score, then id: where they are."""
    order = np.lexsort((ids, -score, who))
    who = who[order]
    start = np.concatenate([[0], np.flatnonzero(who[1:] != who[:-1]) + 1]) if len(who) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(who)))
    return order[np.arange(len(who)) - np.repeat(start, size) < k]


def block_pairs(x: Block, y: Block, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, ...]:
    """For each wish of an anchor of x, low to high (an array of anchors by wishes), its first k rows of y whose score is between, of its label or of others: anchor, wish, id, score.

    Windows go by falling upper bound. What a wish has found so far raises its low; a window that no wish of an anchor can use is not scored for it.
    """
    low = low.copy()
    lo, hi = score_bounds(x.bounds[:, 0], y.bounds)
    wishes = low.shape[1]
    found = [np.zeros(0, np.int64)] * 4
    for w in np.argsort(-hi.max(0, initial=0)):
        rows = slice(w * y.step, (w + 1) * y.step)
        labels = y.labels[rows]
        some = ((hi[:, w, None] >= low) & (lo[:, w, None] <= high)).any(1)
        one = labels.min() == labels.max()
        if same:
            some &= (x.labels >= labels.min()) & (x.labels <= labels.max())
        elif one:
            some &= x.labels != labels[0]
        own = np.flatnonzero(some)
        if not len(own):
            continue
        s = scores(x.v[own], y.v[rows], (x.most, y.most))
        label = x.labels[own, None] == labels
        ok = (label & (x.ids[own, None] != y.ids[rows]) if same else ~label) & (s >= low[own].min(1)[:, None]) & (s <= high[own].max(1)[:, None])
        i, j = np.nonzero(ok)
        value, who, ids = s[i, j], own[i], y.ids[rows][j]
        parts = []
        for t in range(wishes):
            fits = np.flatnonzero((value >= low[who, t]) & (value <= high[who, t]))
            parts.append((who[fits], np.full(len(fits), t), ids[fits], value[fits]))
        found = [np.concatenate(c) for c in zip(found, *parts, strict=True)]
        keep = best(found[0] * wishes + found[1], found[3], found[2], k)
        found = [c[keep] for c in found]
        key = found[0] * wishes + found[1]
        full, at, count = np.unique(key, return_index=True, return_counts=True)
        last = (at + count - 1)[count == k]  # sorted by key, then falling score
        low.ravel()[full[count == k]] = np.maximum(low.ravel()[full[count == k]], found[3][last])
    return tuple(found)


def _met(same: bool, k: int):
    """Partial results (anchor: block and place, wish, id, score) of joined pairs of blocks."""

    def run(batches):
        for rb in batches:
            for row in rb.to_pylist():
                x, y = Block(row, "a_"), Block(row, "r_")
                low, high = (np.frombuffer(row[c], "<i8").reshape(len(x.ids), -1) for c in ("low", "high"))
                who, wish, ids, score = block_pairs(x, y, low, high, same, k)
                if len(who):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), row["a_block"], np.int64)), pa.array(who.astype(np.int32)), pa.array(wish.astype(np.int32)), pa.array(ids), pa.array(score)], names=["block", "place", "wish", "id", "score"])

    return run


@contextmanager
def few_a_batch(spark: SparkSession, rows: int):
    """While it lasts, Arrow batches have so many rows at most: here a row is a pair of blocks."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def met(anchors: DataFrame, rows: DataFrame, where, same: bool, k: int, name: str) -> DataFrame:
    """The first k of each wish over all blocks of rows: block, place, wish, id, score, rank (from 1). where: which pairs of blocks meet."""
    spark = rows.sparkSession
    a, r = (x.select(*[F.col(c).alias(p + c if c in BLOCK_NAMES else c) for c in x.columns]) for x, p in ((anchors, "a_"), (rows, "r_")))
    heads = lambda x, p: x.select(*[p + c for c in ("block", "labels_from", "labels_to")])
    to = heads(r, "r_").join(heads(a, "a_"), where).select("r_block", "a_block")  # numbers of blocks only
    pairs = to.join(a, "a_block").join(r, "r_block")
    with few_a_batch(spark, 8):
        part = written(pairs.mapInArrow(_met(same, k), "block long, place int, wish int, id long, score long"), f"{name}-parts")
    rank = F.row_number().over(Window.partitionBy("block", "place", "wish").orderBy(F.desc("score"), "id"))
    out = written(part.withColumn("rank", rank).where(F.col("rank") <= k), name)
    dropped(part)
    return out


def _wishes(name: str):
    """Anchor blocks with the wishes that their positives make, from score * LEAST / 100 rounded up to the score; where there is no positive, a wish that nothing fits."""

    def run(batches):
        for rb in batches:
            for row in rb.to_pylist():
                n = row["n"]
                low, high = np.full((n, POSITIVES), -FLOOR, "<i8"), np.full((n, POSITIVES), FLOOR, "<i8")
                for place, rank, score in (x.values() for x in row["positives"]):
                    low[place, rank - 1], high[place, rank - 1] = -(-LEAST * score // 100), score
                yield pa.RecordBatch.from_pylist([{c: row[c] for c in BLOCK_NAMES} | {"low": low.tobytes(), "high": high.tobytes()}], schema=SCHEMA)

    return run


SCHEMA = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in BLOCKS.split(", "))] + [("low", pa.binary()), ("high", pa.binary())])
FLOOR = -(2**62)


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, as the module says.

    Rows without vec_id, label or vector, or with a component that is null or not finite, take no part; shorter vectors count as ending in zeros, and vectors of zeros score 0. Rows that share a
    vec_id are rows of their own, none of which is another's positive; as anchors each has its result. Ties go by vec_id; equal rows both count. Scores must fit 64 bits. An anchor without positives, and a positive
    whose bounds no row fits, has no rows; an empty table has none. Columns other than vec_id, label and embedding are not read.
    """
    spark: SparkSession = embeddings.sparkSession
    rows = written(members(embeddings), "vectors")
    unit = directions(rows)
    blocks = blocks_of(rows, unit, BLOCK, WINDOW, "blocks")
    anchors = blocks_of(rows.where(F.col("vec_id") % ANCHOR == 0), unit, ANCHORS, 1, "anchors")
    # one wish without bounds: the best of the anchor's label
    no_bound = lambda value: F.unhex(F.expr(f"repeat('{value.to_bytes(8, 'little', signed=True).hex()}', n)"))
    every = anchors.withColumns({"low": no_bound(FLOOR), "high": no_bound(-FLOOR)})
    near = (F.col("a_labels_from") <= F.col("r_labels_to")) & (F.col("r_labels_from") <= F.col("a_labels_to"))
    positives = met(every, blocks, near, True, POSITIVES, "positives")
    of = positives.groupBy("block").agg(F.collect_list(F.struct("place", "rank", "score")).alias("positives"))
    with few_a_batch(spark, 8):
        asked = written(anchors.join(of, "block").mapInArrow(_wishes("positives"), f"{BLOCKS}, low binary, high binary"), "asked")
    other = (F.col("a_labels_from") != F.col("r_labels_from")) | (F.col("a_labels_to") != F.col("r_labels_to")) | (F.col("a_labels_from") != F.col("a_labels_to"))
    negatives = met(asked, blocks, other, False, NEGATIVES, "negatives")
    names = written(anchors.mapInArrow(_ids, "block long, place int, anchor_id long"), "anchor-ids")
    pos = positives.select("block", "place", (F.col("rank") - 1).alias("wish"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    neg = negatives.select("block", "place", "wish", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    dropped(rows, asked)
    return neg.join(pos, ["block", "place", "wish"]).join(names, ["block", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _ids(batches):
    for rb in batches:
        for row in rb.select(["block", "ids"]).to_pylist():
            ids = np.frombuffer(row["ids"], "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), row["block"], np.int64)), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids.astype(np.int64))], names=["block", "place", "anchor_id"])
