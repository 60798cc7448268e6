"""Exact repeats of fixed-length windows over all documents: of bytes (suffix sorting) and of words (super-k-mers).

Consecutive windows of a document that share a minimiser (the least hash of the grams inside the window) form a segment. Equal windows have equal
minimisers at equal places, so equal windows lie in segments of one minimiser. Three kinds of segments:

* A segment equal to an earlier segment is repeated as a whole. Segments are compared by minimiser and 64-bit content hash, and the first of them found by a
  window function over (minimiser, content); what repeats inside one batch is settled before the shuffle, so a large group of copies
  sends one row a batch.
* The first of equal segments, where its minimiser has other segments too: its bytes or words travel as one packed string to the bucket of
  the minimiser, where sorting finds which of its windows are equal to earlier ones.
* Other segments are unique and go no further.

A minimiser that very many documents have in different surroundings (a common line) is found on a hash sample of the documents; its segments are
cut into single windows, each with its own key, before anything is shuffled. The sample only decides how rows are dealt, never a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillflow.llm.common import (
    bytes_of,
    doc_key,
    dropped,
    mixed,
    shuffle_partitions,
    signed,
    small_batches,
    spread,
    swept,
    text_batches,
    whole_text,
    windows_hash,
    word_hashes,
    word_spans,
    words_array,
    written,
)

#: A minimiser with more than this share of the sampled segments, or so many segments by estimate, is hot; at most HOT_MOST of them.
HOT_SHARE, HOT_ROWS, HOT_MOST, SAMPLE = 1 / 2000, 50_000, 1 << 16, 64
PLACE = np.uint64((1 << 24) - 1)
#: Values that one step of sliding_argmin takes; a place in them has to fit in PLACE.
BLOCK = 1 << 22


@dataclass(frozen=True)
class Windows:
    """What the windows are made of: their length and the minimiser's gram, in items; whether a repeat in the same document counts."""

    length: int
    gram: int
    words: bool
    same_document: bool
    batch_bytes: int


BYTES = Windows(100, 24, False, True, 3 << 20)
WORDS = Windows(50, 8, True, False, 3 << 20)


# --------------------------------------------------------------------------- segments


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value (by its high 40 bits; the first of equal ones) of each run of width values.

    Longer input is done by blocks that overlap by width - 1, so that each run lies in one block whole.
    """
    most = max(BLOCK, width)
    if len(values) > most:
        step = most - width + 1
        return np.concatenate([sliding_argmin(values[a : a + most], width) + a for a in range(0, len(values) - width + 1, step)])
    key = (values & ~PLACE) | np.arange(len(values), dtype=np.uint64)
    size = 1
    while size * 2 <= width:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if rest := width - size:
        key = np.minimum(key[:-rest], key[rest:])
    return (key & PLACE).astype(np.int64)


def byte_grams(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of size bytes (a multiple of 8)."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    data = np.ascontiguousarray(data)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, size, 8):
            lane = np.ndarray((n,), "<u8", data, k, (1,))
            out += (lane ^ (lane >> np.uint64(31))) * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) % 2**64 | 1)
    return mixed(out)


@dataclass
class Batch:
    """A batch of documents as items: bytes, or words with their spans and hashes."""

    data: np.ndarray
    offsets: np.ndarray  # of the documents, in items
    starts: np.ndarray | None = None
    stops: np.ndarray | None = None
    hashes: np.ndarray | None = None


def batch_of(column: pa.Array, w: Windows, hashes: bool = True) -> Batch:
    data, offsets = bytes_of(column)
    if not w.words:
        return Batch(data, offsets)
    starts, stops, offsets = word_spans(data, offsets)
    return Batch(data, offsets, starts, stops, word_hashes(data, starts, stops) if hashes else None)


def segments(b: Batch, w: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First item, number of windows, document and minimiser of each segment of the batch."""
    lengths = np.diff(b.offsets)
    counts = np.maximum(lengths - w.length + 1, 0)
    doc, place = spread(counts)
    if not len(doc):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    grams = windows_hash(b.hashes, w.gram) if w.words else byte_grams(b.data, w.gram)
    first = b.offsets[:-1][doc] + place
    least = sliding_argmin(grams, w.length - w.gram + 1)[first]
    new = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])]))
    return first[new], np.diff(np.append(new, len(doc))), doc[new], grams[least[new]]


def contents_hash(b: Batch, w: Windows, first: np.ndarray, items: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of items."""
    raw, size = (memoryview(np.ascontiguousarray(b.hashes).view(np.uint8)), 8) if w.words else (memoryview(np.ascontiguousarray(b.data)), 1)
    f = xxhash.xxh3_64_intdigest
    return np.fromiter((f(raw[a:z]) for a, z in zip((first * size).tolist(), ((first + items) * size).tolist(), strict=True)), np.uint64, len(first))


def text_marks(column: pa.Array) -> np.ndarray:
    """31 bits of each text's hash, shifted to stand above a place: rows that share a doc_id but not the text stay apart."""
    f = xxhash.xxh3_64_intdigest
    return np.array([(f(x or "") & 0x7FFFFFFF) << 32 for x in column.to_pylist()], np.int64)


def single_windows(first: np.ndarray, n: np.ndarray, doc: np.ndarray, h: np.ndarray, hot: np.ndarray, b: Batch, w: Windows):
    """Cuts segments of hot minimisers into single windows, whose key is their own content."""
    is_hot = np.isin(h, hot)
    if not is_hot.any():
        return first, n, doc, h
    group, k = spread(n[is_hot])
    at = first[is_hot][group] + k
    own = contents_hash(b, w, at, np.full(len(at), w.length))
    cold = ~is_hot
    return (
        np.concatenate([first[cold], at]),
        np.concatenate([n[cold], np.ones(len(at), np.int64)]),
        np.concatenate([doc[cold], doc[is_hot][group]]),
        np.concatenate([h[cold], mixed(own, 77)]),
    )


def merged(doc: np.ndarray, pos: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adjacent or overlapping runs of windows of a document as one run each."""
    if not len(doc):
        return doc, pos, n
    order = np.lexsort((pos, doc))
    doc, pos, end = doc[order], pos[order], (pos + n)[order]
    # a window lies in one run, so ends grow within a text; pos holds the text's mark above, so that texts do not touch
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (pos[1:] > end[:-1])])
    at = np.flatnonzero(new)
    return doc[at], pos[at], np.maximum.reduceat(end, at) - pos[at]


SEGMENTS = "h long, c long, doc long, pos long, n int"
FOUND = "repeated boolean, h long, doc long, pos long, n int"


def _segment_rows(w: Windows, hot: np.ndarray) -> Callable:
    def run(batches):
        for rb in text_batches(batches, w.batch_bytes):
            b = batch_of(rb.column("text"), w)
            first, n, doc, h = segments(b, w)
            if not len(first):
                continue
            first, n, doc, h = single_windows(first, n, doc, h, hot, b, w)
            c = contents_hash(b, w, first, n + w.length - 1)
            ids = rb.column("doc").to_numpy()[doc]
            pos = text_marks(rb.column("text"))[doc] + first - b.offsets[:-1][doc]
            # what repeats inside the batch
            order = np.lexsort((pos, ids, c, h))
            same = np.concatenate([[False], (h[order][1:] == h[order][:-1]) & (c[order][1:] == c[order][:-1])])
            head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
            if w.same_document:
                later = same
                # rows that repeat doc_id and text have one place: neither is earlier
                later &= (ids[order] != ids[order][head]) | (pos[order] != pos[order][head])
            else:
                later = same & (ids[order] != ids[order][head])
            go, done = order[~later], order[later]
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(h[go])), pa.array(signed(c[go])), pa.array(ids[go]), pa.array(pos[go]), pa.array(n[go].astype(np.int32))], names=["h", "c", "doc", "pos", "n"]
            )
            d, p, k = merged(ids[done], pos[done], n[done])
            if len(d):  # a count below 0: settled
                key = signed(mixed(d.view(np.uint64) ^ p.view(np.uint64), 5))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(key), pa.array(d), pa.array(p), pa.array((-k).astype(np.int32))], names=["h", "c", "doc", "pos", "n"])

    return run


def hot_minimisers(docs: DataFrame, w: Windows) -> np.ndarray:
    """Minimisers to deal out by single windows; at most HOT_MOST."""

    def run(batches):
        for rb in text_batches(batches, w.batch_bytes):
            _, _, _, h = segments(batch_of(rb.column("text"), w), w)
            values, counts = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(values)), pa.array(counts)], names=["h", "n"])

    some = docs.where(F.pmod(F.xxhash64("doc"), F.lit(SAMPLE)) == 0)
    counts = written(some.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "minimisers")
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(16, min(total * HOT_SHARE, HOT_ROWS / SAMPLE))
    rows = counts.where(F.col("n") > least).orderBy(F.desc("n"), "h").limit(HOT_MOST).collect()
    dropped(counts)
    return np.sort(np.array([r.h for r in rows], np.int64).view(np.uint64))


# --------------------------------------------------------------------------- sorting in a bucket


def eight(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as one big-endian number, whose order is that of the bytes."""
    return np.ndarray((max(len(data) - 7, 0),), ">u8", data, 0, (1,))[at].astype(np.uint64)


def multikey_quicksort(data: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the strings at the given places of each group by their first depth bytes, eight at a time.

    All groups are split side by side: each round takes a pivot of every open group and parts it into less, equal (which goes on with the next
    eight bytes) and greater. Returns the places and the classes that are equal up to depth; classes of one are dropped.
    """
    at, group = at[np.argsort(group, kind="stable")], np.sort(group, kind="stable")
    deep = np.zeros(len(at), np.int64)
    done_at, done_class, classes = [], [], 0
    while len(at):
        new = np.concatenate([[True], group[1:] != group[:-1]])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(at)))
        many = np.repeat(size > 1, size)
        finished = many & (deep >= depth)
        if finished.any():
            done_at.append(at[finished])
            done_class.append(group[finished] + classes)
        keep = many & ~finished
        classes += int(group[-1]) + 1
        at, group, deep = at[keep], group[keep], deep[keep]
        if not len(at):
            break
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(begin, len(at)))
        key = eight(data, at + deep)
        three = np.sort(np.stack([key[begin], key[begin + size // 2], key[begin + size - 1]]), axis=0)
        pivot = np.repeat(three[1], size)
        side = (key > pivot).astype(np.int64) - (key < pivot) + 1
        label = np.repeat(np.arange(len(begin)), size) * 3 + side
        order = np.argsort(label, kind="stable")
        at, label, deep = at[order], label[order], (deep + 8 * (side == 1))[order]
        group = np.cumsum(np.concatenate([[False], label[1:] != label[:-1]]))
    if not done_at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(done_at), np.concatenate(done_class)


def blind_tries(data: np.ndarray, at: np.ndarray, group: np.ndarray, length: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Orders the strings of each group, equal up to depth, by a blind trie each; returns places and leaf of those that share a leaf.

    A node holds the number of bytes that all its strings share, found by comparing each with the node's first, and branches on the one byte behind them; bytes
    between branches are never compared again. The nodes of one level of all tries are made side by side.
    """
    out_at, out_leaf, leaves = [], [], 0
    order = np.argsort(group, kind="stable")
    at, group = at[order], group[order]
    while len(at):
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(begin, len(at)))
        keep = np.repeat(size > 1, size)
        at = at[keep]
        size = size[size > 1]
        if not len(at):
            break
        begin = np.cumsum(size) - size
        node = np.repeat(np.arange(len(size)), size)
        lead = at[begin][node]
        shared = np.full(len(at), length, np.int64)
        open_ = np.arange(len(at))
        for k in range(depth, length, 8):
            k = min(k, length - 8)
            x = eight(data, at[open_] + k) ^ eight(data, lead[open_] + k)
            differs = x != 0
            if differs.any():
                y = x[differs]
                high = np.zeros(len(y), np.int64)
                for s in (32, 16, 8):
                    big = y >> np.uint64(s) != 0
                    high += s * big
                    y = np.where(big, y >> np.uint64(s), y)
                shared[open_[differs]] = np.minimum(length, k + 7 - high // 8)
                open_ = open_[~differs]
        skip = np.minimum.reduceat(shared, begin)
        leaf = (skip >= length)[node]
        if leaf.any():
            out_at.append(at[leaf])
            out_leaf.append(node[leaf] + leaves)
        leaves += len(size)
        at, node = at[~leaf], node[~leaf]
        label = node * 256 + data[at + skip[node]]
        order = np.argsort(label, kind="stable")
        at, group = at[order], label[order]
        depth = 0 if not len(at) else min(depth, length - 8)
    if not out_at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_at), np.concatenate(out_leaf)


SHALLOW = 32


def equal_bytes(data: np.ndarray, at: np.ndarray, length: int, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and class of the strings of the given length that equal another one of their group: deep-shallow sorting."""
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    shallow = min(SHALLOW, length // 8 * 8)
    at, group = multikey_quicksort(data, at, np.zeros(len(at), np.int64) if group is None else group, shallow)
    return blind_tries(data, at, group, length, shallow)


def equal_words(codes: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and class of the runs of length word codes, by sorting ranks of runs of doubled length."""
    rank, size = codes, 1
    while size * 2 <= length:
        rank = np.unique(rank[:-size] << 32 | rank[size:], return_inverse=True)[1].reshape(-1)
        size *= 2
    if rest := length - size:
        rank = np.unique(rank[:-rest] << 32 | rank[rest:], return_inverse=True)[1].reshape(-1)
    return at, rank[at]


def repeated_windows(packed: list[bytes], h: np.ndarray, n: np.ndarray, doc: np.ndarray, pos: np.ndarray, w: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, pos and count of the runs of windows, among the given segments, that equal an earlier window."""
    seg, k = spread(n)
    if w.words:
        text = pa.array(packed, pa.large_binary())
        data, off = np.frombuffer(text.buffers()[2], np.uint8), np.frombuffer(text.buffers()[1], np.int64, len(text) + 1)
        starts, stops, item = word_spans(data, off, data_space())
        codes = words_array(data, starts, stops).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        at, cls = equal_words(codes, item[:-1][seg] + k, w.length)
        who = np.arange(len(seg))
    else:
        sizes = np.array([len(x) for x in packed])
        data = np.frombuffer(b"".join(packed), np.uint8)
        where = (np.cumsum(sizes) - sizes)[seg] + k
        at, cls = equal_bytes(data, where, w.length, np.unique(h, return_inverse=True)[1].reshape(-1)[seg])
        who = np.searchsorted(where, at)
    d, p = doc[seg][who], (pos[seg] + k)[who]
    order = np.lexsort((p, d, cls))
    head = np.maximum.accumulate(np.where(np.concatenate([[True], cls[order][1:] != cls[order][:-1]]), np.arange(len(order)), 0)) if len(order) else order
    d, p = d[order], p[order]
    late = (d != d[head]) | ((p != p[head]) if w.same_document else False)
    return merged(d[late], p[late], np.ones(int(late.sum()), np.int64))


def data_space() -> np.ndarray:
    """The separator of packed words: one space, and nothing else."""
    t = np.zeros(256, bool)
    t[0x20] = True
    return t


def _sorted_buckets(w: Windows, most: int = 4 << 20) -> Callable:
    """Streams rows in order of h; a bucket's rows are sorted together, many small buckets at a time."""

    def settle(held):
        t = pa.Table.from_batches(held)
        d, p, k = repeated_windows(t.column("data").to_pylist(), t.column("h").to_numpy(), t.column("n").to_numpy().astype(np.int64), t.column("doc").to_numpy(), t.column("pos").to_numpy(), w)
        zero = np.zeros(len(d), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(d), bool)), pa.array(zero), pa.array(d), pa.array(p), pa.array(k.astype(np.int32))], names=["repeated", "h", "doc", "pos", "n"])

    def run(batches):
        held, size = [], 0
        for rb in batches:
            if not rb.num_rows:
                continue
            if size >= most:  # cut where h changes
                h = rb.column("h").to_numpy()
                last = held[-1].column("h")[-1].as_py()
                cut = int(np.searchsorted(h != last, True)) if h[0] == last else 0
                if h[0] == last and not (h != last).any():
                    cut = rb.num_rows
                if cut < rb.num_rows:
                    if cut:
                        held.append(rb.slice(0, cut))
                    yield settle(held)
                    held, size, rb = [], 0, rb.slice(cut)
            held.append(rb)
            size += rb.nbytes
        if held:
            yield settle(held)

    return run


def _cut(w: Windows) -> Callable:
    """The packed string of each wanted segment of a document."""

    def run(batches):
        for rb in text_batches(batches, w.batch_bytes):
            b = batch_of(rb.column("text"), w, hashes=False)
            marks = text_marks(rb.column("text"))
            lists = rb.column("want")
            row = np.repeat(np.arange(rb.num_rows), lists.value_lengths().to_numpy())
            want = lists.flatten()
            h, pos, n = (want.field(x).to_numpy() for x in ("h", "pos", "n"))
            own = (pos >> 32) << 32 == marks[row]
            row, h, pos, n = row[own], h[own], pos[own], n[own].astype(np.int64)
            first = b.offsets[:-1][row] + (pos & 0xFFFFFFFF)
            last = first + n + w.length - 1
            raw = b.data.tobytes()
            if w.words:
                data = [b" ".join(raw[x:y] for x, y in zip(b.starts[i:j].tolist(), b.stops[i:j].tolist(), strict=True)) for i, j in zip(first.tolist(), last.tolist(), strict=True)]
            else:
                data = [raw[i:j] for i, j in zip(first.tolist(), last.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), pa.array(rb.column("doc").to_numpy()[row]), pa.array(pos), pa.array(n.astype(np.int32)), pa.array(data, pa.binary())], names=["h", "doc", "pos", "n", "data"]
            )

    return run


# --------------------------------------------------------------------------- the job


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(doc_key().alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))


def repeated_spans(docs: DataFrame, w: Windows) -> DataFrame:
    """doc, pos and n: runs of n windows that start at pos (the text's mark above, the item below) and equal earlier windows."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = keyed(docs).select("doc", "text")
    hot = hot_minimisers(texts, w)
    rows = texts.mapInArrow(_segment_rows(w, hot), SEGMENTS)
    equal = Window.partitionBy("h", "c").orderBy("doc", "pos")
    lead = F.first(F.struct("doc", "pos") if w.same_document else F.struct("doc")).over(equal)
    me = F.struct("doc", "pos") if w.same_document else F.struct("doc")
    rows = rows.withColumn("later", lead != me)
    bucket = Window.partitionBy("h")
    rows = rows.withColumn("mixed", F.min("c").over(bucket) != F.max("c").over(bucket))
    rows = rows.where("n < 0 or later or mixed").select((F.col("later") | (F.col("n") < 0)).alias("repeated"), "h", "doc", "pos", F.abs("n").cast("int").alias("n"))
    found = written(rows, "segments")
    swept(spark)
    want = found.where("not repeated").groupBy("doc").agg(F.collect_list(F.struct("h", "pos", "n")).alias("want"))
    packed = texts.join(want, "doc").select("doc", "text", "want").mapInArrow(_cut(w), "h long, doc long, pos long, n int, data binary")
    deal = packed.repartition(shuffle_partitions(spark), "h").sortWithinPartitions("h")
    inside = written(deal.mapInArrow(_sorted_buckets(w), FOUND), "windows")
    swept(spark)
    return found.where("repeated").unionByName(inside).select("doc", "pos", "n")


def with_spans(docs: DataFrame, w: Windows) -> DataFrame:
    """doc_id, text and spans (a list of pos and n, or null) of each row of docs."""
    spans = repeated_spans(docs, w).groupBy("doc").agg(F.collect_list(F.struct("pos", "n")).alias("spans"))
    return keyed(docs).join(spans, "doc", "left").select("doc_id", "text", "spans")


def covered(rb: pa.RecordBatch, b: Batch, w: Windows) -> np.ndarray:
    """Which items of a batch of with_spans() lie in a repeated window."""
    lists = rb.column("spans")
    row = np.repeat(np.arange(rb.num_rows), lists.value_lengths().fill_null(0).to_numpy())
    spans = lists.flatten()
    pos, n = (spans.field(x).to_numpy() for x in ("pos", "n"))
    own = (pos >> 32) << 32 == text_marks(rb.column("text"))[row]
    row, pos, n = row[own], pos[own], n[own].astype(np.int64)
    first = b.offsets[:-1][row] + (pos & 0xFFFFFFFF)
    steps = np.zeros(int(b.offsets[-1]) + 1, np.int64)
    np.add.at(steps, first, 1)
    np.add.at(steps, first + n + w.length - 1, -1)
    return np.cumsum(steps[:-1]) > 0


def per_document(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _digest(flat: np.ndarray, offsets: np.ndarray) -> list[str]:
    raw = memoryview(np.ascontiguousarray(flat))
    return [hashlib.sha256(raw[a:z]).hexdigest() for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def substring_dedup(docs: DataFrame, w: Windows = BYTES) -> DataFrame:
    """Removes each byte covered by a window of w.length bytes that also starts earlier; one row per document.

    Null texts are empty; texts shorter than a window stay whole. Earlier: in a document of smaller doc_id (null first), or in the same document.
    Rows that repeat doc_id and text have the same places, so neither is earlier and both get the same result; rows that share only the doc_id are ordered by a
    hash of their texts. Columns other than doc_id and text are not read.
    """

    def run(batches):
        for rb in text_batches(batches, w.batch_bytes):
            b = batch_of(rb.column("text"), w)
            gone = covered(rb, b, w)
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            at = b.offsets[:-1][np.diff(b.offsets) > 0]
            begins[at] = gone[at]
            n_gone = per_document(gone, b.offsets)
            size = np.diff(b.offsets)
            off = np.concatenate([[0], np.cumsum(size - n_gone)])
            yield pa.RecordBatch.from_arrays(
                [rb.column("doc_id"), pa.array(size), pa.array(n_gone), pa.array(per_document(begins, b.offsets)), pa.array(_digest(b.data[~gone], off))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return with_spans(docs, w).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def joined_words(b: Batch, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each document joined by one space: all bytes, and len + 1 offsets."""
    starts, stops = b.starts[keep], b.stops[keep]
    lengths = stops - starts + 1
    off = np.concatenate([[0], np.cumsum(lengths)])
    data = np.concatenate([b.data, np.array([32], np.uint8)])
    take = np.repeat((starts - off[:-1]).astype(np.int32), lengths)
    take += np.arange(off[-1], dtype=np.int32)
    take[off[1:] - 1] = len(b.data)
    flat = data[take]
    counts = per_document(keep, b.offsets)
    edge = np.concatenate([[0], np.cumsum(counts)])
    ends = off[edge]
    last = ends[1:][counts > 0] - 1  # the space behind a document's last word
    flat = np.delete(flat, last)
    return flat, np.concatenate([[0], np.cumsum(np.diff(ends) - (counts > 0))])


def passage_dedup(docs: DataFrame, w: Windows = WORDS) -> DataFrame:
    """Removes each word covered by a window of w.length words that also starts in a document of smaller doc_id; one row per document.

    Null texts have no words. A null doc_id is smaller than others; rows that share a doc_id are one document here: they never remove each other's words.
    Columns other than doc_id and text are not read.
    """

    def run(batches):
        for rb in text_batches(batches, w.batch_bytes):
            b = batch_of(rb.column("text"), w, hashes=False)
            gone = covered(rb, b, w)
            flat, off = joined_words(b, ~gone)
            yield pa.RecordBatch.from_arrays(
                [rb.column("doc_id"), pa.array(np.diff(b.offsets)), pa.array(per_document(gone, b.offsets)), pa.array(_digest(flat, off))], names=["doc_id", "n_words", "n_removed", "kept_sha256"]
            )

    return with_spans(docs, w).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")

