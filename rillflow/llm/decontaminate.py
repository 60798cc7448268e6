"""Benchmark decontamination by a prefix-filtered set join.

An item is a set of windows (10 consecutive words; a shorter item is one window), a window a sequence of shingles. A window is contained in a document
only if each of its shingles is, so one necessary shingle is enough for its prefix: the rarest, by document counts over all documents. Documents look up
the prefix shingles; the place of a hit gives the only possible start of the window; bounds of length and position are applied,
and what is left is compared word for word.

Windows are taken in blocks of BLOCK, so that what a task holds is bounded however many items there are: each block is one more pass
over the documents, without a shuffle of texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import LOWER, apart, bytes_of, frugal, small_batches, spread, swept, table_of, text_batches, whole_text, windows_hash, word_hashes, word_spans, written

#: Bytes that separate words of the pattern [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
SEPARATORS = table_of((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
WINDOW, SHINGLE, BLOCK = 10, 3, 50_000
BITS = 20
BYTES = 2 << 20


def _words(column: pa.Array):
    data, offsets = bytes_of(column)
    data = LOWER[data]
    starts, stops, edges = word_spans(data, offsets, SEPARATORS)
    return data, starts, stops, edges, word_hashes(data, starts, stops)


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows of the items: the words joined by one space, their number, and the sorted ids of items that have the window."""

    def run(batches):
        for rb in text_batches(batches):
            data, starts, stops, edges, _ = _words(rb.column("text"))
            raw = data.tobytes()
            out = {"w": [], "len": [], "item": []}
            for item, a, z in zip(rb.column("item").to_pylist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                words = [raw[i:j].decode("utf-8", "surrogateescape") for i, j in zip(starts[a:z].tolist(), stops[a:z].tolist(), strict=True)]
                for i in range(max(1, len(words) - window + 1) if words else 0):
                    out["w"].append(" ".join(words[i : i + window]))
                    out["len"].append(min(window, len(words)))
                    out["item"].append(item)
            yield pa.RecordBatch.from_pydict({"w": pa.array(out["w"], pa.string()), "len": pa.array(out["len"], pa.int32()), "item": pa.array(out["item"], pa.string())})

    d = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), whole_text().alias("text"))
    return d.mapInArrow(run, "w string, len int, item string").groupBy("w", "len").agg(F.sort_array(F.collect_set("item")).alias("items"))


class Lookup:
    """Which of a sorted set of hashes each value is, or -1; a bitmap of the low bits settles most values first."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.bits = np.zeros(1 << BITS, bool)
        self.bits[(self.values & np.uint64((1 << BITS) - 1)).astype(np.int64)] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the values that are in the set, and which they are."""
        at = np.flatnonzero(self.bits[(x & np.uint64((1 << BITS) - 1)).astype(np.int64)])
        if not len(self.values):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.values, x[at]), len(self.values) - 1)
        ok = self.values[k] == x[at]
        return at[ok], k[ok]


class Block:
    """A bounded number of windows and their shingles."""

    def __init__(self, rows: list, shingle: int):
        self.texts = [r["w"] for r in rows]
        self.items = [list(r["items"]) for r in rows]
        self.length = np.array([r["len"] for r in rows], np.int64)
        _, _, _, edges, hashes = _words(pa.array(self.texts, pa.string()))
        self.size = np.minimum(self.length, shingle)  # words of a window's shingles
        self.hash = np.zeros(len(rows), np.uint64)
        own, place, value = [], [], []
        for k in np.unique(self.length):
            at = np.flatnonzero(self.length == k)
            self.hash[at] = windows_hash(hashes, int(k))[edges[at]]
            s = int(min(k, shingle))
            sh = windows_hash(hashes, s)
            w, i = spread(np.full(len(at), int(k) - s + 1))
            own.append(at[w])
            place.append(i)
            value.append(sh[edges[at][w] + i])
        self.own, self.place, self.value = (np.concatenate(x) for x in (own, place, value))
        self.sizes = sorted(set(self.size.tolist()))

    def lookups(self) -> dict[int, Lookup]:
        return {s: Lookup(self.value[self.size[self.own] == s]) for s in self.sizes}

    def prefixes(self, counts: dict[tuple[int, int], int]):
        """For each shingle size: the lookup of prefix shingles, and for each of them its windows and their offsets."""
        rarity = np.array([counts.get((s, v), 0) for s, v in zip(self.size[self.own].tolist(), self.value.view(np.int64).tolist(), strict=True)])
        order = np.lexsort((self.place, self.value, rarity, self.own))
        rarest = order[np.concatenate([[True], self.own[order][1:] != self.own[order][:-1]])]
        out = {}
        for s in self.sizes:
            r = rarest[self.size[self.own[rarest]] == s]
            look = Lookup(self.value[r])
            k = np.searchsorted(look.values, self.value[r])
            r = r[np.argsort(k, kind="stable")]
            k = np.sort(k)
            out[s] = look, np.searchsorted(k, np.arange(len(look.values) + 1)), self.own[r], self.place[r]
        return out


def _counted(block: Block):
    looks = block.lookups()

    def run(batches):
        for rb in text_batches(batches, BYTES):
            _, _, _, edges, hashes = _words(rb.column("text"))
            for s, look in looks.items():
                at, k = look.find(windows_hash(hashes, s))
                doc = np.searchsorted(edges, at, side="right") - 1
                inside = at + s <= edges[doc + 1]
                pair = np.unique(doc[inside] * len(look.values) + k[inside])
                n = np.bincount(pair % max(1, len(look.values)), minlength=len(look.values))
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict({"s": pa.array(np.full(len(some), s, np.int32)), "v": pa.array(look.values[some].view(np.int64)), "n": pa.array(n[some])})

    return run


def _matched(block: Block, prefixes, names: list[str]):
    """Adds the block's hits to the columns _spans (pairs of first word and end) and _items."""

    def run(batches):
        for rb in text_batches(batches, BYTES):
            data, starts, stops, edges, hashes = _words(rb.column("_text"))
            raw = data.tobytes()
            spans = [list(x or ()) for x in rb.column("_spans").to_pylist()]
            items = [set(x or ()) for x in rb.column("_items").to_pylist()]
            whole: dict[int, np.ndarray] = {}
            for s, (look, first, own, place) in prefixes.items():
                at, k = look.find(windows_hash(hashes, s))
                doc = np.searchsorted(edges, at, side="right") - 1
                pair, i = spread(first[k + 1] - first[k])
                w = own[first[k][pair] + i]
                start = at[pair] - place[first[k][pair] + i]
                doc = doc[pair]
                fits = (start >= edges[doc]) & (start + block.length[w] <= edges[doc + 1])
                w, start, doc = w[fits], start[fits], doc[fits]
                for n in np.unique(block.length[w]).tolist():
                    if n not in whole:
                        whole[n] = windows_hash(hashes, n)
                    own_n = np.flatnonzero(block.length[w] == n)
                    own_n = own_n[whole[n][start[own_n]] == block.hash[w[own_n]]]
                    for a, d, x in zip(start[own_n].tolist(), doc[own_n].tolist(), w[own_n].tolist(), strict=True):
                        if b" ".join(raw[p:q] for p, q in zip(starts[a : a + n].tolist(), stops[a : a + n].tolist(), strict=True)) == block.texts[x].encode("utf-8"):
                            spans[d] += (a - int(edges[d]), a - int(edges[d]) + n)
                            items[d].update(block.items[x])
            yield pa.RecordBatch.from_arrays(
                [*(rb.column(c) for c in names), rb.column("_text"), pa.array(spans, pa.list_(pa.int64())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                names=[*names, "_text", "_spans", "_items"],
            )

    return run


RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _summed(names: list[str]):
    def run(batches):
        for rb in text_batches(batches, BYTES):
            data, offsets = bytes_of(rb.column("_text"))
            _, _, edges = word_spans(LOWER[data], offsets, SEPARATORS)
            lists = rb.column("_spans")
            flat = lists.flatten().to_numpy()
            base = np.repeat(edges[:-1], lists.value_lengths().to_numpy() // 2)
            steps = np.zeros(int(edges[-1]) + 1, np.int64)
            np.add.at(steps, flat[::2] + base, 1)
            np.add.at(steps, flat[1::2] + base, -1)
            total = np.concatenate([[0], np.cumsum(np.cumsum(steps[:-1]) > 0)])
            hit = total[edges[1:]] - total[edges[:-1]]
            items = rb.column("_items").to_pylist()
            digests = [hashlib.sha256(",".join(x).encode("utf-8")).hexdigest() for x in items]
            own = [pa.array(np.diff(edges)), pa.array(hit), pa.array([len(x) for x in items], pa.int64()), pa.array(digests, pa.string()), pa.array(hit > 0)]
            yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in names), *own], names=[*names, *(x.split()[0] for x in RESULT.split(", "))])

    return run


def _both(first, then):
    return lambda batches: then(first(batches))


def judged(docs: DataFrame, items: DataFrame, names: list[str], window: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """The named columns of docs with the columns of RESULT."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(whole_text().alias("text"))
    windows = written(item_windows(items, window), "item-windows")
    blocks = max(1, -(-windows.count() // block))
    quoted = [F.col(f"`{c}`") for c in names]
    kept = docs.select(*quoted)
    out = docs.select(*quoted, whole_text().alias("_text"), F.array().cast("array<bigint>").alias("_spans"), F.array().cast("array<string>").alias("_items"))
    schema = out.schema
    passes = []
    for i in range(blocks):
        part = windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("w"), F.lit(blocks)) == i)
        rows = part.orderBy("w").collect()  # about BLOCK windows
        if not rows:
            continue
        b = Block(rows, shingle)
        counts = texts.mapInArrow(frugal(_counted(b)), "s int, v long, n long").groupBy("s", "v").agg(F.sum("n")).collect()
        passes.append(_matched(b, b.prefixes({(r[0], r[1]): r[2] for r in counts}), names))
    swept(spark)
    for column in RESULT.split(", "):
        kept = kept.withColumn(column.split()[0], F.lit(None).cast(column.split()[1]))
    for run in passes[:-1]:
        out = out.mapInArrow(frugal(run), schema)
    last = _summed(names)
    if passes:  # in the worker of the last block: each step of its own is one more worker beside every task
        last = _both(passes[-1], last)
    return out.mapInArrow(frugal(last), kept.schema)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: its words, the words inside any window of an item, and the items whose windows occur.

    Null texts and ids: a null text has no words, a null item_id counts as an item with an empty id, a null doc_id is kept. Items that share their words both
    count; items without words have no window. Repeated rows give repeated results; other columns of either table are not read. Very long texts are judged whole.
    """
    return judged(docs, items, ["doc_id"], window, shingle, block)


def decontaminated(docs: DataFrame, items: DataFrame, **limits: int) -> DataFrame:
    """The rows of docs, with all their columns, whatever their names, that hold no window of an item. Null and empty texts stay; repeated rows stay or go together."""
    return apart(docs, ("text",), lambda d: judged(d, items, d.columns, **limits).where("not contaminated"))
