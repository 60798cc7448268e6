"""MinHash near-duplicates: one-permutation signatures with optimal densification, banded buckets, stars of candidates, exact confirmation.

A document is the set of its distinct 5-word shingles. One hash of each shingle deals it to one of BINS bins by its upper bits; a bin's value is its least hash. A bin without shingles takes the
value of another one, found by a walk over bins that is the same in all documents (densification with a hash of bin and attempt), so that bins agree as often as sets overlap. ROWS bins one
after the other are a band; documents whose bins agree in a band meet in its bucket. For two sets at the threshold of 0.85 that share no band the chance is about 6e-11.

Copies (equal sets) are one node. In a bucket each node is paired with one hub, so a bucket of n nodes gives n - 1 pairs, and hubs are the same node in most bands of a cluster. Pairs are confirmed
on full sets. A star leaves pairs of its other members open where one of them is not tied to the hub; the members of such stars, and they alone, go to the prefix-filter join, which is exact
and takes only pairs with rare shingles in common. So each pair that shares a bucket is looked at, or lies in one star already.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm import ngram_join
from rillflow.llm.common import (
    NULL_ID,
    doc_key,
    dropped,
    frugal,
    mixed,
    shuffle_partitions,
    small_batches,
    spread,
    text_batches,
    whole_text,
    written,
)
from rillflow.llm.components import components
from rillflow.llm.ngram_join import BYTES, NODE, Sets, _set_rows, ends_of, leads, node_array, nodes_of, rows_of, shingle_sets

SHINGLE, PERCENT = 5, 85
#: Bins of a signature (a power of two), and bins of a band.
BINS, ROWS = 128, 4
#: Edges that a task of the component search takes.
TASK_ROWS = 20_000
ENTRY = np.dtype([("key", "<u8"), ("node", f"V{NODE}"), ("n", "<u4")])
DOC, PAIR, PACKED = range(3)
FOUND = "kind int, doc long, n long, node binary, other binary"
FOUND_NAMES = [c.split()[0] for c in FOUND.split(", ")]
SENT = f"{FOUND}, bucket int, packed binary"


def signatures(value: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """BINS values of each set of hashes (ascending and joined, with their len + 1 offsets); sets of no hash have zeros."""
    n = np.diff(edges)
    doc = np.repeat(np.arange(len(n)), n)
    place = doc * BINS + (value >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.ones(len(value), bool)
    first[1:] = place[1:] != place[:-1]
    out, there = np.zeros(len(n) * BINS, np.uint64), np.zeros(len(n) * BINS, bool)
    out[place[first]], there[place[first]] = value[first], True  # the least hash of a bin comes first
    open_ = np.flatnonzero(~there & np.repeat(n > 0, BINS))
    attempt = 0
    while len(open_):
        attempt += 1
        bin_ = (open_ % BINS).astype(np.uint64)
        donor = open_ // BINS * BINS + (mixed(bin_ + np.uint64(attempt * BINS), 31) % np.uint64(BINS)).astype(np.int64)
        full = there[donor]
        out[open_[full]] = out[donor[full]]
        open_ = open_[~full]
    return out.reshape(len(n), BINS)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each signature."""
    bands = signature.reshape(len(signature), -1, ROWS)
    key = np.broadcast_to(mixed(np.arange(bands.shape[1], dtype=np.uint64), 32), bands.shape[:2])
    for i in range(ROWS):
        key = mixed(key ^ bands[:, :, i], 33)
    return key


def _first_pass(size: int, percent: int, buckets: int):
    """A row for each document, and the band entries of each node of a batch, packed by bucket."""

    def run(batches):
        for rb in text_batches(batches, BYTES):
            value, edges = shingle_sets(rb.column("text"), size)
            n, nodes, doc = np.diff(edges), nodes_of(value, edges), rb.column("doc").to_numpy()
            deal = (mixed(doc.view(np.uint64), 34) % np.uint64(buckets)).astype(np.int32)
            yield rows_of(SENT, len(n), kind=DOC, doc=doc, n=n, node=node_array(nodes, n == 0), bucket=deal)
            # unequal sets of which the smaller has n shingles share n / (n + 1) at most
            own = np.flatnonzero(leads(nodes) & (100 * n >= percent * (n + 1)) & (n > 0))
            if not len(own):
                continue
            keep = np.zeros(len(n), bool)
            keep[own] = True
            keys = band_keys(signatures(value[np.repeat(keep, n)], np.concatenate([[0], np.cumsum(n[own])])))
            key, who = keys.ravel(), np.repeat(own, keys.shape[1])
            bucket = (key >> np.uint64(32)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            entries = np.zeros(len(key), ENTRY)
            entries["key"], entries["node"], entries["n"] = key[order], nodes[who[order]], n[who[order]]
            ends = np.cumsum(np.bincount(bucket.astype(np.int64), minlength=buckets))
            some = np.flatnonzero(np.diff(ends, prepend=0))
            raw, begins = entries.tobytes(), np.concatenate([[0], ends])[some]
            packed = [raw[ENTRY.itemsize * a : ENTRY.itemsize * z] for a, z in zip(begins.tolist(), ends[some].tolist(), strict=True)]
            yield rows_of(SENT, len(some), kind=PACKED, bucket=some, packed=pa.array(packed, pa.binary()))

    return run


def _starred(percent: int):
    """Of the entries of a task: pairs of each bucket's hub with its other nodes (n has 1 where their sizes admit a link, and 2 where the bucket has more nodes than these). Other rows go through."""

    def run(batches):
        held = []
        for rb in batches:
            kind = rb.column("kind").to_numpy()
            if (kind == PACKED).any():
                held += rb.column("packed").drop_null().to_pylist()
                rb = rb.filter(pa.array(kind != PACKED))
            yield rb.select(FOUND_NAMES)
        x = np.frombuffer(b"".join(held), ENTRY)
        held = None
        x = x[np.argsort(x["key"])]
        same = x["key"][1:] == x["key"][:-1]
        alone = np.ones(len(x), bool)
        alone[1:] &= ~same
        alone[:-1] &= ~same
        x = x[~alone]
        if not len(x):
            return
        names, code = np.unique(x["node"], return_inverse=True)
        order = np.lexsort((code.reshape(-1), x["key"]))
        x, code = x[order], code.reshape(-1)[order]
        new = np.concatenate([[True], (x["key"][1:] != x["key"][:-1]) | (code[1:] != code[:-1])])
        x, code = x[new], code[new]  # batches of one task may send a node twice
        begin = np.flatnonzero(np.concatenate([[True], x["key"][1:] != x["key"][:-1]]))
        count = np.diff(np.append(begin, len(x)))
        group, place = spread(count)
        hub, n = begin[group], x["n"].astype(np.int64)
        fits = 100 * np.minimum(n, n[hub]) >= percent * np.maximum(n, n[hub])
        what = fits + 2 * (count[group] > 2)
        key = np.unique(((code[hub] * len(names) + code) * 4 + what)[place > 0])
        pair, what = key // 4, key % 4
        yield rows_of(FOUND, len(pair), kind=PAIR, n=what, node=node_array(names[pair // len(names)]), other=node_array(names[pair % len(names)]))

    return run


def confirmed(sets: Sets, pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a table, of nodes whose full sets reach the threshold. Each side is joined by its node; a hub has as many rows as partners, which Spark's skew join splits."""
    full = sets.fetched(ends_of(pairs), _set_rows(sets.size), "node binary, n long, set array<long>", "sets")
    side = lambda x: full.dropDuplicates(["node"]).select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("set").alias(f"set_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    links = written(both.where(100 * shared >= percent * (F.col("n_a") + F.col("n_b") - shared)).select("a", "b"), "links")
    dropped(full)
    return links


def open_nodes(star: DataFrame, links: DataFrame) -> DataFrame:
    """node: hubs and members of stars over more than two nodes, of which a member is not tied to its hub. A node is tied to the least hub that it links with, and through that to its hub's hub."""
    up = written(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")), "hubs")
    label = up.join(up.select(F.col("node").alias("up"), F.col("up").alias("top")), "up", "left").select("node", F.coalesce("top", "up").alias("label"))
    of = lambda x: label.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"))
    many = star.where(F.col("what") >= 2)
    both = many.join(of("a"), "a", "left").join(of("b"), "b", "left")
    loose = written(both.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a").distinct(), "loose")
    return ends_of(many.join(loose, "a", "left_semi"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs: kept where the document is the first of its component.

    A null or empty text, or one without words, has no shingles and no links, and is kept. With fewer than size words the whole sequence is the only shingle. Rows with shingles that share a doc_id
    are linked, and repeated rows have the same result. A null doc_id sorts first; the component_id of what it links with is null, and its own row alone is kept. Very long texts are sets as any
    other, made a batch at a time. An empty table has no rows. Columns other than doc_id and text are not read.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    buckets = shuffle_partitions(spark)
    texts = docs.select(doc_key().alias("doc"), whole_text().alias("text"))
    sent = texts.mapInArrow(frugal(_first_pass(size, percent, buckets)), SENT)
    found = written(sent.repartitionById(buckets, F.col("bucket")).mapInArrow(frugal(_starred(percent)), FOUND), "found")
    rows = found.where(F.col("kind") == DOC).select("doc", "n", "node")
    classes = written(rows.where("n > 0").groupBy("node").agg(F.min("doc").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n")), "classes")
    pairs = found.where(F.col("kind") == PAIR).groupBy(F.col("node").alias("a"), F.col("other").alias("b")).agg(F.bit_or("n").alias("what"))
    star = written(pairs, "star")
    sets = Sets(texts, classes.select("node", "rep"), None, size, percent)
    links = confirmed(sets, star.where(F.col("what") % 2 == 1).select("a", "b"), percent)
    # rows that share a doc_id but not their set link their classes; such ids are few, and written, as links are read more than once
    own = rows.where("n > 0").select("doc", "node")
    ids = written(own.groupBy("doc").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("doc", "least"), "shared-ids")
    shared = written(own.join(ids, "doc").where(F.col("least") != F.col("node")).select(F.col("least").alias("a"), F.col("node").alias("b")).distinct(), "shared")
    links = links.union(shared)

    def edges(links):
        named = lambda x: classes.select(F.col("node").alias(x), F.col("rep").alias(f"rep_{x}"))
        return links.join(named("a"), "a").join(named("b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))

    every = edges(links)
    rest = written(open_nodes(star, links).join(classes, "node").select(F.col("rep").alias("doc")), "open")
    if rest.take(1):
        held = written(texts.join(rest, "doc", "left_semi").select(F.col("doc").alias("doc_id"), "text"), "open-texts")
        exact = ngram_join.jaccard_components(held, percent, size, TASK_ROWS)
        every = every.union(exact.where("n_shingles > 0").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("a"), F.coalesce("component_id", F.lit(NULL_ID)).alias("b")))
    labels = components(every, TASK_ROWS)
    of = classes.join(labels, classes["rep"] == labels["doc"], "left").where("copies > 1 OR component IS NOT NULL").select("node", F.coalesce("component", "rep").alias("component"))
    bare = rows.where("n = 0").select("doc", "n", F.col("doc").alias("component"))
    full = rows.where("n > 0").join(written(of, "class-components"), "node", "left").select("doc", "n", F.coalesce("component", "doc").alias("component"))
    dropped(star)
    id_of = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return full.union(bare).select(id_of("doc").alias("doc_id"), F.col("n").alias("n_shingles"), id_of("component").alias("component_id"), (F.col("doc") == F.col("component")).alias("kept"))
