"""N-gram Jaccard join by prefix filters under several global orders.

A document is the set of its distinct 4-word shingles. If two sets reach the threshold, their prefixes (the first n - ceil(t n) + 1 shingles) share a shingle
under any order of all shingles. Candidates come from the prefixes under the first order, with bounds by length and by the places of the shared shingle; they must
share prefix shingles under the other orders too before whole sets are intersected. Each order puts shingles that very many documents have last, and orders the
others by a hash of its own. Which shingles are frequent is counted per batch over all documents and summed; any choice gives the same links, only other candidates.

Copies (equal sets) are one class, a node, which sends each of its prefix shingles once. Prefix entries travel as packed strings to the bucket of their shingle. There, groups of at most
SMALL nodes give their pairs. Members of larger groups are compared with one hub of the group, the member that shares most shingles; then only members that lie in another component
than most of their group are looked at again, and only with members of other components that the bounds admit. A document that differs from the hub in many
shingles of its own has the group's shingle late in its order, so the bounds admit few partners, however large the group is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.common import (
    LOWER,
    NULL_ID,
    apart,
    bytes_of,
    doc_key,
    dropped,
    frugal,
    mixed,
    most_frequent,
    shuffle_partitions,
    signed,
    small_batches,
    spread,
    text_batches,
    whole_text,
    windows_hash,
    word_hashes,
    word_spans,
    written,
)
from rillflow.llm.components import components
from rillflow.llm.decontaminate import Lookup

SHINGLE, PERCENT = 4, 85
ORDERS = 3
#: Frequent shingles that an order knows of (at most), and how often a batch must hold one to report it.
FREQUENT, IN_BATCH = 1 << 18, 2
#: Groups of up to SMALL nodes give their pairs; shingles of at least this level (a power of two of their count) go to large groups at once.
SMALL, HOT_LEVEL = 64, 13
#: So many documents are looked up by broadcast; more are joined by a shuffle.
BROADCAST_MOST = 1 << 20
BYTES = 4 << 20

NODE = 12
ENTRY = np.dtype([("token", "<u4"), ("node", f"V{NODE}"), ("n", "<u4"), ("reach", "<u4")])
DOC, LARGE, PAIR, PACKED = range(4)
FOUND = "kind int, doc long, n long, node binary, reach long, token long, other binary"
SENT = f"{FOUND}, bucket int, packed binary"


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending and joined, and their len + 1 offsets."""
    data, offsets = bytes_of(column)
    data = LOWER[data]
    starts, stops, edges = word_spans(data, offsets)
    hashes = word_hashes(data, starts, stops)
    n = np.diff(edges)
    counts = np.where(n < size, n > 0, n - size + 1)
    doc, place = spread(counts)
    at = edges[:-1][doc] + place
    value = np.zeros(len(doc), np.uint64)
    full = n[doc] >= size
    value[full] = windows_hash(hashes, size)[at[full]]
    for k in range(1, size):  # shorter texts: the whole sequence
        short = n[doc] == k
        if short.any():
            value[short] = mixed(windows_hash(hashes, k)[at[short]], 1000 + k)
    ends = np.cumsum(counts)
    for a, z in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        value[a:z].sort()
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[new], np.concatenate([[0], np.cumsum(new)])[np.concatenate([[0], ends])]


def prefix_sizes(n: np.ndarray, percent: int) -> np.ndarray:
    return np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)


def reach(n: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """The size of the largest set that can reach the threshold with one of size n if the first shingle they share is at this place."""
    return (n - place) * (100 + percent) // percent - n


class Orders:
    """Global orders of shingles: by frequency class, then by a hash that differs between orders."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray):
        order = np.argsort(frequent)
        self.look, self.level = Lookup(frequent), np.minimum(63, 1 + np.log2(np.maximum(counts[order], 1)).astype(np.uint64))

    def levels(self, value: np.ndarray) -> np.ndarray:
        out = np.zeros(len(value), np.uint64)
        at, k = self.look.find(value)
        out[at] = self.level[k]
        return out

    def prefixes(self, value: np.ndarray, level: np.ndarray, edges: np.ndarray, most: np.ndarray, seed: int) -> np.ndarray:
        """Where the first most[i] shingles of each set i stand in value, in the order of this seed."""
        key = level << np.uint64(58) | mixed(value, seed) >> np.uint64(6)
        out, end = np.zeros(int(most.sum()), np.int64), 0
        for a, z, m in zip(edges[:-1].tolist(), edges[1:].tolist(), most.tolist(), strict=True):
            if m:
                out[end : end + m] = a + key[a:z].argsort()[:m]
                end += m
        return out


def frequent_shingles(texts: DataFrame, size: int) -> Orders:
    """Shingles that a batch holds in IN_BATCH documents or more, with the sum of such counts; the FREQUENT most frequent ones."""

    def run(batches):
        for rb in text_batches(batches, BYTES):
            value, counts = np.unique(shingle_sets(rb.column("text"), size)[0], return_counts=True)
            often = counts >= IN_BATCH
            yield pa.RecordBatch.from_arrays([pa.array(signed(value[often])), pa.array(counts[often])], names=["v", "n"])

    counts = written(texts.mapInArrow(frugal(run), "v long, n long").groupBy("v").agg(F.sum("n").alias("n")), "frequent")
    value, n = most_frequent(counts, "v", "n", FREQUENT)
    dropped(counts)
    return Orders(value.view(np.uint64), n)


# --------------------------------------------------------------------------- rows of nodes


def nodes_of(value: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """96 bits of each set's hash."""
    raw, digest = memoryview(np.ascontiguousarray(value).view(np.uint8)), xxhash.xxh3_128_digest
    return np.frombuffer(b"".join(digest(raw[8 * a : 8 * z])[:NODE] for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)), f"V{NODE}")


def node_array(nodes: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    out = pa.FixedSizeBinaryArray.from_buffers(pa.binary(NODE), len(nodes), [None, pa.py_buffer(np.ascontiguousarray(nodes))]).cast(pa.binary())
    return out if missing is None else pc.if_else(pa.array(missing), pa.scalar(None, pa.binary()), out)


def rows_of(schema: str, rows: int, /, **columns) -> pa.RecordBatch:
    """A batch of rows whose other columns are null."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    full = lambda x, t: x if isinstance(x, pa.Array) else pa.array(np.full(rows, x) if np.isscalar(x) else x, t)
    return pa.RecordBatch.from_arrays([full(columns[c], kinds[t]) if c in columns else pa.nulls(rows, kinds[t]) for c, t in zip(names, types, strict=True)], names=list(names))


def leads(nodes: np.ndarray) -> np.ndarray:
    """Whether each node is the first of its kind in a batch."""
    out = np.zeros(len(nodes), bool)
    out[np.unique(nodes, return_index=True)[1]] = True
    return out


def _first_pass(orders: Orders, size: int, percent: int, buckets: int):
    """A row for each document, and the prefix entries of each node of a batch, packed by bucket of the shingle; those of very frequent shingles one a row."""

    def run(batches):
        for rb in text_batches(batches, BYTES):
            value, edges = shingle_sets(rb.column("text"), size)
            n, nodes, doc = np.diff(edges), nodes_of(value, edges), rb.column("doc").to_numpy()
            deal = (mixed(doc.view(np.uint64), 21) % np.uint64(buckets)).astype(np.int32)
            yield rows_of(SENT, len(n), kind=DOC, doc=doc, n=n, node=node_array(nodes, n == 0), bucket=deal)
            # unequal sets of which the smaller has n shingles share n / (n + 1) at most
            most = np.where(leads(nodes) & (100 * n >= percent * (n + 1)), prefix_sizes(n, percent), 0)
            level = orders.levels(value)
            at = orders.prefixes(value, level, edges, most, 1)
            own, place = spread(most)
            far = reach(n[own], place, percent)
            hot = level[at] >= HOT_LEVEL
            if hot.any():
                yield rows_of(SENT, int(hot.sum()), kind=LARGE, token=signed(value[at[hot]]), node=node_array(nodes[own[hot]]), n=n[own[hot]], reach=far[hot], bucket=deal[own[hot]])
            at, own, far = at[~hot], own[~hot], far[~hot]
            token = mixed(value[at], 22)
            bucket = (token >> np.uint64(32)) % np.uint64(buckets)
            order = np.argsort(bucket)
            entries = np.zeros(len(at), ENTRY)
            entries["token"], entries["node"], entries["n"], entries["reach"] = token[order], nodes[own[order]], n[own[order]], far[order]
            ends = np.cumsum(np.bincount(bucket.astype(np.int64), minlength=buckets))
            some = np.flatnonzero(np.diff(ends, prepend=0))
            raw = entries.tobytes()
            begins = np.concatenate([[0], ends])[some]
            packed = [raw[ENTRY.itemsize * a : ENTRY.itemsize * z] for a, z in zip(begins.tolist(), ends[some].tolist(), strict=True)]
            yield rows_of(SENT, len(some), kind=PACKED, bucket=some, packed=pa.array(packed, pa.binary()))

    return run


def _paired(batches):
    """Of a bucket's entries: the pairs of groups of up to SMALL nodes that the bounds admit, and the rows of larger groups. Other rows go through."""
    held = []
    for rb in batches:
        kind = rb.column("kind").to_numpy()
        if (kind == PACKED).any():
            held += rb.column("packed").drop_null().to_pylist()
            rb = rb.filter(pa.array(kind != PACKED))
        yield rb.select(FOUND_NAMES)
    x = np.frombuffer(b"".join(held), ENTRY)
    held = None
    x = x[np.argsort(x["token"])]
    alone = np.ones(len(x), bool)
    same = x["token"][1:] == x["token"][:-1]
    alone[1:] &= ~same
    alone[:-1] &= ~same
    x = x[~alone]
    if not len(x):
        return
    names, code = np.unique(x["node"], return_inverse=True)
    code = code.reshape(-1)
    order = np.lexsort((code, x["token"]))
    x, code = x[order], code[order]
    first = np.concatenate([[True], (x["token"][1:] != x["token"][:-1]) | (code[1:] != code[:-1])])
    x, code = x[first], code[first]
    begin = np.flatnonzero(np.concatenate([[True], x["token"][1:] != x["token"][:-1]]))
    size = np.diff(np.append(begin, len(x)))
    n, far = x["n"].astype(np.int64), x["reach"].astype(np.int64)
    pairs = []
    for k in np.unique(size[(size > 1) & (size <= SMALL)]).tolist():
        i, j = np.triu_indices(k, 1)
        some = begin[size == k]
        step = max(1, (1 << 19) // len(i))
        for a in range(0, len(some), step):
            p, q = ((some[a : a + step, None] + y).ravel() for y in (i, j))
            fits = (n[q] <= far[p]) & (n[p] <= far[q])
            pairs.append(np.unique(code[p[fits]] * len(names) + code[q[fits]]))
    if pairs:
        pair = np.unique(np.concatenate(pairs))
        yield rows_of(FOUND, len(pair), kind=PAIR, node=node_array(names[pair // len(names)]), other=node_array(names[pair % len(names)]))
    large = np.repeat(size > SMALL, size)
    if large.any():
        yield rows_of(FOUND, int(large.sum()), kind=LARGE, token=x["token"][large].astype(np.int64), node=node_array(x["node"][large]), n=n[large], reach=far[large])


FOUND_NAMES = [c.split()[0] for c in FOUND.split(", ")]
FILTERS = [f"p{i}" for i in range(2, ORDERS + 1)]


def _lists(value: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(value))


def _batch_sets(batches, size: int):
    """Of each batch: the distinct nodes, their sets joined, and the sets' sizes."""
    for rb in text_batches(batches, BYTES):
        value, edges = shingle_sets(rb.column("text"), size)
        nodes, n = nodes_of(value, edges), np.diff(edges)
        new = leads(nodes) & (n > 0)
        yield nodes[new], value[np.repeat(new, n)], n[new]


def _filter_rows(orders: Orders, size: int, percent: int):
    """32 bits of the prefix shingles of each node under each order but the first, in that order."""

    def run(batches):
        for nodes, value, n in _batch_sets(batches, size):
            edges, most, level = np.concatenate([[0], np.cumsum(n)]), prefix_sizes(n, percent), orders.levels(value)
            own = [_lists(mixed(value[orders.prefixes(value, level, edges, most, i)], 23).astype(np.uint32).view(np.int32), most) for i in range(2, ORDERS + 1)]
            yield pa.RecordBatch.from_arrays([node_array(nodes), pa.array(n), *own], names=["node", "n", *FILTERS])

    return run


def _set_rows(size: int):
    def run(batches):
        for nodes, value, n in _batch_sets(batches, size):
            yield pa.RecordBatch.from_arrays([node_array(nodes), pa.array(n), _lists(signed(np.ascontiguousarray(value)), n)], names=["node", "n", "set"])

    return run


# --------------------------------------------------------------------------- links


def ends_of(pairs: DataFrame) -> DataFrame:
    """node: each node that is one of a pair (a, b), once. Each side is made distinct by itself, so no pair becomes two rows."""
    return pairs.select(F.col("a").alias("node")).distinct().union(pairs.select(F.col("b").alias("node")).distinct()).distinct()


class Sets:
    """Fetches filters and whole sets of nodes from the texts of their representatives."""

    def __init__(self, texts: DataFrame, classes: DataFrame, orders: Orders, size: int, percent: int):
        self.texts, self.classes, self.orders, self.size, self.percent = texts, classes, orders, size, percent

    def fetched(self, nodes: DataFrame, run, schema: str, name: str) -> DataFrame:
        """Rows of the nodes, by broadcast of up to BROADCAST_MOST ids, else by a shuffle. A node may have several equal rows."""
        ids = written(nodes.join(self.classes, "node").select(F.col("rep").alias("doc")).distinct(), "ids")
        texts = self.texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_MOST else ids, "doc", "left_semi")
        return written(texts.mapInArrow(frugal(run), schema), name)

    def filters(self, nodes: DataFrame) -> DataFrame:
        return self.fetched(nodes, _filter_rows(self.orders, self.size, self.percent), "node binary, n long" + "".join(f", {p} array<int>" for p in FILTERS), "filters")

    def admitted(self, p: str) -> Column:
        """Whether two prefixes share a shingle at places that leave enough behind it; the first one that they share leaves most."""
        left = lambda x, v: F.col(f"n_{x}") + 1 - F.array_position(f"{p}_{x}", v)
        least = self.percent * (F.col("n_a") + F.col("n_b"))
        return F.exists(F.array_intersect(f"{p}_a", f"{p}_b"), lambda v: (100 + self.percent) * F.least(left("a", v), left("b", v)) >= least)

    def verified(self, pairs: DataFrame, filters: DataFrame) -> DataFrame:
        """Pairs (a, b) whose prefixes admit them under every other order too and whose whole sets reach the threshold."""
        side = lambda x, frame: frame.dropDuplicates(["node"]).select(*[F.col(c).alias(x if c == "node" else f"{c}_{x}") for c in frame.columns])
        near = pairs.join(side("a", filters), "a").join(side("b", filters), "b")
        for p in FILTERS:
            near = near.where(self.admitted(p))
        near = written(near.select("a", "b"), "near")
        sets = self.fetched(ends_of(near), _set_rows(self.size), "node binary, n long, set array<long>", "sets")
        both = near.join(side("a", sets), "a").join(side("b", sets), "b")
        shared = F.size(F.array_intersect("set_a", "set_b"))
        links = written(both.where(100 * shared >= self.percent * (F.col("n_a") + F.col("n_b") - shared)).select("a", "b").distinct(), "links")
        dropped(near, sets)
        return links


def _ordered(x: str, y: str):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def hub_pairs(large: DataFrame) -> DataFrame:
    """Pairs of members of each large group with its hub: of the members that lie in most groups, the first."""
    degree = large.groupBy("node").agg(F.count("*").alias("degree"))
    hubs = large.join(degree, "node").groupBy("token").agg(F.min(F.struct(-F.col("degree"), "node", "n", "reach")).alias("h"))
    hubs = hubs.select("token", F.col("h.node").alias("hub"), F.col("h.n").alias("m"), F.col("h.reach").alias("hub_reach"))
    near = large.join(hubs, "token").where((F.col("node") != F.col("hub")) & (F.col("m") <= F.col("reach")) & (F.col("n") <= F.col("hub_reach")))
    return near.select(*_ordered("node", "hub")).distinct()


def cross_pairs(large: DataFrame, labels: DataFrame) -> DataFrame:
    """large has the representative, rep, of each node; labels the component of each doc. Pairs of members of a large group that lie in different components, one of them not in the group's most frequent one, and that the bounds admit."""
    named = large.join(labels, large["rep"] == labels["doc"], "left").withColumn("label", F.coalesce("component", "rep"))
    main = named.groupBy("token", "label").agg(F.count("*").alias("c")).groupBy("token").agg(F.max(F.struct("c", "label")).alias("most"), F.count("*").alias("labels")).where("labels > 1")
    named = written(named.join(main.select("token", F.col("most.label").alias("main")), "token"), "named")
    left = named.where("label <> main").select("token", F.col("node").alias("x"), F.col("n").alias("n_x"), F.col("reach").alias("reach_x"), F.col("label").alias("label_x"))
    both = left.join(named, "token").where((F.col("label_x") != F.col("label")) & (F.col("n_x") <= F.col("reach")) & (F.col("n") <= F.col("reach_x")))
    return both.select(*_ordered("x", "node")).distinct()


def jaccard_components(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, task_rows: int | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs. task_rows is that of components().

    A null or empty text has no shingles and no links. Rows with shingles that share a doc_id are linked. A null doc_id sorts first, and the component_id of
    what it links with is null. Very long texts are sets as any other. Columns other than doc_id and text are not read.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    buckets = shuffle_partitions(spark)
    texts = docs.select(doc_key().alias("doc"), whole_text().alias("text"))
    orders = frequent_shingles(texts, size)
    sent = texts.mapInArrow(frugal(_first_pass(orders, size, percent, buckets)), SENT)
    found = written(sent.repartitionById(buckets, F.col("bucket")).mapInArrow(frugal(_paired), FOUND), "found")
    rows = found.where(F.col("kind") == DOC).select("doc", "n", "node")
    classes = written(rows.where("n > 0").groupBy("node").agg(F.min("doc").alias("rep"), F.count("*").alias("copies")), "classes")
    large = written(found.where(F.col("kind") == LARGE).select("token", "node", "n", "reach").distinct(), "large")
    pairs = found.where(F.col("kind") == PAIR).select(*_ordered("node", "other")).union(hub_pairs(large)).distinct()
    pairs = written(pairs, "pairs")
    wanted = ends_of(pairs).union(large.select("node").distinct()).distinct()
    sets = Sets(texts, classes, orders, size, percent)
    filters = sets.filters(wanted)
    links = sets.verified(pairs, filters)
    # rows that share a doc_id but not their set link their classes
    own = rows.where("n > 0").select("doc", "node").distinct()
    shared = own.join(own.groupBy("doc").agg(F.count("*").alias("k"), F.min("node").alias("least")).where("k > 1"), "doc")
    links = links.union(shared.where(F.col("least") != F.col("node")).select(F.col("least").alias("a"), F.col("node").alias("b")))

    def labelled(links):
        """doc and component of the representatives that have links."""
        named = lambda x: classes.select(F.col("node").alias(x), F.col("rep").alias(f"rep_{x}"))
        return components(links.join(named("a"), "a").join(named("b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")), task_rows)

    labels = labelled(links)
    if large.take(1):
        reps = classes.select("node", "rep")
        cross = written(cross_pairs(large.join(reps, "node"), labels), "cross")
        if cross.take(1):
            labels = labelled(links.union(sets.verified(cross, filters)))
    # class to component, of classes that have copies or links
    of = classes.join(labels, classes["rep"] == labels["doc"], "left").where("copies > 1 OR component IS NOT NULL").select("node", F.coalesce("component", "rep").alias("component"))
    bare = rows.where("n = 0").select("doc", "n", F.col("doc").alias("component"))
    full = rows.where("n > 0").join(written(of, "class-components"), "node", "left").select("doc", "n", F.coalesce("component", "doc").alias("component"))
    id_of = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return full.union(bare).select(id_of("doc").alias("doc_id"), F.col("n").alias("n_shingles"), id_of("component").alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """The rows of docs, with all their columns, that stand for their component: one each, of the smallest doc_id (null first). Rows without words all stay.

    Documents are told apart by a 64-bit hash of doc_id and text: a doc_id that rows share, or a null one, links nothing by itself. Other columns may have any name.
    """
    return apart(docs, ("doc_id", "text"), lambda d: _one_of_each(d, percent, size))


def _one_of_each(docs: DataFrame, percent: int, size: int) -> DataFrame:
    own = docs.withColumns({"_id": doc_key(), "_doc": F.xxhash64(doc_key(), whole_text())})
    key = lambda c: F.coalesce(c, F.lit(NULL_ID))
    found = jaccard_components(own.select(F.col("_doc").alias("doc_id"), whole_text().alias("text")), percent, size)
    found = found.where("n_shingles > 0").select(key("doc_id").alias("_doc"), key("component_id").alias("_component")).distinct()
    stays = own.select("_doc", "_id").distinct().join(found, "_doc").groupBy("_component").agg(F.min(F.struct("_id", "_doc")).alias("least")).select("least._doc")
    bare = ~whole_text().rlike(r"[^\x20\x09-\x0D]")
    kept = own.where(~bare).join(stays, "_doc", "left_semi").dropDuplicates(["_doc", "_id"])
    return kept.unionByName(own.where(bare))
