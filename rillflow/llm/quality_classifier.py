"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors of its words and of their character n-grams, hashed into buckets, and of one vector for each word that equals the word before it
(the one word n-gram that needs no words); a softmax layer gives its class. Vectors and layer are
trained by stochastic gradient descent in numpy, in one task, on a bounded sample of labelled documents (TRAIN_ROWS). Every document is scored: the layer is applied to the bucket vectors
once, which leaves one number a bucket, and distinct words of a batch are summed once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import apart, bytes_of, coded, frugal, hashed, mixed, small_batches, spread, text_batches, whole_text, word_spans

#: At most so many labelled rows are learned from: those with the least hash of their id.
TRAIN_ROWS = 6000
BUCKETS, DIMS, GRAMS, EPOCHS, RATE = 1 << 15, 16, (3, 4, 5), 6, 0.5
#: A repeated word counts as so many features, about as many as a word has n-grams.
REPEAT = 16
BYTES = 1 << 20
#: Distinct words whose n-grams are made in one vector pass.
AT_ONCE = 1 << 14


def word_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the distinct words and of their n-grams of characters, in order of the words, and len + 1 offsets; AT_ONCE words at a time."""
    parts = list(_parts(words))
    if not parts:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    return np.concatenate([ids for ids, _ in parts]), np.concatenate([[0], np.cumsum(np.concatenate([n for _, n in parts]))])


def _parts(words: pa.Array):
    return (_features_of(words.slice(a, AT_ONCE)) for a in range(0, len(words), AT_ONCE))


def word_sums(words: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's sum of the weights of its features, and how many these are; no more than AT_ONCE words' features are held."""
    sums, counts = [np.zeros(0)], [np.zeros(0, np.int64)]
    for ids, n in _parts(words):  # a word has one feature at least
        sums.append(np.add.reduceat(weights[ids].astype(np.float64), np.cumsum(n) - n))
        counts.append(n)
    return np.concatenate(sums), np.concatenate(counts)


def _features_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets in order of the words, and how many each word has."""
    n = len(words)
    own = (mixed(hashed(words), 9) % np.uint64(BUCKETS)).astype(np.int32)
    marked = [f"<{w.decode('utf-8', 'replace')}>" for w in words.to_pylist()]
    # a word's end: as many ">" as words, told apart by lengths
    size = np.fromiter(map(len, marked), np.int64, n)
    chars = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.cumsum(size)
    place = np.repeat(ends, size) - np.arange(len(chars))  # characters left in the word
    word = np.repeat(np.arange(n, dtype=np.int32), size)
    ids, of = [own], [np.arange(n, dtype=np.int32)]
    with np.errstate(over="ignore"):
        for g in GRAMS:
            if len(chars) < g:
                continue
            h = np.full(len(chars) - g + 1, g, np.uint64)
            for k in range(g):
                h ^= chars[k : k + len(h)]
                h *= np.uint64(0x100000001B3)
            at = np.flatnonzero(place[: len(h)] >= g)
            ids.append((mixed(h[at], 3) % np.uint64(BUCKETS)).astype(np.int32))
            of.append(word[at])
    ids, of = np.concatenate(ids), np.concatenate(of)
    return ids[np.argsort(of, kind="stable")], np.bincount(of, minlength=n)


def repeats_before(codes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Which words equal the word before them in their document."""
    out = np.zeros(len(codes), bool)
    out[1:] = codes[1:] == codes[:-1]
    out[edges[:-1][edges[:-1] < len(codes)]] = False
    return out


def packed(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Buckets in two bytes each, counts in two or, where one is larger, four; the first byte tells which."""
    width = 4 if counts.max(initial=0) >= 1 << 16 else 2
    return bytes([width]) + ids.astype("<u2").tobytes() + counts.astype(f"<u{width}").tobytes()


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    width = raw[0]
    n = (len(raw) - 1) // (2 + width)
    return np.frombuffer(raw, "<u2", n, 1), np.frombuffer(raw, f"<u{width}", n, 1 + 2 * n).astype(np.int64)


def _document_features(batches):
    """Buckets with counts of each labelled document, packed."""
    for rb in text_batches(batches, BYTES):
        data, offsets = bytes_of(rb.column("text"))
        starts, stops, edges = word_spans(data, offsets)
        codes, words = coded(data, starts, stops)
        ids, first = word_features(words)
        again = np.concatenate([[0], np.cumsum(repeats_before(codes, edges))])
        out = []
        for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            c, times = np.unique(codes[a:z], return_counts=True)
            group, j = spread(first[c + 1] - first[c])
            b, back = np.unique(ids[first[c][group] + j], return_inverse=True)
            n = np.bincount(back, weights=times[group], minlength=len(b)).astype(np.int64)
            if k := int(again[z] - again[a]):
                b, n = np.append(b, BUCKETS), np.append(n, REPEAT * k)
            out.append(packed(b, n))
        yield pa.RecordBatch.from_arrays([rb.column("rank"), rb.column("y"), pa.array(out, pa.binary())], names=["rank", "y", "features"])


def trained(rows: list[tuple[int, bytes]], seed: int = 0) -> tuple[np.ndarray, float]:
    """One weight a bucket and a bias: the difference of the two classes' logits, after training on (label, features)."""
    rnd = np.random.default_rng(seed)
    vectors = rnd.uniform(-1 / DIMS, 1 / DIMS, (BUCKETS + 1, DIMS)).astype(np.float32)
    layer, bias = np.zeros((DIMS, 2), np.float32), np.zeros(2, np.float32)
    steps, done = max(1, EPOCHS * len(rows)), 0
    for _ in range(EPOCHS):
        for i in rnd.permutation(len(rows)):
            y, raw = rows[i]
            ids, counts = unpacked(raw)
            share = (counts / max(1, counts.sum())).astype(np.float32)
            rate = RATE * (1 - done / steps)
            done += 1
            hidden = share @ vectors[ids]
            logit = hidden @ layer + bias
            p = np.exp(logit - logit.max())
            g = p / p.sum()
            g[y] -= 1
            back = layer @ g
            layer -= rate * np.outer(hidden, g)
            bias -= np.float32(0.1 * rate) * g
            vectors[ids] -= np.float32(rate) * np.outer(share, back) * np.float32(len(ids)) ** 0.5
    d = layer[:, 1] - layer[:, 0]
    return vectors @ d, float(bias[1] - bias[0])


def _train(batches):
    rows = []
    for rb in batches:
        rows += zip(rb.column("rank").to_pylist(), rb.column("y").to_pylist(), rb.column("features").to_pylist(), strict=True)
    rows.sort()
    weights, bias = trained([r[1:] for r in rows])
    yield pa.RecordBatch.from_pydict({"weights": pa.array([weights.astype("<f4").tobytes()], pa.binary()), "bias": pa.array([bias])})


def fitted(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """Bucket weights and bias learned from labelled documents whose crc32(doc_id as text) mod 3 is not 1."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")  # labels of documents that are not here would use up the bound
    known = known.select("doc_id", "y", F.xxhash64("doc_id").alias("rank")).orderBy("rank", "doc_id").limit(train_rows)
    d = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(known), "doc_id").select("rank", "y", "text")
    got = d.mapInArrow(frugal(_document_features), "rank long, y int, features binary").repartition(1).mapInArrow(frugal(_train), "weights binary, bias double").collect()
    return (np.frombuffer(got[0].weights, "<f4"), got[0].bias) if got else (np.zeros(BUCKETS + 1, np.float32), 0.0)


def with_score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """docs with the column score (replaced if there): probability of label 1 from the text alone. A null or empty text has the score of the bias."""
    weights, bias = model
    names = [c for c in docs.columns if c != "score"]

    def run(batches):
        for rb in text_batches(batches, BYTES):
            data, offsets = bytes_of(rb.column("text"))
            starts, stops, edges = word_spans(data, offsets)
            codes, words = coded(data, starts, stops)
            value, n = (x[codes] for x in word_sums(words, weights))
            again = repeats_before(codes, edges)
            value, n = value + again * (REPEAT * float(weights[BUCKETS])), n + again * REPEAT
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (value, n)]
            value, n = (x[edges[1:]] - x[edges[:-1]] for x in sums)
            score = 1 / (1 + np.exp(-np.clip(value / np.maximum(n, 1) + bias, -500, 500)))
            yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in names), pa.array(score)], names=[*names, "score"])

    small_batches(docs.sparkSession)
    d = docs.select(*[F.col(f"`{c}`") for c in names])
    return d.mapInArrow(frugal(run), d.limit(0).withColumn("score", F.lit(0.0)).schema)


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs, with all their columns, whatever their names, whose score is at least so much. Null and empty texts have the score of the bias; repeated rows stay or go together."""
    model = fitted(docs, labels, train_rows)
    return apart(docs, ("text",), lambda d: with_score(d, model).where(F.col("score") >= least))


def quality_scores(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs.

    Rows without a label of 0 or 1 and a doc_id teach nothing; without any labelled row, each score is 0.5. A doc_id that is labelled twice takes the larger label.
    Repeated rows give repeated results; a null doc_id is not held out. Very long texts are scored whole; columns other than doc_id and text are not read.
    """
    model = fitted(docs, labels, train_rows)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    scored = with_score(docs.select("doc_id", whole_text().alias("text")), model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
