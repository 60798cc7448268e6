import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rillflow.llm import quality_classifier as q


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = q.quality_scores(docs, labels).join(labels, "doc_id").where("held_out")
    right, n = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert n > 50 and right > 0.95


def test_edge_rows(spark):
    rows = [(None, "a b"), (1, None), (2, ""), (3, "x" * 50_000), (4, "w " * 20_000), (4, "w " * 20_000)]
    docs = spark.createDataFrame([(*r, 7.0, 1) for r in rows], "doc_id long, text string, score double, y int")
    labels = spark.createDataFrame([(1, 0), (3, 1), (3, 1), (4, None), (None, 1), (9, 5)], "doc_id long, quality int")
    out = q.quality_scores(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    by = {}
    for r in out:
        assert by.setdefault(r.doc_id, r.score) == r.score
    assert by[1] == by[2]


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in q.quality_scores(docs, none).collect()] == [0.5]
    assert q.quality_scores(docs.limit(0), none).count() == 0


def test_training_bound(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    assert q.fitted(docs, labels, 3)[1] != q.fitted(docs, labels)[1]


def test_packed_features_come_back():
    for ids, counts in (([], []), ([0, 5, 32768], [1, 65535, 2]), ([1, 32768], [70_000, 3])):
        got = q.unpacked(q.packed(np.array(ids, np.int64), np.array(counts, np.int64)))
        assert [x.tolist() for x in got] == [ids, counts]


def test_features_do_not_depend_on_how_many_words_go_at_once(monkeypatch):
    words = pa.array([f"wörd{k * k}".encode() for k in range(500)] + [b"", b"\xff>", b"x" * 3000], pa.large_binary())
    ids, first = q.word_features(words)
    monkeypatch.setattr(q, "AT_ONCE", 7)
    few_ids, few_first = q.word_features(words)
    assert np.array_equal(ids, few_ids) and np.array_equal(first, few_first)
    assert first[-1] == len(ids) and len(first) == len(words) + 1


def test_a_words_sum_is_that_of_its_features(monkeypatch):
    """Features of all words of a batch, and their weights, were held at once."""
    words = pa.array([f"wörd{k * k}".encode() for k in range(500)] + [b"", b"\xff>", b"x" * 3000], pa.large_binary())
    weights = np.random.default_rng(0).normal(size=q.BUCKETS + 1).astype(np.float32)
    ids, first = q.word_features(words)
    held, known = [], q._features_of
    monkeypatch.setattr(q, "_features_of", lambda w: held.append(len(w)) or known(w))
    monkeypatch.setattr(q, "AT_ONCE", 7)
    sums, n = q.word_sums(words, weights)
    assert np.array_equal(n, np.diff(first)) and np.allclose(sums, [weights[ids[a:z]].astype(float).sum() for a, z in zip(first[:-1], first[1:], strict=True)])
    assert max(held) == 7 and [len(x) for x in q.word_sums(words[:0], weights)] == [0, 0]


def test_batches_of_long_texts_stay_small(spark):
    """Only rows of a batch were bounded: 60 texts of 300 KB came in one batch."""
    q.small_batches(spark)
    docs = spark.range(0, 60, 1, 1).select(F.repeat(F.lit("abc "), 75_000).alias("text"))
    sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
    assert sum(r.n for r in sizes) >= 60 * 300_000 and max(r.n for r in sizes) <= 3 << 20
