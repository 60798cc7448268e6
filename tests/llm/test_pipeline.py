import zlib
from collections import Counter

import corpus_pipeline as p
import numpy as np
from test_dac import plain
from test_decontaminate import brute as brute_items
from test_ngram_join import brute as brute_links

from rillflow.llm.quality_classifier import quality_scores

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs, labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    columns = docs.columns
    good = {r.doc_id for r in quality_scores(docs, labels).where("predicted = 1").collect()}
    one = p.classify(spark, docs, SF)
    assert one.columns == columns and {r.doc_id for r in one.collect()} == good and 0 < len(good) < docs.count()
    two = p.deduplicate(spark, one, SF)
    want = {i for i, _, c in brute_links([(r.doc_id, r.text) for r in one.collect()], p.PERCENT, p.SHINGLE) if i == c}
    assert two.columns == columns and sorted(r.doc_id for r in two.collect()) == sorted(want) and len(want) < len(good)
    three = p.decontaminate_(spark, two, SF)
    bad = {x[0] for x in brute_items([(r.doc_id, r.text) for r in two.collect()], [(r.item_id, r.text) for r in items.collect()]) if x[5]}
    assert three.columns == columns and sorted(r.doc_id for r in three.collect()) == sorted(want - bad) and bad
    four = p.mix(spark, three, SF)
    rows = four.collect()
    assert four.columns == columns and {r.doc_id for r in rows} == want - bad and max(Counter(r.doc_id for r in rows).values()) <= 2
    five = p.tokenize(spark, four, SF).orderBy("start").collect()
    rows.sort(key=lambda r: r.doc_id)
    start = 0
    for r, d, ids in zip(five, rows, plain([d.text for d in rows]), strict=True):
        ids = [*ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_near_copies_by_five_words_and_80_percent(spark):
    w = [f"w{i}" for i in range(120)]
    v = [f"v{i}" for i in range(49)]
    texts = [w[:100], w, v, [*v[:20], "other", *v[21:]], [f"u{i}" for i in range(60)]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in p.deduplicate(spark, docs, SF).collect()) == [0, 2, 4]


def test_edge_rows_and_clashing_columns(spark):
    """Null and empty texts, null, shared and repeated ids, a long text, and columns that operators use themselves."""
    extra = ["score", "n_tokens", "epoch", "block_rank", "n_words", "contaminated", "_doc", "_text", "_s", "rank", "a.b"]
    some = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40").collect()]
    rows = [*some, (None, None, None), (None, "", "web"), (None, "a few words", None), (7, "a shared id", "web"), *some[:2], (90001, "word " * 40_000, "web")]
    docs = spark.createDataFrame([(i, t, s, *(f"{c}-{k}" for c in extra)) for k, (i, t, s) in enumerate(rows)], "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in extra))
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        got = {tuple(r) for r in out.collect()}
        assert got and got <= {tuple(r) for r in docs.collect()}
    assert p.tokenize(spark, docs, SF).count() == len(rows)


def test_run(spark):
    got = p.run(spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 50


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, docs, SF).count() == 0
