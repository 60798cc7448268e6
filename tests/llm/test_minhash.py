import random

import numpy as np
import pytest
from test_ngram_join import brute, corpus

from rillflow.llm import minhash as m


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n int, key int").repartition(4)
    return sorted(map(tuple, m.near_duplicates(df).collect()), key=str)


def want(rows):
    return sorted(((i, n, c, i == c or i is None) for i, n, c in brute(rows, size=5)), key=str)


@pytest.mark.parametrize("seed", [75, 11])
def test_against_brute_force(spark, seed):
    rows = corpus(seed, 160)
    assert run(spark, rows) == want(rows)


def test_links_that_no_hub_has(spark):
    """Texts that change step by step: each is near the next few only, though most share buckets with far ones."""
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    rows = [(1000, "q " * 7)]
    for k in range(60):
        words[rnd.randrange(200)] = f"x{k}"
        rows.append((k, " ".join(words)))
    assert run(spark, rows) == want(rows)


def test_edges(spark):
    t = " ".join(f"w{i}" for i in range(40))
    assert run(spark, []) == []
    rows = [(4, t), (4, t), (9, t + " x"), (9, "p q r s t u v"), (7, "p q r s t u v"), (8, None), (6, ""), (5, " \n"), (3, "A b"), (2, "a B"), (1, "y" * 2_000_000)]
    assert run(spark, rows) == want(rows)
    got = {(r.doc_id, r.component_id, r.kept) for r in m.near_duplicates(spark.createDataFrame([(None, t), (5, t), (None, None)], "doc_id long, text string")).collect()}
    assert got == {(None, None, True), (5, None, False)}


def test_signatures_agree_as_sets_overlap():
    rnd = np.random.default_rng(1)
    pool = rnd.integers(0, 2**64, (40, 90), dtype=np.uint64)
    sets = [np.unique(np.concatenate([p[:85], x])) for p in pool for x in (p[85:], rnd.integers(0, 2**64, 5, dtype=np.uint64))]
    s = m.signatures(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])]))
    share = (s[::2] == s[1::2]).mean()
    assert abs(share - 85 / 95) < 0.02
    one = m.signatures(np.array([7, 9], np.uint64), np.array([0, 1, 1, 2]))
    assert (one[0] == 7).all() and (one[1] == 0).all() and (one[2] == 9).all()
    k = m.band_keys(s)
    assert k.shape == (80, m.BINS // m.ROWS) and (k[::2] == k[1::2]).any(1).all()


def test_nodes_of_pairs_take_no_row_a_side(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 2), (3, 1), (5, 5)], "a long, b long")
    got = m.ends_of(pairs)
    assert sorted(r.node for r in got.collect()) == [1, 2, 3, 5]
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    plan = m.open_nodes(spark.createDataFrame([(1, 2, 2), (1, 3, 3)], "a long, b long, what int"), spark.createDataFrame([(1, 3)], "a long, b long"))
    assert sorted(r.node for r in plan.collect()) == [1, 2, 3] and "Generate" not in plan._jdf.queryExecution().optimizedPlan().toString()
