import math
import random
from collections import Counter, defaultdict

import pytest

from rillflow.llm import mixing as m


def corpus(spark, seed=1):
    rnd = random.Random(seed)
    rows = [(i, " ".join("w" * rnd.randint(1, 30)), rnd.choice(["a"] * 12 + ["b"] * 4 + ["c", None])) for i in range(2000)]
    rows = [(i, t if rnd.random() > 0.01 else None, s) for i, t, s in rows] + [(5000, "", "empty"), (5001, "x y", "one"), (5001, "x y", "one")]
    return rows, spark.createDataFrame([(*r, 9, "z") for r in rows], "doc_id long, text string, source string, n_tokens int, epoch string")


def words(t):
    return len((t or "").split())


def test_every_document_is_kept_and_repeats_are_bounded(spark):
    rows, df = corpus(spark)
    got = m.mixed_sources(df, max_repeat=3.0).collect()
    copies, avail, used = Counter((r.doc_id, r.text, r.source) for r in got), Counter(), Counter()
    for _, t, s in rows:
        avail[s] += words(t)
    for r in got:
        used[r.source] += r.n_tokens
        assert r.n_tokens == words(r.text)
    assert set(copies) == {tuple(r) for r in rows}
    rate = {s: used[s] / avail[s] for s in avail if avail[s]}
    assert max(rate.values()) <= 3.0 and min(rate.values()) == 1.0 and rate["one"] > 2.4
    assert copies[(5000, "", "empty")] == 1
    # documents of a block move together in whole epochs
    where = defaultdict(set)
    for r in got:
        where[(r.source, r.epoch, r.block_rank)].add(r.doc_id)
    assert {e for _, e, _ in where} == {0, 1, 2}


def test_budget_and_entropy(spark):
    rows, df = corpus(spark, 2)
    avail = Counter()
    for _, t, s in rows:
        avail[s] += words(t)
    total = sum(avail.values())
    share = [v / total for v in avail.values() if v]
    h1 = -sum(p * math.log(p) for p in share)
    goal = (h1 + math.log(len(share))) / 2
    got = m.mixed_sources(df, max_repeat=None, target_entropy=goal, budget=total // 2).collect()
    used = Counter()
    for r in got:
        used[r.source] += r.n_tokens
    n = sum(used.values())
    assert total // 2 - 200 <= n <= total // 2 + 3
    assert abs(-sum(v / n * math.log(v / n) for v in used.values() if v) - goal) < 0.05
    assert max(Counter((r.doc_id, r.epoch) for r in got if r.doc_id < 5000).values()) == 1


def test_arguments_and_empty_table(spark):
    _, df = corpus(spark)
    with pytest.raises(ValueError):
        m.mixed_sources(df, max_repeat=2.0, target_entropy=1.0)
    assert m.mixed_sources(df.limit(0)).count() == 0


def test_one_source(spark):
    df = spark.createDataFrame([(1, "a b", "s"), (2, None, "s")], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.epoch) for r in m.mixed_sources(df).collect()) == [(1, 0), (2, 0)]
