import random
import re

import pytest

from rillflow.llm import ngram_join as j
from rillflow.llm.components import components


def brute(rows, percent=85, size=4):
    sets = []
    for i, t in rows:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        sets.append((i, {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()))
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y) or x and y and rows[a][0] == rows[b][0]:
                up[root(a)] = root(b)
    key = lambda i: (i is not None, i or 0)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i, key=key)
    return sorted(((i, len(s), least[root(k)]) for k, (i, s) in enumerate(sets)), key=str)


def corpus(seed, n=120):
    rnd = random.Random(seed)
    v = [f"w{i}" for i in range(300)]
    say = lambda k: " ".join(rnd.choice(v) for _ in range(k))
    line = say(12)
    out = [None, "", "a", "A", "a b", "a b c", "a b c d", "x " * 50, "x " * 60, " ".join(["x y z"] * 30)]
    base = say(120)
    for _ in range(n):
        kind = rnd.random()
        if kind < 0.3:
            w = base.split()
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(v)
            out.append(" ".join(w))
        elif kind < 0.5:
            w = (rnd.choice(out) or "").split()
            if w:
                w[rnd.randrange(len(w))] = rnd.choice(v).upper()
            out.append("\n".join(w))
        elif kind < 0.6:
            out.append(rnd.choice(out))
        else:
            out.append(line + "\n" + say(rnd.randint(1, 80)))
    ids = list(range(len(out)))
    rnd.shuffle(ids)
    return list(zip(ids, out, strict=True))


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n int, s1 int").repartition(4)
    return sorted(map(tuple, j.jaccard_components(df).collect()), key=str)


@pytest.mark.parametrize("small", [64, 3, 0])
def test_against_brute_force(spark, monkeypatch, small):
    """With small groups, with most groups large, and with large groups only."""
    monkeypatch.setattr(j, "SMALL", small)
    rows = corpus(small + 2)
    assert run(spark, rows) == brute(rows)


def test_hot_shingles_and_lookup_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(j, "HOT_LEVEL", 2)
    monkeypatch.setattr(j, "BROADCAST_MOST", 0)
    rows = corpus(5)
    assert run(spark, rows) == brute(rows)


def test_a_very_long_text(spark):
    rnd = random.Random(3)
    w = [f"w{rnd.randrange(10**6)}" for _ in range(60_000)]
    rows = [(1, " ".join(w)), (2, " ".join(w[:30_000] + ["x"] + w[30_000:])), (3, " ".join(w[:40_000])), (4, "y" * 3_000_000), (5, "Y" * 3_000_000 + " "), (6, "y" * 2_999_999)]
    assert run(spark, rows) == brute(rows)


def test_null_and_repeated_ids(spark):
    t = " ".join(f"w{i}" for i in range(40))
    rows = [(None, t), (4, t), (9, t + " x"), (9, "p q r s t"), (7, "p q r s t"), (8, None)]
    assert run(spark, rows) == brute(rows)


def test_one_of_each_keeps_what_has_no_copy(spark):
    t, u, v = (" ".join(f"{x}{i}" for i in range(40)) for x in "tuv")
    rows = [(None, t), (None, u), (None, "z"), (7, ""), (7, "real text"), (9, v), (9, "p q r s t"), (3, t), (12, v), (5, "p q r s t"), (None, u), (None, None)]
    got = j.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    want = [(None, t), (None, u), (None, "z"), (7, ""), (7, "real text"), (9, v), (5, "p q r s t"), (None, None)]
    assert got.columns == ["doc_id", "text"] and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(10, 40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.doc: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 10 for i in range(10, 41)}, **{100 + i: 100 for i in range(50)}}
