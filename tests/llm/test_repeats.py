import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from rillflow.llm import repeats as r


def brute_bytes(rows, length=100):
    seen, out = {}, []
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    for i in order:
        b = (rows[i][1] or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            x = b[s : s + length]
            if seen.setdefault(x, (rows[i][0], s)) != (rows[i][0], s):
                gone[s : s + length] = True
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((rows[i][0], len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def brute_words(rows, length=50):
    import re

    first, docs = {}, []
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        docs.append((i, w))
        for s in range(len(w) - length + 1):
            k = tuple(w[s : s + length])
            first[k] = min(first.get(k, float("inf")), -1 if i is None else i)
    out = []
    for i, w in docs:
        gone = set()
        for s in range(len(w) - length + 1):
            if first[tuple(w[s : s + length])] < (-1 if i is None else i):
                gone |= set(range(s, s + length))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, docs=60):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7))) for _ in range(400)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passages = [say(rnd.randint(40, 120)) for _ in range(5)]
    out = [None, "", " ", "a" * 700, "ab" * 400, "short"]
    for _ in range(docs):
        kind = rnd.random()
        if kind < 0.2 and len(out) > 10:
            out.append(rnd.choice(out))
        elif kind < 0.5 and len(out) > 10:
            x = (rnd.choice(out) or "").split(" ")
            for _ in range(3):
                x.insert(rnd.randint(0, len(x)), rnd.choice(words))
            out.append(rnd.choice([" ", "  ", "\n"]).join(x))
        else:
            out.append(say(rnd.randint(0, 150)) + "\n" + rnd.choice(passages) + "\n" + say(rnd.randint(0, 100)))
    ids = list(range(len(out)))
    rnd.shuffle(ids)
    return list(zip(ids, out, strict=True))


def run(spark, rows, f, parts=5):
    df = spark.createDataFrame([(*x, "z", 1) for x in rows], "doc_id long, text string, h string, n int").repartition(parts)
    return sorted(map(tuple, f(df).collect()), key=str)


def test_bytes_against_brute_force(spark):
    rows = corpus(1)
    assert run(spark, rows, r.substring_dedup) == brute_bytes(rows)


def test_words_against_brute_force(spark):
    rows = corpus(2)
    assert run(spark, rows, r.passage_dedup) == brute_words(rows)


def test_hot_minimisers_give_the_same(spark, monkeypatch):
    rows = corpus(3)
    h = [r.segments(r.batch_of(__import__("pyarrow").array([t or "" for _, t in rows]), w), w)[3] for w in (r.BYTES, r.WORDS)]
    for w, f, brute, hot in ((r.BYTES, r.substring_dedup, brute_bytes, h[0]), (r.WORDS, r.passage_dedup, brute_words, h[1])):
        monkeypatch.setattr(r, "hot_minimisers", lambda docs, w, hot=hot: np.unique(hot)[::2])
        assert run(spark, rows, f) == brute(rows)


def test_null_and_repeated_ids(spark):
    t = " ".join(f"w{i}" for i in range(80))
    rows = [(None, t), (5, t), (5, t), (7, t + " x"), (2, None)]
    got = {x[0]: x[2] for x in run(spark, rows, r.passage_dedup)}
    assert got == {None: 0, 5: 80, 7: 80, 2: 0}
    rows = [(5, t), (5, t), (7, t)]
    assert sorted(x[2] for x in run(spark, rows, r.substring_dedup)) == [0, 0, len(t)]
    two = [(5, t), (5, "other " + t)]
    assert sorted(x[2] > 0 for x in run(spark, two, r.substring_dedup)) == [False, True]


def test_argmin_by_blocks(monkeypatch):
    values = np.random.default_rng(4).integers(0, 2**63, 1000).astype(np.uint64)
    values[::3] = 5  # equal ones: the first counts
    whole = [r.sliding_argmin(values, w) for w in (1, 2, 27, 77, 300)]
    for size in (1, 50, 77, 128, 999):
        monkeypatch.setattr(r, "BLOCK", size)
        assert all(np.array_equal(r.sliding_argmin(values, w), x) for w, x in zip((1, 2, 27, 77, 300), whole, strict=True))


def test_argmin_beyond_the_places():
    values = np.full((1 << 24) + 1000, 2**62, np.uint64)
    values[(1 << 24) + 500] = 1 << 30
    got = r.sliding_argmin(values, 77)
    assert len(got) == len(values) - 76 and got[-1] == len(values) - 77 and (got[(1 << 24) + 424 : (1 << 24) + 501] == (1 << 24) + 500).all()


def test_empty_table(spark):
    assert run(spark, [], r.substring_dedup) == []
    assert run(spark, [], r.passage_dedup) == []


@given(st.lists(st.text(alphabet="ab", min_size=110, max_size=160), min_size=1, max_size=5))
@settings(deadline=None, max_examples=60)
def test_deep_shallow_sorting_finds_equal_strings(texts):
    raw = "".join(texts).encode()
    data = np.frombuffer(raw, np.uint8)
    places = np.arange(len(raw) - 99)
    at, cls = r.equal_bytes(data, places, 100)
    groups = {}
    for a, c in zip(at.tolist(), cls.tolist(), strict=True):
        groups.setdefault(c, []).append(a)
    got = sorted(sorted(x) for x in groups.values())
    want = {}
    for p in places.tolist():
        want.setdefault(raw[p : p + 100], []).append(p)
    assert got == sorted(x for x in want.values() if len(x) > 1)
