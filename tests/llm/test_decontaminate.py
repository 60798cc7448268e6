import hashlib
import random
import re

import pytest

from rillflow.llm import decontaminate as d


def words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(docs, items, window=10):
    ws = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            ws.setdefault(tuple(w[k : k + window]), set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for x, names in ws.items():
            for a in range(len(w) - len(x) + 1):
                if tuple(w[a : a + len(x)]) == x:
                    hit |= set(range(a, a + len(x)))
                    found |= names
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def tables(seed):
    rnd = random.Random(seed)
    v = ["a", "B", "cé", "d4", "E", "ünï", "g-h"]
    say = lambda n: rnd.choice([" ", "  ", ", "]).join(rnd.choice(v) for _ in range(n))
    items = [(1, say(14)), (2, say(10)), (10, "One"), (11, "two three"), (12, None), (13, "!!"), (None, say(11)), (14, "a A a a a a a a a a a")]
    items.append((15, items[0][1]))
    docs = [(None, None), (1, ""), (2, "ONE x"), (3, "two, three two three"), (4, "a " * 500), (5, "é" * 3000)]
    for i in range(6, 60):
        docs.append((i, say(rnd.randint(0, 40)) + " " + (rnd.choice(items)[1] or "") + " " + say(rnd.randint(0, 30))))
    return docs + docs[2:4], items


@pytest.mark.parametrize("block", [50_000, 3])
def test_against_brute_force(spark, block):
    docs, items = tables(4)
    a = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, items string")
    b = spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, w string")
    assert sorted(map(tuple, d.contamination(a, b, block=block).collect()), key=str) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = tables(5)
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert d.contamination(a.limit(0), b).count() == 0
    assert d.contamination(a, b.limit(0)).where("contaminated").count() == 0


def test_one_worker_beside_a_task(spark):
    """The hits of the last block are summed where they are found."""
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "x y")], "doc_id long, text string")
    items = spark.createDataFrame([("p", "b c d e f g h i j k"), ("q", "x y"), ("r", "w v u")], "item_id string, text string")
    for block, workers in ((50_000, 1), (1, 3)):
        df = d.contamination(docs, items, block=block)
        assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") <= workers
        assert sorted((r.doc_id, r.n_hit, r.n_items) for r in df.collect()) == [(1, 10, 1), (2, 2, 1)]
    assert d.contamination(docs, items.where("false")).where("contaminated").count() == 0
