import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rillflow.llm import quality_rules as q


def brute(text):
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(grams)
    rep = {i + k for i, g in enumerate(grams) if c[g] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep)


TEXTS = [None, "", " \n ", "a", "a b c", "a b c a b c", "x x x x", "é# ü|\n\né# ü|\n é# ü|", "a\x0bb\x0cc\rd", "the of " * 40, "w " * 20000, "one two three " * 3 + "four one two three"]


def test_counts_against_brute_force(spark):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS * 2)], "doc_id int, text string, n_words int")
    rows = q.quality_rules(df).collect()
    assert len(rows) == 2 * len(TEXTS)
    for r in rows:
        want = brute(TEXTS[r.doc_id % len(TEXTS)])
        assert tuple(r)[1:6] == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


def test_own_thresholds_and_unknown_metric(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)))], "doc_id int, text string")
    assert q.quality_rules(df, [("n_words", 10, None)]).first().kept
    assert not q.quality_rules(df, [("n_words", None, 59)]).first().kept
    with pytest.raises(ValueError):
        q.compiled([("nothing", 1, 2)], {"n_words": F.col("n_words")})


def test_empty_table(spark):
    assert q.quality_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0
