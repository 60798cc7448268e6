import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from rillflow.llm import lm_scoring as m

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def base(rows):
    def words(t):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]

    held = {i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    c = Counter()
    for i, t in rows:
        if not held[i]:
            c.update([*words(t), "\n"])
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        w = [*words(t), "\n"]
        out.append((i, held[i], len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)))
    return sorted(out, key=str)


@pytest.mark.parametrize("vocabulary", [1 << 18, 50])
def test_base_against_brute_force(spark, monkeypatch, vocabulary):
    monkeypatch.setattr(m, "VOCABULARY", vocabulary)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60).collect()]
    rows += [(None, "a B c"), (1000, None), (1001, ""), (1002, "x " * 5000), (1003, "é" * 3000), (1004, "once more"), (1004, "once more"), (1004, "another once")]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, mark string, n int").repartition(3)
    got = m.lm_scores(df, PATH).collect()
    assert sorted(((*tuple(r)[:5], round(r.base_score, 6)) for r in got), key=str) == base(rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    same = [round(r.score, 3) for r in got if r.doc_id == 1004]
    assert len(set(same)) == 2


def test_model_beats_the_word_base_on_held_out_texts(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = m.lm_scores(df, PATH).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_classes_and_context_are_not_cut():
    counts = np.zeros(m.IDS)
    counts[:40000] = np.arange(40000)[::-1] + 1
    sizes = np.bincount(m.Classes(counts).of, minlength=256)
    assert (sizes > 0).all() and (sizes[:200] == 1).all() and sizes[255] == 1
    assert m.STEP * 2 <= m.SPAN


def test_training_helps_on_held_out_texts(spark, monkeypatch):
    """Against the first weights, which give each class its share. (The word base is better than the model on these invented texts; the README says so.)"""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    total = lambda: sum(r.score for r in m.lm_scores(df, PATH).where("held_out").collect())
    trained = total()
    monkeypatch.setattr(m, "ROUNDS", 0)
    untrained = total()
    assert trained > untrained + 0.05 * abs(untrained)


def test_each_window_of_each_training_document_is_in_one_round():
    texts = ["a few words", "", "one more text that is somewhat longer than a single window of subwords, so that it has several of them", *(f"short {k}" for k in range(200))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc", "text"])
    ids, edges, *_ = m.sequences(pa.array(texts), PATH)
    want = Counter(tuple(np.pad(ids[a:z][k : k + m.SPAN], (0, max(0, k + m.SPAN - (z - a))), constant_values=m.END_ID)) for a, z in zip(edges[:-1], edges[1:], strict=True) for k in range(0, z - a, m.SPAN))
    got = Counter()
    for rb in m._counts(PATH)(iter([batch])):
        for r in rb.to_pylist():
            if r["kind"] == 3:
                assert 0 <= r["h"] < m.ROUNDS
                got.update(map(tuple, np.frombuffer(r["x"], np.uint16).reshape(-1, m.SPAN + 1)[:, 1:].astype(int)))
    assert got == want


def test_gradient_against_differences():
    rnd = np.random.default_rng(1)
    flat = m.first_weights(np.full(m.CLASSES, 1 / m.CLASSES)).astype(np.float64)
    x, y = rnd.integers(0, m.CLASSES, (3, m.SPAN)), rnd.integers(0, m.CLASSES, (3, m.SPAN))
    _, g = m.gradient(flat, x, y)
    for i in rnd.choice(np.flatnonzero(np.abs(g) > 1e-4), 40, replace=False):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        assert abs((m.gradient(up, x, y)[0] - m.gradient(down, x, y)[0]) / 2e-5 - g[i]) < 1e-4


def test_scores_are_causal_and_each_token_counts_once():
    rnd = np.random.default_rng(2)
    w = m.views(m.first_weights(np.full(m.CLASSES, 1 / m.CLASSES)))
    lengths = np.array([0, 1, 5, 16, 17, 24, 25, 100, 0])
    edges = np.concatenate([[0], np.cumsum(lengths)])
    x = rnd.integers(0, m.CLASSES, edges[-1])
    y = rnd.integers(0, m.CLASSES, edges[-1])
    got = m.log_probabilities(w, x, y, edges)
    assert (got < 0).all()
    for a, z in zip(edges[:-1], edges[1:], strict=True):
        for i in range(a, z):
            k = 0 if i - a < m.SPAN else ((i - a - m.SPAN) // m.STEP + 1) * m.STEP
            window = np.resize(x[a + k : min(z, a + k + m.SPAN)], m.SPAN)
            h, _ = m.forward(w, window[None])
            logits = h[0, i - a - k] @ w["u"] + w["bu"]
            p = logits[y[i]] - np.log(np.exp(logits).sum())
            assert abs(p / math.log(10) - got[i]) < 1e-4


def test_class_probabilities_sum_to_one():
    counts = np.zeros(m.IDS)
    counts[:3000] = np.arange(3000)[::-1]
    c = m.Classes(counts)
    total = np.bincount(c.of, weights=10**c.within, minlength=m.CLASSES)
    assert np.allclose(total[np.unique(c.of)], 1)


def spelled_by_hand(texts, scored):
    """The speller's probabilities of the tokens of each text of scored, by its definition, from words of texts."""
    subs = lambda w: tuple(m._bpe(PATH)[0].encode_ordinary(" " + w))
    words, begun, ends = Counter(w for t in texts for w in t.split()), Counter(), len(texts)
    for w, n in words.items():
        for j in range(1, len(subs(w)) + 1):
            begun[subs(w)[:j]] += n
    total = sum(words.values()) + ends
    out = []
    for t in scored:
        over = 1.0
        for w in t.split():
            x = subs(w)
            out.append(over * begun[x[:1]] / total)
            out += [begun[x[: j + 1]] / begun[x[:j]] if begun[x[:j]] else 0.0 for j in range(1, len(x))]
            over = words[w] / begun[x] if begun[x] else 0.0
        out.append(over * ends / total)
    return out


def test_speller_against_brute_force():
    texts = ["an unfathomable unfathomed thing", "", "un unfathomable xyzzyx xyzzy", "an an thing"]
    scored = [*texts, "xyzzyx", "never seenword an", "", "unfathomed an"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc", "text"])
    got = [r for rb in m._counts(PATH)(iter([batch])) for r in rb.to_pylist()]
    kind = lambda k: [np.array([r[c] for r in got if r["kind"] == k], np.int64) for c in ("h", "n")]
    words = kind(0)
    v = m.Vocabulary(*words, int(words[1].sum()) + len(texts), len(words[0]) + 1, len(texts))
    ids, edges, codes, found, at, parts = m.sequences(pa.array(scored), PATH)
    p, n = m.spelled(parts, codes, at, v.find(m.signed(m.hashed(found))), m.Counts(*kind(4)), v)
    assert np.allclose(p, spelled_by_hand(texts, scored)) and len(p) == len(n) == len(ids)
    assert (n[edges[:-1]] == v.tokens).all() and n[edges[5] - 1] == 1 and (p[n == 0] == 0).all()


def test_gates_average_probabilities_of_texts():
    rnd = np.random.default_rng(3)
    p, q, n, edges = rnd.random(9) + 1e-3, rnd.random(9), rnd.integers(0, 4, 9), np.array([0, 1, 4, 9])
    share = lambda g, i: (1 - g) * n[i] / (n[i] + 1)
    want = [math.log10(sum(math.prod((1 - share(g, i)) * p[i] + share(g, i) * q[i] for i in range(a, z)) for g in m.GATES) / len(m.GATES)) for a, z in zip(edges[:-1], edges[1:], strict=True)]
    assert np.allclose(m.gated(np.log10(p), q, n, edges), want)


def test_scores_do_not_depend_on_how_many_counts_a_task_holds(spark, monkeypatch):
    """Prefixes and words that are not held by every task had no share of the speller."""
    monkeypatch.setattr(m, "ROUNDS", 0)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60).collect()]
    rows += [(None, "a B c"), (1000, None), (1001, "unfathomable"), (1002, "x " * 500), (1003, "é" * 3000), (1004, "once more"), (1004, "once more"), (1005, "neverseen wordings neverseen"), (1006, "é" * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {}
    for vocabulary in (1 << 18, 50, 0):
        monkeypatch.setattr(m, "VOCABULARY", vocabulary)
        got[vocabulary] = sorted(((str(r.doc_id), r.n_tokens, r.n_known, r.score) for r in m.lm_scores(df, PATH).collect()))
    for other in (50, 0):
        assert [x[:3] for x in got[other]] == [x[:3] for x in got[1 << 18]]
        assert np.allclose([x[3] for x in got[other]], [x[3] for x in got[1 << 18]], rtol=1e-5, atol=1e-3)


def test_a_block_asks_once_for_each_count_that_no_task_holds(monkeypatch):
    """Each occurrence of a word whose counts were not held was a row of its own, with its tokens' probabilities."""
    monkeypatch.setattr(m, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("P", (), {"partitionId": lambda self: 3})())}))
    texts = ["unfathomable unfathomed " * 50, None, "unfathomable thing " * 40]
    batch = pa.RecordBatch.from_arrays([pa.array([1, None, 2], pa.int64()), pa.array([False] * 3), pa.array(["" if t is None else t for t in texts])], names=["doc_id", "held_out", "text"])
    none = [np.zeros(0, np.int64)] * 2
    v, begun = m.Vocabulary(*none, 10, 3, 3), m.Counts(*none)
    v.whole = begun.whole = False
    rows = [r for rb in m._asked(PATH, v, begun)(iter([batch])) for r in rb.to_pylist()]
    assert [(r["doc_id"], r["text"]) for r in rows if r["h"] is None] == [(1, texts[0]), (None, ""), (2, texts[2])]
    asked = [(r["kind"], r["h"]) for r in rows if r["h"] is not None]
    subs = {w: m._bpe(PATH)[0].encode_ordinary(" " + w) for w in ("unfathomable", "unfathomed", "thing")}
    begins = {tuple(x[:j]) for x in subs.values() for j in range(2, len(x) + 1)}
    assert len(asked) == len(set(asked)) == 3 + len(begins) and {r["block"] for r in rows} == {3 << 32}


def test_hidden_rows_are_made_once_for_each_token(monkeypatch):
    """Windows overlap, and hidden rows of the places that the window before had scored were made again: about twice as many rows as tokens."""
    rnd, made, rows = np.random.default_rng(4), [], m.hidden_rows
    monkeypatch.setattr(m, "hidden_rows", lambda *a: made.append((out := rows(*a)).size // m.DIMS) or out)
    w = m.views(m.first_weights(np.full(m.CLASSES, 1 / m.CLASSES)))
    edges = np.cumsum([0, 400, 0, 5, 1000, 16, 17])
    m.log_probabilities(w, rnd.integers(0, m.CLASSES, edges[-1]), rnd.integers(0, m.CLASSES, edges[-1]), edges)
    assert edges[-1] <= sum(made) <= edges[-1] + m.SPAN * len(edges)


def test_gradient_and_scores_beyond_the_range_of_exponentials():
    rnd = np.random.default_rng(5)
    flat = m.first_weights(np.full(m.CLASSES, 1 / m.CLASSES))
    m.views(flat)["u"][:] *= 40
    m.views(flat)["bu"][:7] = 300
    x, y = rnd.integers(0, m.CLASSES, (5, m.SPAN)), rnd.integers(0, 7, (5, m.SPAN))
    loss, g = m.gradient(flat, x, y)
    want, wanted = m.gradient(flat.astype(np.float64), x, y)
    assert abs(loss - want) < 1e-3 * want and np.abs(g - wanted).max() < 1e-3 * np.abs(wanted).max()
    edges = np.array([0, m.SPAN])
    got = m.log_probabilities(m.views(flat), x[0], y[0], edges)
    logits = m.forward(m.views(flat.astype(np.float64)), x[:1])[0][0] @ m.views(flat)["u"] + m.views(flat)["bu"]
    top = logits.max(axis=1)
    assert np.allclose(got, (logits[np.arange(m.SPAN), y[0]] - top - np.log(np.exp(logits - top[:, None]).sum(axis=1))) / math.log(10), rtol=1e-3, atol=1e-2)


def test_subwords_are_those_of_each_word_whatever_a_worker_remembers():
    """Words are looked up by hash, all at once, where each was looked up in Python."""
    kept, bpe = m.Subwords(PATH, most=6), m._bpe(PATH)[0]
    for text in ("some words here", "here are some others", "unfathomable é\u00a0é x", "here some x", "", "a b c d e f g here unfathomable", "x" * 300 + " here"):
        _, words, _ = m.batch_words(pa.array([text]))
        flat, first, count = kept.of(words, m.hashed(words))
        assert [flat[a : a + n].tolist() for a, n in zip(first, count, strict=True)] == [bpe.encode_ordinary(" " + w.decode()) for w in words.to_pylist()]


def test_empty_table(spark):
    assert m.lm_scores(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
