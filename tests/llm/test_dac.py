import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rillflow.llm import dac

PATH = public_tokenizers.path("byte_bpe_50k.json")


@given(st.lists(st.one_of(st.integers(0, 255), st.integers(0, 70_000), st.integers(0, 2**32 - 1)), max_size=3000))
@settings(deadline=None, max_examples=40)
def test_segment_round_trip_and_random_access(ids):
    x = np.array(ids, np.uint32)
    blob = dac.packed(x)
    assert np.array_equal(dac.unpacked(blob), x)
    places = np.arange(len(x))[::-7]
    assert np.array_equal(dac.at(blob, places), x[places])


def test_random_access_to_large_ids():
    x = np.array([256, 1, 70_000, 50_256, 2**32 - 1, 255] * 700, np.uint32)
    places = np.random.default_rng(1).permutation(len(x))
    assert np.array_equal(dac.at(dac.packed(x), places), x[places])


def test_cached_pieces_are_dropped_and_kept(monkeypatch):
    """Batches that overflow the cache give the same ids."""
    monkeypatch.setitem(dac._KEPT, PATH, dac.Pieces(PATH, most=8))
    for k in range(6):
        check([" ".join(f"w{j}" for j in range(k, k + 7)), "the same words in each batch"])


def plain(texts):
    t = Tokenizer.from_file(PATH)
    return [e.ids for e in t.encode_batch(["" if x is None else x for x in texts], add_special_tokens=False)]


def check(texts):
    ids, counts = dac.encoded(pa.array(texts, pa.string()), PATH)
    ends = np.cumsum(counts)
    assert [ids[e - c : e].tolist() for e, c in zip(ends, counts, strict=True)] == plain(texts)


@given(st.lists(st.text(alphabet=st.sampled_from(list("ab'sé \n\t\r\x0b\x1c  ​　\u0085!7<|>中")), max_size=30), max_size=6))
@settings(deadline=None, max_examples=200)
def test_encoding_equals_the_library(texts):
    check(texts)


def test_encoding_edge_texts():
    check(["", None, " ", "\n\n", "a", " a", "a ", "it's  a\n\n b", "<|endoftext|> x", "a <|endoftext|> b  c", "<|endoftext|><|endoftext|>", "<|endof", "text|> <|endoftext|>\n", "x" * 3000, "ab " * 5000, "a   b c", "﻿a b"])


def test_files(spark, tmp_path):
    rows = [(3, "c c"), (1, None), (2, ""), (2, "z"), (None, "n"), (3, "c c"), (9, "long " * 20000)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, start int")
    got = [tuple(r) for r in dac.token_output(df, PATH, str(tmp_path / "t")).orderBy("start").collect()]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or ""))
    want, start = [], 0
    for (i, _), ids in zip(order, plain([r[1] for r in order]), strict=True):
        ids = [*ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    flat = [x for ids in plain([r[1] for r in order]) for x in [*ids, 0]]
    places = spark.createDataFrame([(0,), (5,), (5,), (len(flat) - 1,), (len(flat),)], "place long")
    assert sorted(map(tuple, dac.tokens_at(spark, str(tmp_path / "t"), places).collect())) == [(i, flat[i]) for i in (0, 5, 5, len(flat) - 1)]
    every = spark.range(len(flat)).select(F.col("id").alias("place"))
    assert [r.id for r in dac.tokens_at(spark, str(tmp_path / "t"), every).orderBy("place").collect()] == flat


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert dac.token_output(df, PATH, str(tmp_path / "t")).count() == 0


def test_marks_behind_letters_are_cut_as_the_library_cuts_them():
    t = dac._tokenizer(PATH)[0]
    texts = ["don't we'll I'VE 'tis x's. y'all'd've", "a.b,c (d)e [f]g_h i-j k/l", "é. ñ'x á. Á'b", "...x ..x'", "x!!! y?!", "<|endoftext|>a.b", "q a.b c", "end.\n\nNext, line.\t'z"]
    ids, counts = dac.encoded(pa.array(texts), PATH)
    assert [list(x) for x in np.split(ids, np.cumsum(counts)[:-1])] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_a_worker_encodes_repeated_pieces_once(monkeypatch):
    """Batches of whole texts have so many distinct words that all were forgotten behind each batch."""
    rnd = np.random.default_rng(6)
    words = ["".join(x) for x in rnd.choice(list("abcdefghij"), (120_000, 7))]
    texts = [" ".join(words[i : i + 40_000]) for i in list(range(0, 120_000, 40_000)) * 12]
    seen, known = [], dac.Pieces._encoded
    monkeypatch.setattr(dac, "_KEPT", {})
    monkeypatch.setattr(dac.Pieces, "_encoded", lambda self, pieces: seen.append(len(pieces)) or known(self, pieces))
    monkeypatch.setattr(dac, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("P", (), {"partitionId": lambda self: 0})())}))
    others = [" ".join("".join(x) for x in rnd.choice(list("klmnopqrst"), (10_000, 9))) for _ in texts]
    rb = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([f"{a} {b}" for a, b in zip(texts, others, strict=True)])], names=["doc_id", "text"])
    assert sum(r.num_rows for r in dac._writer(PATH, 0, dac.WIDTHS, dac.SEGMENT_TOKENS)(iter([rb]))) > 1
    assert sum(seen) < 1.1 * (120_000 + 10_000 * len(texts))


def test_an_idle_worker_remembers_no_pieces(monkeypatch):
    monkeypatch.setattr(dac, "_KEPT", {})
    monkeypatch.setattr(dac, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("P", (), {"partitionId": lambda self: 0})())}))
    rb = pa.RecordBatch.from_arrays([pa.array([1, 2], pa.int64()), pa.array(["some words", "more words"])], names=["doc_id", "text"])
    assert sum(r.num_rows for r in dac._writer(PATH, 0, dac.WIDTHS, dac.SEGMENT_TOKENS)(iter([rb]))) == 1
    assert not dac._KEPT
