"""Language-model scores: a word count base, and a causal self-attention model on subword ids.

The model's probability of a subword is that of its class given the context, by one layer of causal self-attention in numpy, times that of the subword in its class, from counts over all
training documents. Classes are the OWN most frequent subwords, one each, and ranges of about equal mass of the others. Weights are trained by rounds: each
task takes Adam steps on its windows from the common weights, and weights are averaged over tasks in Spark, by number of windows. Each window of each training
document is in exactly one round, so that all rounds together are one pass over the corpus.

A second expert spells words from counts over all training documents: the probability of a word's next subword, or of its end, given the word's subwords so far, which the attention model
knows by their classes only. Behind a prefix that n words have, the speller's share of a token's probability is (1 - g) * n / (n + 1), the attention model's the rest; a text's is the mean of its probabilities over the GATES g, so that each
text is weighed by how well either expert did on it so far. Both experts and all gates are causal, and none gives more than 1 to all next tokens together. The VOCABULARY most frequent
prefixes and words, and all first subwords, go to every task; counts of other prefixes are joined by hash, once for each block of texts that has them.

Texts are scored by windows of SPAN inputs, STEP apart, which overlap: a window scores the tokens that the one before it did not, so each token is scored once, with SPAN - STEP tokens
of context at least (but at a text's start).

Word counts: the VOCABULARY most frequent words, a bounded table, go to every task; the others, each of which then has less than 1 / VOCABULARY of all words, are joined by hash in the same way.
"""

from __future__ import annotations

import base64
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm import dac
from rillflow.llm.common import LOWER, bytes_of, coded, doc_key, dropped, frugal, mixed, most_frequent, signed, reusing, small_batches, spread, swept, text_batches, whole_text, word_hashes, word_spans, written

VOCABULARY = 1 << 18
CLASSES, OWN, END_CLASS, END_ID, IDS = 256, 200, 255, 50256, 50257
SPAN, STEP, DIMS, HIDDEN = 16, 8, 16, 32
ROUNDS, SLICES, RATE, MINIBATCH, LEAST_STEPS = 3, 3, 0.02, 128, 150
BYTES = 3 << 20
#: Least shares of the attention model in the mixture of the experts.
GATES = (0.02, 0.1, 0.3, 0.6, 0.98)


# --------------------------------------------------------------------------- words and subwords


def hashed(words: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct words (large binary, from coded())."""
    if not len(words):
        return np.zeros(0, np.uint64)
    off = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
    return word_hashes(np.frombuffer(words.buffers()[2], np.uint8), off[:-1], off[1:])


class Subwords:
    """Subword ids of words, kept for up to most words in a worker. Words are found by their 64-bit hashes, as their counts are."""

    def __init__(self, tokenizer: str, most: int = 600_000):
        self.tokenizer, self.most = tokenizer, most
        self.clear()

    def clear(self) -> None:
        self.h, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.first, self.count = np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def of(self, words: pa.Array, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All known ids joined, and the first place and number of ids of each of the given distinct words, which have these hashes."""
        if len(self.h) > self.most:
            self.clear()
        order = np.argsort(h)
        sought = h[order]
        k = np.searchsorted(self.h, sought)
        fresh = self.h[np.minimum(k, len(self.h) - 1)] != sought if len(self.h) else np.ones(len(h), bool)
        if fresh.any():
            ids, counts = self._encoded(words.take(pa.array(order[fresh])).to_pylist())
            at = np.arange(len(self.first), len(self.first) + len(counts))
            first = len(self.flat) + np.cumsum(counts) - counts
            self.flat, self.first, self.count = np.concatenate([self.flat, ids.astype(np.uint16)]), np.concatenate([self.first, first]), np.concatenate([self.count, counts])
            self.h, self.row = np.insert(self.h, k[fresh], sought[fresh]), np.insert(self.row, k[fresh], at)
            k += np.cumsum(fresh) - fresh
        at = np.empty(len(h), np.int64)
        at[order] = self.row[k]
        return self.flat, self.first[at], self.count[at]

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, each behind a space: encoded side by side and parted by their lengths in bytes, as no token reaches over a space."""
        bpe, bytes_in = _bpe(self.tokenizer)
        joined = b" " + b" ".join(words)
        if dac.odd_documents(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]))[0]:  # other white space inside words
            ids = [bpe.encode_ordinary(" " + w.decode("utf-8")) for w in words]
            return np.array([i for x in ids for i in x], np.int64), np.array([len(x) for x in ids])
        got = np.array(bpe.encode_ordinary(joined.decode("utf-8")), np.int64)
        ends, reach = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1), np.cumsum(bytes_in[got])
        stop = np.searchsorted(reach, ends) + 1
        if not np.array_equal(reach[stop - 1], ends):
            raise ValueError("a token reaches over a space")
        return got, np.diff(np.concatenate([[0], stop]))


@lru_cache(maxsize=4)
def _bpe(path: str):
    """A byte-level BPE from a file of ranks, and the bytes of each id."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    bytes_in = np.zeros(IDS, np.int64)
    for token, i in ranks.items():
        bytes_in[i] = len(token)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), bytes_in


_KEPT: dict[str, Subwords] = {}


def subwords(tokenizer: str) -> Subwords:
    return _KEPT.setdefault(tokenizer, Subwords(tokenizer))


def batch_words(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of the lower-cased words, the distinct words, and len + 1 offsets of the documents' words."""
    data, offsets = bytes_of(column)
    data = LOWER[data]
    starts, stops, edges = word_spans(data, offsets)
    return *coded(data, starts, stops), edges


def _counts(tokenizer: str):
    """Counts of words (kind 0, by hash), subwords (1), ends (2), words' prefixes of subwords (4, by hash) and of these the first subwords alone (5) of a task's documents, and packed windows of SPAN + 1 ids for each training round (3).

    A hash of document and place chooses the round of a window; as SLICES is ROUNDS, none is left out.
    """

    def rows(kind, h, n, x=None):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int32)), pa.array(h), pa.array(n), pa.array([None] * len(h) if x is None else x, pa.binary())], names=["kind", "h", "n", "x"])

    def run(batches):
        reusing()
        total, ends, hs, ns, ps, qs = np.zeros(IDS, np.int64), 0, [], [], [], []
        for rb in text_batches(batches, BYTES):
            ids, edges, codes, words, _, parts = sequences(rb.column("text"), tokenizer)
            total += np.bincount(ids, minlength=IDS)
            ends += rb.num_rows
            hs.append(signed(hashed(words)))
            ns.append(np.bincount(codes, minlength=len(words)))
            if sum(map(len, hs)) > 1_500_000:
                yield sums_of(0, hs, ns)
                hs, ns = [], []
            for j, (some, h) in enumerate(prefixes(*parts)):
                ps.append(signed(h))
                qs.append(np.bincount(codes, minlength=len(words))[some])
                if j == 0:
                    yield sums_of(5, ps[-1:], qs[-1:])
            if sum(map(len, ps)) > 1_500_000:
                yield sums_of(4, ps, qs)
                ps, qs = [], []
            doc, k = spread(-(-np.diff(edges) // SPAN))
            pick = mixed(mixed(rb.column("doc").to_numpy().view(np.uint64)[doc]) + k.astype(np.uint64), 11) % np.uint64(SLICES)
            for r in range(ROUNDS):
                at = np.flatnonzero(pick == r)
                if len(at):
                    first = edges[:-1][doc[at]] + k[at] * SPAN
                    place = first[:, None] + np.arange(-1, SPAN)
                    x = ids[np.minimum(place, edges[1:][doc[at]][:, None] - 1)].astype(np.uint16)  # behind the end: more ends
                    x[k[at] == 0, 0] = END_ID
                    yield rows(3, np.array([r]), np.array([len(at)]), [np.ascontiguousarray(x).tobytes()])
        if hs:
            yield sums_of(0, hs, ns)
        if ps:
            yield sums_of(4, ps, qs)
        total[END_ID] = 0
        some = np.flatnonzero(total)
        yield rows(1, some, total[some])
        yield rows(2, np.zeros(1, np.int64), np.array([ends]))

    def sums_of(kind, hs, ns):
        h, back = np.unique(np.concatenate(hs), return_inverse=True)
        return rows(kind, h, np.bincount(back, weights=np.concatenate(ns)).astype(np.int64))

    return run


class Counts:
    """Counts by hash, of the most frequent ones. whole: of all that there are, so that others have none."""

    whole = True

    def __init__(self, h: np.ndarray, n: np.ndarray):
        order = np.argsort(h)
        self.h, self.n = h[order], n[order]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Counts of these hashes; -1: not among the most frequent."""
        if not len(self.h):
            return np.full(len(h), -1, np.int64)
        k = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[k] == h, self.n[k], -1)


class Together:
    """Counts of a first table, and of the next one where it has none."""

    def __init__(self, *tables: Counts):
        self.tables = tables

    def find(self, h: np.ndarray) -> np.ndarray:
        out = self.tables[0].find(h)
        for t in self.tables[1:]:
            out = np.where(out < 0, t.find(h), out)
        return out


class Vocabulary(Counts):
    """Counts of the most frequent words, and totals."""

    def __init__(self, h: np.ndarray, n: np.ndarray, tokens: int, distinct: int, ends: int):
        super().__init__(h, n)
        self.tokens, self.distinct, self.ends = tokens, distinct, ends
        self.scale = math.log10(tokens + 0.1 * (distinct + 1))


# --------------------------------------------------------------------------- the speller


def prefixes(flat: np.ndarray, first: np.ndarray, count: np.ndarray):
    """For one subword, two, up to SPAN: which words have so many, and hashes of these subwords."""
    h = np.zeros(len(count), np.uint64)
    for j in range(min(SPAN, int(count.max(initial=0)))):
        some = np.flatnonzero(count > j)
        h[some] = mixed(h[some] ^ (flat[first[some] + j].astype(np.uint64) + np.uint64(1)), 5)
        yield some, h[some]


def spelled(parts: tuple, codes: np.ndarray, at: np.ndarray, known: np.ndarray, begun: Counts | Together, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The speller's probability of each id of sequences(), and the count of the prefix before it: known has the words' counts, begun those of prefixes.

    A word is its first subword, by its share of all words and ends, then each next one by its share of what follows the prefix; whatever comes behind the word first needs the word's end.
    """
    flat, first, count = parts
    place, before = np.cumsum(count) - count, np.zeros(len(count))
    own, held = np.zeros(int(count.sum())), np.zeros(int(count.sum()))
    for j, (some, h) in enumerate(prefixes(flat, first, count)):
        n = np.maximum(begun.find(signed(h)), 0).astype(float)
        own[place[some] + j] = n / np.maximum(before[some], 1) * (before[some] > 0) if j else n / max(1, v.tokens)
        held[place[some] + j] = before[some]
        before[some] = n
    before[count > SPAN] = 0
    over = np.maximum(known, 0) / np.maximum(before, 1) * (before > 0)
    group, k = spread(count[codes])
    take = place[codes][group] + k
    out, n = own[take], held[take]
    starts, some = np.cumsum(count[codes]) - count[codes], np.diff(at) > 0
    for each, values, alone in ((out, over, 1.0), (n, before, float(v.tokens))):  # of the word before each word, if the text has one
        here = np.concatenate([[alone], values[codes]])[:-1]
        here[at[:-1][some]] = alone
        each[starts] = here if each is n else each[starts] * here
    last = at[1:][some] - 1
    end, end_n = np.full(len(some), v.ends / max(1, v.tokens)), np.full(len(some), float(v.tokens))
    end[some] *= over[codes[last]]
    end_n[some] = before[codes[last]]
    where = np.concatenate([[0], np.cumsum(count[codes])])[at[1:]]
    return np.insert(out, where, end), np.insert(n, where, end_n)


def wanted(words: pa.Array, parts: tuple, v: Vocabulary, begun: Counts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (kind 0) and of their prefixes (4) whose counts the tables do not hold."""
    h = signed(hashed(words))
    out = [np.zeros(0, np.int64) if v.whole else h[v.find(h) < 0]]
    if not begun.whole:
        for j, (_, x) in enumerate(prefixes(*parts)):
            if j:  # all first subwords are held
                x = np.unique(signed(x))
                out.append(x[begun.find(x) < 0])
    rest = np.unique(np.concatenate([np.zeros(0, np.int64), *out[1:]]))
    return np.repeat(np.array([0, 4], np.int32), [len(out[0]), len(rest)]), np.concatenate([out[0], rest])


def gate_terms(attention: np.ndarray, spelling: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log10 probabilities of tokens under each gate."""
    p = np.exp(attention * math.log(10))
    more = (spelling - p) * (n / (n + 1))
    return np.stack([np.log10(np.maximum(p + (1 - g) * more, 1e-300)) for g in GATES])


def gated(attention: np.ndarray, spelling: np.ndarray, n: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """log10 probability of each text from log10 probabilities of its tokens by one expert, and probabilities by the other with counts behind them: the mean over the gates."""
    sums = np.add.reduceat(gate_terms(attention, spelling, n), edges[:-1], axis=1)
    top = sums.max(axis=0)
    return top + np.log10((10 ** (sums - top)).mean(axis=0))


# --------------------------------------------------------------------------- the model


SHAPES = {
    "e": (CLASSES, DIMS), "p": (SPAN, DIMS), "q": (DIMS, DIMS), "k": (DIMS, DIMS), "v": (DIMS, DIMS), "o": (DIMS, DIMS),
    "w1": (DIMS, HIDDEN), "b1": (HIDDEN,), "w2": (HIDDEN, DIMS), "b2": (DIMS,), "u": (DIMS, CLASSES), "bu": (CLASSES,),
}
SIZE = sum(math.prod(s) for s in SHAPES.values())
LATER = np.triu(np.full((SPAN, SPAN), -1e9, np.float32), 1)


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = math.prod(shape)
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def first_weights(shares: np.ndarray, seed: int = 0) -> np.ndarray:
    """Small random weights; the output bias makes the classes as probable as they are on the whole."""
    flat = np.random.default_rng(seed).normal(0, 0.2, SIZE).astype(np.float32)
    w = views(flat)
    for name in ("b1", "b2"):
        w[name][:] = 0
    w["bu"][:] = np.log(shares)
    return flat


def two(t: np.ndarray) -> np.ndarray:
    """As rows: products of two axes are one BLAS call."""
    return t.reshape(-1, t.shape[-1])


def forward(w: dict, x: np.ndarray):
    """Hidden rows for windows x of SPAN input classes, and what the way back needs. Masked: no row sees a later input."""
    h0 = np.take(w["e"], x, axis=0) + w["p"]
    qkv = (two(h0) @ np.hstack([w["q"], w["k"], w["v"]])).reshape(*x.shape, -1)
    q, k, v = qkv[..., :DIMS], qkv[..., DIMS : 2 * DIMS], qkv[..., 2 * DIMS :]
    a = q @ k.swapaxes(1, 2)
    a *= np.float32(DIMS**-0.5)
    a += LATER
    a -= a.max(axis=2, keepdims=True)
    np.exp(a, out=a)
    a /= (two(a) @ np.ones(SPAN, a.dtype)).reshape(*x.shape, 1)
    c = a @ v
    h1 = h0 + (two(c) @ w["o"]).reshape(h0.shape)
    z = two(h1) @ w["w1"]
    z += w["b1"]
    np.maximum(z, 0, out=z)
    h2 = z @ w["w2"]
    h2 += w["b2"]
    h2 += two(h1)
    return h2.reshape(h0.shape), (h0, q, k, v, a, c, h1, z)


#: Rows of class logits at a time, which stay in a core's cache.
CACHED = 384


def output_gradient(h: np.ndarray, w: dict, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss (nats) over targets y of hidden rows h, its gradient by h, and by the output weights with the bias as a last row.

    Exponentials are not divided by their sums: these go to the small factors of the products. Where a sum leaves the type's range, its rows are done again with the largest logit taken off.
    """
    more, u = np.ones((len(h), DIMS + 1), h.dtype), np.vstack([w["u"], w["bu"]])
    more[:, :DIMS] = h
    back, ones = np.ascontiguousarray(w["u"].T), np.ones(CLASSES, h.dtype)
    loss, dh, du, room = 0.0, np.empty_like(h), np.zeros((CLASSES, DIMS + 1), h.dtype), np.empty((CACHED, CLASSES), h.dtype)
    for a in range(0, len(h), CACHED):
        part, t = more[a : a + CACHED], y[a : a + CACHED]
        rows = np.arange(len(t))
        e = np.matmul(part, u, out=room[: len(t)])
        own = e[rows, t]
        total = np.exp(e, out=e) @ ones
        if not (np.isfinite(total) & (total > 0)).all():
            np.matmul(part, u, out=e)
            top = e.max(axis=1)
            own -= top
            e -= top[:, None]
            total = np.exp(e, out=e) @ ones
        loss -= float((own - np.log(total)).sum(dtype=np.float64))
        e[rows, t] -= total
        share = (1 / (total * len(h)))[:, None]
        dh[a : a + CACHED] = e @ back
        dh[a : a + CACHED] *= share
        du += e.T @ (part * share)
    return loss / len(h), dh, du.T


def gradient(flat: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean loss (nats) over targets y of windows x, and its gradient."""
    w, out = views(flat), np.zeros_like(flat)
    g = views(out)
    h2, (h0, q, k, v, a, c, h1, z) = forward(w, x)
    with np.errstate(over="ignore", invalid="ignore"):
        loss, dh2, du = output_gradient(two(h2), w, y.ravel())
    g["u"][:], g["bu"][:] = du[:DIMS], du[DIMS]
    g["w2"][:], g["b2"][:] = z.T @ dh2, dh2.sum(axis=0)
    dz = dh2 @ w["w2"].T
    dz *= z > 0
    g["w1"][:], g["b1"][:] = two(h1).T @ dz, dz.sum(axis=0)
    dh0 = dz @ w["w1"].T
    dh0 += dh2
    g["o"][:] = two(c).T @ dh0
    dc = (dh0 @ w["o"].T).reshape(c.shape)
    d = np.empty((*x.shape, 3 * DIMS), h0.dtype)
    ds = dc @ v.swapaxes(1, 2)
    ds -= np.einsum("ijk,ijk->ij", dc, c)[..., None]
    ds *= a
    ds *= np.float32(DIMS**-0.5)
    d[..., :DIMS], d[..., DIMS : 2 * DIMS], d[..., 2 * DIMS :] = ds @ k, ds.swapaxes(1, 2) @ q, a.swapaxes(1, 2) @ dc
    g["q"][:], g["k"][:], g["v"][:] = np.hsplit((two(d).T @ two(h0)).T, 3)
    dh0 += two(d) @ np.hstack([w["q"], w["k"], w["v"]]).T
    order = np.argsort(x, axis=None, kind="stable")
    kinds, starts = np.unique(x.ravel()[order], return_index=True)
    g["e"][kinds] = np.add.reduceat(dh0[order], starts, axis=0)
    g["p"][:] = dh0.reshape(h0.shape).sum(axis=0)
    return loss, out


def adam(flat: np.ndarray, windows: np.ndarray, seed: int) -> np.ndarray:
    """Weights after one pass (LEAST_STEPS steps at least) over windows of SPAN + 1 classes."""
    rnd, flat = np.random.default_rng(seed), flat.copy()
    m, s = np.zeros_like(flat), np.zeros_like(flat)
    steps = max(LEAST_STEPS, -(-len(windows) // MINIBATCH))
    order = np.concatenate([rnd.permutation(len(windows)) for _ in range(-(-steps * MINIBATCH // len(windows)))])
    for t in range(1, steps + 1):
        some = windows[order[(t - 1) * MINIBATCH : t * MINIBATCH]]
        _, g = gradient(flat, some[:, :-1], some[:, 1:].astype(np.int64))
        m += 0.1 * (g - m)
        g *= g
        g -= s
        g *= 0.01
        s += g
        np.sqrt(s, out=g)
        g += 1e-8 * math.sqrt(1 - 0.99**t)
        np.divide(m, g, out=g)
        g *= RATE * (1 - 0.9 * t / steps) * math.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        flat -= g
    return flat


#: Pseudo-counts of subwords, 0.1 each on the average: merges are numbered from frequent to rare, so they fall with the id and tell unseen subwords apart.
PRIOR = 1 / (np.arange(IDS) + 256.0)
PRIOR *= 0.1 * IDS / PRIOR.sum()


class Classes:
    """Class of each subword id, its log10 probability within the class, and the classes' shares."""

    def __init__(self, counts: np.ndarray):
        order = np.argsort(-counts[:END_ID], kind="stable")
        self.of = np.zeros(IDS, np.uint8)
        self.of[order[:OWN]] = np.arange(OWN)
        rest = order[OWN:]
        mass = np.cumsum(counts[rest] + PRIOR[rest])
        self.of[rest] = OWN + np.minimum(END_CLASS - OWN - 1, (mass / mass[-1] * (END_CLASS - OWN)).astype(np.int64))
        self.of[END_ID] = END_CLASS
        held = counts + PRIOR
        total = np.bincount(self.of, weights=held, minlength=CLASSES)
        self.within = np.log10(held / total[self.of])
        self.shares = np.maximum(total, 1e-9) / total.sum()


def sequences(column: pa.Array, tokenizer: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray, tuple]:
    """Subword ids of each text with the end id, joined, len + 1 offsets, the batch's words as from batch_words(), and their subwords as from Subwords.of()."""
    codes, words, edges = batch_words(column)
    flat, first, count = subwords(tokenizer).of(words, hashed(words))
    n = count[codes]
    group, k = spread(n)
    ids = flat[first[codes][group] + k].astype(np.int64)
    before = np.concatenate([[0], np.cumsum(n)])[edges]
    ids = np.insert(ids, before[1:], END_ID)
    return ids, before + np.arange(len(before)), codes, words, edges, (flat, first, count)


def _round(flat: np.ndarray, seed: int, of: np.ndarray):
    def run(batches):
        reusing()
        raw = b"".join(x for rb in batches for x in rb.column("x").to_pylist())
        windows = of[np.frombuffer(raw, np.uint16).reshape(-1, SPAN + 1)]
        if len(windows):
            new = adam(flat, windows, seed).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SIZE)), pa.array(new * len(windows)), pa.array(np.full(SIZE, float(len(windows))))], names=["i", "v", "w"])

    return frugal(run)


EARLIER = (LATER == 0).astype(np.float32)


def tables(w: dict) -> dict:
    """What log_probabilities() needs of the weights: all input rows by class and place, with their values behind the output projection; queries are multiplied with the key weights beforehand."""
    rows = (w["e"][:, None] + w["p"]).reshape(-1, DIMS)
    return w | {"rows": np.hstack([rows, rows @ (w["v"] @ w["o"])]), "qk": (w["q"] @ w["k"].T) * np.float32(DIMS**-0.5), "share": np.exp(w["bu"])}


def hidden_rows(w: dict, x: np.ndarray, first: int) -> np.ndarray:
    """forward()'s hidden rows of each window's places from first on, which alone ask the others, in fewer passes: attention is normalised behind its sum. w: from tables()."""
    both = np.take(w["rows"], x * np.intp(SPAN) + np.arange(SPAN), axis=0)
    h0, v, own = both[..., :DIMS], both[..., DIMS:], np.ascontiguousarray(both[:, first:, :DIMS])
    s = (two(own) @ w["qk"]).reshape(own.shape) @ h0.swapaxes(1, 2)
    np.exp(s, out=s)
    s *= EARLIER[first:]
    h1 = two(s @ v)
    h1 /= (two(s) @ np.ones(SPAN, s.dtype))[:, None]
    h1 += two(own)
    z = h1 @ w["w1"]
    z += w["b1"]
    np.maximum(z, 0, out=z)
    h1 += z @ w["w2"]
    h1 += w["b2"]
    return h1


def log_totals(w: dict, h: np.ndarray) -> np.ndarray:
    """Logarithms of sums of the classes' exponentials, CACHED hidden rows at a time."""
    out, e = np.empty(len(h), h.dtype), np.empty((CACHED, CLASSES), h.dtype)
    for a in range(0, len(h), CACHED):
        part = e[: len(h) - a]
        np.matmul(h[a : a + CACHED], w["u"], out=part)
        np.matmul(np.exp(part, out=part), w["share"], out=out[a : a + CACHED])
    return np.log(out, out=out)


def log_probabilities(w: dict, inputs: np.ndarray, targets: np.ndarray, edges: np.ndarray, chunk: int = 2048) -> np.ndarray:
    """log10 probability of each target class given the classes before it in its document, by overlapping windows.

    Exponentials are summed as they are; where that leaves float32's range, a chunk of as many tokens is done again with the largest logit taken off.
    """
    old = np.seterr(over="ignore", invalid="ignore", divide="ignore")
    n, out, w = np.diff(edges), np.zeros(len(inputs)), tables(w)
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([inputs, np.zeros(SPAN, inputs.dtype)]), SPAN)
    picked = np.ascontiguousarray(np.vstack([w["u"], w["bu"]]).T)
    later = np.maximum(0, -(-(n - SPAN) // STEP))
    group, k = spread(later)
    begins = [(edges[:-1][n > 0], edges[1:][n > 0], 0), (edges[:-1][group] + (k + 1) * STEP, edges[1:][group], SPAN - STEP)]
    for starts, stops, first in begins:  # a text's first window scores all its places, others their last STEP ones
        some = chunk // (SPAN - first)
        for a in range(0, len(starts), some):
            place = starts[a : a + some, None] + np.arange(first, SPAN)
            inside = (place < stops[a : a + some, None]).ravel()
            x = windows[starts[a : a + some]]
            at, h = place.ravel()[inside], hidden_rows(w, x, first)[inside]
            total = log_totals(w, h)
            if not np.isfinite(total).all():
                h = two(forward(w, x)[0][:, first:])[inside]
                logits = (h @ w["u"] + w["bu"]).astype(np.float64)
                top = logits.max(axis=1)
                total = top + np.log(np.exp(logits - top[:, None]).sum(axis=1))
            own = np.take(picked, targets[at], axis=0)
            out[at] = (np.einsum("ij,ij->i", h, own[:, :DIMS]) + own[:, DIMS] - total) / math.log(10)
    np.seterr(**old)
    return out


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scored(tokenizer: str, classes: Classes, flat: np.ndarray, v: Vocabulary, begun: Counts):
    """SCORED of a batch of texts, given tables with counts of words and of prefixes that others do not hold."""

    def run(rb: pa.RecordBatch, words_more: Counts, begun_more: Counts) -> pa.RecordBatch:
        ids, edges, codes, words, at, parts = sequences(rb.column("text"), tokenizer)
        cls = classes.of[ids]
        inputs = np.concatenate([[END_CLASS], cls[:-1]]).astype(np.uint8)
        inputs[edges[:-1]] = END_CLASS
        c = np.maximum(Together(v, words_more).find(signed(hashed(words))), 0)
        attention = log_probabilities(views(flat), inputs, cls.astype(np.int64), edges) + classes.within[ids]
        score = gated(attention, *spelled(parts, codes, at, c, Together(begun, begun_more), v), edges)
        base = np.concatenate([[0], np.cumsum(np.log10(c + 0.1)[codes])])
        known = np.concatenate([[0], np.cumsum((c > 0)[codes])])
        n = np.diff(at) + 1
        own = [n, known[at[1:]] - known[at[:-1]] + (v.ends > 0), base[at[1:]] - base[at[:-1]] + math.log10(v.ends + 0.1) - n * v.scale, score]
        return pa.RecordBatch.from_arrays([rb.column("doc_id"), rb.column("held_out"), *map(pa.array, own)], names=[x.split()[0] for x in SCORED.split(", ")])

    return run


def _alone(score):
    none = Counts(np.zeros(0, np.int64), np.zeros(0, np.int64))

    def run(batches):
        reusing()
        for rb in text_batches(batches, BYTES):
            yield score(rb, none, none)

    return run


ASKED = "block long, doc_id long, held_out boolean, text string, kind int, h long"


def _asked(tokenizer: str, v: Vocabulary, begun: Counts):
    """The texts in blocks of about BYTES, and for each block, without texts, the hashes whose counts it wants."""

    def run(batches):
        reusing()
        part = TaskContext.get().partitionId()
        for seq, rb in enumerate(text_batches(batches, BYTES)):
            *_, words, _, parts = sequences(rb.column("text"), tokenizer)
            kind, h = wanted(words, parts, v, begun)
            for n, columns in ((rb.num_rows, {c: rb.column(c) for c in ("doc_id", "held_out", "text")}), (len(h), {"kind": pa.array(kind), "h": pa.array(h)})):
                columns["block"] = pa.array(np.full(n, (part << 32) + seq, np.int64))
                yield pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

    types = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "int": pa.int32()}
    schema = pa.schema([(x.split()[0], types[x.split()[1]]) for x in ASKED.split(", ")])
    return run


def _in_blocks(score):
    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        reusing()
        kind, h, n = (found.column(c).to_numpy() for c in ("kind", "h", "n"))
        out = [score(rb, *[Counts(h[kind == k], n[kind == k]) for k in (0, 4)]) for rb in texts.combine_chunks().to_batches()]
        return pa.Table.from_batches(out)

    return run


def lm_scores(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs.

    Documents whose crc32(doc_id as text) mod 10 is not 0 (a null doc_id too) are learned from. A null or empty text is one end. Words are counted by 64-bit hashes.
    Without training documents each count is 0 and the model has its first weights. Repeated rows give repeated results; rows that share a doc_id are scored by their own texts.
    Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc_key().alias("doc"), whole_text().alias("text"), held.alias("held_out"))
    train = texts.where("not held_out").select("doc", "text")
    gathered = written(train.mapInArrow(_counts(tokenizer), "kind int, h long, n long, x binary"), "gathered", "zstd")
    counts = written(gathered.where("kind <> 3").groupBy("kind", "h").agg(F.sum("n").alias("n")), "counts")
    totals = {r.kind: (r.s, r.c) for r in counts.groupBy("kind").agg(F.sum("n").alias("s"), F.count("*").alias("c")).collect()}
    ends = totals.get(2, (0, 0))[0]
    tokens, distinct = totals.get(0, (0, 0))[0] + ends, totals.get(0, (0, 0))[1] + (ends > 0)
    v = Vocabulary(*most_frequent(counts.where("kind = 0"), "h", "n", VOCABULARY), tokens, distinct, ends)
    first = counts.where("kind = 5").select("h", "n").toPandas()  # at most as many as subwords
    most = [np.concatenate(x) for x in zip(most_frequent(counts.where("kind = 4"), "h", "n", VOCABULARY), (first["h"].to_numpy(np.int64), first["n"].to_numpy(np.int64)), strict=True)]
    own = np.unique(most[0], return_index=True)[1]
    begun = Counts(most[0][own], most[1][own])
    v.whole, begun.whole = len(v.h) == totals.get(0, (0, 0))[1], len(begun.h) == totals.get(4, (0, 0))[1]
    ids = np.zeros(IDS)
    for r in counts.where("kind = 1").collect():  # at most as many as subwords
        ids[r.h] = r.n
    ids[END_ID] = ends
    classes = Classes(ids)
    swept(spark)
    flat = first_weights(classes.shares)
    for r in range(ROUNDS):
        windows = gathered.where((F.col("kind") == 3) & (F.col("h") == r)).select("x")
        new = windows.mapInArrow(_round(flat, r, classes.of), "i long, v double, w double").groupBy("i").agg((F.sum("v") / F.sum("w")).alias("v")).collect()
        if new:
            flat = np.zeros(SIZE, np.float32)
            for x in new:
                flat[x.i] = x.v
    dropped(gathered)
    score, texts = _scored(tokenizer, classes, flat, v, begun), texts.select("doc_id", "held_out", "text")
    if v.whole and begun.whole:
        scored = texts.mapInArrow(_alone(score), SCORED)
    else:
        asked = written(texts.mapInArrow(_asked(tokenizer, v, begun), ASKED), "asked", "zstd")
        # only counts that no task holds are joined: each of these words and prefixes has less than 1 / VOCABULARY of all, and a block asks for each once
        found = asked.where("h IS NOT NULL").select("block", "kind", "h").join(counts.where("kind IN (0, 4)"), ["kind", "h"]).select("block", "kind", "h", "n")
        own = asked.where("h IS NULL").select(F.col("block").alias("own"), "doc_id", "held_out", "text")
        scored = own.groupBy("own").cogroup(found.groupBy("block")).applyInArrow(_in_blocks(score), SCORED)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
