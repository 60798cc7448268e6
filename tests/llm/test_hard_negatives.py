import math
import random

import numpy as np
import pytest

from rillflow.llm import hard_negatives as h

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    v = []
    for i, e, c in rows:
        if i is None or c is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        v.append((i, (c + 1) % 10 if i % 7 == 0 else c, [math.floor(256 * float(np.float32(x))) for x in e]))
    out = []
    for i, c, x in v:
        if i % 100:
            continue
        score = lambda y: sum(p * q for p, q in zip(x, y, strict=False))
        near = sorted((-score(y), j) for j, d, y in v if j != i and d == c)[:5]
        far = sorted((-score(y), j) for j, d, y in v if d != c)
        for s, j in near:
            fits = [(t, k) for t, k in far if 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(i, j, n + 1, k, -s, -t) for n, (t, k) in enumerate(fits)]
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", n int, block string").repartition(3)
    return sorted(map(tuple, h.hard_negatives(df).collect()))


def vectors(seed, n, dims=8, spread=0.3):
    rnd = np.random.default_rng(seed)
    centre = rnd.normal(size=(12, dims))
    return [(int(i), [float(np.float32(x)) for x in centre[rnd.integers(12)] + spread * rnd.normal(size=dims)], int(rnd.integers(10))) for i in rnd.permutation(3 * n)[:n] * 5]


@pytest.mark.parametrize("sizes", [(8192, 1024, 256), (64, 8, 16)])
def test_against_brute_force(spark, monkeypatch, sizes):
    """With one block, and with many small ones and windows."""
    for name, value in zip(("BLOCK", "ANCHORS", "WINDOW"), sizes, strict=True):
        monkeypatch.setattr(h, name, value)
    rows = vectors(sizes[0], 900)
    nan, inf = float("nan"), float("inf")
    rows += [(None, [1.0] * 8, 3), (100, None, 3), (200, [1.0, None], 3), (300, [nan] * 8, 3), (400, [inf] * 8, 3), (500, [1.0] * 8, None), (100_000, [0.0] * 8, 1), (100_001, [0.0] * 8, 1), (200_000, [], 1), (300_000, [1.0, 2.0], 2), (300_001, [1.0] * 12, 2)]
    rows += [(10_000_000 + k, [0.5] * 8, k % 3) for k in range(300)]  # ties
    rows += [rows[-1], rows[-1], (10_000_100, [0.25] * 8, 1), (-700, [0.5] * 8, 9)]
    got, want = run(spark, rows), brute(rows)
    assert len(want) > 200 and got == want


def test_small_tables_and_large_components(spark):
    assert run(spark, []) == [] and run(spark, [(100, [1.0], 1)]) == [] and run(spark, [(100, None, 1)]) == []
    rnd = random.Random(2)
    rows = [(50 * k, [rnd.uniform(-3e4, 3e4) for _ in range(16)], k % 2) for k in range(60)] + [(50 * k + 1, [rnd.uniform(0, 3e6) for _ in range(16)], k % 2) for k in range(60)]
    got, want = run(spark, rows), brute(rows)
    assert want and got == want


def test_bounds_hold_and_prune():
    rnd = np.random.default_rng(5)
    v = rnd.integers(-300, 300, (512, 16))
    v[:256] = v[0] + rnd.integers(-20, 20, (256, 16))
    v[7] = 0
    unit = v[[0, 300, 400]] / np.linalg.norm(v[[0, 300, 400]], axis=1, keepdims=True)
    norm, angle = h.angles(v, unit)
    both = np.hstack([norm[:, None], angle])
    at = np.arange(0, 512, 64)
    low, high = h.score_bounds(both, np.stack([np.minimum.reduceat(both, at), np.maximum.reduceat(both, at)], 1))
    s = (v @ v.T).reshape(512, 8, 64)
    assert (low <= s.min(2)).all() and (s.max(2) <= high).all()
    assert high[0, 4:].max() < s[0, :4].max()  # rows near the anchor leave no need of the others
