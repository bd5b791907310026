from __future__ import annotations

import numpy as np
import pytest

from corvane.llm import neighbours as N
from corvane.llm.neighbours import AdditiveQuantiser, nearest_neighbours, neighbour_pairs

SCHEMA = "content_hash string, vector array<float>, vid string, name int, x string, cell long"


def clusters(n, seed=1, size=64):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 25), size))
    return (centres[rng.integers(len(centres), size=n)] + 0.25 * rng.normal(size=(n, size))).astype(np.float32)


def frame(spark, x, extra=()):
    rows = [(f"h{i:05d}", [float(v) for v in row], "v", 1, "x", 3) for i, row in enumerate(x)]
    return spark.createDataFrame([*rows, *extra], SCHEMA)


def exact(x, k=5):
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return {(min(i, j), max(i, j)) for i, row in enumerate(np.argsort(-s, axis=1, kind="stable")[:, :k]) for j in row}


def recall(spark, x, **kw):
    got = {(int(r[0][1:]), int(r[1][1:])) for r in neighbour_pairs(nearest_neighbours(frame(spark, x), **kw)).collect()}
    want = exact(x)
    return len(got & want) / len(want)


def test_recall(spark):
    assert recall(spark, clusters(3000)) >= 0.95


@pytest.mark.parametrize(("crowded", "rows", "rerank"), [(40, 32, 256), (400, 32, 256), (200, 100, 24)])
def test_recall_with_crowded_cells_in_blocks(spark, monkeypatch, crowded, rows, rerank):
    monkeypatch.setattr(N, "CROWDED", crowded)
    monkeypatch.setattr(N, "CELL_ROWS", 2 * rows)
    monkeypatch.setattr(N, "BLOCK_ROWS", rows)
    assert recall(spark, clusters(2500, 3), rerank=rerank) >= 0.9


@pytest.mark.parametrize("rerank", [32, 64])
def test_recall_by_tables(spark, monkeypatch, rerank):
    """Cells of some 375 vectors of which only so many, little more than a cluster has, are scored exactly: the tables choose them."""
    monkeypatch.setattr(N, "book_sizes", lambda n: [8, 128, 128, 128])
    assert recall(spark, clusters(3000, 4), rerank=rerank) >= 0.9


def test_copies_are_bounded():
    x = clusters(2000, 6)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = AdditiveQuantiser.fit(x, [16, 32])
    local = {w: x[np.nonzero(N.nearest(x, model.books[0]) == w)[0][:7]] for w in range(0, 16, 2)}
    home, others = N.cells(model.books[0], x, local, 1)
    assert (home // N.WIDE == N.nearest(x, model.books[0])).all()
    counts = sum((np.bincount(at, minlength=len(x)) for at, _ in others), np.ones(len(x), dtype=int))
    assert counts.max() <= N.COPIES and counts.min() >= 2
    pairs = np.concatenate([np.stack([np.arange(len(x)), home], 1), *[np.stack(o, 1) for o in others]])
    assert len(np.unique(pairs, axis=0)) == len(pairs)


def test_dirt_and_copies(spark):
    x = clusters(60, 5)
    one = [float(v) for v in x[0]]
    extra = [("n", None, "v", 1, "x", 3), ("short", [1.0] * 32, "v", 1, "x", 3), ("zero", [0.0] * 64, "v", 1, "x", 3), ("nan", [float("nan")] * 64, "v", 1, "x", 3), (None, one, "v", 1, "x", 3)]
    extra += [("hole", [None, *one[1:]], "v", 1, "x", 3)]
    extra += [(f"copy{i}", one, "v", 1, "x", 3) for i in range(9)] + [("copy0", one, "v", 1, "x", 3), ("h00001", None, "v", 1, "x", 3)]
    found = nearest_neighbours(frame(spark, x, extra)).collect()
    names = {r.name for r in found}
    assert names == {f"h{i:05d}" for i in range(60)} | {f"copy{i}" for i in range(9)}
    per = {}
    for r in found:
        per.setdefault(r.name, []).append(r)
        assert r.name != r.other
    assert all(len(v) == 5 for v in per.values())
    # ten names share one vector: each other's nearest, the smaller names first
    assert {r.other for r in per["copy8"]} == {"copy0", "copy1", "copy2", "copy3", "copy4"}
    assert all(r.cosine == 1.0 for r in per["copy8"])


def test_few_rows(spark):
    assert nearest_neighbours(frame(spark, np.zeros((0, 64)))).count() == 0
    assert nearest_neighbours(frame(spark, clusters(1))).count() == 0
    assert nearest_neighbours(frame(spark, clusters(3))).count() == 6


def test_quantiser_sums_and_norms():
    x = clusters(800, 2)
    model = AdditiveQuantiser.fit(x, [16, 32, 32])
    codes, norms = model.encode(x)
    sums = model.all[codes].sum(1)
    assert np.allclose((sums**2).sum(1), norms, rtol=1e-2, atol=1e-2)
    greedy, _ = model.encode(x, beam=1)
    error = lambda c: ((x - model.all[c].sum(1)) ** 2).sum()
    assert error(codes) <= error(greedy) * 1.0001
