"""The kernel of the nearest neighbours: tile by tile, with and without a floor from elsewhere; blocks as shares of the input."""

import numpy as np
import pytest

from tonearm.operators import blocks, kernels, neighbours


def held(ids, x, floor=None):
    out = blocks.Rows.__new__(blocks.Rows)
    out.ids, out.x, out.s, out.used, out._coded = np.array(ids, dtype=object), x, np.empty((len(ids), 0), object), None, {}
    out.p = np.zeros((len(ids), 0)) if floor is None else np.array(floor, float)[:, None]
    return out


def points(rng, n):
    """A few directions, most of them several times."""
    x = np.concatenate([rng.normal(size=(n // 2, 4)), np.repeat(rng.normal(size=(5, 4)), n - n // 2 - 10, axis=0)[:n - n // 2 - 10], np.zeros((10, 4))])
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(length > 0, x / np.maximum(length, 1e-300), 0.0)[rng.permutation(n)]


@pytest.mark.parametrize("distance", [False, True])
@pytest.mark.parametrize("tile", [3, 16, 4096])
def test_tiles_equal_brute_force(monkeypatch, distance, tile):
    monkeypatch.setattr(kernels.CosineTop, "tile", tile)
    rng = np.random.default_rng(tile)
    x = points(rng, 120)
    ids = [f"v{i:03d}" for i in range(120)]
    values = -np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) if distance else x @ x.T
    rounded = np.round(values, 4)
    np.fill_diagonal(rounded, -np.inf)
    want = {i: sorted((-s, c) for s, c in zip(row, ids) if s > -np.inf)[:6] for i, row in zip(ids, rounded)}
    for floors in (None, [-want[i][5][0] for i in ids], [-want[i][2][0] for i in ids], [-np.inf] * 120):
        worker = kernels.CosineTop(held(ids, x.copy()), 6, True, 4, distance)
        got = {i: [] for i in ids}
        for a, c, s in zip(*worker.score(held(ids, x, floors))):
            got[a].append((-round(s, 4), c))
        reach = floors or [-np.inf] * 120
        for i, low in zip(ids, reach):
            assert [c for _, c in got[i]] == [c for s, c in want[i] if -s >= low]


def test_blocks_are_shares_of_the_input():
    """The copies of an anchor do not grow with the input."""
    blocks_of = lambda n: -(-n // neighbours.share(n))
    assert [blocks_of(n) for n in (1000, 100_000, 1_000_000, 4_000_000)] == [1, 4, 8, 8]
