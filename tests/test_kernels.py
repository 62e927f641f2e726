"""Kernels that score only what can matter, against scoring everything."""

import numpy as np
import pytest

from tonearm.operators import kernels
from tonearm.operators.blocks import Rows
from tonearm.operators.kernels import AT, TEXT_AT


def some_rows(n, prefix, seed):
    rng = np.random.default_rng(seed)
    out = Rows.__new__(Rows)
    out.ids = np.array([f"{prefix}{i:04d}" for i in range(n)], dtype=object)
    out.x = rng.random((n, kernels.THEMES + 5))
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    out.x[:, kernels.CHROMA], out.x[:, kernels.THEMES:] = unit(rng.random((n, 12))), unit(rng.random((n, 5)))
    out.x[:, kernels.MFCC] = rng.uniform(-30, 30, (n, 13))
    for name, values in {"bpm": rng.uniform(60, 180, n), "energy": rng.uniform(0, 100, n), "key_no": rng.integers(-1, 12, n),
                         "live": rng.random(n) < 0.2, "has_lyrics": rng.random(n) < 0.6, "playable": rng.random(n) < 0.9, "n_themes": 5,
                         "mood": np.where(rng.random(n) < 0.5, np.nan, rng.integers(0, 3, n))}.items():
        out.x[:, AT[name]] = values
    out.s = np.stack([rng.choice(np.array([f"{t}{i}" for i in range(n if t == "identity" else 5)], dtype=object), n) for t in kernels.TEXTS], axis=1)
    out.s[:, TEXT_AT["mode"]] = rng.choice(np.array(["major", "minor"], dtype=object), n)
    out.x[n // 2:n // 2 + 9], out.s[n // 2:n // 2 + 9] = out.x[:9], out.s[:9]  # equal scores
    out.p, out.used, out._coded = None, [None] * n, {}
    return out


def asks(n, p, seed):
    prev, other = some_rows(n, "p", seed), some_rows(n, "o", seed + 1)
    rng = np.random.default_rng(seed)
    prev.x, prev.s, prev.p = np.hstack([prev.x, other.x]), np.hstack([prev.s, other.s]), p
    prev.used = [[[f"c{rng.integers(300):04d}"], [f"identity{rng.integers(300)}"], [f"artist_key{rng.integers(5)}"]] for _ in range(n)]
    return prev


def everything(worker, a, score):
    """The open candidates of each request with ``score(previous, other, p, candidate rows)`` of all of them."""
    prev, other = kernels.second(a, a.x.shape[1] // 2, len(kernels.TEXTS))
    for i, (ids, recordings, names) in enumerate(a.used):
        columns = np.flatnonzero(worker.free(ids, recordings))
        row = np.full(len(columns), i)
        yield i, columns, worker.repeated(names)[columns], score(prev.at(row), other.at(row), a.p[row], worker.c.at(columns))


def fits(a, c):
    tempo, key = kernels.tempo_fit(a.x, c.x), kernels.key_fit(a, c)
    return np.diagonal(tempo), np.diagonal(key)


@pytest.mark.parametrize("dialect", ["hosted", "classic"])
@pytest.mark.parametrize("step", [1, 3])
def test_bounded_bridge_equals_scoring_everything(dialect, step, monkeypatch):
    rng = np.random.default_rng(5)
    p = np.column_stack([rng.choice([0.25, 0.7, 1.0], (30, 5)), rng.uniform(0, 100, 30), rng.random(30), rng.choice([0.25, 1.0], 30)])
    a, worker = asks(30, p, 7), kernels.Bridge(some_rows(300, "c", 3), step, dialect)
    progress, weight = step / 4, 0.22 + step / 4 * 0.46

    def score(prev, goal, p, c):
        here, origin, genre, there, there_genre, energy, bright, home = p.T
        value = (1 - weight) * kernels.handoff_score(prev, c, here, origin, genre, dialect, *fits(prev, c))
        value += weight * kernels.handoff_score(c, goal, there, home, there_genre, dialect, *fits(c, goal))
        off = lambda start, name: np.abs(c.x[:, AT[name]] - (start * (1 - progress) + goal.x[:, AT[name]] * progress))
        return value * 0.84 + np.exp(-off(energy, "energy") / 18) * 0.10 + np.exp(-off(bright, "brightness") / 0.24) * 0.06

    want = []
    for i, columns, again, value in everything(worker, a, score):
        value = np.round(np.where(again, value * 0.68, value), 10)
        best = columns[np.lexsort((columns, -value))[0]]
        want.append((a.ids[i], worker.c.ids[best], value.max()))
    scored, real = [], kernels.handoff_score
    monkeypatch.setattr(kernels, "handoff_score", lambda left, *more: scored.append(len(left.ids)) or real(left, *more))
    got = [(r, t, round(s, 10)) for r, t, s in zip(*worker.score(a))]
    assert got == want
    assert sum(scored) < 2 * 30 * 300 * 0.5


def test_bridges_share_what_previous_tracks_and_destinations_reach(monkeypatch):
    rng = np.random.default_rng(13)
    p = np.column_stack([rng.choice([0.25, 0.7, 1.0], (40, 5)), rng.uniform(0, 100, 40), rng.random(40), np.ones(40)])
    a, width, texts = asks(40, p, 14), kernels.THEMES + 5, len(kernels.TEXTS)
    a.x = np.hstack([a.x[np.arange(40) % 3, :width], a.x[np.arange(40) % 4, width:]])
    a.s = np.hstack([a.s[np.arange(40) % 3, :texts], a.s[np.arange(40) % 4, texts:]])
    worker = kernels.Bridge(some_rows(500, "c", 15), 2, "hosted")
    told = lambda rows: [(r, t, round(s, 10)) for r, t, s in zip(*worker.score(rows))]
    alone = [told(a.take(i, i + 1))[0] for i in range(40)]
    bounded, real = [], kernels.handoff_bound
    monkeypatch.setattr(kernels, "handoff_bound", lambda x, *more: bounded.append(len(x)) or real(x, *more))
    assert told(a) == alone
    assert sum(bounded) == 3 + 4
    a.p = np.column_stack([a.p, [score for _, _, score in alone]])  # found elsewhere: equal scores are still told
    assert told(a) == alone
    a.p[:, 8] += 1e-6
    assert all(score < least for score, least in zip((worker.score(a) or [[], [], []])[2], a.p[:, 8]))


@pytest.mark.parametrize("dialect", ["hosted", "classic"])
def test_chain_scores_only_rows_from_the_cut_on(dialect, monkeypatch):
    rng = np.random.default_rng(6)
    cut = rng.choice([-1.0, 80.0, 95.0, 127.0], 30)
    a = asks(30, np.column_stack([rng.choice([0.1, 0.5, 1.0], (30, 2)), rng.choice([0.25, 0.7, 1.0], (30, 2)), cut]), 8)
    worker = kernels.Chain(some_rows(300, "c", 4), "nearby", True, dialect)
    rough = lambda prev, p, c: np.diagonal(kernels.rough_score(prev, c, p[:, 2][:, None], p[:, 0][:, None], dialect)[0])
    score = lambda prev, other, p, c: worker.exact(prev, other, c, p, *fits(prev, c))
    prev, _ = kernels.second(a, a.x.shape[1] // 2, len(kernels.TEXTS))
    want, reached = set(), 0
    for i, columns, again, value in everything(worker, a, score):
        row = np.full(len(columns), i)
        first = rough(prev.at(row), a.p[row], worker.c.at(columns))
        value, bins = np.round(np.where(again, value * 0.62, value), 10), kernels.rough_bins(first)
        told = [(columns[j], False) for j in np.flatnonzero(bins == cut[i])]
        above = np.flatnonzero(bins > cut[i])
        reached += len(above) + len(told)
        if len(above):
            told.append((columns[above[np.lexsort((columns[above], -first[above], -value[above]))[0]]], True))
        by = dict(zip(columns, value))
        want |= {(a.ids[i], worker.c.ids[j], by[j], sure) for j, sure in told}
    scored, real = [], kernels.timbre
    monkeypatch.setattr(kernels, "timbre", lambda *args: scored.append(real(*args)) or scored[-1])
    got = {(r, t, round(s, 10), bool(sure)) for r, t, _, s, sure in zip(*worker.score(a))}
    assert got == want
    assert sum(x.size for x in scored) == reached < 30 * 300


@pytest.mark.parametrize("dialect", ["hosted", "classic"])
def test_rough_scores_are_found_without_a_scan(dialect, monkeypatch):
    """Bins down to the shortlist as by scoring everything, though few rows of a large block are looked at."""
    rng = np.random.default_rng(9)
    p = np.column_stack([rng.choice([0.1, 0.5, 1.0], (30, 2)), rng.choice([0.25, 0.7, 1.0], (30, 2))])
    a, cands = asks(30, p, 11), some_rows(6000, "c", 12)
    a, _ = kernels.second(a, a.x.shape[1] // 2, len(kernels.TEXTS))
    a.p, a.used = p, [[[f"c{rng.integers(6000):04d}"], [f"identity{rng.integers(6000)}"], ["artist_key1"]] for _ in range(30)]
    a.x[:3, AT["bpm"]] = 0.0, -5.0, 1e9
    cands.x[:40, AT["bpm"]], cands.x[40:80, AT["bpm"]] = 0.0, 600.0
    worker = kernels.ChainBins(cands, dialect, 100)
    rough = kernels.rough_score(a, worker.c, p[:, 2][:, None], p[:, 0][:, None], dialect)[0]
    want = set()
    for i, (ids, recordings, _) in enumerate(a.used):
        bins, n = np.unique(kernels.rough_bins(rough[i])[worker.free(ids, recordings)], return_counts=True)
        above = n[::-1].cumsum()[::-1] - n
        want |= {(a.ids[i], b, m) for b, m, more in zip(bins, n, above) if more < 100}
    looked, real = [], kernels.tempo_fit
    monkeypatch.setattr(kernels, "tempo_fit", lambda *args: looked.append(real(*args)) or looked[-1])
    got = {(r, b, m) for r, bins, counts in zip(*(list(c) if isinstance(c, list) else c.to_pylist() for c in worker.score(a))) for b, m in zip(bins, counts)}
    assert got == want
    assert sum(x.size for x in looked) < 30 * 6000 / 3


def metadata_rows(n, prefix, anchor=False):
    rng = np.random.default_rng(n)
    out = Rows.__new__(Rows)
    out.ids = np.array([f"{prefix}{i:04d}" for i in range(n)], dtype=object)
    out.x = np.column_stack([np.where(rng.random(n) < 0.1, np.nan, rng.integers(1990, 1994, n)), np.where(rng.random(n) < 0.1, np.nan, rng.integers(9, 12, n) * 1e4)])
    out.s = np.array([[f"e{i // 50}", "pop", f"artist {i % 7}", f"a{i % 7}\u0001a{i % 3}", f"c{i:04d}"][:5 if anchor else 4] for i in range(n)], dtype=object)
    out.p, out.used, out._coded = np.full((n, 1), 0.5), [None] * n, {}
    return out


@pytest.mark.parametrize("mode", ["similar", "personalized"])
def test_metadata_lists_do_not_sort_whole_blocks(mode, monkeypatch):
    """Fifty rows of each edition and few different scores: lists must go on behind equal scores and repeated editions."""
    a, cands = metadata_rows(20, "q", True), metadata_rows(1500, "c")
    a.used = [[["pop"] if i % 2 else [], ["artist 3", "artist 3"] if i % 3 else []] for i in range(20)]
    worker = kernels.Metadata(cands, mode, 12, (0.65, 0.10, 0.25))
    seen = cands.take(0, 200)
    worker.feed(0, seen)
    want = []
    for i in range(20):
        rows = []
        for j in range(1500):
            year, length = a.x[i]
            year, length = (2005 if np.isnan(year) else year), (210_000 if np.isnan(length) else length)
            other = [own if np.isnan(value) else value for value, own in zip(worker.c.x[j], (year, length))]
            era = 0.65 * np.exp(-abs(other[0] - year) / 12) + 0.35 * np.exp(-abs(other[1] - length) / 120_000)
            shared = float(bool(set(a.s[i, 3].split("\u0001")) & set(worker.c.s[j, 3].split("\u0001"))))
            total = 0.65 * 0.5 + 0.10 * shared + 0.25 * era
            if mode == "personalized" and (a.used[i][0] or a.used[i][1]):
                liked = min(1.0, (worker.c.s[j, 1] in a.used[i][0]) + 0.35 * (worker.c.s[j, 2] in a.used[i][1]))
                total = 0.40 * liked + 0.20 * 0.5 + 0.40 * (0.625 * era + 0.375 * (0.15 if j < 200 else 1.0))
            if worker.c.s[j, 0] != a.s[i, 0] and worker.c.ids[j] != a.s[i, 4]:
                rows.append((-round(min(1.0, total), 4), worker.c.ids[j], worker.c.s[j, 0]))
        taken = {}
        for row in sorted(rows):
            taken.setdefault(row[2], row)
        want += [(a.ids[i], row[1], row[2], -row[0]) for row in list(taken.values())[:12]]
    sizes, real = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda x, *args, **more: sizes.append(np.size(x)) or real(x, *args, **more))
    got = [(r, t, e, round(s, 4)) for r, t, e, s, *_ in zip(*worker.score(a))]
    assert got == want
    assert max(sizes) <= 1500  # a row at a time, not the matrix
