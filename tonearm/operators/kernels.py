"""Array kernels of the block join: the pair formulas of functions/acoustic.py over whole blocks.

tests/test_recommend.py holds them equal to the Column expressions by brute force.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tonearm.functions import acoustic as ac
from tonearm.operators.blocks import AVERSE, FEEDBACK, SCORED_PAIRS, SEEN, TASTE, Rows

# numeric layout of ``x`` (see recommend.features): names, then 13 coefficients, 12 pitch classes, themes
NUMBERS = ["bpm", "tempo_confidence", "onset_density", "beat_regularity", "percussive_ratio", "danceability",
           "brightness", "spectral_flatness", "spectral_contrast", "zero_crossing_rate", "harmonic_ratio",
           "aggression", "dynamic_range", "tonal_strength", "energy", "valence", "mood", "live", "has_lyrics",
           "sentiment", "arousal", "key_no", "id_hash", "playable", "n_themes"]
AT = {name: i for i, name in enumerate(NUMBERS)}
MFCC = slice(len(NUMBERS), len(NUMBERS) + 13)
CHROMA = slice(MFCC.stop, MFCC.stop + 12)
THEMES = CHROMA.stop
# layout of ``s``
TEXTS = ["identity", "artist_key", "intensity", "rhythm_character", "tempo_band", "language", "mode", "split"]
TEXT_AT = {name: i for i, name in enumerate(TEXTS)}


def clip01(value):
    return np.clip(value, 0.0, 1.0)


#: Pairs of one tile: what a similarity adds up stays in the cache.
TILE = 1 << 16


def bounded(a, c, columns, scales, sharpness, outer=True):
    """Similarity by the mean scaled gap, of every row of ``a`` with every row of ``c`` or, not ``outer``, row by row."""
    columns, scales = list(columns), np.asarray(scales, dtype=float)
    factor = -sharpness / len(scales)
    if not outer:
        gaps = a[:, columns] - c[:, columns]
        np.abs(gaps, out=gaps)
        return clip01(np.exp(gaps @ (factor / scales)))
    left, right = (np.ascontiguousarray((x[:, columns] / scales).T) for x in (a, c))
    out = np.empty((len(a), len(c)))
    step = max(1, TILE // max(1, len(c)))
    gap = np.empty((min(step, len(a)), len(c)))
    for low in range(0, len(a), step):
        total = out[low:low + step]
        one = gap[:len(total)]
        total[:] = 0.0
        for x, y in zip(left, right):
            np.subtract(x[low:low + step, None], y[None, :], out=one)
            np.abs(one, out=one)
            total += one
        total *= factor
        np.exp(total, out=total)
        np.clip(total, 0.0, 1.0, out=total)
    return out


def named(a, c, spec, outer=True):
    names, scales, sharpness = spec
    return bounded(a, c, [AT[n] for n in names], scales, sharpness, outer)


def across(x, y, outer=True):
    """Two columns so that they meet: all with all, or row by row."""
    return (x[:, None], y[None, :]) if outer else (x, y)


def numbers(a, c, name, outer=True):
    return across(a[:, AT[name]], c[:, AT[name]], outer)


def product(a, c, columns, outer=True):
    return a[:, columns] @ c[:, columns].T if outer else np.einsum("ij,ij->i", a[:, columns], c[:, columns])


def live(a, c, outer=True):
    x, y = numbers(a, c, "live", outer)
    return (x > 0) | (y > 0)


def timbre(a, c, dialect, outer=True):
    mfcc = bounded(a, c, range(MFCC.start, MFCC.stop), ac.MFCC_SCALES, ac.MFCC_SHARPNESS, outer)
    profile = named(a, c, ac.PROFILE, outer)
    plain = 0.55 * mfcc + 0.45 * profile
    return plain if dialect == "classic" else np.where(live(a, c, outer), 0.20 * mfcc + 0.80 * profile, plain)


def components(a, c, dialect):
    chroma_a, chroma_c = a[:, CHROMA], c[:, CHROMA]
    chroma = np.full((len(a), len(c)), -np.inf)
    for shift in range(12):
        np.maximum(chroma, chroma_a @ np.roll(chroma_c, shift, axis=1).T, out=chroma)
    profile = named(a, c, ac.HARMONIC)
    harmony = 0.65 * chroma + 0.35 * profile
    if dialect == "hosted":
        harmony = np.where(live(a, c), 0.35 * chroma + 0.65 * profile, harmony)
    return named(a, c, ac.RHYTHM), timbre(a, c, dialect), clip01(harmony)


#: Text columns that pair scores compare, and the number of an unknown language.
COMPARED = ["intensity", "rhythm_character", "tempo_band", "language"]
UNSPOKEN = -2


class Coded:
    """Numbers of rows, and their compared texts as numbers of the texts of a block: pairs are gathered without strings."""

    def __init__(self, ids, x, codes):
        self.ids, self.x, self.codes = ids, x, codes

    @classmethod
    def of(cls, rows: Rows, block: Rows) -> "Coded":
        codes = np.empty((len(rows.ids), len(COMPARED)), dtype=np.int64)
        for j, name in enumerate(COMPARED):
            known, texts = block.coded(TEXT_AT[name])[0], rows.s[:, TEXT_AT[name]]
            codes[:, j] = [known.get(v, -1) for v in texts]  # -1: a text the block has not
            if name == "language":
                codes[texts == "", j] = UNSPOKEN
        return cls(np.arange(len(rows.ids)), rows.x, codes)

    def at(self, rows: np.ndarray) -> "Coded":
        return Coded(self.ids[rows], self.x.take(rows, axis=0), self.codes.take(rows, axis=0))


def equal(a: Rows, c: Rows, name: str, outer=True):
    if isinstance(a, Coded):
        j = COMPARED.index(name)
        return a.codes[:, j] == c.codes[:, j]
    i = TEXT_AT[name]
    if not outer:
        return (a.s[:, i] == c.s[:, i]).astype(bool)
    known, codes = c.coded(i)
    own = np.fromiter((known.get(v, -1) for v in a.s[:, i]), dtype=np.int64, count=len(a.ids))
    return own[:, None] == codes[None, :]


def lyric(a: Rows, c: Rows, outer=True):
    """NaN where either side has no usable lyric features."""
    x, y = a.x, c.x
    themes = slice(THEMES, THEMES + int(x[0, AT["n_themes"]]))
    theme = np.maximum(0.0, product(x, y, themes, outer))

    def gap(name):
        left, right = numbers(x, y, name, outer)
        return np.abs(left - right)

    known = a.codes[:, COMPARED.index("language")] != UNSPOKEN if isinstance(a, Coded) else a.s[:, TEXT_AT["language"]] != ""
    language = np.where(equal(a, c, "language", outer) & (known[:, None] if outer else known), 1.0, 0.65)
    value = clip01(0.55 * theme + 0.20 * (1 - np.minimum(1, gap("sentiment") / 2))
                   + 0.15 * (1 - np.minimum(1, gap("arousal"))) + 0.10 * language)
    left, right = numbers(x, y, "has_lyrics", outer)
    return np.where((left > 0) & (right > 0), value, np.nan)


def vibe(a: Rows, c: Rows, dialect, lyrics, outer=True):
    acoustic = named(a.x, c.x, ac.VIBE, outer)
    character = (equal(a, c, "intensity", outer).astype(float) + equal(a, c, "rhythm_character", outer)
                 + equal(a, c, "tempo_band", outer)) / 3
    left, right = numbers(a.x, c.x, "mood", outer)
    title = np.where(np.isnan(left) | np.isnan(right), np.nan, (left == right).astype(float))
    plain = 0.78 * acoustic + 0.22 * character
    if dialect == "classic":
        return clip01(np.where(np.isnan(title), plain, 0.70 * acoustic + 0.18 * character + 0.12 * title)), title
    semantic = np.where(np.isnan(title), lyrics, np.where(np.isnan(lyrics), title, (title + lyrics) / 2))
    return clip01(np.where(np.isnan(semantic), plain,
                           0.62 * acoustic + 0.18 * character + 0.20 * semantic)), title


def tempo_fit(a, c, pairs=None):
    """Of every row of ``a`` with every row of ``c``, or of the ``pairs`` (rows, columns)."""
    x, y = numbers(a, c, "bpm") if pairs is None else (a[pairs[0], AT["bpm"]], c[pairs[1], AT["bpm"]])
    gap = np.abs(x - y)
    for other in (x - y * 2, x * 2 - y):
        np.minimum(gap, np.abs(other, out=other), out=gap)
    gap /= -12
    return np.exp(gap, out=gap)


def key_fit(a: Rows, c: Rows):
    """Computed once for each two different (key, mode) of the sides."""
    first, at_a = _keys(a)
    other, at_c = _keys(c)
    return _key_table(first, other)[at_a][:, at_c]


def _keys(rows: Rows):
    """The different (key, mode) of ``rows`` and which of them each row has."""
    seen = {}
    pairs = zip(rows.x[:, AT["key_no"]].tolist(), rows.s[:, TEXT_AT["mode"]])
    at = np.fromiter((seen.setdefault(pair, len(seen)) for pair in pairs), dtype=np.int64, count=len(rows.ids))
    return list(seen), at


def _key_table(first, other):
    ka, kc = (np.array([key for key, _ in side], dtype=float) for side in (first, other))
    ka, kc = ka[:, None], kc[None, :]
    step = np.mod(kc - ka, 12)
    modes_a, modes_c = (np.array([mode for _, mode in side] + [None], dtype=object)[:-1] for side in (first, other))
    same = (modes_a[:, None] == modes_c[None, :]).astype(bool)
    is_a = lambda m: (modes_a == m)[:, None].astype(bool)
    is_c = lambda m: (modes_c == m)[None, :].astype(bool)
    relative = (is_a("major") & is_c("minor") & (step == 9)) | (is_a("minor") & is_c("major") & (step == 3))
    return np.select(
        [(ka < 0) | (kc < 0), (step == 0) & same, relative, same & np.isin(step, (5, 7)), step == 0,
         same & np.isin(step, (2, 10))], [0.45, 1.0, 0.98, 0.92, 0.84, 0.72], 0.30)


def grouped(values):
    """Value -> the places that hold it."""
    places = {}
    for i, value in enumerate(values):
        places.setdefault(value, []).append(i)
    return {value: np.array(at) for value, at in places.items()}


class Worker:
    """Holds one candidate block; sub-classes score anchor rows against it."""

    names: list[str] = []

    def __init__(self, cands: Rows):
        order = np.argsort(cands.ids.astype(str), kind="stable")  # library order: ties go to the smaller id
        cands.ids, cands.x, cands.s = cands.ids[order], cands.x[order], cands.s[order]
        self.c, self.size = cands, len(cands.ids)
        self.index = {v: i for i, v in enumerate(cands.ids)}
        self.reset()

    def group_columns(self, name):
        """Value of a text column -> candidate columns that carry it."""
        return grouped(self.c.s[:, TEXT_AT[name]])

    def free(self, ids, recordings):
        """Playable candidates whose id and recording are not used yet."""
        mask = self.playable.copy()
        for value in ids:
            if value in self.index:
                mask[self.index[value]] = False
        for value in recordings:
            mask[self.by_identity.get(value, [])] = False
        return mask

    def index_used(self):
        self.playable = self.c.x[:, AT["playable"]] > 0
        self.by_identity, self.by_artist = self.group_columns("identity"), self.group_columns("artist_key")

    def repeated(self, names):
        mask = np.zeros(self.size, dtype=bool)
        for value in names:
            mask[self.by_artist.get(value, [])] = True
        return mask

    def rows_at_once(self) -> int:
        """Anchor rows to score at a time."""
        return max(1, SCORED_PAIRS // max(1, self.size))

    def reset(self):
        """A new requester group begins."""

    def feed(self, side: int, data: Rows):
        """Rows that belong to the current group (tastes, seen ids)."""


def top_k(scores, k):
    """Column order of the k best per row; ties keep column order."""
    return np.argsort(-scores, axis=1, kind="stable")[:, :k]


def learned_pair(a, c, dims, moods, strength, outer=True):
    """(factor, scaled sound similarity, whether both sides are indexed) of anchors and candidates by learned sound and mood."""
    sound_at, mood_at = slice(-dims - moods, -moods), slice(-moods, None)
    own = scaled_sound(a, c, sound_at, outer)
    known, other = across(indexed(a), indexed(c), outer)
    both = known & other
    x, y = across(a[:, mood_at], c[:, mood_at], outer)
    gap = np.abs(x - y).sum(axis=-1) if both.any() else np.zeros(both.shape)
    factor = ((1 - strength) + strength * (0.35 + 1.10 * own)) * (0.72 + 0.28 * clip01(1 - gap / 2))
    return np.where(both, factor, 1.0), own, both


def scaled_sound(a, c, sound_at, outer=True):
    return clip01((np.clip(product(a, c, sound_at, outer), -1, 1) - 0.35) / 0.65)


def indexed(x):
    return ~np.isnan(x[:, -1])


def best_first(scores, k):
    """For each row the columns of its k best scores and of all that equal the last of them, best first; ties keep column order."""
    if scores.shape[1] <= 2 * k:
        yield from np.argsort(-scores, axis=1, kind="stable")
        return
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    for row, low in zip(scores, least):
        columns = np.flatnonzero(row >= low)
        yield columns[np.argsort(-row[columns], kind="stable")]


class CosineTop(Worker):
    """k best dot products of unit vectors (or negative distances), after rounding.

    The block is taken tile by tile.  A row's k-th best value so far is its floor: of a later tile
    only what rounds to more is looked at (an equal value there has the larger id).  Anchor rows may
    bring a floor from elsewhere (``p``); values that round to less are left out.
    """

    names = ["anchor_id", "candidate_id", "score"]
    tile = 4096
    #: Values of one matrix product, and differences of coordinates held at a time.
    values, differences = 1 << 20, 1 << 24

    def __init__(self, cands, k, exclude_self, digits=6, distance=False):
        self.k, self.exclude_self, self.digits, self.distance = k, exclude_self, digits, distance
        super().__init__(cands)
        self.columns = min(self.tile, max(1, self.size))
        self.rows = self.values // self.columns
        if distance:
            self.rows = max(1, min(self.rows, self.differences // (self.columns * max(1, cands.x.shape[1]))))

    def rows_at_once(self):
        return self.rows

    def score(self, a: Rows):
        n = len(a.ids)
        own = np.array([self.index.get(v, -1) for v in a.ids]) if self.exclude_self else np.full(n, -1)
        unit = 10.0 ** -self.digits
        floor = a.p[:, 0].copy() if a.p.shape[1] else np.full(n, -np.inf)
        least = np.round(floor, self.digits) - 0.5 * unit - 1e-12
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        for low in range(0, self.size, self.columns):
            part = self.c.x[low:low + self.columns]
            if self.distance:
                found = -np.sqrt(np.maximum(0.0, ((a.x[:, None, :] - part[None, :, :]) ** 2).sum(axis=2)))
            else:
                found = a.x @ part.T
            mine = np.flatnonzero((own >= low) & (own < low + len(part)))
            found[mine, own[mine] - low] = -np.inf
            if low == 0 and found.shape[1] > self.k and np.count_nonzero(found >= least[:, None]) > 16 * self.k * n:
                # the best of the first tile bound all that follows; what equals the last of them stays until the ids decide
                last = np.partition(found, found.shape[1] - self.k, axis=1)[:, found.shape[1] - self.k]
                least = np.maximum(least, np.where(last > -np.inf, np.round(last, self.digits) - 0.5 * unit - 1e-12, -np.inf))
            row, column = np.divmod(np.flatnonzero(found >= least[:, None]), found.shape[1])
            if not len(row):
                continue
            value = found[row, column]
            keep = value > -np.inf
            held = [np.concatenate(x) for x in zip(held, (row[keep], column[keep] + low, value[keep]))]
            order = np.lexsort((held[1], -np.round(held[2], self.digits), held[0]))
            held = [x[order] for x in held]
            place = np.arange(len(order)) - np.searchsorted(held[0], held[0])
            last = np.flatnonzero(place == self.k - 1)
            # strictly more than the k-th: an equal value further on has a larger id
            least[held[0][last]] = np.maximum(least[held[0][last]], np.round(held[2][last], self.digits) + 0.5 * unit - 1e-12)
            held = [x[place < self.k] for x in held]
        row, column, value = held
        return [a.ids[row].tolist(), self.c.ids[column].tolist(), value]


class Recommend(Worker):
    """Diversified top list of one block; mergeable (recommend.py says why that is exact)."""

    names = ["request_id", "track_id", "identity", "artist_key", "hybrid_score", "rhythm", "timbre", "harmony"]

    def __init__(self, cands, mode, k, weights, scope, vibe_lock, dialect, lyric_weight, learned=None, inside=False):
        self.learned, self.inside = learned, inside
        if inside:
            self.names = [*self.names, "inside"]
        self.mode, self.k, self.weights, self.scope = mode, k, weights, scope
        self.vibe_lock, self.dialect, self.lyric_weight = vibe_lock, dialect, lyric_weight
        super().__init__(cands)
        self.identities = cands.s[:, TEXT_AT["identity"]]
        self.artists = cands.s[:, TEXT_AT["artist_key"]]
        self.split = self.size > 0 and cands.s[0, TEXT_AT["split"]] == "true"
        self.by_identity = self.group_columns("identity")

    def reset(self):
        self.best = None  # best taste parts per candidate
        self.averse = None
        self.seen = np.zeros(self.size, dtype=bool)
        self.feedback = []

    def feed(self, side, data):
        if side == SEEN:
            for track in data.ids:
                if track in self.index:
                    self.seen[self.index[track]] = True
            return
        if side == FEEDBACK:
            self.feedback += list(zip(data.p[:, 0], data.ids, data.s[:, 0], data.x))
            return
        step = max(1, 1_000_000 // max(1, self.size))
        for low in range(0, len(data.ids), step):
            parts = np.stack(components(data.x[low:low + step], self.c.x, self.dialect))
            value = np.tensordot(np.asarray(self.weights), parts, axes=1)
            if side == AVERSE:
                top = value.max(axis=0)
                self.averse = top if self.averse is None else np.maximum(self.averse, top)
            elif side == TASTE:
                who = value.argmax(axis=0)
                cols = np.arange(self.size)
                top, chosen = value[who, cols], parts[:, who, cols]
                if self.best is None:
                    self.best = (top, chosen)
                else:
                    better = top > self.best[0]
                    self.best = (np.where(better, top, self.best[0]), np.where(better, chosen, self.best[1]))

    def total(self, a: Rows):
        genre = a.p[:, 0][:, None]
        parts = components(a.x, self.c.x, self.dialect)
        if self.mode == "personalized" and self.best is not None:
            parts = tuple(0.65 * own + 0.35 * liked[None, :] for own, liked in zip(parts, self.best[1]))
        self.parts = r, t, h = parts
        acoustic = self.weights[0] * r + self.weights[1] * t + self.weights[2] * h
        lyrics = lyric(a, self.c) if self.dialect == "hosted" else np.full(r.shape, np.nan)
        mood, title = vibe(a, self.c, self.dialect, lyrics)
        if self.mode == "rhythm":
            base = 0.72 * r + 0.12 * mood + 0.10 * h + 0.06 * t
        elif self.mode == "timbre":
            base = 0.72 * t + 0.12 * mood + 0.10 * h + 0.06 * r
        elif self.mode == "discover":
            base = 0.42 * acoustic + 0.30 * mood + 0.18 * genre + 0.10 * self.c.x[:, AT["id_hash"]][None, :]
        else:
            w = self.lyric_weight
            base = np.where(np.isnan(lyrics), acoustic, (1 - w) * acoustic + w * lyrics)
        total = base * (0.86 + 0.14 * genre if self.scope == "open" else 0.56 + 0.44 * genre)
        if self.vibe_lock:
            total = total * (0.42 + 0.58 * mood)
        total = np.where(title == 0, total * 0.52, total)
        discover = self.mode == "discover"
        if discover:
            total = np.where(equal(a, self.c, "artist_key"), total * 0.58, total)
        if self.seen.any():
            factor = (0.36 if self.dialect == "hosted" else 0.40) if discover else 0.76
            total = np.where(self.seen[None, :], total * factor, total)
        if self.averse is not None:
            cut = 1 - 0.45 * np.minimum(1, (self.averse - 0.72) / 0.28)
            total = np.where((self.averse > 0.72)[None, :], total * cut[None, :], total)
        if self.learned is not None:
            total = total * self.learned_factor(a)
        return clip01(total)

    def learned_factor(self, a: Rows):
        """Multiplier from learned sound, predicted mood and explicit feedback."""
        dims, moods, sad, strength = self.learned
        sound_at, mood_at = slice(-dims - moods, -moods), slice(-moods, None)
        known, c = indexed, self.c.x
        factor, own, _ = learned_pair(a.x, c, dims, moods, strength)
        listed = sorted(self.feedback, key=lambda f: f[0])
        direct = {}
        for _, track, reason, _ in listed:
            direct.setdefault(track, reason)
        for track, reason in direct.items():
            if track in self.index:
                factor[:, self.index[track]] *= 1.12 if reason == "more_like_this" else 0.12
        for _, track, reason, x in listed[:12]:
            if np.isnan(x[-1]):
                continue
            other = known(c) & (self.c.ids != track)
            if reason == "more_like_this":
                related = clip01((np.clip(c[:, sound_at] @ x[sound_at], -1, 1) - 0.55) / 0.45)
                factor = factor * np.where(other, 1 + related * 0.07, 1.0)[None, :]
            elif reason == "too_different":
                factor = np.where(other[None, :] & known(a.x)[:, None], factor * (0.90 + 0.10 * own), factor)
            elif reason == "too_sad" and sad is not None and x[mood_at][sad] > 0.16:
                factor = factor * np.where(other, 1 - np.minimum(0.18, c[:, mood_at][:, sad] * 0.35), 1.0)[None, :]
        return factor

    def pick(self, total, columns):
        """(main, rest, whether all allowed columns were seen): columns come best first."""
        taken, artists, main, rest = set(), {}, [], []
        for column in columns.tolist():
            if total[column] < 0 or len(main) >= self.k:
                return main, rest, True
            if self.identities[column] in taken:
                continue
            taken.add(self.identities[column])
            artist = self.artists[column]
            if self.split or artists.get(artist, 0) < 2:
                artists[artist] = artists.get(artist, 0) + 1
                main.append(column)
            elif len(rest) < self.k:
                rest.append(column)
        return main, rest, len(columns) == self.size

    def score(self, a: Rows):
        total = np.round(self.total(a), 4)
        for row, text in zip(total, a.s):
            row[self.by_identity.get(text[TEXT_AT["identity"]], [])] = -1.0
            if text[-1] in self.index:
                row[self.index[text[-1]]] = -1.0
        out = tuple([] for _ in self.names)
        lists = [(total, [])] if not self.inside else [(total, [False]), (np.where(indexed(self.c.x)[None, :], total, -1.0), [True])]
        for values, flag in lists:
            for row, columns in enumerate(best_first(values, 6 * self.k)):
                main, rest, all_seen = self.pick(values[row], columns)
                if len(main) < self.k and not all_seen:
                    main, rest, _ = self.pick(values[row], np.argsort(-values[row], kind="stable"))
                chosen = main + rest
                for column, part in zip(out, ([a.ids[row]] * len(chosen), self.c.ids[chosen], self.identities[chosen], self.artists[chosen],
                                              values[row, chosen], *[p[row, chosen] for p in self.parts], flag * len(chosen))):
                    column.extend(part)
        return list(out)


def handoff_score(a: Rows, c: Rows, here, origin, genre, dialect, tempo, key):
    """Transition score from rows ``a`` to rows ``c``, row by row; ``tempo`` and ``key`` are their fits."""
    straight = np.maximum(0.0, product(a.x, c.x, CHROMA, False))
    harmonic = 0.72 * key + 0.28 * straight
    if dialect == "hosted":
        harmonic = np.where(live(a.x, c.x, False), 0.86 * key + 0.14 * straight, harmonic)
    harmonic, tone = clip01(harmonic), timbre(a.x, c.x, dialect, False)
    energy = named(a.x, c.x, ac.HANDOFF_ENERGY, False)
    if dialect == "classic":
        base = 0.36 * tempo + 0.30 * harmonic + 0.20 * tone + 0.14 * energy
        return clip01(base * (0.78 + 0.22 * here) * (0.90 + 0.10 * origin))
    lyrics = lyric(a, c, False)
    mood, _ = vibe(a, c, dialect, lyrics, False)
    base = np.where(np.isnan(lyrics), 0.31 * tempo + 0.27 * harmonic + 0.17 * tone + 0.11 * energy + 0.14 * mood,
                    0.29 * tempo + 0.25 * harmonic + 0.16 * tone + 0.10 * energy + 0.12 * mood + 0.08 * lyrics)
    return clip01(base * (0.80 + 0.12 * here + 0.08 * genre) * (0.92 + 0.08 * origin))


def handoff_bound(a, c, dialect, tempo, key):
    """No less than a transition score before styles, of all rows with all: characters, titles and lyrics are taken as 1."""
    straight = np.maximum(0.0, product(a, c, CHROMA))
    harmonic = 0.72 * key + 0.28 * straight
    if dialect == "hosted":
        harmonic = np.where(live(a, c), 0.86 * key + 0.14 * straight, harmonic)
    np.clip(harmonic, 0.0, 1.0, out=harmonic)
    tone, energy = timbre(a, c, dialect), named(a, c, ac.HANDOFF_ENERGY)
    if dialect == "classic":
        return 0.36 * tempo + 0.30 * harmonic + 0.20 * tone + 0.14 * energy + BOUND_SLACK
    mood = named(a, c, ac.VIBE)
    mood *= 0.62
    mood += 0.38  # rows without title mood and lyrics reach no more: 0.78 of the acoustic part and 0.22
    parts = ((0.31, 0.02, tempo), (0.27, 0.02, harmonic), (0.17, 0.01, tone), (0.11, 0.01, energy), (0.14, 0.02, mood))
    bound = sum(share * part for share, _, part in parts)
    left, right = numbers(a, c, "has_lyrics")
    bound += np.where((left > 0) & (right > 0), 0.08 - sum(less * part for _, less, part in parts), 0.0)
    return bound + BOUND_SLACK


#: Above what rounding adds to a bound or takes from a score.
BOUND_SLACK = 1e-9
#: Pairs that are scored row by row at a time.
PAIRS = 1 << 12


def second(a: Rows, width: int, texts: int) -> tuple[Rows, Rows]:
    """Split rows that carry two tracks (previous, other) into two row sets."""
    first, other = a.take(0, len(a.ids)), a.take(0, len(a.ids))
    first.x, other.x = a.x[:, :width], a.x[:, width:]
    first.s, other.s = a.s[:, :texts], a.s[:, texts:]
    return first, other


ROUGH_BINS = 256


def rough_bins(rough):
    """Bin of each rough score (0 to 1)."""
    return np.clip((rough * ROUGH_BINS).astype(np.int32), 0, ROUGH_BINS - 1)


def rough_weights(dialect):
    """Shares of tempo, key, style and genre in the rough score."""
    return (0.50, 0.32, 0.18, 0.0) if dialect == "classic" else (0.47, 0.30, 0.13, 0.10)


def rough_sum(tempo, key, here, genre, dialect):
    weights = rough_weights(dialect)
    rough = weights[0] * tempo
    rough += weights[1] * key
    rough += weights[2] * here
    rough += weights[3] * genre
    return rough


def rough_score(a: Rows, c: Rows, here, genre, dialect):
    """(rough, tempo, key): matrices of previous tracks and candidates."""
    tempo, key = tempo_fit(a.x, c.x), key_fit(a, c)
    return rough_sum(tempo, key, here, genre, dialect), tempo, key


class TempoIndex:
    """Playable columns of a block by (key, mode) and by tempo: rows of near tempo are ranges, found without a scan."""

    #: Tempo steps a beat per minute, and their number; tempos beyond lie in the outer steps.
    STEPS, MOST = 8, 4096

    def __init__(self, cands: Rows, playable):
        self.keys, self.key_at = _keys(cands)
        self.bpm = cands.x[:, AT["bpm"]]
        cell = self.key_at * self.MOST + self.step(self.bpm)
        self.order = np.flatnonzero(playable)
        self.order = self.order[np.argsort(cell[self.order], kind="stable")]
        counts = np.bincount(cell[self.order], minlength=len(self.keys) * self.MOST)
        #: place in ``order`` of the first row of each step, one more for the end
        self.first = np.append(0, np.cumsum(counts))

    def step(self, bpm):
        return np.nan_to_num(np.clip(np.floor(bpm * self.STEPS), 0, self.MOST - 1), nan=0).astype(np.int64)

    def table(self, a: Rows):
        """(key fits of the different keys of ``a`` with those of the block, which of them each row has)."""
        own, at = _keys(a)
        return _key_table(own, self.keys), at

    def ranges(self, bpm, gap, inside=False):
        """(start, length), rows x keys x 3: places whose tempo, its half or its double is within ``gap`` of ``bpm`` (0 or more).

        Every such row is in a range and none in two; ``inside`` leaves out the outer steps, which hold other rows too.
        """
        x, key = bpm[:, None], np.arange(len(self.keys)) * self.MOST
        at = lambda low, high: (self.first[key + self.step(low) + inside], self.first[key + self.step(high) + 1 - inside])
        (low, high), (half, half_end), (double, double_end) = at(x - gap, x + gap), at((x - gap) / 2, (x + gap) / 2), at(2 * x - gap, 2 * x + gap)
        start = np.stack([low, half, np.maximum(double, high)], axis=2)
        end = np.stack([high, np.minimum(half_end, low), double_end], axis=2)
        return start, np.maximum(end - start, 0)

    def gaps(self, bpm, need):
        """Largest gap whose tempo fit reaches ``need``; -1 where none does, no bound where all do."""
        with np.errstate(divide="ignore", invalid="ignore"):
            gap = np.where(need > 1 + 1e-9, -1.0, np.where(need > 1e-9, -12 * np.log(np.minimum(need, 1)) + 1e-6, np.inf))
        gap[~((bpm >= 0) & (bpm < np.inf))] = np.inf
        return gap

    def pairs(self, start, length):
        """(row, column) of all places in the ranges of each row."""
        length = length.reshape(-1)
        some = np.flatnonzero(length)
        at, place = spread(start.reshape(-1)[some], length[some])
        return some[at] // (len(self.keys) * 3), self.order[place]


def spread(start, length):
    """(which range, place) of every place in ranges."""
    ends = np.cumsum(length)
    place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)
    return np.repeat(np.arange(len(length)), length), place


def parts_of(sizes, most):
    """Cut rows into runs whose sizes add up to about ``most``, one row at least."""
    run = np.cumsum(sizes) // max(1, most)
    edges = np.flatnonzero(np.diff(run)) + 1
    return [slice(low, high) for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(sizes)])]


class UsedWorker(Worker):
    """A block whose recordings and artists are numbered, for requests that bring what they have used."""

    def __init__(self, cands, dialect):
        self.dialect = dialect
        super().__init__(cands)
        self.index_used()
        self.identity_of, self.artist_of = (self.c.coded(TEXT_AT[name]) for name in ("identity", "artist_key"))

    def told(self, a: Rows):
        """Columns, recordings and artists that each request has used, as numbers; -1 where the block has them not."""
        out = []
        for i, known in enumerate((self.index, self.identity_of[0], self.artist_of[0])):
            used = [[known.get(v, -1) for v in row[i]] for row in a.used]
            width = max(1, max(map(len, used)))
            out.append(np.array([row + [-1] * (width - len(row)) for row in used], dtype=np.int64).reshape(len(used), width))
        return out

    def still_open(self, told, row, column, *more):
        """The pairs whose candidate and recording the request has not used, and what else there is of them."""
        shut = (column[:, None] == told[0][row]).any(1) | (self.identity_of[1][column][:, None] == told[1][row]).any(1)
        return tuple(x[~shut] for x in (row, column, *more))

    def by_used_artist(self, told, row, column):
        return (self.artist_of[1][column][:, None] == told[2][row]).any(1)


class RoughWorker(UsedWorker):
    """A block whose candidates are found by their rough score; only rows that can reach a bin are looked at."""

    def __init__(self, cands, dialect):
        super().__init__(cands, dialect)
        self.tempos = TempoIndex(self.c, self.playable)
        self.identity_rows = np.bincount(self.identity_of[1], minlength=len(self.identity_of[0]))

    def rows_at_once(self):
        return 1024

    def needs(self, a: Rows, prev: Rows, least):
        """Function of rows: tempo fit that a candidate of each key needs for bin ``least``."""
        table, at = self.tempos.table(prev)
        w = rough_weights(self.dialect)
        fixed = w[1] * table[at] + (w[2] * a.p[:, 2] + w[3] * a.p[:, 0])[:, None]
        return lambda rows: (least[rows][:, None] / ROUGH_BINS - fixed[rows]) / w[0]

    def reached(self, a: Rows, prev: Rows, told, rows, least):
        """Open candidates of bin ``least`` and above of some rows: (rows, then row, column, rough, tempo, key of the pairs), part by part."""
        index, need = self.tempos, self.needs(a, prev, least)
        table, at = index.table(prev)
        bpm = prev.x[:, AT["bpm"]]
        start, length = index.ranges(bpm[rows], index.gaps(bpm[rows], need(rows)))
        for part in parts_of(length.sum((1, 2)), SCORED_PAIRS):
            row, column = index.pairs(start[part], length[part])
            row, column = self.still_open(told, rows[part][row], column)
            tempo = tempo_fit(prev.x, self.c.x, (row, column))
            key = table[at[row], index.key_at[column]]
            rough = rough_sum(tempo, key, a.p[row, 2], a.p[row, 0], self.dialect)
            some = rough_bins(rough) >= least[row]
            yield rows[part], row[some], column[some], rough[some], tempo[some], key[some]


class ChainBins(RoughWorker):
    """First pass of a step: how many open candidates of the block lie in each bin of the rough score.

    Bins below the block's own ``shortlist`` best cannot hold the cut and are not told; where they begin
    is found by halving, from ranges of tempo that lie in a bin or above for certain.
    """

    names = ["request_id", "bins", "counts"]

    def __init__(self, cands, dialect, shortlist):
        self.shortlist = shortlist
        super().__init__(cands, dialect)

    def first_bins(self, a: Rows, told):
        """A bin of each row that ``shortlist`` open candidates reach, or 0."""
        index, bpm = self.tempos, a.x[:, AT["bpm"]]
        shut = (told[0] >= 0).sum(1) + np.where(told[1] >= 0, self.identity_rows[told[1]], 0).sum(1)
        low, high = np.zeros(len(a.ids), dtype=np.int64), np.full(len(a.ids), ROUGH_BINS)
        while (high - low > 1).any():
            middle = (low + high) // 2
            gap = index.gaps(bpm, self.needs(a, a, middle)(slice(None)))
            enough = index.ranges(bpm, gap, inside=True)[1].sum((1, 2)) >= self.shortlist + shut
            low, high = np.where(enough, middle, low), np.where(enough, high, middle)
        return low

    def score(self, a: Rows):
        told = self.told(a)
        least = self.first_bins(a, told)
        out, rows, back, place = [], np.arange(len(a.ids)), 1, np.empty(len(a.ids), dtype=np.int64)
        while len(rows):
            again = []
            for some, row, _, rough, _, _ in self.reached(a, a, told, rows, least):
                place[some] = np.arange(len(some))
                counts = np.bincount(place[row] * ROUGH_BINS + rough_bins(rough), minlength=len(some) * ROUGH_BINS).reshape(-1, ROUGH_BINS)
                few = (counts.sum(1) < self.shortlist) & (least[some] > 0)
                again.append(some[few])
                above = counts[:, ::-1].cumsum(1)[:, ::-1] - counts
                at, column = np.nonzero((counts > 0) & (above < self.shortlist) & ~few[:, None])
                out.append((some[at], column, counts[at, column]))
            rows = np.concatenate(again)
            least[rows] = np.maximum(least[rows] - back, 0)  # rounding moved rows over an edge
            back *= 2
        row, column, n = (np.concatenate(x) for x in zip(*out))
        begins = np.flatnonzero(np.diff(row, prepend=-1))  # the bins of a request come together
        lists = lambda values: pa.ListArray.from_arrays(pa.array(np.append(begins, len(row)), pa.int32()), pa.array(values))
        return [a.ids[row[begins]].tolist(), lists(column.astype(np.int32)), lists(n.astype(np.int64))]


class Chain(RoughWorker):
    """Second pass of a step: the best row above the cut, and all rows of the bin that the cut lies in.

    Only rows from the cut on are scored, row by row: of a large library they are few.
    """

    names = ["request_id", "track_id", "rough", "score", "sure"]

    def __init__(self, cands, scope, vibe_lock, dialect, learned=None):
        self.scope, self.vibe_lock, self.learned = scope, vibe_lock, learned
        super().__init__(cands, dialect)
        self.coded = Coded.of(self.c, self.c)

    def exact(self, prev: Rows, anchor: Rows, c: Rows, p, tempo, key):
        """Score before artists, row by row."""
        genre, prev_genre, here, origin = p.T[:4]
        exact = handoff_score(prev, c, here, origin, prev_genre, self.dialect, tempo, key)
        lyrics = lyric(anchor, c, False) if self.dialect == "hosted" else np.full(exact.shape, np.nan)
        mood, _ = vibe(anchor, c, self.dialect, lyrics, False)
        if self.vibe_lock:
            exact = exact * (0.58 + 0.42 * mood)
        return exact * (0.88 + 0.12 * genre if self.scope == "open" else 0.60 + 0.40 * genre)

    def learned_factor(self, prev: Rows, anchor: Rows, c: Rows):
        """Learned sound and mood of anchor and candidate, and how the previous track's sound flows into it."""
        dims, moods, strength = self.learned
        factor, _, both = learned_pair(anchor.x, c.x, dims, moods, strength, False)
        flow = scaled_sound(prev.x, c.x, slice(-dims - moods, -moods), False)
        return np.where(both & indexed(prev.x), factor * (0.94 + 0.06 * flow), factor)

    def score(self, a: Rows):
        prev, anchor = second(a, a.x.shape[1] // 2, len(TEXTS))
        told, cut = self.told(a), a.p[:, 4]
        first, origin = Coded.of(prev, self.c), Coded.of(anchor, self.c)
        out = []
        for _, row, column, rough, tempo, key in self.reached(a, prev, told, np.arange(len(a.ids)), np.maximum(cut, 0)):
            if not len(row):
                continue
            sure = rough_bins(rough) > cut[row]
            again = self.by_used_artist(told, row, column)
            exact = np.empty(len(row))
            for low in range(0, len(row), PAIRS):
                at = slice(low, low + PAIRS)
                parts = first.at(row[at]), origin.at(row[at]), self.coded.at(column[at])
                value = self.exact(*parts, a.p[row[at]], tempo[at], key[at])
                value = np.where(again[at], value * 0.62, value)
                exact[at] = value if self.learned is None else clip01(value * self.learned_factor(*parts))
            top = np.flatnonzero(sure)
            if len(top):
                begins = np.flatnonzero(np.diff(row[top], prepend=-1))  # pairs come row by row
                best = np.repeat(np.maximum.reduceat(exact[top], begins), np.diff(np.append(begins, len(top))))
                top = top[~(exact[top] < best)]
                # equal scores: the best rough, then the first id
                top = top[np.lexsort((column[top], -rough[top], -exact[top], row[top]))]
                top = top[np.flatnonzero(np.diff(row[top], prepend=-1))]
            keep = np.concatenate([top, np.flatnonzero(~sure)])
            out.append((row[keep], column[keep], rough[keep], exact[keep], np.arange(len(keep)) < len(top)))
        if not out:
            return None
        row, column, rough, exact, sure = (np.concatenate(x) for x in zip(*out))
        return [a.ids[row].tolist(), self.c.ids[column].tolist(), rough, exact, sure]


def same_rows(rows: Rows):
    """(a place of each different row, which of them each row is)."""
    seen, places = {}, []
    at = np.empty(len(rows.ids), dtype=np.int64)
    for i, (x, text) in enumerate(zip(rows.x, rows.s)):
        at[i] = n = seen.setdefault((x.tobytes(), *text), len(seen))
        if n == len(places):
            places.append(i)
    return np.array(places), at


class Bridge(UsedWorker):
    """One intermediate of a bridge: the best candidate of the block.

    Requests share previous tracks and destinations: what a candidate can reach from one and to the other is bounded
    once for each.  The best bounds of a request are scored, then all others whose bound, closer by the path, reaches
    the best score found.  A request may bring a score that it has found elsewhere (the ninth value of ``p``).
    """

    names = ["request_id", "track_id", "score"]
    #: Candidates of a request that are scored before bounds are compared, and bounds of previous tracks that are kept.
    FIRST, KEPT = 32, 1 << 23

    def __init__(self, cands, step, dialect):
        self.step = step
        super().__init__(cands, dialect)
        self.coded = Coded.of(self.c, self.c)
        self.shut = np.flatnonzero(~self.playable)

    def rows_at_once(self):
        return 1 << 14

    def score(self, a: Rows):
        prev, goal = second(a, a.x.shape[1] // 2, len(TEXTS))
        (froms, from_at), (goals, goal_at) = same_rows(prev), same_rows(goal)
        sides = [_Side(prev, froms, self, False), _Side(goal, goals, self, True)]
        told, found = self.told(a), []
        kept = sides[0].bounds(np.arange(len(froms))) if len(froms) * self.size <= self.KEPT else None
        # requests of one destination together; a few destinations at a time
        order = np.argsort(goal_at, kind="stable")
        for part in parts_of(np.full(len(order), self.size), SCORED_PAIRS):
            rows = order[part]
            ends, end_at = np.unique(goal_at[rows], return_inverse=True)
            starts, start_at = np.unique(from_at[rows], return_inverse=True)
            first = kept[from_at[rows]] if kept is not None else sides[0].bounds(starts)[start_at]
            found += self.best(a, rows, told, first, sides[1].bounds(ends)[end_at], sides, (from_at, goal_at))
        if not found:
            return None
        row, column, value = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((column, -value, row))  # equal scores: the first id
        top = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
        return [a.ids[row[top]].tolist(), self.c.ids[column[top]].tolist(), value[top]]

    def best(self, a: Rows, rows, told, leave, arrive, sides, at):
        """Scored pairs of some requests: (rows, columns, scores), part by part, the best among them."""
        here, origin, genre, there, there_genre, energy0, bright0, home = a.p.T[:8]
        progress = self.step / 4
        weight = 0.22 + progress * 0.46
        styles = handoff_styles(here, origin, genre, self.dialect), handoff_styles(there, home, there_genre, self.dialect)
        least = a.p[rows, 8] if a.p.shape[1] > 8 else np.full(len(rows), -np.inf)
        bound = leave * (0.84 * (1 - weight) * styles[0][rows])[:, None]
        bound += arrive * (0.84 * weight * styles[1][rows])[:, None]
        bound[:, self.shut] = -np.inf
        off = lambda name, start, row, column: np.abs(
            self.c.x[column, AT[name]] - (start[row] * (1 - progress) + sides[1].rows.x[row, AT[name]] * progress))

        def look(place, column):
            """Scores of the open pairs whose bound with the path reaches the best."""
            row = rows[place]
            near = np.exp(-off("energy", energy0, row, column) / 18) * 0.10, np.exp(-off("brightness", bright0, row, column) / 0.24) * 0.06
            again = self.by_used_artist(told, row, column)
            most = bound[place, column] + near[0] + near[1] + BOUND_SLACK
            some = np.flatnonzero(np.where(again, most * 0.68, most) >= least[place])
            _, _, some = self.still_open(told, row[some], column[some], some)
            out = np.empty(len(some))
            for low in range(0, len(some), PAIRS):
                one = some[low:low + PAIRS]
                r, c = row[one], column[one]
                mine, (tempo, key), (tempo2, key2) = self.coded.at(c), *(s.fits(k[r], c) for s, k in zip(sides, at))
                value = handoff_score(sides[0].coded.at(r), mine, here[r], origin[r], genre[r], self.dialect, tempo, key) * (1 - weight)
                value += handoff_score(mine, sides[1].coded.at(r), there[r], home[r], there_genre[r], self.dialect, tempo2, key2) * weight
                value = value * 0.84 + near[0][one] + near[1][one]
                out[low:low + PAIRS] = np.where(again[one], value * 0.68, value)
            np.maximum.at(least, place[some], out)
            return row[some], column[some], out

        n = min(self.FIRST, self.size)
        ahead = np.argpartition(bound, self.size - n, axis=1)[:, self.size - n:] if n < self.size else np.tile(np.arange(n), (len(rows), 1))
        place, column = np.repeat(np.arange(len(rows)), n), ahead.ravel()
        some = bound[place, column] > -np.inf
        place, column = place[some], column[some]
        out = [look(place, column)]
        bound[place, column] = -np.inf  # scored
        place, column = np.nonzero((bound >= (least - 0.16 - BOUND_SLACK)[:, None]) & (bound > -np.inf))
        out.append(look(place, column))
        return out


class _Side:
    """Previous tracks or destinations of requests, each different one once."""

    def __init__(self, rows: Rows, places, worker: Bridge, into: bool):
        self.rows, self.c, self.dialect = rows, worker.c.x, worker.dialect
        self.coded, self.x = Coded.of(rows, worker.c), rows.x[places]
        keys, self.key_at = _keys(rows)
        other, self.column_at = _keys(worker.c)
        self.table = _key_table(other, keys).T if into else _key_table(keys, other)
        self.key_at = self.key_at[places]

    def bounds(self, which):
        x = self.x[which]
        return handoff_bound(x, self.c, self.dialect, tempo_fit(x, self.c), self.table[self.key_at[which]][:, self.column_at])

    def fits(self, which, column):
        return tempo_fit(self.x, self.c, (which, column)), self.table[self.key_at[which], self.column_at[column]]


def handoff_styles(here, origin, genre, dialect):
    """What styles multiply a transition score by."""
    if dialect == "classic":
        return (0.78 + 0.22 * here) * (0.90 + 0.10 * origin)
    return (0.80 + 0.12 * here + 0.08 * genre) * (0.92 + 0.08 * origin)


class Metadata(Worker):
    """Metadata score; x = (year or NaN, duration or NaN), s = (edition, sub-genre, artist, title-less names...)."""

    names = ["request_id", "track_id", "edition", "hybrid_score", "first", "second", "third"]

    def __init__(self, cands, mode, k, weights):
        self.mode, self.k, self.weights = mode, k, weights
        super().__init__(cands)
        by_name = {}
        for i, row in enumerate(cands.s):
            for name in set(row[3].split("\u0001")):
                by_name.setdefault(name, []).append(i)
        self.by_name = {name: np.array(at) for name, at in by_name.items()}
        self.by_edition, self.by_genre, self.by_artist = (grouped(cands.s[:, i]) for i in range(3))
        self.years = np.unique(cands.x[:, 0], return_inverse=True)  # NaN is one year more

    def reset(self):
        self.seen = np.zeros(self.size, dtype=bool)

    def feed(self, side, data):
        for track in data.ids:
            if track in self.index:
                self.seen[self.index[track]] = True

    def liked(self, used):
        out = np.zeros(self.size)
        for columns, values, weight in ((self.by_genre, used[0], 1.0), (self.by_artist, used[1], 0.35)):
            for value in set(values):
                if value in columns:
                    out[columns[value]] += weight
        return np.minimum(1.0, out)

    def score(self, a: Rows):
        shape = (len(a.ids), self.size)
        genre = a.p[:, 0][:, None]
        shared = np.zeros(shape)
        for row, text in zip(shared, a.s):
            for name in text[3].split("\u0001"):
                if name in self.by_name:
                    row[self.by_name[name]] = 1.0

        def decay(column, default, width, other):
            base = np.where(np.isnan(a.x[:, column]), default, a.x[:, column])[:, None]
            gap = np.where(np.isnan(other), base, other)
            gap -= base
            np.abs(gap, out=gap)
            gap /= -width
            return np.exp(gap, out=gap)

        years, at = self.years
        era = 0.65 * np.take(decay(0, 2005, 12, years[None, :]), at, axis=1)
        era += 0.35 * decay(1, 210_000, 120_000, self.c.x[:, 1][None, :])
        if self.mode == "adjacent":
            near, fresh = np.where(genre == 1.0, 0.25, genre), np.where(shared > 0, 0.1, 1.0)
            total, parts = 0.60 * near + 0.25 * fresh + 0.15 * era, (near, fresh, era)
        elif self.mode == "same-era":
            total, parts = 0.20 * genre + 0.10 * shared + 0.70 * era, (genre, shared, era)
        elif self.mode == "discover":
            fresh = np.where(shared > 0, 0.1, 1.0)
            total = np.maximum(0.0, 0.45 * genre + 0.35 * fresh + 0.20 * era - np.where(self.seen, 0.40, 0.0)[None, :])
            parts = (genre, fresh, era)
        else:
            w = self.weights
            total, parts = w[0] * genre + w[1] * shared + w[2] * era, (genre, shared, era)
            has = np.array([bool(u and (u[0] or u[1])) for u in a.used])[:, None]
            if self.mode == "personalized" and has.any():
                one, told = {}, []  # the rows of a listener carry the same taste
                for used, some in zip(a.used, has[:, 0]):
                    taste = (tuple(used[0]), tuple(used[1])) if some else ((), ())
                    if taste not in one:
                        one[taste] = self.liked(taste)
                    told.append(one[taste])
                liked = np.stack(told)
                novelty = 0.625 * era + 0.375 * np.where(self.seen, 0.15, 1.0)[None, :]
                total = np.where(has, 0.40 * liked + 0.20 * genre + 0.40 * novelty, total)
                parts = tuple(np.where(has, p, q) for p, q in zip((liked, genre, novelty), parts))
        total = np.round(np.minimum(1.0, total, out=total), 4, out=total)
        for row, text in zip(total, a.s):
            row[self.by_edition.get(text[0], [])] = -1.0
            if text[4] in self.index:
                row[self.index[text[4]]] = -1.0
        editions = self.c.s[:, 0]
        out = tuple([] for _ in self.names)
        for i, columns in enumerate(best_first(total, 2 * self.k)):
            chosen = self.pick(total[i], columns)
            if len(chosen) < self.k and len(columns) < self.size:
                chosen = self.pick(total[i], np.argsort(-total[i], kind="stable"))
            for target, values in zip(out, ([a.ids[i]] * len(chosen), self.c.ids[chosen], editions[chosen], total[i, chosen],
                                            *[np.broadcast_to(p, shape)[i, chosen] for p in parts])):
                target.extend(values)
        return list(out)

    def pick(self, total, columns):
        """The best column of each of the first k editions; ``columns`` come best first."""
        taken, chosen = set(), []
        for column in columns.tolist():
            if total[column] < 0 or len(chosen) >= self.k:
                break
            edition = self.c.s[column, 0]
            if edition not in taken:
                taken.add(edition)
                chosen.append(column)
        return chosen
