"""Pair expressions over prepared library rows (see operators/library.py).

``a`` and ``b`` are callables that return the column of one side of the pair,
e.g. ``side("a")("bpm") == F.col("a_bpm")``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tonearm.functions import taxonomy as tx
from tonearm.functions.style import Styles
from tonearm.functions.vectors import bounded_similarity, clip, dot

# fixed values: scales and sharpness of each bounded similarity
RHYTHM = (["bpm", "tempo_confidence", "onset_density", "beat_regularity", "percussive_ratio", "danceability"],
          [70, 1, 5, 1, 1, 1], 2.2)
PROFILE = (["brightness", "spectral_flatness", "spectral_contrast", "zero_crossing_rate", "harmonic_ratio",
            "aggression", "dynamic_range"], [1, 0.35, 35, 0.25, 1, 1, 1], 2.2)
MFCC_SCALES, MFCC_SHARPNESS = [180, 90, 70, 60, 55, 50, 45, 42, 40, 38, 36, 34, 32], 1.8
HARMONIC = (["tonal_strength", "harmonic_ratio", "valence"], [1, 1, 1], 1.7)
VIBE = (["energy", "danceability", "brightness", "aggression", "dynamic_range", "onset_density", "percussive_ratio",
         "harmonic_ratio"], [38, 0.45, 0.45, 0.45, 0.55, 3.5, 0.45, 0.50], 2.35)
HANDOFF_ENERGY = (["energy", "aggression", "dynamic_range", "danceability"], [55, 1, 1, 1], 1.7)
LIVE = "client-preview-v1"


def side(prefix: str):
    return lambda name: F.col(f"{prefix}_{name}")


def _bounded(a, b, spec) -> Column:
    names, scales, sharpness = spec
    return bounded_similarity([(a(n), b(n)) for n in names], scales, sharpness)


def live_pair(a, b) -> Column:
    return a("live") | b("live")


def rotated_chroma(a, b) -> Column:
    """Best cosine over the 12 rotations of the unit chroma of ``b``."""
    doubled = F.concat(b("chroma_unit"), b("chroma_unit"))
    return F.array_max(F.transform(F.sequence(F.lit(1), F.lit(12)),
                                   lambda s: dot(a("chroma_unit"), F.slice(doubled, s, F.lit(12)))))


def mfcc_similarity(a, b) -> Column:
    pairs = [(a("mfcc")[i], b("mfcc")[i]) for i in range(13)]
    return bounded_similarity(pairs, MFCC_SCALES, MFCC_SHARPNESS)


def timbre(a, b, dialect: str = "hosted") -> Column:
    mfcc, profile = mfcc_similarity(a, b), _bounded(a, b, PROFILE)
    plain = 0.55 * mfcc + 0.45 * profile
    return plain if dialect == "classic" else F.when(live_pair(a, b), 0.20 * mfcc + 0.80 * profile).otherwise(plain)


def rhythm(a, b) -> Column:
    return _bounded(a, b, RHYTHM)


def harmony(a, b, dialect: str = "hosted") -> Column:
    chroma, profile = rotated_chroma(a, b), _bounded(a, b, HARMONIC)
    plain = 0.65 * chroma + 0.35 * profile
    if dialect == "classic":
        return clip(plain)
    return clip(F.when(live_pair(a, b), 0.35 * chroma + 0.65 * profile).otherwise(plain))


def components(a, b, dialect: str = "hosted") -> dict[str, Column]:
    return {"rhythm": rhythm(a, b), "timbre": timbre(a, b, dialect), "harmony": harmony(a, b, dialect)}


def title_match(a, b) -> Column:
    """1/0 when both titles carry a mood, null otherwise."""
    return F.when(a("mood").isNotNull() & b("mood").isNotNull(), (a("mood") == b("mood")).cast("double"))


def lyric_similarity(a, b) -> Column:
    """Null unless both sides have usable lyric features."""
    ta, tb = a("theme_vector"), b("theme_vector")
    shared = F.aggregate(F.map_keys(ta), F.lit(0.0), lambda s, k: s + ta[k] * F.coalesce(tb[k], F.lit(0.0)))
    theme = F.greatest(F.lit(0.0), shared / F.greatest(F.sqrt(a("theme_sq") * b("theme_sq")), F.lit(1e-10)))
    theme = F.coalesce(theme, F.lit(0.0))
    gap = lambda name, default: F.abs(F.coalesce(a(name), F.lit(default)) - F.coalesce(b(name), F.lit(default)))
    sentiment = 1 - F.least(F.lit(1.0), gap("sentiment", 0.0) / 2)
    arousal = 1 - F.least(F.lit(1.0), gap("arousal", 0.5))
    language = F.when((a("language") != "") & (a("language") == b("language")), F.lit(1.0)).otherwise(F.lit(0.65))
    return F.when(a("has_lyrics") & b("has_lyrics"),
                  clip(0.55 * theme + 0.20 * sentiment + 0.15 * arousal + 0.10 * language))


def vibe(a, b, dialect: str = "hosted", lyric: Column | None = None) -> Column:
    acoustic = _bounded(a, b, VIBE)
    same = [a(n).eqNullSafe(b(n)).cast("double") for n in ("intensity", "rhythm_character", "tempo_band")]
    character = (same[0] + same[1] + same[2]) / 3
    title = title_match(a, b)
    plain = 0.78 * acoustic + 0.22 * character
    if dialect == "classic":
        return clip(F.when(title.isNull(), plain).otherwise(0.70 * acoustic + 0.18 * character + 0.12 * title))
    lyric = lyric_similarity(a, b) if lyric is None else lyric
    semantic = (F.when(title.isNotNull() & lyric.isNotNull(), (title + lyric) / 2)
                .otherwise(F.coalesce(title, lyric)))
    return clip(F.when(semantic.isNull(), plain).otherwise(0.62 * acoustic + 0.18 * character + 0.20 * semantic))


def tempo_difference(a, b) -> Column:
    x, y = a("bpm"), b("bpm")
    return F.least(F.abs(x - y), F.abs(x - y * 2), F.abs(x * 2 - y))


def key_compatibility(a, b) -> Column:
    ka, kb, ma, mb = a("key_no"), b("key_no"), a("mode"), b("mode")
    step = F.pmod(kb - ka, F.lit(12))
    return (
        F.when((ka < 0) | (kb < 0), F.lit(0.45))
        .when((step == 0) & (ma == mb), F.lit(1.0))
        .when((ma == "major") & (mb == "minor") & (step == 9), F.lit(0.98))
        .when((ma == "minor") & (mb == "major") & (step == 3), F.lit(0.98))
        .when((ma == mb) & step.isin(5, 7), F.lit(0.92))
        .when(step == 0, F.lit(0.84))
        .when((ma == mb) & step.isin(2, 10), F.lit(0.72))
        .otherwise(F.lit(0.30))
    )


def weighted(parts: dict[str, Column], weights) -> Column:
    return weights[0] * parts["rhythm"] + weights[1] * parts["timbre"] + weights[2] * parts["harmony"]


def _reasons(options) -> Column:
    listed = F.array(*[F.when(cond, text) for cond, text in options])
    return F.slice(F.array_distinct(F.filter(listed, lambda r: r.isNotNull())), 1, 3)


def _spaced(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value, F.lit("undefined")), "-", " ")


def match_reasons(a, b, harmony_: Column, genre: Column, vibe_: Column, lyric: Column | None,
                  dialect: str = "hosted") -> Column:
    """Up to three distinct reasons in priority order."""
    label = F.when(a("primary") == "", F.lit("genre")).otherwise(a("primary"))
    options = []
    if dialect == "hosted" and lyric is not None:
        options.append((lyric >= 0.82, F.lit("related lyrical themes")))
    options += [
        (genre >= 0.90, F.concat(F.lit("same "), label, F.lit(" lane"))),
        (vibe_ >= 0.78, F.lit("same vibe")),
        (tempo_difference(a, b) <= 8, F.lit("close tempo")),
        (a("texture").eqNullSafe(b("texture")), F.concat(_spaced(a("texture")), F.lit(" texture"))),
        (F.abs(a("aggression") - b("aggression")) <= 0.09, F.lit("matched intensity")),
        (a("rhythm_character").eqNullSafe(b("rhythm_character")),
         F.concat(_spaced(a("rhythm_character")), F.lit(" rhythm"))),
        (harmony_ >= 0.94, F.lit("compatible harmony")),
    ]
    return _reasons(options)


def handoff(prev, cand, anchor, styles: Styles, dialect: str = "hosted") -> dict[str, Column]:
    """Transition metrics from ``prev`` to ``cand`` inside a run that began at ``anchor``."""
    gap = tempo_difference(prev, cand)
    tempo = F.exp(-gap / 12)
    straight = F.greatest(F.lit(0.0), dot(prev("chroma_unit"), cand("chroma_unit")))
    key = key_compatibility(prev, cand)
    mixed = 0.72 * key + 0.28 * straight
    if dialect == "hosted":
        mixed = F.when(live_pair(prev, cand), 0.86 * key + 0.14 * straight).otherwise(mixed)
    harmonic, tone = clip(mixed), timbre(prev, cand, dialect)
    energy = _bounded(prev, cand, HANDOFF_ENERGY)
    here = styles.similarity(prev("style"), cand("style"))
    origin = styles.similarity(anchor("style"), cand("style"))
    genre = styles.genre_similarity(prev("primary"), prev("sub"), cand("primary"), cand("sub"))
    lyric = lyric_similarity(prev, cand)
    mood = vibe(prev, cand, dialect, lyric)
    if dialect == "classic":
        base = 0.36 * tempo + 0.30 * harmonic + 0.20 * tone + 0.14 * energy
        score = base * (0.78 + 0.22 * here) * (0.90 + 0.10 * origin)
    else:
        base = F.when(lyric.isNull(), 0.31 * tempo + 0.27 * harmonic + 0.17 * tone + 0.11 * energy + 0.14 * mood
                      ).otherwise(0.29 * tempo + 0.25 * harmonic + 0.16 * tone + 0.10 * energy + 0.12 * mood
                                  + 0.08 * lyric)
        score = base * (0.80 + 0.12 * here + 0.08 * genre) * (0.92 + 0.08 * origin)
    arrow = lambda x, y: F.concat(x, F.lit("→"), y)
    beats = F.concat(arrow(*[F.floor(s("bpm") + 0.5).cast("string") for s in (prev, cand)]), F.lit(" BPM"))
    keys = arrow(*[F.concat_ws(" ", s("key"), s("mode")) for s in (prev, cand)])
    options = [(gap <= 5, beats), (key >= 0.90, keys), (energy >= 0.88, F.lit("steady energy handoff")),
               (tone >= 0.86, F.lit("matched texture"))]
    if dialect == "hosted":
        options += [(mood >= 0.86, F.lit("same vibe")), (lyric >= 0.82, F.lit("lyrical mood continuity"))]
    found = _reasons(options)
    reasons = F.when(F.size(found) == 0, F.array(F.lit("balanced tempo and tone"))).otherwise(found)
    return {"tempo": tempo, "timbre": tone, "harmony": harmonic, "key": key, "energy": energy, "genre": genre,
            "vibe": mood, "lyric": lyric, "score": clip(score), "reasons": reasons,
            "note": F.concat(beats, F.lit(" · "), keys)}


def rough_handoff(prev, cand, anchor, styles: Styles, dialect: str = "hosted") -> Column:
    """Cheap score used to shortlist the candidates of one transition step."""
    tempo = F.exp(-tempo_difference(prev, cand) / 12)
    key = key_compatibility(prev, cand)
    here = styles.similarity(prev("style"), cand("style"))
    if dialect == "classic":
        return 0.50 * tempo + 0.32 * key + 0.18 * here
    genre = styles.genre_similarity(anchor("primary"), anchor("sub"), cand("primary"), cand("sub"))
    return 0.47 * tempo + 0.30 * key + 0.13 * here + 0.10 * genre


def base_score(mode: str, parts, vibe_: Column, lyric: Column | None, genre: Column, id_hash: Column, weights,
               dialect: str = "hosted") -> Column:
    r, t, h = parts["rhythm"], parts["timbre"], parts["harmony"]
    if mode == "rhythm":
        return 0.72 * r + 0.12 * vibe_ + 0.10 * h + 0.06 * t
    if mode == "timbre":
        return 0.72 * t + 0.12 * vibe_ + 0.10 * h + 0.06 * r
    acoustic = weighted(parts, weights)
    if mode == "discover":
        return 0.42 * acoustic + 0.30 * vibe_ + 0.18 * genre + 0.10 * id_hash
    if dialect == "classic" or lyric is None:
        return acoustic
    w = tx.LYRIC_WEIGHTS[mode]
    return F.when(lyric.isNull(), acoustic).otherwise((1 - w) * acoustic + w * lyric)
