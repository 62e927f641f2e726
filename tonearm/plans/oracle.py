"""Check SQL for DuckDB: shared views of the domain tables and pair formulas.

Only text is built here; nothing in the package executes it.
"""

from __future__ import annotations

import re

from tonearm.functions import taxonomy as tx
from tonearm.schemas import KEY_NAMES
from tonearm.sources import adapters as ad

D = ad.Dialect("duckdb")
EDITION = tx.EDITION_SUFFIX.removeprefix("(?i)").replace("'", "''")


def lit(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def clean(x: str) -> str:
    return f"lower(trim(coalesce({x}, '')))"


def words_only(x: str, keep: str = r"\p{L}\p{N}") -> str:
    return f"trim(regexp_replace({x}, '[^{keep}]+', ' ', 'g'))"


def title_key(t: str) -> str:
    return words_only(f"regexp_replace({clean(t)}, '{EDITION}', '', 'i')")


def identity(t: str, a: str) -> str:
    return f"({title_key(t)} || '::' || {words_only(clean(a))})"


def norm_search(x: str) -> str:
    return words_only(f"translate(lower(coalesce({x}, '')), '''’`', '')")


def norm_folded(x: str) -> str:
    return words_only(f"translate(lower(strip_accents({x})), '''’`', '')")


def mood(t: str, a: str) -> str:
    text = f"lower(trim(coalesce({t}, '') || ' ' || coalesce({a}, '')))"
    return (f"CASE WHEN regexp_matches({text}, '{tx.NEGATIVE_TITLE}') THEN -1 "
            f"WHEN regexp_matches({text}, '{tx.POSITIVE_TITLE}') THEN 1 END")


def clip(x: str, low: str = "0.0", high: str = "1.0") -> str:
    return f"least({high}::DOUBLE, greatest({low}::DOUBLE, {x}))"


def bs(a: str, b: str, names, scales, sharp) -> str:
    terms = [f"abs({a}.{n} - {b}.{n}) / {s}::DOUBLE" for n, s in zip(names, scales)]
    return clip(f"exp(-{sharp}::DOUBLE * ({' + '.join(terms)}) / {len(terms)}::DOUBLE)")


BAND_SQL = """
  CASE WHEN aggression > 0.72 THEN 'ferocious' WHEN energy > 55 OR aggression > 0.55 THEN 'driving'
    WHEN energy > 28 THEN 'restrained' ELSE 'low-intensity' END AS intensity,
  CASE WHEN spectral_flatness > 0.18 OR (zero_crossing_rate > 0.14 AND aggression > 0.58) THEN 'noisy-distorted'
    WHEN percussive_ratio > 0.56 AND brightness > 0.42 THEN 'bright-percussive'
    WHEN harmonic_ratio > 0.64 AND brightness < 0.38 THEN 'warm-harmonic'
    WHEN rms_energy < 0.08 AND brightness > 0.35 THEN 'airy-sparse' ELSE 'dense-balanced' END AS texture,
  CASE WHEN onset_density > 3.6 AND percussive_ratio > 0.48 THEN 'rhythm-forward'
    WHEN beat_regularity > 0.72 THEN 'steady-pulse' WHEN onset_density < 1.2 THEN 'sparse-rhythm'
    ELSE 'loose-flow' END AS rhythm_character,
  CASE WHEN tonal_strength < 0.16 THEN 'tonally-ambiguous' WHEN mode = 'minor' AND valence < 0.57 THEN 'dark-minor'
    WHEN mode = 'major' THEN 'bright-major' ELSE 'harmonically-rich' END AS harmonic_character,
  CASE WHEN bpm < 70 THEN 'slow-drift' WHEN bpm < 96 THEN 'measured-groove' WHEN bpm < 126 THEN 'mid-pulse'
    WHEN bpm < 156 THEN 'fast-drive' ELSE 'high-velocity' END AS tempo_band"""

_THEMES = ad.CHECK_THEMES
_VOCAB = ", ".join(f"('{w}', '{k}', {repr(t) if t else 'NULL'})" for w, k, t in ad.CHECK_VOCABULARY)
_TV = "[" + ", ".join(f"round(n_{t} / greatest(1.0, {', '.join(f'n_{x}' for x in _THEMES)}), 4)" for t in _THEMES) + "]"
_MAXT = "greatest(1.0::DOUBLE, " + ", ".join(f"n_{x}" for x in _THEMES) + ")"
_TV = "[" + ", ".join(f"round(n_{t} / {_MAXT}, 4)" for t in _THEMES) + "]"
_RANKED = ("list_transform(list_sort(list_filter([" +
           ", ".join(f"{{'n': n_{t}, 'o': {-i}, 't': '{t}'}}" for i, t in enumerate(_THEMES)) +
           "], lambda x: x.n > 0), 'DESC')[1:4], lambda x: x.t)")


def ln_rounded(x):
    return f"round({x}, 6)"


VIEWS: dict[str, str] = {
    "tracks": ad.tracks_sql(D),
    "raw_fp": ad.raw_fingerprints_sql(D),
    "fp": f"""
SELECT *, intensity || ' · ' || texture || ' · ' || rhythm_character || ' · ' || harmonic_character || ' · '
  || tempo_band AS acoustic_signature
FROM (SELECT *, {lit(KEY_NAMES)}[list_position(vector[24:35], list_max(vector[24:35]))] AS key, {BAND_SQL}
      FROM raw_fp)""",
    "vocab": f"SELECT * FROM (VALUES {_VOCAB}) v(word, kind, theme)",
    "lyr_words": r"""
SELECT 'apple-' || doc_id AS track_id, lang AS language,
  regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}'']+') AS words FROM documents""",
    "lyr_counts": "SELECT track_id, language, CAST(len(words) AS DOUBLE) AS words, "
    + ", ".join(f"CAST(len(list_filter(words, lambda w: list_contains({lit([w for w, k, t in ad.CHECK_VOCABULARY if t == th])}, w))) AS DOUBLE) AS n_{th}" for th in _THEMES)
    + ", " + ", ".join(f"CAST(len(list_filter(words, lambda w: list_contains({lit([w for w, k, t in ad.CHECK_VOCABULARY if k == kind])}, w))) AS DOUBLE) AS {kind}" for kind in ("positive", "negative", "arousal"))
    + " FROM lyr_words",
    "lyr": f"""
SELECT track_id, language, words < 8 AS instrumental, {_RANKED} AS themes, {_TV} AS theme_vec,
  CASE WHEN positive + negative > 0 THEN {clip('(positive - negative) / (positive + negative)', '-1.0')} ELSE 0.0 END AS sentiment,
  {clip('arousal / greatest(8.0::DOUBLE, words * 0.035::DOUBLE)')} AS arousal,
  {clip(f'0.45::DOUBLE + words / 900 + len({_RANKED}) * 0.06::DOUBLE', '0.25', '0.95')} AS confidence
FROM lyr_counts""",
    "learned": ad.learned_sql(D),
    "interactions": ad.interactions_sql(D),
    "favorites": ad.FAVORITES_SQL,
    "runs": ad.RUNS_SQL,
    "items": ad.ITEMS_SQL,
    "plays": ad.PLAYS_SQL,
    "frames": ad.frames_sql(D),
    "run_pairs": "SELECT DISTINCT anchor_track_id AS anchor_id, track_id FROM runs JOIN items ON runs.id = items.run_id",
    "lib": f"""
SELECT f.*, t.title, t.artist, t.album, t.preview_url, t.provider_genre, t.provider_subgenre, t.seed_genre,
  {identity('t.title', 't.artist')} AS ident, {clean('t.artist')} AS artist_key,
  {clean('coalesce(t.provider_genre, t.provider_subgenre)')} AS prim,
  {clean('coalesce(t.provider_subgenre, t.seed_genre)')} AS sub, {clean('t.provider_subgenre')} AS style,
  {mood('t.title', 't.album')} AS mood, coalesce(t.preview_url, '') <> '' AS playable,
  list_position({lit(KEY_NAMES)}, f.key) - 1 AS key_no,
  f.vector[24:35] AS chroma, list_aggregate(list_transform(f.vector[24:35], lambda x: x * x), 'sum') AS chroma_sq,
  [list_concat(f.vector[24:35][s+1:12], f.vector[24:35][1:s]) FOR s IN range(12)] AS rotations,
  {' , '.join(f'f.vector[{11 + i}] AS mf{i}' for i in range(13))},
  (coalesce(l.confidence, 0) > 0 AND NOT coalesce(l.instrumental, false)) AS has_lyrics, l.theme_vec,
  list_aggregate(list_transform(l.theme_vec, lambda x: x * x), 'sum') AS theme_sq, l.sentiment, l.arousal AS l_arousal,
  coalesce(l.language, '') AS language, l.themes, l.confidence, l.instrumental
FROM fp f JOIN tracks t ON f.track_id = t.track_id LEFT JOIN lyr l ON l.track_id = f.track_id""",
    "families": "SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{f}')" for s, f in tx.families()) + ") x(style, family)",
    "adjacent": "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {v}::DOUBLE)" for a, b, v in tx.adjacency()) + ") x(s1, s2, value)",
    # every pair of distinct styles of the library, hosted rules
    "styles": "SELECT DISTINCT style FROM (SELECT prim AS style FROM lib UNION SELECT sub FROM lib UNION SELECT style FROM lib)",
    "style_pair": """
SELECT a.style AS s1, b.style AS s2,
  CASE WHEN a.style = '' OR b.style = '' THEN 0.25::DOUBLE WHEN a.style = b.style THEN 1.0::DOUBLE
    WHEN d1.value IS NOT NULL THEN d1.value WHEN d2.value IS NOT NULL THEN d2.value
    WHEN coalesce(fa.family, a.style) = coalesce(fb.family, b.style) THEN 0.34::DOUBLE
    WHEN list_sort([fa.family, fb.family]) = ['metal', 'rock'] THEN 0.14::DOUBLE
    WHEN list_sort([fa.family, fb.family]) IN (['pop', 'rock'], ['electronic', 'pop'], ['hip-hop', 'r&b']) THEN 0.12::DOUBLE
    ELSE 0.04::DOUBLE END AS sim
FROM styles a CROSS JOIN styles b LEFT JOIN families fa ON fa.style = a.style LEFT JOIN families fb ON fb.style = b.style
LEFT JOIN adjacent d1 ON d1.s1 = a.style AND d1.s2 = b.style LEFT JOIN adjacent d2 ON d2.s1 = b.style AND d2.s2 = a.style""",
    "lanes": "SELECT DISTINCT prim, sub FROM lib",
    "genre_pair": """
SELECT a.prim AS p1, a.sub AS u1, b.prim AS p2, b.sub AS u2,
  CASE WHEN a.prim <> '' AND a.prim = b.prim THEN 1.0::DOUBLE WHEN a.sub <> '' AND a.sub = b.sub THEN 0.9::DOUBLE
    ELSE greatest(x.sim, y.sim * 0.82::DOUBLE) END AS genre
FROM lanes a CROSS JOIN lanes b JOIN style_pair x ON x.s1 = a.sub AND x.s2 = b.sub
JOIN style_pair y ON y.s1 = a.prim AND y.s2 = b.prim""",
}


def rhythm(a="a", b="b"):
    return bs(a, b, ["bpm", "tempo_confidence", "onset_density", "beat_regularity", "percussive_ratio", "danceability"],
              [70, 1, 5, 1, 1, 1], 2.2)


def timbre(a="a", b="b", live=False):
    mf = bs(a, b, [f"mf{i}" for i in range(13)], [180, 90, 70, 60, 55, 50, 45, 42, 40, 38, 36, 34, 32], 1.8)
    pr = bs(a, b, ["brightness", "spectral_flatness", "spectral_contrast", "zero_crossing_rate", "harmonic_ratio",
                   "aggression", "dynamic_range"], [1, 0.35, 35, 0.25, 1, 1, 1], 2.2)
    return f"(0.20::DOUBLE * {mf} + 0.80::DOUBLE * {pr})" if live else f"(0.55::DOUBLE * {mf} + 0.45::DOUBLE * {pr})"


def harmony(a="a", b="b", live=False):
    rot = (f"list_max(list_transform({b}.rotations, lambda r: list_dot_product({a}.chroma, r))) "
           f"/ greatest(sqrt({a}.chroma_sq * {b}.chroma_sq), 1e-10)")
    hp = bs(a, b, ["tonal_strength", "harmonic_ratio", "valence"], [1, 1, 1], 1.7)
    return clip(f"(0.35::DOUBLE * {rot} + 0.65::DOUBLE * {hp})" if live else f"(0.65::DOUBLE * {rot} + 0.35::DOUBLE * {hp})")


def lyric(a="a", b="b"):
    theme = (f"greatest(0.0::DOUBLE, list_dot_product({a}.theme_vec, {b}.theme_vec) "
             f"/ greatest(sqrt({a}.theme_sq * {b}.theme_sq), 1e-10))")
    return (f"CASE WHEN {a}.has_lyrics AND {b}.has_lyrics THEN " + clip(
        f"(0.55::DOUBLE * {theme} + 0.20::DOUBLE * (1 - least(1.0::DOUBLE, abs({a}.sentiment - {b}.sentiment) / 2)) "
        f"+ 0.15::DOUBLE * (1 - least(1.0::DOUBLE, abs({a}.l_arousal - {b}.l_arousal))) "
        f"+ 0.10::DOUBLE * CASE WHEN {a}.language <> '' AND {a}.language = {b}.language THEN 1.0 ELSE 0.65 END::DOUBLE)") + " END")


def title_match(a="a", b="b"):
    return f"CASE WHEN {a}.mood IS NOT NULL AND {b}.mood IS NOT NULL THEN CAST({a}.mood = {b}.mood AS DOUBLE) END"


def vibe_parts(a="a", b="b"):
    """(acoustic, character) of the vibe score."""
    acoustic = bs(a, b, ["energy", "danceability", "brightness", "aggression", "dynamic_range", "onset_density",
                         "percussive_ratio", "harmonic_ratio"], [38, 0.45, 0.45, 0.45, 0.55, 3.5, 0.45, 0.5], 2.35)
    character = ("(" + " + ".join(f"CAST({a}.{n} IS NOT DISTINCT FROM {b}.{n} AS DOUBLE)"
                                  for n in ("intensity", "rhythm_character", "tempo_band")) + ") / 3")
    return acoustic, character


def vibe_classic(acoustic, character, title):
    return clip(f"CASE WHEN {title} IS NULL THEN 0.78::DOUBLE * {acoustic} + 0.22::DOUBLE * {character} "
                f"ELSE 0.70::DOUBLE * {acoustic} + 0.18::DOUBLE * {character} + 0.12::DOUBLE * {title} END")


def vibe_of(acoustic, character, title, lyr):
    sem = f"CASE WHEN {title} IS NOT NULL AND {lyr} IS NOT NULL THEN ({title} + {lyr}) / 2 ELSE coalesce({title}, {lyr}) END"
    return clip(f"CASE WHEN ({sem}) IS NULL THEN 0.78::DOUBLE * {acoustic} + 0.22::DOUBLE * {character} "
                f"ELSE 0.62::DOUBLE * {acoustic} + 0.18::DOUBLE * {character} + 0.20::DOUBLE * ({sem}) END")


def tempo_gap(a="a", b="b"):
    return f"least(abs({a}.bpm - {b}.bpm), abs({a}.bpm - {b}.bpm * 2), abs({a}.bpm * 2 - {b}.bpm))"


def key_compat(a="a", b="b"):
    step = f"((({b}.key_no - {a}.key_no) % 12 + 12) % 12)"
    return f"""CASE WHEN {a}.key_no IS NULL OR {b}.key_no IS NULL THEN 0.45 WHEN {step} = 0 AND {a}.mode = {b}.mode THEN 1.0
  WHEN {a}.mode = 'major' AND {b}.mode = 'minor' AND {step} = 9 THEN 0.98
  WHEN {a}.mode = 'minor' AND {b}.mode = 'major' AND {step} = 3 THEN 0.98
  WHEN {a}.mode = {b}.mode AND {step} IN (5, 7) THEN 0.92 WHEN {step} = 0 THEN 0.84
  WHEN {a}.mode = {b}.mode AND {step} IN (2, 10) THEN 0.72 ELSE 0.30 END::DOUBLE"""


# all pair scores of one pair relation: `pairs` must expose aliases a and b of lib
def scored_pairs(source: str, extra: str = "", where: str = "", live: bool = False, classic: bool = False) -> str:
    """SELECT with every similarity part; ``source`` is a FROM clause binding a and b; ``live``: a is a live analysis."""
    acoustic, character = vibe_parts()
    vibe = vibe_classic("v_acoustic", "v_character", "title_sim") if classic else vibe_of("v_acoustic", "v_character", "title_sim", "lyric_sim")
    lyrics = "CAST(NULL AS DOUBLE)" if classic else lyric()
    return f"""
SELECT *, {vibe} AS vibe
FROM (SELECT a.track_id AS anchor_id, b.track_id AS track_id, a.ident AS a_ident, b.ident AS b_ident,
  a.artist_key AS a_artist_key, b.artist_key AS b_artist_key, a.prim AS a_prim, b.prim AS b_prim,
  gp.genre AS genre, {rhythm()} AS rhythm, {timbre(live=live)} AS timbre, {harmony(live=live)} AS harmony, {lyrics} AS lyric_sim,
  {title_match()} AS title_sim, {acoustic} AS v_acoustic, {character} AS v_character, {tempo_gap()} AS tempo_gap,
  a.texture AS a_texture, b.texture AS b_texture, abs(a.aggression - b.aggression) AS aggression_gap,
  a.rhythm_character AS a_rhythm_character, b.rhythm_character AS b_rhythm_character {extra}
  FROM {source} JOIN genre_pair gp ON gp.p1 = a.prim AND gp.u1 = a.sub AND gp.p2 = b.prim AND gp.u2 = b.sub {where})"""


def reasons_sql() -> str:
    opts = [("lyric_sim >= 0.82", "'related lyrical themes'"),
            ("genre >= 0.90", "'same ' || CASE WHEN a_prim = '' THEN 'genre' ELSE a_prim END || ' lane'"),
            ("vibe >= 0.78", "'same vibe'"), ("tempo_gap <= 8", "'close tempo'"),
            ("a_texture IS NOT DISTINCT FROM b_texture", "replace(a_texture, '-', ' ') || ' texture'"),
            ("aggression_gap <= 0.09", "'matched intensity'"),
            ("a_rhythm_character IS NOT DISTINCT FROM b_rhythm_character", "replace(a_rhythm_character, '-', ' ') || ' rhythm'"),
            ("harmony >= 0.94", "'compatible harmony'")]
    items = ", ".join(f"CASE WHEN {c} THEN {t} END" for c, t in opts)
    return f"array_to_string(list_filter([{items}], lambda x: x IS NOT NULL)[1:3], ' | ')"


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the views it mentions, dependencies first."""
    views = {**VIEWS, **(extra or {})}
    needed: list[str] = []

    def visit(text: str):
        for name in views:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN|from|join|,)\s+{name}\b", text):
                visit(views[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body.strip()
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({views[n].strip()})" for n in needed)
    return f"WITH {ctes}\n{body.strip()}"
