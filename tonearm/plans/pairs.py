"""Pair similarity queries (the pairs are anchor and item of every recorded run)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonearm.functions import acoustic, style, text, vectors
from tonearm.functions.style import Styles
from tonearm.operators.library import pair_up
from tonearm.plans import oracle as o
from tonearm.plans.registry import query, r6, r6s

A, B = acoustic.side("a"), acoustic.side("b")
PAIRS = "run_pairs rp JOIN lib a ON a.track_id = rp.anchor_id JOIN lib b ON b.track_id = rp.track_id"
IDS = "rp.anchor_id AS anchor_id, rp.track_id AS track_id"


def pairs(c):
    return pair_up(c.run_pairs, c.prepared)


@query("q_style_family", sql="""
SELECT s.style, coalesce(f.family, s.style) AS family FROM (SELECT DISTINCT lower(trim(provider_subgenre)) AS style
FROM tracks UNION SELECT DISTINCT lower(trim(provider_genre)) FROM tracks) s LEFT JOIN families f ON f.style = s.style""")
def q_style_family(c):
    t = c.tracks
    styles = t.select(text.clean("provider_subgenre").alias("style")).union(t.select(text.clean("provider_genre"))).distinct()
    return styles.select("style", Styles().family("style").alias("family"))


@query("q_style_similarity", sql=f"""
SELECT {IDS}, x.sim AS similarity FROM {PAIRS} JOIN style_pair x ON x.s1 = a.style AND x.s2 = b.style""")
def q_style_similarity(c):
    return pairs(c).select("anchor_id", "track_id", Styles().similarity(A("style"), B("style")).alias("similarity"))


@query("q_primary_genre", sql="""
SELECT track_id, lower(trim(coalesce(provider_genre, provider_subgenre, ''))) AS primary_genre,
  lower(trim(coalesce(provider_subgenre, seed_genre, ''))) AS sub_genre FROM tracks""")
def q_primary_genre(c):
    return c.tracks.select("track_id", style.primary_genre().alias("primary_genre"), style.sub_genre().alias("sub_genre"))


@query("q_genre_similarity", sql=f"""
SELECT {IDS}, gp.genre AS similarity FROM {PAIRS}
JOIN genre_pair gp ON gp.p1 = a.prim AND gp.u1 = a.sub AND gp.p2 = b.prim AND gp.u2 = b.sub""")
def q_genre_similarity(c):
    g = Styles().genre_similarity(A("primary"), A("sub"), B("primary"), B("sub"))
    return pairs(c).select("anchor_id", "track_id", g.alias("similarity"))


@query("q_title_mood", sql=f"SELECT track_id, CAST({o.mood('title', 'album')} AS DOUBLE) AS mood FROM tracks")
def q_title_mood(c):
    return c.tracks.select("track_id", style.title_mood("title", "album").cast("double").alias("mood"))


@query("q_bounded_similarity", sql=f"""
SELECT {IDS}, {r6s(o.bs('a', 'b', ['energy', 'aggression', 'dynamic_range', 'danceability'], [55, 1, 1, 1], 1.7), 'similarity')}
FROM {PAIRS}""")
def q_bounded_similarity(c):
    names, scales, sharp = acoustic.HANDOFF_ENERGY
    value = vectors.bounded_similarity([(A(n), B(n)) for n in names], scales, sharp)
    return pairs(c).select("anchor_id", "track_id", r6(value, "similarity"))


@query("q_components", sql=f"""
SELECT {IDS}, {r6s(o.rhythm(), 'rhythm')}, {r6s(o.timbre(), 'timbre')}, {r6s(o.harmony(), 'harmony')} FROM {PAIRS}""")
def q_components(c):
    parts = acoustic.components(A, B)
    return pairs(c).select("anchor_id", "track_id", *[r6(v, n) for n, v in parts.items()])


@query("q_vibe", sql=f"""
SELECT {IDS}, {r6s(o.vibe_of('v1', 'v2', 'v3', 'v4'), 'vibe')}, v3 AS title_match, {r6s('v1', 'acoustic')} FROM (
 SELECT rp.*, {o.vibe_parts()[0]} AS v1, {o.vibe_parts()[1]} AS v2, {o.title_match()} AS v3, {o.lyric()} AS v4
 FROM {PAIRS}) rp""")
def q_vibe(c):
    return pairs(c).select(
        "anchor_id", "track_id", r6(acoustic.vibe(A, B), "vibe"), acoustic.title_match(A, B).alias("title_match"),
        r6(acoustic._bounded(A, B, acoustic.VIBE), "acoustic"))


@query("q_lyric_similarity", sql=f"SELECT {IDS}, {r6s(o.lyric(), 'similarity')} FROM {PAIRS}")
def q_lyric_similarity(c):
    return pairs(c).select("anchor_id", "track_id", r6(acoustic.lyric_similarity(A, B), "similarity"))


@query("q_tempo_difference", sql=f"SELECT {IDS}, {r6s(o.tempo_gap(), 'gap')} FROM {PAIRS}")
def q_tempo_difference(c):
    return pairs(c).select("anchor_id", "track_id", r6(acoustic.tempo_difference(A, B), "gap"))


@query("q_key_compatibility", sql=f"SELECT {IDS}, {o.key_compat()} AS compatibility FROM {PAIRS}")
def q_key_compatibility(c):
    return pairs(c).select("anchor_id", "track_id", acoustic.key_compatibility(A, B).alias("compatibility"))


def transition_sql(prev="a", cand="b", anchor="a", lyr="lyr_sim", vibe="vibe_sim"):
    """Transition score over a row that already has the parts as columns (see HANDOFF_PARTS)."""
    base = (f"CASE WHEN {lyr} IS NULL THEN 0.31::DOUBLE*tempo+0.27::DOUBLE*harm+0.17::DOUBLE*tone+0.11::DOUBLE*energy_sim+0.14::DOUBLE*{vibe} "
            f"ELSE 0.29::DOUBLE*tempo+0.25::DOUBLE*harm+0.16::DOUBLE*tone+0.10::DOUBLE*energy_sim+0.12::DOUBLE*{vibe}+0.08::DOUBLE*{lyr} END")
    return o.clip(f"({base}) * (0.80::DOUBLE + 0.12::DOUBLE * here + 0.08::DOUBLE * genre) * (0.92::DOUBLE + 0.08::DOUBLE * origin)")


def handoff_parts(prev="a", cand="b"):
    """SELECT items for every part of a transition except the two style terms and genre."""
    ac, ch = o.vibe_parts(prev, cand)
    energy = o.bs(prev, cand, ["energy", "aggression", "dynamic_range", "danceability"], [55, 1, 1, 1], 1.7)
    chroma = f"greatest(0.0::DOUBLE, list_dot_product({prev}.chroma, {cand}.chroma) / greatest(sqrt({prev}.chroma_sq * {cand}.chroma_sq), 1e-10))"
    return f"""{o.tempo_gap(prev, cand)} AS gap, exp(-{o.tempo_gap(prev, cand)} / 12) AS tempo, {o.key_compat(prev, cand)} AS keyc,
  {o.clip(f'0.72::DOUBLE * {o.key_compat(prev, cand)} + 0.28::DOUBLE * {chroma}')} AS harm, {o.timbre(prev, cand)} AS tone,
  {energy} AS energy_sim, {o.lyric(prev, cand)} AS lyr_sim, {ac} AS v1, {ch} AS v2, {o.title_match(prev, cand)} AS v3,
  CAST(floor({prev}.bpm + 0.5) AS INT) || '→' || CAST(floor({cand}.bpm + 0.5) AS INT) || ' BPM' AS beats,
  {prev}.key || ' ' || {prev}.mode || '→' || {cand}.key || ' ' || {cand}.mode AS keys"""


HANDOFF_REASONS = """CASE WHEN len(rs) = 0 THEN 'balanced tempo and tone' ELSE array_to_string(rs[1:3], ' | ') END"""
HANDOFF_LIST = """list_filter([CASE WHEN gap <= 5 THEN beats END, CASE WHEN keyc >= 0.90 THEN keys END,
  CASE WHEN energy_sim >= 0.88 THEN 'steady energy handoff' END, CASE WHEN tone >= 0.86 THEN 'matched texture' END,
  CASE WHEN vibe_sim >= 0.86 THEN 'same vibe' END, CASE WHEN lyr_sim >= 0.82 THEN 'lyrical mood continuity' END],
  lambda x: x IS NOT NULL)"""


@query("q_transition_metrics", sql=f"""
SELECT anchor_id, track_id, {r6s('tempo')}, {r6s('harm', 'harmony')}, {r6s('tone', 'timbre')}, {r6s('energy_sim', 'energy')},
  {r6s(transition_sql(), 'score')}, {HANDOFF_REASONS} AS reasons, beats || ' · ' || keys AS note
FROM (SELECT *, {HANDOFF_LIST} AS rs FROM (SELECT *, {o.vibe_of('v1', 'v2', 'v3', 'lyr_sim')} AS vibe_sim FROM (
 SELECT rp.anchor_id, rp.track_id, sp.sim AS here, sp.sim AS origin, gp.genre AS genre, {handoff_parts()}
 FROM {PAIRS} JOIN style_pair sp ON sp.s1 = a.style AND sp.s2 = b.style
 JOIN genre_pair gp ON gp.p1 = a.prim AND gp.u1 = a.sub AND gp.p2 = b.prim AND gp.u2 = b.sub)))""")
def q_transition_metrics(c):
    m = acoustic.handoff(A, B, A, Styles())
    return pairs(c).select("anchor_id", "track_id", *[r6(m[n], n) for n in ("tempo", "harmony", "timbre", "energy", "score")],
                           F.array_join(m["reasons"], " | ").alias("reasons"), m["note"].alias("note"))


@query("q_match_reasons", sql=f"""
SELECT anchor_id, track_id, {o.reasons_sql()} AS reasons FROM ({o.scored_pairs(PAIRS)})""")
def q_match_reasons(c):
    genre = Styles().genre_similarity(A("primary"), A("sub"), B("primary"), B("sub"))
    lyric = acoustic.lyric_similarity(A, B)
    reasons = acoustic.match_reasons(A, B, acoustic.harmony(A, B), genre, acoustic.vibe(A, B, lyric=lyric), lyric)
    return pairs(c).select("anchor_id", "track_id", F.array_join(reasons, " | ").alias("reasons"))


@query("q_weight_report", sql="""
SELECT mode, n, total, ok FROM (SELECT mode, count(*) AS n, round(sum(score), 6) AS total,
  round(min(score), 6) >= 0 AND abs(round(sum(score), 6) - 1) <= 0.01 AS ok
FROM runs JOIN items ON runs.id = items.run_id GROUP BY mode, run_id)""")
def q_weight_report(c):
    """Each run's item scores read as a weight set: which sets are non-negative and sum to one."""
    from tonearm.operators.recommend import weight_report
    weights = c.runs.join(c.items, c.runs.id == c.items.run_id).select("run_id", "mode", F.col("score").alias("weight"))
    return weight_report(weights, ["run_id", "mode"]).select("mode", "n", r6("total"), "ok")


@query("q_artist_overlap", sql=r"""
SELECT rp.anchor_id, rp.track_id, CAST(len(list_intersect(a.names, b.names)) > 0 AS INT) AS overlap FROM run_pairs rp
JOIN names a ON a.track_id = rp.anchor_id JOIN names b ON b.track_id = rp.track_id""", views={"names": r"""
SELECT track_id, list_distinct(list_transform(list_filter(regexp_split_to_array(lower(artist), '\s*(?:,|&|\bfeat\.?\b|\bfeaturing\b|\bx\b)\s*'),
 lambda p: trim(p) <> ''), lambda p: trim(regexp_replace(p, '[^a-z0-9]+', ' ', 'g')))) AS names FROM tracks"""})
def q_artist_overlap(c):
    names = c.tracks.select("track_id", text.artist_set("artist").alias("names"))
    left = names.select(F.col("track_id").alias("anchor_id"), F.col("names").alias("a"))
    return (c.run_pairs.join(left, "anchor_id").join(names, "track_id")
            .select("anchor_id", "track_id", F.arrays_overlap("a", "names").cast("int").alias("overlap")))


@query("q_era_score", sql="""
SELECT rp.anchor_id, rp.track_id, round(0.65::DOUBLE * exp(-abs(coalesce(b.year, coalesce(a.year, 2005)) - coalesce(a.year, 2005)) / 12::DOUBLE)
 + 0.35::DOUBLE * exp(-abs(coalesce(b.duration_ms, coalesce(a.duration_ms, 210000)) - coalesce(a.duration_ms, 210000)) / 120000::DOUBLE), 6) AS era
FROM run_pairs rp JOIN tracks a ON a.track_id = rp.anchor_id JOIN tracks b ON b.track_id = rp.track_id""")
def q_era_score(c):
    from tonearm.operators.metadata import era_score
    t = c.tracks.select("track_id", "year", "duration_ms")
    a = t.toDF("anchor_id", "a_year", "a_duration_ms")
    b = t.toDF("track_id", "b_year", "b_duration_ms")
    return c.run_pairs.join(a, "anchor_id").join(b, "track_id").select("anchor_id", "track_id", r6(era_score(A, B), "era"))


@query("q_stable_hash", sql="""
SELECT track_id, round(list_reduce(list_prepend(7::BIGINT, list_transform(string_split(track_id, ''), lambda ch: ascii(ch)::BIGINT)),
  lambda h, x: (h * 31 + x) % 997) / 997::DOUBLE, 6) AS hosted,
 round(list_sum(list_transform(string_split(track_id, ''), lambda ch, i: i * ascii(ch))) % 997 / 997::DOUBLE, 6) AS classic FROM tracks""")
def q_stable_hash(c):
    return c.tracks.select("track_id", r6(text.stable_hash("track_id"), "hosted"),
                           r6(text.stable_hash("track_id", "classic"), "classic"))


@query("q_cosine_topk", sql="""
SELECT anchor_id, track_id, rank, round(sim, 6) AS similarity FROM (SELECT a.vec_id AS anchor_id, b.vec_id AS track_id,
  list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS rank
 FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 10""")
def q_cosine_topk(c):
    """Ten nearest rows of every embedding."""
    from tonearm.operators.neighbours import cosine_topk
    e = c.raw("embeddings").select(F.col("vec_id").alias("id"), vectors.doubles("embedding").alias("vector"))
    return cosine_topk(e, e, k=10, exclude_self=True).select(
        F.col("anchor_id").cast("bigint").alias("anchor_id"), F.col("candidate_id").cast("bigint").alias("track_id"),
        F.col("rank").cast("bigint").alias("rank"), r6("score", "similarity"))
