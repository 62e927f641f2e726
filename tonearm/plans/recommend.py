"""Recommender queries: every analysed track is an anchor, over the whole library."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonearm.functions import taxonomy as tx
from tonearm.operators import recommend as rec
from tonearm.plans import oracle as o
from tonearm.plans.registry import query, r6
from tonearm.sources.adapters import CHECK_THEMES

ALL = "lib a JOIN lib b ON a.track_id <> b.track_id AND a.ident <> b.ident"


def anchors(c):
    return c.fingerprints.select(F.col("track_id").alias("request_id"), F.col("track_id").alias("anchor_id"))


def base_sql(mode: str) -> str:
    w = tx.MODE_WEIGHTS[mode]
    acoustic = f"({w[0]}::DOUBLE * rhythm + {w[1]}::DOUBLE * timbre + {w[2]}::DOUBLE * harmony)"
    if mode == "rhythm":
        return "(0.72::DOUBLE * rhythm + 0.12::DOUBLE * vibe + 0.10::DOUBLE * harmony + 0.06::DOUBLE * timbre)"
    if mode == "timbre":
        return "(0.72::DOUBLE * timbre + 0.12::DOUBLE * vibe + 0.10::DOUBLE * harmony + 0.06::DOUBLE * rhythm)"
    if mode == "discover":
        return f"(0.42::DOUBLE * {acoustic} + 0.30::DOUBLE * vibe + 0.18::DOUBLE * genre + 0.10::DOUBLE * id_hash)"
    lw = tx.LYRIC_WEIGHTS[mode]
    return f"(CASE WHEN lyric_sim IS NULL THEN {acoustic} ELSE {1 - lw}::DOUBLE * {acoustic} + {lw}::DOUBLE * lyric_sim END)"


ID_HASH = ("list_reduce(list_prepend(7::BIGINT, list_transform(string_split(b.track_id, ''), lambda ch: ascii(ch)::BIGINT)), "
           "lambda h, x: (h * 31 + x) % 997) / 997::DOUBLE")


def total_sql(mode: str, scope: str, vibe_lock: bool) -> str:
    g = "(0.86::DOUBLE + 0.14::DOUBLE * genre)" if scope == "open" else "(0.56::DOUBLE + 0.44::DOUBLE * genre)"
    v = "(0.42::DOUBLE + 0.58::DOUBLE * vibe)" if vibe_lock else "1"
    artist = "* CASE WHEN a_artist_key = b_artist_key THEN 0.58::DOUBLE ELSE 1 END" if mode == "discover" else ""
    return f"{base_sql(mode)} * {g} * {v} * CASE WHEN title_sim = 0 THEN 0.52::DOUBLE ELSE 1 END {artist}"


def scope_sql(scope: str) -> str:
    return {"strict": "a_prim = b_prim", "nearby": "genre >= 0.10", "open": "true"}[scope]


def diverse_sql(scored: str, key: str, k: int) -> str:
    """Recording first, two per artist, then backfill; ``scored`` has b_ident, b_artist_key, hybrid_score."""
    return f"""
SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY backfill, hybrid_score DESC, track_id) AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY {key}, b_artist_key ORDER BY hybrid_score DESC, track_id) > 2 AS backfill FROM (
  SELECT *, row_number() OVER (PARTITION BY {key}, b_ident ORDER BY hybrid_score DESC, track_id) AS edition FROM ({scored}))
 WHERE edition = 1) QUALIFY rank <= {k}"""


OUT = """SELECT anchor_id, track_id, CAST(rank AS BIGINT) AS rank, hybrid_score, round(rhythm, 6) AS rhythm,
  round(timbre, 6) AS timbre, round(harmony, 6) AS harmony, round(vibe, 6) AS vibe, round(genre, 6) AS genre,
  round(lyric_sim, 6) AS lyric, """ + o.reasons_sql() + " AS reasons"


def mode_sql(mode: str, k: int = 12, scope: str = "nearby", vibe_lock: bool = True, lib_filter: str = "", source: str = ALL, live: bool = False) -> str:
    extra = f", {ID_HASH} AS id_hash" if mode == "discover" else ""
    scored = f"""SELECT *, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, {total_sql(mode, scope, vibe_lock)})), 4) + 0.0 AS hybrid_score
FROM ({o.scored_pairs(source, extra, live=live)}) WHERE {scope_sql(scope)} {lib_filter}"""
    return f"{OUT} FROM ({diverse_sql(scored, 'anchor_id', k)})"


def show(c, top, outside=None):
    """Compare form of finished lists."""
    from tonearm.functions import acoustic
    from tonearm.functions.style import Styles
    from tonearm.operators.library import pair_up
    a, b = acoustic.side("a"), acoustic.side("b")
    lyric = acoustic.lyric_similarity(a, b)
    genre = Styles().genre_similarity(a("primary"), a("sub"), b("primary"), b("sub"))
    vibe = acoustic.vibe(a, b, lyric=lyric)
    reasons = acoustic.match_reasons(a, b, F.col("harmony"), genre, vibe, lyric)
    known = c.prepared if outside is None else c.prepared.unionByName(outside)
    return pair_up(top.drop("identity", "artist_key"), known).select(
        "anchor_id", "track_id", F.col("rank").cast("bigint").alias("rank"), "hybrid_score", r6("rhythm"),
        r6("timbre"), r6("harmony"), r6(vibe, "vibe"), r6(genre, "genre"), r6(lyric, "lyric"),
        F.array_join(reasons, " | ").alias("reasons"))


def _mode(mode):
    @query(f"q_recommend_{mode}", sql=mode_sql(mode))
    def run(c):
        return show(c, rec.top_lists(anchors(c), c.prepared, mode, k=12, themes=CHECK_THEMES, blocked=c.blocks))

    run.__doc__ = f"Top 12 of every analysed track, mode {mode}."
    return run


for _name in ("similar", "rhythm", "timbre", "discover"):
    _mode(_name)


# --- scopes, taste, aversion, diversity --------------------------------------------------------
def _scope_sql(scope, lock):
    return f"SELECT '{scope}' AS scope, anchor_id, track_id, rank, hybrid_score FROM ({mode_sql('similar', 5, scope, lock)})"


@query("q_genre_scopes", sql=" UNION ALL ".join([_scope_sql("strict", True), _scope_sql("open", False)]))
def q_genre_scopes(c):
    """Strict with the vibe lock, open without it (nearby is every other query)."""
    one = lambda scope, lock: rec.top_lists(anchors(c), c.prepared, "similar", k=5, genre_scope=scope, vibe_lock=lock,
                                            themes=CHECK_THEMES, blocked=c.blocks).select(
        F.lit(scope).alias("scope"), "anchor_id", "track_id", F.col("rank").cast("bigint").alias("rank"), "hybrid_score")
    return one("strict", True).unionByName(one("open", False))


OUTSIDE = {"outside": "SELECT * REPLACE ('live-' || track_id AS track_id, bpm * 1.05::DOUBLE AS bpm, brightness * 0.9::DOUBLE AS brightness) FROM lib"}


@query("q_recommend_outside", views=OUTSIDE, sql=mode_sql("similar", source="outside a JOIN lib b ON a.ident <> b.ident", live=True))
def q_recommend_outside(c):
    """Anchors that come with the request: live analyses of every track, a little faster and darker than the stored ones."""
    live = c.prepared.withColumns({"track_id": F.concat(F.lit("live-"), "track_id"), "bpm": F.col("bpm") * 1.05,
                                   "brightness": F.col("brightness") * 0.9, "live": F.lit(True)})
    requests = live.select(F.col("track_id").alias("request_id"), F.col("track_id").alias("anchor_id"))
    top = rec.top_lists(requests, c.prepared, "similar", k=12, themes=CHECK_THEMES, blocked=c.blocks, outside=live)
    return show(c, top, live)


W3 = tx.MODE_WEIGHTS["similar"]
USERS = {
    "asks": "SELECT DISTINCT user_id, anchor_track_id AS anchor_id FROM runs WHERE mode = '{mode}' AND anchor_track_id IN (SELECT track_id FROM lib)",
    "liked": "SELECT user_id, track_id FROM favorites UNION SELECT user_id, track_id FROM interactions WHERE event_type IN ('liked', 'preview_completed', 'youtube_opened')",
    "averse": "SELECT DISTINCT user_id, track_id FROM interactions WHERE event_type IN ('disliked', 'dismissed')",
    "met": "SELECT r.user_id, i.track_id FROM runs r JOIN items i ON i.run_id = r.id UNION SELECT user_id, track_id FROM interactions",
    "parts": f"""SELECT *, {W3[0]}::DOUBLE * r + {W3[1]}::DOUBLE * t + {W3[2]}::DOUBLE * h AS w FROM (SELECT a.track_id AS src, b.track_id, {o.rhythm()} AS r, {o.timbre()} AS t, {o.harmony()} AS h
      FROM lib a CROSS JOIN lib b WHERE a.track_id IN (SELECT track_id FROM liked UNION SELECT track_id FROM averse))""",
    "best": "SELECT l.user_id, p.track_id, max_by({'r': r, 't': t, 'h': h}, w) AS p FROM liked l JOIN parts p ON p.src = l.track_id GROUP BY l.user_id, p.track_id",
    "worst": "SELECT l.user_id, p.track_id, max(w) AS w FROM averse l JOIN parts p ON p.src = l.track_id GROUP BY l.user_id, p.track_id",
    "pairs0": o.scored_pairs(ALL),
}


def _user_sql(mode: str, k: int, blend: bool) -> tuple[dict, str]:
    views = {**USERS, "asks": USERS["asks"].replace("{mode}", mode)}
    part = lambda full, short: f"0.65::DOUBLE * s.{full} + 0.35::DOUBLE * coalesce(t.p.{short}, s.{full})" if blend else f"s.{full}"
    raw = f"""SELECT q.user_id, q.anchor_id, s.track_id, s.b_ident, s.b_artist_key, s.genre, s.vibe, s.title_sim, s.lyric_sim,
      CASE WHEN {str(blend).lower()} AND t.user_id IS NOT NULL THEN {part('rhythm', 'r')} ELSE s.rhythm END AS rhythm,
      CASE WHEN {str(blend).lower()} AND t.user_id IS NOT NULL THEN {part('timbre', 't')} ELSE s.timbre END AS timbre,
      CASE WHEN {str(blend).lower()} AND t.user_id IS NOT NULL THEN {part('harmony', 'h')} ELSE s.harmony END AS harmony,
      CASE WHEN m.track_id IS NOT NULL THEN 0.76::DOUBLE ELSE 1 END * CASE WHEN n.w > 0.72 THEN 1 - 0.45::DOUBLE * least(1.0::DOUBLE, (n.w - 0.72::DOUBLE) / 0.28::DOUBLE) ELSE 1 END AS penalty
     FROM asks q JOIN pairs0 s ON s.anchor_id = q.anchor_id LEFT JOIN best t ON t.user_id = q.user_id AND t.track_id = s.track_id
     LEFT JOIN met m ON m.user_id = q.user_id AND m.track_id = s.track_id LEFT JOIN worst n ON n.user_id = q.user_id AND n.track_id = s.track_id WHERE genre >= 0.10"""
    scored = f"SELECT *, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, {total_sql(mode, 'nearby', True)} * penalty)), 4) + 0.0 AS hybrid_score FROM ({raw})"
    sql = f"""SELECT user_id, anchor_id, track_id, CAST(rank AS BIGINT) AS rank, hybrid_score, round(rhythm, 6) AS rhythm, round(timbre, 6) AS timbre,
      round(harmony, 6) AS harmony FROM ({diverse_sql(scored, 'user_id, anchor_id', k)})"""
    return views, sql


def personal(c, mode: str, k: int):
    from tonearm.operators import listeners as ls
    requests = c.runs.filter(F.col("mode") == mode).select("user_id", F.col("anchor_track_id").alias("anchor_id")).distinct()
    requests = requests.withColumn("request_id", F.concat_ws(":", F.col("user_id").cast("string"), "anchor_id"))
    rows = ls.taste_rows(c.favorites, c.interactions)
    top = rec.top_lists(requests, c.prepared, mode, k=k, taste=rows.filter("liked"), averse=rows.filter("disliked"),
                        seen=ls.seen(c.runs, c.items, c.interactions), themes=CHECK_THEMES, blocked=c.blocks)
    return top.select("user_id", "anchor_id", "track_id", F.col("rank").cast("bigint").alias("rank"), "hybrid_score",
                      r6("rhythm"), r6("timbre"), r6("harmony"))


_views, _sql = _user_sql("personalized", 12, True)


@query("q_recommend_personalized", views=_views, sql=_sql)
def q_recommend_personalized(c):
    """Every personalised run: taste blended in, seen tracks and disliked sound held back."""
    return personal(c, "personalized", 12)


_views, _sql = _user_sql("similar", 6, False)


@query("q_negative_affinity", views=_views, sql=_sql)
def q_negative_affinity(c):
    """Mode similar for signed-in listeners: seen penalty and disliked-affinity penalty."""
    return personal(c, "similar", 6)


@query("q_diversify", sql=f"""
SELECT run_id, track_id, CAST(rank AS BIGINT) AS rank, backfill, hybrid_score FROM ({diverse_sql(
    f"SELECT i.run_id, i.track_id, i.score AS hybrid_score, {o.identity('t.title', 't.artist')} AS b_ident, {o.clean('t.artist')} AS b_artist_key FROM items i JOIN tracks t ON t.track_id = i.track_id", 'run_id', 4)})""")
def q_diversify(c):
    from tonearm.functions import text
    t = c.tracks.select("track_id", text.recording_identity("title", "artist").alias("identity"), text.clean("artist").alias("artist_key"))
    scored = c.items.join(t, "track_id").withColumn("hybrid_score", F.col("score"))
    return rec.diversify(scored, "run_id", 4).select("run_id", "track_id", F.col("rank").cast("bigint").alias("rank"), "backfill", "hybrid_score")


# --- transition runs and bridges ---------------------------------------------------------------
from tonearm.operators import chain as ch  # noqa: E402
from tonearm.plans.pairs import HANDOFF_LIST, HANDOFF_REASONS, handoff_parts, transition_sql  # noqa: E402

STEP = {"step_pairs": f"""
SELECT *, {o.vibe_of('v1', 'v2', 'v3', 'lyr_sim')} AS vibe_sim FROM (
 SELECT a.track_id AS anchor_id, b.track_id, b.playable, a.artist_key = b.artist_key AS same_artist, a.playable AS a_playable, b.energy AS b_energy, b.brightness AS b_brightness,
  sp.sim AS here, sp.sim AS origin, gp.genre AS genre, {handoff_parts()}
 FROM {ALL} JOIN style_pair sp ON sp.s1 = a.style AND sp.s2 = b.style
 JOIN genre_pair gp ON gp.p1 = a.prim AND gp.u1 = a.sub AND gp.p2 = b.prim AND gp.u2 = b.sub)""",
 "step_rough": """SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY rough DESC, track_id) AS n FROM (
   SELECT *, 0.47::DOUBLE * tempo + 0.30::DOUBLE * keyc + 0.13::DOUBLE * here + 0.10::DOUBLE * genre AS rough FROM step_pairs WHERE playable AND genre >= 0.10) QUALIFY n <= 520"""}


@query("q_transition_step1", views=STEP, sql=f"""
SELECT anchor_id, track_id, round(rough, 6) AS rough, round(score, 6) AS score FROM (SELECT *, {transition_sql()} * (0.58::DOUBLE + 0.42::DOUBLE * vibe_sim) * (0.60::DOUBLE + 0.40::DOUBLE * genre)
  * CASE WHEN same_artist THEN 0.62::DOUBLE ELSE 1 END AS score FROM step_rough) QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, n) = 1""")
def q_transition_step1(c):
    """First step of the run of every analysed track."""
    out = ch.transition_chain(anchors(c), c.prepared, k=1, themes=CHECK_THEMES, blocked=c.blocks)
    return out.select("anchor_id", "track_id", r6("rough"), r6("score"))


def _lead(pairs: str, classic: bool = False) -> str:
    """Pairs with ``lead``: the transition score before the style of the run's anchor counts."""
    vibe = o.vibe_classic("v1", "v2", "v3") if classic else o.vibe_of("v1", "v2", "v3", "lyr_sim")
    base = ("CASE WHEN lyr_sim IS NULL THEN 0.31::DOUBLE*tempo+0.27::DOUBLE*harm+0.17::DOUBLE*tone+0.11::DOUBLE*energy_sim+0.14::DOUBLE*vibe_sim "
            "ELSE 0.29::DOUBLE*tempo+0.25::DOUBLE*harm+0.16::DOUBLE*tone+0.10::DOUBLE*energy_sim+0.12::DOUBLE*vibe_sim+0.08::DOUBLE*lyr_sim END")
    lead = ("(0.36::DOUBLE*tempo+0.30::DOUBLE*harm+0.20::DOUBLE*tone+0.14::DOUBLE*energy_sim) * (0.78::DOUBLE + 0.22::DOUBLE * here)" if classic else
            f"({base}) * (0.80::DOUBLE + 0.12::DOUBLE * here + 0.08::DOUBLE * genre)")
    return f"""SELECT *, {lead} AS lead FROM (
  SELECT *, {vibe} AS vibe_sim FROM (
   SELECT a.track_id AS prev, b.track_id, b.playable, b.ident, b.artist_key, sp.sim AS here, gp.genre AS genre, {handoff_parts()}
   FROM {pairs} JOIN style_pair sp ON sp.s1 = a.style AND sp.s2 = b.style
   JOIN genre_pair gp ON gp.p1 = a.prim AND gp.u1 = a.sub AND gp.p2 = b.prim AND gp.u2 = b.sub))"""


def chain_views(steps: int, learned: tuple[str, str] = ("", ""), classic: bool = False) -> dict[str, str]:
    """The runs step by step: run_s0 is the start, run_s1.. hold what was picked; ``learned`` are a factor and its joins."""
    rough = ("0.50::DOUBLE * h.tempo + 0.32::DOUBLE * h.keyc + 0.18::DOUBLE * h.here" if classic else
             "0.47::DOUBLE * h.tempo + 0.30::DOUBLE * h.keyc + 0.13::DOUBLE * h.here + 0.10::DOUBLE * t.genre")
    origin = "0.90::DOUBLE + 0.10::DOUBLE" if classic else "0.92::DOUBLE + 0.08::DOUBLE"
    views = {"hops": _lead(ALL, classic), "run_s0": "SELECT track_id AS anchor_id, track_id AS prev, [track_id] AS ids, [ident] AS idents, [artist_key] AS arts FROM lib"}
    for i in range(1, steps + 1):
        views[f"run_c{i}"] = f"""SELECT s.anchor_id, s.prev, s.ids, s.idents, s.arts, h.track_id, h.ident, h.artist_key, {rough} AS rough,
  {o.clip(f'h.lead * ({origin} * t.here)')} * (0.58::DOUBLE + 0.42::DOUBLE * t.vibe_sim) * (0.60::DOUBLE + 0.40::DOUBLE * t.genre)
   * CASE WHEN list_contains(s.arts, h.artist_key) THEN 0.62::DOUBLE ELSE 1 END {learned[0]} AS score
 FROM run_s{i - 1} s JOIN hops h ON h.prev = s.prev JOIN hops t ON t.prev = s.anchor_id AND t.track_id = h.track_id {learned[1]}
 WHERE h.playable AND t.genre >= 0.10 AND NOT list_contains(s.ids, h.track_id) AND NOT list_contains(s.idents, h.ident)
 QUALIFY row_number() OVER (PARTITION BY s.anchor_id ORDER BY rough DESC, h.track_id) <= 520"""
        views[f"run_s{i}"] = f"""SELECT anchor_id, track_id AS prev, list_append(ids, track_id) AS ids, list_append(idents, ident) AS idents, list_append(arts, artist_key) AS arts,
  prev AS prev_id, score, {i} AS step FROM run_c{i} QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, rough DESC, track_id) = 1"""
    views["runs_of"] = " UNION ALL ".join(f"SELECT anchor_id, step, prev_id, prev AS track_id, score FROM run_s{i}" for i in range(1, steps + 1))
    return views


@query("q_transition_chain", views=chain_views(5), sql=f"""
SELECT anchor_id, step, prev_id, track_id, round(score, 6) AS score, {HANDOFF_REASONS} AS reasons, beats || ' · ' || keys AS transition_note
FROM (SELECT r.*, h.beats, h.keys, {HANDOFF_LIST} AS rs FROM runs_of r JOIN hops h ON h.prev = r.prev_id AND h.track_id = r.track_id)""")
def q_transition_chain(c):
    """Five-step run of every analysed track with notes."""
    out = ch.transition_chain(anchors(c), c.prepared, k=5, themes=CHECK_THEMES, blocked=c.blocks)
    told = ch.describe_steps(out, c.prepared)
    return told.select("anchor_id", "step", "prev_id", "track_id", r6("score"), F.array_join("match_reasons", " | ").alias("reasons"), "transition_note")


def bridge_requests(c):
    """Anchor and first suggestion of every recorded run, once per pair."""
    first = c.items.filter("rank = 1").select(F.col("run_id").alias("id"), F.col("track_id").alias("destination_id"))
    pairs = c.runs.select("id", F.col("anchor_track_id").alias("anchor_id")).join(first, "id").select("anchor_id", "destination_id").distinct()
    return pairs.withColumn("request_id", F.concat_ws(">", "anchor_id", "destination_id"))


BRIDGE = {**STEP, "br_req": "SELECT DISTINCT r.anchor_track_id AS anchor_id, i.track_id AS destination_id FROM runs r JOIN items i ON i.run_id = r.id AND i.rank = 1 WHERE r.anchor_track_id <> i.track_id",
  "br_pairs": f"""SELECT *, {o.vibe_of('v1', 'v2', 'v3', 'lyr_sim')} AS vibe_sim FROM (SELECT a.track_id AS anchor_id, b.track_id, sp.sim AS here, CASE WHEN b.style = '' THEN 0.25 ELSE 1.0 END::DOUBLE AS dest_self, sp.sim AS origin, gp.genre AS genre, {handoff_parts()}
    FROM lib a JOIN lib b ON a.track_id <> b.track_id JOIN style_pair sp ON sp.s1 = a.style AND sp.s2 = b.style JOIN genre_pair gp ON gp.p1 = a.prim AND gp.u1 = a.sub AND gp.p2 = b.prim AND gp.u2 = b.sub)""",
  "br_lead": f"SELECT anchor_id, track_id, {transition_sql()} AS score FROM br_pairs",
  "br_home": f"SELECT anchor_id AS track_id, track_id AS destination_id, {transition_sql().replace('origin', 'dest_self')} AS score FROM br_pairs"}


@query("q_bridge_step1", views=BRIDGE, sql="""
SELECT anchor_id, destination_id, track_id, round(total, 6) AS score FROM (
 SELECT q.anchor_id, q.destination_id, c.track_id, (0.84::DOUBLE * (l.score * (1 - 0.335::DOUBLE) + h.score * 0.335::DOUBLE)
   + 0.10::DOUBLE * exp(-abs(c.energy - (a.energy * 0.75::DOUBLE + d.energy * 0.25::DOUBLE)) / 18::DOUBLE)
   + 0.06::DOUBLE * exp(-abs(c.brightness - (a.brightness * 0.75::DOUBLE + d.brightness * 0.25::DOUBLE)) / 0.24::DOUBLE))
   * CASE WHEN c.artist_key IN (a.artist_key, d.artist_key) THEN 0.68::DOUBLE ELSE 1 END AS total
 FROM br_req q JOIN lib a ON a.track_id = q.anchor_id AND a.playable JOIN lib d ON d.track_id = q.destination_id AND d.playable
 JOIN lib c ON c.playable AND c.ident NOT IN (a.ident, d.ident) AND c.track_id NOT IN (a.track_id, d.track_id)
 JOIN br_lead l ON l.anchor_id = a.track_id AND l.track_id = c.track_id JOIN br_home h ON h.track_id = c.track_id AND h.destination_id = d.track_id)
QUALIFY row_number() OVER (PARTITION BY anchor_id, destination_id ORDER BY total DESC, track_id) = 1""")
def q_bridge_step1(c):
    """First intermediate of every bridge."""
    out = ch.sound_bridge(bridge_requests(c), c.prepared, themes=CHECK_THEMES, blocked=c.blocks, steps=1).filter("step = 1 AND score IS NOT NULL")
    return out.select("anchor_id", "destination_id", "track_id", r6("score"))


def bridge_views(steps: int = 3) -> dict[str, str]:
    """The bridges step by step; ``home`` is the score from a track to a destination."""
    views = {"br_req": BRIDGE["br_req"], "ways": _lead("lib a JOIN lib b ON a.track_id <> b.track_id"),
             "home": f"""SELECT w.prev AS track_id, w.track_id AS destination_id, {o.clip("w.lead * (0.92::DOUBLE + 0.08::DOUBLE * CASE WHEN d.style = '' THEN 0.25 ELSE 1.0 END::DOUBLE)")} AS score
               FROM ways w JOIN lib d ON d.track_id = w.track_id""",
             "br_s0": """SELECT q.anchor_id, q.destination_id, a.track_id AS prev, [a.track_id, d.track_id] AS ids, [a.ident, d.ident] AS idents, [a.artist_key, d.artist_key] AS arts,
               a.energy AS e0, d.energy AS e1, a.brightness AS l0, d.brightness AS l1
               FROM br_req q JOIN lib a ON a.track_id = q.anchor_id AND a.playable JOIN lib d ON d.track_id = q.destination_id AND d.playable"""}
    for i in range(1, steps + 1):
        p, w = i / 4, 0.22 + i / 4 * 0.46
        views[f"br_s{i}"] = f"""SELECT anchor_id, destination_id, track_id AS prev, list_append(ids, track_id) AS ids, list_append(idents, ident) AS idents, list_append(arts, artist_key) AS arts,
   e0, e1, l0, l1, prev AS prev_id, total AS score, {i} AS step FROM (
  SELECT s.*, c.track_id, c.ident, c.artist_key, (0.84::DOUBLE * ({o.clip('l.lead * (0.92::DOUBLE + 0.08::DOUBLE * t.sim)')} * {1 - w}::DOUBLE + h.score * {w}::DOUBLE)
    + 0.10::DOUBLE * exp(-abs(c.energy - (s.e0 * {1 - p}::DOUBLE + s.e1 * {p}::DOUBLE)) / 18::DOUBLE)
    + 0.06::DOUBLE * exp(-abs(c.brightness - (s.l0 * {1 - p}::DOUBLE + s.l1 * {p}::DOUBLE)) / 0.24::DOUBLE))
    * CASE WHEN list_contains(s.arts, c.artist_key) THEN 0.68::DOUBLE ELSE 1 END AS total
  FROM br_s{i - 1} s JOIN lib a ON a.track_id = s.anchor_id JOIN lib c ON c.playable AND NOT list_contains(s.idents, c.ident) AND NOT list_contains(s.ids, c.track_id)
  JOIN ways l ON l.prev = s.prev AND l.track_id = c.track_id JOIN home h ON h.track_id = c.track_id AND h.destination_id = s.destination_id
  JOIN style_pair t ON t.s1 = a.style AND t.s2 = c.style)
 QUALIFY row_number() OVER (PARTITION BY anchor_id, destination_id ORDER BY total DESC, track_id) = 1"""
    picks = " UNION ALL ".join(f"SELECT anchor_id, destination_id, step, prev_id, prev AS track_id, score FROM br_s{i}" for i in range(1, steps + 1))
    views["bridges"] = f"""{picks} UNION ALL SELECT b.anchor_id, b.destination_id, {steps + 1}, b.prev, b.destination_id, {o.clip('w.lead * (0.92::DOUBLE + 0.08::DOUBLE * t.sim)')}
     FROM br_s{steps} b JOIN ways w ON w.prev = b.prev AND w.track_id = b.destination_id JOIN lib a ON a.track_id = b.anchor_id JOIN lib d ON d.track_id = b.destination_id
     JOIN style_pair t ON t.s1 = a.style AND t.s2 = d.style"""
    return views


@query("q_sound_bridge", views=bridge_views(), sql="""
SELECT r.anchor_id, r.destination_id, r.step, r.prev_id, r.track_id, round(r.score, 6) AS score, w.beats || ' · ' || w.keys AS transition_note
FROM bridges r JOIN ways w ON w.prev = r.prev_id AND w.track_id = r.track_id""")
def q_sound_bridge(c):
    """Full bridges: three intermediates, then the destination."""
    out = ch.sound_bridge(bridge_requests(c), c.prepared, themes=CHECK_THEMES, blocked=c.blocks)
    told = ch.describe_steps(out, c.prepared)
    return told.select("anchor_id", "destination_id", "step", "prev_id", "track_id", r6("score"), "transition_note")


@query("q_select_baseline", views={**chain_views(5), **{f"top_{m}": mode_sql(m) for m in ("similar", "rhythm", "timbre")}}, sql="""
SELECT track_id FROM lib WHERE playable AND (track_id IN (SELECT track_id FROM top_similar) OR track_id IN (SELECT track_id FROM top_rhythm)
  OR track_id IN (SELECT track_id FROM top_timbre) OR track_id IN (SELECT track_id FROM runs_of) OR track_id IN (SELECT anchor_id FROM run_s0))""")
def q_select_baseline(c):
    """Playable tracks that any mode recommends for any anchor (what a first learned index should cover)."""
    lists = [rec.top_lists(anchors(c), c.prepared, m, k=12, themes=CHECK_THEMES, blocked=c.blocks).select("track_id")
             for m in ("similar", "rhythm", "timbre")]
    lists.append(ch.transition_chain(anchors(c), c.prepared, k=5, themes=CHECK_THEMES, blocked=c.blocks).select("track_id"))
    ids = lists[0]
    for more in lists[1:]:
        ids = ids.union(more)
    return ids.union(anchors(c).select("anchor_id")).distinct().join(c.prepared.filter("playable").select("track_id"), "track_id", "left_semi")
