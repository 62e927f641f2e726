"""Listener-table queries."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tonearm.functions import taxonomy as tx
from tonearm.operators import listeners as ls
from tonearm.plans.registry import STAMP, query, r6, stamp

AT = STAMP.format("created_at")


@query("q_favorites", sql=f"""
SELECT user_id, track_id, {AT} AS created_at FROM (SELECT user_id, track_id, max(created_at) AS created_at FROM (
  SELECT * FROM favorites UNION ALL SELECT user_id, track_id, created_at FROM interactions WHERE event_type = 'youtube_opened') GROUP BY 1, 2)
WHERE (user_id, track_id) NOT IN (SELECT (user_id, track_id) FROM interactions WHERE event_type = 'disliked')""")
def q_favorites(c):
    added = c.interactions.filter("event_type = 'youtube_opened'").select("user_id", "track_id", "created_at")
    removed = c.interactions.filter("event_type = 'disliked'")
    return ls.update_favorites(c.favorites, added, removed).select("user_id", "track_id", stamp("created_at"))


WEIGHTS = {mode: dict(zip(("rhythm", "timbre", "harmony"), values)) for mode, values in tx.MODE_WEIGHTS.items()}
WEIGHTS_SQL = " ".join(f"WHEN '{m}' THEN '{json.dumps(w, sort_keys=True, separators=(',', ':'))}'" for m, w in WEIGHTS.items())


def recorded(c):
    """The recommendation rows of every request, recorded anew."""
    recs = c.runs.join(c.items, c.runs.id == c.items.run_id).select(
        F.col("id").alias("request_id"), "user_id", F.col("anchor_track_id").alias("anchor_id"), "mode", "created_at", "track_id", "rank",
        F.col("score").alias("hybrid_score"))
    return ls.record_runs(recs, c.tracks, WEIGHTS)


@query("q_record_runs", sql=f"""
SELECT r.id AS run_id, r.user_id, r.anchor_track_id AS anchor_id, a.title AS anchor_title, a.artist AS anchor_artist, r.mode,
  {STAMP.format('r.created_at')} AS created_at, count(*) AS n, max(i.score) AS best, count(t.title) AS titled, min(t.provider_subgenre) AS subgenre,
  CASE r.mode {WEIGHTS_SQL} END AS weights
FROM runs r JOIN items i ON r.id = i.run_id LEFT JOIN tracks a ON a.track_id = r.anchor_track_id LEFT JOIN tracks t ON t.track_id = i.track_id GROUP BY ALL""")
def q_record_runs(c):
    runs, items = recorded(c)
    counted = items.groupBy("run_id").agg(F.count("*").alias("n"), F.max("score").alias("best"), F.count("title").alias("titled"),
                                          F.min("subgenre").alias("subgenre"))
    return runs.join(counted, runs.id == counted.run_id).select(
        "run_id", "user_id", F.col("anchor_track_id").alias("anchor_id"), "anchor_title", "anchor_artist", "mode", stamp("created_at"), "n", "best",
        "titled", "subgenre", "weights")


LATEST = {"latest": "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS position FROM runs QUALIFY position <= 30"}


RECORDED = {"latest": """SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS position FROM runs
  WHERE id IN (SELECT run_id FROM items) QUALIFY position <= 30"""}


@query("q_history", views=LATEST, sql=f"""
SELECT l.user_id, l.id, l.mode, {STAMP.format('l.created_at')} AS created_at, CAST(l.position AS BIGINT) AS position,
  coalesce(string_agg(i.rank || ':' || i.track_id, ',' ORDER BY i.rank), '') AS suggestions
FROM latest l LEFT JOIN items i ON i.run_id = l.id AND i.rank <= 12 GROUP BY ALL""")
def q_history(c):
    return _history(c.runs, c.items)


@query("q_record_history", views=RECORDED, sql=f"""
SELECT l.user_id, l.id, l.mode, {STAMP.format('l.created_at')} AS created_at, CAST(l.position AS BIGINT) AS position,
  coalesce(string_agg(i.rank || ':' || i.track_id, ',' ORDER BY i.rank), '') AS suggestions
FROM latest l LEFT JOIN items i ON i.run_id = l.id AND i.rank <= 12 GROUP BY ALL""")
def q_record_history(c):
    """History over runs as record_runs writes them."""
    return _history(*recorded(c))


def _history(runs, items):
    out = ls.history(runs, items)
    text = F.array_join(F.transform("suggestions", lambda s: F.concat_ws(":", s["rank"].cast("string"), s["track_id"])), ",")
    return out.select("user_id", "id", "mode", stamp("created_at"), F.col("position").cast("bigint").alias("position"),
                      F.coalesce(text, F.lit("")).alias("suggestions"))


GONE = "(SELECT DISTINCT user_id FROM interactions WHERE event_type = 'disliked' AND value = -3)"


@query("q_clear_history", sql=f"""
SELECT 'runs' AS kind, user_id, count(*) AS n FROM runs WHERE user_id NOT IN {GONE} GROUP BY user_id
UNION ALL SELECT 'items', r.user_id, count(*) FROM runs r JOIN items i ON i.run_id = r.id WHERE r.user_id NOT IN {GONE} GROUP BY r.user_id
UNION ALL SELECT 'interactions', user_id, count(*) FROM interactions WHERE user_id NOT IN {GONE} GROUP BY user_id""")
def q_clear_history(c):
    users = c.interactions.filter("event_type = 'disliked' AND value = -3")
    runs, items, acts = ls.clear_history(users, c.runs, c.items, c.interactions)
    count = lambda df, kind: df.groupBy("user_id").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "user_id", "n")
    owned = items.join(c.runs.select(F.col("id").alias("run_id"), "user_id"), "run_id")
    return count(runs, "runs").unionByName(count(owned, "items")).unionByName(count(acts, "interactions"))


@query("q_valid_events", sql="""
SELECT event_id, user_id, track_id, event_type FROM (SELECT event_id, user_id, track_id,
  CASE WHEN value = 2 THEN 'shared' ELSE event_type END AS event_type FROM interactions) WHERE event_type <> 'shared'""")
def q_valid_events(c):
    events = c.interactions.withColumn("event_type", F.when(F.col("value") == 2, "shared").otherwise(F.col("event_type")))
    return ls.valid_interactions(events).select("event_id", "user_id", "track_id", "event_type")


@query("q_seen", sql="""
SELECT r.user_id, i.track_id FROM runs r JOIN items i ON i.run_id = r.id UNION SELECT user_id, track_id FROM interactions""")
def q_seen(c):
    return ls.seen(c.runs, c.items, c.interactions)


def taste_text(df):
    join = lambda n: F.coalesce(F.array_join(n, ","), F.lit("")).alias(n)
    return df.select("user_id", *[join(n) for n in ("track_ids", "disliked_track_ids", "subgenres", "artists")])


TASTE_SQL = """
SELECT user_id, coalesce(string_agg(DISTINCT track_id, ',' ORDER BY track_id) FILTER (liked), '') AS track_ids,
  coalesce(string_agg(DISTINCT track_id, ',' ORDER BY track_id) FILTER (disliked), '') AS disliked_track_ids,
  coalesce(any_value(s), '') AS subgenres, coalesce(any_value(a), '') AS artists
FROM (SELECT user_id, track_id, true AS liked, false AS disliked FROM favorites UNION ALL
  SELECT user_id, track_id, event_type IN ('liked','preview_completed','youtube_opened'), event_type IN ('disliked','dismissed') FROM interactions)
LEFT JOIN (SELECT user_id, string_agg(DISTINCT lower(provider_subgenre), ',' ORDER BY lower(provider_subgenre)) AS s,
   string_agg(DISTINCT lower(artist), ',' ORDER BY lower(artist)) AS a FROM favorites JOIN tracks USING (track_id) GROUP BY user_id) USING (user_id)
WHERE liked OR disliked GROUP BY user_id"""


@query("q_taste", sql=TASTE_SQL)
def q_taste(c):
    return taste_text(ls.taste(c.favorites, c.interactions, c.tracks))


@query("q_feedback", views={"fb_all": """
SELECT user_id, track_id, CASE event_id % 3 WHEN 0 THEN 'more_like_this' WHEN 1 THEN 'too_sad' ELSE 'too_different' END AS reason, created_at, event_id, 0 AS source
FROM interactions WHERE event_type = 'selected' UNION ALL SELECT user_id, track_id, CASE value WHEN 2 THEN 'more_like_this' WHEN -2 THEN 'too_sad' WHEN -3 THEN 'too_different' END,
 created_at, event_id, 1 FROM interactions"""}, sql="""
SELECT user_id, track_id, reason, CAST(source AS BIGINT) AS source, CAST(position AS BIGINT) AS position FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY source, created_at DESC, event_id DESC) AS position FROM (
  SELECT * FROM fb_all WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, track_id ORDER BY source, created_at DESC, event_id DESC) = 1))
WHERE position <= 100""")
def q_feedback(c):
    return feedback(c).select("user_id", "track_id", "reason", F.col("source").cast("bigint").alias("source"),
                              F.col("position").cast("bigint").alias("position"))


def feedback(c):
    """Local feedback is read from the 'selected' events."""
    pick = F.col("event_id") % 3
    reason = F.when(pick == 0, "more_like_this").when(pick == 1, "too_sad").otherwise("too_different")
    local = c.interactions.filter("event_type = 'selected'").withColumn("reason", reason)
    return ls.combined_feedback(local, c.interactions)


@query("q_bounded_list", sql="""
SELECT user_id, track_id, k AS replace_key, event_id, CAST(position AS BIGINT) AS position FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, event_id DESC) AS position FROM (
  SELECT *, CASE WHEN value IS NOT NULL THEN '#value' ELSE event_type END AS k FROM interactions
  QUALIFY row_number() OVER (PARTITION BY user_id, track_id, k ORDER BY created_at DESC, event_id DESC) = 1)) WHERE position <= 30""")
def q_bounded_list(c):
    """The 30 newest interactions per user after same-key replacement (the bound is the feature)."""
    keyed = c.interactions.withColumn("replace_key", ls.replace_key())
    return ls.bounded_list(keyed, ["track_id", "replace_key"], 30).select(
        "user_id", "track_id", "replace_key", "event_id", F.col("position").cast("bigint").alias("position"))


@query("q_over_limit", sql="SELECT user_id, count(*) AS entries FROM favorites GROUP BY user_id HAVING count(*) > 5")
def q_over_limit(c):
    """Listeners whose favourites exceed five entries."""
    return ls.over_limit(c.favorites, 5)


@query("q_preferences", views=LATEST, sql="""
SELECT user_id, kind, track_id, count(*) AS n FROM (SELECT user_id, 'favorite' AS kind, track_id FROM favorites
 UNION ALL SELECT user_id, 'interaction', track_id FROM interactions
 UNION ALL SELECT l.user_id, 'item', i.track_id FROM latest l JOIN items i ON i.run_id = l.id AND i.rank <= 12) GROUP BY ALL""")
def q_preferences(c):
    out = ls.preferences(c.favorites, c.interactions, ls.history(c.runs, c.items))
    return out.groupBy("user_id", "kind", "track_id").agg(F.count("*").alias("n"))
