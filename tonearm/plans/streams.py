"""Streaming queries, drained with availableNow so that they can be compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonearm.plans.registry import query
from tonearm.sources.adapters import Dialect, interactions_sql
from tonearm.streaming import listeners as st

# a glob lets the file source read one file as well as a folder of part files


def events_stream(c):
    raw = st.read_stream(c.spark, f"{c.folder}/events.parque[t]", c.raw("events").schema)
    rows = c._sql(interactions_sql(Dialect("spark")), events=raw)
    return rows.withColumn("created_at", F.col("created_at").cast("timestamp"))


@query("q_stream_taste", sql="""
SELECT user_id, track_id, bool_or(event_type IN ('liked','preview_completed','youtube_opened')) AS liked, bool_or(event_type IN ('disliked','dismissed')) AS disliked
FROM interactions GROUP BY user_id, track_id HAVING bool_or(event_type IN ('liked','preview_completed','youtube_opened','disliked','dismissed'))""")
def q_stream_taste(c):
    return st.taste_now(events_stream(c))


@query("q_stream_feedback", sql="""
SELECT user_id, CAST(position AS BIGINT) AS position, track_id, reason, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, event_id DESC) AS position FROM (
 SELECT *, CASE value WHEN 2 THEN 'more_like_this' WHEN -2 THEN 'too_sad' ELSE 'too_different' END AS reason FROM interactions WHERE value IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY user_id, track_id ORDER BY created_at DESC, event_id DESC) = 1)) WHERE position <= 20""")
def q_stream_feedback(c):
    """The twenty newest feedback rows per listener (the bound is the feature)."""
    return st.feedback_now(events_stream(c), 20)


@query("q_stream_status", sql="""
SELECT (SELECT count(*) FROM embeddings) AS indexed, (SELECT count(*) FROM events WHERE event_type = 'error') AS failures, (SELECT count(*) FROM tracks) AS total,
 greatest(0, (SELECT count(*) FROM tracks) - (SELECT count(*) FROM embeddings)) AS remaining""")
def q_stream_status(c):
    """Fingerprints and failures as they land: embedding rows index tracks, error events are failures."""
    landed = st.read_stream(c.spark, f"{c.folder}/embeddings.parque[t]", c.raw("embeddings").schema).select(F.lit("indexed").alias("kind"))
    failed = st.read_stream(c.spark, f"{c.folder}/events.parque[t]", c.raw("events").schema).filter("event_type = 'error'").select(F.lit("failed").alias("kind"))
    return st.status_now(landed.union(failed), c.tracks)
