"""Source, sink and payload queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tonearm.operators import library as lib
from tonearm.plans.catalogue import SUB_VIEWS
from tonearm.plans.registry import query, r6
from tonearm.session import checkpoint_dir
from tonearm.sources import catalogue as src

TRACK_COLUMNS = "track_id, title, artist, album, provider_genre, provider_subgenre, seed_genre, CAST(year AS DOUBLE) AS year, duration_ms, preview_url"


@query("q_scan_tracks", sql=f"SELECT {TRACK_COLUMNS} FROM tracks")
def q_scan_tracks(c):
    return c.tracks.selectExpr(*TRACK_COLUMNS.split(", "))


PROFILED = ["title", "artist", "year", "preview_url", "provider_genre", "theme_pool"]


@query("q_null_profile", sql=" UNION ALL ".join(
    f"SELECT '{n}' AS \"column\", count(*) AS \"rows\", count(*) - count({n}) AS nulls, count(DISTINCT {n}) AS \"distinct\" FROM tracks"
    for n in PROFILED))
def q_null_profile(c):
    required = src.read_training(c.tracks, PROFILED)
    return src.null_profile(required, PROFILED)


def store_payloads(c):
    """Track rows spelled as store payloads (every 17th has no artist)."""
    t = c.tracks
    number = F.expr("CAST(substring(track_id, 7) AS BIGINT)")
    body = F.struct(
        number.cast("string").alias("trackId"), F.col("title").alias("trackName"),
        F.when(number % 17 != 0, F.col("artist")).alias("artistName"), F.col("external_url").alias("trackViewUrl"),
        F.concat(F.col("year").cast("string"), F.lit("-01-01")).alias("releaseDate"),
        F.col("provider_genre").alias("primaryGenreName"), F.col("preview_url").alias("previewUrl"),
        F.col("album").alias("collectionName"), F.col("artwork_url").alias("artworkUrl100"),
        F.col("duration_ms").cast("string").alias("trackTimeMillis"))
    return t.select(number.alias("n"), F.to_json(body).alias("payload"))


@query("q_normalize_provider", sql="""
SELECT track_id, title, artist, album, CAST(year AS DOUBLE) AS year, duration_ms, coalesce(preview_url, '') AS preview_url,
  external_url, provider_genre, 'Apple Music' AS source FROM tracks WHERE CAST(substring(track_id, 7) AS BIGINT) % 17 <> 0""")
def q_normalize_provider(c):
    out = src.normalize_provider(store_payloads(c).select("payload"))
    return out.select("track_id", "title", "artist", "album", F.col("year").cast("double").alias("year"), "duration_ms",
                      "preview_url", "external_url", "provider_genre", "source")


def recording_payloads(c):
    t = c.tracks.withColumn("n", F.expr("CAST(substring(track_id, 7) AS BIGINT)"))
    names = F.split("artist", " feat\\. ")
    credit = F.transform(names, lambda name, i: F.struct(
        name.alias("name"), F.when(i + 1 < F.size(names), F.lit(" feat. ")).otherwise(F.lit("")).alias("joinphrase")))
    body = F.struct(
        F.col("n").cast("string").alias("id"), F.col("title").alias("title"), F.col("duration_ms").alias("length"), credit.alias("artist-credit"),
        F.array(F.struct(F.col("album").alias("title"), F.concat(F.col("year").cast("string"), F.lit("-02-03")).alias("date"))).alias("releases"),
        F.array(F.struct(F.col("provider_genre").alias("name"), (F.col("n") % 3).alias("count")),
                F.struct(F.col("provider_subgenre").alias("name"), (F.col("n") % 2).alias("count"))).alias("tags"))
    return t.select(F.to_json(body).alias("payload"))


@query("q_normalize_recordings", sql="""
SELECT 'mb-' || substring(track_id, 7) AS track_id, title, artist, album, CAST(year AS DOUBLE) AS year,
  CASE WHEN CAST(substring(track_id, 7) AS BIGINT) % 2 > CAST(substring(track_id, 7) AS BIGINT) % 3 THEN provider_subgenre
    ELSE provider_genre END AS provider_genre, duration_ms, 'https://musicbrainz.org/recording/' || substring(track_id, 7) AS external_url,
  'MusicBrainz' AS source FROM tracks""")
def q_normalize_recordings(c):
    return src.normalize_recordings(recording_payloads(c)).select(
        "track_id", "title", "artist", "album", F.col("year").cast("double").alias("year"), "provider_genre", "duration_ms", "external_url", "source")


@query("q_parse_fingerprints", sql="""
SELECT track_id, len(vector) AS n, round(list_sum(vector), 6) AS total, round(bpm, 6) AS bpm, round(aggression, 6) AS aggression,
  key, mode, acoustic_signature FROM fp""")
def q_parse_fingerprints(c):
    stored = c.fingerprints.select("track_id", F.to_json("vector").alias("vector"), F.to_json("profile").alias("profile"),
                                   "acoustic_signature")
    out = src.parse_fingerprints(stored)
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)
    return out.select("track_id", F.size("vector").cast("bigint").alias("n"), r6(total, "total"), r6(F.col("profile.bpm"), "bpm"),
                      r6(F.col("profile.aggression"), "aggression"), "profile.key", "profile.mode", "acoustic_signature")


@query("q_library", sql="""
SELECT f.track_id, t.title, t.artist, f.acoustic_signature, l.language, l.instrumental, array_to_string(l.themes, ',') AS themes,
  round(l.sentiment, 6) AS sentiment, round(l.arousal, 6) AS arousal, round(l.confidence, 6) AS confidence
FROM fp f JOIN tracks t ON f.track_id = t.track_id LEFT JOIN lyr l ON l.track_id = f.track_id""")
def q_library(c):
    rows = lib.library(c.fingerprints, c.tracks, c.lyric_features)
    return rows.orderBy("track_id").select("track_id", "title", "artist", "acoustic_signature", "language", "instrumental",
                                           F.array_join("themes", ",").alias("themes"), r6("sentiment"), r6("arousal"),
                                           r6("confidence"))


@query("q_export_manifest", sql="""
SELECT n AS indexed, substring(sha256(n || '-' || w), 1, 16) AS version, (SELECT count(*) FROM tracks) AS total FROM (
 SELECT (SELECT count(*) FROM fp) AS n, string_agg(s, '-' ORDER BY i) AS w FROM (
  SELECT i, CAST(CAST(sum(CAST('0x' || substring(h, 1 + 8 * i, 8) AS BIGINT)) AS BIGINT) AS VARCHAR) AS s FROM (
   SELECT sha256(track_id || '|' || acoustic_signature || '|' ||
    array_to_string(list_transform(vector, lambda v: CAST(round(v * 1e6) AS BIGINT)), ',')) AS h FROM fp), range(8) r(i) GROUP BY i))""")
def q_export_manifest(c):
    """The snapshot is written; its manifest is made from the rows."""
    return src.export_catalogue(c.tracks, c.fingerprints, f"{checkpoint_dir(c.spark)}/export-{uuid.uuid4().hex}").select("indexed", "version", "total")


@query("q_index_manifest", sql="""
SELECT count(l.track_id) AS indexed, count(*) AS total,
 count(*) FILTER (t.preview_url IS NOT NULL AND l.track_id IS NULL) AS failed, 'm' AS model, 'r1' AS revision
FROM tracks t LEFT JOIN learned l ON l.track_id = t.track_id""")
def q_index_manifest(c):
    return src.index_manifest(c.learned, c.tracks, "m", "r1").select("indexed", "total", "failed", "model", "revision")


@query("q_write_roundtrip", sql="""
SELECT provider_genre, count(*) AS n, count(DISTINCT title) AS titles FROM tracks GROUP BY provider_genre""")
def q_write_roundtrip(c):
    stored = src.write_table(c.tracks, f"{checkpoint_dir(c.spark)}/tracks-{uuid.uuid4().hex}", "seed_genre")
    return stored.groupBy("provider_genre").agg(F.count("*").alias("n"), F.count_distinct("title").alias("titles"))


@query("q_index_rows", sql="""
SELECT l.track_id, len(embedding) AS dims, CAST(list_sum(embedding) AS BIGINT) AS total, round(list_max(mood_scores), 6) AS best_mood, preview_seconds FROM learned l JOIN tracks t ON t.track_id = l.track_id""")
def q_index_rows(c):
    """The learned index exported and read again."""
    path = f"{checkpoint_dir(c.spark)}/index-{uuid.uuid4().hex}"
    src.export_index(c.learned, c.tracks, path, "m", "r1")
    total = F.aggregate("embedding", F.lit(0).cast("bigint"), lambda s, x: s + x)
    return src.read_index(c.spark, path).select("track_id", F.size("embedding").cast("bigint").alias("dims"), total.alias("total"),
                                                r6(F.array_max("mood_scores"), "best_mood"), "preview_seconds")


@query("q_scan_csv", views={**SUB_VIEWS, "sg_plain": """SELECT t.track_id, coalesce(g.s, k.s, s.s, lower(trim(t.provider_genre))) AS subgenre FROM sg_keyed t
  LEFT JOIN sg_genre g ON g.g = t.gkey LEFT JOIN sg_canon k ON k.g = t.gkey LEFT JOIN sg_seed s ON s.g = t.seed_genre"""}, sql="""
SELECT 'given' AS kind, track_id, title, artist, CAST(year AS DOUBLE) AS year, preview_url, provider_subgenre FROM tracks
UNION ALL SELECT 'inferred', t.track_id, title, artist, CAST(year AS DOUBLE), preview_url, p.subgenre FROM tracks t JOIN sg_plain p ON p.track_id = t.track_id""")
def q_scan_csv(c):
    """The catalogue as CSV files with and without the sub-genre column."""
    path = f"{checkpoint_dir(c.spark)}/csv-{uuid.uuid4().hex}"
    full = c.tracks.drop("theme_pool")
    for name, frame in (("given", full), ("inferred", full.drop("provider_subgenre"))):
        frame.write.csv(f"{path}/{name}.csv", header=True)
    one = lambda name: src.read_catalogue(c.spark, f"{path}/{name}.csv").select(
        F.lit(name).alias("kind"), "track_id", "title", "artist", F.col("year").cast("double").alias("year"), "preview_url", "provider_subgenre")
    return one("given").unionByName(one("inferred"))
