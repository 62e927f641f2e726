"""Chart jobs: normalise a feed, match it to the catalogue, decorate, snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from tonearm.functions.text import normalize_search
from tonearm.operators.catalogue import first_by
from tonearm.sources.catalogue import year_of

FEED = T.StructType([T.StructField("feed", T.StructType([T.StructField("results", T.ArrayType(T.StructType([
    T.StructField(n, T.StringType()) for n in ("id", "name", "artistName", "artworkUrl100", "url", "releaseDate")]
    + [T.StructField("genres", T.ArrayType(T.StructType([T.StructField("name", T.StringType())])))])))]))])
LOOKUP = ["trackName", "artistName", "collectionName", "releaseDate", "artworkUrl100", "previewUrl", "trackViewUrl", "primaryGenreName"]


def parse_feed(feeds: DataFrame) -> DataFrame:
    """feeds(country, payload) -> one row per chart position."""
    parsed = feeds.select("country", F.from_json("payload", FEED).alias("p"))
    return parsed.select("country", F.posexplode("p.feed.results").alias("position", "item")).select(
        "country", (F.col("position") + 1).alias("chart_rank"), "item.*")


def _filled(*names):
    return F.coalesce(*[F.when(F.coalesce(F.col(n), F.lit("")) != "", F.col(n)) for n in names])


def chart_tracks(items: DataFrame, lookup: DataFrame | None = None, size: str = "300x300bb") -> DataFrame:
    """Chart positions with lookup details; works without a lookup table."""
    if lookup is None:
        joined = items.withColumns({f"l_{n}": F.lit(None).cast("string") for n in LOOKUP})
    else:
        joined = items.join(lookup.select(F.col("trackId").alias("id"), *[F.col(n).alias(f"l_{n}") for n in LOOKUP]), "id", "left")
    text = lambda value, default: F.coalesce(value, F.lit(default))
    genre = F.coalesce(_filled("l_primaryGenreName"), F.try_element_at("genres", F.lit(1))["name"])
    return joined.select(
        "country", "chart_rank", F.col("id").alias("chart_id"), F.concat_ws("-", F.lit("chart"), "country", "id").alias("track_id"),
        text(_filled("name", "l_trackName"), "Unknown title").alias("title"),
        text(_filled("artistName", "l_artistName"), "Unknown artist").alias("artist"),
        text(_filled("l_collectionName"), "").alias("album"),
        year_of(_filled("l_releaseDate", "releaseDate")).alias("year"),
        F.regexp_replace(text(_filled("l_artworkUrl100", "artworkUrl100"), ""), "100x100bb", size).alias("artwork_url"),
        text(_filled("l_previewUrl"), "").alias("preview_url"),
        text(_filled("url", "l_trackViewUrl"), "").alias("external_url"), genre.alias("provider_genre"))


def match_chart(chart: DataFrame, tracks: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Best analysed catalogue row of each chart item: same normalised title, related artist.

    An equi-join on the title; the best match per item is kept map-side, so a title shared by a
    third of the catalogue costs one row per task and item.
    """
    t = tracks.join(fingerprints.select("track_id"), "track_id", "left_semi").select(
        F.col("track_id").alias("match_id"), normalize_search("title").alias("_title"), normalize_search("artist").alias("_b"))
    c = chart.select("country", "chart_id", normalize_search("title").alias("_title"), normalize_search("artist").alias("_a"))
    pairs = c.join(t, "_title").filter(
        (F.col("_a") == F.col("_b")) | F.contains(F.col("_b"), F.col("_a")) | F.contains(F.col("_a"), F.col("_b")))
    ranked = pairs.withColumn("_other", F.col("_a") != F.col("_b")).select("country", "chart_id", "match_id", "_other")
    return first_by(ranked, ["country", "chart_id"], ["_other", "match_id"]).select("country", "chart_id", "match_id")


def chart_view(chart: DataFrame, matched: DataFrame, tracks: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Chart rows decorated with their catalogue row, or marked as not catalogued."""
    known = (matched.join(tracks.select(F.col("track_id").alias("match_id"), F.col("album").alias("m_album"),
                                        F.col("preview_url").alias("m_preview")), "match_id")
             .join(fingerprints.select(F.col("track_id").alias("match_id"), "acoustic_signature", F.col("profile.bpm").alias("bpm")), "match_id"))
    out = chart.join(known, ["country", "chart_id"], "left")
    found = F.col("match_id").isNotNull()
    return out.select(
        "country", "chart_rank", F.coalesce("match_id", "track_id").alias("track_id"), "title", "artist",
        F.when(found, F.col("m_album")).otherwise(F.col("album")).alias("album"),
        F.coalesce("m_preview", "preview_url").alias("preview_url"),
        F.when(found, F.lit("Catalogue")).otherwise(F.lit("Country chart")).alias("source"), "bpm", "acoustic_signature",
        F.when(found, F.lit("complete")).otherwise(F.lit("pending")).alias("analysis_status"), found.alias("catalogued"))


def chart_snapshot(chart: DataFrame, prefix: str = "apple-") -> DataFrame:
    """Stored form of a chart: catalogue ids, re-ranked per country, flagged as a snapshot."""
    from pyspark.sql import Window as W
    rank = F.row_number().over(W.partitionBy("country").orderBy("chart_rank"))
    return chart.select("country", F.concat(F.lit(prefix), "chart_id").alias("track_id"), "title", "artist",
                        rank.cast("bigint").alias("chart_rank"), F.lit(True).alias("snapshot"), F.lit(True).alias("stale"))
