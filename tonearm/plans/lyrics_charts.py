"""Lyric and chart queries."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from tonearm.operators import charts as ch, lyrics as ly
from tonearm.plans import oracle as o
from tonearm.plans.registry import query, r6
from tonearm.sources.adapters import CHECK_THEMES


@query("q_lyric_features", sql="""
SELECT track_id, language, instrumental, array_to_string(themes, ',') AS themes, array_to_string(list_transform(theme_vec, lambda x: CAST(round(x * 10000) AS BIGINT)), ',') AS theme_vector,
 round(sentiment, 6) + 0.0 AS sentiment, round(arousal, 6) AS arousal, round(confidence, 6) AS confidence FROM lyr""")
def q_lyric_features(c):
    out = ly.lyric_features(c.lyric_texts, c.vocabulary, CHECK_THEMES)
    vector = F.array_join(F.array(*[F.round(F.col("theme_vector")[t] * 10000).cast("bigint").cast("string") for t in CHECK_THEMES]), ",")
    return out.select("track_id", "language", "instrumental", F.array_join("themes", ",").alias("themes"), vector.alias("theme_vector"),
                      r6("sentiment"), r6("arousal"), r6("confidence"))


@query("q_lyric_backlog", sql="""
SELECT track_id, title FROM tracks WHERE track_id NOT IN (SELECT track_id FROM lyr WHERE language = 'en') ORDER BY track_id LIMIT 50""")
def q_lyric_backlog(c):
    """The next batch; the batch size (50) is the feature."""
    return ly.lyric_backlog(c.tracks, c.lyric_features.filter("language = 'en'"), 50).select("track_id", "title")


@query("q_lyric_summary", sql="""
SELECT count(*) AS processed, count(*) FILTER (s = 'analyzed') AS analyzed, count(*) FILTER (s = 'not-found') AS not_found,
 count(*) FILTER (s = 'no-lyrics') AS no_lyrics, count(*) FILTER (s = 'error') AS errors FROM (
 SELECT CASE WHEN t.preview_url IS NULL THEN 'error' WHEN l.track_id IS NULL THEN 'not-found' WHEN l.instrumental THEN 'no-lyrics' ELSE 'analyzed' END AS s
 FROM tracks t LEFT JOIN lyr l ON l.track_id = t.track_id)""")
def q_lyric_summary(c):
    joined = c.tracks.join(c.lyric_features.select("track_id", "instrumental"), "track_id", "left")
    status = (F.when(F.col("preview_url").isNull(), "error").when(F.col("instrumental").isNull(), "not-found")
              .when(F.col("instrumental"), "no-lyrics").otherwise("analyzed"))
    return ly.run_summary(joined.select(status.alias("status")))


CHARTS = {
    "chart_rows": """SELECT n_nationkey AS nation, l_partkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY sum(l_quantity) DESC, l_partkey) AS r
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
      GROUP BY n_nationkey, l_partkey QUALIFY r <= 50""",
    "chart": """SELECT 'n' || nation AS country, r AS chart_rank, CAST(l_partkey AS VARCHAR) AS chart_id, 'chart-n' || nation || '-' || l_partkey AS track_id,
      upper(t.title) AS title, CASE WHEN r % 2 = 0 THEN t.artist ELSE 'The ' || t.artist END AS artist, t.album, t.year, t.preview_url, t.provider_genre
      FROM chart_rows JOIN tracks t ON t.track_id = 'apple-' || l_partkey""",
    "chart_match": f"""SELECT country, chart_id, match_id FROM (SELECT c.country, c.chart_id, t.track_id AS match_id,
      row_number() OVER (PARTITION BY c.country, c.chart_id ORDER BY ({o.norm_search('t.artist')} = {o.norm_search('c.artist')}) DESC, t.track_id) AS n
      FROM chart c JOIN tracks t ON {o.norm_search('t.title')} = {o.norm_search('c.title')} AND t.track_id IN (SELECT track_id FROM fp)
      WHERE {o.norm_search('t.artist')} = {o.norm_search('c.artist')} OR contains({o.norm_search('t.artist')}, {o.norm_search('c.artist')})
        OR contains({o.norm_search('c.artist')}, {o.norm_search('t.artist')})) WHERE n = 1""",
}


def feeds(c):
    """One feed document per nation: its 50 most bought tracks, spelled as a chart feed."""
    raw = c.raw
    sold = (raw("lineitem").join(raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .groupBy("c_nationkey", "l_partkey").agg(F.sum("l_quantity").alias("q")))
    top = sold.withColumn("r", F.row_number().over(W.partitionBy("c_nationkey").orderBy(F.desc("q"), "l_partkey"))).filter("r <= 50")
    t = c.tracks.withColumn("l_partkey", F.expr("CAST(substring(track_id, 7) AS BIGINT)"))
    rows = top.join(t, "l_partkey")
    item = F.struct(
        F.col("r"), F.col("l_partkey").cast("string").alias("id"), F.upper("title").alias("name"),
        F.when(F.col("r") % 2 == 0, F.col("artist")).otherwise(F.concat(F.lit("The "), "artist")).alias("artistName"),
        F.col("artwork_url").alias("artworkUrl100"), F.col("external_url").alias("url"))
    results = F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("r"))  # 50 positions per country
    return rows.groupBy(F.concat(F.lit("n"), F.col("c_nationkey")).alias("country")).agg(results.alias("results")).select(
        "country", F.to_json(F.struct(F.struct("results").alias("feed"))).alias("payload"))


def lookup(c):
    return c.tracks.select(
        F.expr("substring(track_id, 7)").alias("trackId"), F.col("title").alias("trackName"), F.col("artist").alias("artistName"),
        F.col("album").alias("collectionName"), F.concat(F.col("year").cast("string"), F.lit("-01-01")).alias("releaseDate"),
        F.col("artwork_url").alias("artworkUrl100"), F.col("preview_url").alias("previewUrl"),
        F.col("external_url").alias("trackViewUrl"), F.col("provider_genre").alias("primaryGenreName"))


def chart(c):
    return ch.chart_tracks(ch.parse_feed(feeds(c)), lookup(c))


@query("q_chart_normalize", views=CHARTS, sql="""
SELECT country, CAST(chart_rank AS BIGINT) AS chart_rank, track_id, title, artist, album, CAST(year AS DOUBLE) AS year,
 'https://example.test/art/' || chart_id || '/300x300bb.jpg' AS artwork_url, coalesce(preview_url, '') AS preview_url, provider_genre FROM chart""")
def q_chart_normalize(c):
    return chart(c).select("country", F.col("chart_rank").cast("bigint").alias("chart_rank"), "track_id", "title", "artist", "album",
                           F.col("year").cast("double").alias("year"), "artwork_url", "preview_url", "provider_genre")


@query("q_chart_match", views=CHARTS, sql="SELECT country, chart_id, match_id FROM chart_match")
def q_chart_match(c):
    return ch.match_chart(chart(c), c.tracks, c.fingerprints)


@query("q_chart_view", views=CHARTS, sql="""
SELECT c.country, CAST(c.chart_rank AS BIGINT) AS chart_rank, coalesce(m.match_id, c.track_id) AS track_id, c.title, c.artist,
 CASE WHEN m.match_id IS NULL THEN c.album ELSE t.album END AS album, coalesce(t.preview_url, coalesce(c.preview_url, '')) AS preview_url,
 CASE WHEN m.match_id IS NULL THEN 'Country chart' ELSE 'Catalogue' END AS source, round(f.bpm, 6) AS bpm, f.acoustic_signature,
 CASE WHEN m.match_id IS NULL THEN 'pending' ELSE 'complete' END AS analysis_status, m.match_id IS NOT NULL AS catalogued
FROM chart c LEFT JOIN chart_match m ON m.country = c.country AND m.chart_id = c.chart_id LEFT JOIN tracks t ON t.track_id = m.match_id LEFT JOIN fp f ON f.track_id = m.match_id""")
def q_chart_view(c):
    rows = chart(c)
    out = ch.chart_view(rows, ch.match_chart(rows, c.tracks, c.fingerprints), c.tracks, c.fingerprints)
    return out.withColumns({"bpm": r6(F.col("bpm")), "chart_rank": F.col("chart_rank").cast("bigint")})


@query("q_chart_snapshot", views=CHARTS, sql="""
SELECT country, 'apple-' || chart_id AS track_id, title, artist, CAST(chart_rank AS BIGINT) AS chart_rank, true AS snapshot, true AS stale FROM chart""")
def q_chart_snapshot(c):
    return ch.chart_snapshot(chart(c))
