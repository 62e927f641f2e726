"""Catalogue cleaning, quality and maintenance queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tonearm.functions import taxonomy as tx, text
from tonearm.operators import catalogue as cat
from tonearm.plans import oracle as o
from tonearm.plans.registry import query, r6
from tonearm.session import checkpoint_dir
from tonearm.sources.adapters import GENRES
from tonearm.sources.versions import KeyedTable

NUM = "CAST(substring(track_id, 7) AS BIGINT)"
TRAINING = {"training": f"""
SELECT t.track_id, t.title, t.artist, t.provider_genre AS genre, t.theme_pool AS primary_theme_pool,
  f.texture AS timbre, f.key AS chroma_key, 2 * f.valence - 1 AS vader_sentiment, f.energy / 100 AS arousal, f.vector,
  t.theme_pool AS theme_1, CASE WHEN {NUM.replace('track_id', 't.track_id')} % 2 = 0 THEN 'none' END AS theme_2
FROM fp f JOIN tracks t ON t.track_id = f.track_id"""}


def training(c):
    odd = F.expr(NUM.replace("track_id", "t.track_id")) % 2 == 0
    return (c.fingerprints.alias("f").join(c.tracks.alias("t"), "track_id").select(
        "track_id", "t.title", "t.artist", F.col("t.provider_genre").alias("genre"),
        F.col("t.theme_pool").alias("primary_theme_pool"), F.col("f.profile.texture").alias("timbre"),
        F.col("f.profile.key").alias("chroma_key"), (2 * F.col("f.vector")[2] - 1).alias("vader_sentiment"),
        (F.col("f.profile.energy") / 100).alias("arousal"), "f.vector", F.col("t.theme_pool").alias("theme_1"),
        F.when(odd, F.lit("none")).alias("theme_2")))


@query("q_fill_themes", views=TRAINING, sql="SELECT track_id, coalesce(theme_1, 'none') AS theme_1, coalesce(theme_2, 'none') AS theme_2 FROM training")
def q_fill_themes(c):
    return cat.fill_themes(training(c), ["theme_1", "theme_2"]).select("track_id", "theme_1", "theme_2")


ENCODED = ["genre", "timbre", "chroma_key", "primary_theme_pool"]


@query("q_label_encode", views=TRAINING, sql="SELECT track_id, " + ", ".join(
    f"CAST(dense_rank() OVER (ORDER BY {n}) - 1 AS BIGINT) AS {n}_encoded" for n in ENCODED) + " FROM training")
def q_label_encode(c):
    return cat.label_encode(training(c), ENCODED).select("track_id", *[F.col(f"{n}_encoded").cast("bigint").alias(f"{n}_encoded") for n in ENCODED])


@query("q_dedupe_first", sql="""
SELECT track_id, title, artist FROM tracks QUALIFY row_number() OVER (PARTITION BY title, artist ORDER BY track_id) = 1""")
def q_dedupe_first(c):
    return cat.dedupe_first(c.tracks.select("track_id", "title", "artist"))


@query("q_split_distribution", sql="""
SELECT provider_genre, split, count(*) AS n, min(track_id) AS first_id, max(track_id) AS last_id FROM (
 SELECT provider_genre, track_id, CASE WHEN row_number() OVER (PARTITION BY provider_genre ORDER BY sha256('42' || track_id))
   <= round(count(*) OVER (PARTITION BY provider_genre) * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM tracks) GROUP BY 1, 2""")
def q_split_distribution(c):
    split = cat.stratified_split(c.tracks.select("track_id", "provider_genre"), "provider_genre")
    return split.groupBy("provider_genre", "split").agg(
        F.count("*").alias("n"), F.min("track_id").alias("first_id"), F.max("track_id").alias("last_id"))


@query("q_recording_identity", sql=f"SELECT track_id, {o.identity('title', 'artist')} AS identity FROM tracks")
def q_recording_identity(c):
    return c.tracks.select("track_id", text.recording_identity("title", "artist").alias("identity"))


UNICODE_ID = f"{o.words_only('lower(title)', chr(92) + 'p{L}' + chr(92) + 'p{N}_')} || '::' || {o.words_only('lower(artist)', chr(92) + 'p{L}' + chr(92) + 'p{N}_')}"


@query("q_identity_variants", sql=f"""
SELECT track_id, trim(lower(title)) || '::' || trim(lower(artist)) AS exact_key,
  trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) || '::' || trim(regexp_replace(lower(artist), '[^a-z0-9]+', ' ', 'g')) AS ascii_key,
  {UNICODE_ID} AS unicode_key FROM tracks""")
def q_identity_variants(c):
    return c.tracks.select("track_id", text.identity("title", "artist", "exact").alias("exact_key"),
                           text.identity("title", "artist", "ascii").alias("ascii_key"),
                           text.identity("title", "artist", "unicode").alias("unicode_key"))


MERGE_VIEWS = {
    "existing": f"SELECT track_id, title, artist, album, provider_genre, seed_genre, year FROM tracks WHERE source IS NOT NULL",
    "batch": f"""SELECT track_id, title, artist, album || ' (new)' AS album, provider_genre, seed_genre, year,
      {NUM} AS position FROM tracks""",
    "known": f"SELECT DISTINCT {UNICODE_ID} AS identity FROM existing",
    "fresh": f"""SELECT * FROM (SELECT *, {UNICODE_ID} AS identity FROM batch) WHERE track_id NOT IN (SELECT track_id FROM existing)
      AND identity NOT IN (SELECT identity FROM known) QUALIFY row_number() OVER (PARTITION BY identity ORDER BY position) = 1""",
    "inserted": "SELECT * FROM fresh ORDER BY position LIMIT 40",
    "merge_stop": "SELECT CASE WHEN count(*) >= 40 THEN max(position) ELSE 9223372036854775807 END AS stop FROM inserted",
}


@query("q_merge_catalogue", views=MERGE_VIEWS, sql="""
SELECT track_id, title, artist, album, provider_genre FROM existing WHERE track_id NOT IN (
   SELECT track_id FROM batch, merge_stop WHERE position <= stop)
UNION ALL SELECT b.track_id, b.title, b.artist, b.album, b.provider_genre FROM batch b, merge_stop WHERE position <= stop
  AND (b.track_id IN (SELECT track_id FROM existing) OR b.track_id IN (SELECT track_id FROM inserted))""")
def q_merge_catalogue(c):
    """A batch that stops after 40 new rows (the bound is the feature)."""
    return merged(c, 40)


def merged(c, most):
    """The provider batch is the whole catalogue; rows without a source are not in ours yet."""
    columns = ["track_id", "title", "artist", "album", "provider_genre", "seed_genre", "year"]
    existing = c.tracks.filter("source IS NOT NULL").select(*columns)
    batch = c.tracks.select(*columns).withColumns({"album": F.concat("album", F.lit(" (new)")), "position": F.expr(NUM)})
    out = cat.merge_catalogue(existing, batch, max_new=most)
    return out.select("track_id", "title", "artist", "album", "provider_genre")


@query("q_merge_catalogue_all", views=MERGE_VIEWS, sql="""
SELECT track_id, title, artist, album, provider_genre FROM existing WHERE track_id NOT IN (SELECT track_id FROM batch)
UNION ALL SELECT track_id, title, artist, album, provider_genre FROM batch
  WHERE track_id IN (SELECT track_id FROM existing) OR track_id IN (SELECT track_id FROM fresh)""")
def q_merge_catalogue_all(c):
    """The same batch without a bound on new rows."""
    return merged(c, None)


@query("q_round_robin", views={"rr_pool": f"""
SELECT seed_genre AS grp, {NUM} % 6 AS pool, row_number() OVER (PARTITION BY seed_genre, {NUM} % 6 ORDER BY {NUM}) AS position, track_id, title, artist,
  {UNICODE_ID} AS identity FROM tracks""", "rr_known": f"SELECT track_id, {UNICODE_ID} AS identity FROM tracks WHERE preview_url IS NULL",
  "rr_queue": """SELECT *, row_number() OVER (PARTITION BY grp, pool ORDER BY position) - 1 AS off FROM (SELECT * FROM rr_pool
    WHERE track_id NOT IN (SELECT track_id FROM rr_known) AND identity NOT IN (SELECT identity FROM rr_known)
    QUALIFY row_number() OVER (PARTITION BY grp, pool, identity ORDER BY position) = 1)""",
  "rr_a": "SELECT * FROM (SELECT * FROM rr_queue WHERE grp = 'metal' QUALIFY row_number() OVER (PARTITION BY identity ORDER BY off, pool) = 1) ORDER BY off, pool LIMIT 100",
  "rr_b": "SELECT * FROM (SELECT * FROM rr_queue WHERE grp = 'indie' AND identity NOT IN (SELECT identity FROM rr_a) QUALIFY row_number() OVER (PARTITION BY identity ORDER BY off, pool) = 1) ORDER BY off, pool LIMIT 100",
  "rr_c": """SELECT * FROM (SELECT * FROM rr_queue WHERE grp = 'pop' AND identity NOT IN (SELECT identity FROM rr_a) AND identity NOT IN (SELECT identity FROM rr_b)
    QUALIFY row_number() OVER (PARTITION BY identity ORDER BY off, pool) = 1) ORDER BY off, pool LIMIT 100"""},
  sql="SELECT grp AS \"group\", pool, CAST(off AS BIGINT) AS \"offset\", track_id FROM (SELECT * FROM rr_a UNION ALL SELECT * FROM rr_b UNION ALL SELECT * FROM rr_c)")
def q_round_robin(c):
    """Pools of search results per language group; the target (100 per group) is the feature."""
    from pyspark.sql import Window as W
    number = F.expr(NUM)
    t = c.tracks.withColumns({"group": F.col("seed_genre"), "pool": number % 6})
    position = F.row_number().over(W.partitionBy("group", "pool").orderBy(number))
    pools = t.withColumn("position", position).select("group", "pool", "position", "track_id", "title", "artist")
    known = c.tracks.filter("preview_url IS NULL")
    out = cat.round_robin_select(pools, known, ["metal", "indie", "pop"], 100)
    return out.select("group", "pool", F.col("offset").cast("bigint").alias("offset"), "track_id")


@query("q_enrich_preview", sql=f"""
SELECT track_id, CASE WHEN source IS NULL THEN 'https://new.test/' || {NUM} ELSE preview_url END AS preview_url FROM tracks""")
def q_enrich_preview(c):
    lookup = c.tracks.filter("source IS NULL").select(
        "track_id", F.concat(F.lit("https://new.test/"), F.expr(NUM).cast("string")).alias("preview_url"))
    return cat.enrich_preview(c.tracks.select("track_id", "preview_url"), lookup)


ARTIST_ROWS = [(f"Artist {i + 1}", sub) for i, (_, sub) in enumerate(GENRES)]
OVERRIDE_ROWS = [("Artist 3", "red", "grunge", 1), ("Artist 5", "small", "shoegaze", 2)]
_values = lambda rows: ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in rows)
SUB_VIEWS = {
    "sg_artists": f"SELECT lower(a) AS name, s AS style FROM (VALUES {_values(ARTIST_ROWS)}) v(a, s)",
    "sg_over": f"SELECT lower(a) AS name, t AS title, s AS style, p AS pos FROM (VALUES {_values(OVERRIDE_ROWS)}) v(a, t, s, p)",
    "sg_genre": f"SELECT * FROM (VALUES {_values(tx.GENRE_ALIASES.items())}) v(g, s)",
    "sg_seed": f"SELECT * FROM (VALUES {_values(tx.SEED_ALIASES.items())}) v(g, s)",
    "sg_canon": "SELECT trim(regexp_replace(style, '[^a-z0-9]+', ' ', 'g')) AS g, style AS s FROM families",
    "sg_names": r"""SELECT track_id, unnest(list_distinct(list_filter(list_concat([trim(regexp_replace(lower(artist), '[^a-z0-9]+', ' ', 'g'))],
      list_transform(regexp_split_to_array(lower(artist), '\s*(?:&|,|/|;|\bfeat\.?\b|\bfeaturing\b|\bx\b)\s*'),
      lambda p: trim(regexp_replace(p, '[^a-z0-9]+', ' ', 'g')))), lambda n: n <> ''))) AS name FROM tracks""",
    "sg_o": """SELECT n.track_id, min_by(o.style, o.pos) AS style FROM sg_names n JOIN sg_over o ON o.name = n.name JOIN tracks t ON t.track_id = n.track_id
      WHERE starts_with(lower(t.title), o.title) GROUP BY n.track_id""",
    "sg_a": "SELECT n.track_id, max_by(a.style, len(n.name) || n.name) AS style FROM sg_names n JOIN sg_artists a ON a.name = n.name GROUP BY n.track_id",
    "sg_keyed": "SELECT *, trim(regexp_replace(lower(provider_genre), '[^a-z0-9]+', ' ', 'g')) AS gkey FROM tracks",
    "sg_out": """SELECT t.track_id, coalesce(o.style, a.style, g.s, k.s, s.s, lower(trim(t.provider_genre))) AS subgenre FROM sg_keyed t
      LEFT JOIN sg_o o ON o.track_id = t.track_id LEFT JOIN sg_a a ON a.track_id = t.track_id LEFT JOIN sg_genre g ON g.g = t.gkey
      LEFT JOIN sg_canon k ON k.g = t.gkey LEFT JOIN sg_seed s ON s.g = t.seed_genre""",
}


def inferred(c):
    artists = c.spark.createDataFrame(ARTIST_ROWS, "artist string, style string")
    over = c.spark.createDataFrame(OVERRIDE_ROWS, "artist string, title string, style string, position int")
    return cat.infer_subgenre(c.tracks, artists, over)


@query("q_infer_subgenre", views=SUB_VIEWS, sql="SELECT * FROM sg_out")
def q_infer_subgenre(c):
    return inferred(c).select("track_id", "subgenre")


@query("q_label_counts", views=SUB_VIEWS, sql="SELECT subgenre, count(*) AS tracks FROM sg_out GROUP BY subgenre")
def q_label_counts(c):
    return cat.label_counts(inferred(c))


@query("q_upsert", sql="""
SELECT track_id, round(CASE WHEN tonal_strength > 0.6 THEN bpm + 1 ELSE bpm END, 6) AS bpm, CAST(CASE WHEN tonal_strength > 0.6 THEN 2 ELSE 1 END AS BIGINT) AS version FROM fp""")
def q_upsert(c):
    rows = c.fingerprints.select("track_id", F.col("profile.bpm").alias("bpm"), F.col("profile.tonal_strength").alias("tonal"),
                                 F.lit(1).cast("bigint").alias("version"))
    changes = rows.filter("tonal > 0.6").withColumns({"bpm": F.col("bpm") + 1, "version": F.lit(2).cast("bigint")})
    return cat.upsert(rows, changes, ["track_id"]).select("track_id", r6("bpm"), "version")


@query("q_upsert_stored", sql="""
SELECT track_id, round(CASE WHEN tonal_strength > 0.6 THEN bpm + 1 ELSE bpm END, 6) AS bpm, CAST(CASE WHEN tonal_strength > 0.6 THEN 2 ELSE 1 END AS BIGINT) AS version FROM fp
UNION ALL SELECT 'new-' || track_id, round(bpm, 6), CAST(1 AS BIGINT) FROM fp WHERE tonal_strength <= 0.02""")
def q_upsert_stored(c):
    """The same change and some new rows as upserts of a stored table, which write only the buckets they touch."""
    rows = c.fingerprints.select("track_id", F.col("profile.bpm").alias("bpm"), F.col("profile.tonal_strength").alias("tonal"),
                                 F.lit(1).cast("bigint").alias("version"))
    table = KeyedTable.create(rows, f"{checkpoint_dir(c.spark)}/fingerprints-{uuid.uuid4().hex}", ["track_id"])
    table.upsert(rows.filter("tonal <= 0.02").withColumn("track_id", F.concat(F.lit("new-"), "track_id")))
    table.upsert(rows.filter("tonal > 0.6").withColumns({"bpm": F.col("bpm") + 1, "version": F.lit(2).cast("bigint")}))
    return table.read().select("track_id", r6("bpm"), "version")


@query("q_failure_ledger", sql=f"""
SELECT track_id, CAST(2 + {NUM} % 3 AS BIGINT) AS attempts, substring('retry failed: ' || title || repeat('x', 500), 1, 400) AS last_error, CAST(2 AS BIGINT) AS updated_at
FROM tracks WHERE preview_url IS NULL""")
def q_failure_ledger(c):
    lost = c.tracks.filter("preview_url IS NULL")
    ledger = lost.select("track_id", (1 + F.expr(NUM) % 3).alias("attempts"), F.lit("timeout").alias("last_error"),
                         F.lit(1).cast("bigint").alias("updated_at"))
    new = lost.select("track_id", F.concat(F.lit("retry failed: "), "title", F.repeat(F.lit("x"), F.lit(500))).alias("error"),
                      F.lit(2).cast("bigint").alias("at"))
    return cat.record_failures(ledger, new)


@query("q_index_backlog", sql="""
SELECT track_id, sha256('42' || track_id) AS order_key FROM tracks WHERE starts_with(coalesce(preview_url, ''), 'https://')
 AND track_id NOT IN (SELECT track_id FROM fp)""")
def q_index_backlog(c):
    return cat.index_backlog(c.tracks, c.fingerprints).select("track_id", "order_key")


@query("q_index_status", sql="""
SELECT (SELECT count(*) FROM fp) AS indexed, (SELECT count(*) FROM tracks) AS total,
 (SELECT count(*) FROM tracks WHERE preview_url IS NULL) AS failures,
 greatest(0, (SELECT count(*) FROM tracks) - (SELECT count(*) FROM fp)) AS remaining""")
def q_index_status(c):
    return cat.index_status(c.tracks, c.fingerprints, c.tracks.filter("preview_url IS NULL"))


@query("q_prune_duplicates", views={"pd_valid": "SELECT * FROM tracks WHERE seed_genre <> 'pop'"}, sql=f"""
SELECT track_id FROM tracks WHERE track_id NOT IN (SELECT track_id FROM pd_valid) AND track_id NOT IN (SELECT track_id FROM favorites)
 AND {UNICODE_ID} IN (SELECT {UNICODE_ID} FROM pd_valid)""")
def q_prune_duplicates(c):
    return cat.prune_duplicates(c.tracks, c.tracks.filter("seed_genre <> 'pop'"), c.favorites).select("track_id")


@query("q_validate_fingerprints", sql="""
SELECT track_id, CASE WHEN danceability > 0.8 THEN 'vector length' WHEN danceability < 0.2 THEN 'vector values' ELSE '' END AS reasons FROM fp""")
def q_validate_fingerprints(c):
    """Rows are broken by their own values: very danceable ones lose a value, undanceable ones get a NaN."""
    d = F.col("profile.danceability")
    broken = F.when(d > 0.8, F.slice("vector", 1, 34)).when(
        d < 0.2, F.transform("vector", lambda x, i: F.when(i == 3, F.lit(float("nan"))).otherwise(x))).otherwise(F.col("vector"))
    out = cat.validate_fingerprints(c.fingerprints.withColumn("vector", broken))
    return out.select("track_id", F.array_join("reasons", ",").alias("reasons"))


@query("q_validate_embeddings", sql="""
SELECT track_id, array_to_string(list_filter([CASE WHEN len(embedding) <> 64 THEN 'length' END,
  CASE WHEN len(list_filter(embedding, lambda x: abs(x * 3) > 127)) > 0 THEN 'range' END,
  CASE WHEN len(list_filter(embedding, lambda x: x <> 0)) = 0 THEN 'zero' END, CASE WHEN len(mood_scores) <> 8 THEN 'mood length' END,
  CASE WHEN len(list_filter(mood_scores, lambda x: abs(x * 4) > 1)) > 0 THEN 'mood values' END], lambda r: r IS NOT NULL), ',') AS reasons FROM learned""")
def q_validate_embeddings(c):
    scaled = c.learned.withColumns({"embedding": F.transform("embedding", lambda x: x * 3),
                                    "mood_scores": F.transform("mood_scores", lambda x: x * 4)})
    return cat.validate_embeddings(scaled, 64).select("track_id", F.array_join("reasons", ",").alias("reasons"))


@query("q_constraints", sql="""
SELECT 'event_type' AS rule, count(*) FILTER (event_type NOT IN ('selected','preview_started','preview_completed','youtube_opened','liked','disliked','dismissed')) AS violations FROM interactions
UNION ALL SELECT 'mode', count(*) FILTER (mode NOT IN ('similar','rhythm','timbre','discover','personalized','transition')) FROM runs
UNION ALL SELECT 'score', count(*) FILTER (NOT score BETWEEN 0 AND 1) FROM items UNION ALL SELECT 'rank', count(*) FILTER (rank <= 0) FROM items
UNION ALL SELECT 'sentiment', count(*) FILTER (NOT sentiment BETWEEN -1 AND 1) FROM lyr UNION ALL SELECT 'arousal', count(*) FILTER (NOT arousal BETWEEN 0 AND 1) FROM lyr
UNION ALL SELECT 'confidence', count(*) FILTER (NOT confidence BETWEEN 0 AND 1) FROM lyr UNION ALL SELECT 'duration', count(*) FILTER (duration_ms < 0) FROM tracks
UNION ALL SELECT 'orphan_item', count(*) FROM items WHERE run_id NOT IN (SELECT id FROM runs)
UNION ALL SELECT 'orphan_interaction', count(*) FROM interactions WHERE track_id NOT IN (SELECT track_id FROM tracks)
UNION ALL SELECT 'orphan_lyrics', count(*) FROM lyr WHERE track_id NOT IN (SELECT track_id FROM tracks)""")
def q_constraints(c):
    return cat.constraint_violations(c.tracks, c.interactions, c.runs, c.items, c.lyric_features)
