"""Driver tables read as the domain tables of the data model (views only, no data generation).

Each view is one SELECT that Spark and DuckDB both accept; where the two engines
spell something differently a small dialect object fills it in.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from tonearm.functions import bands
from tonearm.operators import lyrics as lyric_jobs
from tonearm.schemas import THEME_POOLS
from tonearm.session import materialize

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()

GENRES = [("Metal", "nu metal"), ("Metal", "alternative metal"), ("Metal", "heavy metal"),
          ("Alternative", "alternative rock"), ("Alternative", "indie rock"), ("Punk", "pop punk"), ("Pop", "pop"),
          ("Electronic", "house"), ("Hip-Hop/Rap", "hip-hop"), ("R&B/Soul", "r&b")]

# check vocabulary: words that occur in the driver's documents
CHECK_VOCABULARY = [
    ("the", "theme", "love"), ("of", "theme", "loss"), ("and", "theme", "hope"), ("to", "theme", "anger"),
    ("in", "theme", "nostalgia"), ("is", "positive", None), ("it", "positive", None), ("that", "negative", None),
    ("was", "negative", None), ("for", "arousal", None), ("with", "arousal", None),
]
CHECK_THEMES = ["love", "loss", "hope", "anger", "nostalgia"]


class Dialect:
    def __init__(self, engine: str):
        self.spark = engine == "spark"

    def e(self, i: int) -> str:
        """1-based element of the embedding as a double."""
        return f"CAST(e.embedding[{i - 1 if self.spark else i}] AS DOUBLE)"

    def u(self, i: int) -> str:
        one = "CAST(1 AS DOUBLE)"
        return f"((greatest(least(4 * {self.e(i)}, {one}), -{one}) + 1) / 2)"

    def array(self, items) -> str:
        body = ", ".join(items)
        return f"array({body})" if self.spark else f"[{body}]"

    def prop(self) -> str:
        path = "get_json_object(props, '$.k')" if self.spark else "json_extract_string(props, '$.k')"
        return f"CAST({path} AS INT)"


def _case(key: str, values) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def tracks_sql(d: Dialect) -> str:
    return f"""
SELECT 'apple-' || p_partkey AS track_id,
  p_name || CASE p_partkey % 7 WHEN 0 THEN ' - Remastered 2011' WHEN 1 THEN ' (From "Guru")'
    WHEN 2 THEN ' (Radio Edit)' ELSE '' END AS title,
  'Artist ' || regexp_extract(p_brand, '([0-9]+)', 1)
    || CASE WHEN p_partkey % 9 = 0 THEN ' feat. Artist ' || (p_partkey % 25 + 1) ELSE '' END AS artist,
  p_type || CASE p_partkey % 11 WHEN 0 THEN ' goodbye' WHEN 1 THEN ' party' ELSE '' END AS album,
  {_case('g', [a for a, _ in GENRES])} AS provider_genre,
  {_case('g', [b for _, b in GENRES])} AS provider_subgenre,
  {_case('p_partkey % 3', ['metal', 'indie', 'pop'])} AS seed_genre,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE 1970 + p_size END AS year,
  CAST(100 * p_retailprice AS INT) AS duration_ms,
  'https://example.test/art/' || p_partkey || '/100x100bb.jpg' AS artwork_url,
  'https://example.test/song/' || p_partkey AS external_url,
  CASE WHEN p_size % 5 = 0 THEN NULL ELSE 'Provider' END AS source,
  CASE WHEN p_partkey % 20 = 19 THEN NULL ELSE 'https://example.test/' || p_partkey || '.m4a' END AS preview_url,
  {_case('p_partkey % 10', THEME_POOLS)} AS theme_pool
FROM (SELECT p.*, CASE WHEN e.label IS NULL THEN p_partkey % 10 ELSE e.label END AS g
      FROM part p LEFT JOIN embeddings e ON p.p_partkey = e.vec_id)"""


def raw_fingerprints_sql(d: Dialect) -> str:
    """Vector and raw profile numbers; bands are added by the band operator."""
    u = d.u
    chroma_sum = "(" + " + ".join(u(i) for i in range(24, 36)) + " + 1e-10)"
    vector = [f"60 + 120 * {u(1)}", f"100 * {u(2)}", u(3), u(4), f"5000 * {u(5)}", f"10000 * {u(6)}", u(7),
              f"0.25 * {u(8)}", f"0.25 * {u(9)}", u(10), f"-400 + 300 * {u(11)}"]
    vector += [f"60 * ({u(i)} - 0.5)" for i in range(12, 24)]
    vector += [f"{u(i)} / {chroma_sum}" for i in range(24, 36)]
    v = dict(enumerate(vector, 1))
    return f"""
SELECT 'apple-' || e.vec_id AS track_id, {d.array(f'CAST({x} AS DOUBLE)' for x in vector)} AS vector,
  CAST({v[1]} AS DOUBLE) AS bpm, CAST({v[2]} AS DOUBLE) AS energy, {v[3]} AS valence, {v[4]} AS brightness,
  CAST({v[5]} AS DOUBLE) AS spectral_centroid_hz, CAST({v[6]} AS DOUBLE) AS spectral_rolloff_hz,
  CAST({v[8]} AS DOUBLE) AS rms_energy, CAST({v[9]} AS DOUBLE) AS zero_crossing_rate, {v[10]} AS tempo_confidence,
  CAST(0.35 * {u(36)} AS DOUBLE) AS spectral_flatness, CAST(35 * {u(37)} AS DOUBLE) AS spectral_contrast,
  CAST(5 * {u(38)} AS DOUBLE) AS onset_density, {u(39)} AS beat_regularity, {u(40)} AS dynamic_range,
  {u(41)} AS harmonic_ratio, 1 - {u(41)} AS percussive_ratio, {u(42)} AS tonal_strength, {u(43)} AS danceability,
  {u(44)} AS aggression, CASE WHEN {u(45)} >= 0.5 THEN 'major' ELSE 'minor' END AS mode
FROM embeddings e JOIN part p ON p.p_partkey = e.vec_id"""


def learned_sql(d: Dialect) -> str:
    values = d.array(f"CAST(round(127 * {d.e(i)}) AS INT)" for i in range(1, 65))
    moods = d.array(d.e(i) for i in range(46, 54))
    # tracks without a learned row: the ones whose first component is large
    return f"""
SELECT 'apple-' || e.vec_id AS track_id, {values} AS embedding, {moods} AS mood_scores,
  CAST(30 AS DOUBLE) AS preview_seconds FROM embeddings e WHERE {d.e(1)} < 0.1"""


def interactions_sql(d: Dialect) -> str:
    return f"""
SELECT event_id, user_id, 'apple-' || {d.prop()} AS track_id,
  CASE event_type WHEN 'view' THEN 'preview_started' WHEN 'click' THEN 'selected' WHEN 'purchase' THEN 'liked'
    WHEN 'signup' THEN 'youtube_opened' WHEN 'error' THEN 'disliked' END AS event_type,
  CAST(CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN -2 WHEN 2 THEN -3 END AS DOUBLE) AS value, ts AS created_at
FROM events"""


FAVORITES_SQL = """
SELECT user_id, track_id, max(created_at) AS created_at FROM interactions WHERE event_type = 'liked'
GROUP BY user_id, track_id"""

RUNS_SQL = """
SELECT o_orderkey AS id, o_custkey % 150 AS user_id, 'apple-' || (o_orderkey % 200) AS anchor_track_id,
  CASE o_orderkey % 6 WHEN 0 THEN 'similar' WHEN 1 THEN 'rhythm' WHEN 2 THEN 'timbre' WHEN 3 THEN 'discover'
    WHEN 4 THEN 'personalized' ELSE 'transition' END AS mode, o_orderdate AS created_at FROM orders"""

ITEMS_SQL = """
SELECT l_orderkey AS run_id, 'apple-' || l_partkey AS track_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate,
    l_extendedprice) AS BIGINT) AS rank, 10 * l_discount AS score FROM lineitem"""

PLAYS_SQL = """
SELECT o_custkey AS user_id, 'apple-' || l_partkey AS track_id, sum(l_quantity) AS plays
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey"""


def frames_sql(d: Dialect) -> str:
    return f"""
SELECT track_id, frame_idx, 0.25 * frame_idx AS time, value / 2000 AS rms,
  2.5 * k / 99 AS high_ratio, 1.5 * (99 - k) / 99 AS low_ratio,
  2.5 * k / 99 * (value / 2000) AS high, 1.5 * (99 - k) / 99 * (value / 2000) AS low,
  CAST(1 + event_id % 12 AS DOUBLE) AS crest_raw, 0.25 * k / 99 AS zero_crossing_rate
FROM (SELECT user_id AS track_id, event_id, value, CAST({d.prop()} AS DOUBLE) AS k,
        CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS DOUBLE) AS frame_idx FROM events)"""


class Catalogue:
    """Lazy access to the domain tables of one data folder."""

    _open: dict = {}

    @classmethod
    def of(cls, spark: SparkSession, folder: str) -> "Catalogue":
        """One instance per application and folder, so written intermediates are shared."""
        key = (spark.sparkContext.applicationId, id(spark), folder)
        if key not in cls._open:
            cls._open[key] = cls(spark, folder)
        return cls._open[key]

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._d = spark, folder, Dialect("spark")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _sql(self, statement: str, **frames: DataFrame) -> DataFrame:
        for name, frame in frames.items():
            statement = _replace_table(statement, name)
        return self.spark.sql(statement, **frames)

    @cached_property
    def tracks(self) -> DataFrame:
        return self._sql(tracks_sql(self._d), part=self.raw("part"), embeddings=self.raw("embeddings"))

    @cached_property
    def measures(self) -> DataFrame:
        return self._sql(raw_fingerprints_sql(self._d), part=self.raw("part"), embeddings=self.raw("embeddings"))

    @cached_property
    def fingerprints(self) -> DataFrame:
        raw = self.measures.withColumn("key", bands.key_name(F.slice("vector", 24, 12)))
        banded = raw.withColumns(bands.bands(F.col))
        banded = banded.withColumns({"timbre": F.col("texture"), "analysis_source": F.lit("catalogue")})
        from tonearm.schemas import PROFILE
        # stored once, like the fingerprint table it stands for
        return materialize(banded.select("track_id", "vector", F.struct(*PROFILE.fieldNames()).alias("profile"),
                                         "acoustic_signature"))

    @cached_property
    def lyric_texts(self) -> DataFrame:
        return self.raw("documents").select(F.concat(F.lit("apple-"), "doc_id").alias("track_id"), "text",
                                            F.col("lang").alias("language"))

    @cached_property
    def vocabulary(self) -> DataFrame:
        return self.spark.createDataFrame(CHECK_VOCABULARY, "word string, kind string, theme string")

    @cached_property
    def lyric_features(self) -> DataFrame:
        return materialize(lyric_jobs.lyric_features(self.lyric_texts, self.vocabulary, CHECK_THEMES))

    @cached_property
    def learned(self) -> DataFrame:
        return self._sql(learned_sql(self._d), embeddings=self.raw("embeddings"))

    @cached_property
    def interactions(self) -> DataFrame:
        return self._sql(interactions_sql(self._d), events=self.raw("events"))

    @cached_property
    def favorites(self) -> DataFrame:
        return self._sql(FAVORITES_SQL, interactions=self.interactions)

    @cached_property
    def runs(self) -> DataFrame:
        return self._sql(RUNS_SQL, orders=self.raw("orders"))

    @cached_property
    def items(self) -> DataFrame:
        return self._sql(ITEMS_SQL, lineitem=self.raw("lineitem"))

    @cached_property
    def plays(self) -> DataFrame:
        return self._sql(PLAYS_SQL, lineitem=self.raw("lineitem"), orders=self.raw("orders"))

    @cached_property
    def frames(self) -> DataFrame:
        return self._sql(frames_sql(self._d), events=self.raw("events"))

    @cached_property
    def library(self) -> DataFrame:
        from tonearm.operators.library import library
        return library(self.fingerprints, self.tracks.drop("theme_pool"), self.lyric_features)

    @cached_property
    def prepared(self) -> DataFrame:
        """The prepared library, written once and shared by every query over this folder."""
        from tonearm.operators.library import prepare
        return materialize(prepare(self.library))

    @cached_property
    def blocks(self) -> DataFrame:
        """Candidate blocks of the prepared library, written once."""
        from tonearm.operators.recommend import candidate_blocks
        return materialize(candidate_blocks(self.prepared))

    @cached_property
    def text_index(self):
        """The inverted index of the catalogue's texts, written once."""
        from tonearm.operators.search import text_index
        return text_index(self.tracks)

    @cached_property
    def run_pairs(self) -> DataFrame:
        """Distinct (anchor, recommended track) pairs of the recorded runs."""
        return (self.runs.select(F.col("id").alias("run_id"), F.col("anchor_track_id").alias("anchor_id"))
                .join(self.items.select("run_id", "track_id"), "run_id")
                .select("anchor_id", "track_id").distinct())


def _replace_table(statement: str, name: str) -> str:
    import re
    return re.sub(rf"(FROM|JOIN)\s+{name}\b", rf"\1 {{{name}}}", statement)
