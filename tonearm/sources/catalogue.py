"""Readers, payload normalisers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tonearm import schemas

REQUIRED_TRAINING = ["track_id", "title", "artist", "genre", "year", "primary_theme_pool", "vader_sentiment", "arousal"]


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet, JSON or CSV by extension; CSV and JSON always with a declared schema."""
    if path.rstrip("/").endswith((".csv", ".csv.gz")):
        return spark.read.csv(path, header=True, schema=schema, enforceSchema=False)
    if path.rstrip("/").endswith((".json", ".json.gz", ".jsonl")):
        return spark.read.schema(schema).json(path) if schema else spark.read.json(path)
    return spark.read.parquet(path)


def read_catalogue(spark: SparkSession, path: str, **taxonomy) -> DataFrame:
    """Catalogue scan; the sub-genre is inferred when the column is missing.

    A CSV file may lack columns or have them in another order: its header names them.
    """
    schema = None
    if path.rstrip("/").endswith((".csv", ".csv.gz")):
        kinds = {f.name: f for f in schemas.TRACKS}
        names = spark.read.csv(path, header=True, inferSchema=False).columns
        schema = T.StructType([kinds.get(n, T.StructField(n, T.StringType())) for n in names])
    df = read_table(spark, path, schema)
    df = df.withColumn("track_id", F.col("track_id").cast("string"))
    if "provider_subgenre" in df.columns:
        return df
    from tonearm.operators.catalogue import infer_subgenre
    styles = infer_subgenre(df, **taxonomy).select("track_id", F.col("subgenre").alias("provider_subgenre"))
    return df.join(styles, "track_id", "left")


def missing_columns(df: DataFrame, required=REQUIRED_TRAINING) -> list[str]:
    return [c for c in required if c not in df.columns]


def read_training(df: DataFrame, required=REQUIRED_TRAINING) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"dataset is missing required columns: {missing}")
    return df


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: nulls and distinct values, from one pass over the data."""
    aggs = [F.count("*").alias("rows")]
    for c in columns:
        aggs += [F.count_if(F.col(c).isNull()).alias(f"n_{c}"), F.count_distinct(c).alias(f"d_{c}")]
    one = df.agg(*aggs)
    stacked = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("nulls"),
                                 F.col(f"d_{c}").alias("distinct")) for c in columns])
    return one.select("rows", F.explode(stacked).alias("p")).select("rows", "p.*")


def year_of(text) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"^(\d{4})", 1).try_cast("int")


PROVIDER = T.StructType([T.StructField(n, T.StringType()) for n in (
    "trackId", "trackName", "artistName", "trackViewUrl", "releaseDate", "primaryGenreName", "previewUrl",
    "collectionName", "artworkUrl100", "trackTimeMillis")])


def normalize_provider(payloads: DataFrame, column: str = "payload", seed: str | None = None, prefix: str = "apple-",
                       require_preview: bool = False, source: str = "Apple Music") -> DataFrame:
    """Store payload rows -> track rows; rows without id, title, artist or url are dropped."""
    p = F.from_json(F.col(column), PROVIDER)
    rest = [c for c in payloads.columns if c != column]
    rows = payloads.select(*rest, p.alias("p"))
    needed = ["trackId", "trackName", "artistName", "trackViewUrl"] + (["previewUrl"] if require_preview else [])
    for name in needed:
        rows = rows.filter(F.coalesce(F.col(f"p.{name}"), F.lit("")) != "")
    genre = F.coalesce(F.col("p.primaryGenreName"), F.lit(seed))
    return rows.select(
        *rest, F.concat(F.lit(prefix), F.col("p.trackId")).alias("track_id"), F.col("p.trackName").alias("title"),
        F.col("p.artistName").alias("artist"), F.coalesce(F.col("p.collectionName"), F.lit("")).alias("album"),
        year_of(F.col("p.releaseDate")).alias("year"), F.col("p.trackTimeMillis").try_cast("int").alias("duration_ms"),
        F.coalesce(F.col("p.artworkUrl100"), F.lit("")).alias("artwork_url"),
        F.coalesce(F.col("p.previewUrl"), F.lit("")).alias("preview_url"), F.col("p.trackViewUrl").alias("external_url"),
        genre.alias("provider_genre"), genre.alias("provider_subgenre"), F.lit(seed).cast("string").alias("seed_genre"),
        F.lit(source).alias("source"))


RECORDING = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("length", T.LongType()),
    T.StructField("artist-credit", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()), T.StructField("joinphrase", T.StringType()),
        T.StructField("artist", T.StructType([T.StructField("name", T.StringType())]))]))),
    T.StructField("releases", T.ArrayType(T.StructType([
        T.StructField("title", T.StringType()), T.StructField("date", T.StringType())]))),
    T.StructField("first-release-date", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()), T.StructField("count", T.LongType())]))),
])


def normalize_recordings(payloads: DataFrame, column: str = "payload", prefix: str = "mb-", source: str = "MusicBrainz",
                         page: str = "https://musicbrainz.org/recording/") -> DataFrame:
    """Open-database recordings -> track rows (joined credit, first release, most counted tag)."""
    rest = [c for c in payloads.columns if c != column]
    rows = payloads.select(*rest, F.from_json(F.col(column), RECORDING).alias("p"))
    empty = F.lit("")
    credit = F.array_join(F.transform("p.artist-credit", lambda x: F.concat(
        F.coalesce(x["name"], x["artist"]["name"], empty), F.coalesce(x["joinphrase"], empty))), "")
    release = F.try_element_at("p.releases", F.lit(1))
    best = F.reduce("p.tags", F.struct(F.lit(-1).cast("bigint").alias("count"), F.lit(None).cast("string").alias("name")),
                    lambda acc, t: F.when(F.coalesce(t["count"], F.lit(0)) > acc["count"], F.struct(
                        F.coalesce(t["count"], F.lit(0)).cast("bigint").alias("count"), t["name"].alias("name"))).otherwise(acc))
    tag = best["name"]
    rows = rows.select(
        *rest, F.concat(F.lit(prefix), F.col("p.id")).alias("track_id"),
        F.trim(F.coalesce("p.title", empty)).alias("title"), F.trim(F.coalesce(credit, empty)).alias("artist"),
        F.coalesce(release["title"], empty).alias("album"),
        year_of(F.coalesce(release["date"], F.col("p.first-release-date"))).alias("year"),
        F.col("p.length").cast("int").alias("duration_ms"), F.concat(F.lit(page), F.col("p.id")).alias("external_url"),
        F.lit(source).alias("source"), tag.alias("provider_genre"), tag.alias("provider_subgenre"))
    return rows.filter((F.col("title") != "") & (F.col("artist") != "") & F.col("track_id").isNotNull())


def parse_fingerprints(df: DataFrame) -> DataFrame:
    """JSON vector and profile columns -> typed columns."""
    return df.select(
        "track_id", F.from_json("vector", "array<double>").alias("vector"),
        F.from_json("profile", schemas.PROFILE).alias("profile"), "acoustic_signature")


def micros(values) -> Column:
    """Engine-independent text of a numeric vector (six decimals)."""
    return F.array_join(F.transform(values, lambda v: F.round(v * 1e6).cast("bigint").cast("string")), ",")


def content_version(df: DataFrame, text: Column) -> DataFrame:
    """Order-free content hash: one row (rows, version).

    The 256-bit row hashes are added up in eight 32-bit words, so every bit of every row counts.
    The sums combine map-side, nothing is gathered.
    """
    digest = df.select(F.sha2(text, 256).alias("h"))
    words = [F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(8)]
    sums = digest.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(w), F.lit(0)).alias(f"w{i}") for i, w in enumerate(words)))
    return sums.select(F.col("n").alias("rows"), F.substring(F.sha2(F.concat_ws(
        "-", *[F.col(c).cast("string") for c in ("n", *(f"w{i}" for i in range(8)))]), 256), 1, 16).alias("version"))


EXPORT_FIELDS = ["track_id", "title", "artist", "album", "artwork_url", "external_url", "source", "preview_url",
                 "seed_genre", "provider_genre", "provider_subgenre", "year"]


def export_rows(tracks: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Public rows: whitelisted track and profile fields; only 35-value vectors that have a track."""
    valid = fingerprints.filter(F.size("vector") == schemas.VECTOR_SIZE)
    profile = F.struct(*[F.col(f"profile.{f}").alias(f) for f in schemas.PROFILE.fieldNames()])
    return (valid.select("track_id", "vector", profile.alias("profile"), "acoustic_signature")
            .join(tracks.select("track_id"), "track_id", "left_semi"))


def export_manifest(tracks: DataFrame, fingerprints: DataFrame) -> DataFrame:
    rows = export_rows(tracks, fingerprints)
    body = F.concat_ws("|", "track_id", "acoustic_signature", micros("vector"))
    return (content_version(rows, body).withColumnRenamed("rows", "indexed")
            .crossJoin(F.broadcast(tracks.agg(F.count("*").alias("total")))))  # one row beside one row


def export_catalogue(tracks: DataFrame, fingerprints: DataFrame, path: str) -> DataFrame:
    """Write the snapshot as gzip JSON and return its one-row manifest."""
    tracks.select(*[c for c in EXPORT_FIELDS if c in tracks.columns]).write.mode("overwrite").json(
        f"{path}/tracks", compression="gzip")
    export_rows(tracks, fingerprints).write.mode("overwrite").json(f"{path}/fingerprints", compression="gzip")
    return export_manifest(tracks, fingerprints)


def export_index(index: DataFrame, tracks: DataFrame, path: str, model: str, revision: str) -> DataFrame:
    """Write the rows of a learned index that have a track as gzip JSON and return their one-row manifest."""
    rows = index.join(tracks.select("track_id").distinct(), "track_id", "left_semi")
    rows.select("track_id", "embedding", "mood_scores", "preview_seconds").write.mode("overwrite").json(f"{path}/index", compression="gzip")
    return index_manifest(rows, tracks, model, revision)


INDEX = "track_id string, embedding array<int>, mood_scores array<double>, preview_seconds double"


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Rows that ``export_index`` wrote."""
    return spark.read.schema(INDEX).json(f"{path}/index")


def index_manifest(index: DataFrame, tracks: DataFrame, model: str, revision: str) -> DataFrame:
    """indexed / total / failed counts of a learned index."""
    known = tracks.select("track_id").distinct().join(
        index.select("track_id").distinct().withColumn("hit", F.lit(1)), "track_id", "left")
    wanted = tracks.filter(F.coalesce(F.col("preview_url"), F.lit("")) != "")
    failed = wanted.join(index, "track_id", "left_anti").agg(F.count("*").alias("failed"))
    return (known.agg(F.count("hit").alias("indexed"), F.count("*").alias("total")).crossJoin(F.broadcast(failed))
            .withColumns({"model": F.lit(model), "revision": F.lit(revision)}))


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> DataFrame:
    """Write parquet (optionally partitioned) and return the stored table."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.parquet(path)
