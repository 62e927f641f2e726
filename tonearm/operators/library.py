"""Library load and the prepared (flat, score-ready) form every recommender reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tonearm.functions import acoustic, style, text
from tonearm.functions.vectors import unit
from tonearm.schemas import KEY_NAMES, PROFILE_NUMERIC
from tonearm.session import broadcast_few, materialize

NUMERIC = [n for n in PROFILE_NUMERIC if not n.startswith("spectral_centroid") and not n.startswith("spectral_rolloff")]


def library(fingerprints: DataFrame, tracks: DataFrame, lyrics: DataFrame | None = None) -> DataFrame:
    """Fingerprints that have a track, with lyric features where present."""
    out = fingerprints.join(tracks, "track_id", "inner")
    if lyrics is None:
        return out.withColumns({
            "language": F.lit(None).cast("string"), "instrumental": F.lit(None).cast("boolean"),
            "themes": F.lit(None).cast("array<string>"), "theme_vector": F.lit(None).cast("map<string,double>"),
            "sentiment": F.lit(None).cast("double"), "arousal": F.lit(None).cast("double"),
            "confidence": F.lit(None).cast("double")})
    keep = ["track_id", "language", "instrumental", "themes", "theme_vector", "sentiment", "arousal", "confidence"]
    return out.join(lyrics.select(*keep), "track_id", "left")


def prepare(lib: DataFrame, dialect: str = "hosted", ignore=()) -> DataFrame:
    """Flatten and pre-compute everything a pair score needs, once per track."""
    p, v = F.col("profile"), F.col("vector")
    zero = F.lit(0.0)
    cols = {n: F.coalesce(p[n], F.lit(0.5) if n == "tempo_confidence" else zero) for n in NUMERIC}
    keys = F.array(*[F.lit(k) for k in KEY_NAMES])
    has_lyrics = (F.coalesce(F.col("confidence"), zero) > 0) & ~F.coalesce(F.col("instrumental"), F.lit(False))
    cols.update({
        "valence": F.coalesce(v[2], zero),
        "mfcc": F.slice(v, 11, 13),
        "chroma_unit": unit(F.slice(v, 24, 12)),
        "key": F.coalesce(p["key"], F.lit("")),
        "mode": F.coalesce(p["mode"], F.lit("")),
        "key_no": (F.array_position(keys, F.coalesce(p["key"], F.lit(""))) - 1).cast("int"),
        "intensity": p["intensity"], "rhythm_character": p["rhythm_character"], "tempo_band": p["tempo_band"],
        "texture": p["texture"],
        "live": F.coalesce(p["analysis_source"] == acoustic.LIVE, F.lit(False)),
        "identity": text.recording_identity("title", "artist", dialect),
        "artist_key": text.clean("artist"),
        "primary": style.primary_genre(dialect, ignore),
        "sub": style.sub_genre(dialect),
        "style": text.clean("provider_subgenre"),
        "mood": style.title_mood("title", "album"),
        "playable": F.coalesce(F.col("preview_url"), F.lit("")) != "",
        "id_hash": text.stable_hash("track_id", dialect),
        "has_lyrics": has_lyrics,
        "theme_vector": F.coalesce(F.col("theme_vector"), F.create_map().cast("map<string,double>")),
        "language": F.coalesce(F.col("language"), F.lit("")),
        "sentiment": F.col("sentiment"), "arousal": F.col("arousal"),
    })
    out = lib.select("track_id", "title", "artist", "preview_url", "acoustic_signature",
                     *[c.alias(n) for n, c in cols.items()])
    squares = F.aggregate(F.map_values("theme_vector"), zero, lambda s, x: s + x * x)
    return out.withColumn("theme_sq", squares)


def prefixed(df: DataFrame, prefix: str, columns=None) -> DataFrame:
    columns = columns or df.columns
    return df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in columns])


#: A generous size of one prepared row.
PREPARED_BYTES = 4096


def pair_up(pairs: DataFrame, prepared: DataFrame, sides=(("anchor_id", "a"), ("track_id", "b"))) -> DataFrame:
    """Attach prepared columns to each id column of a pair table.

    A side of few ids is broadcast, after the others: then the pairs are shuffled while
    they are narrow and no wide row travels with each of them.
    """
    pairs = materialize(pairs)
    out, small = pairs, []
    for id_column, prefix in sides:
        key = f"{prefix}_track_id"
        right = prefixed(prepared, prefix)
        few = broadcast_few(right, pairs.select(F.col(id_column).alias(key)), key, PREPARED_BYTES)
        if few is None:
            out = out.join(right, F.col(id_column) == F.col(key), "inner")
        else:
            small.append((few, F.col(id_column) == F.col(key)))
    for few, same in small:
        out = out.join(few, same, "inner")
    return out.select(*pairs.columns, *[f"{prefix}_{c}" for _, prefix in sides for c in prepared.columns])
