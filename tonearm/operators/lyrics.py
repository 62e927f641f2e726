"""Lyric feature jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tonearm.functions.vectors import clip
from tonearm.limits import MAX_LIST, within
from tonearm.session import broadcast_if_small

WORD = r"([\p{L}\p{N}']+)"
#: Words of a vocabulary up to which texts are filtered before they are cut into rows.
FILTER_WORDS = 10_000


def lyric_features(texts: DataFrame, vocabulary: DataFrame, themes: list[str]) -> DataFrame:
    """Theme counts, sentiment, arousal and confidence of each text.

    texts(track_id, text, language), one row per track; vocabulary(word, kind, theme).
    The whole text is cut into words once.  Words that a small vocabulary does not have are
    dropped inside the row; a large one is joined to all of them.  The number of words travels
    with each word left, and all counts are combined map-side before the one shuffle.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col("text"), F.lit(""))), F.lit(WORD), F.lit(1))
    cut = texts.select("track_id", "language", words.alias("all"))
    listed = [r["word"] for r in vocabulary.select("word").distinct().limit(FILTER_WORDS + 1).collect()]
    kept = F.filter("all", lambda w: w.isin(listed)) if len(listed) <= FILTER_WORDS else F.col("all")
    tokens = cut.select("track_id", "language", F.size("all").cast("double").alias("words"), F.explode_outer(kept).alias("word"))
    known = tokens.join(broadcast_if_small(vocabulary, 256), "word", "left")
    total = lambda kind: F.count_if(F.col("kind") == kind).cast("double").alias(kind)
    theme_counts = [F.count_if((F.col("kind") == "theme") & (F.col("theme") == t)).cast("double").alias(f"t{i}")
                    for i, t in enumerate(themes)]
    names = [f"t{i}" for i in range(len(themes))]
    out = known.groupBy("track_id").agg(F.max("language").alias("language"), F.max("words").alias("words"),
                                        total("positive"), total("negative"), total("arousal"), *theme_counts)

    top = F.greatest(F.lit(1.0), *[F.col(n) for n in names])
    listed = F.array(*[F.struct(F.col(n).alias("n"), F.lit(-i).alias("o"), F.lit(t).alias("t"))
                       for i, (n, t) in enumerate(zip(names, themes))])
    ranked = F.sort_array(F.filter(listed, lambda x: x["n"] > 0), asc=False)
    emotional = F.col("positive") + F.col("negative")
    out = out.withColumn("themes", F.transform(F.slice(ranked, 1, 4), lambda x: x["t"]))
    return out.select(
        "track_id", "language", (F.col("words") < 8).alias("instrumental"), "themes",
        F.map_from_arrays(F.array(*[F.lit(t) for t in themes]),
                          F.array(*[F.round(F.col(n) / top, 4) for n in names])).alias("theme_vector"),
        F.when(emotional > 0, clip((F.col("positive") - F.col("negative")) / emotional, -1.0, 1.0))
        .otherwise(F.lit(0.0)).alias("sentiment"),
        clip(F.col("arousal") / F.greatest(F.lit(8.0), F.col("words") * 0.035)).alias("arousal"),
        clip(0.45 + F.col("words") / 900 + F.size("themes") * 0.06, 0.25, 0.95).alias("confidence"),
    )


def lyric_backlog(tracks: DataFrame, analysed: DataFrame, limit: int = 10) -> DataFrame:
    """First tracks by id that have no lyric features yet; a batch has at most 50."""
    return (tracks.select("track_id", "title", "artist").join(analysed.select("track_id"), "track_id", "left_anti")
            .orderBy("track_id").limit(within(limit, MAX_LIST, "limit")))


def run_summary(results: DataFrame) -> DataFrame:
    """processed / analysed / other outcomes of one enrichment run."""
    status = lambda s: F.count_if(F.col("status") == s)
    return results.agg(
        F.count("*").alias("processed"), status("analyzed").alias("analyzed"), status("not-found").alias("not_found"),
        status("no-lyrics").alias("no_lyrics"), status("error").alias("errors"))
