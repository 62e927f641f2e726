"""Listener tables: favourites, history, seen ids, taste, feedback, bounded lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tonearm import schemas
from tonearm.operators.catalogue import first_by, last_by

FEEDBACK = [(2.0, "more_like_this"), (-2.0, "too_sad"), (-3.0, "too_different")]  # fixed values
LIMITS = {"favorites": 100, "history": 30, "interactions": 100}  # fixed values


def newest(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The n newest rows per key with their position.  row_number <= n is pushed before the shuffle."""
    ranked = df.withColumn("position", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("position") <= n)


def update_favorites(favorites: DataFrame, added: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Upsert by (user, track) keeping the newest row, then drop removals."""
    out = last_by(favorites.unionByName(added), ["user_id", "track_id"], ["created_at"])
    return out if removed is None else out.join(removed.select("user_id", "track_id"), ["user_id", "track_id"], "left_anti")


def over_limit(favorites: DataFrame, limit: int = LIMITS["favorites"]) -> DataFrame:
    """Users whose favourites exceed the limit (such a write is rejected)."""
    return favorites.groupBy("user_id").agg(F.count("*").alias("entries")).filter(F.col("entries") > limit)


def record_runs(recommendations: DataFrame, tracks: DataFrame, weights: dict[str, dict]) -> tuple[DataFrame, DataFrame]:
    """Split recommendation rows into runs and items; ``history`` reads both.

    recommendations(request_id, user_id, anchor_id, mode, created_at, track_id, rank, hybrid_score): every
    request is a run of its own, also if a listener repeats it.  ``weights``: component weights of each mode.
    """
    keys = ["request_id", "user_id", "anchor_id", "mode", "created_at"]
    shown = tracks.select("track_id", "title", "artist", F.col("provider_subgenre").alias("subgenre"))
    text = None
    for mode, parts in weights.items():
        json = F.to_json(F.create_map(*[F.lit(x) for kv in sorted(parts.items()) for x in kv]))
        text = F.when(F.col("mode") == mode, json) if text is None else text.when(F.col("mode") == mode, json)
    anchors = shown.select(F.col("track_id").alias("anchor_id"), F.col("title").alias("anchor_title"), F.col("artist").alias("anchor_artist"))
    runs = recommendations.select(*keys).distinct().join(anchors, "anchor_id", "left").select(
        F.col("request_id").alias("id"), "user_id", F.col("anchor_id").alias("anchor_track_id"), "anchor_title", "anchor_artist", "mode",
        "created_at", text.alias("weights"))
    items = recommendations.join(shown, "track_id", "left").select(
        F.col("request_id").alias("run_id"), "track_id", "title", "artist", "subgenre", F.col("rank").cast("bigint").alias("rank"),
        F.col("hybrid_score").alias("score"))
    return runs, items


def history(runs: DataFrame, items: DataFrame, n: int = 30, m: int = 12) -> DataFrame:
    """Latest n runs per user with their first m items nested in rank order."""
    latest = newest(runs, ["user_id"], [F.desc("created_at"), F.desc("id")], n)
    # ranks number the items of a run from 1, so the first m need no window: the filter reaches the scan
    top = items.filter(F.col("rank") <= m)
    nested = (top.join(latest.select(F.col("id").alias("run_id")), "run_id", "left_semi").groupBy("run_id")
              .agg(F.array_sort(F.collect_list(F.struct("rank", "track_id", "score"))).alias("suggestions")))
    return latest.join(nested, latest.id == nested.run_id, "left").drop("run_id")


def clear_history(users: DataFrame, runs: DataFrame, items: DataFrame, interactions: DataFrame):
    """Remove the runs (with their items) and interactions of the given users."""
    ids = users.select("user_id").distinct()
    kept = runs.join(ids, "user_id", "left_anti")
    gone = runs.join(ids, "user_id", "left_semi").select(F.col("id").alias("run_id"))
    return kept, items.join(gone, "run_id", "left_anti"), interactions.join(ids, "user_id", "left_anti")


def valid_interactions(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_type").isin(schemas.EVENT_TYPES) & F.col("track_id").isNotNull())


def append_interactions(events: DataFrame, path: str) -> None:
    valid_interactions(events).write.mode("append").parquet(path)


def seen(runs: DataFrame, items: DataFrame, interactions: DataFrame) -> DataFrame:
    """(user, track) pairs a listener has met: items of own runs and interactions."""
    own = runs.select(F.col("id").alias("run_id"), "user_id").join(items.select("run_id", "track_id"), "run_id")
    return own.select("user_id", "track_id").union(interactions.select("user_id", "track_id")).distinct()


def taste_rows(favorites: DataFrame, interactions: DataFrame) -> DataFrame:
    """Long form (user, track, liked, disliked), the shape joins use."""
    fav = favorites.select("user_id", "track_id", F.lit(True).alias("liked"), F.lit(False).alias("disliked"))
    acts = interactions.select(
        "user_id", "track_id", F.col("event_type").isin(schemas.POSITIVE_EVENTS).alias("liked"),
        F.col("event_type").isin(schemas.NEGATIVE_EVENTS).alias("disliked"))
    return fav.union(acts).groupBy("user_id", "track_id").agg(
        F.max("liked").alias("liked"), F.max("disliked").alias("disliked")).filter("liked OR disliked")


def taste(favorites: DataFrame, interactions: DataFrame, tracks: DataFrame, style: str = "provider_subgenre") -> DataFrame:
    """Per user: liked and disliked ids, sub-genres and artists of the favourites (sorted arrays).

    The arrays are what a single request needs; joins over many users use ``taste_rows``.
    """
    rows = taste_rows(favorites, interactions)
    named = favorites.join(tracks.select("track_id", F.lower(style).alias("s"), F.lower("artist").alias("a")), "track_id")
    labels = named.groupBy("user_id").agg(F.array_sort(F.collect_set("s")).alias("subgenres"),
                                          F.array_sort(F.collect_set("a")).alias("artists"))
    ids = rows.groupBy("user_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("liked"), F.col("track_id")))).alias("track_ids"),
        F.array_sort(F.collect_set(F.when(F.col("disliked"), F.col("track_id")))).alias("disliked_track_ids"))
    return ids.join(labels, "user_id", "left")


def decode_feedback(value: Column) -> Column:
    out = None
    for number, reason in FEEDBACK:
        out = F.when(value == number, reason) if out is None else out.when(value == number, reason)
    return out


def combined_feedback(local: DataFrame, interactions: DataFrame, limit: int = 100) -> DataFrame:
    """Local feedback first, then decoded interactions; first per track wins; newest ``limit`` per user.

    local(user_id, track_id, reason, created_at, event_id).
    """
    cols = ["user_id", "track_id", "reason", "created_at", "event_id"]
    remote = interactions.withColumn("reason", decode_feedback(F.col("value"))).select(*cols)
    both = local.select(*cols).withColumn("source", F.lit(0)).unionByName(remote.withColumn("source", F.lit(1)))
    both = both.filter(F.col("reason").isNotNull()).withColumn(
        "age", F.struct("source", (-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("t"), (-F.col("event_id")).alias("e")))
    once = first_by(both, ["user_id", "track_id"], ["age"])
    return newest(once, ["user_id"], [F.asc("age")], limit).drop("age")


def bounded_list(df: DataFrame, keys: list[str], n: int, order=("created_at", "event_id")) -> DataFrame:
    """Newest row per (user, keys), then the newest n per user."""
    once = last_by(df, ["user_id", *keys], list(order))
    return newest(once, ["user_id"], [F.desc(o) for o in order], n)


def replace_key() -> Column:
    """A valued interaction replaces any valued one of its track, a plain one the same event type."""
    return F.when(F.col("value").isNotNull(), F.lit("#value")).otherwise(F.col("event_type"))


def preferences(favorites: DataFrame, interactions: DataFrame, hist: DataFrame) -> DataFrame:
    """Tagged long table of everything a personalised request reads."""
    fav = favorites.select("user_id", F.lit("favorite").alias("kind"), "track_id", F.lit(None).cast("string").alias("event_type"))
    acts = interactions.select("user_id", F.lit("interaction").alias("kind"), "track_id", "event_type")
    items = hist.select("user_id", F.lit("item").alias("kind"), F.explode("suggestions").alias("s")).select(
        "user_id", "kind", F.col("s.track_id").alias("track_id"), F.lit(None).cast("string").alias("event_type"))
    return fav.unionByName(acts).unionByName(items)
