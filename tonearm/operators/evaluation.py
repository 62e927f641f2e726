"""Offline ranking metrics over recommendation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tonearm.functions.vectors import unit
from tonearm.session import broadcast_few, broadcast_if_small, materialize

#: Rows of lists whose sums one task holds on average, and the largest number of tasks.
LIST_TASK_ROWS, MOST_TASKS = 1 << 18, 20_000


def hits(recs: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """recs(anchor_id, track_id, rank) marked with ``hit`` within the first k."""
    marked = relevant.select("anchor_id", "track_id").distinct().withColumn("hit", F.lit(1.0))
    return (recs.filter(F.col("rank") <= k).join(marked, ["anchor_id", "track_id"], "left")
            .fillna(0.0, ["hit"]))


def list_metrics(recs: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """precision, recall and ndcg at k per anchor, from one pass over the hits."""
    marked = hits(recs, relevant, k)
    per = marked.groupBy("anchor_id").agg(
        F.sum("hit").alias("hits"), F.sum(F.col("hit") / F.log2(F.col("rank") + 1)).alias("dcg"))
    counts = relevant.groupBy("anchor_id").agg(F.count_distinct("track_id").alias("n_relevant"))
    out = per.join(counts, "anchor_id", "left").fillna(0, ["n_relevant"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int")), F.lit(0.0),
                        lambda s, i: s + F.lit(1.0) / F.log2(i + 1))
    return out.select(
        "anchor_id", (F.col("hits") / k).alias("precision"),
        F.when(F.col("n_relevant") > 0, F.col("hits") / F.col("n_relevant")).otherwise(F.lit(0.0)).alias("recall"),
        F.when(F.col("n_relevant") > 0, F.col("dcg") / ideal).otherwise(F.lit(0.0)).alias("ndcg"))


def coverage(recs: DataFrame, tracks: DataFrame) -> DataFrame:
    n = tracks.agg(F.count("*").alias("catalogue"))
    used = recs.agg(F.count_distinct("track_id").alias("recommended"))
    value = F.when(F.col("catalogue") > 0, F.col("recommended") / F.col("catalogue")).otherwise(F.lit(0.0))
    return used.crossJoin(F.broadcast(n)).withColumn("coverage", value)  # one row beside one row


def diversity(recs: DataFrame, vectors: DataFrame, dims: int) -> DataFrame:
    """1 - mean pairwise cosine inside each list, without pairing the list with itself.

    The sum over ordered pairs equals |sum of unit vectors|^2 minus the number of
    non-zero vectors, so one map-side combined sum per dimension serves lists of any size.
    """
    v = vectors.select("track_id", unit("vector").alias("u"))
    narrow = materialize(recs.select("anchor_id", "track_id"))
    # the sums of a list take far more room than its rows, so the number of rows decides the number of tasks
    tasks = min(max(-(-narrow.count() // LIST_TASK_ROWS), int(recs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), MOST_TASKS)
    few = broadcast_few(v, narrow, "track_id", 16 * dims)
    joined = narrow.repartition(tasks, "anchor_id").join(few, "track_id") if few is not None else narrow.join(v, "track_id").repartition(tasks, "anchor_id")
    nonzero = F.when(F.exists("u", lambda x: x != 0), 1.0).otherwise(0.0)
    sums = joined.groupBy("anchor_id").agg(
        F.count("*").alias("n"), F.sum(nonzero).alias("m"), *[F.sum(F.get("u", F.lit(i))).alias(f"s{i}") for i in range(dims)])
    square = sum((F.col(f"s{i}") * F.col(f"s{i}") for i in range(1, dims)), F.col("s0") * F.col("s0"))
    mean = (square - F.col("m")) / (F.col("n") * (F.col("n") - 1))
    return sums.select("anchor_id", F.when(F.col("n") < 2, F.lit(0.0)).otherwise(F.round(1 - mean, 4)).alias("diversity"))


def relevance(tracks: DataFrame, anchors: DataFrame, n: int = 50) -> DataFrame:
    """First n catalogue rows that share the genre or the theme of each anchor.

    tracks(track_id, genre, theme, position).  Each label keeps only its first n+1 rows before
    any join: an anchor's first n come from the first n+1 of its genre and of its theme.
    """
    keep = lambda label: (tracks.withColumn("_n", F.row_number().over(W.partitionBy(label).orderBy("position")))
                          .filter(F.col("_n") <= n + 1).select(F.col(label).alias("_label"), "track_id", "position"))
    # anchors with the same labels have the same first rows but for themselves: these lists are made once and shared
    asked = anchors.filter(F.col("track_id").isNotNull()).groupBy(F.col("track_id").alias("anchor_id")).agg(
        F.sort_array(F.collect_set("genre")).alias("genres"), F.sort_array(F.collect_set("theme")).alias("themes"))
    asked = materialize(asked)
    labels = asked.select("genres", "themes").distinct()
    row = F.struct("position", "track_id")
    listed = lambda held, label: labels.withColumn("_label", F.explode(held)).join(keep(label), "_label").select("genres", "themes", row.alias("row"))
    lists = materialize(listed("genres", "genre").union(listed("themes", "theme")).filter("row.track_id is not null").groupBy("genres", "themes").agg(
        F.sort_array(F.collect_set("row")).alias("rows")))  # at most n + 1 rows of each label
    lists = broadcast_if_small(lists, 200 * (n + 1))
    others = F.slice(F.filter("rows", lambda x: x["track_id"] != F.col("anchor_id")), 1, n)
    ranked = asked.join(lists, ["genres", "themes"]).select("anchor_id", F.posexplode(others).alias("place", "row"))
    return ranked.select("anchor_id", "row.track_id", "row.position", (F.col("place") + 1).alias("rank"))


def evaluate(recs: DataFrame, relevant: DataFrame, tracks: DataFrame, vectors: DataFrame, dims: int, k: int,
             sample_size: int | None = None, seed: int = 42) -> DataFrame:
    """Mean metrics over a seeded sample of anchors (all anchors when no size is given)."""
    if sample_size is not None:
        chosen = (recs.select("anchor_id").distinct()
                  .orderBy(F.sha2(F.concat(F.lit(str(seed)), "anchor_id"), 256)).limit(sample_size))
        recs = recs.join(chosen, "anchor_id", "left_semi")
    top = recs.filter(F.col("rank") <= k)
    per = list_metrics(recs, relevant, k).join(diversity(top, vectors, dims), "anchor_id", "left")
    means = per.agg(*[F.round(F.avg(m), 4).alias(m) for m in ("precision", "recall", "ndcg", "diversity")],
                    F.count("*").alias("n_evaluated"))
    return means.crossJoin(F.broadcast(coverage(top, tracks).select(F.round("coverage", 4).alias("coverage"))))
