"""Wide rows of a side with few ids are broadcast; the rows are those of the shuffled form."""

from pyspark.sql import functions as F

from tonearm.operators import frames as fr, learned as le, library as li
from tonearm.session import broadcast_few


def shuffled(monkeypatch, module):
    monkeypatch.setattr(module, "broadcast_few", lambda *args, **kwargs: None)


def key(rows):
    return sorted(map(str, rows))


def test_only_counted_small_sides_are_broadcast(spark):
    wide = spark.range(100).select(F.col("id").alias("k"), F.lit("x").alias("w"))
    asked = spark.createDataFrame([(1,), (1,), (2,), (None,), (500,)], "k bigint")
    few = broadcast_few(wide, asked, "k", 10, 20)
    assert sorted(r.k for r in few.collect()) == [1, 2]
    assert broadcast_few(wide, asked, "k", 10, 19) is None
    assert broadcast_few(wide.union(wide), asked, "k", 10, 39) is None  # rows count, not ids


def test_pair_up_broadcasts_the_few(spark, monkeypatch):
    prepared = spark.createDataFrame([("t1", 1.0), ("t2", 2.0), ("t2", 2.5), ("t3", 3.0)], "track_id string, bpm double")
    pairs = spark.createDataFrame([("t1", "t2"), ("t1", "t3"), ("t2", "t1"), (None, "t1"), ("t9", "t1"), ("t1", None)], "anchor_id string, track_id string")
    monkeypatch.setattr(li, "PREPARED_BYTES", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = li.pair_up(pairs, prepared)
        assert got.columns == ["anchor_id", "track_id", "a_track_id", "a_bpm", "b_track_id", "b_bpm"]
        assert got._jdf.queryExecution().toString().count("BroadcastHashJoin") >= 2
        rows = key(got.collect())
        shuffled(monkeypatch, li)
        assert rows == key(li.pair_up(pairs, prepared).collect()) and len(rows) == 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_learned_rerank_equals_the_shuffled_form(spark, monkeypatch):
    index = spark.createDataFrame([(f"t{i}", [i, 3 - i, 1], [0.1 * i, 0.2]) for i in range(4)], "track_id string, embedding array<int>, mood_scores array<double>")
    index = index.withColumn("mood_scores", F.concat("mood_scores", F.array_repeat(F.lit(0.1), 6)))
    scored = spark.createDataFrame([("t0", "t1", 0.5, "u", "t2"), ("t0", "t9", 0.6, "u", None), (None, "t2", 0.7, "v", "t1"), ("t3", "t2", 0.8, None, "t8")],
                                   "anchor_id string, track_id string, score double, user_id string, previous_id string")
    said = spark.createDataFrame([("u", "t1", "more_like_this", 1), ("u", "t3", "too_different", 2)], "user_id string, track_id string, reason string, position int")
    for rows in (scored, scored.drop("previous_id")):
        with monkeypatch.context() as m:
            few = key(le.learned_rerank(rows, index, "transition", said).collect())
            shuffled(m, le)
            assert few == key(le.learned_rerank(rows, index, "transition", said).collect()) and len(few) == 4


def test_plan_compatibility_equals_the_shuffled_form(spark, monkeypatch):
    names = ["bpm", "tempo_confidence", "beat_regularity", "energy", "brightness", "tonal_strength", "spectral_flatness"]
    profiles = spark.createDataFrame([(i, *[100.0 + i, 0.9, 0.8, 40.0 + i, 0.5, 0.4, 0.3], [float(j == i) for j in range(12)]) for i in range(3)],
                                     "track_id bigint, " + ", ".join(f"{n} double" for n in names) + ", chroma array<double>")
    bass = spark.createDataFrame([(0, 0.2), (1, 0.4)], "track_id bigint, mean_bass double")
    pairs = spark.createDataFrame([("a", 0, 1), ("b", 1, 2), ("c", 2, 0), ("d", 0, 9), ("e", None, 1)], "pair_id string, out_id bigint, in_id bigint")
    columns = ["pair_id", "out_id", "in_id", "mode", "compatibility", "wanted", "playback_rate"]
    few = key(fr.plan_compatibility(pairs, profiles, bass).select(columns).collect())
    shuffled(monkeypatch, fr)
    assert few == key(fr.plan_compatibility(pairs, profiles, bass).select(columns).collect()) and len(few) == 3
