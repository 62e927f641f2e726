"""What must not depend on batches, nulls or silent bounds."""

from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from tonearm.functions import text
from tonearm.limits import within
from tonearm.operators import catalogue as cat, listeners as ls, lyrics
from tonearm.session import broadcast_if_small
from tonearm.sources.catalogue import content_version
from tonearm.streaming import listeners as st

EVENTS = "event_id long, user_id long, track_id string, event_type string, value double, created_at timestamp"


def events(spark, first, hour):
    rows = [(first + i, i % 3, f"t{(first + i) % 7}", ["liked", "disliked", "selected"][i % 3 if i < 4 else 2], None) for i in range(8)]
    return spark.createDataFrame([(*r, datetime(2024, 1, 1, hour)) for r in rows], EVENTS).coalesce(1)


def test_taste_stream_keeps_late_events_and_goes_on(spark, tmp_path):
    source, base = str(tmp_path / "in"), str(tmp_path / "query")
    parts = [events(spark, 0, 20), events(spark, 50, 1), events(spark, 90, 12)]  # the second file is hours late
    for part in parts[:2]:
        part.write.mode("append").parquet(source)

    def table(files):
        stream = st.read_stream(spark, source, parts[0].schema, files_per_trigger=files)
        return {(r.user_id, r.track_id, r.liked, r.disliked) for r in st.taste_now(stream, base).collect()}

    def batch(frames):
        rows = frames[0]
        for more in frames[1:]:
            rows = rows.unionByName(more)
        flags = rows.groupBy("user_id", "track_id").agg(F.max(F.col("event_type") == "liked").alias("l"), F.max(F.col("event_type") == "disliked").alias("d"))
        return {(r.user_id, r.track_id, r.l, r.d) for r in flags.filter("l OR d").collect()}

    assert table(1) == batch(parts[:2])
    parts[2].write.mode("append").parquet(source)
    before = sum(1 for _ in (tmp_path / "query" / "out").iterdir())
    assert table(1) == batch(parts)  # the same folder: goes on with the new file
    assert sum(1 for _ in (tmp_path / "query" / "out").iterdir()) == before + 1


def test_split_keeps_null_strata(spark):
    rows = spark.createDataFrame([(f"t{i}", "a" if i % 3 else None) for i in range(60)], "track_id string, g string")
    got = {r["g"]: (r["n"], r["test"]) for r in cat.stratified_split(rows, "g").groupBy("g").agg(
        F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("test")).collect()}
    assert got == {None: (20, 4), "a": (40, 8)}


def test_merge_is_not_bounded_by_default(spark):
    kind = "track_id string, title string, artist string"
    existing = spark.createDataFrame([("x", "Old", "A")], kind)
    batch = spark.createDataFrame([(f"n{i}", f"New {i}", "B", i) for i in range(1200)], f"{kind}, position long")
    assert cat.merge_catalogue(existing, batch).count() == 1201
    assert cat.merge_catalogue(existing, batch, max_new=10).count() == 11


def test_bounds_are_errors():
    assert within(50, 50, "k") == 50
    for wrong in (0, 51, -1):
        with pytest.raises(ValueError):
            within(wrong, 50, "k")


def test_repeated_requests_are_runs_of_their_own(spark):
    recs = spark.createDataFrame([(r, 1, "a", "similar", datetime(2024, 1, r), f"t{i}", i, 0.5) for r in (1, 2) for i in (1, 2)],
                                 "request_id long, user_id long, anchor_id string, mode string, created_at timestamp, track_id string, rank long, hybrid_score double")
    tracks = spark.createDataFrame([("t1", "One", "X", "rock"), ("a", "Anchor", "Y", "pop")], "track_id string, title string, artist string, provider_subgenre string")
    runs, items = ls.record_runs(recs, tracks, {"similar": {"rhythm": 1.0}})
    assert runs.count() == 2 and items.count() == 4
    seen = ls.history(runs, items).orderBy("id").collect()
    assert [len(r["suggestions"]) for r in seen] == [2, 2] and {r["anchor_title"] for r in seen} == {"Anchor"}


def test_ascii_strings_stay_in_the_jvm(spark):
    sent = spark.sparkContext.accumulator(0)

    @F.pandas_udf(T.StringType())
    def counting(values: pd.Series) -> pd.Series:
        sent.add(int(values.notna().sum()))
        return values.str.normalize("NFKD")

    real = text._nfkd
    text._nfkd = counting
    try:
        rows = spark.createDataFrame([(f"plain {i}",) for i in range(500)] + [("Ünïcode ①",)], "s string")
        got = [r[0] for r in rows.select(text.nfkd("s")).collect()]
    finally:
        text._nfkd = real
    assert sent.value == 1 and got[0] == "plain 0" and got[-1].endswith("1")


def test_every_bit_of_a_row_counts(spark):
    one = spark.createDataFrame([("a",), ("b",)], "s string")
    other = spark.createDataFrame([("a",), ("c",)], "s string")
    versions = {content_version(df, F.col("s")).first()["version"] for df in (one, other, one.repartition(3))}
    assert len(versions) == 2


def test_lyrics_with_a_large_vocabulary(spark):
    texts = spark.createDataFrame([("a", "love love pain", "en"), ("b", None, None), ("c", "nothing known", "de")], "track_id string, text string, language string")
    words = spark.createDataFrame([("love", "theme", "love"), ("love", "positive", None), ("pain", "negative", None)], "word string, kind string, theme string")
    got = {r["track_id"]: r for r in lyrics.lyric_features(texts, words, ["love"]).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"]["themes"] == ["love"] and got["a"]["language"] == "en" and got["b"]["instrumental"]
    assert "broadcast" not in broadcast_if_small(words, 1 << 20, 1 << 20)._jdf.queryExecution().logical().toString().lower()
