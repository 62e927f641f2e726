"""Stored tables that change in parts."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tonearm.sources.versions import Folder, KeyedTable
from tonearm.streaming import listeners as st


def files(folder):
    return {str(p.relative_to(folder)) for p in folder.rglob("*.parquet")}


def test_upsert_keeps_untouched_files(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i}", i % 7, i, 1) for i in range(500)], "id string, part long, value long, version long")
    table = KeyedTable.create(rows, str(tmp_path / "t"), ["id", "part"], buckets=32)
    before = files(tmp_path / "t")
    changes = spark.createDataFrame([("k3", 3, -3, 2), ("k3", 3, -4, 1), ("k9", 2, 0, 0), ("new", 0, 5, 1)], "id string, part long, value long, version long")
    touched = table.upsert(changes)
    assert 1 <= touched <= 3
    fresh = files(tmp_path / "t") - before
    assert len(fresh) == touched and before <= files(tmp_path / "t")
    got = {(r.id, r.part): (r.value, r.version) for r in table.read().collect()}
    want = {(f"k{i}", i % 7): (i, 1) for i in range(500)} | {("k3", 3): (-3, 2), ("new", 0): (5, 1)}
    assert got == want  # an older version of k9 changes nothing
    assert table.upsert(changes.limit(0)) == 0
    assert KeyedTable(spark, str(tmp_path / "t")).upsert(changes.filter("id = 'new'").withColumn("version", F.lit(3).cast("long"))) == 1
    assert table.clean(1) > 0 and {(r.id, r.part): r.version for r in table.read().collect()}[("new", 0)] == 3
    assert table.read().count() == 501
    with pytest.raises(ValueError):
        KeyedTable.create(rows, str(tmp_path / "t"), ["id"])


def test_one_writer_publishes_a_number(spark, tmp_path):
    folder = Folder(spark, str(tmp_path / "v"))
    assert folder.latest() == (0, None)
    folder.publish(1, {"a": 1})
    with pytest.raises(RuntimeError):
        folder.publish(1, {"a": 2})
    assert folder.latest() == (1, {"a": 1})


EVENTS = "event_id long, user_id long, track_id string, event_type string, value double, created_at timestamp"


def test_epochs_are_folded(spark, tmp_path):
    """Ten epochs, a restart after each, the same table as the whole; files do not grow with epochs."""
    source, base = str(tmp_path / "in"), str(tmp_path / "query")
    every, kinds = [], ["liked", "disliked", "selected"]
    for epoch in range(10):
        rows = [(epoch * 20 + i, i % 4, f"t{(epoch + i) % 9}", kinds[(epoch + i) % 3], None, datetime(2024, 1, 1 + epoch)) for i in range(20)]
        every += rows
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(source)
        stream = st.read_stream(spark, source, spark.createDataFrame(rows, EVENTS).schema)
        table = st.taste_now(stream, base, fold=3)
        out = tmp_path / "query" / "out"
        assert sum(p.name.startswith(("epoch=", "snapshot-")) for p in out.iterdir()) <= 4
        flags = {}
        for _, user, track, kind, *_ in every:
            liked, disliked = flags.get((user, track), (False, False))
            flags[user, track] = (liked or kind == "liked", disliked or kind == "disliked")
        assert {(r.user_id, r.track_id): (r.liked, r.disliked) for r in table.collect()} == {k: v for k, v in flags.items() if any(v)}
    again = st.FoldedEpochs(spark, f"{base}/out", lambda rows: rows)
    before = again.read().count()
    again.write(spark.createDataFrame([], table.schema), 0)  # an epoch that is folded already is not read twice
    assert again.read().count() == before
