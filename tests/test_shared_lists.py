"""Lists that many rows share are made once: relevance, list diversity, tracks of one text."""

import random

import pytest
from pyspark.sql import functions as F

from tonearm.operators import evaluation, search

LABELS = "track_id string, genre string, theme string, position long"


def label_rows(n):
    rng = random.Random(n)
    pick = lambda names: rng.choice([*names, None])
    return [(f"t{i:03d}", pick("abc"), pick("xyzw"), i) for i in range(n)]


def test_relevance_is_the_definition(spark):
    rows = label_rows(90)
    t = spark.createDataFrame(rows, LABELS)
    more = spark.createDataFrame([("t004", "c", "w", 4)], LABELS)  # an anchor with two rows has the labels of both
    got = sorted((r.anchor_id, r["rank"], r.track_id) for r in evaluation.relevance(t, t.union(more), 7).collect())
    held = {}
    for a, g, h, _ in [*rows, ("t004", "c", "w", 4)]:
        held.setdefault(a, (set(), set()))[0].add(g)
        held[a][1].add(h)
    want = []
    for a, (genres, themes) in held.items():
        fits = [b for b, g, h, _ in rows if b != a and (g is not None and g in genres or h is not None and h in themes)]
        want += [(a, i, b) for i, b in enumerate(fits[:7], 1)]
    assert got == sorted(want)


def test_relevance_shuffles_no_row_per_anchor_and_track(spark):
    t = spark.createDataFrame(label_rows(60), LABELS)
    plan = evaluation.relevance(t, t, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "anchor_id#" not in "".join(x for x in plan.split("\n") if "Exchange hash" in x)


@pytest.mark.parametrize("task_rows", [1, 1 << 18])
def test_diversity_tasks_follow_the_rows(spark, monkeypatch, task_rows):
    monkeypatch.setattr(evaluation, "LIST_TASK_ROWS", task_rows, raising=False)
    recs = spark.createDataFrame([(a, f"t{(a * k) % 7}") for a in range(40) for k in range(1, 4)], "anchor_id long, track_id string")
    vectors = spark.createDataFrame([(f"t{i}", [1.0, float(i)]) for i in range(6)], "track_id string, vector array<double>")
    made = evaluation.diversity(recs, vectors, 2)
    assert (made.rdd.getNumPartitions() >= 100) == (task_rows == 1)
    norm = lambda i: (1 + i * i) ** 0.5
    for r in made.collect():
        ids = [i for i in ((r.anchor_id * k) % 7 for k in range(1, 4)) if i < 6]
        pairs = [(1 + a * b) / norm(a) / norm(b) for x, a in enumerate(ids) for y, b in enumerate(ids) if x != y]
        assert r.diversity == pytest.approx(0.0 if len(ids) < 2 else 1 - sum(pairs) / len(pairs), abs=6e-5)


def test_tracks_of_one_text_are_scored_once(spark, monkeypatch):
    tracks = spark.createDataFrame([(f"t{i:03d}", "Night Ride", "Ann", None, "https://x.test/a" if i % 2 else None) for i in range(40)]
                                   + [("u1", "Night Ride (Live)", "Ann", None, None), ("u2", "Night Rode", "Bob", None, "https://x.test/b")],
                                   "track_id string, title string, artist string, album string, preview_url string")
    fingerprints = spark.createDataFrame([("t006",), ("t009",), ("u2",)], "track_id string")
    seen = []
    candidates = search.search_candidates
    monkeypatch.setattr(search, "search_candidates", lambda queries, texts: seen.append(texts.count()) or candidates(queries, texts))
    queries = spark.createDataFrame([("q", "night ride")], "query_id string, query string")
    got = search.search_local(tracks, fingerprints, queries).orderBy("position").collect()
    assert seen == [6]  # four of "Night Ride" (analysed or not, playable or not), one each of the others
    assert [(r.track_id, r.position) for r in got][:1] == [("t009", 1)]
    assert all(r.total == len(got) for r in got) and "u2" in [r.track_id for r in got]
