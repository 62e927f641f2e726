"""Cells of the block join, the metric index and the text index: equal to comparing everything, and bounded."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonearm.functions import text as tx
from tonearm.operators import blocks, neighbours, recommend as rec, search as se
from tonearm.session import materialize
from tonearm.sources.adapters import CHECK_THEMES


@pytest.fixture(scope="module")
def hot_library(catalogue):
    """A third of the rows in one lane."""
    some = catalogue.prepared.filter(F.col("track_id").isin([f"apple-{i}" for i in range(80)]))
    return materialize(some.unionByName(some.filter("track_id = 'apple-7'").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(40)))).withColumns({
        "track_id": F.concat(F.lit("x"), "n"), "identity": F.concat(F.lit("x"), "n"), "bpm": F.col("bpm") + F.col("n")}).drop("n")))


def test_cells_bound_both_sides(spark, hot_library):
    cands = materialize(rec.candidate_blocks(hot_library, 16))
    sizes = {r["block"]: r["count"] for r in cands.groupBy("block").count().collect()}
    asks = cands.select("block").distinct().withColumn("request_id", F.explode(F.sequence(F.lit(1), F.lit(500))))
    cells = blocks.Cells(cands, asks, 500, 50)
    left, right = cells.candidates(cands), cells.asks(asks)
    per_cell = {r["block"]: r["count"] for r in left.groupBy("block").count().collect()}
    asked = {r["block"]: r["count"] for r in right.groupBy("block").count().collect()}
    assert set(per_cell) == set(asked) and len(asked) == cells.count == 10 * len(sizes)
    assert max(per_cell.values()) == max(sizes.values()) and max(asked.values()) <= 100 and sum(asked.values()) == asks.count()
    few = blocks.Cells(cands, asks, 50, 50)
    assert few.count == len(sizes) and few.candidates(cands) is cands


@pytest.mark.parametrize("mode", ["similar", "personalized", "discover"])
def test_lists_do_not_depend_on_cells(spark, hot_library, mode):
    ids = [r["track_id"] for r in hot_library.select("track_id").orderBy("track_id").collect()]
    requests = spark.createDataFrame([(f"r{i}", t, i % 3) for i, t in enumerate(ids)], "request_id string, anchor_id string, user_id long")
    marks = lambda step: spark.createDataFrame([(u, t) for u in range(3) for t in ids[u::step]], "user_id long, track_id string")
    told = dict(taste=marks(9), averse=marks(11), seen=marks(5), themes=CHECK_THEMES, k=6)
    lists = [sorted((r.request_id, r["rank"], r.track_id, r.hybrid_score) for r in rec.top_lists(
        requests, hot_library, mode, block_rows=rows, chunk_rows=chunk, **told).collect()) for rows, chunk in ((4096, 16384), (16, 10))]
    assert lists[0] == lists[1] and len(lists[0]) == 6 * len(ids)


def test_best_first_keeps_ties():
    from tonearm.operators.kernels import best_first
    scores = np.round(np.random.default_rng(0).random((40, 300)), 1)
    for row, columns in zip(scores, best_first(scores, 7)):
        assert len(columns) >= 7 and columns.tolist() == np.argsort(-row, kind="stable")[:len(columns)].tolist()


def vectors(rng, clusters=12, each=40, dims=6, spread=0.02):
    centres = rng.normal(0, 1, (clusters, dims))
    points = (centres[:, None, :] + rng.normal(0, spread, (clusters, each, dims))).reshape(-1, dims)
    points = np.concatenate([points, points[:30], np.zeros((3, dims)), np.tile(points[:1], (60, 1))])  # copies, zeros, a hot point
    return [(f"v{i:04d}", p.tolist()) for i, p in enumerate(points)]


def by_brute_force(rows, k, score, digits=6):
    out = []
    for i, a in rows:
        best = sorted((-round(score(np.array(a), np.array(c)), digits) + 0.0, j) for j, c in rows if score is euclid or i != j)[:k]
        out += [(i, rank, j, s) for rank, (s, j) in enumerate(best, 1)]
    return sorted(out)


def euclid(a, c):
    return -float(np.sqrt(((a - c) ** 2).sum()))


def cosine(a, c):
    n = np.linalg.norm(a) * np.linalg.norm(c)
    return float(a @ c / n) if n else 0.0


@pytest.mark.parametrize("kind,block_rows", [("cosine", 25), ("euclid", 25), ("cosine", 100_000)])
def test_neighbours_equal_brute_force(spark, kind, block_rows):
    rows = vectors(np.random.default_rng(1))
    frame = spark.createDataFrame(rows, "id string, vector array<double>")
    if kind == "cosine":
        got = neighbours.cosine_topk(frame, frame, 5, exclude_self=True, digits=4, block_rows=block_rows)
    else:
        got = neighbours.nearest(frame, frame, 5, digits=4, block_rows=block_rows)
    found = sorted((r.anchor_id, r["rank"], r.candidate_id, -round(r.score, 4) + 0.0) for r in got.collect())
    want = by_brute_force(rows, 5, cosine if kind == "cosine" else euclid, 4)
    assert [f[:3] for f in found] == [w[:3] for w in want]
    assert [f[3] for f in found] == pytest.approx([w[3] for w in want], abs=1e-9)


def test_most_blocks_are_never_met(spark):
    rows = vectors(np.random.default_rng(2))
    frame = materialize(spark.createDataFrame(rows, "id string, x array<double>"))
    cands, known = neighbours.metric_blocks(frame, 25)
    assert known.sizes.sum() == len(rows) and len(known.names) > 20
    assert cands.groupBy("block").count().agg(F.max("count")).first()[0] <= 75  # the hot point is cut by its ids
    first = neighbours._meet(frame, known, 5, True, 6, False)
    lists = {i: sorted(-euclid(np.array(a), np.array(c)) for _, c in rows)[4] for i, a in rows}
    floors = spark.createDataFrame([(i, -d) for i, d in lists.items()], "id string, floor double")
    later = neighbours._meet(frame.join(floors, "id").select("id", "x", "floor"), known, 5, True, 6, True)
    met, everything = first.count() + later.count(), len(rows) * len(known.names)
    assert met < 0.35 * everything


def gram_set(value):
    return {("  " + w + " ")[i:i + 3] for w in value.split() for i in range(len(w) + 1)}


def run_score(query, value):
    run = [("  " + w + " ")[i:i + 3] for w in value.split() for i in range(len(w) + 1)]
    best = 0.0
    for i in range(len(run)):
        for j in range(i + 1, len(run) + 1):
            part = set(run[i:j])
            if part and run[i] in query and run[j - 1] in query:
                best = max(best, len(part & query) / len(part | query))
    return best


def fuzzy(tracks, q, limit):
    out = []
    query = gram_set(q)
    for track, title, artist in tracks:
        value = f"{title} {artist}"
        grams = gram_set(value)
        sim, ws = len(query & grams) / len(query | grams), run_score(query, value)
        if q in value or sim >= 0.16 or ws >= 0.28:
            score = 10 * (title == q) + 8 * (value == q) + 4 * title.startswith(q) + 2 * (q in value) + 3.5 * sim + 2.5 * ws
            out.append((-round(score, 6), track))
    return [t for _, t in sorted(out)[:limit]]


def test_fuzzy_search_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    words = ["blue", "bolt", "blues", "boat", "anvil", "anvils", "night", "knight", "light", "slight", "zz", "qx", "a"]
    tracks = [(f"t{i:03d}", " ".join(rng.choice(words, rng.integers(1, 5))), f"artist {rng.integers(1, 4)}") for i in range(150)]
    tracks += [(f"u{i:03d}", "blue night", "artist 1") for i in range(60)]  # one text, many tracks
    asked = ["blue bolt", "blue night artist 1", "kniht", "zzz unknown words", "a", "qx", "artist", "artist 2 slight boat", "blu", "jjj", "light anvils night boat blues"]
    frame = spark.createDataFrame(tracks, "track_id string, title string, artist string")
    queries = spark.createDataFrame([(str(i), q) for i, q in enumerate(asked)] + [("empty", " "), ("null", None)], "query_id string, query string")
    for limit in (7, 200):
        got = {}
        for r in sorted(se.search_fuzzy(frame, queries, limit).collect(), key=lambda r: r["rank"]):
            got.setdefault(r.query_id, []).append(r.track_id)
        want = {str(i): fuzzy(tracks, q, limit) for i, q in enumerate(asked)}
        assert got == {i: t for i, t in want.items() if t}


def test_frequent_trigrams_join_little(spark):
    """Every text and every query holds the same word; only its rare trigrams meet."""
    rng = np.random.default_rng(8)
    name = lambda: " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(6))
    frame = spark.createDataFrame([(f"t{i}", name(), "ed") for i in range(400)], "track_id string, title string, artist string")
    index = se.text_index(frame)
    asked = spark.createDataFrame([("q", name() + " ed")], "query_id string, q string")
    known = asked.select("query_id", F.explode(tx.trigrams("q")).alias("gram")).join(index.grams, "gram", "left").groupBy("query_id").agg(
        F.count("*").alias("n_query"), F.array_sort(F.collect_list("number")).alias("q_grams"))
    assert index.texts.count() == 400 and se.prefix_pairs(asked.join(known, "query_id"), index.texts).count() < 40
