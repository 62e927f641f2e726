"""Block-join recommenders against plain pair expressions."""

import pytest
from pyspark.sql import functions as F

from tonearm.functions import acoustic
from tonearm.functions.style import Styles
from tonearm.operators import chain, recommend as rec
from tonearm.operators.library import pair_up
from tonearm.session import materialize
from tonearm.sources.adapters import CHECK_THEMES


@pytest.fixture(scope="module")
def library(catalogue):
    """A slice of the small library with forty copies of one recording (a hot group)."""
    some = catalogue.prepared.filter(F.col("track_id").isin([f"apple-{i}" for i in range(60)]))
    copies = some.filter("track_id = 'apple-7'").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(40))))
    copies = copies.withColumns({"track_id": F.concat(F.lit("copy-"), F.col("n").cast("string")),
                                 "bpm": F.col("bpm") + F.col("n"), "energy": F.col("energy") - F.col("n")}).drop("n")
    return materialize(some.unionByName(copies))


def brute(library, mode, scope, lock, k):
    pairs = library.select(F.col("track_id").alias("anchor_id")).crossJoin(library.select("track_id"))
    scored = rec.score_pairs(pairs, library, mode, genre_scope=scope, vibe_lock=lock).withColumn("request_id", F.col("anchor_id"))
    return rec.diversify(scored.select("request_id", "track_id", "identity", "artist_key", "hybrid_score"), "request_id", k)


def rows(df):
    return sorted((r.request_id, r["rank"], r.track_id, r.hybrid_score) for r in df.collect())


@pytest.mark.parametrize("mode,scope,lock,k", [("similar", "nearby", True, 12), ("discover", "open", False, 30), ("timbre", "strict", True, 3)])
def test_block_lists_equal_brute_force(library, mode, scope, lock, k):
    requests = library.select(F.col("track_id").alias("request_id"), F.col("track_id").alias("anchor_id"))
    got = rec.top_lists(requests, library, mode, k=k, genre_scope=scope, vibe_lock=lock, themes=CHECK_THEMES, block_rows=8)
    assert rows(got) == rows(brute(library, mode, scope, lock, k))


def test_hot_recording_is_split(library):
    cut = rec.candidate_blocks(library, 8)
    sizes = [r["count"] for r in cut.groupBy("block").count().collect()]
    assert max(sizes) <= 24 and cut.filter("split").select("block").distinct().count() > 1


def test_explicit_rows_are_complete(library):
    requests = library.filter("track_id = 'apple-3'").select(F.col("track_id").alias("request_id"), F.col("track_id").alias("anchor_id"))
    out = rec.recommend(requests, library, "rhythm", k=5, themes=CHECK_THEMES).orderBy("rank").collect()
    assert [r["rank"] for r in out] == list(range(1, len(out) + 1))
    assert all(r.match_reasons is not None and r.score_mode.endswith("rhythm") for r in out)


def test_transition_prefers_the_compatible_track(spark, catalogue):
    one = catalogue.prepared.limit(1)
    make = lambda name, bpm, key, mode, energy: one.withColumns({
        "track_id": F.lit(name), "bpm": F.lit(float(bpm)), "key_no": F.lit(key), "mode": F.lit(mode), "energy": F.lit(float(energy))})
    three = make("anchor", 120, 0, "major", 55).unionByName(make("good", 123, 7, "major", 58)).unionByName(make("bad", 164, 6, "minor", 82))
    pairs = spark.createDataFrame([("anchor", "good"), ("anchor", "bad")], "anchor_id string, track_id string")
    a, b = acoustic.side("a"), acoustic.side("b")
    m = acoustic.handoff(a, b, a, Styles())
    got = {r.track_id: r.s for r in pair_up(pairs, three).select("track_id", m["score"].alias("s")).collect()}
    assert got["good"] > got["bad"]


def greedy(library, anchor, k, shortlist):
    """The chain rule row by row on collected pair scores (small fixture only)."""
    p, b, a = acoustic.side("p"), acoustic.side("b"), acoustic.side("a")
    ids = library.select("track_id")
    pairs = ids.withColumnRenamed("track_id", "prev_id").crossJoin(ids).withColumn("anchor_id", F.lit(anchor))
    wide = pair_up(pairs, library, (("prev_id", "p"), ("track_id", "b"), ("anchor_id", "a")))
    styles = Styles()
    m = acoustic.handoff(p, b, a, styles)
    genre = styles.genre_similarity(a("primary"), a("sub"), b("primary"), b("sub"))
    scored = wide.select("prev_id", "track_id", b("identity").alias("i"), b("artist_key").alias("k"), b("playable").alias("play"),
                         genre.alias("g"), acoustic.rough_handoff(p, b, a, styles).alias("rough"),
                         (m["score"] * (0.58 + 0.42 * acoustic.vibe(a, b)) * (0.60 + 0.40 * genre)).alias("s")).collect()
    by = {}
    for r in scored:
        by.setdefault(r.prev_id, []).append(r)
    me = next(r for r in by[anchor] if r.track_id == anchor)
    ids, idents, artists, prev, out = {anchor}, {me.i}, {me.k}, anchor, []
    for _ in range(k):
        open_ = [r for r in by[prev] if r.play and r.g >= 0.10 and r.track_id not in ids and r.i not in idents]
        short = sorted(open_, key=lambda r: (-r.rough, r.track_id))[:shortlist]
        if not short:
            break
        best = max(short, key=lambda r: (round(r.s * (0.62 if r.k in artists else 1), 12), r.rough))
        out.append(best.track_id)
        ids.add(best.track_id), idents.add(best.i), artists.add(best.k)
        prev = best.track_id
    return out


def test_chain_equals_row_by_row_greedy(spark, library):
    requests = spark.createDataFrame([(a, a) for a in ("apple-1", "apple-30")], "request_id string, anchor_id string")
    out = chain.transition_chain(requests, library, k=4, themes=CHECK_THEMES, shortlist=9, block_rows=8).collect()
    for anchor in ("apple-1", "apple-30"):
        got = [r.track_id for r in sorted((r for r in out if r.request_id == anchor), key=lambda r: r.step)]
        assert got == greedy(library, anchor, 4, 9)


def test_chain_and_bridge_properties(spark, library):
    requests = library.filter("playable").select(F.col("track_id").alias("request_id"), F.col("track_id").alias("anchor_id"))
    steps = chain.transition_chain(requests, library, k=3, genre_scope="strict", themes=CHECK_THEMES)
    told = chain.describe_steps(steps, library)
    primary = library.select("track_id", "primary")
    wide = told.join(primary, "track_id").join(primary.toDF("anchor_id", "a_primary"), "anchor_id")
    per = wide.groupBy("request_id").agg(F.count("*").alias("n"), F.count_distinct("identity").alias("d"), F.max("step").alias("s"),
                                         F.min((F.col("primary") == F.col("a_primary")) & F.col("playable") & F.col("transition_note").isNotNull()).alias("ok"))
    assert all(r.n == r.d == r.s and r.ok for r in per.collect())
    ask = spark.createDataFrame([("x", "apple-1", "apple-2"), ("same", "apple-1", "apple-1")], "request_id string, anchor_id string, destination_id string")
    bridge = sorted(chain.sound_bridge(ask, library, themes=CHECK_THEMES).collect(), key=lambda r: r.step)
    assert [r.step for r in bridge] == [1, 2, 3, 4] and bridge[-1].track_id == "apple-2"
    assert len({r.track_id for r in bridge}) == 4
