"""Acoustic recommenders: five modes, three genre scopes, vibe lock, taste, aversion and diversity.

``requests`` is a DataFrame of (request_id, anchor_id[, user_id]); one request is
the one-row case, the whole library is the batch case.  The plan is

1. prepared library -> genre lanes -> blocks of bounded size (one shuffle);
2. lane pairs that the genre scope allows, found by equi-joins on style keys;
3. requests sent to the blocks they may reach, scored there (see blocks.py);
4. block lists merged per request by two windows and a top-k.

Why the merge is exact: a block holds whole recordings, so its best edition per
recording is the global one.  A row among the global k best (at most two per
artist) has fewer than k such rows above it in its own block too, because an
artist with j <= 2 better rows in the block has at least j better rows overall.
If fewer than k rows pass the artist cap, no block dropped any of them, and each
block also hands over its best capped rows for the backfill.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tonearm.functions import acoustic
from tonearm.functions import taxonomy as tx
from tonearm.functions.style import Styles
from tonearm.functions.vectors import unit
from tonearm.limits import MAX_LIST, within
from tonearm.operators import blocks, kernels
from tonearm.operators.library import pair_up
from tonearm.session import materialize

SCOPES = ("strict", "nearby", "open")
TOP_SCHEMA = ("request_id string, track_id string, identity string, artist_key string, hybrid_score double, "
              "rhythm double, timbre double, harmony double")


def check_weights(weights, tolerance: float = 0.01) -> tuple[float, float, float]:
    values = tuple(float(w) for w in weights)
    if len(values) != 3 or any(w < 0 or w != w for w in values) or abs(sum(values) - 1) > tolerance:
        raise ValueError("weights must be three non-negative numbers that sum to 1")
    return values


def weight_report(weights: DataFrame, keys: list[str], tolerance: float = 0.01) -> DataFrame:
    """Validate a table of weight sets (keys, weight): non-negative and summing to one."""
    total = F.round(F.sum("weight"), 6)
    return weights.groupBy(*keys).agg(
        F.count("*").alias("n"), total.alias("total"),
        ((F.round(F.min("weight"), 6) >= 0) & (F.abs(total - 1) <= tolerance)).alias("ok"))


def features(themes=None, learned: bool = False) -> Column:
    """Numeric layout read by kernels.py; built in the JVM once per track."""
    themes = tx.LYRIC_THEMES if themes is None else themes
    defaults = {"mood": F.lit(float("nan")), "sentiment": F.lit(0.0), "arousal": F.lit(0.5)}
    numbers = [F.lit(float(len(themes))) if n == "n_themes" else
               F.coalesce(F.col(n).cast("double"), defaults.get(n, F.lit(0.0))) for n in kernels.NUMBERS]
    theme = unit(F.array(*[F.coalesce(F.element_at("theme_vector", F.lit(t)), F.lit(0.0)) for t in themes]))
    parts = [F.array(*numbers), F.col("mfcc"), F.col("chroma_unit"), theme]
    return F.concat(*parts, F.col("sound"), F.col("moods")) if learned else F.concat(*parts)


def with_learned(prepared: DataFrame, index: DataFrame, dims: int, moods: int) -> DataFrame:
    """Attach unit embeddings and mood distributions; rows outside the index get zeros and NaN."""
    from tonearm.operators.learned import mood_distribution
    rows = index.select("track_id", unit(F.transform("embedding", lambda x: x.cast("double"))).alias("_s"),
                        mood_distribution("mood_scores").alias("_m"))
    nan = F.array_repeat(F.lit(float("nan")), moods)
    return prepared.join(rows, "track_id", "left").withColumns({
        "sound": F.coalesce("_s", F.array_repeat(F.lit(0.0), dims)), "moods": F.coalesce("_m", nan)}).drop("_s", "_m")


def texts(split: Column | None = None) -> Column:
    cols = [F.coalesce(F.col(n), F.lit("\u0000")) for n in kernels.TEXTS if n != "split"]
    flag = F.lit("false") if split is None else split.cast("string")
    return F.array(*cols, flag)


def with_lane(prepared: DataFrame) -> DataFrame:
    return prepared.withColumn("lane", F.concat_ws("\u0001", "primary", "sub", "style"))


def lane_pairs(anchors: DataFrame, candidates: DataFrame, scope: str, styles: Styles) -> DataFrame:
    """(anchor_lane, lane, genre): lane pairs inside the genre scope.

    Only distinct lanes meet here.  "nearby" pairs share a style key whenever their
    similarity can reach .10, so they are found by an equi-join and then filtered.
    """
    cols = ["lane", "primary", "sub"]
    left = anchors.select(*[F.col(c).alias(f"a_{c}") for c in cols]).distinct()
    right = candidates.select(*cols).distinct()
    genre = styles.genre_similarity("a_primary", "a_sub", "primary", "sub")
    if scope == "strict":
        pairs = left.join(right, F.col("a_primary") == F.col("primary"))
    elif scope == "nearby":
        l2 = left.withColumn("key", F.explode(styles.reach_keys("a_primary", "a_sub")))
        r2 = right.withColumn("key", F.explode(styles.own_keys("primary", "sub")))
        pairs = l2.join(r2, "key").drop("key").distinct()
        # an empty style on the candidate side is close to everything
        blank = right.filter((F.col("primary") == "") | (F.col("sub") == "")).withColumn("any", F.lit(1))
        pairs = pairs.unionByName(left.withColumn("any", F.lit(1)).join(blank, "any").drop("any")).distinct()
    elif scope == "open":
        pairs = left.withColumn("any", F.lit(1)).join(right.withColumn("any", F.lit(1)), "any").drop("any")
    else:
        raise ValueError(f"unknown genre scope {scope}")
    pairs = pairs.withColumn("genre", genre)
    if scope == "nearby":
        pairs = pairs.filter(F.col("genre") >= 0.10)
    return pairs.select(F.col("a_lane").alias("anchor_lane"), "lane", "genre")


def candidate_blocks(prepared: DataFrame, block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    return blocks.assign_blocks(with_lane(prepared), "lane", "identity", "track_id", block_rows)


def top_lists(requests: DataFrame, prepared: DataFrame, mode: str = "similar", k: int = 12, weights=None,
              genre_scope: str = "nearby", vibe_lock: bool = True, taste: DataFrame | None = None,
              averse: DataFrame | None = None, seen: DataFrame | None = None, dialect: str = "hosted",
              styles: Styles | None = None, themes=None, blocked: DataFrame | None = None,
              candidates: DataFrame | None = None,
              learned: tuple[int, list[str]] | None = None, feedback: DataFrame | None = None, block_rows: int = blocks.BLOCK_ROWS,
              chunk_rows: int = blocks.CHUNK_ROWS, outside: DataFrame | None = None, inside: bool = False) -> DataFrame:
    """Top-k per request: request_id, anchor_id, track_id, rank, hybrid_score and the three parts.

    ``outside`` holds anchors that come with the requests and are not in the library (rows of
    ``library.prepare``, with ids of their own).  ``inside`` (with ``learned``) gives two lists per request in one
    pass, of all candidates and of the indexed ones alone, told apart by a column ``inside``.

    ``blocked`` is a stored result of ``candidate_blocks`` (of the library or of a part of it).
    taste, averse and seen are (user_id, track_id) tables.  ``learned`` = (dims, mood labels) turns on
    the learned rerank; prepared and blocked then carry the columns of ``with_learned``, and
    feedback(user_id, track_id, reason, position) adds explicit feedback (at most 100 rows per user).
    """
    if mode not in tx.MODE_WEIGHTS or mode == "transition":
        raise ValueError(f"unknown mode {mode}")
    if inside and learned is None:
        raise ValueError("lists inside the index need the learned columns")
    if genre_scope not in SCOPES:
        raise ValueError(f"unknown genre scope {genre_scope}")
    k = within(k, MAX_LIST, "k")
    chosen = check_weights(weights) if mode == "similar" and weights else tx.MODE_WEIGHTS[mode]
    styles = styles or Styles(dialect=dialect)
    if blocked is None:
        blocked = materialize(candidate_blocks(prepared if candidates is None else candidates, block_rows))
    cands = blocked
    personal = "user_id" in requests.columns
    group = F.concat(F.lit("u"), F.col("user_id").cast("string")) if personal else F.lit("~")

    anchors = with_lane(prepared if outside is None else prepared.unionByName(outside))
    asked = requests.join(anchors.withColumnRenamed("track_id", "anchor_id"), "anchor_id")
    pairs = lane_pairs(asked, cands, genre_scope, styles)
    directory = cands.select("lane", "block").distinct()
    routed = (asked.withColumnRenamed("lane", "anchor_lane").join(pairs, "anchor_lane").join(directory, "lane"))
    cells = blocks.Cells(directory, routed, requests.count(), chunk_rows)
    routed = cells.asks(routed)
    x, s = features(themes, learned is not None), texts()
    parts = [
        blocks.rows(cells.candidates(cands), blocks.CANDIDATE, "", texts(F.col("split")), x, row_id="track_id"),
        blocks.rows(routed, blocks.ANCHOR, F.coalesce(group, F.lit("~")), F.concat(s, F.array("anchor_id")), x,
                    F.array("genre"), row_id="request_id"),
    ]
    if personal:
        reach = routed.select("user_id", "block").distinct()
        fx = prepared.select("track_id", x.alias("x"))
        for side, table in ((blocks.TASTE, taste if mode == "personalized" else None), (blocks.AVERSE, averse)):
            if table is not None:
                known = table.select("user_id", "track_id").distinct().join(fx, "track_id").join(reach, "user_id")
                parts.append(blocks.rows(known, side, group, x=F.col("x"), row_id="track_id"))
        if seen is not None:
            home = cands.select("track_id", F.col("block").alias("home"))
            known = seen.select("user_id", "track_id").distinct().join(home, "track_id").join(
                routed.select("user_id", "home", "block").distinct(), ["user_id", "home"])
            parts.append(blocks.rows(known, blocks.SEEN, group, row_id="track_id"))
        if feedback is not None:
            said = feedback.join(prepared, "track_id", "left").join(reach, "user_id")
            blank = F.array_repeat(F.lit(float("nan")), 1)
            parts.append(blocks.rows(said, blocks.FEEDBACK, group, F.array("reason"), F.coalesce(x, blank),
                                     F.array(F.col("position").cast("double")), row_id="track_id"))
    kernel = partial(kernels.Recommend, mode=mode, k=k, weights=chosen, scope=genre_scope, vibe_lock=vibe_lock,
                     dialect=dialect, lyric_weight=tx.LYRIC_WEIGHTS[mode])
    if learned is not None:
        dims, labels = learned
        strength = 0.20 if mode in ("rhythm", "timbre") else 0.42
        sad = labels.index("melancholic") if "melancholic" in labels else None
        kernel = partial(kernel, learned=(dims, len(labels), sad, strength), inside=inside)
    local = blocks.run(parts, kernel, f"{TOP_SCHEMA}, inside boolean" if inside else TOP_SCHEMA, cells.count)
    if inside:
        listed = local.withColumn("_list", F.concat_ws("\u0001", "request_id", F.col("inside").cast("string")))
        return requests.join(diversify(listed, "_list", k).drop("_list"), "request_id")
    merged = diversify(local, "request_id", k)
    return requests.join(merged, "request_id")


def diversify(scored: DataFrame, key: str, k: int) -> DataFrame:
    """One row per recording, two per artist in score order, then backfill without the artist cap.

    scored needs track_id, identity, artist_key, hybrid_score.
    """
    best = [F.desc("hybrid_score"), F.asc("track_id")]
    scored = scored.repartition(key)  # one shuffle serves the three windows; a request has a bounded list per block
    first = scored.withColumn("n", F.row_number().over(W.partitionBy(key, "identity").orderBy(*best))).filter("n = 1")
    capped = first.withColumn("n", F.row_number().over(W.partitionBy(key, "artist_key").orderBy(*best)))
    ranked = capped.withColumn("backfill", F.col("n") > 2)
    order = W.partitionBy(key).orderBy("backfill", *best)
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("n")


def describe(top: DataFrame, prepared: DataFrame, mode: str, genre_scope: str = "nearby", dialect: str = "hosted",
             styles: Styles | None = None, outside: DataFrame | None = None) -> DataFrame:
    """Add vibe, genre, lyric similarity and reasons to finished lists (at most k rows per request)."""
    styles = styles or Styles(dialect=dialect)
    a, b = acoustic.side("a"), acoustic.side("b")
    wide = pair_up(top, prepared if outside is None else prepared.unionByName(outside))
    lyric = acoustic.lyric_similarity(a, b)
    genre = styles.genre_similarity(a("primary"), a("sub"), b("primary"), b("sub"))
    vibe = acoustic.vibe(a, b, dialect, lyric)
    cols = {"vibe_similarity": F.round(vibe, 4), "genre_similarity": F.round(genre, 4),
            "lyric_similarity": F.round(lyric, 4), "genre_scope": F.lit(genre_scope),
            "score_mode": F.lit(f"acoustic-fingerprint-{mode}"), "title": b("title"), "artist": b("artist"),
            "preview_url": b("preview_url"),
            "match_reasons": acoustic.match_reasons(a, b, F.col("harmony"), genre, vibe, lyric, dialect)}
    out = wide.withColumns(cols).withColumns({
        "audio_similarity": F.round("rhythm", 4), "timbre_similarity": F.round("timbre", 4),
        "collab_similarity": F.round("harmony", 4)})
    keep = [c for c in top.columns if c not in ("rhythm", "timbre", "harmony", "identity", "artist_key", "backfill")]
    return out.select(*keep, "title", "artist", "preview_url", "audio_similarity", "timbre_similarity",
                      "lyric_similarity", "collab_similarity", "vibe_similarity", "genre_similarity", "genre_scope",
                      "score_mode", "match_reasons")


def recommend(requests: DataFrame, prepared: DataFrame, mode: str = "similar", **options) -> DataFrame:
    """Full recommendation rows (scores, parts, reasons) for every request."""
    top = top_lists(requests, prepared, mode, **options)
    return describe(top, prepared, mode, options.get("genre_scope", "nearby"), options.get("dialect", "hosted"),
                    options.get("styles"), options.get("outside"))


def score_pairs(pairs: DataFrame, prepared: DataFrame, mode: str = "similar", weights=None,
                genre_scope: str = "nearby", vibe_lock: bool = True, dialect: str = "hosted",
                styles: Styles | None = None) -> DataFrame:
    """Score an explicit pair table (anchor_id, track_id) with Column expressions only."""
    styles = styles or Styles(dialect=dialect)
    chosen = check_weights(weights) if mode == "similar" and weights else tx.MODE_WEIGHTS[mode]
    a, b = acoustic.side("a"), acoustic.side("b")
    genre = styles.genre_similarity(a("primary"), a("sub"), b("primary"), b("sub"))
    wide = pair_up(pairs, prepared).filter((F.col("anchor_id") != F.col("track_id")) & (a("identity") != b("identity")))
    if genre_scope == "strict":
        wide = wide.filter(a("primary") == b("primary"))
    wide = wide.withColumn("genre", genre)
    if genre_scope == "nearby":
        wide = wide.filter("genre >= 0.10")
    wide = wide.withColumns(acoustic.components(a, b, dialect))
    wide = wide.withColumn("lyric", acoustic.lyric_similarity(a, b) if dialect == "hosted" else F.lit(None).cast("double"))
    wide = wide.withColumns({"vibe": acoustic.vibe(a, b, dialect, F.col("lyric")), "title_sim": acoustic.title_match(a, b)})
    parts = {n: F.col(n) for n in ("rhythm", "timbre", "harmony")}
    base = acoustic.base_score(mode, parts, F.col("vibe"), F.col("lyric"), F.col("genre"), b("id_hash"), chosen, dialect)
    g = F.col("genre")
    total = base * ((0.86 + 0.14 * g) if genre_scope == "open" else (0.56 + 0.44 * g))
    if vibe_lock:
        total = total * (0.42 + 0.58 * F.col("vibe"))
    total = F.when(F.col("title_sim") == 0, total * 0.52).otherwise(total)
    if mode == "discover":
        total = F.when(a("artist_key") == b("artist_key"), total * 0.58).otherwise(total)
    score = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)), 4)
    return wide.withColumns({"hybrid_score": score, "identity": b("identity"), "artist_key": b("artist_key")})


def unique_top(scored: DataFrame, key: str, k: int) -> DataFrame:
    """Strongest edition per exact (title, artist), then the k best."""
    from tonearm.functions.text import identity
    best = [F.desc("hybrid_score"), F.asc("track_id")]
    named = scored.withColumn("edition", identity("title", "artist", "exact"))
    first = named.withColumn("n", F.row_number().over(W.partitionBy(key, "edition").orderBy(*best))).filter("n = 1")
    return (first.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*best)))
            .filter(F.col("rank") <= k).drop("n", "edition"))


def summary(recommendations: DataFrame, index: DataFrame) -> DataFrame:
    """Learned coverage per request: recommended rows, indexed rows, pairs indexed on both sides."""
    ids = index.select(F.col("track_id").alias("indexed_id")).distinct()
    a = ids.withColumnRenamed("indexed_id", "anchor_indexed")
    joined = (recommendations.join(ids, F.col("track_id") == F.col("indexed_id"), "left")
              .join(a, F.col("anchor_id") == F.col("anchor_indexed"), "left"))
    both = F.col("indexed_id").isNotNull() & F.col("anchor_indexed").isNotNull()
    return joined.groupBy("request_id").agg(
        F.count("*").alias("pool"), F.count("indexed_id").alias("indexed"), F.count_if(both).alias("matched"))
