"""Catalogue cleaning, merging, quality and maintenance jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tonearm import schemas
from tonearm.functions import taxonomy as tx
from tonearm.functions.text import identity
from tonearm.session import materialize


def fill_themes(df: DataFrame, columns=("theme_1", "theme_2", "theme_3", "theme_4")) -> DataFrame:
    return df.fillna("none", list(columns))


def ranked(frame: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """Add the 0-based place in the whole order.

    Ranges are numbered on their own and moved by the sizes of the ranges before them, so no task
    sees more than one range.
    """
    parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = materialize(frame.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    sizes = cut.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))  # one row per range
    within = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    placed = cut.withColumn(name, within).join(before, "_range")
    return placed.withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")


def label_encode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Alphabetical codes from 0.

    Only the distinct labels are numbered, range by range; the fact table is joined
    to that dictionary and never sorted as a whole.
    """
    for c in columns:
        labels = df.select(F.col(c).cast("string").alias("label")).distinct()
        codes = ranked(labels, F.col("label").asc_nulls_first(), name=f"{c}_encoded")
        df = df.join(codes, df[c].cast("string").eqNullSafe(codes["label"]), "left").drop("label")
    return df


def first_by(df: DataFrame, keys: list, order: list) -> DataFrame:
    """First row per key.  min_by combines map-side, so a hot key costs one row per task."""
    packed = df.withColumn("_row", F.struct(*df.columns)).withColumn("_order", F.struct(*order))
    first = packed.groupBy(*keys).agg(F.min_by("_row", "_order").alias("_row"))
    return first.select("_row.*")


def last_by(df: DataFrame, keys: list, order: list) -> DataFrame:
    packed = df.withColumn("_row", F.struct(*df.columns)).withColumn("_order", F.struct(*order))
    return packed.groupBy(*keys).agg(F.max_by("_row", "_order").alias("_row")).select("_row.*")


def dedupe_first(df: DataFrame, keys=("title", "artist"), order=("track_id",)) -> DataFrame:
    return first_by(df, list(keys), list(order))


def stratified_split(df: DataFrame, by: str, fraction: float = 0.2, seed: int = 42, key: str = "track_id") -> DataFrame:
    """Add ``split``: the ``fraction`` of each stratum with the smallest seeded hash is the test part.

    The cut hash of a stratum is found by counting hash prefixes, so no stratum is sorted in one task
    unless it is small.
    """
    hashed = df.withColumn("_h", F.sha2(F.concat(F.lit(str(seed)), F.col(key)), 256))
    prefix = hashed.withColumn("_b", F.substring("_h", 1, 4))
    counts = prefix.groupBy(by, "_b").agg(F.count("*").alias("_n"))
    running = W.partitionBy(by).orderBy("_b")
    # a null stratum is a stratum like any other: its rows are joined null-safe below
    totals = counts.withColumn("_upto", F.sum("_n").over(running)).withColumn(
        "_total", F.sum("_n").over(W.partitionBy(by)))
    totals = totals.withColumn("_want", F.round(F.col("_total") * fraction))
    cut = totals.select(F.col(by).alias("_by"), F.col("_b").alias("_cut"), (F.col("_upto") - F.col("_n")).alias("_before"), "_upto", "_want")
    placed = prefix.join(cut, prefix[by].eqNullSafe(cut["_by"]) & (prefix["_b"] == cut["_cut"])).drop("_by", "_cut")
    # only the prefix that straddles the cut needs an order inside it (1/65536 of a stratum)
    inside = F.when((F.col("_before") < F.col("_want")) & (F.col("_upto") > F.col("_want")), F.col("_b"))
    rank = F.row_number().over(W.partitionBy(by, "_b").orderBy("_h"))
    test = F.when(F.col("_upto") <= F.col("_want"), True).when(inside.isNotNull(), F.col("_before") + rank <= F.col("_want"))
    split = F.when(F.coalesce(test, F.lit(False)), "test").otherwise("train")
    return placed.withColumn("split", split).drop("_h", "_b", "_before", "_upto", "_want")


def merge_catalogue(existing: DataFrame, batch: DataFrame, max_new: int | None = None) -> DataFrame:
    """Merge a provider batch (same columns plus ``position``) into the catalogue.

    A known id is updated in place, an unknown id with a known recording is skipped,
    anything else is inserted.  ``max_new`` bounds a batch: once so many rows are new, later rows
    are ignored.
    """
    columns = existing.columns
    keyed = batch.withColumn("_identity", identity("title", "artist", "unicode"))
    known = existing.select(identity("title", "artist", "unicode").alias("_identity")).distinct()
    fresh = keyed.join(existing.select("track_id"), "track_id", "left_anti").join(known, "_identity", "left_anti")
    inserts = first_by(fresh, ["_identity"], ["position"])
    if max_new is not None:
        inserts = inserts.orderBy("position").limit(max_new)
    stop = inserts.agg(F.count("*").alias("_n"), F.max("position").alias("_last"))
    if max_new is None:
        stop = stop.withColumn("_stop", F.lit(None).cast("bigint"))
    else:
        stop = stop.withColumn("_stop", F.when(F.col("_n") >= max_new, F.col("_last")))
    allowed = (keyed.crossJoin(F.broadcast(stop.select("_stop")))  # a single row
               .filter(F.col("_stop").isNull() | (F.col("position") <= F.col("_stop"))))
    ids = existing.select("track_id").union(inserts.select("track_id"))
    changes = allowed.join(ids, "track_id", "left_semi").select(*columns, "position")
    current = existing.withColumn("position", F.lit(-1).cast("bigint"))
    return last_by(current.unionByName(changes), ["track_id"], ["position"]).drop("position")


def round_robin_select(pools: DataFrame, known: DataFrame, groups: list[str], target: int) -> DataFrame:
    """Position p of every pool before position p+1, per language group, skipping known recordings.

    pools(group, pool, position, track_id, title, artist); groups are served in the given order.
    """
    keyed = pools.withColumn("_identity", identity("title", "artist", "unicode"))
    seen = known.select("track_id", identity("title", "artist", "unicode").alias("_identity"))
    keyed = keyed.join(seen.select("track_id"), "track_id", "left_anti").join(
        seen.select("_identity").distinct(), "_identity", "left_anti")
    unique = first_by(keyed, ["group", "pool", "_identity"], ["position"])
    offset = F.row_number().over(W.partitionBy("group", "pool").orderBy("position")) - 1
    queued = unique.withColumn("offset", offset)
    chosen = None
    for group in groups:  # a short fixed list of languages
        mine = queued.filter(F.col("group") == group)
        if chosen is not None:
            mine = mine.join(chosen.select("_identity"), "_identity", "left_anti")
        mine = first_by(mine, ["_identity"], ["offset", "pool"]).orderBy("offset", "pool").limit(target)
        chosen = mine if chosen is None else chosen.unionByName(mine)
    return chosen.drop("_identity")


def enrich_preview(tracks: DataFrame, lookup: DataFrame) -> DataFrame:
    """New preview urls where the lookup has one, the old value otherwise."""
    new = lookup.filter(F.coalesce("preview_url", F.lit("")) != "").select("track_id", F.col("preview_url").alias("_new"))
    return tracks.join(new, "track_id", "left").withColumn("preview_url", F.coalesce("_new", "preview_url")).drop("_new")


def _key(value) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.trim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]+", " "))


def infer_subgenre(df: DataFrame, artists: DataFrame | None = None, overrides: DataFrame | None = None,
                   families=None, genre_aliases=None, seed_aliases=None, genre: str = "provider_genre") -> DataFrame:
    """Add ``subgenre``: track override, known artist, genre alias, taxonomy, seed alias, raw label.

    artists(artist, style[, position]) and overrides(artist, title, style, position) are reference tables; the
    catalogue is only joined to the few credit parts each track has.
    """
    parts = F.split(F.lower(F.coalesce("artist", F.lit(""))), r"\s*(?:&|,|/|;|\bfeat\.?\b|\bfeaturing\b|\bx\b)\s*")
    names = F.array_distinct(F.concat(F.array(_key("artist")), F.transform(parts, _key)))
    names = F.filter(names, lambda n: n != "")
    out = df
    if overrides is not None:
        o = overrides.select(_key("artist").alias("_name"), _key("title").alias("_title"), F.col("style").alias("_o"), "position")
        hits = (df.select("track_id", _key("title").alias("_t"), F.explode(names).alias("_name")).join(o, "_name")
                .filter(F.startswith("_t", "_title")).groupBy("track_id").agg(F.min_by("_o", "position").alias("_o")))
        out = out.join(hits, "track_id", "left")
    else:
        out = out.withColumn("_o", F.lit(None).cast("string"))
    if artists is not None:
        a = artists.select(_key("artist").alias("_name"), F.col("style").alias("_a"))
        hits = (df.select("track_id", F.explode(names).alias("_name")).join(a, "_name").groupBy("track_id")
                .agg(F.max_by("_a", F.struct(F.length("_name"), "_name")).alias("_a")))
        out = out.join(hits, "track_id", "left")
    else:
        out = out.withColumn("_a", F.lit(None).cast("string"))
    from tonearm.functions.style import _map
    import re
    canonical = {re.sub(r"[^a-z0-9]+", " ", s.lower()).strip(): s for s, _ in (families or tx.families())}
    g = _key(genre)
    seed = F.lower(F.trim(F.coalesce("seed_genre", F.lit(""))))
    filled = lambda name: F.when(F.coalesce(F.col(name), F.lit("")) != "", F.col(name))
    style = F.coalesce(
        "_o", "_a", F.element_at(_map(genre_aliases or tx.GENRE_ALIASES.items()), g),
        F.element_at(_map(canonical.items()), g),
        F.element_at(_map(seed_aliases or tx.SEED_ALIASES.items()), seed),
        F.lower(F.trim(F.coalesce(filled(genre), filled("seed_genre"), F.lit("Music")))))
    return out.withColumn("subgenre", style).drop("_o", "_a")


def label_counts(df: DataFrame, column: str = "subgenre") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("tracks"))


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """Last version per key wins; combined map-side."""
    return last_by(target.unionByName(changes), keys, [version])


def clear_failures(failures: DataFrame, stored: DataFrame) -> DataFrame:
    """Failures of rows that have been stored since are removed."""
    return failures.join(stored.select("track_id"), "track_id", "left_anti")


def record_failures(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """ledger(track_id, attempts, last_error, updated_at) + new(track_id, error, at) -> ledger."""
    rows = ledger.select("track_id", F.col("attempts").cast("bigint").alias("attempts"), "last_error", "updated_at").unionByName(
        new.select("track_id", F.lit(1).cast("bigint").alias("attempts"),
                   F.substring("error", 1, 400).alias("last_error"), F.col("at").alias("updated_at")))
    return rows.groupBy("track_id").agg(
        F.sum("attempts").alias("attempts"), F.max_by("last_error", "updated_at").alias("last_error"),
        F.max("updated_at").alias("updated_at"))


def index_backlog(tracks: DataFrame, fingerprints: DataFrame, limit: int | None = None, seed: int = 42) -> DataFrame:
    """Tracks with a secure preview that are not analysed yet, in a seeded order."""
    todo = (tracks.filter(F.startswith(F.coalesce("preview_url", F.lit("")), F.lit("https://")))
            .join(fingerprints.select("track_id"), "track_id", "left_anti"))
    ordered = todo.withColumn("order_key", F.sha2(F.concat(F.lit(str(seed)), "track_id"), 256))
    return ordered.orderBy("order_key").limit(limit) if limit is not None else ordered


def shortfall(indexed: int, minimum: int = 18) -> int:
    """How many more rows an index needs before it can serve."""
    return max(0, minimum - indexed)


def index_status(tracks: DataFrame, fingerprints: DataFrame, failures: DataFrame) -> DataFrame:
    one = lambda df, name: df.agg(F.count("*").alias(name))
    counts = (one(fingerprints, "indexed").crossJoin(one(tracks, "total")).crossJoin(one(failures, "failures")))
    return counts.withColumn("remaining", F.greatest(F.lit(0), F.col("total") - F.col("indexed")))


def prune_duplicates(remote: DataFrame, valid: DataFrame, favourites: DataFrame) -> DataFrame:
    """Obsolete editions: not valid, not favourited, but their recording is."""
    key = identity("title", "artist", "unicode").alias("_identity")
    recordings = valid.select(key).distinct()
    return (remote.join(valid.select("track_id"), "track_id", "left_anti")
            .join(favourites.select("track_id"), "track_id", "left_anti")
            .withColumn("_identity", key).join(recordings, "_identity", "left_semi").drop("_identity"))


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def validate_fingerprints(df: DataFrame, limit: float = 1e6) -> DataFrame:
    """Add ``reasons`` (empty = accepted) and cut text fields to their lengths."""
    v = F.col("vector")
    rules = [
        (F.coalesce(F.size(v) != schemas.VECTOR_SIZE, F.lit(True)), "vector length"),
        (~F.coalesce(F.forall(v, lambda x: _finite(x) & (F.abs(x) <= limit)), F.lit(False)), "vector values"),
    ] + [(~F.coalesce(_finite(F.col(f"profile.{n}")), F.lit(False)), f"missing {n}") for n in schemas.PROFILE_NUMERIC]
    reasons = F.filter(F.array(*[F.when(bad, F.lit(text)) for bad, text in rules]), lambda r: r.isNotNull())
    cut = [F.col(f"profile.{n}").alias(n) for n in schemas.PROFILE_NUMERIC]
    cut += [F.substring(F.coalesce(f"profile.{n}", F.lit("unknown")), 1, 240 if n == "acoustic_signature" else 64).alias(n)
            for n in schemas.PROFILE_TEXT]
    return df.withColumns({"profile": F.struct(*cut), "reasons": reasons,
                           "acoustic_signature": F.substring("acoustic_signature", 1, 240)})


def validate_embeddings(df: DataFrame, dims: int = 512, moods: int = 8) -> DataFrame:
    e, m = F.col("embedding"), F.col("mood_scores")
    rules = [
        (F.size(e) != dims, "length"), (F.exists(e, lambda x: F.abs(x) > 127), "range"),
        (~F.exists(e, lambda x: x != 0), "zero"), (F.size(m) != moods, "mood length"),
        (F.exists(m, lambda x: ~_finite(x) | (F.abs(x) > 1)), "mood values"),
        (~_finite(F.col("preview_seconds")) | ~F.col("preview_seconds").between(1, 30), "seconds"),
    ]
    listed = F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(text)) for bad, text in rules])
    return df.withColumn("reasons", F.filter(listed, lambda r: r.isNotNull()))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Count broken rules of one table in one pass: (rule, violations)."""
    counted = df.agg(*[F.count_if(bad).alias(name) for name, bad in rules.items()])
    return counted.unpivot([], list(rules), "rule", "violations")


def constraint_violations(tracks, interactions, runs, items, lyrics) -> DataFrame:
    """Value and key rules over the listener and catalogue tables."""
    reports = [
        violations(interactions, {"event_type": ~F.col("event_type").isin(schemas.EVENT_TYPES)}),
        violations(runs, {"mode": ~F.col("mode").isin(schemas.MODES)}),
        violations(items, {"score": ~F.col("score").between(0, 1), "rank": F.col("rank") <= 0}),
        violations(lyrics, {"sentiment": ~F.col("sentiment").between(-1, 1), "arousal": ~F.col("arousal").between(0, 1),
                            "confidence": ~F.col("confidence").between(0, 1)}),
        violations(tracks, {"duration": F.col("duration_ms") < 0}),
        items.join(runs.select(F.col("id").alias("run_id")), "run_id", "left_anti")
        .agg(F.count("*").alias("violations")).select(F.lit("orphan_item").alias("rule"), "violations"),
        interactions.join(tracks.select("track_id"), "track_id", "left_anti")
        .agg(F.count("*").alias("violations")).select(F.lit("orphan_interaction").alias("rule"), "violations"),
        lyrics.join(tracks.select("track_id"), "track_id", "left_anti")
        .agg(F.count("*").alias("violations")).select(F.lit("orphan_lyrics").alias("rule"), "violations"),
    ]
    return reduce(DataFrame.unionByName, reports)
