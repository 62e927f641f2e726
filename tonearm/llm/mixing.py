"""Mixing sources to target weights: whole epochs, then an exponential-key sample.

Everything is DataFrame code.  Each source gets a target of words; the share
above what a source may give (``max_epochs`` times its size) is spread over the
others by weight until none is above.  A source gives every document once per
complete epoch, and the rest of its target in the order of exponential keys
-ln(u)/w (w: quality weight), by prefix sums of sizes; the document at the
border gives the words still missing.  ``u`` comes from a digest of the id, so
reruns agree.

Prefix sums never sort a whole source in one task: keys are cut into ranges
of about ``rows_per_range`` rows per source, summed per range first.

Null texts have size 0, null sources are one source (last in order), null ids
share one ``u``; rows with equal keys are ordered by id and text digest, so only
identical rows can change places.  Without words every target is 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tonearm.llm.common import n_words, table
from tonearm.operators.catalogue import ranked
from tonearm.session import materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
ROWS_PER_RANGE = 4096
SEED = "mix"


def uniform(id_col: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from 48 bits of a digest of the id."""
    digest = F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(id_col.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, n_docs, source_size, target from rows (source, n_docs, source_size).

    Each round shares what the capped sources leave by weight; it ends when no
    further source is above its cap.  A round is one aggregation over sources.
    """
    order = F.col("source").asc_nulls_last()
    w = reduce(lambda c, kv: c.when(F.col("position") % len(weights) == kv[0], F.lit(float(kv[1]))),
               list(enumerate(weights))[1:], F.when(F.col("position") % len(weights) == 0, F.lit(float(weights[0]))))
    sources = materialize(ranked(sizes, order).withColumn("w", w).withColumn("cap", max_epochs * F.col("source_size")))
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        above = F.col("cap") <= F.lit(level) * F.col("w") if capped >= 0 else F.lit(False)
        row = sources.agg(F.sum(F.when(above, F.col("cap"))).alias("caps"), F.sum(F.when(~above, F.col("w"))).alias("w"),
                          F.count(F.when(above, 1)).alias("n")).first()
        if row["n"] == capped or not row["w"]:
            break
        capped, level = row["n"], (total - (row["caps"] or 0)) / row["w"]
    target = F.when(F.col("cap") <= F.lit(level) * F.col("w"), F.col("cap").cast("double")).otherwise(F.lit(level) * F.col("w"))
    return sources.select("source", "n_docs", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        quality: DataFrame | None = None, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS,
        rows_per_range: int = ROWS_PER_RANGE, seed: str = SEED) -> DataFrame:
    """doc_id, size, source, source_size, target, taken of every row of ``docs``.

    ``quality``: positive quality weights (doc_id, weight), one row per id; a
    document that is not in it weighs 1.  It is joined after the texts are left out.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"),
                        F.xxhash64(F.col(text_col)).alias("digest"), (-F.log(uniform(F.col(id_col), seed))).alias("key"))
    if quality is not None:
        rated = quality.select(F.col("doc_id").alias("__rated"), F.col("weight").cast("double").alias("weight"))
        sized = (sized.join(rated, sized["doc_id"] == rated["__rated"], "left")
                 .withColumn("key", F.col("key") / F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.lit(1.0))).drop("__rated", "weight"))
    sized = materialize(sized)
    totals = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    plan = materialize(source_targets(totals, weights, share, max_epochs)).withColumnRenamed("source", "__source")
    ranges = F.ceil(F.col("n_docs") / F.lit(rows_per_range)).cast("long")
    placed = (sized.join(plan, sized["source"].eqNullSafe(plan["__source"])).drop("__source")
              .withColumn("range", F.least(F.floor((1 - F.exp(-F.col("key"))) * ranges), ranges - 1)))
    rows = placed.withColumn("within", F.sum("size").over(
        W.partitionBy("source", "range").orderBy("key", "doc_id", "digest").rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    sums = placed.groupBy("source", "range").agg(F.sum("size").alias("words"))
    starts = sums.select(F.col("source").alias("__source"), F.col("range").alias("__range"), (F.sum("words").over(
        W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, 0)) - F.col("words")).alias("start"))
    rows = rows.join(starts, rows["source"].eqNullSafe(starts["__source"]) & (rows["range"] == starts["__range"]))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.floor(F.col("target") - epochs * F.col("source_size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start") - F.col("within")))
    return rows.select("doc_id", "size", "source", "source_size", "target",
                       (epochs * F.col("size") + part).cast("long").alias("taken"))


def label_weights(labels: DataFrame) -> DataFrame:
    """doc_id, weight: 2 for the documents that a label calls good."""
    return labels.filter(F.col("quality") == 1).groupBy("doc_id").agg(F.lit(2.0).alias("weight"))


def op10_mix_sources(spark, folder):
    quality = label_weights(table(spark, folder, "labels"))
    return mix(table(spark, folder, "documents"), quality=quality).select("doc_id", "size", "source_size", "target", "taken")


def mix_sql(source: str, name: str = "mixed") -> str:
    """DuckDB common tables: ``{name}`` with the same columns over the rows of ``source``."""
    return rf"""
    {name}_sized AS (SELECT d.doc_id, d.source, CAST(len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
        -ln((CAST('0x' || substr(md5('{SEED}:' || CAST(d.doc_id AS VARCHAR)), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0)
        / CASE WHEN g.doc_id IS NULL THEN 1.0 ELSE 2.0 END AS key
        FROM {source} d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) g USING (doc_id)),
    {name}_sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS s,
        CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END AS w
        FROM {name}_sized GROUP BY source),
    {name}_steps AS (SELECT *, 2 * s / CAST(w AS DOUBLE) AS ratio, sum(CAST(w AS DOUBLE)) OVER () - sum(CAST(w AS DOUBLE)) OVER o AS w_left,
        sum(2 * s) OVER o AS caps, sum(s) OVER () AS total FROM {name}_sources
        WINDOW o AS (ORDER BY 2 * s / CAST(w AS DOUBLE), source ROWS UNBOUNDED PRECEDING)),
    {name}_levels AS (SELECT CAST(0 AS BIGINT) AS k, (SELECT 1.5 * sum(s) / sum(CAST(w AS DOUBLE)) FROM {name}_sources) AS level,
        (SELECT min(ratio) FROM {name}_steps) AS next
        UNION ALL SELECT row_number() OVER (ORDER BY ratio, source), (CAST(1.5 AS DOUBLE) * total - caps) / w_left, lead(ratio) OVER (ORDER BY ratio, source)
        FROM {name}_steps),
    {name}_level AS (SELECT CAST(level AS DOUBLE) AS level FROM {name}_levels WHERE next IS NOT NULL AND next > level ORDER BY k LIMIT 1),
    {name}_targets AS (SELECT source, s, CASE WHEN 2 * s <= level * CAST(w AS DOUBLE) THEN CAST(2 * s AS DOUBLE) ELSE level * CAST(w AS DOUBLE) END AS target
        FROM {name}_sources, {name}_level),
    {name}_order AS (SELECT z.doc_id, z.source, z.size, t.s AS source_size, t.target,
        sum(z.size) OVER (PARTITION BY z.source ORDER BY z.key, z.doc_id ROWS UNBOUNDED PRECEDING) - z.size AS before
        FROM {name}_sized z JOIN {name}_targets t ON z.source IS NOT DISTINCT FROM t.source),
    {name}_epochs AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS e FROM {name}_order),
    {name} AS (SELECT doc_id, size, source, source_size, target, CAST(e * size + greatest(0, least(size,
        floor(target - e * source_size) - before)) AS BIGINT) AS taken FROM {name}_epochs)"""


QUERIES = {"op10_mix_sources": op10_mix_sources}
ORACLE = {"op10_mix_sources": f"WITH {mix_sql('documents')} SELECT doc_id, size, source_size, target, taken FROM mixed"}
