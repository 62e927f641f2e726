"""Benchmark items inside documents: size-partitioned MinHash containment search.

DataFrame code only.  Texts are compared as sets of five-word shingles over
lower-case words of letters and digits.  Documents fall into size classes
(powers of two of their shingle count).  In class k the hash space is cut into
2^(k+s) bins and a set is known by the smallest hash in each bin it touches
(one-permutation MinHash; one row per value).  A short item inside a long
document shares a bin's minimum as often as the document leaves the bin to it:
with a load of x shingles per bin that is (1 - e^-x)/x of its shingles.  ``s`` is
chosen from the smallest item so that an item at the threshold shares no value
with probability at most ``miss``.  With 2^64 bins every hash is a value and none
is missed.  Sharing one value makes a candidate; exact containment of the shingle
strings decides.

Items have one sketch per size class, for every size that an array can have.  They are broadcast while all sketches
take at most ``max_bytes``; beyond that the sketches are joined by shuffle.

Null and short texts (below five words) have no shingles: such items are found
nowhere, such documents hold nothing.  Repeated rows are one row per id in the
result (containment of the best row).  Empty tables give no pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tonearm.llm.common import table
from tonearm.session import materialize

SHINGLE = 5
THRESHOLD = 0.8
MISS = 1e-6
MAX_BYTES = 64 << 20
#: An array has less than 2^31 elements.
CLASSES = 32
SPACE = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), "")


def _runs(array: Column, size: int) -> Column:
    """Every ``size`` neighbours of an array as a struct.

    Shifted copies are zipped, so that the array may be any expression: a lambda
    that looked back into it would compute it again for each element.
    """
    shifted = [F.slice(array, F.lit(1 + j), F.greatest(F.size(array) - (size - 1), F.lit(0))).alias(f"_{j}") for j in range(size)]
    return F.arrays_zip(*shifted)


def shingle_texts(words: Column, size: int = SHINGLE) -> Column:
    """Distinct shingles as strings."""
    return F.array_distinct(F.transform(_runs(words, size), lambda r: F.concat_ws(" ", *(r[f"_{j}"] for j in range(size)))))


def with_hashes(frame: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Adds ``hashes``, the sorted shingle hashes of ``words``: each word is hashed once, a shingle combines ``size`` of them.

    The arrays that a lambda looks into are columns used several times, which
    Catalyst computes once and does not inline.
    """
    frame = frame.withColumn("__word", F.transform("words", lambda w: F.xxhash64(w)))
    combined = F.transform("__word", lambda x, i: F.xxhash64(x, *(F.get(F.col("__word"), i + j) for j in range(1, size))))
    frame = frame.withColumn("__all", F.slice(combined, F.lit(1), F.greatest(F.size("__word") - (size - 1), F.lit(0))))
    return frame.withColumn("hashes", F.sort_array("__all")).drop("__word", "__all")


def extra_bits(smallest_item: int, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """Bins per shingle, as a power of two, for an item of so many shingles."""
    must = max(1, math.ceil(threshold * smallest_item))
    wanted = 1 - miss ** (1 / must)
    bits = 0
    while bits < 63 and -math.expm1(-(2.0 ** -bits)) * 2.0 ** bits < wanted:
        bits += 1
    return bits


def _bins(bits: int) -> Column:
    """Bits that name a bin in the size class of a row."""
    return F.least(F.col("class") + bits + 1, F.lit(64))


def bin_minima(hashes: str, bits: Column) -> Column:
    """The smallest hash of each of 2^bits bins (the high bits of a hash name its bin), from a column of sorted hashes."""
    shift = F.lit(64) - bits
    return F.filter(hashes, lambda x, i: (i == 0) | (_bin(x, shift) != _bin(F.get(F.col(hashes), i - 1), shift)))


def _bin(x: Column, shift: Column) -> Column:
    return F.call_function("shiftright", x, shift)


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
              item_text_col: str = "text", threshold: float = THRESHOLD, miss: float = MISS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles for every item whose shingles a document holds to ``threshold``."""
    texts = items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).alias("text"))
    worded = texts.select("item_id", words_of(F.col("text")).alias("words"))
    known = materialize(with_hashes(worded).select("item_id", "hashes", shingle_texts(F.col("words")).alias("shingles")))
    known = known.filter(F.size("shingles") > 0)
    size = known.agg(F.min(F.size("shingles")).alias("least"), F.sum(F.size("hashes")).alias("all")).first()
    bits = extra_bits(size["least"] or 1, threshold, miss)
    classes = F.sequence(F.lit(0), F.lit(CLASSES - 1))
    sketches = (known.select("item_id", "hashes", F.explode(classes).alias("class"))
                .select("item_id", "class", F.explode_outer(bin_minima("hashes", _bins(bits))).alias("value")))
    if (size["all"] or 0) * CLASSES * 24 <= max_bytes:
        sketches = F.broadcast(sketches)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    worded = rows.select("doc_id", words_of(F.col("text")).alias("words"))
    # from the number of words and never null: a null check on a join key is pushed down and would compute the hashes again
    size_class = F.coalesce(F.ceil(F.log2(F.greatest(F.size("words") - (SHINGLE - 1), F.lit(1)).cast("double"))).cast("int"), F.lit(0))
    classed = with_hashes(worded.withColumn("class", size_class)).select("doc_id", "class", "hashes")
    # outer: a plain explode gets an inferred filter below it that would compute the arrays again
    values = classed.select("doc_id", "class", F.explode_outer(bin_minima("hashes", _bins(bits))).alias("value"))
    pairs = materialize(values.join(sketches, ["class", "value"]).select("doc_id", "item_id").distinct())

    per_doc = pairs.groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_set("item_id").alias("items"))
    held = (rows.join(per_doc, rows["doc_id"].eqNullSafe(per_doc["__doc"]))
            .select("doc_id", words_of(F.col("text")).alias("words"), "items")
            .select("doc_id", shingle_texts(F.col("words")).alias("held"), "items")
            .select("doc_id", "held", F.explode("items").alias("item_id")))
    sets = known.select("item_id", "shingles")
    both = held.join(sets, "item_id").select("doc_id", "item_id", F.size("shingles").cast("long").alias("n_shingles"),
                                             F.size(F.array_intersect("held", "shingles")).cast("long").alias("n_shared"))
    best = both.groupBy("doc_id", "item_id", "n_shingles").agg(F.max("n_shared").alias("n_shared"))
    return best.filter(F.col("n_shared") >= F.lit(threshold) * F.col("n_shingles"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` without a benchmark item, with all their columns."""
    found = contained(docs, items, id_col, text_col, **how).select(F.col("doc_id").alias("__found")).distinct()
    return docs.join(found, docs[id_col].eqNullSafe(found["__found"]), "left_anti")


def op4_benchmark_leaks(spark, folder):
    return contained(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def leaks_sql(source: str, name: str = "leaks") -> str:
    """DuckDB common tables: ``{name}`` with every item that a row of ``source`` holds."""
    def shingled(table_name, key):
        return rf"""
    {name}_{key}_words AS (SELECT {key}, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM {table_name}),
    {name}_{key}_tokens AS (SELECT {key}, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS p FROM {name}_{key}_words),
    {name}_{key} AS (SELECT DISTINCT {key}, s FROM (SELECT {key}, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' '
        || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS s FROM {name}_{key}_tokens WINDOW o AS (PARTITION BY {key} ORDER BY p)) WHERE s IS NOT NULL)"""
    return rf"""{shingled(source, 'doc_id')}, {shingled('benchmark', 'item_id')},
    {name}_size AS (SELECT item_id, count(*) AS n_shingles FROM {name}_item_id GROUP BY item_id),
    {name}_shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM {name}_doc_id JOIN {name}_item_id USING (s) GROUP BY doc_id, item_id),
    {name} AS (SELECT doc_id, item_id, n_shingles, n_shared FROM {name}_shared JOIN {name}_size USING (item_id) WHERE n_shared >= {THRESHOLD} * n_shingles)"""


QUERIES = {"op4_benchmark_leaks": op4_benchmark_leaks}
ORACLE = {"op4_benchmark_leaks": f"WITH {leaks_sql('documents')} SELECT doc_id, item_id, n_shingles, n_shared FROM leaks"}
