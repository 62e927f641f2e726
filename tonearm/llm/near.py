"""Near duplicates: Jaccard join of word shingles with MinHash banding of fixed depth.

Each distinct set of five-word shingles gets ``TREES`` bands of MinHash values;
two sets match if all values of a band are equal.  The depth of a band is fixed
before any data is read: the longest k for which the expected share of pairs at
the threshold that match in some band, 1 - (1 - t^k)^trees, reaches ``recall``
(4 of at most 8 here; such a pair is missed with probability 2.6e-5).  There are
no tries and no longer prefixes, and the recall is not measured on the data.

Matches are not expanded into pairs.  A band value links its sets to one of them;
the connected clusters are candidates, and each set's shingles travel once per
cell of its cluster.  A cell holds two blocks of a cluster (at most about
``block_shingles`` shingles and ``block_sets`` sets each); it computes the exact
Jaccard similarity of all its pairs by matrix products and returns, for each set,
the number of linked texts, and a spanning forest of the links.  So no link
between matched texts is lost and no group is written out as pairs.  The work
in a cluster grows with the square of its size, in cells of fixed size.

Texts of one to four words have one shingle, all of their words.  Null texts and
texts without words are alone in their class.  Exact copies share a class and
count as one text in ``n_links``.  Null ids come last.  Repeated rows are rows of
the same class.  Shingles are compared by 64-bit hashes; texts and sets by 128 bits.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tonearm.llm.common import Rolling, U64, WordHashes, as_bytes, fresh, table
from tonearm.llm.components import components
from tonearm.session import materialize

SHINGLE = 5
THRESHOLD = 0.8
TREES, DEPTH = 20, 8
RECALL = 0.9999
BLOCK_SETS = 512
BLOCK_SHINGLES = 2_000_000
LAST = (1 << 63) - 1


def prefix_length(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which the forest finds pairs at the threshold with probability ``recall``."""
    for k in range(depth, 1, -1):
        if 1 - (1 - threshold ** k) ** trees >= recall:
            return k
    return 1


class Shingler:
    def __init__(self):
        self.words, self.rolling = WordHashes(), Rolling()

    def of(self, text: bytes) -> np.ndarray:
        """Sorted distinct shingle hashes of a text."""
        words = text.split()
        if not words:
            return np.zeros(0, U64)
        prefix = self.rolling.prefix(self.words.of(words))
        return np.unique(self.rolling.windows(prefix, min(SHINGLE, len(words))))


class Forest:
    """Labels of shingle sets: ``depth`` MinHash values per tree, kept as one key per tree."""

    def __init__(self, trees: int, depth: int, seed: int = 7):
        self.trees, self.depth = trees, depth
        self.factors = np.random.default_rng(seed).integers(1, 1 << 63, trees * depth, dtype=np.uint64) * U64(2) + U64(1)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(len(self.factors), ~U64(0), U64)
        for at in range(0, len(shingles), 8192):
            np.minimum(out, (shingles[at:at + 8192, None] * self.factors[None, :]).min(0), out=out)
        return out

    def keys(self, shingles: np.ndarray) -> list[int]:
        """A key for each tree's prefix; equal prefixes of different trees have different keys."""
        values = self.minima(shingles).reshape(self.trees, self.depth)
        return [xxhash.xxh3_64_intdigest(row.tobytes(), seed=t + 1) - (1 << 63) for t, row in enumerate(values)]


SKETCH = "doc_id long, text_hash long, text_key binary, set_key binary, n_shingles long, trees array<long>"


def sketches(docs: DataFrame, id_col: str, text_col: str, trees: int, depth: int) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("text_key", pa.binary()), ("set_key", pa.binary()),
                        ("n_shingles", pa.int64()), ("trees", pa.list_(pa.int64()))])

    def run(batches):
        shingler, forest = Shingler(), Forest(trees, depth)
        for batch in batches:
            rows = []
            for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))):
                found = shingler.of(text or b"")
                rows.append((doc, key, xxhash.xxh3_128_digest(text or b""), xxhash.xxh3_128_digest(found.tobytes()), len(found),
                             forest.keys(found) if len(found) else []))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return _keyed(docs, id_col, text_col).mapInArrow(run, SKETCH)


def _keyed(docs, id_col, text_col):
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"),
                       F.col(text_col).alias("text"))


def _links(left: list, right: list | None, threshold: float) -> np.ndarray:
    """Boolean matrix: the exact Jaccard similarity of left and right sets reaches the threshold."""
    other = left if right is None else right
    sizes, other_sizes = np.array([len(x) for x in left]), np.array([len(x) for x in other])
    shared = np.zeros((len(left), len(other)), np.int64)
    if len(left) * len(other) <= 64:
        for i, x in enumerate(left):
            for j, y in enumerate(other):
                if (right is not None or i < j) and min(len(x), len(y)) >= threshold * max(len(x), len(y)) - 1e-9:
                    shared[i, j] = np.intersect1d(x, y, assume_unique=True).size
        if right is None:
            shared += shared.T
    else:
        everything = left if right is None else left + right
        values, columns = np.unique(np.concatenate(everything), return_inverse=True)
        often = np.bincount(columns, minlength=len(values)) > 1
        number = np.cumsum(often) - 1
        rows = np.repeat(np.arange(len(everything)), [len(x) for x in everything])
        kept = often[columns]
        rows, columns = rows[kept], number[columns[kept]]
        order = np.argsort(columns, kind="stable")
        rows, columns = rows[order], columns[order]
        width = max(256, min(4096, (8 << 20) // len(everything)))
        total = int(often.sum())
        exact = np.zeros(shared.shape, np.float64)
        for at in range(0, total, width):
            a, b = np.searchsorted(columns, [at, at + width])
            tile = np.zeros((len(everything), min(width, total - at)), np.float32)
            tile[rows[a:b], columns[a:b] - at] = 1
            exact += tile[:len(left)] @ (tile if right is None else tile[len(left):]).T
        shared = exact.astype(np.int64)
    union = sizes[:, None] + other_sizes[None, :] - shared
    linked = shared >= threshold * union - 1e-9
    if right is None:
        np.fill_diagonal(linked, False)
    return linked


def _forest_edges(linked: np.ndarray, square: bool):
    """(row, column) pairs that span the links: at most as many as there are sets."""
    n, m = linked.shape
    todo_rows, todo_columns = np.ones(n, bool), np.ones(m, bool)
    for root in range(n):
        if not todo_rows[root]:
            continue
        todo_rows[root] = False
        if square:
            todo_columns[root] = False
        stack = [(root, True)]
        while stack:
            at, is_row = stack.pop()
            if is_row:
                new = np.flatnonzero(linked[at] & todo_columns)
                todo_columns[new] = False
                if square:
                    todo_rows[new] = False
                for j in new:
                    yield at, j
                    stack.append((j, square))
            else:
                new = np.flatnonzero(linked[:, at] & todo_rows)
                todo_rows[new] = False
                for i in new:
                    yield i, at
                    stack.append((i, True))


def _judge_cell(rows: list, square: bool, threshold: float):
    """Rows (set, other or None, linked texts) of a cell; ``rows``: (second side, set key, texts, shingles)."""
    rows = [*{(r[0], r[1]): r for r in rows}.values()]
    left = [r for r in rows if not r[0]]
    right = None if square else [r for r in rows if r[0]]
    if not left or (right is not None and not right):
        return
    linked = _links([r[3] for r in left], None if square else [r[3] for r in right], threshold)
    other = left if square else right
    texts, other_texts = np.array([r[2] for r in left], np.int64), np.array([r[2] for r in other], np.int64)
    for row, n in zip(left, linked @ other_texts):
        if n:
            yield row[1], None, int(n)
    if not square:
        for row, n in zip(right, texts @ linked):
            if n:
                yield row[1], None, int(n)
    for i, j in _forest_edges(linked, square):
        yield left[i][1], other[j][1], 0


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, trees: int = TREES,
                    recall: float = RECALL, block_sets: int = BLOCK_SETS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, text_hash, text_class, class_id, n_links of every row.

    text_class: smallest id with the same text.  class_id: smallest id of the
    connected class of links.  n_links: other texts at the threshold or above.
    """
    depth = prefix_length(threshold, trees, recall=recall)
    rows = materialize(sketches(docs, id_col, text_col, trees, depth))
    texts = rows.filter("n_shingles > 0").groupBy("set_key", "text_key").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("first"), F.first("trees").alias("trees"), F.first("n_shingles").alias("n_shingles"))
    texts = materialize(texts)
    sets = materialize(texts.groupBy("set_key").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("texts"), F.first("trees").alias("trees"),
                                                    F.first("n_shingles").alias("n_shingles")).withColumn("node", F.xxhash64("set_key")))
    nodes = sets.select("node", F.explode("trees").alias("key"))
    hubs = nodes.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub < last").drop("last")
    candidates = nodes.join(hubs, "key").filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    clusters = materialize(components(candidates))
    members = materialize(sets.join(clusters, "node").select("set_key", "first", "texts", "n_shingles", F.col("component").alias("cluster")))
    found = materialize(_verified(docs, members, id_col, text_col, threshold, block_sets, block_shingles))
    links = found.filter("other IS NULL").groupBy("set_key").agg(F.sum("linked").alias("linked"))
    classes = components(found.filter("other IS NOT NULL").select(F.col("set_key").alias("a"), F.col("other").alias("b")))
    placed = sets.select("set_key", "first", "texts").join(classes.withColumnRenamed("node", "set_key"), "set_key", "left")
    placed = placed.withColumn("component", F.coalesce("component", "set_key"))
    keepers = placed.groupBy("component").agg(F.min("first").alias("keeper"))
    info = placed.join(keepers, "component").join(links, "set_key", "left").select(
        "set_key", "keeper", (F.coalesce("linked", F.lit(0)) + F.col("texts") - 1).alias("n_links"))
    of_text = texts.select("set_key", "text_key", F.col("first.doc_id").alias("text_class")).join(info, "set_key")
    own = F.struct("doc_id", "text_hash")
    return (rows.join(of_text, ["set_key", "text_key"], "left")
            .select("doc_id", "text_hash", F.coalesce("text_class", "doc_id").alias("text_class"), F.coalesce("keeper.doc_id", "doc_id").alias("class_id"),
                    F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (F.coalesce("keeper", own) == own).alias("stays")))


def _verified(docs, members, id_col, text_col, threshold, block_sets, block_shingles):
    """(set_key, other, linked): linked texts per set and cell, and spanning links."""
    size = members.groupBy("cluster").agg(F.ceil(F.greatest(F.sum("n_shingles") / block_shingles, F.count(F.lit(1)) / block_sets)).cast("int").alias("blocks"))
    placed = members.join(size, "cluster").select("set_key", "texts", "cluster", "blocks", F.col("first.doc_id").alias("doc_id"),
                                                  F.col("first.text_hash").alias("text_hash"),
                                                  F.pmod(F.xxhash64("set_key", F.lit("block")), F.col("blocks")).cast("int").alias("block"))
    joined = _keyed(docs, id_col, text_col).join(placed, ["doc_id", "text_hash"])
    plain = pa.schema([("cluster", pa.int64()), ("block", pa.int32()), ("blocks", pa.int32()), ("set_key", pa.binary()), ("texts", pa.int64()), ("shingles", pa.binary())])
    out = pa.schema([("set_key", pa.binary()), ("other", pa.binary()), ("linked", pa.int64())])

    def shingle(batches):
        shingler = Shingler()
        for batch in batches:
            texts = [shingler.of(t).tobytes() for t in as_bytes(batch.column(5))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(texts, pa.binary())], names=plain.names)

    def judge(batches):
        def stream():
            for batch in batches:
                for i in range(batch.num_rows):
                    yield [c[i].as_py() for c in batch.columns]

        kept = []
        for (_, i, j), group in groupby(stream(), key=lambda r: tuple(r[:3])):
            cell = [(r[3], r[4], r[5], np.frombuffer(r[6], U64)) for r in group]
            kept += _judge_cell(cell, i == j, threshold)
            if len(kept) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept), out)], schema=out)
                kept = []
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept), out)], schema=out)

    packed = joined.select("cluster", "block", "blocks", "set_key", "texts", "text").mapInArrow(
        shingle, "cluster long, block int, blocks int, set_key binary, texts long, shingles binary")
    cells = packed.select("cluster", "set_key", "texts", "shingles", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    i, j = F.least("block", "with"), F.greatest("block", "with")
    cells = cells.select("cluster", i.alias("i"), j.alias("j"), ((F.col("block") == j) & (i != j)).alias("second"), "set_key", "texts", "shingles")
    return cells.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(judge, "set_key binary, other binary, linked long")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each class: that with the smallest id (of repeated rows, one)."""
    own, text, other, hashed = fresh(docs, "__own", "__text", "__id", "__hash")
    stays = near_duplicates(docs, id_col, text_col, **how).filter("stays").select(
        F.col("doc_id").alias(other), F.col("text_hash").alias(hashed)).distinct()
    keyed = docs.withColumns({own: F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), text: F.xxhash64(F.col(text_col))})
    kept = keyed.join(stays, (keyed[own] == stays[other]) & (keyed[text] == stays[hashed]), "left_semi")
    return kept.dropDuplicates([own, text]).drop(own, text)


def op7_near_duplicates(spark, folder):
    return near_duplicates(table(spark, folder, "documents")).select("doc_id", "text_class", "class_id", "n_links")


def near_sql(source: str, name: str = "near") -> str:
    """DuckDB common tables (the first is recursive): ``{name}`` with the classes of every row of ``source``."""
    gram = " || chr(1) || ".join(f"lead(w, {i}) OVER o" if i else "w" for i in range(SHINGLE))
    return rf"""
    {name}_texts AS (SELECT text, min(doc_id) AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM {source} GROUP BY text),
    {name}_tokens AS (SELECT t, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS p FROM {name}_texts WHERE len(words) >= {SHINGLE}),
    {name}_grams AS (SELECT DISTINCT t, s FROM (SELECT t, {gram} AS s FROM {name}_tokens WINDOW o AS (PARTITION BY t ORDER BY p)) WHERE s IS NOT NULL
        UNION ALL SELECT t, array_to_string(words, chr(1)) FROM {name}_texts WHERE len(words) BETWEEN 1 AND {SHINGLE - 1}),
    {name}_sizes AS (SELECT t, count(*) AS n FROM {name}_grams GROUP BY t),
    {name}_shared AS (SELECT a.t AS a, b.t AS b, count(*) AS n FROM {name}_grams a JOIN {name}_grams b ON a.s = b.s AND a.t <> b.t GROUP BY a.t, b.t),
    {name}_links AS (SELECT s.a, s.b FROM {name}_shared s JOIN {name}_sizes x ON s.a = x.t JOIN {name}_sizes y ON s.b = y.t
        WHERE s.n * 5 >= 4 * (x.n + y.n - s.n)),
    {name}_reach AS (SELECT t AS a, t AS b FROM {name}_texts UNION SELECT r.a, l.b FROM {name}_reach r JOIN {name}_links l ON r.b = l.a),
    {name}_class AS (SELECT a, min(b) AS class_id FROM {name}_reach GROUP BY a),
    {name}_degree AS (SELECT a, count(*) AS n_links FROM {name}_links GROUP BY a),
    {name} AS (SELECT d.doc_id, CASE WHEN len(x.words) > 0 THEN x.t ELSE d.doc_id END AS text_class,
        CASE WHEN len(x.words) > 0 THEN c.class_id ELSE d.doc_id END AS class_id, CAST(coalesce(g.n_links, 0) AS BIGINT) AS n_links
        FROM {source} d JOIN {name}_texts x ON d.text IS NOT DISTINCT FROM x.text JOIN {name}_class c ON c.a = x.t LEFT JOIN {name}_degree g ON g.a = x.t)"""


QUERIES = {"op7_near_duplicates": op7_near_duplicates}
ORACLE = {"op7_near_duplicates": f"WITH RECURSIVE {near_sql('documents')} SELECT doc_id, text_class, class_id, n_links FROM near"}
