"""Frequent lines by levelled sorted runs of line hashes.

A line's key is the line without white space at its ends, A-Z lower-cased; it
travels as a 128-bit hash.  ``LineRuns`` keeps what earlier batches of documents
held as *runs*: tables of (hash, number of documents), bucketed and sorted by
hash, so that runs and batches meet in merge joins without moving the runs.
Each new batch is merge-anti-joined with the *settled* runs (keys already known
to be frequent need no more counting) and adds the rest as a run of its own.  When
a level has ``fanout`` runs they are compacted into one run of the next level:
counts are summed, and keys that have reached ``min_docs`` move to the settled
runs.  A row of counts is thus written once per level, and the number of runs
grows with the logarithm of the number of batches.

The runs are files in the shared folder; what is known of them is in ``manifest``,
with which a later session goes on (``LineRuns.reopened``).

Every row of a table is a document: rows with the same id and repeated rows count
each; null ids are documents as well.  A null or empty text is one empty line.
Keys without code points are never frequent.  A text of any length is one task's
row.  Empty tables give empty results.  Only the id and the text are read.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from tonearm.llm.common import U64, as_bytes, table
from tonearm.session import checkpoint_dir, materialize

MIN_DOCS, FANOUT, BATCHES = 10, 3, 6
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
FLUSH_KEYS = 300_000
#: Rows of a run per bucket (the first where there are fewer buckets than shuffle partitions, the second always), and
#: bytes of frequent keys that may go to all tasks.
BUCKET_ROWS = (100_000, 4_000_000)
SENT_BYTES = 32 << 20


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()  # bytes.lower() changes A-Z only


class Digests(dict):
    """line -> 128-bit hash of its key (0: no key), computed once per distinct line; emptied when full."""

    def __init__(self, most: int = 200_000, longest: int = 1000):
        self.most, self.longest = most, longest

    def __missing__(self, line):
        key = line_key(line)
        value = xxhash.xxh3_128_intdigest(key) or 1 if key else 0
        if len(line) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[line] = value
        return value


def _halves(digests: list[int]) -> tuple[np.ndarray, np.ndarray]:
    low = (1 << 64) - 1
    n = len(digests)
    return (np.fromiter((d >> 64 for d in digests), U64, n).view(np.int64), np.fromiter((d & low for d in digests), U64, n).view(np.int64))


def line_counts(docs: DataFrame, text_col: str = "text", batch: str | None = None) -> DataFrame:
    """batch, h1, h2, n: how many documents hold a line key, summed within tasks (a key can come from several).

    ``batch`` names an integer column that deals documents into batches; 0 without it.
    """
    schema = pa.schema([("batch", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64())])

    def emit(total):
        batches, digests = [*zip(*total)] or ((), ())
        return pa.RecordBatch.from_arrays([pa.array(batches, pa.int32()), *map(pa.array, _halves(digests)), pa.array(list(total.values()), pa.int64())], schema=schema)

    def count(batches):
        digest, total = Digests(), Counter()
        for rows in batches:
            for at in range(0, rows.num_rows, 256):
                part = rows.slice(at, 256)
                for number, text in zip(part.column(0).to_pylist(), as_bytes(part.column(1))):
                    keys = {digest[line] for line in text.split(b"\n")}
                    keys.discard(0)
                    total.update((number, key) for key in keys)
                if len(total) > FLUSH_KEYS:
                    yield emit(total)
                    total.clear()
        yield emit(total)

    number = F.coalesce(F.col(batch).cast("int"), F.lit(0)) if batch else F.lit(0)
    return docs.filter(F.length(F.col(text_col)) > 0).select(number.alias("batch"), F.col(text_col).alias("text")).mapInArrow(
        count, "batch int, h1 long, h2 long, n long")


class LineRuns:
    """Levels of sorted runs of (h1, h2, n), and settled runs of (h1, h2)."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT, buckets: int | None = None, folder: str | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/line-runs-{uuid.uuid4().hex}"
        self.levels: list[list[str]] = [[]]
        self.settled: list[str] = []

    @property
    def manifest(self) -> dict:
        """All that a later session needs."""
        return {"folder": self.folder, "min_docs": self.min_docs, "fanout": self.fanout, "buckets": self.buckets,
                "levels": [list(level) for level in self.levels], "settled": list(self.settled)}

    @classmethod
    def reopened(cls, spark: SparkSession, manifest: dict) -> "LineRuns":
        runs = cls(spark, manifest["min_docs"], manifest["fanout"], manifest["buckets"], manifest["folder"])
        runs.levels, runs.settled = [list(level) for level in manifest["levels"]], list(manifest["settled"])
        for name in [*runs.settled, *(n for level in runs.levels for n in level)]:
            columns = "h1 BIGINT, h2 BIGINT" + ("" if name in runs.settled else ", n BIGINT")
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {runs.buckets} BUCKETS "
                      f"LOCATION '{runs.folder}/{name}'")
        return runs

    def _write(self, frame: DataFrame) -> str:
        """A sorted run: one file per bucket."""
        name = f"line_run_{uuid.uuid4().hex}"
        (frame.sortWithinPartitions("h1", "h2").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
         .option("path", f"{self.folder}/{name}").format("parquet").saveAsTable(name))
        return name

    def _dealt(self, frame: DataFrame) -> DataFrame:
        """Counts by key, placed as the buckets of the runs are."""
        return frame.repartition(self.buckets, "h1", "h2").groupBy("h1", "h2").agg(F.sum("n").alias("n"))

    def _open(self, counts: DataFrame) -> DataFrame:
        """Without the keys that are settled: a merge anti-join with each settled run."""
        for name in self.settled:
            counts = counts.join(self.spark.table(name).hint("merge"), ["h1", "h2"], "left_anti")
        return counts

    def _settle(self, counts: DataFrame, level: int) -> None:
        """Frequent keys become a settled run, the others a run of ``level``."""
        counts = materialize(counts)  # read twice
        frequent = counts.filter(F.col("n") >= self.min_docs).select("h1", "h2")
        if not frequent.isEmpty():
            self.settled.append(self._write(frequent.repartition(self.buckets, "h1", "h2")))
        self.levels[level].append(self._write(counts.filter(F.col("n") < self.min_docs).repartition(self.buckets, "h1", "h2")))
        if len(self.settled) > self.fanout:
            merged = self._union(self.settled).distinct().repartition(self.buckets, "h1", "h2")
            self.settled = [self._write(merged)]

    def _union(self, names: list[str]) -> DataFrame:
        """All rows of some runs, read as plain files: their buckets are dealt anew."""
        return self.spark.read.schema(self.spark.table(names[0]).schema).parquet(*(f"{self.folder}/{name}" for name in names))

    def add(self, counts: DataFrame) -> None:
        """A new batch: rows (h1, h2, n) of ``line_counts``."""
        self._settle(self._open(self._dealt(counts.select("h1", "h2", "n"))), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self.compact(level)
            level += 1

    def compact(self, level: int) -> None:
        """The runs of a level become one run of the next."""
        names, self.levels[level] = self.levels[level], []
        if level + 1 == len(self.levels):
            self.levels.append([])
        self._settle(self._open(self._dealt(self._union(names))), level + 1)

    def frequent(self) -> DataFrame:
        """h1, h2 of all keys that at least ``min_docs`` documents hold."""
        names = [n for level in self.levels for n in level]
        found = [self._union(self.settled).distinct()] if self.settled else []
        if names:
            found.append(self._open(self._dealt(self._union(names))).filter(F.col("n") >= self.min_docs).select("h1", "h2"))
        if not found:
            return self.spark.createDataFrame([], "h1 long, h2 long")
        return found[0].unionByName(found[1]) if len(found) == 2 else found[0]


class KeySet:
    """Frequent keys as arrays sorted by their first half."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray):
        order = np.lexsort((h2, h1))
        self.h1, self.h2 = h1[order], h2[order]

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out, row = np.zeros(len(h1), bool), np.arange(len(h1))
        at = np.searchsorted(self.h1, h1)
        while len(row):  # once, but for keys that share a half
            row = row[at[row] < len(self.h1)]
            row = row[self.h1[at[row]] == h1[row]]
            out[row] |= self.h2[at[row]] == h2[row]
            at[row] += 1
        return out


REPORT = "text string, n_lines long, n_dropped long"


def _cut(texts: list, digest: Digests, gone) -> pa.RecordBatch:
    """text, n_lines, n_dropped; ``gone(row of each line, digests)`` tells which lines go."""
    lines = [text.split(b"\n") if text else [b""] for text in texts]
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    digests = [digest[line] for part in lines for line in part]
    drop = gone(np.repeat(np.arange(len(lines)), sizes), digests)
    dropped = np.add.reduceat(drop, np.cumsum(sizes) - sizes, dtype=np.int64) if len(lines) else np.zeros(0, np.int64)
    kept, at = [], 0
    for text, part, n in zip(texts, lines, dropped.tolist()):
        kept.append(text if not n else b"\n".join(line for line, d in zip(part, drop[at:at + len(part)].tolist()) if not d))
        at += len(part)
    return pa.RecordBatch.from_arrays([pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sizes), pa.array(dropped)], names=["text", "n_lines", "n_dropped"])


def drop_lines(docs: DataFrame, frequent: DataFrame, id_col: str = "doc_id", text_col: str = "text", sent_bytes: int = SENT_BYTES) -> DataFrame:
    """doc_id, text, n_lines, n_dropped of every row: the text without the lines whose key is in ``frequent`` (h1, h2).

    Up to ``sent_bytes`` of keys go to all tasks; beyond, the documents' keys are joined to them.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    frequent = materialize(frequent)
    if frequent.count() * 16 <= sent_bytes:
        keys = frequent.toArrow()
        shared = rows.sparkSession.sparkContext.broadcast(KeySet(*(keys.column(c).to_numpy() for c in ("h1", "h2"))))

        def clean(batches):
            digest, known = Digests(), shared.value
            for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
                out = _cut(as_bytes(batch.column(1)), digest, lambda _, digests: known.has(*_halves(digests)))
                yield pa.RecordBatch.from_arrays([batch.column(0), *out.columns], names=["doc_id", *out.schema.names])

        return rows.mapInArrow(clean, f"doc_id {kind}, {REPORT}")
    return _dropped_by_join(rows, frequent, kind)


def _dropped_by_join(rows: DataFrame, frequent: DataFrame, kind: str) -> DataFrame:
    """``drop_lines`` for any number of frequent keys: each document gets its own."""
    pair = pa.schema([("doc", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])

    def keys(batches):
        digest = Digests()
        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            owners, digests = [], []
            for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                found = {digest[line] for line in text.split(b"\n")} - {0}
                owners += [doc] * len(found)
                digests += found
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), *map(pa.array, _halves(digests))], schema=pair)

    def clean(batches):
        digest = Digests()
        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            known = []
            for own in batch.column(2).to_pylist():
                known.append({((k["h1"] & (1 << 64) - 1) << 64) | (k["h2"] & (1 << 64) - 1) for k in own or ()})
            out = _cut(as_bytes(batch.column(1)), digest, lambda at, digests: np.fromiter((d in known[i] for i, d in zip(at.tolist(), digests)), bool, len(digests)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *out.columns], names=["doc_id", *out.schema.names])

    # rows with one text have the same lines
    keyed = rows.withColumn("doc", F.xxhash64("text"))
    pairs = keyed.filter(F.length("text") > 0).select("doc", "text").mapInArrow(keys, "doc long, h1 long, h2 long").distinct()
    own = pairs.join(frequent, ["h1", "h2"], "left_semi").groupBy("doc").agg(F.collect_list(F.struct("h1", "h2")).alias("own"))
    return keyed.join(own, "doc", "left").select("doc_id", "text", "own").mapInArrow(clean, f"doc_id {kind}, {REPORT}")


def buckets_for(spark: SparkSession, rows: int) -> int:
    few, most = (-(-rows // n) for n in BUCKET_ROWS)
    return max(1, most, min(few, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, batches: int = BATCHES,
                   fanout: int = FANOUT) -> DataFrame:
    """h1, h2 of the line keys of at least ``min_docs`` documents; documents are dealt into batches by their id."""
    number = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(batches))
    rows = docs.select(number.alias("batch"), F.col(text_col).alias("text"))
    counts = materialize(line_counts(rows, "text", "batch"))
    runs = LineRuns(docs.sparkSession, min_docs, fanout, buckets_for(docs.sparkSession, counts.count()))
    for i in range(batches):
        runs.add(counts.filter(F.col("batch") == i))
    return runs.frequent()


def op12_line_dedup(spark, folder):
    docs = table(spark, folder, "documents")
    cleaned = drop_lines(docs, frequent_lines(docs))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = rf"""WITH l AS (SELECT doc_id, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS p FROM
        (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
    k AS (SELECT doc_id, p, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
        '{_UPPER}', '{_LOWER}') AS key FROM l),
    f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS})
    SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
    FROM k LEFT JOIN f USING (key) GROUP BY doc_id"""

QUERIES = {"op12_line_dedup": op12_line_dedup}
ORACLE = {"op12_line_dedup": SQL}
