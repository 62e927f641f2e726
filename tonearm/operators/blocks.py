"""Block join: score every allowed (anchor, candidate) pair without ever emitting the pairs.

Candidates are spread over blocks of bounded size, each inside one genre lane.
Anchor rows are sent to the blocks whose lane they may reach.  Where more than
``CHUNK_ROWS`` anchors reach a block, they are cut into chunks and the block is
copied to each: the unit of work is a *cell* of one block and one chunk, bounded on
both sides, and the number of tasks follows the number of cells.  A task streams one
cell at a time: the block's candidates are held, anchor rows arrive in Arrow batches,
and only a bounded list per (anchor, block) leaves the task.  Spark does the
partitioning, the shuffle and the final merge.

A lane, an artist, a recording or a requester that holds a third of either side is
split over many cells like everything else, so no key decides the size of a task.
"""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tonearm.session import materialize

BLOCK_ROWS = 4096
CHUNK_ROWS = 16384
MOST_TASKS = 20_000
#: Pairs that a kernel scores at a time.
SCORED_PAIRS = 1 << 18
CANDIDATE, TASTE, AVERSE, SEEN, FEEDBACK, ANCHOR = 0, 1, 2, 3, 4, 5
ROW_COLUMNS = ["block", "grp", "side", "id", "s", "x", "p", "used"]


def assign_blocks(candidates: DataFrame, lane: str = "lane", spread: str = "identity", unique: str = "id",
                  rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``block`` and ``split``; rows of one ``spread`` value share a block unless they outgrow it.

    ``split`` marks rows whose ``spread`` value had to be cut over several blocks.
    """
    per_value = candidates.groupBy(lane, spread).agg(F.count("*").alias("n"))
    lanes = per_value.groupBy(lane).agg(F.sum("n").alias("lane_rows"))
    # at most (library rows / block rows) values can be this large
    large = per_value.filter(F.col("n") > rows).withColumn("parts", F.ceil(F.col("n") / rows)).drop("n")
    out = candidates.join(lanes, lane).join(large, [lane, spread], "left")
    buckets = F.ceil(F.col("lane_rows") / rows)
    whole = F.concat_ws("/", lane, F.lit("n"), F.pmod(F.xxhash64(spread), buckets))
    cut = F.concat_ws("/", lane, F.lit("c"), F.xxhash64(spread), F.pmod(F.xxhash64(unique), F.col("parts")))
    return (out.withColumn("split", F.col("parts").isNotNull())
            .withColumn("block", F.when(F.col("split"), cut).otherwise(whole)).drop("lane_rows", "parts"))


class Cells:
    """How the anchors of each block are cut into chunks.

    ``asks`` has a row per (request, block), ``most`` is the number of requests: a block
    cannot get more rows than there are requests, so few requests need no counting.
    """

    def __init__(self, blocks: DataFrame, asks: DataFrame, most: int, chunk_rows: int = CHUNK_ROWS):
        n_blocks = blocks.select("block").distinct().count()
        self.parts, self.count = None, n_blocks
        if most > chunk_rows:
            per_block = asks.groupBy("block").agg(F.ceil(F.count("*") / chunk_rows).cast("int").alias("_parts"))
            self.parts = materialize(per_block.filter("_parts > 1"))
            self.count += self.parts.agg(F.coalesce(F.sum(F.col("_parts") - 1), F.lit(0))).first()[0]

    def candidates(self, cands: DataFrame) -> DataFrame:
        """Candidate rows once per cell of their block."""
        if self.parts is None:
            return cands
        every = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
        return cands.join(self.parts, "block", "left").withColumn("_part", F.explode(every)).withColumn("block", self._name()).drop("_parts", "_part")

    def asks(self, asks: DataFrame, key: str = "request_id") -> DataFrame:
        """Anchor rows in the cell of their chunk; ``home`` is the block."""
        asks = asks.withColumn("home", F.col("block"))
        if self.parts is None:
            return asks
        part = F.pmod(F.xxhash64(key), F.coalesce("_parts", F.lit(1)))
        return asks.join(self.parts, "block", "left").withColumn("_part", part).withColumn("block", self._name()).drop("_parts", "_part")

    def _name(self) -> Column:
        return F.when(F.col("_parts").isNull(), F.col("block")).otherwise(F.concat_ws("/", "block", "_part"))


def rows(df: DataFrame, side: int, grp: Column | str = "", s=None, x=None, p=None, used=None,
         row_id: str = "id") -> DataFrame:
    """Bring one side to the common row layout of a block stream."""
    pick = lambda value, kind: (F.lit(None) if value is None else value).cast(kind)
    return df.select(
        "block", (F.lit(grp) if isinstance(grp, str) else grp).cast("string").alias("grp"), F.lit(side).alias("side"),
        F.col(row_id).cast("string").alias("id"), pick(s, "array<string>").alias("s"),
        pick(x, "array<double>").alias("x"), pick(p, "array<double>").alias("p"),
        pick(used, "array<array<string>>").alias("used"))


def run(parts: list[DataFrame], kernel: Callable, schema: str, cells: int = 1) -> DataFrame:
    """Stream each cell through ``kernel(candidates, groups) -> iterator of column dicts``; ``cells`` is their number."""
    stream = parts[0]
    for part in parts[1:]:
        stream = stream.unionByName(part)
    spark = stream.sparkSession
    n = min(max(cells, int(spark.conf.get("spark.sql.shuffle.partitions"))), MOST_TASKS)
    # the order (candidates first, then one requester group after the other) is what keeps memory bounded
    stream = stream.repartition(n, "block").sortWithinPartitions("block", "grp", "side", "id")

    def per_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return stream_block(batches, kernel)

    return stream.groupBy("block").applyInArrow(per_block, schema)


def matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    if n == 0 or column.null_count == n:
        return np.zeros((n, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, len(flat) // n)


class Rows:
    """Some rows of one side as arrays."""

    def __init__(self, batch: pa.RecordBatch):
        names = {name: i for i, name in enumerate(batch.schema.names)}
        get = lambda name: batch.column(names[name])
        self.ids = np.asarray(get("id").to_pylist(), dtype=object)
        self.x = matrix(get("x"))
        self.p = matrix(get("p"))
        texts = get("s").to_pylist()
        self.s = np.asarray(texts, dtype=object) if texts and texts[0] is not None else np.empty((len(texts), 0), object)
        self.used = get("used").to_pylist()
        self._coded = {}

    def coded(self, i: int) -> tuple[dict, np.ndarray]:
        """(code of each text, codes of the rows) of text column ``i``."""
        if i not in self._coded:
            known: dict = {}
            codes = np.fromiter((known.setdefault(v, len(known)) for v in self.s[:, i]), dtype=np.int64, count=len(self.ids))
            self._coded[i] = known, codes
        return self._coded[i]

    def at(self, rows: np.ndarray) -> "Rows":
        """Numbers and texts of the given rows, in their order."""
        out = Rows.__new__(Rows)
        out.ids, out.x, out.p, out.s, out.used, out._coded = self.ids[rows], self.x[rows], None, self.s[rows], None, {}
        return out

    def take(self, start: int, stop: int) -> "Rows":
        out = Rows.__new__(Rows)
        out.ids, out.x, out.p, out.s = self.ids[start:stop], self.x[start:stop], self.p[start:stop], self.s[start:stop]
        out.used, out._coded = self.used[start:stop], {}
        return out


def stream_block(batches: Iterator[pa.RecordBatch], kernel: Callable) -> Iterator[pa.RecordBatch]:
    """Split the sorted rows of one block into (group, side) runs and feed the kernel."""
    held: list[pa.RecordBatch] = []
    worker = None
    last_group, scored = None, False
    for batch in batches:
        names = batch.schema.names
        side = batch.column(names.index("side")).to_numpy(zero_copy_only=False)
        grp = np.asarray(batch.column(names.index("grp")).to_pylist(), dtype=object)
        edges = np.flatnonzero((side[1:] != side[:-1]) | (grp[1:] != grp[:-1])) + 1
        bounds = [0, *edges.tolist(), len(side)]
        for start, stop in zip(bounds[:-1], bounds[1:]):
            part = batch.slice(start, stop - start)
            if side[start] == CANDIDATE:
                if worker is not None:
                    raise ValueError("a candidate row arrived after the block was closed")
                held.append(part)
                continue
            if worker is None:
                if not held:
                    return
                table = pa.Table.from_batches(held).combine_chunks()
                worker = kernel(Rows(table.to_batches()[0]))
                held = []
            if grp[start] != last_group:
                worker.reset()
                last_group, scored = grp[start], False
            data = Rows(part)
            if side[start] != ANCHOR:
                if scored:
                    raise ValueError("a row that scores depend on arrived after its group was scored")
                worker.feed(int(side[start]), data)
                continue
            scored = True
            step = worker.rows_at_once()
            for low in range(0, len(data.ids), step):
                columns = worker.score(data.take(low, low + step))
                if columns is not None and len(columns[0]):
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=worker.names)
