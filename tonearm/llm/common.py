"""Helpers that several of these operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word: a run without ASCII white space.  ``bytes.split()`` cuts at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"

U64 = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C15


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``frame`` has."""
    taken = {c.lower() for c in frame.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def as_bytes(column) -> list:
    """The UTF-8 bytes of an Arrow string column; None for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class WordHashes(dict):
    """word -> 64-bit hash, computed once per distinct word; emptied when it has grown to ``most`` words."""

    def __init__(self, most: int = 500_000):
        self.most = most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, U64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out, dtype=U64)


class Rolling:
    """Polynomial hashes modulo 2^64 of windows of words, from prefix sums; the powers are kept and grown."""

    def __init__(self, base: int = _MULTIPLIER):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.zeros(0, U64)

    def prefix(self, hashes: np.ndarray) -> np.ndarray:
        n = len(hashes)
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            self.up, self.down = _powers(size, self.base), _powers(size, self.inverse)
        out = np.zeros(n + 1, U64)
        np.cumsum(hashes * self.up[:n], dtype=U64, out=out[1:])
        return out

    def windows(self, prefix: np.ndarray, length: int) -> np.ndarray:
        """Hash of the ``length`` words from each start; empty if there are fewer words."""
        n = len(prefix) - length
        if n <= 0:
            return np.zeros(0, U64)
        return mixed((prefix[length:] - prefix[:n]) * self.down[:n])

    def at(self, prefix: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        return mixed((prefix[starts + length] - prefix[starts]) * self.down[starts])


def arrow_rows(batches: Iterator[pa.RecordBatch], schema: pa.Schema, fn) -> Iterator[pa.RecordBatch]:
    """Apply ``fn(batch) -> list of columns`` to every batch."""
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c
                                              for c, f in zip(fn(batch), schema)], schema=schema)
