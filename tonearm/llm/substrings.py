"""Repeated passages by level-wise doubling.

Level 0 are all windows of ``length`` words.  A window is *repeated* if its words
also start in a document with a smaller id, and *shared* if two documents hold
it.  Shared windows alone are extended to twice their length, and so on until no
candidate survives.

Level 0 is exact over every window.  Work is dealt by seeds: of the five-word
runs inside a window the one with the smallest hash.  Equal windows have equal
seeds and neighbours mostly share one, so the windows of a seed travel as one
entry (document, start, hashes) in packed blocks.  A task first settles copies
inside its own batch: of equal windows there only those of the smallest document
are sent on, so a passage that thousands of documents share sends a few entries
per batch, and no bucket grows with its copies.

Longer levels take every window whose level-0 windows are all shared, at every
start, and are dealt, settled and judged as level 0 is; the seed of a doubled
window is the smaller of its halves' seeds.  A text whose words as a whole also
are a smaller document's needs no windows there: its windows are that document's.
Longer levels cannot change what is removed (the words of a repeated long window
lie in repeated short ones); they tell how long the repeated passages are.

Words are compared by 64-bit hashes; windows of all levels by ``hash_bytes``
bytes within a bucket.

Null texts have no words.  Null ids count as larger than all others.  Rows with
the same id have equal rank: they never make each other repeated.  Texts shorter
than a window stay whole.  Empty tables give empty results.  Only the id and the
text are read.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tonearm.llm.common import Rolling, U64, WordHashes, as_bytes, fresh, mixed, table
from tonearm.session import materialize

LENGTH = 13
SEED_WORDS = 5
HASH_BYTES = 7
#: Text that one batch settles among its own documents, and characters per bucket.
BATCH_BYTES = 8 << 20
BUCKET_CHARS = 4 << 20
LAST = (1 << 63) - 1
SALT = U64(0xA0761D6478BD642F)
#: Longer windows that one batch settles among its own documents.
BATCH_WINDOWS = 1 << 20
#: Windows of one entry: two masks of so many bits fit a long with the start.
ENTRY_WINDOWS = 16

BLOCK = pa.schema([("bucket", pa.int64()), ("docs", pa.binary()), ("keys", pa.binary()), ("starts", pa.binary()), ("counts", pa.binary()),
                   ("repeated", pa.binary()), ("shared", pa.binary()), ("hashes", pa.binary())])
BLOCK_SQL = "bucket long, docs binary, keys binary, starts binary, counts binary, repeated binary, shared binary, hashes binary"


def _packed(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpacked(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel().astype(U64)


def seeds_of(runs: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window the place and hash of the smallest of its ``span`` runs (the first of equal ones)."""
    view = np.lib.stride_tricks.sliding_window_view(runs, span)
    place = view.argmin(1)
    at = place + np.arange(len(view))
    return at, runs[at]


def settle(docs: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a smaller document here has the same window, this is the smallest and a larger one has it)."""
    if not len(docs):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.lexsort((docs, hashes))
    h, d = hashes[order], docs[order]
    edges = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    sizes = np.diff(np.append(edges, len(h)))
    later = d > np.repeat(d[edges], sizes)
    first = ~later & np.repeat(d[np.append(edges[1:], len(h)) - 1] > d[edges], sizes)
    out = np.zeros((2, len(h)), bool)
    out[0, order], out[1, order] = later, first
    return out[0], out[1]


def entries_of(docs, keys, starts, seed_at):
    """Where each entry begins and how many windows it has."""
    new = np.concatenate([[True], (seed_at[1:] != seed_at[:-1]) | (starts[1:] != starts[:-1] + 1) | (docs[1:] != docs[:-1]) | (keys[1:] != keys[:-1])])
    at = np.flatnonzero(new)
    within = np.arange(len(docs)) - np.repeat(at, np.diff(np.append(at, len(docs))))
    at = np.flatnonzero(within % ENTRY_WINDOWS == 0)
    return at, np.diff(np.append(at, len(docs)))


def _masks(flags: np.ndarray, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    within = np.arange(len(flags)) - np.repeat(at, counts)
    return np.bitwise_or.reduceat(flags.astype(np.int64) << within, at)


def blocks_of(windows, buckets: int, hash_bytes: int, levels: np.ndarray | None = None):
    """Packed entries of a batch: one row per bucket.  With ``levels`` these go in the place of the starts."""
    docs, keys, starts, hashes, seeds, seed_at = windows
    repeated, shared = settle(docs, hashes)
    at, counts = entries_of(docs, keys, starts, seed_at)
    later, first = _masks(repeated, at, counts), _masks(shared, at, counts)
    bucket = (mixed(seeds[at] ^ SALT) % U64(buckets)).astype(np.int64)
    told = starts if levels is None else levels
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]]))
    for piece in np.split(order, edges[1:]):
        n = counts[piece]
        rows = np.repeat(at[piece] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        yield (int(bucket[piece[0]]), docs[at[piece]].tobytes(), keys[at[piece]].tobytes(), told[at[piece]].astype(np.int32).tobytes(),
               n.astype(np.uint8).tobytes(), later[piece].astype(np.uint16).tobytes(), first[piece].astype(np.uint16).tobytes(),
               _packed(hashes[rows[~repeated[rows]]], hash_bytes))


def judge_bucket(parts, hash_bytes: int):
    """docs, keys, marks of the entries of one bucket that hold a shared window."""
    docs, keys, starts, counts, later, first = (np.frombuffer(b"".join(parts[c]), t) for c, t in enumerate(
        (np.int64, np.int32, np.int32, np.uint8, np.uint16, np.uint16)))
    counts = counts.astype(np.int64)
    at = np.cumsum(counts) - counts
    entry = np.repeat(np.arange(len(docs)), counts)
    within = np.arange(len(entry)) - at[entry]
    repeated = (later[entry].astype(np.int64) >> within) & 1 == 1
    shared = (first[entry].astype(np.int64) >> within) & 1 == 1
    sent = ~repeated
    more = settle(docs[entry[sent]], _unpacked(b"".join(parts[6]), hash_bytes))
    repeated[sent], shared[sent] = more[0], shared[sent] | more[1]
    marks = (starts.astype(np.int64) << 32) | (_masks(shared & ~repeated, at, counts) << 16) | _masks(repeated, at, counts)
    some = marks & 0xFFFFFFFF != 0
    return docs[some], keys[some], marks[some]


class Windows:
    """The windows of texts, by word hashes and rolling window hashes."""

    def __init__(self, length: int):
        self.length, self.words, self.rolling = length, WordHashes(), Rolling()
        self.seed = min(SEED_WORDS, length)

    def of(self, rows):
        """All windows of (doc, key, text) rows as flat arrays; None if there are none.

        The one after the last of a text stands for all its words.
        """
        ids, found = [], []
        for doc, key, text in rows:
            words = text.split()
            if len(words) < self.length:
                continue
            prefix = self.rolling.prefix(self.words.of(words))
            window = self.rolling.windows(prefix, self.length)
            place, seed = seeds_of(self.rolling.windows(prefix, self.seed), self.length - self.seed + 1)
            whole = mixed(self.rolling.windows(prefix, len(words)) ^ mixed(np.array([len(words)], U64)))
            ids.append((doc, key, len(window) + 1))
            found.append((np.append(window, whole), np.append(seed, whole), np.append(place, len(words)).astype(np.int32)))
        if not found:
            return None
        doc, key, n = zip(*ids)
        n = np.array(n)
        starts = np.arange(n.sum(), dtype=np.int32) - np.repeat(np.cumsum(n) - n, n).astype(np.int32)
        return (np.repeat(np.array(doc, np.int64), n), np.repeat(np.array(key, np.int32), n), starts, *map(np.concatenate, zip(*found)))

    def longer(self, words, shared: np.ndarray):
        """(level, starts, hashes, seeds, their places) of all longer windows whose windows at level 0 are all shared."""
        held, hashed = np.concatenate([[0], np.cumsum(shared)]), False
        level, size = 1, 2 * self.length
        while size <= len(words):
            n, half, need = len(words) - size + 1, size // 2, size - self.length + 1
            at = np.flatnonzero(held[need:need + n] - held[:n] == need)
            if not len(at):
                break
            if not hashed:
                prefix, hashed = self.rolling.prefix(self.words.of(words)), True
                place, seed = seeds_of(self.rolling.windows(prefix, self.seed), self.length - self.seed + 1)
            right = seed[half:half + n] < seed[:n]
            place, seed = np.where(right, place[half:half + n], place[:n]), np.where(right, seed[half:half + n], seed[:n])
            yield level, at, self.rolling.at(prefix, at, size), seed[at], place[at]
            level, size = level + 1, 2 * size


class Longer:
    """Collects the longer windows of texts and packs them."""

    def __init__(self, maker: Windows):
        self.maker, self.rows, self.size = maker, [], 0

    def add(self, doc: int, key: int, words, shared: np.ndarray):
        for level, at, hashes, seeds, place in self.maker.longer(words, shared):
            self.rows.append((doc, key, level, at, hashes, seeds, place))
            self.size += len(at)

    def blocks(self, buckets: int, hash_bytes: int) -> list:
        """Packed entries of what was collected, one row per bucket; a new batch begins."""
        rows, self.rows, self.size = self.rows, [], 0
        if not rows:
            return []
        doc, key, level, at, hashes, seeds, place = zip(*rows)
        n = [len(a) for a in at]
        flat = lambda values, kind: np.repeat(np.array(values, kind), n)
        levels = flat(level, np.int64)
        windows = (flat(doc, np.int64), flat(key, np.int32), np.concatenate(at), np.concatenate(hashes), np.concatenate(seeds),
                   np.concatenate(place) + (levels << 40))  # windows of two levels share no entry
        return list(blocks_of(windows, buckets, hash_bytes, levels))


def _batches(batches, most: int):
    """(doc, key, text) rows in lists of at most ``most`` bytes of text (a longer text is alone)."""
    rows, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):  # not all texts of an Arrow batch at once
            part = batch.slice(at, 256)
            for doc, key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), as_bytes(part.column(2))):
                if rows and size + len(text) > most:
                    yield rows
                    rows, size = [], 0
                rows.append((doc, key, text))
                size += len(text)
    if rows:
        yield rows


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple:
    """Rank and text key of a row: repeated ids with different texts stay apart."""
    return (F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), F.hash(F.col(text_col)))


def buckets_for(docs: DataFrame, text_col: str) -> int:
    """How many buckets the windows of ``docs`` are dealt to."""
    chars = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    return max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // BUCKET_CHARS))


def judged_buckets(batches, hash_bytes: int):
    """docs, keys, marks of each bucket of blocks that arrive by bucket."""
    def rows():
        for batch in batches:
            for i in range(batch.num_rows):
                yield [column[i].as_py() for column in batch.columns]

    for _, group in groupby(rows(), key=lambda r: r[0]):
        yield judge_bucket([*zip(*group)][1:], hash_bytes)


def shared_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   hash_bytes: int = HASH_BYTES, buckets: int | None = None) -> DataFrame:
    """doc, key, mark: mark holds a start (high 32 bits) and two masks over the windows that start there and after:
    shared ones in the smallest document that has them (16 bits), repeated ones (low 16 bits).  The window after the last
    of a text stands for all its words."""
    if buckets is None:
        buckets = buckets_for(docs, text_col)

    def send(batches):
        maker = Windows(length)
        for rows in _batches(batches, BATCH_BYTES):
            windows = maker.of(rows)
            if windows:
                blocks = zip(*blocks_of(windows, buckets, hash_bytes))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(blocks, BLOCK)], schema=BLOCK)

    def judge(batches):
        for found in judged_buckets(batches, hash_bytes):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["doc", "key", "mark"])

    rank, key = _keyed(docs, id_col, text_col)
    texts = docs.filter(F.col(text_col).isNotNull()).select(rank.alias("doc"), key.alias("key"), F.col(text_col).alias("text"))
    dealt = texts.mapInArrow(send, BLOCK_SQL).repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(judge, "doc long, key int, mark long")


def marked(docs: DataFrame, id_col: str, text_col: str, length: int, hash_bytes: int, buckets: int | None = None) -> tuple[DataFrame, str]:
    """``docs`` with one column more, the marks of each row's text (null: none), and that column's name."""
    doc, own, name = fresh(docs, "__doc", "__key", "__marks")
    marks = shared_windows(docs, id_col, text_col, length, hash_bytes, buckets).groupBy(
        F.col("doc").alias(doc), F.col("key").alias(own)).agg(F.collect_set("mark").alias(name))
    rank, key = _keyed(docs, id_col, text_col)
    return docs.join(marks, (rank == marks[doc]) & (key == marks[own]), "left").drop(doc, own), name


def window_flags(marks, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(repeated, shared) for each of ``n`` windows."""
    repeated, shared = np.zeros(n + ENTRY_WINDOWS, bool), np.zeros(n + ENTRY_WINDOWS, bool)
    marks = np.asarray(marks, np.int64)
    starts = marks >> 32
    for i in range(ENTRY_WINDOWS):
        repeated[starts[(marks >> i) & 1 == 1] + i] = True
        shared[starts[(marks >> (16 + i)) & 1 == 1] + i] = True
    return repeated[:n], (shared | repeated)[:n]


def covered(repeated: np.ndarray, length: int) -> np.ndarray:
    """Words inside a repeated window."""
    edges = np.zeros(len(repeated) + length, np.int64)
    edges[:len(repeated)] += repeated
    edges[length:] -= repeated
    return np.cumsum(np.append(edges, 0))[:len(repeated) + length - 1] > 0


def kept_words(words: list, marks, length: int) -> list:
    if marks is None or len(words) < length:
        return words
    gone = covered(window_flags(marks, len(words) - length + 1)[0], length)
    return [w for w, g in zip(words, gone.tolist()) if not g]


OWN = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
                 ("doc", pa.int64()), ("key", pa.int32()), ("least", pa.int32())])
OWN_SQL = "doc_id long, n_words long, n_removed long, kept_sha256 string, doc long, key int, least int"
JUDGED = pa.schema([*OWN, ("longest", pa.int32())])


def _rows_of(schema: pa.Schema, names: list, columns) -> pa.RecordBatch:
    """A batch of ``schema`` with the named columns; the others are null."""
    known = {name: pa.array(c, schema.field(name).type) for name, c in zip(names, columns)}
    n = len(known[names[0]])
    return pa.RecordBatch.from_arrays([known[f.name] if f.name in known else pa.nulls(n, f.type) for f in schema], schema=schema)


def substring_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                     hash_bytes: int = HASH_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and ``longest`` (words of the longest doubled window that is repeated; 0 if
    none is) of every row."""
    schema = pa.schema([*OWN, *BLOCK])
    buckets = buckets_for(docs, text_col)

    def report(batches):
        maker = Windows(length)
        longer = Longer(maker)
        for batch in (whole.slice(at, 1024) for whole in batches for at in range(0, whole.num_rows, 1024)):
            rows = []
            for doc_id, text, doc, key, marks in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist(),
                                                     batch.column(3).to_pylist(), batch.column(4)):
                words = (text or b"").split()
                kept, least = words, 0
                if marks.is_valid and len(words) >= length:
                    values, n = marks.values.to_numpy(zero_copy_only=False), len(words) - length + 1
                    kept = kept_words(words, values, length)
                    repeated, shared = window_flags(values, n + 1)
                    if repeated[n]:  # all its words are a smaller document's
                        least = length << ((len(words) // length).bit_length() - 1)
                    else:
                        least = length if repeated.any() else 0
                        longer.add(doc, key, words, shared[:n])
                        if longer.size >= BATCH_WINDOWS:
                            yield _rows_of(schema, BLOCK.names, zip(*longer.blocks(buckets, hash_bytes)))
                rows.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), doc, key, least))
            if rows:
                columns = [*zip(*rows)]
                at = (mixed(np.array(columns[4], np.int64).view(U64)) % U64(buckets)).astype(np.int64)  # own rows are spread over the buckets
                yield _rows_of(schema, [*OWN.names, "bucket"], [*columns, at])
        if longer.size:
            yield _rows_of(schema, BLOCK.names, zip(*longer.blocks(buckets, hash_bytes)))

    def judge(batches):
        own = []

        def blocks():
            for batch in batches:
                mine = batch.column("docs").is_null()
                own.append(batch.filter(mine).select(OWN.names))
                yield batch.filter(pc.invert(mine)).select(BLOCK.names)

        def passed():
            while own:
                rows = own.pop()
                yield _rows_of(JUDGED, OWN.names, rows.columns)

        for found, keys, marks in judged_buckets(blocks(), hash_bytes):
            yield from passed()
            again = marks & 0xFFFF != 0
            found, keys, sizes = found[again], keys[again], (length << (marks[again] >> 32)).astype(np.int32)
            order = np.lexsort((sizes, keys, found))
            found, keys, sizes = found[order], keys[order], sizes[order]
            last = np.append((found[1:] != found[:-1]) | (keys[1:] != keys[:-1]), np.ones(min(1, len(found)), bool))
            yield _rows_of(JUDGED, ["doc", "key", "longest"], (found[last], keys[last], sizes[last]))
        yield from passed()

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows, name = marked(chosen, "doc_id", "text", length, hash_bytes, buckets)
    rank, key = _keyed(rows, "doc_id", "text")
    reported = rows.select("doc_id", "text", rank.alias("doc"), key.alias("key"), name).mapInArrow(report, f"{OWN_SQL}, {BLOCK_SQL}")
    dealt = reported.repartition("bucket").sortWithinPartitions("bucket")
    judged = materialize(dealt.mapInArrow(judge, f"{OWN_SQL}, longest int"))
    longest = judged.filter(F.col("n_words").isNull()).groupBy("doc", "key").agg(F.max("longest").alias("longest"))
    own = judged.filter(F.col("n_words").isNotNull()).drop("longest")
    return own.join(longest, ["doc", "key"], "left").withColumn("longest", F.greatest("longest", "least")).drop("doc", "key", "least")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   hash_bytes: int = HASH_BYTES) -> DataFrame:
    """``docs`` with the repeated words cut out of the text column; a text without any stays as it is, else the kept words
    are joined by one space."""
    @F.pandas_udf("string")
    def cut(texts: pd.Series, marks: pd.Series) -> pd.Series:
        out = []
        for text, mark in zip(texts, marks):
            if text is not None and mark is not None:
                words = text.encode().split()
                kept = kept_words(words, mark, length)
                text = text if len(kept) == len(words) else b" ".join(kept).decode()
            out.append(text)
        return pd.Series(out, dtype=object)

    rows, name = marked(docs, id_col, text_col, length, hash_bytes)
    return rows.withColumn(text_col, F.when(F.col(name).isNotNull(), cut(F.col(text_col), F.col(name))).otherwise(F.col(text_col))).drop(name)


def op3_substring_dedup(spark, folder):
    return substring_report(table(spark, folder, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def repeats_sql(source: str, name: str = "cut") -> str:
    """DuckDB common tables: ``{name}`` with the words that stay of every row of ``source``."""
    window = " || chr(1) || ".join(f"lead(w, {i}) OVER o" if i else "w" for i in range(LENGTH))
    return rf"""
    {name}_words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM {source}),
    {name}_tokens AS (SELECT doc_id, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS p FROM {name}_words),
    {name}_windows AS (SELECT doc_id, p, md5({window}) AS s FROM {name}_tokens WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
    {name}_firsts AS (SELECT s, min(doc_id) AS f FROM {name}_windows WHERE s IS NOT NULL GROUP BY s HAVING count(DISTINCT doc_id) > 1),
    {name}_hit AS (SELECT doc_id, p FROM {name}_windows JOIN {name}_firsts USING (s) WHERE doc_id > f),
    {name}_gone AS (SELECT DISTINCT doc_id, p + i AS p FROM {name}_hit, range({LENGTH}) r(i)),
    {name}_left AS (SELECT t.doc_id, string_agg(w, ' ' ORDER BY t.p) AS kept, count(*) AS n FROM {name}_tokens t
        ANTI JOIN {name}_gone g ON t.doc_id = g.doc_id AND t.p = g.p GROUP BY t.doc_id),
    {name} AS (SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
        coalesce(kept, '') AS kept FROM {name}_words d LEFT JOIN {name}_left USING (doc_id))"""


QUERIES = {"op3_substring_dedup": op3_substring_dedup}
ORACLE = {"op3_substring_dedup": f"WITH {repeats_sql('documents')} SELECT doc_id, n_words, n_removed, sha256(kept) AS kept_sha256 FROM cut"}
