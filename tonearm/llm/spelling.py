"""Spelling variants by one-edit neighbourhoods over a reduced alphabet.

Letters are hashed to a few symbols.  If two words differ by one edit, their
reduced words are equal or differ by one edit as well.  So every word sends the
codes of its reduced word and of the whole one-edit neighbourhood of that
(deletions, replacements and insertions over the few symbols), the codes are
joined to those of the reduced vocabulary, and the pairs found are verified on
the words themselves.  A smaller alphabet means fewer codes and more pairs to
verify; the answer is the same for any.

A neighbourhood has about ``2 * symbols`` codes a letter, few of which are in the
vocabulary.  A bitmap of the vocabulary's codes, of a size bounded by
``FILTER_BITS``, goes to all tasks and drops most of the others before they are
shuffled; what it lets through wrongly finds no partner in the join.  Codes are
64-bit hashes of reduced words: a collision costs one verification.

A word's *form* is its near word of the largest count (of equal ones the first
in code-point order) if that count is at least ``factor`` times its own, its
*root* what forms lead to in the end.  Counts grow by ``factor`` with each step,
so chains are short and pointer doubling needs a known number of rounds.

Counting: null texts have no words, null ids count as empty text, rows with the
same id and repeated rows count each.  A word of any length is handled; its codes
are made in pieces.  Empty tables give empty results.  Only the id and the text
are read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tonearm.llm.common import U64, mixed, table
from tonearm.session import materialize

#: Letters of a word.
LETTERS = "A-Za-zÀ-ÿ"
LENGTH, COUNT, DAMAGE, FACTOR = 7, 2, 31, 10
FLUSH_WORDS = 200_000
#: Codes that a task holds at once, and the bounds of the bitmap.
CODES = 1 << 21
FILTER_BITS = (20, 28)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def damaged(word: str, h: int, damage: int) -> str:
    """``word`` without its code point ``h % length`` if ``damage`` divides ``h``."""
    if h % damage:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = LENGTH, min_count: int = COUNT,
                damage: int | None = DAMAGE) -> DataFrame:
    """word, n: runs of letters (A-Z lower-cased) of at least ``min_length`` letters that occur at least ``min_count`` times.

    With ``damage`` a run loses one letter where that number divides the crc32 of ``<id>:<run>``.
    """
    runs = re.compile(f"[{LETTERS}]{{{min_length},}}")
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def emit(total):
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], schema=schema)

    def count(batches):
        total: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    start = zlib.crc32(f"{doc}:".encode())
                    # bytes.lower() changes A-Z only
                    for word, n in Counter(runs.findall(text.encode().lower().decode())).items():
                        if damage:
                            word = damaged(word, zlib.crc32(word.encode(), start), damage)
                            if len(word) < min_length:
                                continue
                        total[word] += n
                if len(total) > FLUSH_WORDS:
                    yield emit(total)
                    total.clear()
        yield emit(total)

    rows = docs.filter(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def symbols_for(words: int, length: int) -> int:
    """The smallest of a few alphabets whose reduced words of the shortest length outnumber the vocabulary."""
    return next((k for k in (2, 4, 8, 16) if k ** length >= words), 32)


def reduced(words: list[str], symbols: int) -> np.ndarray:
    """(words, letters) symbols 1.. of words of one length."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(U64)
    return (mixed(points + U64(1)) % U64(symbols) + U64(1)).reshape(len(words), -1)


class Codes:
    """Codes of reduced words and of their neighbourhoods: polynomials modulo 2^64, put through a finaliser."""

    def __init__(self, symbols: int):
        self.symbols, self.up = symbols, np.zeros(0, U64)

    def powers(self, n: int) -> np.ndarray:
        if len(self.up) < n:
            self.up = np.full(max(n, 64), BASE, U64)
            self.up[0] = 1
            self.up = np.multiply.accumulate(self.up, dtype=U64)
        return self.up[:n]

    def prefixes(self, letters: np.ndarray) -> np.ndarray:
        out = np.zeros((len(letters), letters.shape[1] + 1), U64)
        np.cumsum(letters * self.powers(letters.shape[1]), axis=1, dtype=U64, out=out[:, 1:])
        return out

    def own(self, words: list[str]) -> np.ndarray:
        """Code of each word."""
        out = np.zeros(len(words), U64)
        for rows, letters in self.by_length(words):
            out[rows] = mixed(self.prefixes(letters)[:, -1])
        return out

    def by_length(self, words: list[str]):
        """(rows, symbols) of words of equal length, so many at a time that their codes fit."""
        groups = defaultdict(list)
        for i, w in enumerate(words):
            groups[len(w)].append(i)
        for n, rows in groups.items():
            step = max(1, CODES // (2 * self.symbols * max(n, 1)))
            for at in range(0, len(rows), step):
                part = rows[at:at + step]
                yield np.array(part), reduced([words[i] for i in part], self.symbols)

    def around(self, letters: np.ndarray):
        """(rows, codes) of the distinct words at zero or one edit over the symbols, in pieces.

        Of equal results only one is made: a deletion inside a run of equal symbols
        at its start, an insertion next to its own symbol after the run.
        """
        k, prefix = self.symbols, self.prefixes(letters)
        total, n = prefix[:, -1:], letters.shape[1]
        everyone = np.arange(len(letters))
        yield everyone, mixed(total[:, 0])
        last = self.powers(n + 1)[n:]
        for c in range(1, k + 1):
            yield everyone, mixed(total[:, 0] + U64(c) * last)
        width = max(1, CODES // (2 * k * len(letters)))
        for at in range(0, n, width):
            here = letters[:, at:at + width]
            w = here.shape[1]
            head, tail, power = prefix[:, at:at + w], total - prefix[:, at + 1:at + w + 1], self.powers(n)[at:at + w]
            before = np.concatenate([np.zeros((len(letters), 1), U64) if at == 0 else letters[:, at - 1:at], here[:, :-1]], axis=1)
            starts = np.nonzero(here != before)
            yield starts[0], mixed((head + tail * U64(INVERSE))[starts])
            rows = np.repeat(everyone, w)
            moved = (total - head) * U64(BASE)
            for step in range(1, k):
                other = ((here + U64(step - 1)) % U64(k) + U64(1)) * power
                yield rows, mixed(head + other + tail).ravel()
                yield rows, mixed(head + other + moved).ravel()


def code_filter(coded: DataFrame, words: int) -> tuple[np.ndarray, int]:
    """Bitmap of the codes (64 a word) and its number of bits: about 16 a code within the bounds."""
    size = min(max(math.ceil(math.log2(16 * words + 1)), FILTER_BITS[0]), FILTER_BITS[1])
    slot = F.col("code").bitwiseAND(F.lit((1 << size) - 1))
    found = coded.groupBy(F.shiftright(slot, 6).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(code & 63 as int))")).alias("bits")).toArrow()  # at most 2^size / 64 rows
    out = np.zeros(1 << (size - 6), np.int64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return out.view(U64), size


def near_words(words: DataFrame, symbols: int | None = None, length: int = LENGTH) -> DataFrame:
    """id, near_word, near_n: for each of ``words`` (id, word, n) the words at one edit."""
    spark = words.sparkSession
    count = words.count()
    k = symbols or symbols_for(count, length)

    def code(batches):
        codes = Codes(k)
        for batch in batches:
            own = codes.own(batch.column(1).to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own)], names=["id", "code"])

    coded = materialize(words.select("id", "word").mapInArrow(code, "id long, code long"))
    bits, size = code_filter(coded, count)
    shared = spark.sparkContext.broadcast(bits)

    def reach(batches):
        codes, table_ = Codes(k), shared.value
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for rows, letters in codes.by_length(texts):
                for at, found in codes.around(letters):
                    slot = found & U64((1 << size) - 1)
                    some = np.flatnonzero((table_[(slot >> U64(6)).astype(np.int64)] >> (slot & U64(63))) & U64(1))
                    if len(some):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[rows[at[some]]]), pa.array(found[some].view(np.int64))], names=["id", "code"])

    reached = words.select("id", "word").mapInArrow(reach, "id long, code long")
    # both neighbourhoods find a pair: one of the two is verified and then told in both directions
    pairs = reached.join(coded.withColumnRenamed("id", "near"), "code").filter(F.col("id") < F.col("near")).select("id", "near")
    left = words.select("id", "word", "n")
    right = words.select(F.col("id").alias("near"), F.col("word").alias("near_word"), F.col("n").alias("near_n"))
    found = pairs.join(left, "id").join(right, "near").filter(F.levenshtein("word", "near_word", 1) == 1)
    ways = F.array(F.struct("id", "near_word", "near_n"), F.struct(F.col("near").alias("id"), F.col("word").alias("near_word"), F.col("n").alias("near_n")))
    return found.select(F.inline(ways))


def variant_groups(words: DataFrame, factor: int = FACTOR, symbols: int | None = None, length: int = LENGTH) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary (word, n) of distinct words, n at least 1."""
    if factor <= 1:
        raise ValueError("factor must be greater than 1: forms would not end")
    words = materialize(words.select("word", "n").withColumn("id", F.monotonically_increasing_id()))
    best = near_words(words, symbols, length).groupBy("id").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near_word")).alias("best"))
    takes = -F.col("best.n") >= factor * F.col("n")
    judged = materialize(words.join(best, "id", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("best.near_word")).alias("form"),
        F.when(takes, -F.col("best.n")).alias("form_n")))
    roots = _roots(judged.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), judged, factor)
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame, judged: DataFrame, factor: int) -> DataFrame:
    """word, root: links followed to their end, twice as far each round."""
    least, most = judged.agg(F.min("n"), F.max("form_n")).first()
    steps = int(math.log((most or 1) / (least or 1), factor) + 1e-9) + 1
    done = 1
    while done < steps:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = materialize(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
        done *= 2
    return links


def op11_spelling_variants(spark, folder):
    return variant_groups(word_counts(table(spark, folder, "documents")))


#: DuckDB compares bytes: for edit distances the letters above ASCII stand as ASCII signs that no word has.
_ABOVE, _SIGNS = "".join(map(chr, range(0xC0, 0x100))), "".join(map(chr, range(0x21, 0x61))).replace("'", "''")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = rf"""WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([0, 0, 0, 0, 0, 0, 0, 0],
            lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(0, 256) r(i))),
    runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]{{{LENGTH},}}')), '{_UPPER}', '{_LOWER}') AS run FROM documents),
    counted AS (SELECT run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS named, count(*) AS c FROM runs GROUP BY ALL),
    bytes AS (SELECT run, c, flatten(list_transform(string_split(named, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT]
            ELSE [(192 + (unicode(x) >> 6))::BIGINT, (128 + (unicode(x) & 63))::BIGINT] END)) AS b FROM counted),
    hashed AS (SELECT run, c, xor(list_reduce(b, lambda h, x: xor(h >> 8, t[(xor(h, x) & 255) + 1]), 4294967295), 4294967295) AS h FROM bytes, crc),
    words AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n, translate(word, '{_ABOVE}', '{_SIGNS}') AS w FROM (SELECT c, CASE WHEN h % {DAMAGE} <> 0 THEN run
            ELSE substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) END AS word FROM hashed)
        WHERE length(word) >= {LENGTH} GROUP BY word HAVING sum(c) >= {COUNT}),
    cuts AS (SELECT word, w, n, w AS k FROM words UNION SELECT word, w, n, substr(w, 1, i) || substr(w, i + 2) FROM words, unnest(range(0, length(w))) r(i)),
    near AS (SELECT DISTINCT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b USING (k) WHERE a.word <> b.word AND levenshtein(a.w, b.w) = 1),
    best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS most FROM near GROUP BY word),
    judged AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {FACTOR} * n THEN other END AS form,
            CASE WHEN most >= {FACTOR} * n THEN most END AS form_n FROM words LEFT JOIN best USING (word)),
    walk AS (SELECT word, word AS root FROM judged UNION ALL SELECT walk.word, j.form FROM walk JOIN judged j ON j.word = walk.root WHERE j.form IS NOT NULL)
    SELECT j.word, j.form, walk.root, j.n, j.n_near, j.form_n FROM judged j JOIN walk ON walk.word = j.word
    JOIN judged last ON last.word = walk.root AND last.form IS NULL"""

QUERIES = {"op11_spelling_variants": op11_spelling_variants}
ORACLE = {"op11_spelling_variants": SQL}
