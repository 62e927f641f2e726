"""Language identification with interpolated Kneser-Ney character models.

One model per language over the characters of words (a word is read from its
start mark to its end mark, so its score does not depend on its neighbours).
Counts of the highest order come from all training texts, summed by Spark; lower
orders use Kneser-Ney continuation counts, summed by Spark as well.  The counts
of grams and of their contexts are one table sorted by 64-bit hash and language.
It is written to the shared folder and sent with ``addFile``; tasks memory-map
it, probe it by binary search and interpolate the orders, once per distinct gram.
The order is the same at every size: what grows with the texts is on disk, and
only discounts (per order and language) are gathered.

The language of a text is the one with the lowest cross-entropy per character.
Its score is the share of right answers at that margin to the second language,
counted on a calibration fold and made monotone; a text whose entropy lies above
almost all calibration texts of its language is rejected (``accepted`` false).

Folds are crc32 of the id as text, modulo 5: 0 is held out, 1 calibrates, the
others train.  Null languages are not learned from.  A null text or one without
letters gets ``und`` and score 0, and so does every text if nothing was learned.
Repeated rows count each.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, functions as F

from tonearm.llm.common import table
from tonearm.session import checkpoint_dir, materialize

ORDER = 4
FLUSH_WORDS = 200_000
CACHE_WORDS = 200_000
CACHE_GRAMS = 200_000
START, END = "\x02", "\x03"
#: Runs of letters; a longer run is read in pieces.
LETTERS = re.compile(r"[^\W\d_]{1,40}")
#: Signs like fractions and circled digits, which ``LETTERS`` would take for letters.  The pattern stays below U+10000, or
#: ``re`` would go through it sign by sign; above, each character is asked.
SIGNS = re.compile("[" + "".join(c for c in map(chr, range(0x10000)) if c.isalnum() and not c.isalpha() and not c.isdecimal()) + "]")
ABOVE = re.compile("[\U00010000-\U0010ffff]")
UNKNOWN = "und"
BINS, BIN_WIDTH = 200, 0.02
REJECT = 0.999


def fold(id_col: Column, folds: int = 5) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds


def grams(word: str, order: int) -> list[str]:
    padded = START * (order - 1) + word + END
    return [padded[i:i + order] for i in range(len(word) + 1)]


def gram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, gram, n of all rows (lang, text)."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])

    def emit(words):
        for lang, counter in words.items():
            total: Counter = Counter()
            for word, n in counter.items():
                for gram in grams(word, order):
                    total[gram] += n
            if total:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(total)), pa.array(list(total)), pa.array(list(total.values()), pa.int64())], schema=schema)

    def run(batches):
        words = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words[lang].update(text_words(text))
                if len(words[lang]) > FLUSH_WORDS:
                    yield from emit({lang: words.pop(lang)})
        yield from emit(words)

    counted = texts.select("lang", "text").mapInArrow(run, "lang string, gram string, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _hash(grams_: list[str]) -> np.ndarray:
    """Spark's ``xxhash64`` of each."""
    return np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams_), np.uint64, len(grams_)).view(np.int64)


def _discount(once: int, twice: int) -> float:
    return once / (once + 2 * twice) if once and twice else 0.75


class Model:
    """Counts of grams of all orders, and per order and language the discount.

    ``tables`` are the keys (sorted hashes, one row per gram and language) and the
    values (language, count, total and number of the grams that follow it as
    context), as arrays or as names of files sent with ``addFile``.
    """

    def __init__(self, langs: list[str], order: int, alphabet: int, discounts: dict[int, np.ndarray], tables: tuple):
        self.langs, self.order, self.alphabet, self.discounts, self.tables = langs, order, alphabet, discounts, tables
        self._open = None
        self._index, self._rows, self._used, self._sizes = {}, None, 0, None
        self._grams, self._logs = {}, None

    @classmethod
    def fit(cls, counts: dict[str, dict[str, int]], order: int) -> "Model":
        """The model of counts in memory; ``fit`` below is the same over tables."""
        langs = sorted(counts)
        rows, discounts = defaultdict(lambda: [0, 0, 0]), {n: np.full(len(langs), 0.75) for n in range(1, order + 1)}
        letters = set()
        for i, lang in enumerate(langs):
            level = counts[lang]
            for n in range(order, 0, -1):
                discounts[n][i] = _discount(sum(c == 1 for c in level.values()), sum(c == 2 for c in level.values()))
                for gram, c in level.items():
                    rows[gram, i][0] += c
                    rows[gram[:-1], i][1] += c
                    rows[gram[:-1], i][2] += 1
                if n == 1:
                    letters |= set(level)
                level = Counter(g[1:] for g in level)  # distinct left neighbours
        hashes, values = _hash([g for g, _ in rows]), np.array([[i, *v] for (_, i), v in rows.items()], np.int64).reshape(-1, 4)
        by = np.lexsort((values[:, 0], hashes))
        return cls(langs, order, len(letters) + 1, discounts, (hashes[by], values[by]))

    def _counts(self, names: list[str]) -> np.ndarray:
        """(count, total, kinds) of each name in every language."""
        if self._open is None:
            keys, values = (np.memmap(SparkFiles.get(t), np.int64, "r") if isinstance(t, str) else t for t in self.tables)
            self._open = keys, values.reshape(-1, 4)
        keys, values = self._open
        wanted, row = _hash(names), np.arange(len(names))
        at, out = np.searchsorted(keys, wanted), np.zeros((3, len(names), len(self.langs)))
        while len(row):  # once per language that has the name
            row = row[at[row] < len(keys)]
            row = row[keys[at[row]] == wanted[row]]
            found = values[at[row]]
            out[:, row, found[:, 0]] = found[:, 1:].T
            at[row] += 1
        return out

    def _chances(self, names: list[str], n: int) -> np.ndarray:
        """Probability of each gram of order n in every language."""
        if n == 0:
            return np.full((len(names), len(self.langs)), 1 / self.alphabet)
        tails, heads = [g[1:] for g in names], [g[:-1] for g in names]
        tail, head = ({g: i for i, g in enumerate(dict.fromkeys(part))} for part in (tails, heads))
        lower = self._chances(list(tail), n - 1)[[tail[g] for g in tails]]
        _, total, kinds = self._counts(list(head))[:, [head[g] for g in heads]]
        d, seen = self.discounts[n], np.maximum(total, 1)
        return np.maximum(self._counts(names)[0] - d, 0) / seen + np.where(total > 0, d * kinds / seen, 1) * lower

    def _score(self, names: list[str], n: int) -> np.ndarray:
        """Log probability of each gram of order n in every language."""
        return np.log(np.maximum(self._chances(names, n), 1e-30)).astype(np.float32)

    def _gram_rows(self, names: list[str]) -> np.ndarray:
        """Log probabilities of grams of the model's order; those seen last are kept."""
        fresh = [g for g in names if g not in self._grams]
        if self._logs is None or len(self._grams) + len(fresh) > len(self._logs):
            fresh, self._grams = names, {}
            self._logs = np.zeros((max(CACHE_GRAMS, len(fresh)), len(self.langs)), np.float32)
        if fresh:
            at = len(self._grams)
            self._logs[at:at + len(fresh)] = self._score(fresh, self.order)
            self._grams.update(zip(fresh, range(at, at + len(fresh))))
        return self._logs[np.fromiter(map(self._grams.__getitem__, names), np.int64, len(names))]

    def word_scores(self, words: list[str]) -> np.ndarray:
        pieces = [grams(w, self.order) for w in words]
        flat = [g for p in pieces for g in p]
        unique = {g: i for i, g in enumerate(dict.fromkeys(flat))}
        scores = self._gram_rows(list(unique))
        rows = np.fromiter(map(unique.__getitem__, flat), np.int64, len(flat))
        return np.add.reduceat(scores[rows], np.cumsum([0, *map(len, pieces[:-1])]), axis=0)

    def entropies(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(nats per character in every language, number of characters) of texts, given as their words."""
        out, sizes = np.zeros((len(words), len(self.langs))), np.zeros(len(words), np.int64)
        for at in range(0, len(words), 512):
            part = words[at:at + 512]
            fresh = [w for w in dict.fromkeys(w for ws in part for w in ws) if w not in self._index]
            if self._used + len(fresh) > CACHE_WORDS or self._rows is None:
                fresh = list(dict.fromkeys(w for ws in part for w in ws))
                self._index, self._used = {}, 0
                self._rows = np.zeros((max(CACHE_WORDS, len(fresh)), len(self.langs)), np.float32)
                self._sizes = np.zeros(len(self._rows), np.int64)
            for start in range(0, len(fresh), 20_000):
                new = fresh[start:start + 20_000]
                self._rows[self._used:self._used + len(new)] = self.word_scores(new)
                self._sizes[self._used:self._used + len(new)] = [len(w) + 1 for w in new]
                self._index.update(zip(new, range(self._used, self._used + len(new))))
                self._used += len(new)
            for i, ws in enumerate(part):
                if ws:
                    rows = np.fromiter(map(self._index.__getitem__, ws), np.int64, len(ws))
                    sizes[at + i] = self._sizes[rows].sum()
                    out[at + i] = -self._rows[rows].sum(0, dtype=np.float64) / sizes[at + i]
        return out, sizes

    def __getstate__(self):
        return self.__dict__ | {"_open": None, "_index": {}, "_rows": None, "_used": 0, "_sizes": None, "_grams": {}, "_logs": None}


def _levels(docs: DataFrame, order: int) -> dict[int, DataFrame]:
    """lang, gram, n by order: counts at the highest, numbers of distinct left neighbours below."""
    levels = {order: materialize(gram_counts(docs, order))}
    for n in range(order - 1, 0, -1):
        levels[n] = materialize(levels[n + 1].groupBy("lang", F.substring("gram", 2, n).alias("gram")).agg(F.count(F.lit(1)).alias("n")))
    return levels


def _write_shared(records: DataFrame) -> tuple[str, str]:
    """Names of the files of keys and values, sent to every executor: the packed records in order, some at a time."""
    def pack(batches):
        for batch in batches:
            keys, *values = (c.to_numpy(zero_copy_only=False).astype("<i8") for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array([keys.tobytes()], pa.binary()), pa.array([np.stack(values, 1).tobytes()], pa.binary())],
                                             names=["keys", "values"])

    spark = records.sparkSession
    names = tuple(f"grams-{kind}-{uuid.uuid4().hex}" for kind in ("keys", "values"))
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark).rstrip('/')}/{name}") for name in names]
    streams = [path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path) for path in paths]
    for row in records.mapInArrow(pack, "keys binary, values binary").toLocalIterator():
        for stream, data in zip(streams, row):
            stream.write(bytearray(data))
    for stream, path in zip(streams, paths):
        stream.close()
        spark.sparkContext.addFile(path.toString())
    return names


def fit(docs: DataFrame, order: int = ORDER) -> Model:
    """Models of every language in rows (lang, text)."""
    levels = _levels(docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()), order)
    ones = reduce(DataFrame.unionByName, (level.withColumn("order", F.lit(n)) for n, level in levels.items())).groupBy("order", "lang").agg(
        F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).collect()  # orders x languages
    langs = sorted({r["lang"] for r in ones})
    if not langs:
        return Model([], order, 1, {}, ())
    discounts = {n: np.full(len(langs), 0.75) for n in levels}
    for r in ones:
        discounts[r["order"]][langs.index(r["lang"])] = _discount(r["once"], r["twice"])
    alphabet = levels[1].select("gram").distinct().count() + 1
    none, parts = F.lit(0).cast("long"), []
    for n, level in levels.items():
        parts.append(level.select("lang", "gram", F.col("n").alias("count"), none.alias("total"), none.alias("kinds")))
        parts.append(level.groupBy("lang", F.substring("gram", 1, n - 1).alias("gram")).agg(
            none.alias("count"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")))
    places = docs.sparkSession.createDataFrame([*zip(langs, range(len(langs)))], "lang string, place long")
    records = (reduce(DataFrame.unionByName, parts).join(places, "lang").groupBy(F.xxhash64("gram").alias("hash"), "place")
               .agg(F.sum("count").alias("count"), F.sum("total").alias("total"), F.sum("kinds").alias("kinds")).orderBy("hash", "place"))
    return Model(langs, order, alphabet, discounts, _write_shared(records))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, fold, guess, entropy, margin of rows (doc_id, lang, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            guess, entropy, margin = guesses(shared.value, list(map(text_words, batch.column(3).to_pylist())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(guess, pa.string()), pa.array(entropy), pa.array(margin)],
                                             names=["doc_id", "lang", "fold", "guess", "entropy", "margin"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "lang", fold(F.col("doc_id")).alias("fold"), "text").mapInArrow(
        run, f"doc_id {kind}, lang string, fold long, guess string, entropy double, margin double")


def letters(text: str) -> list[str]:
    """Runs of letters of a lower-case text."""
    if not text.isascii():
        if SIGNS.search(text):
            text = SIGNS.sub(" ", text)
        if ABOVE.search(text):
            text = ABOVE.sub(lambda m: m[0] if m[0].isalpha() else " ", text)
    return LETTERS.findall(text)


def text_words(text: str | None) -> list[str]:
    return letters(text.lower()) if text else []


def guesses(model: Model, texts: list[list[str]]):
    """(language, entropy, margin to the second language) of texts, given as their words."""
    return decide(model, *(model.entropies(texts) if model.langs else (np.zeros((len(texts), 0)), np.zeros(len(texts)))))


def decide(model: Model, entropy: np.ndarray, sizes: np.ndarray):
    """(language, entropy, margin to the second language) by the entropies and numbers of characters of texts."""
    if not model.langs:
        return [UNKNOWN] * len(sizes), [0.0] * len(sizes), [0.0] * len(sizes)
    order = np.argsort(entropy, axis=1, kind="stable")
    rows = np.arange(len(sizes))
    best = entropy[rows, order[:, 0]]
    margin = entropy[rows, order[:, 1]] - best if len(model.langs) > 1 else np.full(len(sizes), BINS * BIN_WIDTH)
    margin = np.where(sizes > 0, margin, 0.0)
    return [model.langs[o] if n else UNKNOWN for o, n in zip(order[:, 0], sizes)], best, margin


def monotone(right: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Non-decreasing shares by pooling neighbours; one right and one wrong answer are added per pool."""
    pools = []
    for r, n in zip(right, total):
        pools.append([r, n, 1])
        while len(pools) > 1 and (pools[-2][0] + 1) / (pools[-2][1] + 2) >= (pools[-1][0] + 1) / (pools[-1][1] + 2):
            r2, n2, k2 = pools.pop()
            pools[-1] = [pools[-1][0] + r2, pools[-1][1] + n2, pools[-1][2] + k2]
    return np.concatenate([np.full(k, (r + 1) / (n + 2)) for r, n, k in pools])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted, entropy of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    model = fit(rows.filter(fold(F.col("doc_id")) > 1).select("lang", "text"), order)
    judged = materialize(scored(rows, model))
    bin_ = F.least(F.floor(F.col("margin") / BIN_WIDTH), F.lit(BINS - 1)).cast("int")
    known = judged.filter((F.col("fold") == 1) & F.col("lang").isNotNull() & (F.col("guess") != UNKNOWN))
    right, total = np.zeros(BINS), np.zeros(BINS)
    for row in known.groupBy(bin_.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("guess") == F.col("lang")).cast("long")).alias("r")).collect():
        right[row["b"]], total[row["b"]] = row["r"], row["n"]
    share = F.array(*(F.lit(float(x)) for x in monotone(right, total)))
    limits = known.filter("guess = lang").groupBy(F.col("guess").alias("__guess")).agg(
        F.percentile_approx("entropy", REJECT, 10_000).alias("limit"))
    found = F.col("guess") != UNKNOWN
    return (judged.join(limits, judged["guess"] == limits["__guess"], "left")
            .select("doc_id", (F.col("fold") == 0).alias("held_out"), F.col("guess").alias("lang_pred"),
                    F.when(found, F.element_at(share, bin_ + 1)).otherwise(F.lit(0.0)).alias("score"),
                    (found & (F.col("entropy") <= F.coalesce("limit", F.lit(math.inf)))).alias("accepted"), "entropy"))


def op8_language(spark, folder):
    return identify(table(spark, folder, "documents"))


QUERIES = {"op8_language": op8_language}
ORACLE: dict[str, str] = {}
