"""Toxicity: a convolutional text classifier trained in numpy.

A word's vector is the sum of the hashed embeddings of the whole word and of its
first four and first five letters, so that inflected and unseen forms share what
was learned and words that only begin alike stay apart.  Filters of several
widths run over the words, each filter's maximum over the whole text goes through
a logistic layer.  In scoring, every distinct word is numbered once: its share in each
filter and its log probabilities in the language models lie in one table, so a text
costs one number per word, gathers and shifted sums.  Words are runs of letters and
digits of any length; the letter runs that the language models read are cut from them.

The classifier is fitted on a bounded sample of labelled rows (``per_class`` of
each label, chosen by a hash of the id); everything else covers all rows.  Rows
with crc32(id) mod 5 of 0 are held out; 1 sets the thresholds: for each language
(as the character models of ``language`` see the text) the score that parts the
labels best, pulled to the common one where a language has few labels.  A
language's scores are bent so that its threshold is at 0.5.

Null and empty texts are scored as texts without words.  Ids with several labels
count as toxic if one says so.  Repeated rows are scored each.  Without labels of
both kinds every score is 0.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tonearm.llm import language
from tonearm.llm.common import table
from tonearm.session import materialize

BUCKETS, SIZE, FILTERS, WIDTHS = 1 << 18, 16, 8, (1, 2, 3)
PER_CLASS = 3000
EPOCHS, BATCH, RATE, DECAY = 6, 32, 0.01, 1e-5
CACHE_WORDS = 400_000
CHUNK_WORDS = 100_000
SLICE_ROWS = 256
SCORE_BINS = 400
#: Labels that the common threshold weighs against those of a language.
SHRINK = 200
WORDS = re.compile(r"[^\W_]+")
#: Words up to here are one piece to the language models, if they have letters only.
PIECE = 40


def text_words(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def letter_runs(words: list[str]) -> list[str]:
    """``language.text_words`` of a text, from its ``text_words``."""
    out = []
    for w in words:
        if len(w) <= PIECE and w.isalpha():
            out.append(w)
        else:
            out += language.letters(w)
    return out


def word_buckets(word: str) -> tuple[int, int, int]:
    """Embedding rows of a word and of its two beginnings."""
    return tuple(xxhash.xxh3_64_intdigest(part) % BUCKETS for part in ("w" + word, "4" + word[:4], "5" + word[:5]))


class TextFilter:
    """Parameters and the forward and backward pass."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.embedding = rng.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32)
        self.filters = {w: rng.normal(0, 1 / np.sqrt(w * SIZE), (w * SIZE, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.offset = np.zeros(1, np.float32)
        self._scorer = None

    def __getstate__(self):
        return self.__dict__ | {"_scorer": None}

    def scorer(self, speaker) -> "Scorer":
        """One for all tasks of a worker: what it knows of words is kept."""
        if self._scorer is None or self._scorer.speaker is not speaker:
            self._scorer = Scorer(self, speaker)
        return self._scorer

    def parameters(self) -> list[np.ndarray]:
        return [*self.filters.values(), *self.bias.values(), self.out, self.offset]

    def backward(self, ids: np.ndarray, label: float, weight: float):
        """Loss gradient of one text; ``ids``: (words, 3) embedding rows.  Only the windows that hold a maximum matter."""
        x = self.embedding[ids].sum(1)
        pooled, best = [], {}
        for w in WIDTHS:
            n = len(x) - w + 1
            if n < 1:
                pooled.append(np.zeros(FILTERS, np.float32))
                continue
            rows = np.lib.stride_tricks.sliding_window_view(x, w, axis=0).transpose(0, 2, 1).reshape(n, w * SIZE)
            values = rows @ self.filters[w] + self.bias[w]
            top = values.argmax(0)
            best[w] = (rows[top], top)
            pooled.append(values[top, np.arange(FILTERS)])
        z = np.concatenate(pooled)
        active = np.maximum(z, 0)
        p = 1 / (1 + np.exp(-np.clip(active @ self.out + self.offset[0], -30, 30)))
        delta = np.float32(weight * (p - label))
        dz = np.where(z > 0, delta * self.out, 0).astype(np.float32)
        filters, bias, touched, moves = [], [], [], []
        for k, w in enumerate(WIDTHS):
            part = dz[k * FILTERS:(k + 1) * FILTERS]
            if w not in best:
                filters.append(np.zeros_like(self.filters[w]))
                bias.append(np.zeros(FILTERS, np.float32))
                continue
            rows, top = best[w]
            filters.append(rows.T * part)
            bias.append(part)
            back = (self.filters[w] * part).T.reshape(FILTERS, w, SIZE)
            for j in range(w):
                touched.append(ids[top + j])
                moves.append(back[:, j])
        return [*filters, *bias, delta * active, np.array([delta])], touched, moves, p

    def train(self, texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> "TextFilter":
        """Adam on mini-batches for the dense parts, AdaGrad for the embedding rows that a batch touches."""
        rows = [text_buckets(t) for t in texts]
        weight = {1: 0.5 / max(labels.mean(), 1e-9), 0: 0.5 / max(1 - labels.mean(), 1e-9)}
        dense = self.parameters()
        first, second = [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense]
        squares, step, rng = np.full(BUCKETS, 1e-3, np.float32), 0, np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                part = order[at:at + BATCH]
                sums, touched, moves = [np.zeros_like(p) for p in dense], [], []
                for i in part:
                    if len(rows[i]):
                        grads, t, m, _ = self.backward(rows[i], labels[i], weight[int(labels[i])])
                        for s, g in zip(sums, grads):
                            s += g
                        touched += t
                        moves += m
                step += 1
                for p, s, a, b in zip(dense, sums, first, second):
                    g = s / len(part) + DECAY * p
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= RATE * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)
                if touched:
                    at_rows = np.concatenate(touched)
                    move = np.concatenate(moves) / len(part)
                    unique, inverse = np.unique(at_rows.ravel(), return_inverse=True)
                    total = np.zeros((len(unique), SIZE), np.float32)
                    np.add.at(total, inverse, np.repeat(move, at_rows.shape[1], axis=0))
                    squares[unique] += (total ** 2).mean(1)
                    self.embedding[unique] -= 0.05 * total / np.sqrt(squares[unique])[:, None]
        return self

    def shares(self, ids: np.ndarray) -> np.ndarray:
        """(words, columns): what each word, given as embedding rows, adds to the windows it stands in (see ``SHARES``)."""
        x = self.embedding[ids].sum(1)
        return np.concatenate([x @ self.filters[w][j * SIZE:(j + 1) * SIZE] + (self.bias[w] if j == 0 else 0) for w, j in SHARES], axis=1)

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled, 0) @ self.out + self.offset[0]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def scores(self, texts: list[list[str]]) -> np.ndarray:
        """Probability of each whole text, given as its words."""
        return Scorer(self).read(texts)[0]


#: Columns of shares: for each width the word at each place of a window.
SHARES = [(w, j) for w in WIDTHS for j in range(w)]


class Scorer:
    """Reads texts with a classifier and, if given, language models; distinct words are looked up in one table."""

    def __init__(self, classifier: TextFilter, speaker: "language.Model | None" = None, most: int = CACHE_WORDS):
        self.classifier, self.speaker, self.most = classifier, speaker, most
        self.langs = len(speaker.langs) if speaker else 0
        self._index, self._shares, self._logs, self._chars = {}, None, None, None
        self._beginnings = {}

    def _buckets(self, words: list[str]) -> np.ndarray:
        """``word_buckets`` of words; beginnings recur, so theirs are kept."""
        known = self._beginnings
        if len(known) > self.most:
            known.clear()
        out = []
        for word in words:
            for begin in ("4" + word[:4], "5" + word[:5]):
                if begin not in known:
                    known[begin] = xxhash.xxh3_64_intdigest(begin) % BUCKETS
            out.append((xxhash.xxh3_64_intdigest("w" + word) % BUCKETS, known["4" + word[:4]], known["5" + word[:5]]))
        return np.array(out, np.int64).reshape(-1, 3)

    def _spoken(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log probabilities in every language, characters) of words: the sums of their letter runs."""
        runs = [(i, run) for i, word in enumerate(words) for run in letter_runs([word])]
        logs, chars = np.zeros((len(words), self.langs), np.float32), np.zeros(len(words), np.int64)
        if runs and self.langs:
            at = np.fromiter((i for i, _ in runs), np.int64, len(runs))
            np.add.at(logs, at, self.speaker.word_scores([run for _, run in runs]))
            np.add.at(chars, at, np.fromiter((len(run) + 1 for _, run in runs), np.int64, len(runs)))
        return logs, chars

    def rows(self, words: list[str]) -> np.ndarray:
        """Row of each word in the table; new words are added, a full table is emptied."""
        index = self._index
        fresh = [*set(words).difference(index)]
        if self._shares is None or len(index) + len(fresh) > len(self._shares):
            fresh, index = [*set(words)], {}
            self._index, size = index, max(self.most, len(fresh))
            self._shares = np.zeros((size, len(SHARES) * FILTERS), np.float32)
            self._logs, self._chars = np.zeros((size, self.langs), np.float32), np.zeros(size, np.int64)
        for start in range(0, len(fresh), 20_000):
            new, at = fresh[start:start + 20_000], len(index)
            self._shares[at:at + len(new)] = self.classifier.shares(self._buckets(new))
            self._logs[at:at + len(new)], self._chars[at:at + len(new)] = self._spoken(new)
            index.update(zip(new, range(at, at + len(new))))
        return np.fromiter(map(index.__getitem__, words), np.int64, len(words))

    def read(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probability, log probabilities in every language, characters) of whole texts; long ones in overlapping pieces."""
        pooled = np.full((len(texts), len(WIDTHS) * FILTERS), -np.inf, np.float32)
        logs, chars = np.zeros((len(texts), self.langs)), np.zeros(len(texts), np.int64)
        pieces, owners, own, size = [], [], [], 0

        def flush():
            if pieces:
                self._pool(pieces, owners, own, pooled, logs, chars)
            for part in (pieces, owners, own):
                part.clear()

        for i, words in enumerate(texts):
            for at in range(0, len(words), CHUNK_WORDS):
                piece = words[at:at + CHUNK_WORDS + max(WIDTHS) - 1]
                pieces.append(piece)
                owners.append(i)
                own.append(min(CHUNK_WORDS, len(piece)))  # the others are read again in the next piece
                size += len(piece)
                if size >= CHUNK_WORDS:
                    flush()
                    size = 0
        flush()
        return self.classifier.probability(pooled), logs, chars

    def _pool(self, pieces, owners, own, pooled, logs, chars):
        """Add pieces of at least one word: filter maxima, sums of log probabilities and characters."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        start, owner = ends - sizes, np.array(owners)
        rows = self.rows([word for piece in pieces for word in piece])
        if self.langs:
            bounds = np.stack([start, start + np.array(own)], 1).ravel()
            bounds = bounds[:-1] if bounds[-1] == len(rows) else bounds
            for values, out in ((self._logs, logs), (self._chars, chars)):
                np.add.at(out, owner, np.add.reduceat(values[rows].astype(out.dtype), bounds, axis=0)[::2])
        shares = self._shares[rows]
        column = {place: slice(k * FILTERS, (k + 1) * FILTERS) for k, place in enumerate(SHARES)}
        for k, w in enumerate(WIDTHS):
            has = np.flatnonzero(sizes >= w)
            if not len(has):
                continue
            n = len(rows) - w + 1
            values = np.full((n + 1, FILTERS), -np.inf, np.float32)
            values[:n] = shares[:n, column[w, 0]]
            for j in range(1, w):
                values[:n] += shares[j:j + n, column[w, j]]
            # windows that run into the next text are left out: pairs of (first, past last) per text
            bounds = np.stack([start[has], ends[has] - w + 1], 1).ravel()
            np.maximum.at(pooled[:, k * FILTERS:(k + 1) * FILTERS], owner[has], np.maximum.reduceat(values, bounds)[::2])


def text_buckets(text: str | None) -> np.ndarray:
    return np.array([word_buckets(w) for w in text_words(text)], np.int64).reshape(-1, 3)


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS):
    """(texts, labels) of at most ``per_class`` labelled rows of each label from folds 2 to 4."""
    known = labels.filter(language.fold(F.col("doc_id")) > 1)
    order = F.xxhash64("doc_id", F.lit("train"))
    parts = [known.filter(F.col("toxic") == y).orderBy(order, "doc_id").limit(per_class) for y in (1, 0)]
    chosen = parts[0].unionByName(parts[1]).withColumnRenamed("doc_id", "__id")  # at most 2 * per_class rows: sent to all
    rows = docs.join(F.broadcast(chosen), docs["doc_id"] == chosen["__id"]).select("doc_id", "text", "toxic")
    # one text of each chosen id: no id is left out where ids repeat
    once = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "toxic")).alias("r"))
    rows = once.orderBy("doc_id").select("r.text", "r.toxic").toPandas()
    return rows["text"].tolist(), rows["toxic"].to_numpy(float)


def thresholds(held: dict[str, tuple[np.ndarray, np.ndarray]]) -> tuple[dict[str, float], float]:
    """Best cut per language from (toxic, other) score histograms, and the common one."""
    def cuts(toxic, other):
        """Balanced share of right answers at each cut between bins."""
        hit = toxic.sum() - np.concatenate([[0], np.cumsum(toxic)])
        clean = np.concatenate([[0], np.cumsum(other)])
        return (hit / max(toxic.sum(), 1) + clean / max(other.sum(), 1)) / 2

    def middle(values):
        best = np.flatnonzero(values >= values.max() - 1e-9)
        return float(np.clip(best.mean() / SCORE_BINS, 0.02, 0.98))

    if not held:
        return {}, 0.5
    toxic, other = sum(t for t, _ in held.values()), sum(o for _, o in held.values())
    common = cuts(toxic, other)
    if not toxic.sum() or not other.sum():
        return {}, 0.5
    out = {}
    for lang, (t, o) in held.items():
        share = min(t.sum(), o.sum())
        out[lang] = middle((share * cuts(t, o) + SHRINK * common) / (share + SHRINK)) if share else middle(common)
    return out, middle(common)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                   per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted, lang_pred of every row; ``labels`` has doc_id and toxic."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    marked = materialize(labels.filter(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    texts, y = training_rows(rows, marked, per_class)
    held_out = (language.fold(F.col("doc_id")) == 0).alias("held_out")
    if len(set(y)) < 2:
        return rows.select("doc_id", held_out, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(None).cast("string").alias("lang_pred"))
    classifier = spark.sparkContext.broadcast(TextFilter().train(texts, y))
    speaker = spark.sparkContext.broadcast(language.fit(rows.filter(language.fold(F.col("doc_id")) > 1).select("lang", "text")))

    def run(batches):
        scorer = classifier.value.scorer(speaker.value)
        for batch in (whole.slice(at, SLICE_ROWS) for whole in batches for at in range(0, whole.num_rows, SLICE_ROWS)):
            score, logs, chars = scorer.read(list(map(text_words, batch.column(1).to_pylist())))
            guess = language.decide(speaker.value, -logs / np.maximum(chars, 1)[:, None], chars)[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(guess, pa.string())], names=["doc_id", "raw", "guess"])

    kind = dict(rows.dtypes)["doc_id"]
    raw = materialize(rows.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, raw double, guess string"))
    bin_ = F.least(F.floor(F.col("raw") * SCORE_BINS), F.lit(SCORE_BINS - 1)).cast("int")
    held: dict = {}
    counted = raw.filter(language.fold(F.col("doc_id")) == 1).join(marked, "doc_id").groupBy("guess", bin_.alias("b"), "toxic").count()
    for row in counted.collect():  # languages x bins x labels
        pair = held.setdefault(row["guess"], (np.zeros(SCORE_BINS), np.zeros(SCORE_BINS)))
        pair[0 if row["toxic"] else 1][row["b"]] += row["count"]
    cuts, common = thresholds(held)
    table_ = spark.createDataFrame([(k, v) for k, v in cuts.items()], "__guess string, cut double")
    cut = F.coalesce("cut", F.lit(common))
    bent = F.when(F.col("raw") < cut, F.col("raw") / (2 * cut)).otherwise(0.5 + (F.col("raw") - cut) / (2 * (1 - cut)))
    judged = raw.join(table_, raw["guess"] == table_["__guess"], "left").withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), bent)))
    return judged.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col("guess").alias("lang_pred"))


def op9_toxicity(spark, folder):
    return score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLE: dict[str, str] = {}
