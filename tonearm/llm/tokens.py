"""Edit-aware token counts.

A text is cut into pre-tokens; leaves of 64 neighbouring pre-tokens carry their
number of characters and tokens, and a segment tree holds the sums above.  An
edit is located by descending the character sums.  Only the leaves it touches are
cut again, from the last boundary that the edit cannot have moved (two
characters of context before it) to the first old boundary behind it that the
new cut meets; from there on the old pre-tokens hold, since the cut of a text
depends only on what follows a boundary.  The sums on the paths of the touched
leaves are updated; no other leaf is read.

Edits of a text are (start, stop, replacement) in code points of the stored text.
They are applied from the last to the first; one that begins before the end of an
earlier one is left out.  Offsets behind the end are moved to the end.

Null texts have no tokens and no leaves, and edits of them are left out; empty
texts count 0 and may be edited.  Repeated rows and extra columns stay apart.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F

from tonearm.llm.common import table

#: The public vocabulary of the registered query, and the way it cuts texts (fixed values).
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF = 64
#: Characters behind its end that a pre-token's cut may have looked at.
CONTEXT = 2
CACHE = 500_000


class Counter(dict):
    """pre-token -> number of tokens, each encoded once; emptied at ``CACHE`` entries."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(pattern)

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[piece] = len(self.encoding.encode_ordinary(piece))
        return value

    def counts(self, pieces: list[str]) -> list[int]:
        return list(map(self.__getitem__, pieces))


@lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


class SegmentTree:
    """Sums of (characters, tokens, pre-tokens) over leaves; node i has the children 2i and 2i + 1."""

    def __init__(self, leaves: list[tuple[int, int, int]]):
        self.size = 1
        while self.size < len(leaves):
            self.size *= 2
        self.n = len(leaves)
        self.sums = [(0, 0, 0)] * self.size + list(leaves) + [(0, 0, 0)] * (self.size - len(leaves))
        for node in range(self.size - 1, 0, -1):
            self._sum(node)

    def _sum(self, node: int) -> None:
        a, b = self.sums[2 * node], self.sums[2 * node + 1]
        self.sums[node] = (a[0] + b[0], a[1] + b[1], a[2] + b[2])

    def set(self, leaf: int, value: tuple[int, int, int]) -> None:
        node = leaf + self.size
        self.sums[node] = value
        while node > 1:
            node //= 2
            self._sum(node)

    def leaf_at(self, place: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds character ``place``; the last one for the end."""
        if place >= self.sums[1][0]:
            leaf = max(i for i in range(self.n) if i == 0 or self.sums[self.size + i][0])
            return leaf, self.sums[1][0] - self.sums[self.size + leaf][0]
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if place >= start + self.sums[node][0]:
                start += self.sums[node][0]
                node += 1
        return node - self.size, start

    def leaves(self) -> list[tuple[int, int, int]]:
        return self.sums[self.size:self.size + self.n]


def build(text: str, count: Counter) -> SegmentTree:
    pieces = count.cut.findall(text)
    tokens, lengths = count.counts(pieces), list(map(len, pieces))
    return SegmentTree([(sum(lengths[i:i + LEAF]), sum(tokens[i:i + LEAF]), len(pieces[i:i + LEAF])) for i in range(0, len(pieces), LEAF)] or [(0, 0, 0)])


class EditedText:
    """A text under edits that come from its end to its start."""

    def __init__(self, text: str, leaves: list[tuple[int, int, int]], count: Counter):
        self.text, self.tree, self.count, self.encoded = text, SegmentTree(leaves or [(0, 0, 0)]), count, 0

    def apply(self, start: int, stop: int, replacement: str) -> None:
        first, base = self.tree.leaf_at(max(0, start - CONTEXT - 1))
        last, at = self.tree.leaf_at(stop)
        end = at + self.tree.sums[self.tree.size + last][0]
        total = self.tree.sums[1][0]
        while True:
            old = self.text[base:end]
            new = old[:start - base] + replacement + old[stop - base:]
            behind = self.text[end:end + CONTEXT]
            found = self._again(old, behind, new, start - base, stop - base, len(replacement), end >= total)
            if found is not None:
                break
            last += 1  # the cut has not met an old boundary: read one leaf more
            while self.tree.sums[self.tree.size + last][0] == 0:
                last += 1
            end += self.tree.sums[self.tree.size + last][0]
        old_pieces, first_changed, met, fresh = found
        self.encoded += len(fresh)
        kept_before, kept_after = old_pieces[:first_changed], old_pieces[met:]
        self._store(first, last, kept_before, fresh, kept_after)
        self.text = self.text[:start] + replacement + self.text[stop:]

    def _again(self, old, behind, new, start, stop, size, whole):
        """(old pieces, first changed one, old piece met again, new pieces between), or None to read further."""
        pieces, ends = [], []
        for match in self.count.cut.finditer(old + behind):  # a leaf ends at a boundary, seen with what follows it
            if match.start() >= len(old):
                break
            pieces.append(match.group())
            ends.append(match.end())
        first = next((i for i, e in enumerate(ends) if e + CONTEXT > start), len(pieces))
        place = ends[first - 1] if first else 0
        boundary = {0: 0} | {e: i + 1 for i, e in enumerate(ends)}
        shift, fresh = size - (stop - start), []
        while True:
            met = boundary.get(place - shift)
            if met is not None and place >= start + size and place - shift >= stop and met >= first:
                return pieces, first, met, fresh
            piece = self.count.cut.match(new, place)
            if piece is None or (not whole and piece.end() + CONTEXT > len(new)):
                return (pieces, first, len(pieces), fresh) if whole and place >= len(new) else None
            fresh.append(piece.group())
            place = piece.end()

    def _store(self, first, last, before, fresh, after):
        """The pieces go back to the leaves: the changed ones to the first, the rest where it was."""
        rest, leaf = list(after), last
        while leaf > first:
            size = self.tree.sums[self.tree.size + leaf][2]
            own = rest[len(rest) - min(size, len(rest)):]
            rest = rest[:len(rest) - len(own)]
            self._set(leaf, own)
            leaf -= 1
        self._set(first, before + fresh + rest)

    def _set(self, leaf, pieces):
        self.tree.set(leaf, (sum(map(len, pieces)), sum(self.count.counts(pieces)), len(pieces)))


TREE = pa.list_(pa.struct([("chars", pa.int64()), ("tokens", pa.int64()), ("pieces", pa.int64())]))
TREE_SQL = "array<struct<chars:bigint,tokens:bigint,pieces:bigint>>"
EDIT_SQL = "array<struct<start:bigint,stop:bigint,replacement:string>>"


def _tree_column(trees):
    return pa.array([None if t is None else [dict(zip(("chars", "tokens", "pieces"), leaf)) for leaf in t] for t in trees], TREE)


def token_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """doc_id, text, n_tokens, tree (its leaves) of every row."""
    def run(batches):
        count = counter(path, pattern)
        for batch in batches:
            trees = [None if t is None else build(t, count) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([t.sums[1][1] if t else 0 for t in trees], pa.int64()),
                                              _tree_column([t and t.leaves() for t in trees])], names=["doc_id", "text", "n_tokens", "tree"])

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, f"doc_id {dict(chosen.dtypes)['doc_id']}, text string, n_tokens long, tree {TREE_SQL}")


def ordered_edits(edits, size: int) -> list[tuple[int, int, str]]:
    """Edits from the last to the first, without those that begin inside an earlier one."""
    out, end = [], 0
    for edit in sorted(edits or [], key=lambda e: (e["start"], e["stop"], e["replacement"] or "")):
        start = min(max(edit["start"], 0), size)
        stop = min(max(edit["stop"], start), size)
        if start >= end:
            out.append((start, stop, edit["replacement"] or ""))
            end = stop
    return out[::-1]


def apply_edits(trees: DataFrame, path: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """Rows of ``token_trees`` with a column ``edits``: the edited text, its tokens and tree, and what was encoded for it.

    Columns doc_id, text, n_tokens (before), n_edits, n_tokens_after, n_pieces, n_encoded, tree.
    """
    def run(batches):
        count = counter(path, pattern)
        for batch in batches:
            rows = []
            for doc, text, before, tree, edits in zip(*(c.to_pylist() for c in batch.columns)):
                done = [] if text is None else ordered_edits(edits, len(text))
                edited = EditedText(text or "", [(l["chars"], l["tokens"], l["pieces"]) for l in tree or []], count)
                for edit in done:
                    edited.apply(*edit)
                _, tokens, pieces = edited.tree.sums[1]
                rows.append((doc, None if text is None else edited.text, before, len(done), tokens, pieces, edited.encoded,
                             None if text is None else edited.tree.leaves()))
            if rows:
                columns = [*zip(*rows)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(columns[1], pa.string()), *(pa.array(c, pa.int64()) for c in columns[2:7]), _tree_column(columns[7])],
                    names=["doc_id", "text", "n_tokens", "n_edits", "n_tokens_after", "n_pieces", "n_encoded", "tree"])

    chosen = trees.select("doc_id", "text", "n_tokens", "tree", "edits")
    return chosen.mapInArrow(run, f"doc_id {dict(chosen.dtypes)['doc_id']}, text string, n_tokens long, n_edits long, n_tokens_after long, "
                                  f"n_pieces long, n_encoded long, tree {TREE_SQL}")


def attach_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """Rows of ``trees`` with their edits gathered from a table (doc_id, start, stop, replacement).

    All edits of one text are applied by the task that holds the text.
    """
    per_text = edits.groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_list(F.struct(
        F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), F.col("replacement"))).alias("edits"))
    return trees.join(per_text, trees["doc_id"].eqNullSafe(per_text["__doc"]), "left").drop("__doc")


MAIL = regex.compile(r"[\w.+-]+@[\w-]+\.[\w.-]*\w")
NUMBERS = regex.compile(r"\b(?:\d{1,3}\.){3}\d{1,3}\b|\b[0-9a-f]{32,}\b|\+?\d[\d ()-]{7,}\d")


def private_spans(text: str | None) -> list[dict]:
    """Edits that replace mail addresses, network addresses, long hexadecimal keys and telephone numbers."""
    if not text:
        return []
    found = [(m.span(), "<mail>") for m in MAIL.finditer(text)] if "@" in text else []
    found += [(m.span(), "<number>") for m in NUMBERS.finditer(text)]
    return [{"start": a, "stop": b, "replacement": r} for (a, b), r in found]


def with_private_edits(trees: DataFrame) -> DataFrame:
    """Rows of ``token_trees`` with the edits that take private data out of the text."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("replacement", pa.string())]))

    def run(batches):
        for batch in batches:
            edits = pa.array([private_spans(t) for t in batch.column(1).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, edits], names=["doc_id", "text", "n_tokens", "tree", "edits"])

    return trees.mapInArrow(run, f"doc_id {dict(trees.dtypes)['doc_id']}, text string, n_tokens long, tree {TREE_SQL}, edits {EDIT_SQL}")


def op5_token_counts(spark, folder):
    """Tokens of every document before and after private data is replaced."""
    edited = apply_edits(with_private_edits(token_trees(table(spark, folder, "documents"))))
    return edited.select("doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_pieces", "n_encoded")


QUERIES = {"op5_token_counts": op5_token_counts}
ORACLE: dict[str, str] = {}
