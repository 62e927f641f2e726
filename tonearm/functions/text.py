"""Text keys and search expressions.  Built-in Spark functions only, except NFKD folding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from tonearm.functions.taxonomy import EDITION_SUFFIX


def col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clean(value) -> Column:
    """Null-safe trim + lower."""
    return F.lower(F.trim(F.coalesce(col(value), F.lit(""))))


def words_only(value, keep: str = r"\p{L}\p{N}") -> Column:
    return F.trim(F.regexp_replace(value, f"[^{keep}]+", " "))


def title_key(title, dialect: str = "hosted") -> Column:
    keep = r"\p{L}\p{N}" if dialect == "hosted" else r"\p{L}\p{N}_"
    return words_only(F.regexp_replace(clean(title), EDITION_SUFFIX, ""), keep)


def recording_identity(title, artist, dialect: str = "hosted") -> Column:
    """One key per recording: edition suffix removed, punctuation folded."""
    keep = r"\p{L}\p{N}" if dialect == "hosted" else r"\p{L}\p{N}_"
    return F.concat(title_key(title, dialect), F.lit("::"), words_only(clean(artist), keep))


NOT_ASCII = r"[^\x00-\x7f]"


@F.pandas_udf(T.StringType())
def _nfkd(values: pd.Series) -> pd.Series:
    return values.str.normalize("NFKD")


@F.pandas_udf(T.StringType())
def _casefold(values: pd.Series) -> pd.Series:
    return values.str.casefold()


def nfkd(value) -> Column:
    """Compatibility decomposition.  Plain ASCII strings are not sent to Python: it gets a null in their place."""
    value = col(value)
    other = value.rlike(NOT_ASCII)
    return F.when(other, _nfkd(F.when(other, value))).otherwise(value)


def casefold(value) -> Column:
    value = col(value)
    other = value.rlike(NOT_ASCII)
    return F.when(other, _casefold(F.when(other, value))).otherwise(F.lower(value))


def identity(title, artist, mode: str = "exact") -> Column:
    """exact: trimmed and folded; ascii: only a-z0-9 kept; unicode: NFKD, then words."""
    def one(value):
        value = F.coalesce(col(value), F.lit(""))
        if mode == "exact":
            return F.trim(casefold(value))
        if mode == "ascii":
            return F.trim(F.regexp_replace(casefold(value), "[^a-z0-9]+", " "))
        if mode == "unicode":
            return words_only(casefold(nfkd(value)), r"\p{L}\p{N}_")
        raise ValueError(f"unknown identity mode {mode}")

    return F.concat(one(title), F.lit("::"), one(artist))


def normalize_search(value) -> Column:
    bare = F.translate(F.lower(F.coalesce(col(value), F.lit(""))), "'’`", "")
    return words_only(bare)


def normalize_search_folded(value) -> Column:
    """As normalize_search, with accents removed."""
    folded = F.regexp_replace(nfkd(F.coalesce(col(value), F.lit(""))), r"[̀-ͯ]", "")
    return words_only(F.translate(F.lower(folded), "'’`", ""))


def search_text(title, artist) -> Column:
    return normalize_search(F.concat_ws(" ", F.coalesce(col(title), F.lit("")), F.coalesce(col(artist), F.lit(""))))


def edit_similarity(a, b) -> Column:
    a, b = F.substring(col(a), 1, 180), F.substring(col(b), 1, 180)
    longest = F.greatest(F.length(a), F.length(b)).cast("double")
    return (
        F.when(a == b, F.lit(1.0))
        .when((a == "") | (b == ""), F.lit(0.0))
        .otherwise(F.greatest(F.lit(0.0), 1 - F.levenshtein(a, b) / longest))
    )


def tokens(value) -> Column:
    return F.filter(F.split(col(value), " "), lambda w: w != "")


def token_match(q: Column, c: Column) -> Column:
    longest = F.greatest(F.length(q), F.length(c))
    needed = F.when(longest <= 5, F.lit(0.8)).otherwise(F.lit(0.72))
    long_enough = (F.length(q) >= 4) & (F.length(c) >= 4)
    return (q == c) | (long_enough & (edit_similarity(q, c) >= needed))


def token_coverage(q_tokens, c_tokens) -> Column:
    q, c = col(q_tokens), col(c_tokens)
    hits = F.size(F.filter(q, lambda t: F.exists(c, lambda u: token_match(t, u))))
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(hits / F.size(q))


def add_relevance(df, query, title, artist, analysed, playable, out: str = "relevance"):
    """Add the relevance of already normalised query, title and artist columns (formula in README).

    Token arrays and coverages become columns first: an expression inside a lambda would be
    evaluated again for every token.
    """
    q, t, a = col(query), col(title), col(artist)
    df = df.withColumns({"_q": q, "_t": t, "_qt": tokens(q), "_tt": tokens(t), "_at": tokens(a),
                         "_combined": F.trim(F.concat_ws(" ", t, a)), "_reverse": F.trim(F.concat_ws(" ", a, t))})
    df = df.withColumn("_ct", F.concat("_tt", "_at"))
    df = df.withColumns({"_cov": token_coverage("_qt", "_ct"), "_tcov": token_coverage("_qt", "_tt"),
                         "_acov": token_coverage("_qt", "_at")})
    bonus = lambda cond, points: F.when(cond, F.lit(float(points))).otherwise(F.lit(0.0))
    c = {n: F.col(f"_{n}") for n in ("q", "t", "combined", "reverse", "cov", "tcov", "acov")}
    either = lambda test: test(c["combined"], c["q"]) | test(c["reverse"], c["q"])
    score = c["cov"] * 40 + c["tcov"] * 10 + c["acov"] * 6
    score = score + bonus(either(lambda x, y: x == y), 80) + bonus(c["t"] == c["q"], 65)
    score = score + bonus(either(F.contains), 30) + bonus(F.contains(c["q"], c["t"]) & (F.length(c["t"]) >= 3), 22)
    score = score + bonus(either(F.startswith), 12)
    score = score + edit_similarity(c["q"], c["combined"]) * 14 + edit_similarity(c["q"], c["t"]) * 6
    score = score - F.when(c["cov"] < 1, (1 - c["cov"]) * 18).otherwise(F.lit(0.0))
    score = score + bonus(col(analysed), 0.35) + bonus(col(playable), 0.15)
    hidden = [n for n in ("_q", "_t", "_qt", "_tt", "_at", "_combined", "_reverse", "_ct", "_cov", "_tcov", "_acov")]
    return df.withColumn(out, score).drop(*hidden)


def trigrams(value) -> Column:
    """Distinct trigrams; each word is padded with two leading and one trailing blank."""
    return F.array_distinct(ordered_trigrams(value))


def ordered_trigrams(value) -> Column:
    padded = F.transform(tokens(value), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(
        padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))
    )
    return F.flatten(grams)


def trigram_similarity(a, b) -> Column:
    """Shared over united distinct trigrams of two trigram arrays."""
    a, b = col(a), col(b)
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def _best_run(query: set, run: list) -> float:
    """Best shared/united ratio of ``query`` with a contiguous run that starts and ends at a shared trigram."""
    best, size = 0.0, len(query)
    for start, gram in enumerate(run):
        if gram not in query:
            continue
        seen, shared = set(), 0
        for other in run[start:]:
            if other in seen:
                continue
            seen.add(other)
            if other in query:
                shared += 1
                best = max(best, shared / (size + len(seen) - shared))
    return best


@F.pandas_udf(T.DoubleType())
def word_similarity(query_grams: pd.Series, target_grams: pd.Series) -> pd.Series:
    """Best similarity of a query's distinct trigrams with any contiguous run of a target's ordered trigrams.

    The running counts of a sliding run have no built-in form; nested higher-order functions
    give the same numbers about fifty times slower, so this one step is an Arrow function.
    """
    return pd.Series([_best_run(set(q), list(t)) for q, t in zip(query_grams, target_grams)], dtype="float64")


def artist_set(credit) -> Column:
    """Comparable names in a multi-artist credit."""
    parts = F.split(F.lower(F.coalesce(col(credit), F.lit(""))), r"\s*(?:,|&|\bfeat\.?\b|\bfeaturing\b|\bx\b)\s*")
    names = F.transform(F.filter(parts, lambda p: F.trim(p) != ""),
                        lambda p: F.trim(F.regexp_replace(p, "[^a-z0-9]+", " ")))
    return F.array_distinct(names)


def stable_hash(value, dialect: str = "hosted") -> Column:
    """Deterministic id hash in [0, 1)."""
    chars = F.filter(F.split(col(value), ""), lambda c: c != "")
    if dialect == "hosted":
        total = F.aggregate(chars, F.lit(7).cast("bigint"), lambda h, c: (h * 31 + F.ascii(c)) % 997)
    else:
        weighted = F.transform(chars, lambda c, i: (i + 1).cast("bigint") * F.ascii(c))
        total = F.aggregate(weighted, F.lit(0).cast("bigint"), lambda s, x: s + x) % 997
    return total / F.lit(997.0)
