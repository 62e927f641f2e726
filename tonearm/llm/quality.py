"""Quality rules judged per document and per host.

Every text is measured once.  Failures of each rule are summed per host, the
rates are shrunk towards an empirical beta prior (fitted by moments over all
hosts), and the host verdicts are joined back: a document stays if it fails no
base rule and its host is not rejected.

Null texts count as empty (they fail the length rule).  Null hosts are one host
of their own.  Repeated rows are measured and counted each.  An empty table
gives an empty result.  Extra columns of the input are not read, so their names
cannot clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tonearm.llm.common import arrow_rows, as_bytes, table
from tonearm.session import materialize

MIN_WORDS = 50
REPEAT_PERCENT = 50
#: A host goes when the shrunk rate of one of its rules is above this.
MAX_RATE = 0.5

SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"
NOT_WORD_START = WHITE + bytes(range(0x80, 0xC0))

RULES = ("short", "repetitive")


def measure(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip(WHITE)]
    return (len(words), len(text.translate(None, NOT_WORD_START)), len(text) - len(text.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words))


def repeated_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    codes = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(codes.__getitem__, words), np.int64, n)
    size = len(codes)
    pairs = ids[:-1] * size + ids[1:]
    if size ** 3 >= 1 << 62:  # keep the triple code inside 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    triples = pairs[:-1] * size + ids[2:]
    order = np.sort(triples)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(triples, twice)
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift:n - 2 + shift] |= hit
    return int(covered.sum())


def document_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host and the five measures of every text."""
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"),
                         F.col(text_col).alias("text"))
    kinds = dict(chosen.dtypes)
    schema = f"doc_id {kinds['doc_id']}, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"

    def run(batches):
        def columns(batch):
            rows = [measure(text or b"") for text in as_bytes(batch.column(2))]
            return [batch.column(0), batch.column(1).cast(pa.string()), *zip(*rows)]

        for batch in batches:
            if batch.num_rows:
                target = pa.schema([("doc_id", batch.schema.field(0).type), ("host", pa.string()),
                                    *((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))])
                yield from arrow_rows([batch], target, columns)

    stats = chosen.mapInArrow(run, schema)
    short = F.col("n_words") < MIN_WORDS
    repetitive = 100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")
    return stats.withColumns({"short": short, "repetitive": repetitive, "base_failed": short | repetitive})


def host_rates(stats: DataFrame, rules=RULES) -> DataFrame:
    """Per host: documents, failures of each rule and the shrunk rate of each.

    With pooled rate m and variance v between hosts (the binomial part taken
    off) the prior is beta(m k, (1-m) k), k = m(1-m)/v - 1.  Without variance
    between hosts every host gets the pooled rate.
    """
    hosts = materialize(stats.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_docs"), *(F.sum(F.col(r).cast("long")).alias(f"failed_{r}") for r in rules)))
    moments = hosts.agg(F.sum("n_docs").alias("n"), F.count(F.lit(1)).alias("k"),
                        *(F.sum(f"failed_{r}").alias(f"f_{r}") for r in rules),
                        *(F.sum(F.col(f"failed_{r}") * F.col(f"failed_{r}") / F.col("n_docs")).alias(f"q_{r}") for r in rules)).first()
    out = hosts
    for rule in rules:
        out = out.withColumn(f"rate_{rule}", _shrunk(rule, moments))
    return out


def _shrunk(rule: str, moments):
    total, hosts = moments["n"] or 0, moments["k"] or 0
    if not total:
        return F.lit(0.0)
    mean = moments[f"f_{rule}"] / total
    noise = mean * (1 - mean) * hosts / total
    between = moments[f"q_{rule}"] / total - mean * mean - noise
    if between <= 1e-12 or not 0 < mean < 1:
        return F.lit(float(mean))
    strength = max(mean * (1 - mean) / between - 1, 0.0)
    return (F.col(f"failed_{rule}") + mean * strength) / (F.col("n_docs") + strength)


def rejected(max_rate: float = MAX_RATE, rules=RULES):
    return F.greatest(*(F.col(f"rate_{r}") for r in rules), F.lit(0.0)) > max_rate


def host_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
               max_rate: float = MAX_RATE) -> DataFrame:
    """Measures, ``base_failed``, ``host_rejected`` and ``kept`` of every document."""
    stats = materialize(document_stats(docs, id_col, text_col, host_col))
    hosts = host_rates(stats).select(F.col("host").alias("__host"), rejected(max_rate).alias("host_rejected"))
    judged = stats.join(hosts, stats["host"].eqNullSafe(hosts["__host"]), "left").drop("__host")
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    The texts are measured twice (host totals, then the filter) instead of being
    shuffled; only rejected hosts are joined, by anti-join.
    """
    hosts = host_rates(document_stats(docs, text_col, text_col, host_col).drop("doc_id")).filter(rejected(max_rate))
    bad = hosts.select(F.col("host").alias("__host"))
    passed = docs.filter(_passes(F.col(text_col)))
    return passed.join(bad, passed[host_col].cast("string").eqNullSafe(bad["__host"]), "left_anti")


@F.pandas_udf(T.BooleanType())
def _passes(texts: pd.Series) -> pd.Series:
    out = []
    for text in texts:
        words = text.encode().split() if text is not None else []
        out.append(len(words) >= MIN_WORDS and 100 * repeated_words(words) <= REPEAT_PERCENT * len(words))
    return pd.Series(out, dtype=bool)


def op2_host_rules(spark, folder):
    return host_rules(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def stats_sql(source: str, name: str = "stats") -> str:
    """DuckDB common tables: ``{name}`` with the verdict of every row of ``source``."""
    return rf"""
    {name}_words AS (SELECT doc_id, source, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM {source}),
    {name}_tokens AS (SELECT doc_id, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS p FROM {name}_words),
    {name}_triples AS (SELECT doc_id, p, w || chr(1) || lead(w, 1) OVER o || chr(1) || lead(w, 2) OVER o AS t
        FROM {name}_tokens WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
    {name}_twice AS (SELECT doc_id, p FROM {name}_triples WHERE t IS NOT NULL
        QUALIFY count(*) OVER (PARTITION BY doc_id, t) >= 2),
    {name}_repeat AS (SELECT doc_id, count(DISTINCT p + s) AS n FROM {name}_twice, (VALUES (0), (1), (2)) v(s) GROUP BY doc_id),
    {name}_base AS (SELECT d.doc_id, d.source, CAST(len(words) AS BIGINT) AS n_words,
        CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
        FROM {name}_words d LEFT JOIN {name}_repeat r USING (doc_id)),
    {name}_rules AS (SELECT *, n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repetitive FROM {name}_base),
    {name}_long AS (SELECT source, 'short' AS rule, short AS failed FROM {name}_rules
        UNION ALL SELECT source, 'repetitive', repetitive FROM {name}_rules),
    {name}_hosts AS (SELECT source, rule, count(*) AS n, count(*) FILTER (failed) AS f FROM {name}_long GROUP BY source, rule),
    {name}_prior AS (SELECT rule, sum(f) / sum(n) AS m, sum(f * f / n) / sum(n) - (sum(f) / sum(n)) ^ 2
        - (sum(f) / sum(n)) * (1 - sum(f) / sum(n)) * count(*) / sum(n) AS v FROM {name}_hosts GROUP BY rule),
    {name}_rates AS (SELECT source, rule, CASE WHEN v <= 1e-12 OR m <= 0 OR m >= 1 THEN m
        ELSE (f + m * greatest(m * (1 - m) / v - 1, 0)) / (n + greatest(m * (1 - m) / v - 1, 0)) END AS rate
        FROM {name}_hosts JOIN {name}_prior USING (rule)),
    {name}_bad AS (SELECT source, max(rate) > {MAX_RATE} AS bad FROM {name}_rates GROUP BY source),
    {name} AS (SELECT s.*, s.short OR s.repetitive AS base_failed, NOT (s.short OR s.repetitive) AND NOT b.bad AS kept
        FROM {name}_rules s JOIN {name}_bad b ON s.source IS NOT DISTINCT FROM b.source)"""


QUERIES = {"op2_host_rules": op2_host_rules}
ORACLE = {"op2_host_rules": f"WITH {stats_sql('documents')} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, "
                            "n_repeat_words, base_failed, kept FROM stats"}
