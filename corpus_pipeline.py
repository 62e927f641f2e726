"""The corpus pipeline: five stages over ``documents``.

Each stage takes what the one before kept.  All but the last return the columns
of ``documents``; the last returns the mix: doc_id, size, source_size, target and
taken of every document that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tonearm.llm import decontaminate, mixing, near, quality, substrings
from tonearm.llm.common import table
from tonearm.session import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that fail a base rule, and those of rejected hosts, go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each class of near copies stays, the one with the smallest id."""
    return near.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Words in passages that a document with a smaller id also has are cut out; the document stays."""
    return substrings.remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, folder, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """How many words of each document the mix takes."""
    weights = mixing.label_weights(table(spark, folder, "labels"))
    return mixing.mix(docs, quality=weights).select("doc_id", "size", "source_size", "target", "taken")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs


ORACLE_SQL = f"""WITH RECURSIVE {quality.stats_sql('documents')},
    good AS MATERIALIZED (SELECT d.* FROM documents d JOIN stats s USING (doc_id) WHERE s.kept),
    {near.near_sql('good')},
    single AS MATERIALIZED (SELECT d.* FROM good d JOIN near n USING (doc_id) WHERE n.class_id = d.doc_id),
    {substrings.repeats_sql('single')},
    trimmed AS MATERIALIZED (SELECT doc_id, CASE WHEN n_removed = 0 THEN text ELSE kept END AS text, lang, source FROM single JOIN cut USING (doc_id)),
    {decontaminate.leaks_sql('trimmed')},
    clean AS MATERIALIZED (SELECT * FROM trimmed WHERE doc_id NOT IN (SELECT doc_id FROM leaks)),
    {mixing.mix_sql('clean')}
    SELECT doc_id, size, source_size, target, taken FROM mixed"""
