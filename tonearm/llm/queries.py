"""The queries of this subpackage and their check SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("quality", "mixing", "warc", "urls", "decontaminate", "substrings", "near", "language", "toxicity", "tokens", "spelling", "lines", "whitening")

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"tonearm.llm.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLE.update(_module.ORACLE)


def pipeline(spark, folder):
    """All stages of corpus_pipeline.py."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


def _pipeline_sql() -> str:
    import corpus_pipeline

    return corpus_pipeline.ORACLE_SQL


QUERIES["pipeline"] = pipeline
ORACLE["pipeline"] = _pipeline_sql()
