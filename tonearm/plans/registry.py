"""Registry of named queries: a Spark callable and, where SQL can say it, the check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tonearm.plans.oracle import with_views
from tonearm.sources.adapters import Catalogue

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: dict[str, str] | None = None):
    """Register ``fn(catalogue) -> DataFrame`` under ``name``."""
    def wrap(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Catalogue.of(spark, folder))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        run.__module__ = fn.__module__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_views(sql, views)
        return fn

    return wrap


def r6(column, name: str | None = None):
    """Round to 6 decimals for comparison (adding zero turns -0.0 into 0.0)."""
    value = F.col(column) if isinstance(column, str) else column
    out = F.round(value, 6) + F.lit(0.0)
    return out.alias(name or column) if (name or isinstance(column, str)) else out


def stamp(column, name: str | None = None):
    return F.date_format(F.col(column), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name or column)


STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"


def r6s(expr: str, name: str | None = None) -> str:
    return f"round({expr}, 6) + 0.0 AS {name or expr.split('.')[-1]}"
