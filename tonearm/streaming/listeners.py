"""Streaming form of the listener tables (file source, availableNow or continuous triggers).

Results are written per epoch and folded into snapshots (``sources.versions``), so the number
of files does not grow with the number of epochs.
"""

from __future__ import annotations

import uuid
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tonearm import schemas
from tonearm.operators.catalogue import last_by
from tonearm.operators.listeners import decode_feedback
from tonearm.session import checkpoint_dir
from tonearm.sources.versions import FoldedEpochs


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared checkpoint folder, for a run that nothing will continue."""
    return f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def run_available(df: DataFrame, mode: str, newest, base: str, fold: int = 8) -> DataFrame:
    """Drain what is there now; returns the rows that count, with their epoch.

    ``base`` (a shared folder that the caller names) holds the query's state and results: a later
    call with the same ``base`` goes on where this one stopped.  ``newest(rows)`` keeps of the rows of
    several epochs those that still count.
    """
    result = FoldedEpochs(df.sparkSession, f"{base.rstrip('/')}/out", newest, fold)
    query = (df.writeStream.outputMode(mode).option("checkpointLocation", f"{base.rstrip('/')}/state").trigger(availableNow=True)
             .foreachBatch(result.write).start())
    query.awaitTermination()
    return result.read()


def stream_taste(events: DataFrame) -> DataFrame:
    """Latest (user, track, liked, disliked) rows from an interaction stream.

    State is one small row per (user, track), never a growing set per user.  A repeated event
    changes no maximum and a late one still counts, so the table does not depend on how the events
    are cut into batches.
    """
    flags = events.select("user_id", "track_id", F.col("event_type").isin(schemas.POSITIVE_EVENTS).alias("liked"),
                        F.col("event_type").isin(schemas.NEGATIVE_EVENTS).alias("disliked"))
    return flags.groupBy("user_id", "track_id").agg(F.max("liked").alias("liked"), F.max("disliked").alias("disliked"))


def taste_now(events: DataFrame, base: str | None = None, fold: int = 8) -> DataFrame:
    """Run the taste stream over what is available and return the current table."""
    newest = lambda rows: last_by(rows, ["user_id", "track_id"], ["epoch"])
    rows = run_available(stream_taste(events), "update", newest, base or new_folder(events.sparkSession), fold)
    return rows.drop("epoch").filter("liked OR disliked")


LIST_STATE = "track_ids array<string>, reasons array<string>, stamps array<bigint>, events array<bigint>"
LIST_OUT = "user_id bigint, position bigint, track_id string, reason string, event_id bigint"


def bounded_feedback(limit: int = 100):
    """Stateful update of one listener's newest ``limit`` feedback rows, one per track."""
    def update(key, batches: Iterator[pd.DataFrame], state: GroupState):
        held = {}
        if state.exists:
            held = {t: (s, e, r) for t, r, s, e in zip(*state.get)}
        for pdf in batches:
            for t, r, s, e in zip(pdf["track_id"], pdf["reason"], pdf["stamp"], pdf["event_id"]):
                if t not in held or (s, e) > held[t][:2]:
                    held[t] = (int(s), int(e), r)
            newest = sorted(held.items(), key=lambda kv: kv[1][:2], reverse=True)[:limit]
            held = dict(newest)
        newest = sorted(held.items(), key=lambda kv: kv[1][:2], reverse=True)
        state.update(([t for t, _ in newest], [v[2] for _, v in newest], [v[0] for _, v in newest], [v[1] for _, v in newest]))
        yield pd.DataFrame({"user_id": [key[0]] * len(newest), "position": range(1, len(newest) + 1), "track_id": [t for t, _ in newest],
                            "reason": [v[2] for _, v in newest], "event_id": [v[1] for _, v in newest]})

    return update


def stream_feedback(events: DataFrame, limit: int = 100) -> DataFrame:
    rows = events.withColumn("reason", decode_feedback(F.col("value"))).filter(F.col("reason").isNotNull()).select(
        "user_id", "track_id", "reason", F.unix_micros("created_at").alias("stamp"), "event_id")
    return rows.groupBy("user_id").applyInPandasWithState(
        bounded_feedback(limit), LIST_OUT, LIST_STATE, "update", GroupStateTimeout.NoTimeout)


def feedback_now(events: DataFrame, limit: int = 100, base: str | None = None) -> DataFrame:
    def newest(rows):
        last = rows.groupBy("user_id").agg(F.max("epoch").alias("epoch"))
        return rows.join(last, ["user_id", "epoch"], "left_semi")

    return run_available(stream_feedback(events, limit), "update", newest, base or new_folder(events.sparkSession)).drop("epoch")


def stream_status(landed: DataFrame) -> DataFrame:
    """landed(kind) with kinds indexed / failed -> running counts."""
    return landed.groupBy("kind").agg(F.count("*").alias("n"))


def status_now(landed: DataFrame, tracks: DataFrame, base: str | None = None) -> DataFrame:
    """Index status (indexed, total, remaining, failures) from the stream of landed rows."""
    newest = lambda rows: last_by(rows, ["kind"], ["epoch"])
    latest = run_available(stream_status(landed), "complete", newest, base or new_folder(landed.sparkSession))
    pick = lambda k: F.coalesce(F.max(F.when(F.col("kind") == k, F.col("n"))), F.lit(0))
    one = latest.agg(pick("indexed").alias("indexed"), pick("failed").alias("failures"))
    both = one.crossJoin(F.broadcast(tracks.agg(F.count("*").alias("total"))))  # one row beside one row
    return both.withColumn("remaining", F.greatest(F.lit(0), F.col("total") - F.col("indexed")))
