"""The states of jobs as a stream: a state machine by job, and cards that are upgraded once they are ready.

A job is queued when its first action comes. Actions within a trigger are taken in the order of seq;
one that the state doesn't allow is counted and changes nothing. A removed job stays removed. Actions whose
seq an earlier trigger has passed are repeats and change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.catalog import upgraded
from ..operators.jobs import TERMINAL
from ..sources import snapshots

MOVES = {("queued", "start"): "running", ("queued", "cancel"): "canceled", ("running", "stop"): "stopped", ("running", "finish"): "done", ("running", "fail"): "failed"} | {(state, "remove"): "removed" for state in TERMINAL}
OUT = "job string, status string, refused int"


def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, refused, seen = state.get if state.exists else ("queued", 0, -1)
    rows = pd.concat(batches).drop_duplicates().sort_values(["seq", "action"])
    new = rows[rows["seq"] > seen]
    for action in new["action"]:
        after = MOVES.get((status, action))
        status, refused = (status, refused + 1) if after is None else (after, refused)
    state.update((status, refused, int(max([seen, *new["seq"]]))))
    yield pd.DataFrame({"job": [key[0]], "status": [status], "refused": [refused]})


def states(actions: DataFrame) -> DataFrame:
    """job, status, refused of the jobs that a trigger changes. actions: job, seq, action (a stream)."""
    return actions.select(F.col("job").cast("string").alias("job"), "seq", "action").groupBy("job").applyInPandasWithState(update, OUT, "status string, refused int, seen long", "update", GroupStateTimeout.NoTimeout)


def states_available(spark: SparkSession, actions: DataFrame, folder: str) -> DataFrame:
    """Run the machine over all that is there and return each job's last state. folder is shared and new."""

    def keep(rows: DataFrame, epoch: int) -> None:
        rows.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{folder}/out/{epoch}")

    states(actions).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/out")
    return rows.groupBy("job").agg(F.max_by(F.struct("status", "refused"), "epoch").alias("s")).select("job", "s.*")


def cards_available(spark: SparkSession, cards: DataFrame, keys: list[str], folder: str, buckets: int = snapshots.BUCKETS) -> DataFrame:
    """Upsert a stream of cards (keys, columns, audio_ready) and return the table: complete cards stay, pending ones are replaced.

    A trigger rewrites only the buckets that its cards' keys are in; one that is run again changes nothing.
    """
    fields, root = cards.schema, f"{folder}/cards"

    def keep(rows: DataFrame, epoch: int) -> None:
        last = rows.groupBy(*keys).agg(F.max(F.struct("audio_ready", *[c for c in rows.columns if c not in (*keys, "audio_ready")])).alias("row")).select(*keys, "row.*").select(*rows.columns)
        snapshots.merge(last, root, keys, lambda old, new: upgraded(old, new, keys), buckets=buckets, epoch=epoch)

    cards.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return snapshots.read(spark, root, fields)
