"""The job-log fold as a stream: state by job, one output row a job and trigger, checkpointed.

State is phase, progress, slug, done and the sequence numbers that order them, so lines may come
in any order and the state after all of them equals the batch fold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.jobs import DONE_MARK, phase_of, progress_of, slug_of
from ..sources.schemas import LOG

OUT = "job string, phase string, progress double, slug string, done boolean, lines long"
STATE = "phase string, phase_seq long, progress double, slug string, slug_seq long, done boolean, lines long"


def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    phase, phase_seq, progress, slug, slug_seq, done, lines = state.get if state.exists else (None, -1, 0.0, None, 1 << 62, False, 0)
    for rows in batches:  # most jobs are short: numpy rather than pandas, which takes longer for each call
        lines += len(rows)
        seq = rows["seq"].to_numpy()
        progress = np.fmax.reduce(rows["progress"].to_numpy(np.float64), initial=progress)
        done = done or bool(rows["done"].to_numpy().any())
        seen = np.flatnonzero(rows["phase"].notna().to_numpy())
        if len(seen) and seq[last := seen[seq[seen].argmax()]] > phase_seq:
            phase, phase_seq = rows["phase"].iat[last], int(seq[last])
        named = np.flatnonzero(rows["slug"].notna().to_numpy())
        if len(named) and seq[first := named[seq[named].argmin()]] < slug_seq:
            slug, slug_seq = rows["slug"].iat[first], int(seq[first])
    state.update((phase, phase_seq, float(progress), slug, slug_seq, done, lines))
    yield pd.DataFrame({"job": [key[0]], "phase": [phase], "progress": [float(progress)], "slug": [slug], "done": [done], "lines": [lines]})


def fold_stream(log: DataFrame) -> DataFrame:
    """job, phase, progress, slug, done, lines of the jobs that a trigger changes. log: job, seq, line (a stream)."""
    line = F.col("line")
    marked = log.select("job", "seq", phase_of(line).alias("phase"), progress_of(line).alias("progress"), slug_of(line).alias("slug"), F.contains(line, F.lit(DONE_MARK)).alias("done"))
    return marked.groupBy("job").applyInPandasWithState(update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def log_source(spark: SparkSession, folder: str, files_each: int | None = None) -> DataFrame:
    """Job logs as a stream: JSON lines (job, seq, ts, line) of files that are moved into the folder when they are whole."""
    reader = spark.readStream.schema(LOG)
    return (reader.option("maxFilesPerTrigger", files_each) if files_each else reader).json(folder)


def refreshed(log: DataFrame, keep: Callable[[DataFrame, int], None], folder: str, every: str = "2 seconds") -> StreamingQuery:
    """The fold as a running query that hands changed jobs to keep() at every interval; its caller stops it."""
    return fold_stream(log).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", folder).trigger(processingTime=every).start()


def fold_available(spark: SparkSession, log: DataFrame, folder: str) -> DataFrame:
    """Run the fold over all that is there and return each job's last state. folder is shared and new."""

    def keep(rows: DataFrame, epoch: int) -> None:
        rows.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}_")

    query = fold_stream(log).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/out")
    state = [c.split()[0] for c in OUT.split(", ")[1:]]
    return rows.groupBy("job").agg(F.max_by(F.struct(*state), "epoch").alias("s")).select("job", "s.*")
