"""Job logs and job states in batch form: phases, progress, tail, outcome, queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Markers of log lines in the order in which they are looked for, phases and progress.
PHASES = [
    (("JOB: processing",), "starting", 0.05),
    (("already separated",), "separating (models cached)", 0.35),
    (("=== loading",), "separating (running models)", 0.25),
    (("[ensemble]",), "ensembling", 0.60),
    (("[manifest]",), "variants written", 0.75),
    (("normalized", "instrumental"), "normalizing", 0.85),
    (("transcoded", "AAC"), "transcoding (AAC)", 0.95),
    (("DONE: processed",), "finalizing", 0.99),
]
DONE_MARK = "DONE: processed"
TERMINAL = ["canceled", "done", "failed", "stopped"]
ACTIVE = ["queued", "running"]
TAIL_LINES, LINE_CHARS = 40, 500
SLUG_LINE = r"\[manifest\]\s+(.+?):"


def _match(line: Column, index: int) -> Column:
    out = F.lit(None)
    for entry in reversed(PHASES):
        has = F.lit(True)
        for mark in entry[0]:
            has = has & F.contains(line, F.lit(mark))
        out = F.when(has, F.lit(entry[index])).otherwise(out)
    return out


def phase_of(line: Column) -> Column:
    return _match(line, 1).cast("string")


def progress_of(line: Column) -> Column:
    return _match(line, 2).cast("double")


def slug_of(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, SLUG_LINE, 1), F.lit(""))


def running(log: DataFrame, job: str = "job", seq: str = "seq") -> DataFrame:
    """log with phase (the last seen), progress (never falling) and slug (the first seen) up to each line."""
    upto = Window.partitionBy(job).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return log.select(job, seq, F.last(phase_of(F.col("line")), ignorenulls=True).over(upto).alias("phase"), F.coalesce(F.max(progress_of(F.col("line"))).over(upto), F.lit(0.0)).alias("progress"), F.first(slug_of(F.col("line")), ignorenulls=True).over(upto).alias("slug"))


def fold(log: DataFrame, job: str = "job", seq: str = "seq") -> DataFrame:
    """job, phase, progress, slug, done: each job's state after its whole log, by aggregates alone."""
    line = F.col("line")
    phase, slug = phase_of(line), slug_of(line)
    return log.groupBy(job).agg(
        F.max_by(phase, F.when(phase.isNotNull(), F.col(seq))).alias("phase"), F.coalesce(F.max(progress_of(line)), F.lit(0.0)).alias("progress"),
        F.min_by(slug, F.when(slug.isNotNull(), F.col(seq))).alias("slug"), F.coalesce(F.bool_or(F.contains(line, F.lit(DONE_MARK))), F.lit(False)).alias("done"),
    )


def tail(log: DataFrame, job: str = "job", seq: str = "seq", lines: int = TAIL_LINES) -> DataFrame:
    """job, tail: the last lines that are not blank, each cut to 500 characters, as an array."""
    last = Window.partitionBy(job).orderBy(F.desc(seq))
    kept = log.where(F.trim("line") != "").withColumn("n", F.row_number().over(last)).where(F.col("n") <= lines)
    return kept.groupBy(job).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("seq"), F.substring("line", 1, LINE_CHARS).alias("line")))), lambda x: x["line"]).alias("tail"))


def outcome(stop: Column, exit_code: Column, done: Column) -> Column:
    """A stop that was asked for wins even over exit code 0; 0 without the done mark is a failure."""
    return F.when(stop, "stopped").when((exit_code == 0) & done, "done").otherwise("failed")


def elapsed(started: Column, ended: Column, now: Column) -> Column:
    return F.when(started.isNull(), F.lit(None)).otherwise(F.coalesce(ended, now) - started)


def recovered(jobs: DataFrame) -> DataFrame:
    """Jobs as loaded after a crash: what was running has failed."""
    was = F.col("status") == "running"
    return jobs.withColumn("error", F.when(was, "interrupted by server restart").otherwise(F.col("error"))).withColumn("status", F.when(was, "failed").otherwise(F.col("status")))


def newest(jobs: DataFrame, seq: str = "seq") -> DataFrame:
    """Jobs, the last one first."""
    return jobs.orderBy(F.desc(seq))


def by_id(jobs: DataFrame, wanted: str, id_: str = "id") -> DataFrame:
    """The job of an id: one row or none."""
    return jobs.where(F.col(id_) == wanted).limit(1)


def final_states(actions: DataFrame, job: str = "job", seq: str = "seq") -> DataFrame:
    """job, status, refused: each queued job after its actions in order; those that its state doesn't allow are counted.

    actions: job, seq, action (start, finish, fail, cancel, stop, remove). A job's actions are a
    handful by the machine's shape; repeats are summed up before they meet.
    """
    each = F.array_sort(F.collect_set(F.struct(F.col(seq).alias("seq"), F.col("action").alias("action"))))
    start = F.struct(F.lit("queued").alias("status"), F.lit(0).alias("refused"))

    def step(state, x):
        after = transition(state["status"], x["action"])
        return F.struct(F.coalesce(after, state["status"]).alias("status"), (state["refused"] + F.when(after.isNull(), 1).otherwise(0)).alias("refused"))

    return actions.groupBy(job).agg(F.aggregate(each, start, step).alias("s")).select(job, "s.status", "s.refused")


def next_queued(jobs: DataFrame, seq: str = "seq") -> DataFrame:
    """The oldest queued job: one row."""
    return jobs.where(F.col("status") == "queued").orderBy(seq).limit(1)


def actions(status: Column, slug: Column) -> Column:
    """array of what may be done with a job."""
    each = F.array(F.when(status == "running", "stop"), F.when(status == "queued", "cancel"), F.when(status.isin(TERMINAL), "remove"), F.when((status == "done") & (F.coalesce(slug, F.lit("")) != ""), "open"))
    return F.filter(each, lambda x: x.isNotNull())


def transition(status: Column, action: Column) -> Column:
    """The state after an action, null if it is not allowed (a removed job is `removed`)."""
    moves = [("start", ["queued"], "running"), ("cancel", ["queued"], "canceled"), ("stop", ["running"], "stopped"), ("finish", ["running"], "done"), ("fail", ["running"], "failed"), ("remove", TERMINAL, "removed")]
    out = F.lit(None).cast("string")
    for name, before, after in moves:
        out = F.when((action == name) & status.isin(before), after).otherwise(out)
    return out


def new_id() -> Column:
    """A random id of 12 hex digits; write it once, as each evaluation gives another."""
    return F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12)
