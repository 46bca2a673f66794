"""State that ends: what is retired, what replays change, and how much the store holds."""

import pytest

from waveframe.operators import jobs
from waveframe.streaming import retiring

SCHEMA = "job string, seq long, ts timestamp, line string"
WHOLE = ["JOB: processing 1 file(s)", "[ensemble] file", "[manifest] slug_x: 6 entries", "DONE: processed 1 file(s)"]


class Log:
    """A folder of JSON lines, one file a trigger, and the query over it."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.rows, self.held, self.n = spark, folder, [], None, 0
        (folder / "in").mkdir()

    def arrive(self, rows):
        self.n += 1
        self.spark.createDataFrame([(j, s, f"2026-01-01 {t // 60:02d}:{t % 60:02d}:00", x) for j, s, t, x in rows], "job string, seq long, ts string, line string").coalesce(1).write.json(str(self.folder / "in" / f"{self.n}"))
        self.run()

    def run(self):
        log = self.spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").json(str(self.folder / "in"))
        got = []
        query = retiring.fold_retiring(log, 600, 7200).writeStream.outputMode("update").foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(self.folder / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
        if query.lastProgress and query.lastProgress["stateOperators"]:
            self.held = query.lastProgress["stateOperators"][0]["numRowsTotal"]
        self.rows = {r["job"]: r for r in got}
        self.retired = sorted(r["job"] for r in got if r["retired"])


@pytest.fixture
def log(spark, tmp_path):
    return Log(spark, tmp_path)


def test_done_jobs_retire_and_silent_ones_later(log):
    log.arrive([("a", k, 0, x) for k, x in enumerate(WHOLE)] + [("b", 0, 0, WHOLE[0])])
    assert log.rows["a"]["done"] and log.rows["a"]["slug"] == "slug_x" and log.rows["a"]["lines"] == 4 and not log.rows["b"]["done"]
    log.arrive([("c", 0, 30, WHOLE[0])])
    log.arrive([("d", 0, 31, "x")])
    assert "a" in log.retired or log.rows.get("a") is None
    log.arrive([("e", 0, 300, "x")])
    log.arrive([("f", 0, 301, "x")])
    log.arrive([("f", 1, 302, "x")])
    # only e and f are recent
    assert log.held is not None and log.held <= 8


def test_replays_change_nothing(log):
    rows = [("a", 0, 0, WHOLE[0]), ("a", 1, 0, WHOLE[1])]
    log.arrive(rows)
    first = log.rows["a"]
    log.arrive(rows + rows)
    assert "a" not in log.rows
    log.arrive([*rows, ("a", 2, 1, WHOLE[3])])
    assert first["lines"] == 2 and log.rows["a"]["lines"] == 3 and log.rows["a"]["done"]


def test_state_is_bounded_over_many_jobs(log):
    most = 0
    for wave in range(6):
        log.arrive([(f"j{wave}_{k}", s, wave * 60, x) for k in range(60) for s, x in enumerate(WHOLE)])
        most = max(most, log.held or 0)
    # 360 jobs have passed; the store has those of the last waves, a few rows a job (value and timers)
    assert 0 < log.held <= 60 * 2 * 4 and most <= 60 * 2 * 4


def test_equals_the_batch_fold(spark, log):
    rows = [(f"j{k}", s, s, x) for k in range(7) for s, x in enumerate(WHOLE[: 1 + k % 4])]
    log.arrive(rows[::-1])
    batch = spark.createDataFrame([(j, s, x) for j, s, _, x in rows], "job string, seq long, line string")
    want = {r["job"]: tuple(r)[1:5] for r in jobs.fold(batch).select("job", "phase", "progress", "slug", "done").collect()}
    assert {j: tuple(r)[1:5] for j, r in log.rows.items()} == want
