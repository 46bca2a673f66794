"""Versions of tables: what readers see before, during and after writes, and what merges rewrite."""

import os

import pytest
from pyspark.sql import functions as F

from waveframe.sources import readers, snapshots, writers
from waveframe.streaming import job_states


def table(spark, rows):
    return spark.createDataFrame(rows, "k long, v string")


def held(spark, root):
    return sorted((tuple(r) for r in snapshots.read(spark, root, "k long, v string").collect()), key=str)


def failing(spark, n=40):
    """Rows of several partitions, one of which fails."""
    return spark.range(n).repartition(4).select(F.col("id").alias("k"), F.when(F.col("id") == 33, F.raise_error(F.lit("lost")).cast("string")).otherwise("new").alias("v"))


def test_never_written_is_empty(spark, tmp_path):
    assert held(spark, str(tmp_path / "t")) == []
    with pytest.raises(ValueError):
        snapshots.read(spark, str(tmp_path / "t"))


def test_versions_replace_each_other(spark, tmp_path):
    root = str(tmp_path)
    for k in range(4):
        snapshots.commit(table(spark, [(k, "x")] if k != 2 else []), root)
        assert held(spark, root) == ([(k, "x")] if k != 2 else [])
    assert snapshots.current(spark, root)["version"] == 3
    assert sum(f.startswith("data-") for f in os.listdir(tmp_path)) == 2


def test_a_reader_of_the_version_before_can_end(spark, tmp_path):
    root = str(tmp_path)
    snapshots.commit(table(spark, [(1, "a")]), root)
    began = snapshots.read(spark, root)
    snapshots.commit(table(spark, [(2, "b")]), root)
    assert [tuple(r) for r in began.collect()] == [(1, "a")]


@pytest.mark.parametrize("kind", ["parquet", "json"])
def test_a_write_that_fails_halfway_leaves_the_old_rows(spark, tmp_path, kind):
    root = str(tmp_path)
    snapshots.commit(table(spark, [(1, "a")]), root, ["k"], kind)
    for write in (lambda: snapshots.commit(failing(spark), root, ["k"], kind), lambda: snapshots.merge(failing(spark), root, ["k"])):
        with pytest.raises(Exception, match="lost"):
            write()
        assert held(spark, root) == [(1, "a")]
    snapshots.merge(table(spark, [(2, "b")]), root, ["k"])
    assert held(spark, root) == [(1, "a"), (2, "b")]


def test_another_writer_is_seen(spark, tmp_path):
    root = str(tmp_path)
    snapshots.commit(table(spark, [(1, "a")]), root)
    stale = snapshots.current(spark, root)
    snapshots.commit(table(spark, [(2, "b")]), root)
    with pytest.raises(RuntimeError, match="another writer"):
        snapshots._published(spark, root, stale, {}, {})
    assert held(spark, root) == [(2, "b")]


def test_merge_replaces_by_key(spark, tmp_path):
    root = str(tmp_path)
    snapshots.merge(table(spark, [(1, "a"), (None, "n"), (3, "c"), (3, "d")]), root, ["k"], buckets=4)
    snapshots.merge(table(spark, [(None, "m"), (3, "e"), (4, None)]), root, ["k"])
    assert held(spark, root) == sorted([(1, "a"), (None, "m"), (3, "e"), (4, None)], key=str)
    snapshots.merge(table(spark, []), root, ["k"])
    assert len(held(spark, root)) == 4
    with pytest.raises(ValueError, match="held by"):
        snapshots.merge(table(spark, []), root, ["v"])


def test_merge_rewrites_the_buckets_that_it_touches_only(spark, tmp_path):
    root = str(tmp_path)
    snapshots.commit(spark.range(5000).select(F.col("id").alias("k"), F.lit("old").alias("v")), root, ["k"], buckets=32)
    before = snapshots.current(spark, root)["folders"]
    snapshots.merge(table(spark, [(7, "new"), (7000, "new")]), root, ["k"])
    after = snapshots.current(spark, root)["folders"]
    assert len(before) == 32 and 1 <= sum(before[b] != after[b] for b in before) <= 2
    assert sorted(r["k"] for r in snapshots.read(spark, root).where("v = 'new'").collect()) == [7, 7000]
    assert snapshots.read(spark, root).count() == 5001


def test_an_epoch_counts_once(spark, tmp_path):
    root = str(tmp_path)
    add = lambda old, new: old.unionByName(new)
    for epoch in (0, 0, 1, 1, 0):
        snapshots.merge(table(spark, [(1, str(epoch))]), root, ["k"], add, epoch=epoch)
    assert held(spark, root) == [(1, "0"), (1, "1")]


def test_jobs_and_index_survive_a_failed_write(spark, tmp_path):
    jobs = spark.createDataFrame([("a", "running")], "id string, status string")
    writers.write_jobs(jobs, str(tmp_path / "jobs"))
    files = spark.createDataFrame([("s", "S", 1.0)], "slug string, title string, duration_s double")
    writers.write_index_table(files, str(tmp_path / "index"), 7)
    writers.write_index(files, str(tmp_path / "document"), 7)
    bad = failing(spark)
    with pytest.raises(Exception, match="lost"):
        writers.write_jobs(bad.select(F.col("k").cast("string").alias("id"), F.col("v").alias("status")), str(tmp_path / "jobs"))
    for write, at in ((writers.write_index_table, "index"), (writers.write_index, "document")):
        with pytest.raises(Exception, match="lost"):
            write(bad.select(F.col("v").alias("slug"), F.col("v").alias("title"), F.lit(1.0).alias("duration_s")), str(tmp_path / at), 8)
    assert [(r["id"], r["status"]) for r in readers.jobs(spark, str(tmp_path / "jobs")).collect()] == [("a", "running")]
    assert [r["slug"] for r in readers.index_table(spark, str(tmp_path / "index")).collect()] == ["s"]
    assert readers.index_summary(spark, str(tmp_path / "index")) == {"generated": 7, "count": 1}
    assert [r["slug"] for r in readers.index(spark, str(tmp_path / "document")).collect()] == ["s"]


def test_manifest_table_replaces_whole_slugs(spark, tmp_path):
    schema = "slug string, position long, id string, kind string"
    writers.write_manifest_table(spark.createDataFrame([("a", 0, "x", "k"), ("a", 1, "y", "k"), ("b", 0, "z", "k")], schema), str(tmp_path))
    writers.write_manifest_table(spark.createDataFrame([("a", 0, "w", "k")], schema), str(tmp_path))
    assert sorted((r["slug"], r["id"]) for r in readers.manifest_table(spark, str(tmp_path)).collect()) == [("a", "w"), ("b", "z")]


def test_cards_stay_without_new_ones_and_rows_written_follow_the_batch(spark, tmp_path):
    schema = "id long, audio_ready boolean, title string"
    (tmp_path / "in").mkdir()

    def arrive(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in" / name))

    def run():
        cards = spark.readStream.schema(schema).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
        return sorted(tuple(r) for r in job_states.cards_available(spark, cards, ["id"], str(tmp_path / "out")).collect())

    arrive("1", [(k, k % 2 == 0, "old") for k in range(400)])
    first = run()
    assert len(first) == 400
    assert run() == first  # nothing new: the table is still there
    before = snapshots.current(spark, str(tmp_path / "out" / "cards"))["folders"]
    arrive("2", [(1, True, "new"), (2, True, "new"), (1000, False, "new")])
    second = dict((r[0], r[1:]) for r in run())
    after = snapshots.current(spark, str(tmp_path / "out" / "cards"))["folders"]
    assert second[1] == (True, "new") and second[2] == (True, "old") and second[1000] == (False, "new") and len(second) == 401
    assert sum(before.get(b) != f for b, f in after.items()) <= 3
