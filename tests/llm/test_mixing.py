"""Mixing: targets by hand, whole mixes, edges."""

import pytest

from waveframe.llm import mixing


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string, size string")


def test_targets_are_capped_and_shared_again(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 100)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    # 2110 words; a is capped at 30, the rest by weights 2, 1 and 5: nobody's cap but the null source's 300
    assert got["a"] == 30
    assert got[None] == 300
    assert got["b"] == pytest.approx(1780 * 2 / 3) and got["c"] == pytest.approx(1780 / 3)


def test_mix_comes_near_targets_and_reruns_agree(spark):
    rows = [(i, f"s{i % 4}" if i % 9 else None, "w " * (1 + i % 37), "x") for i in range(3000)]
    plan = mixing.mix_plan(docs(spark, rows)).collect()
    again = mixing.mix_plan(docs(spark, rows[::-1])).collect()
    assert sorted(map(tuple, plan), key=str) == sorted(map(tuple, again), key=str)
    by = {}
    for r in plan:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault((r["source"], r["target"]), []).append(r["taken"])
    assert all(abs(sum(v) - t) <= 2 * 37 for (_, t), v in by.items())
    assert sum(map(sum, by.values())) <= sum(r["size"] for r in plan)


def test_mix_keeps_columns_and_repeats_rows(spark):
    rows = [(1, "a", "one two", "x"), (2, "b", "w " * 100, None), (2, "b", "w " * 100, None), (None, None, None, "y"), (3, "a", "", "z")]
    source = docs(spark, rows)
    got = mixing.mix(source)
    assert got.columns == source.columns
    assert set(map(tuple, got.collect())) <= set(rows)
    assert sum(1 for r in got.collect() if r["doc_id"] == 1) == 3


def test_the_mix_holds_what_the_plan_takes(spark):
    rows = [(i, f"s{i % 5}" if i % 11 else None, "w " * (i % 23), f"x{i}") for i in range(1500)]
    frame = spark.createDataFrame([(*r, 1, "y", "z") for r in rows], "doc_id long, source string, text string, size string, rest int, bounds string, row string")
    got = {}
    for r in mixing.mix(frame).collect():
        assert tuple(r)[:4] == rows[r["doc_id"]]
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {r["doc_id"]: r["copies"] for r in mixing.mix_plan(frame).collect() if r["copies"]}


def test_many_empty_texts_and_rows_of_one_id(spark):
    rows = [(i, "a", None, None) for i in range(500)] + [(7, "b", "w " * (1 + i % 3), None) for i in range(300)] + [(8, "c", "v v", None)] * 50
    plan = mixing.mix_plan(docs(spark, rows)).collect()
    assert len(plan) == 850 and all(0 <= r["taken"] <= 3 * r["size"] for r in plan)
    by = {}
    for r in mixing.mix(docs(spark, rows)).collect():
        by[r["source"]] = by.get(r["source"], 0) + len((r["text"] or "").split())
    # b goes up to 3 rounds, c up to 3 rounds of 100 words, all its rows or none in a round
    assert by["c"] % 100 == 0 and 0 < by["b"] <= 1800


def test_slices_grow_with_the_rows():
    assert [mixing._digits(n) for n in (0, 400_000_000, 400_000_001, 10**11)] == [3, 3, 4, 5]


def test_empty(spark):
    assert mixing.mix_plan(docs(spark, [])).count() == 0
    assert mixing.mix(docs(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.mix_plan(docs(spark, [(1, "a", None, None)])).collect()] == [0]


def test_plan_is_native(spark, sf_small):
    df = mixing.mix_plan(spark.read.parquet(f"{sf_small}/documents.parquet"))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
