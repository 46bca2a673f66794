"""Whitening against numpy and exact integers."""

import math

import numpy as np
import pytest

from waveframe.llm import whitening

NAN, INF = float("nan"), float("inf")


def brute(rows):
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    x = [v for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    m = np.array([[n * c - s for c, s in zip(v, sums)] for v in x], float) / n
    cov = m.T @ m / n
    e, axes = np.linalg.eigh(cov)
    return kept, n, [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x], m, e[::-1], axes[:, ::-1], np.trace(cov)


def check(got, rows, components):
    kept, n, deviation, m, e, axes, trace = brute(rows)
    assert len(got) == n * components
    values = np.zeros((n, components))
    place = {}
    for k, (i, _) in enumerate(kept):
        place.setdefault(i, []).append(k)
    for r in got:
        k = place[r["vec_id"]][0]
        assert r["n"] == n and r["deviation"] == deviation[k]
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / trace, rel=1e-9)
        assert r["identity_error"] < 1e-8
        values[k, r["component"] - 1] = r["whitened"]
    for c in range(components):
        want = m @ axes[:, c] / np.sqrt(e[c])
        sign = 1 if np.abs(values[:, c] - want).max() < np.abs(values[:, c] + want).max() else -1
        assert np.abs(sign * values[:, c] - want).max() < 1e-8


def test_matches_numpy(spark, sf_small):
    table = spark.read.parquet(f"{sf_small}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    check(whitening.digest(table).collect(), rows, 32)


def test_unfit_rows_go_and_names_may_clash(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(c) for c in rng.normal(size=3) * [3, 2, 1]]) for i in range(40)]
    bad = [(100, None), (101, [NAN, 1.0, 2.0]), (102, [1.0, INF, 2.0]), (103, [1.0, None, 2.0]), (104, []), (105, [1.0, 2.0]), (106, [1e30, 0.0, 0.0])]
    table = spark.createDataFrame([(*r, "k", 1) for r in rows + bad], "vec_id long, embedding array<float>, x string, m int")
    check(whitening.digest(table).collect(), rows, 3)


def test_repeated_rows_count_each_and_a_null_id_stays(spark):
    rows = [(None, [1.0, 2.0])] * 3 + [(1, [0.5, -1.0]), (2, [4.0, 0.0])]
    got = whitening.digest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 10 and sum(r["vec_id"] is None for r in got) == 6 and {r["n"] for r in got} == {5}


def test_dimensions_without_variance_give_no_component(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(a), float(b), float(a), 5.0]) for i, (a, b) in enumerate(rng.normal(size=(60, 2)))]
    got = whitening.digest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r["component"] for r in got} == {1, 2} and all(r["identity_error"] < 1e-8 for r in got)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]])
def test_without_variance_there_is_no_row(spark, rows):
    assert whitening.digest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count() == 0


def test_sums_and_deviations_are_exact_where_doubles_are_not(spark):
    entries = [2.0**46, 2.0**46 + 1, -(2.0**46), 1.0]
    rows = [(i, [c, 1.0]) for i, c in enumerate(entries)]
    table = whitening.fit_rows(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    x = [[int(64 * c) + 1_000_000 for c in v] for _, v in rows]
    assert whitening.column_sums(table) == (4, [sum(c) for c in zip(*x)])
    got = whitening.digest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["deviation"] for r in got} == {None}
