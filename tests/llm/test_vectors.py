"""Vector near-dedup against brute force."""

import numpy as np

from waveframe.llm import vectors


def brute(x, ids, good, threshold=0.9):
    u = vectors.unit(np.where(good[:, None], x, 1.0))
    near = (u @ u.T >= threshold) & good[:, None] & good[None, :]
    np.fill_diagonal(near, False)
    a, b = np.nonzero(near)
    order = np.argsort(ids)
    place = np.empty(len(ids), int)
    place[order] = np.arange(len(ids))
    root = vectors.local_components(len(ids), place[a], place[b])
    return {int(i): (int(near[k].sum()), int(ids[order][root[place[k]]])) for k, i in enumerate(ids)}


def test_links_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CAP", 300)  # the large group is dealt into blocks
    rng = np.random.default_rng(0)
    x = rng.normal(size=(700, 16))
    centre = rng.normal(size=16)
    x[:400] = centre + rng.normal(size=(400, 16)) * 0.25
    x[500:520] = x[499]
    ids = rng.permutation(5000)[:700]
    want = brute(x.astype(np.float32).astype(float), ids, np.ones(700, bool))
    rows = [(int(i), [float(v) for v in r], 1) for i, r in zip(ids, x, strict=True)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, first int")
    result = vectors.links(df)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in result.collect()}
    assert got == want
    assert vectors.audit(df, result) == 1.0


def test_dense_groups_lose_no_link_at_the_real_cap(spark):
    rng = np.random.default_rng(4)
    groups = [rng.normal(size=32) + rng.normal(size=(n, 32)) * 0.3 for n in (2600, 900, 40)]
    x = np.concatenate([*groups, rng.normal(size=(400, 32))]).astype(np.float32)
    ids = rng.permutation(10 * len(x))[: len(x)]
    df = spark.createDataFrame([(int(i), r) for i, r in zip(ids, x.tolist(), strict=True)], "vec_id long, embedding array<float>").repartition(4)
    result = vectors.links(df)
    want = brute(x.astype(float), ids, np.ones(len(x), bool))
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in result.collect()} == want


def test_vectors_with_a_common_direction_keep_their_centres():
    rng = np.random.default_rng(6)
    common = rng.normal(size=64) * 2.2
    sample = vectors.unit(common + rng.normal(size=(4000, 64)))  # cosines of about 0.83, links are rare
    found = vectors.centres(sample, 16)
    assert len(vectors.apart(found, sample)) == 16


def test_vectors_that_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0]), (None, [1.0, 0.0]), (1, [1.0, 0.0])]
    got = vectors.links(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(got) == len(rows)
    by = {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got}
    assert {(1, 2, 1, True), (2, 2, 1, False)} <= by
    assert {(i, 0, i, True) for i in range(3, 10)} | {(None, 0, None, True)} <= by


def test_every_length_links_within_itself(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [1.0, 0.01, 0.0]), (4, [2.0]), (5, [3.0]), (6, [-1.0]), (7, [0.0, 0.0, 0.0, 5.0]), (8, [0.0, 0.0, 0.0, 4.0]), (9, [2.0, 0.02])]
    got = vectors.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1, True), (2, 1, 2, True), (3, 1, 2, False), (4, 1, 4, True), (5, 1, 4, False), (6, 0, 6, True), (7, 1, 7, True), (8, 1, 7, False), (9, 1, 1, False)]


def test_ties_at_the_threshold_link(spark):
    # cosines of 0.9 and of a little less, exactly
    rows = [(1, [1.0, 0.0]), (2, [9.0, 19.0**0.5]), (3, [9.0, -4.3589]), (4, [0.0, 0.0])]
    x = np.array([r[1] for r in rows[:3]])
    want = {i + 1: sum(float(vectors.unit(x)[i] @ vectors.unit(x)[j]) >= 0.9 for j in range(3) if j != i) for i in range(3)}
    got = {r["vec_id"]: r["n_links"] for r in vectors.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == want | {4: 0}


def test_empty(spark):
    assert vectors.links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
