"""Chunk form against the long form and numpy; sums that no partitioning changes."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waveframe.functions import exact
from waveframe.operators import chunks, signal, spectral

RNG = np.random.default_rng(5)
SIZE = 16
#: Lengths around the chunk's: shorter, equal, one more, many, none beyond one sample.
LENGTHS = {"a": 7, "b": 16, "c": 17, "d": 150, "e": 1}


@pytest.fixture(scope="module")
def samples(spark):
    rows = [(k, ch, i, float(v)) for k, n in LENGTHS.items() for ch in (0, 1) for i, v in enumerate(RNG.normal(size=n + 3 * ch) * 10.0 ** RNG.integers(-6, 3))]
    return spark.createDataFrame(rows, "slug string, ch int, i long, v double").cache()


@pytest.fixture(scope="module")
def held(samples):
    return chunks.chunked(samples, ["slug", "ch"], SIZE).cache()


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or math.isclose(p, q, rel_tol=1e-12, abs_tol=1e-15) for p, q in zip(x, y, strict=True) if not isinstance(p, str)), (x, y)


def test_round_trip(samples, held):
    assert rows(chunks.long_form(held, ["slug", "ch"], SIZE), "slug", "ch", "i", "v") == rows(samples, "slug", "ch", "i", "v")
    assert held.where(F.size("samples") > SIZE).count() == 0


def test_gap_is_an_error(spark):
    bad = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 0, 2, 1.0)], "slug string, ch int, i long, v double")
    with pytest.raises(Exception, match="every sample once"):
        chunks.chunked(bad, ["slug", "ch"], SIZE).collect()


def test_level_equals_the_long_form(samples, held):
    columns = ["slug", "peak", "rms", "loudness", "sr", "channels", "duration_s"]
    close(rows(chunks.level(held, ["slug"], size=SIZE), *columns), rows(signal.level(samples, ["slug"]), *columns))


def test_level_is_the_same_bits_under_any_partitioning(spark, samples):
    want = {k: math.sqrt(math.fsum(r["v"] * r["v"] for r in samples.where(F.col("slug") == k).collect()) / (2 * n + 3)) for k, n in LENGTHS.items()}
    for size in (1, 16, 64):
        own = chunks.chunked(samples, ["slug", "ch"], size)
        for n in (1, 4, 200):
            assert {r["slug"]: r["rms"] for r in chunks.level(own.repartition(n), ["slug"], size=size).collect()} == want


def test_mono_equals_the_long_form(samples, held):
    close(rows(chunks.long_form(chunks.mono(held, ["slug"]), ["slug"], SIZE), "slug", "i", "v"), rows(signal.mono(samples, ["slug"]), "slug", "i", "v"))


def test_normalize_equals_the_long_form(samples, held):
    got = chunks.normalize(held, ["slug"])
    back = rows(chunks.long_form(got, ["slug", "ch"], SIZE), "slug", "ch", "i", "v")
    assert back == rows(signal.normalize(samples, ["slug"]), "slug", "ch", "i", "v")
    assert all(math.isclose(r["peak"], 10**-0.25) for r in chunks.peaks(got, ["slug"]).collect())


def test_silence_stays(spark):
    zero = spark.createDataFrame([("z", 0, 0, [0.0] * 5), ("n", 0, 0, []), ("x", 0, 0, None)], "slug string, ch int, chunk long, samples array<double>")
    got = {r["slug"]: (r["samples"], r["gain"]) for r in chunks.normalize(zero, ["slug"]).collect()}
    assert got == {"z": ([0.0] * 5, 1.0), "n": ([], 1.0), "x": ([], 1.0)}
    levels = {r["slug"]: (r["peak"], r["rms"], r["loudness"]) for r in chunks.level(zero, ["slug"]).collect()}
    assert levels == dict.fromkeys("znx", (0.0, 0.0, 20 * math.log10(1e-9)))


def test_residual_and_align_equal_the_long_form(samples, held):
    a, b = (held.where(F.col("ch") == ch).drop("ch") for ch in (0, 1))
    x, y = (samples.where(F.col("ch") == ch).drop("ch") for ch in (0, 1))
    assert rows(chunks.long_form(chunks.residual(a, b, ["slug"]), ["slug"], SIZE), "slug", "i", "v") == rows(signal.residual(x, y, ["slug"]), "slug", "i", "v")
    cut = chunks.align(held, ["slug"], "ch", SIZE)
    assert rows(chunks.long_form(cut, ["slug", "ch"], SIZE), "slug", "ch", "i", "v") == rows(signal.align(samples, ["slug"], "ch"), "slug", "ch", "i", "v")


@pytest.mark.parametrize("algo", ["avg", "max", "min"])
def test_ensemble_equals_the_long_form(samples, held, algo):
    got = chunks.long_form(chunks.ensemble(held, ["slug"], "ch", algo, SIZE), ["slug"], SIZE)
    close(rows(got, "slug", "i", "v"), rows(signal.ensemble(signal.align(samples, ["slug"], "ch"), ["slug", "i"], "ch", algo), "slug", "i", "v"))


@pytest.mark.parametrize("buckets", [1, 5, 16, 1600])
def test_envelope_equals_the_long_form(samples, held, buckets):
    got = chunks.envelope(held, ["slug", "ch"], buckets, SIZE)
    assert rows(got, "slug", "ch", "bucket", "lo", "hi") == rows(signal.envelope(samples, ["slug", "ch"], buckets), "slug", "ch", "bucket", "lo", "hi")


def test_no_plan_has_a_row_a_sample(held):
    for df in (chunks.level(held, ["slug"], size=SIZE), chunks.mono(held, ["slug"]), chunks.normalize(held, ["slug"]), chunks.residual(held, held, ["slug", "ch"]), chunks.ensemble(held, ["slug"], "ch", "avg", SIZE)):
        assert "posexplode(samples" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_empty(spark):
    none = spark.createDataFrame([], "slug string, ch int, chunk long, samples array<double>")
    for df in (chunks.level(none, ["slug"]), chunks.mono(none, ["slug"]), chunks.normalize(none, ["slug"]), chunks.residual(none, none, ["slug"]), chunks.ensemble(none, ["slug"], "ch"), chunks.envelope(none, ["slug"])):
        assert df.count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), max_size=40), st.integers(1, 5))
def test_exact_sums_are_those_of_fsum(values, cuts):
    found = [exact.parts(np.array(values[k::cuts], float)) for k in range(cuts)]
    try:
        want = math.fsum(values)
    except OverflowError:
        return
    assert exact.total(*(np.concatenate([f[k] for f in found]) for k in range(3))) == want


@pytest.mark.parametrize("algo", ["max", "min"])
@pytest.mark.parametrize("span", [16, 64, 1 << 16])
def test_spectral_ensemble_in_chunks_equals_the_whole(spark, algo, span):
    lengths = {("a", "x"): 5, ("a", "y"): 9, ("b", "x"): 64, ("b", "y"): 64, ("c", "x"): 300, ("c", "y"): 257, ("c", "z"): 400, ("d", "x"): 128}
    whole = {k: RNG.normal(size=n) for k, n in lengths.items()}
    table = spark.createDataFrame([(*k, i, float(v)) for k, x in whole.items() for i, v in enumerate(x)], "slug string, model string, i long, v double")
    held = chunks.chunked(table, ["slug", "model"], span)
    found = {}
    for r in spectral.chunk_ensemble(held, ["slug"], "model", algo, 32, 8, span).orderBy("chunk").collect():
        found.setdefault(r["slug"], []).extend(r["samples"])
    for slug in "abcd":
        own = [x for (s, _), x in sorted(whole.items()) if s == slug]
        n = min(map(len, own))
        want = spectral.inverse(spectral.merged([spectral.forward(x[:n], 32, 8) for x in own], algo), n, 32, 8)
        assert len(found[slug]) == n and np.abs(np.array(found[slug]) - want).max() < 1e-12


@pytest.mark.parametrize("rates", [(44100, 48000), (48000, 44100), (8000, 44100), (44100, 8000)])
def test_resampling_by_ranges_is_the_same_bits_as_the_whole(rates):
    x = RNG.normal(size=3000)
    whole = spectral.resampled(x, *rates)
    parts = []
    for lo in range(0, len(whole), 700):
        hi = min(len(whole), lo + 700)
        a, b = spectral.needed(lo, hi, *rates)
        a, b = max(0, a), min(len(x), b)
        parts.append(spectral.resampled_range(x[a:b], a, len(x), lo, hi, *rates))
    assert np.array_equal(np.concatenate(parts), whole)


@pytest.mark.parametrize("width", [1, 2, 7, 100, 333, 1599, 3200])
def test_pyramid_equals_the_envelope_at_any_width(spark, width):
    rows = [(k, b, -float(v), float(v) + 1) for k, n in (("a", 1), ("b", 2), ("c", 100), ("d", 1023), ("e", 3199)) for b, v in enumerate(RNG.uniform(0, 9, n))]
    peaks = spark.createDataFrame([r for r in rows if r[1] % 50 != 49 or r[1] > 900], "slug string, bucket long, lo double, hi double")
    nodes = signal.pyramid(peaks, ["slug"])
    assert rows_of(signal.from_pyramid(nodes, ["slug"], width)) == rows_of(signal.rebucket(peaks, ["slug"], width))


def rows_of(df):
    return rows(df, "slug", "x", "lo", "hi")


def test_residual_and_gain_need_no_python(spark):
    nan = float("nan")
    made = [(1, 0, [1.0, None, 3.0, nan]), (2, 0, [1.0, 2.0]), (3, 0, None), (4, 0, []), (5, 0, [None, None]), (6, 0, [1.0])]
    others = [(1, 0, [0.5, 1.0, 1.0]), (2, 0, [1.0, 1.0, 1.0]), (3, 0, [1.0]), (4, 0, [2.0]), (5, 0, [1.0, 2.0]), (6, 0, None)]
    a, b = (spark.createDataFrame(x, "k int, chunk long, samples array<double>") for x in (made, others))
    less, scaled = chunks.residual(a, b, ["k"]), chunks.normalize(a.where("k > 1"), ["k"])
    assert sorted(map(tuple, less.collect())) == [(1, 0, [0.5, None, 2.0]), (2, 0, [0.0, 1.0]), (3, 0, []), (4, 0, []), (5, 0, [None, None]), (6, 0, [])]
    gain = 10 ** (-5 / 20)
    assert sorted(map(tuple, scaled.collect())) == [(2, 0, [gain / 2, gain / 2 * 2], gain / 2), (3, 0, [], 1.0), (4, 0, [], 1.0), (5, 0, [None, None], 1.0), (6, 0, [gain], gain)]
    for df in (less, scaled):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
