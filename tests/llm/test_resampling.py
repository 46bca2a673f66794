"""Importance resampling against a plain reading of the contract."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from waveframe.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def counts(text):
    w = words(text)
    runs = [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    return Counter(zlib.crc32(r.encode()) % 10000 for r in runs), len(w), len(runs)


def brute(docs, target):
    rows = [(i, *counts(t)) for i, t in docs]
    s, t = Counter(), Counter()
    for _, c, _, _ in rows:
        s.update(c)
    for x in target:
        t.update(counts(x)[0])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    out = []
    for i, c, n_words, n in rows:
        weight = sum(gain[b] * k for b, k in c.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n_words])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0], -r[2], -r[1]))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def drawn(spark, docs, target):
    frame = resampling.draw(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(x,) for x in target], "text string"))
    return [tuple(r) for r in frame.select("doc_id", "n_features", "weight", "score", "rank").collect()]


def ordered(rows):
    return sorted(rows, key=str)


def test_matches_plain_reading(spark, sf_small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    assert ordered(drawn(spark, docs, target)) == ordered(brute(docs, target))


def test_odd_texts_ties_and_repeats(spark):
    same = "one two three four five six seven eight nine ten " * 3
    docs = [(1, None), (2, ""), (3, " ... "), (4, "É È ÀB 日本 x1 ONE"), (None, same), (None, same + "x"), (5, "\x00one\x7ftwo"), *[(7, same)] * 30, *[(k, same + str(k % 3)) for k in range(100, 160)]]
    assert ordered(drawn(spark, docs, ["one two", None])) == ordered(brute(docs, ["one two", None]))


@pytest.mark.parametrize("target", [[], [None], ["x y"]])
def test_empty_tables(spark, target):
    assert drawn(spark, [], target) == []
    docs = [(k, f"word{k} " * 25) for k in range(40)]
    assert ordered(drawn(spark, docs, target)) == ordered(brute(docs, target))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB1 .é\n", max_size=60), st.integers(1, 12))
def test_features_do_not_depend_on_the_pieces(text, limit):
    found = Counter()
    cut = resampling.pieces
    resampling.pieces = lambda t: cut(t, limit)
    try:
        buckets, n, n_words, n_features = resampling.features(text)
    finally:
        resampling.pieces = cut
    found.update(dict(zip(buckets.tolist(), n.tolist(), strict=True)))
    assert (found, n_words, n_features) == counts(text)


def test_very_long_text_in_pieces():
    text = ("alpha beta gamma delta " * 120_000) + "x" * 3_000_000
    buckets, n, n_words, n_features = resampling.features(text)
    assert (Counter(dict(zip(buckets.tolist(), n.tolist(), strict=True))), n_words, n_features) == counts(text)


def test_resampled_rows_keep_their_columns(spark):
    docs = spark.createDataFrame([(k, f"word{k % 7} " * 30, k, "s") for k in range(100)], "doc_id long, text string, rank long, score string")
    target = spark.createDataFrame([("word1 word1",)], "text string")
    got = resampling.resampled(docs, target)
    assert got.columns == docs.columns and got.count() == 5


def test_nothing_of_the_size_of_the_texts_is_written(spark, monkeypatch):
    made, at = random.Random(5), []
    docs = [(k, " ".join(f"{made.getrandbits(24):x}" for _ in range(600))) for k in range(400)]
    write = resampling.written

    def measured(df):
        found = write(df)
        at.append(sum(os.path.getsize(f.removeprefix("file://")) for f in found.inputFiles()))
        return found

    monkeypatch.setattr(resampling, "written", measured)
    assert ordered(drawn(spark, docs, ["one two"])) == ordered(brute(docs, ["one two"]))
    assert at and sum(at) < sum(len(t) for _, t in docs) // 10


LONG = st.integers(60, 70).map(lambda n: "w" * n) | st.just("\u65e5" * 500)
TEXTS = st.lists(st.lists(st.text(alphabet="aB1 .\u00e9\n", max_size=12) | LONG, max_size=4).map(" ".join), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_rows_of_a_step_do_not_mix(texts):
    column, gain = pa.array(texts, pa.large_string()), np.random.default_rng(3).integers(-9000, 9000, 10000)
    each = [counts(t) for t in texts]
    if texts:
        weight, n_words = resampling.row_gains(column, gain)
        assert weight.tolist() == [sum(int(gain[b]) * n for b, n in c.items()) for c, _, _ in each] and n_words.tolist() == [n for _, n, _ in each]
        sums, n = resampling.bucket_sums(column)
        assert Counter({b: k for b, k in enumerate(sums.tolist()) if k}) == sum((c for c, _, _ in each), Counter()) and n == sum(n for _, n, _ in each)


@pytest.mark.parametrize("longest", [1, 2, 5])
def test_runs_of_other_lengths_in_pieces(longest, monkeypatch):
    cut = resampling.pieces
    monkeypatch.setattr(resampling, "pieces", lambda t: cut(t, 5))
    text = "a bb ccc " * 7 + "x" * 80 + " y " + "z" * 90
    w = words(text)
    runs = [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]
    buckets, n, n_words, n_features = resampling.features(text, 1000, longest)
    assert Counter(dict(zip(buckets.tolist(), n.tolist(), strict=True))) == Counter(zlib.crc32(r.encode()) % 1000 for r in runs)
    assert (n_words, n_features) == (len(w), len(runs))
