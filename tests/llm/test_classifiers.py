"""Quality and toxicity: held-out accuracy, edges."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waveframe.llm import quality, toxicity
from waveframe.llm.common import NOT_LETTERS, text_bytes, word_hashes

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_quality(spark, tables):
    docs, labels = tables
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = quality.classify(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([p == t for p, t in held]) >= 0.9


def test_held_out_toxicity(spark, tables):
    docs, labels = tables
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    got = [r for r in toxicity.detect(docs, labels).collect() if r["doc_id"] in truth]
    held = [(r["predicted"], truth[r["doc_id"]]) for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([p == t for p, t in held]) >= 0.9
    assert np.mean([p for p, t in held if t == 0]) <= 0.03
    assert all(0 <= r["severity"] <= 3 and 0 <= r["score"] <= 1 for r in got)


def test_ordinal_shares_weights_and_orders_thresholds():
    rows = np.repeat(np.arange(40), 1)
    words, counts = np.zeros(40, int), np.arange(1, 41)
    grades = np.minimum(3, np.arange(40) // 10)
    weights, cuts = toxicity.fitted(rows, words, counts, grades, 1, 0.0, 2000)
    assert weights[0] > 1 and (np.diff(cuts) > 0).all()
    above = toxicity.Ordinal(np.array([5], np.uint64), weights, cuts).above(np.zeros(30, int), np.full(30, 5, np.uint64), 2)
    assert (np.diff(above, axis=1) <= 0).all() and above[0, 0] > above[1, 0]


def test_network_gradient_lowers_loss_and_covers_long_texts():
    texts = [b"plain words here " * 9, b"&&& %%% $$$ " * 9] * 20
    net = quality.fitted(texts, np.array([1, 0] * 20, np.float32), epochs=8)
    long = b"plain words here " * 3000
    data = [texts[0], texts[1], b"", long]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in data])])
    good, bad, empty, whole = net.scores(np.frombuffer(b"".join(data), np.uint8), offsets)
    assert good > 0.8 > 0.2 > bad and 0 <= empty <= 1 and whole > 0.5
    chunks, row = quality.chunked(np.frombuffer(long, np.uint8), np.array([0, len(long)]))
    assert chunks[0, 0] == long[0] and len(long) - 1 in (np.arange(len(chunks))[:, None] * (quality.CHUNK - quality.OVERLAP) + np.arange(quality.CHUNK))[chunks != quality.PAD]


def test_scores_equal_a_plain_forward_pass():
    rng = np.random.default_rng(2)
    net = quality.Network(rng.normal(size=(257, quality.DEPTH)).astype(np.float32), rng.normal(0, 0.2, (quality.WIDTH * quality.DEPTH, quality.FILTERS)).astype(np.float32), rng.normal(size=quality.FILTERS).astype(np.float32), rng.normal(0, 0.1, 2 * quality.FILTERS + 1).astype(np.float32), np.ones(1, np.float32))
    net.vectors[quality.PAD] = 0
    texts = [b"", b"abc", bytes(rng.integers(0, 256, 1024, np.uint8)), bytes(rng.integers(0, 256, 2500, np.uint8))]
    want = []
    for text in texts:
        chunks, at = [], 0
        while not chunks or at + quality.OVERLAP < len(text):
            chunks.append([*text[at : at + quality.CHUNK], *[quality.PAD] * (quality.CHUNK - len(text[at : at + quality.CHUNK]))])
            at += quality.CHUNK - quality.OVERLAP
        pooled = []
        for chunk in chunks:
            seen = net.vectors[chunk].astype(float)
            pooled.append([max(0.0, max(float((seen[k : k + quality.WIDTH].reshape(-1) * net.filters[:, f]).sum()) for k in range(quality.CHUNK - quality.WIDTH + 1)) + net.shift[f]) for f in range(0, quality.FILTERS, 6)])
        most, mean = np.max(pooled, 0), np.mean(pooled, 0)
        want.append((most, mean))
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    chunks, row = quality.chunked(data, offsets)
    x = net.features(net.pooled(chunks), row, np.diff(offsets))
    for got, (most, mean) in zip(x, want, strict=True):
        assert np.allclose(got[: quality.FILTERS : 6], most, atol=1e-3) and np.allclose(got[quality.FILTERS : 2 * quality.FILTERS : 6], mean, atol=1e-3)
    z = x @ net.out + net.bias
    assert np.allclose(net.scores(data, offsets), 1 / (1 + np.exp(-z.astype(float))), atol=1e-6)


def test_grades_equal_a_plain_count_of_words(spark):
    rows = [(i, f"stupid{i % 2}word zzz" if i % 4 == 0 else "a kind word", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x int")
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    texts = ["", "kind", "stupid0word", "STUPID1word zzz Zzz stupid0word", "zzz " * 30_000]
    own = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["t"] for r in toxicity.score(own, model, name="t").collect()}

    def hashed(words):
        data, offsets = text_bytes(pa.array(words, pa.large_string()))
        return [int(h) for h in word_hashes(data, offsets, NOT_LETTERS)[0]]

    weights = dict(zip(model.words.tolist(), model.weights.tolist(), strict=True))
    for i, text in enumerate(texts):
        words, counts = re.findall("[a-z]+", text.lower()), {}
        row, features, _ = toxicity.features(pa.array([text.lower()], pa.large_string()))
        assert set(hashed(words)) <= set(features.tolist())
        for h in features.tolist():
            counts[h] = counts.get(h, 0) + 1
        z = sum(np.log1p(n) * weights.get(h, 0.0) for h, n in counts.items())
        above = [1 / (1 + np.exp(-(z - c))) for c in model.cuts]
        assert np.allclose([got[i]["score"], got[i]["severity"]], [above[0], sum(above)]) and got[i]["grade"] == sum(a >= 0.5 for a in above)


def test_repeated_labelled_rows_are_learned_from_once(spark):
    docs = spark.createDataFrame([(k % 40, f"text {k}") for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)] * 2, "doc_id long, quality int, toxic int")
    found = quality.sample(docs, labels, "quality", 10, F.col("text")).collect()
    assert len(found) == 10 and len({r["doc_id"] for r in found}) == 10


@pytest.mark.parametrize("rows", [[], [(1, None, None), (2, 1, 0)]])
def test_few_labels(spark, rows):
    docs = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (2, "text", "q"), (None, "x" * 50_000, "q")], "doc_id long, text string, score string")
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.classify(docs, labels).collect()} <= {0.5, 1.0}
    assert {r["predicted"] for r in toxicity.detect(docs, labels).collect()} == {0}
    assert toxicity.clean(docs, labels).columns == docs.columns
    assert toxicity.clean(docs, labels).count() == 4


def test_empty(spark, tables):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert quality.classify(docs, tables[1]).count() == 0
    assert toxicity.detect(docs, tables[1]).count() == 0


def test_text_bytes_of_slices():
    data, offsets = text_bytes(pa.array(["ab", "c", "", "def"], pa.large_string()).slice(1, 3))
    assert bytes(data) == b"cdef" and offsets.tolist() == [0, 1, 1, 4]
