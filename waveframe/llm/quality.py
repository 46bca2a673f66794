"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into chunks of 1,024 that overlap by 64 and cover the whole
document. Bytes have learned vectors; learned filters over five bytes run along each chunk and
are max-pooled. A document's features are each filter's greatest and mean chunk value and the
logarithm of its length; a logistic unit combines them into the probability of label 1.

It is fitted on the driver from the whole texts of `train_rows` labelled documents at most (those
with the least hash of doc_id). Scoring sees every byte of every text and runs in tasks, one step of
texts at a time.

Defined results: null and empty texts are scored from the bias and length alone; rows without a
label, or with a null one, are not learned from; if the labels have fewer than two classes every
score is the share of label 1 (0.5 without labels); repeated rows count each in the result, and of rows
that share a labelled doc_id the least text is learned from; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps, text_bytes, text_of

CHUNK, OVERLAP, WIDTH, DEPTH, FILTERS = 1024, 64, 5, 4, 24
PAD = 256
THRESHOLD = 0.3
TRAIN_ROWS = 4000
SEED = 7


def chunked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte chunks [n, CHUNK] (padded) and the row of each; a row without bytes has one empty chunk."""
    lengths = np.diff(offsets)
    counts = np.maximum(1, -(-(lengths - OVERLAP) // (CHUNK - OVERLAP)))
    row = np.repeat(np.arange(len(lengths)), counts)
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = offsets[:-1][row] + place * (CHUNK - OVERLAP)
    at = starts[:, None] + np.arange(CHUNK)
    inside = at < offsets[1:][row][:, None]
    if not len(data):
        return np.full((len(row), CHUNK), PAD, np.int16), row
    return np.where(inside, data[np.minimum(at, len(data) - 1)].astype(np.int16), np.int16(PAD)), row


@dataclass
class Network:
    """Weights: vectors of bytes, filters and their bias, the output's weights and bias."""

    vectors: np.ndarray
    filters: np.ndarray
    shift: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def pooled(self, chunks: np.ndarray, where: bool = False):
        """Greatest value of every filter in every chunk, and where it is if asked."""
        n, span = len(chunks), CHUNK - WIDTH + 1
        seen = np.ascontiguousarray(self.vectors.T)[:, chunks]
        windows = np.empty((WIDTH, DEPTH, n, span), np.float32)
        for k in range(WIDTH):
            windows[k] = seen[:, :, k : k + span]
        values = (np.ascontiguousarray(self.filters.T) @ windows.reshape(WIDTH * DEPTH, -1)).reshape(FILTERS, n, span)
        most = values.max(2).T + self.shift
        return (most, values.argmax(2).T) if where else most

    def features(self, pooled: np.ndarray, row: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """[rows, 2 * FILTERS + 1]; chunks come in the order of their rows."""
        pooled = np.maximum(pooled, 0)
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        most = np.maximum.reduceat(pooled, first)
        mean = np.add.reduceat(pooled, first) / np.diff(np.append(first, len(row)))[:, None]
        return np.hstack([most, mean, np.log1p(lengths)[:, None] / 10]).astype(np.float32)

    def scores(self, data: np.ndarray, offsets: np.ndarray, block: int = 16) -> np.ndarray:
        chunks, row = chunked(data, offsets)
        pooled = np.concatenate([self.pooled(chunks[k : k + block]) for k in range(0, len(chunks), block)])
        z = self.features(pooled, row, np.diff(offsets)) @ self.out + self.bias
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))


def fitted(texts: list[bytes], labels: np.ndarray, epochs: int = 10, batch: int = 32, rate: float = 0.01, seed: int = SEED) -> Network:
    """Adam on the logistic loss; both classes weigh the same in all."""
    rng = np.random.default_rng(seed)
    net = Network(*(x.astype(np.float32) for x in (rng.normal(0, 0.5, (257, DEPTH)), rng.normal(0, 0.3, (WIDTH * DEPTH, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, 2 * FILTERS + 1), np.zeros(1))))
    net.vectors[PAD] = 0
    weights = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9)).astype(np.float32)
    parts = [net.vectors, net.filters, net.shift, net.out, net.bias]
    first, second, t = [np.zeros_like(x) for x in parts], [np.zeros_like(x) for x in parts], 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), batch):
            own = order[k : k + batch]
            offsets = np.concatenate([[0], np.cumsum([len(texts[i]) for i in own])])
            chunks, row = chunked(np.frombuffer(b"".join(texts[i] for i in own), np.uint8), offsets)
            found = [net.pooled(chunks[j : j + 16], where=True) for j in range(0, len(chunks), 16)]
            pooled, at = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
            x = net.features(pooled, row, np.diff(offsets))
            p = 1 / (1 + np.exp(-np.clip(x @ net.out + net.bias, -30, 30)))
            dz = ((p - labels[own]) * weights[own] / len(own)).astype(np.float32)
            dx = dz[:, None] * net.out[None, :]
            counts = np.bincount(row, minlength=len(own))
            top = np.maximum(pooled, 0) == x[row, :FILTERS]
            dpooled = (dx[row, :FILTERS] * top + dx[row, FILTERS : 2 * FILTERS] / counts[row][:, None]) * (pooled > 0)
            spans = chunks[np.arange(len(chunks))[:, None, None], at[:, :, None] + np.arange(WIDTH)]  # chunk, filter, byte
            windows = net.vectors[spans].reshape(len(chunks), FILTERS, WIDTH * DEPTH)
            dvectors = np.zeros_like(net.vectors)
            np.add.at(dvectors, spans.reshape(-1), (dpooled[:, :, None] * net.filters.T[None]).reshape(-1, DEPTH))
            dvectors[PAD] = 0
            grads = [dvectors, np.einsum("cf,cfd->df", dpooled, windows), dpooled.sum(0), x.T @ dz, dz.sum(keepdims=True)]
            t += 1
            step = rate * (1 - epoch / (epochs + 1))
            for w, g, m, v in zip(parts, grads, first, second, strict=True):
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                w -= (step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
    return net


def held_out(doc_id="doc_id"):
    """Rows that are never learned from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, text) -> DataFrame:
    """`rows` labelled documents at most, held-out ones apart: doc_id, label, text (of the expression given)."""
    chosen = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id")  # `rows` rows at most
    return found.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Network | float:
    """The network, or a constant if the labels have fewer than two classes."""
    rows = sample(docs, labels, "quality", train_rows, text_of(docs)).collect()  # train_rows texts at most
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    y = np.array([min(1, max(0, r["label"])) for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    return fitted([r["text"].encode() for r in rows], y)


def score(docs: DataFrame, model: Network | float) -> DataFrame:
    """doc_id, score of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, part in steps(batch.column(1), 1 << 19):
                got = np.full(hi - lo, model) if isinstance(model, float) else model.scores(*text_bytes(part))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(got, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
