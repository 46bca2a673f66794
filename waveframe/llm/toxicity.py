"""Toxicity by cumulative-link ordinal regression on sparse words.

P(grade > k) = sigmoid(w.x - cut_k) for the cuts between grades 0 to 3: one weight for a word at
all cuts, as the proportional-odds model has it. x is log(1 + count) of each word (letters of any
script, lower case) of the whole text, and of each beginning of 4 to 8 bytes of a longer word, so
that inflected forms share a feature. The output is the expected grade, the sum of P(grade > k).

Labels are 0 or 1. A labelled 0 is grade 0. A labelled 1 is grade 1 to 3 by its amount of marker
features, those that toxic rows have far more often than others do: the terciles over the toxic
rows of the sum of log(1 + count). Weights are not negative, so that no wealth of harmless words offsets a toxic one,
and have an L1 penalty, so that words of no account get none.

It is fitted on the driver from `train_rows` labelled rows at most (those with the least hash of
doc_id); their words are hashed in tasks over whole texts. Scoring runs in tasks.

Defined results: null and empty texts have no words and are scored from the cuts alone; if the
labels have fewer than two classes nothing is toxic; repeated rows count each in the result, and of
rows that share a labelled doc_id the least text is learned from; other columns
pass through `keep` and are not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NOT_LETTERS, STEP_BYTES, steps, text_bytes, text_of, word_hashes
from .quality import sample

TRAIN_ROWS = 4000
GRADES = 4
THRESHOLD = 0.4
#: A feature needs so many toxic rows, and such a share of them.
LEAST_ROWS, LEAST_SHARE = 3, 0.02
#: It needs such log odds; the penalty has the weight of so many rows.
LEAST_ODDS, PENALTY_ROWS = 3.0, 0.1
BEGINNINGS = (4, 5, 6, 7, 8)


def features(part: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of every word and beginning of a word, and the number of words of every row."""
    words, offsets, parts = word_hashes(*text_bytes(part), NOT_LETTERS, BEGINNINGS)
    row = np.repeat(np.arange(len(part)), np.diff(offsets))
    rows = np.concatenate([row, *[row[which] for which, _ in parts]])
    return rows, np.concatenate([words, *[hashes for _, hashes in parts]]), np.diff(offsets)


@dataclass
class Ordinal:
    """Hashes of words (sorted), their weights, and the cuts between grades."""

    words: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def above(self, row: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
        """[rows, cuts]: P(grade > k) from each word of each row."""
        z = np.zeros(n)
        if len(self.words) and len(words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            hit = np.flatnonzero(self.words[at] == words)
            pair, count = np.unique(row[hit] * len(self.words) + at[hit], return_counts=True)
            z += np.bincount(pair // len(self.words), np.log1p(count) * self.weights[pair % len(self.words)], n)
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.cuts[None, :], -40, 40)))


def log_odds(rows: np.ndarray, words: np.ndarray, toxic: np.ndarray, n_words: int) -> np.ndarray:
    """Of a feature in toxic rows against others; -inf where too few toxic rows have it."""
    bad = np.bincount(words, toxic[rows], n_words)
    good = np.bincount(words, 1 - toxic[rows], n_words)
    odds = np.log((bad + 0.5) / (toxic.sum() + 1)) - np.log((good + 0.5) / (len(toxic) - toxic.sum() + 1))
    return np.where(bad >= max(LEAST_ROWS, LEAST_SHARE * toxic.sum()), odds, -np.inf)


def graded(rows: np.ndarray, words: np.ndarray, counts: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Grades from 0/1 labels by the amount of marker features. words: feature numbers."""
    n, most = len(toxic), int(words.max(initial=-1)) + 1
    marker = log_odds(rows, words, toxic, most) > LEAST_ODDS
    amount = np.bincount(rows, np.log1p(counts) * marker[words], n)
    own = amount[(toxic == 1) & (amount > 0)]
    edges = np.quantile(own, [1 / 3, 2 / 3]) if len(own) else np.array([np.inf, np.inf])
    return np.where(toxic == 1, 1 + (amount[:, None] > edges[None, :]).sum(1), 0)


def fitted(rows: np.ndarray, words: np.ndarray, counts: np.ndarray, grades: np.ndarray, n_words: int, penalty: float, turns: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cuts: accelerated proximal gradient steps on the mean loss of all cuts."""
    x = np.log1p(counts)
    n, k = len(grades), GRADES - 1
    over = (grades[:, None] > np.arange(k)[None, :]).astype(float)
    share = np.clip(over.mean(0), 1 / (n + 2), 1 - 1 / (n + 2))
    w, cuts = np.zeros(n_words), -np.log(share / (1 - share))
    ahead_w, ahead_cuts, t = w.copy(), cuts.copy(), 1.0
    # a bound on the curvature of the loss in the weights
    norm = np.ones(n_words)
    for _ in range(12):
        norm = np.bincount(words, x * np.bincount(rows, x * norm[words], n)[rows], n_words)
        size = np.linalg.norm(norm) or 1.0
        norm /= size
    step = 1 / (k * size / (4 * n) + 0.25)
    for _ in range(turns):
        z = np.bincount(rows, x * ahead_w[words], n)
        gap = 1 / (1 + np.exp(-np.clip(z[:, None] - ahead_cuts[None, :], -40, 40))) - over
        new_w = ahead_w - step * np.bincount(words, x * gap.sum(1)[rows], n_words) / n
        new_w = np.maximum(new_w - step * penalty, 0)
        new_cuts = np.maximum.accumulate(ahead_cuts + step * gap.mean(0))
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead_w, ahead_cuts = new_w + (before - 1) / t * (new_w - w), new_cuts + (before - 1) / t * (new_cuts - cuts)
        w, cuts = new_w, new_cuts
    return w, cuts


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Ordinal:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, part in steps(batch.column(2), STEP_BYTES // 2):
                row, words, sizes = features(part)
                order = np.lexsort((words, row))
                row, words = row[order], words[order]
                first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (words[1:] != words[:-1])])) if len(row) else np.zeros(0, np.int64)
                counts = np.diff(np.append(first, len(row)))
                offsets = pa.array(np.searchsorted(row[first], np.arange(hi - lo + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (words[first].view(np.int64), counts.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[:2], pa.array(sizes, pa.int64()), *lists], names=["doc_id", "label", "size", "words", "counts"])

    hashed = sample(docs, labels, "toxic", train_rows, F.lower(text_of(docs))).select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, size long, words array<long>, counts array<int>")
    got = hashed.toArrow().sort_by([("doc_id", "ascending"), ("size", "ascending")])  # of train_rows labels at most
    toxic = np.clip(np.asarray(got["label"].to_numpy(), float), 0, 1)
    if len(set(toxic.tolist())) < 2:
        return Ordinal(np.zeros(0, np.uint64), np.zeros(0), np.full(GRADES - 1, 40.0))
    lengths = np.concatenate([np.asarray(c.value_lengths()) for c in got["words"].chunks])
    rows = np.repeat(np.arange(len(toxic)), lengths)
    words = got["words"].combine_chunks().flatten().to_numpy().view(np.uint64)
    counts = got["counts"].combine_chunks().flatten().to_numpy()
    known, number, spread = np.unique(words, return_inverse=True, return_counts=True)
    common = spread >= LEAST_ROWS  # of all rows
    keep = common[number]
    renumber = np.cumsum(common) - 1
    rows, words, counts, known = rows[keep], renumber[number[keep]], counts[keep], known[common]
    return selected(rows, words, counts, graded(rows, words, counts, toxic), known)


def selected(rows, words, counts, grades, known) -> Ordinal:
    """Fit features that severe rows have far more often than others have."""
    used = log_odds(rows, words, (grades > 0).astype(float), len(known)) > LEAST_ODDS
    keep, number = used[words], np.cumsum(used) - 1
    weights, cuts = fitted(rows[keep], number[words[keep]], counts[keep], grades, int(used.sum()), PENALTY_ROWS / len(grades), 400)
    return Ordinal(known[used], weights, cuts)


def score(docs: DataFrame, model: Ordinal, keep: list[str] = ("doc_id",), name: str = "toxicity") -> DataFrame:
    """The columns of `keep` and a struct `name` of score (P(grade > 0)), severity, grade."""
    kept = [docs.schema[c] for c in keep]
    inner = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType())])
    kinds = pa.struct([("score", pa.float64()), ("severity", pa.float64()), ("grade", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, part in steps(batch.column(0), STEP_BYTES // 2):
                row, words, _ = features(part)
                above = model.above(row, words, hi - lo)
                grade = (above >= 0.5).sum(1)
                got = pa.StructArray.from_arrays([pa.array(above[:, 0]), pa.array(above.sum(1)), pa.array(grade, pa.int32())], fields=list(kinds))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[1:], got], names=[*keep, name])

    lowered = docs.select(F.lower(text_of(docs)).alias("text_seen"), *[docs[c] for c in keep])
    return lowered.mapInArrow(run, T.StructType([*kept, T.StructField(name, inner)]))


def detect(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, severity, grade, predicted (1: toxic) of every document."""
    scored = score(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]), train(docs, labels))
    return scored.select("doc_id", "toxicity.*", (F.col("toxicity.score") >= threshold).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, columns as they are, whose score is below the threshold."""
    name = "toxicity"
    while name in docs.columns:
        name += "_"
    return score(docs, train(docs, labels), docs.columns, name).where(F.col(f"{name}.score") < threshold).drop(name)
