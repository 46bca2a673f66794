"""Importance resampling towards a target distribution over hashed n-gram buckets.

Each document is a row of a sparse document-by-bucket matrix of counts. The matrix is never kept: it is several
times the texts, and blocks of it, read back, filled the executors. A first pass over the texts adds up its columns,
for the corpus and for the target, which gives a gain for each bucket; a second one makes the rows again and
multiplies them with the gains, which gives each document's weight. Documents are drawn without replacement by the
Gumbel trick: the highest weight plus noise, where the noise depends on the doc_id alone. As `docs` is read twice,
it should be a table or cheap to make, and the same each time.

The gains (one number a bucket) are the only thing that goes to every task, and the only thing
that is collected. Ranks come from a sort by ranges with each range's rows counted, so no task holds all rows.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z: ASCII digits and letters and all other
characters, so texts are handled as bytes. Features are all runs of 1 to 3 words; the crc32 of a run that ends in a word
goes on from that of the run before the word. crc32 is linear, so this is done for all words of a step at once, by tables.

Defined results: null and empty texts have no features, weight 0 and are never drawn; an empty target or corpus
has sums of 0; rows without a doc_id take part with the noise of an empty id and stand last among ties;
rows that repeat count each, and those that tie in score and doc_id go by weight and n_features; an empty
table gives none. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import STEP_BYTES, scoped, steps, text_bytes, text_of, written

N_BUCKETS, LONGEST = 10_000, 3
#: Draws this share, in hundredths, of the documents with so many words.
PERCENT, LEAST_WORDS, SEED = 5, 20, 42
#: What is no part of a word becomes a space, and A-Z lower case.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of text that are handled at once; arrays of that many words stay in a processor's cache.
AT_ONCE = STEP_BYTES // 8
#: Words of more bytes than this go through crc32 one by one.
TABLED = 64


def pieces(text: bytes, limit: int = AT_ONCE) -> Iterator[bytes]:
    """The text cut before spaces into pieces of about `limit` bytes."""
    at = 0
    while len(text) - at > limit:
        to = text.find(b" ", at + limit)
        if to < 0:
            break
        yield text[at:to]
        at = to
    yield text[at:] if at else text


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What a byte adds to a word's crc32 by the bytes after it; the crc32 of zeros by their number, and of a
    space and zeros; what a byte of a crc32 becomes when so many bytes follow."""
    zeros = [bytes(n) for n in range(TABLED + 2)]
    of_zeros = np.array([crc32(z) for z in zeros], np.uint32)
    spaced = np.array([crc32(b" " + z) for z in zeros], np.uint32)
    added = np.array([[crc32(zeros[n], crc32(bytes([b]))) for b in range(256)] for n in range(TABLED)], np.uint32) ^ of_zeros[1 : TABLED + 1, None]
    moved = np.array([[crc32(z, b << k) for k in (0, 8, 16, 24) for b in range(256)] for z in zeros], np.uint32) ^ of_zeros[:, None]
    return added.ravel(), of_zeros, spaced, moved.ravel()


def runs(text: bytes, offsets: np.ndarray, longest: int = LONGEST, before: tuple[int, ...] = ()) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(crc32 of the runs of 1, 2, ... words, by the words they end with; those words' places; each row's offset into
    the words) of rows that stand side by side in `text`, to which LETTERS is applied. There is a run of k + 1 words
    where the place is k or more.

    `before` has the crc32 of the runs of 1, 2, ... words after which the first row, a piece of a text, goes on.
    """
    added, of_zeros, spaced, moved = tables()
    data = np.frombuffer(text, np.uint8)
    inside = data != 32
    edges = np.zeros(len(data) + 1, bool)
    edges[1:-1] = inside[1:] != inside[:-1]
    edges[offsets] = True
    starts, ends = np.flatnonzero(inside & edges[:-1]), np.flatnonzero(inside & edges[1:]) + 1
    sizes = ends - starts
    rows = np.searchsorted(starts, offsets)
    long = [(i, text[starts[i] : ends[i]]) for i in np.flatnonzero(sizes > TABLED).tolist()]
    tabled = np.where(sizes > TABLED, 0, sizes)
    upto = np.cumsum(tabled)
    byte = np.arange(upto[-1] if len(upto) else 0)
    left = np.repeat(upto, tabled) - 1 - byte
    sums = np.zeros(len(byte) + 1, np.uint32)
    np.bitwise_xor.accumulate(added[(left << 8) + data[np.repeat(ends - upto, tabled) + byte]], out=sums[1:])
    words = sums[upto] ^ sums[upto - tabled] ^ of_zeros[tabled]
    for i, word in long:
        words[i] = crc32(word)
    found, goes_on = [words], words ^ of_zeros[tabled] ^ spaced[tabled]
    for k in range(1, longest):
        shorter = np.zeros(len(words), "<u4")
        shorter[1:] = found[-1][:-1]
        if len(words) and k <= len(before):
            shorter[0] = before[k - 1]
        longer = goes_on.copy()
        for j, part in enumerate(shorter.view(np.uint8).reshape(-1, 4).T):
            longer ^= moved[(tabled + 1 << 10) + 256 * j + part]
        for i, word in long:
            longer[i] = crc32(word, crc32(b" ", int(shorter[i])))
        found.append(longer)
    place = np.arange(len(words)) - np.repeat(rows[:-1], np.diff(rows))
    place[: rows[1]] += len(before)
    return found, place, rows


def runs_of(texts: pa.Array, longest: int = LONGEST) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """What `runs` gives for the texts of a step; for a single one, which may be long, piece by piece."""
    data, offsets = text_bytes(texts)
    lowered = data.tobytes().translate(LETTERS)
    if len(texts) > 1:
        yield runs(lowered, offsets, longest)
        return
    before: tuple[int, ...] = ()
    for piece in pieces(lowered):
        found, place, rows = runs(piece, np.array([0, len(piece)]), longest, before)
        yield found, place, rows
        if len(place):
            before = tuple(int(x[-1]) for x in found[: min(longest - 1, int(place[-1]) + 1)])


def bucket_sums(texts: pa.Array, n_buckets: int = N_BUCKETS, longest: int = LONGEST) -> tuple[np.ndarray, int]:
    """The features of each bucket in the texts of a step, and their words."""
    sums, n_words = np.zeros(n_buckets, np.int64), 0
    for found, place, _ in runs_of(texts, longest):
        sums += np.bincount(np.concatenate([x[place >= k] for k, x in enumerate(found)]) % np.uint32(n_buckets), minlength=n_buckets)
        n_words += len(place)
    return sums, n_words


def row_gains(texts: pa.Array, gain: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the gains of each text's features, and its words."""
    weight, n_words = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for found, place, rows in runs_of(texts, longest):
        own = np.zeros(len(place) + 1, np.int64)
        for k, x in enumerate(found):
            own[1:] += np.where(place >= k, gain[x % np.uint32(len(gain))], 0)
        upto = np.cumsum(own)
        weight += upto[rows[1:]] - upto[rows[:-1]]
        n_words += np.diff(rows)
    return weight, n_words


def features(text: str, n_buckets: int = N_BUCKETS, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(buckets in order, their counts, words, features) of a whole text: its row of the matrix."""
    sums, n_words = bucket_sums(pa.array([text], pa.large_string()), n_buckets, longest)
    buckets = np.flatnonzero(sums)
    return buckets, sums[buckets], n_words, int(sums.sum())


def column_sums(docs: DataFrame, text: str = "text", n_buckets: int = N_BUCKETS, longest: int = LONGEST) -> DataFrame:
    """bucket, n: a partial sum from each task, then the sums of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for _, _, part in steps(batch.column(0), AT_ONCE):
                sums += bucket_sums(part, n_buckets, longest)[0]
        held = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(sums[held])], names=["bucket", "n"])

    return docs.select(text_of(docs, text).alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, n_buckets: int = N_BUCKETS) -> list[int]:
    """Each bucket's gain from column sums: thousandths of the logarithm of smoothed target over source share, rounded down."""
    s, t = ([0] * n_buckets for _ in "st")
    for sums, rows in ((s, source), (t, target)):
        for bucket, n in rows.select("bucket", "n").collect():  # n_buckets rows at most
            sums[bucket] = n
    total_s, total_t = sum(s), sum(t)
    return [math.floor(1000 * math.log((float(b + 1) * float(total_s + n_buckets)) / (float(a + 1) * float(total_t + n_buckets)))) for a, b in zip(s, t, strict=True)]


def weights(docs: DataFrame, gain: list[int], id_column: str = "doc_id", text: str = "text", longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features, weight: the matrix times the gains, its rows made step by step."""
    held = np.array(gain, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [row_gains(part, held, longest) for _, _, part in steps(batch.column(1), AT_ONCE)]
            weight, n_words = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*each, strict=True) if each else ((), ())))
            n_features = sum(np.maximum(n_words - k, 0) for k in range(longest))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n_words, n_features, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(docs[id_column].cast("long").alias("doc_id"), text_of(docs, text).alias("text")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, rounded down, from the first 8 hex digits of sha256 of the seed and the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """rows with their place from 1 in the order, null beyond the n-th: sorted into ranges, whose
    rows are counted; a row's place is the rows of the ranges before and its place in its own.

    The order should leave equal rows only undecided.
    """
    in_ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("_at"))
    placed = written(in_ranges.withColumns({"_range": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)}))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("rows"))  # a row for each range
    before = F.coalesce(F.sum("rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range").withColumn(rank, F.col("_before") + F.col("_at") + 1)
    return placed.withColumn(rank, F.when(F.col(rank) <= n, F.col(rank))).select(*rows.columns, rank)


@scoped
def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, n_buckets: int = N_BUCKETS, longest: int = LONGEST) -> DataFrame:
    """Every document's doc_id, n_words, n_features, weight, score and rank, null unless it is drawn."""
    sums = [column_sums(x, n_buckets=n_buckets, longest=longest) for x in (docs, target)]
    found = weights(docs, gains(*sums, n_buckets), longest=longest)
    scored = written(found.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    able = F.col("n_words") >= least_words
    n = scored.where(able).count() * percent // 100
    return ranked(scored, [(~able).asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features").desc(), F.col("n_words")], n)


def resampled(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of docs whose doc_id is drawn (all of them, if a doc_id repeats), with all their columns."""
    drawn = draw(docs, target, **options).where("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(drawn, docs["doc_id"].cast("long").eqNullSafe(drawn["_drawn"]), "left_semi")
