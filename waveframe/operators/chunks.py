"""Signals in chunk form: one row (keys, ch, chunk, samples) for each run of `size` samples of a channel.

All chunks of a channel but its last hold `size` samples, the first begins at sample 0. Kernels are
column expressions (residual, normalize) or numpy over a chunk's array; what is shuffled are chunks or a few numbers of each, never single
samples, and a task holds a batch of chunks, not a signal. A signal's channels and an ensemble's
members are taken to be few (they meet in one group for each chunk); its chunks may be any number.

Defined results: a chunk without samples is a channel of length 0 (level() gives silence); null samples are
no numbers; signals that only one side has are left out by residual(); an empty table gives none.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exact
from .signal import BUCKETS, EPSILON, RATE, loudness

SIZE = 1 << 16
# types as objects: a string needs a session when the module is imported
SAMPLES = T.ArrayType(T.DoubleType())
LONGS = T.ArrayType(T.LongType())
POWER = T.StructType().add("peak", T.DoubleType()).add("n", T.LongType()).add("exponents", T.ArrayType(T.IntegerType())).add("high", LONGS).add("low", LONGS)
EXTREMES = T.ArrayType(T.StructType().add("bucket", T.LongType()).add("lo", T.DoubleType()).add("hi", T.DoubleType()))


def chunked(signal: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    """Chunk form of long form (keys, i, v); a signal with a gap or a sample twice is an error. Each sample is shuffled here, once."""
    rows = signal.groupBy(*keys, F.floor(F.col("i") / size).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("i", F.col("v").cast("double").alias("v")))).alias("at"))
    dense = F.forall(F.transform("at", lambda x, k: x["i"] == F.col("chunk") * size + k), lambda ok: ok)
    told = F.raise_error(F.lit("chunk form needs every sample once"))
    return rows.select(*keys, "chunk", F.when(dense, F.transform("at", lambda x: x["v"])).otherwise(told.cast("array<double>")).alias("samples"))


def long_form(chunks: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    """keys, i, v: one row a sample."""
    each = chunks.select(*keys, "chunk", F.posexplode("samples").alias("at", "v"))
    return each.select(*keys, (F.col("chunk") * F.lit(size).cast("long") + F.col("at")).alias("i"), "v")


def end(size: int) -> Column:
    """The sample after a chunk's last one."""
    return F.col("chunk") * F.lit(size).cast("long") + F.size("samples")


def lengths(chunks: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    """keys, n: samples of the longest channel."""
    return chunks.groupBy(*keys).agg(F.max(end(size)).alias("n"))


def _rows(series: pd.Series) -> list[np.ndarray]:
    return [np.zeros(0) if x is None else np.asarray(x, np.float64) for x in series]


@F.pandas_udf(POWER)
def _power(samples: pd.Series) -> pd.DataFrame:
    found = []
    for x in _rows(samples):
        x = x[~np.isnan(x)]
        found.append((float(np.abs(x).max(initial=0.0)), len(x), *exact.parts(x * x)))
    return pd.DataFrame(found, columns=["peak", "n", "exponents", "high", "low"])


@F.pandas_udf(T.DoubleType())
def _total(exponents: pd.Series, high: pd.Series, low: pd.Series) -> pd.Series:
    return pd.Series([exact.total(*x) for x in zip(exponents, high, low, strict=True)], dtype="float64")


def _held(samples: Column) -> Column:
    return F.coalesce(samples, F.array().cast(SAMPLES))


def _number(x: Column) -> Column:
    """x, or null if it is no number."""
    return F.when(~F.isnan(x), x)


def _minus(a: Column, b: Column) -> Column:
    """a - b as far as both go, in the JVM."""
    a, b = _held(a), _held(b)
    return F.slice(F.zip_with(a, b, lambda x, y: _number(x - y)), F.lit(1), F.least(F.size(a), F.size(b)))


def _times(samples: Column, gain: Column) -> Column:
    return F.transform(_held(samples), lambda x: _number(x * gain))


@F.pandas_udf(SAMPLES)
def _mean(members: pd.Series) -> pd.Series:
    """Of arrays of arrays; a sample that only some have is their mean."""
    def of(each) -> np.ndarray:
        held = _rows(each)
        sums, n = np.zeros(max(map(len, held), default=0)), np.zeros(max(map(len, held), default=0))
        for x in held:
            sums[: len(x)] += x
            n[: len(x)] += 1
        return sums / n

    return pd.Series([of(x) for x in members], dtype=object)


def _picks(algo: str):
    @F.pandas_udf(SAMPLES)
    def pick(members: pd.Series) -> pd.Series:
        def further(best: np.ndarray, x: np.ndarray) -> np.ndarray:
            n = min(len(best), len(x))
            own, other = np.abs(best[:n]), np.abs(x[:n])
            return np.where(other > own if algo == "max" else other < own, x[:n], best[:n])

        return pd.Series([reduce(further, _rows(x)) for x in members], dtype=object)

    return pick


@F.pandas_udf(EXTREMES)
def _extremes(samples: pd.Series, start: pd.Series, step: pd.Series) -> pd.Series:
    def of(x: np.ndarray, start: int, step: int) -> list[dict]:
        if not len(x):
            return []
        first = start // step
        cuts = np.concatenate([[0], np.arange((first + 1) * step - start, len(x), step)])
        lows, highs = np.minimum.reduceat(x, cuts), np.maximum.reduceat(x, cuts)
        return [{"bucket": first + k, "lo": lo, "hi": hi} for k, (lo, hi) in enumerate(zip(lows.tolist(), highs.tolist(), strict=True))]

    return pd.Series([of(*each) for each in zip(_rows(samples), start, step, strict=True)], dtype=object)


def _together(chunks: DataFrame, keys: list[str], member: str) -> DataFrame:
    """keys, chunk, members: the members' samples, in the order of `member`."""
    each = F.array_sort(F.collect_list(F.struct(F.col(member).alias("m"), F.col("samples").alias("x"))))
    return chunks.groupBy(*keys, "chunk").agg(F.transform(each, lambda s: s["x"]).alias("members"))


def mono(chunks: DataFrame, keys: list[str], ch: str = "ch") -> DataFrame:
    """keys, chunk, samples: the mean over channels."""
    return _together(chunks, keys, ch).select(*keys, "chunk", _mean("members").alias("samples"))


def level(chunks: DataFrame, keys: list[str], rate: int = RATE, size: int = SIZE, ch: str = "ch") -> DataFrame:
    """peak, rms, loudness, sr, channels, duration_s over all channels, as signal.level.

    The squares' sum is exact and rounded once, so no partitioning changes a digit; what is shuffled is
    a row for each chunk and exponent of two.
    """
    each = chunks.select(*keys, ch, end(size).alias("end"), _power("samples").alias("p"))
    whole = each.groupBy(*keys).agg(F.max("p.peak").alias("peak"), F.sum("p.n").alias("n"), F.max("end").alias("length"), F.count_distinct(ch).alias("channels"))
    split = each.select(*keys, F.explode(F.arrays_zip(F.col("p.exponents").alias("e"), F.col("p.high").alias("h"), F.col("p.low").alias("w"))).alias("x"))
    summed = split.groupBy(*keys, F.col("x.e").alias("e")).agg(F.sum(F.col("x.h").cast("decimal(20,0)")).alias("h"), F.sum(F.col("x.w").cast("decimal(20,0)")).alias("w"))
    # a double has 2,098 exponents at most
    gathered = summed.groupBy(*keys).agg(F.collect_list(F.struct("e", "h", "w")).alias("all"))
    power = gathered.select(*keys, _total("all.e", "all.h", "all.w").alias("power"))
    same = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
    both = whole.alias("l").join(power.alias("r"), same, "left").select("l.*", F.coalesce("r.power", F.lit(0.0)).alias("power"))
    rms = F.when(F.col("n") > 0, F.sqrt(F.col("power") / F.col("n"))).otherwise(0.0)
    return both.select(*keys, "peak", rms.alias("rms"), loudness(rms).alias("loudness"), F.lit(rate).alias("sr"), "channels", (F.col("length") / F.lit(float(rate))).alias("duration_s"))


def align(chunks: DataFrame, keys: list[str], member: str, size: int = SIZE) -> DataFrame:
    """The members of each key, cut to the shortest one's length."""
    shortest = lengths(chunks, [*keys, member], size).groupBy(*keys).agg(F.min("n").alias("shortest"))
    start = F.col("chunk") * F.lit(size).cast("long")
    own = chunks.join(shortest, keys).where((start < F.col("shortest")) | (F.col("chunk") == 0))
    kept = F.slice("samples", 1, F.greatest(F.lit(0), F.least(F.lit(size).cast("long"), F.col("shortest") - start)).cast("int"))
    return own.withColumn("samples", kept).drop("shortest")


def residual(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, chunk, samples: a - b at the positions that both have."""
    both = a.select(*keys, "chunk", "samples").join(b.select(*keys, "chunk", F.col("samples").alias("other")), [*keys, "chunk"])
    return both.select(*keys, "chunk", _minus(F.col("samples").cast(SAMPLES), F.col("other").cast(SAMPLES)).alias("samples"))


def peaks(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, peak: the greatest magnitude over all chunks of a key."""
    each = F.greatest(F.abs(F.array_max("samples")), F.abs(F.array_min("samples")))
    return chunks.groupBy(*keys).agg(F.coalesce(F.max(each), F.lit(0.0)).alias("peak"))


def normalize(chunks: DataFrame, keys: list[str], dbfs: float = -5.0) -> DataFrame:
    """samples scaled so that the signal's peak, over all its channels, is at dbfs, and gain; silence is left as it is."""
    gain = F.when(F.col("peak") > EPSILON, F.lit(10 ** (dbfs / 20)) / F.col("peak")).otherwise(1.0)
    return chunks.join(peaks(chunks, keys), keys).withColumn("gain", gain).withColumn("samples", _times(F.col("samples").cast(SAMPLES), F.col("gain"))).drop("peak")


def ensemble(chunks: DataFrame, keys: list[str], member: str, algo: str = "avg", size: int = SIZE) -> DataFrame:
    """keys, chunk, samples: members cut to the shortest; the mean, or the sample of greatest or least magnitude (the first member's on ties)."""
    if algo not in ("avg", "max", "min"):
        raise ValueError(f"algo is max, min or avg, not {algo}")
    pick = _mean if algo == "avg" else _picks(algo)
    return _together(align(chunks, keys, member, size), keys, member).select(*keys, "chunk", pick("members").alias("samples"))


def envelope(chunks: DataFrame, keys: list[str], buckets: int = BUCKETS, size: int = SIZE) -> DataFrame:
    """bucket, lo, hi, as signal.envelope: a chunk's own extremes by bucket, then those of buckets that two chunks share."""
    placed = chunks.join(lengths(chunks, keys, size), keys)
    step = F.greatest(F.lit(1).cast("long"), F.expr(f"n div {buckets}"))
    own = placed.select(*keys, F.explode(_extremes("samples", F.col("chunk") * F.lit(size).cast("long"), step)).alias("x"))
    return own.groupBy(*keys, F.col("x.bucket").alias("bucket")).agg(F.min("x.lo").alias("lo"), F.max("x.hi").alias("hi"))
