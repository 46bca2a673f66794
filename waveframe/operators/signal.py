"""Signals in long form (slug, id, ch, i, v): levels, envelopes, alignment, residuals, gain.

All operators take the key columns as an argument, aggregate by key before they shuffle, and keep
the full precision of doubles; sums depend on the order of rows in their last digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import round_exact

RATE = 44_100
BUCKETS = 1600
EPSILON = 1e-9
#: Rows of a slice of long_positions, over all signals.
SLICE_ROWS = 1 << 18


def mono(signal: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over channels at each position."""
    return signal.groupBy(*keys, "i").agg(F.avg(F.col("v").cast("double")).alias("v"))


def level(signal: DataFrame, keys: list[str], rate: int = RATE) -> DataFrame:
    """peak, rms, loudness (20 log10(rms + 1e-9)), sr, channels, duration_s of each signal, over all its channels.

    A signal without samples has no row here; level_of() gives its values.
    """
    square = F.col("v").cast("double") * F.col("v").cast("double")
    sums = signal.groupBy(*keys, "ch").agg(F.max(F.abs("v")).alias("peak"), F.sum(square).alias("power"), F.count("*").alias("n"), (F.max("i") + 1).alias("length"))
    whole = sums.groupBy(*keys).agg(F.max("peak").alias("peak"), F.sum("power").alias("power"), F.sum("n").alias("n"), F.max("length").alias("length"), F.count("*").alias("channels"))
    rms = F.sqrt(F.col("power") / F.col("n"))
    return whole.select(*keys, "peak", rms.alias("rms"), loudness(rms).alias("loudness"), F.lit(rate).alias("sr"), "channels", (F.col("length") / F.lit(float(rate))).alias("duration_s"))


def rounded_level(levels: DataFrame) -> DataFrame:
    """Levels as records hold them: peak to 4 decimals, rms to 5, loudness to 1, duration to 2, by their exact values."""
    for name, places in (("peak", 4), ("rms", 5), ("loudness", 1), ("duration_s", 2)):
        levels = levels.withColumn(name, round_exact(F.col(name), places))
    return levels


def loudness(rms: Column) -> Column:
    return 20 * F.log10(F.coalesce(rms, F.lit(0.0)) + EPSILON)


def envelope(signal: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """bucket, lo, hi: extremes of runs of max(1, n div buckets) samples, so up to 2 * buckets - 1 of them.

    Lengths are found and joined by key unless the signal has them as n, as long_positions() gives them.
    """
    lengths = signal.groupBy(*keys).agg((F.max("i") + 1).alias("n"))
    step = F.greatest(F.lit(1), F.expr(f"n div {buckets}"))
    placed = (signal if "n" in signal.columns else signal.join(lengths, keys)).withColumn("bucket", F.floor(F.col("i") / step))
    return placed.groupBy(*keys, "bucket").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))


def rebucket(peaks: DataFrame, keys: list[str], width: int) -> DataFrame:
    """x, lo, hi: an envelope at `width` columns; column x covers the buckets from floor(x / width * n)
    to max(that + 1, floor((x + 1) / width * n)), exclusive. A range join as an equi-join."""
    spans = peaks.groupBy(*keys).agg((F.max("bucket") + 1).alias("n"))
    columns = spans.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    first = F.floor(F.col("x") / F.lit(float(width)) * F.col("n"))
    last = F.greatest(first + 1, F.floor((F.col("x") + 1) / F.lit(float(width)) * F.col("n")))
    covered = columns.select(*keys, "x", F.explode(F.sequence(first, last - 1)).alias("bucket"))
    joined = covered.join(peaks, [*keys, "bucket"], "left")
    return joined.groupBy(*keys, "x").agg(F.coalesce(F.min("lo"), F.lit(0.0)).alias("lo"), F.coalesce(F.max("hi"), F.lit(0.0)).alias("hi"))


def pyramid(peaks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, depth, node, lo, hi: the extremes of 2^depth buckets each, up to the depth at which one node has all.

    peaks: keys, bucket, lo, hi. An envelope has fewer than 3,200 buckets, so 12 doublings at most.
    """
    spans = peaks.groupBy(*keys).agg(F.ceil(F.log2(F.max("bucket") + 1)).cast("int").alias("top"))
    placed = peaks.join(spans, keys).select(*keys, "bucket", "lo", "hi", F.explode(F.sequence(F.lit(0), F.col("top"))).alias("depth"))
    node = F.floor(F.col("bucket") / F.pow(F.lit(2.0), F.col("depth")))
    return placed.groupBy(*keys, "depth", node.alias("node")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def from_pyramid(nodes: DataFrame, keys: list[str], width: int) -> DataFrame:
    """x, lo, hi as rebucket() has them: a column's buckets are two nodes of each depth at most, so what is read
    grows with the width and the depths and not with the buckets."""
    spans = nodes.where("depth = 0").groupBy(*keys).agg((F.max("node") + 1).alias("n"))
    columns = spans.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    first = F.floor(F.col("x") / F.lit(float(width)) * F.col("n"))
    last = F.greatest(first + 1, F.floor((F.col("x") + 1) / F.lit(float(width)) * F.col("n")))
    deep = columns.select(*keys, "x", "n", first.alias("first"), last.alias("last"))
    deep = deep.withColumn("depth", F.explode(F.sequence(F.lit(0), F.ceil(F.log2("n")).cast("int"))))
    size = F.pow(F.lit(2.0), F.col("depth"))
    lo, hi = F.ceil(F.col("first") / size), F.floor(F.col("last") / size)
    # of the whole nodes of a depth, those that no node of the next depth covers
    ends = F.array(F.when(lo % 2 == 1, lo), F.when(hi % 2 == 1, hi - 1))
    wanted = deep.select(*keys, "x", "depth", F.explode(F.when(lo < hi, F.array_compact(ends)).otherwise(F.array().cast("array<long>"))).alias("node"))
    joined = columns.select(*keys, "x").join(wanted, [*keys, "x"], "left").join(nodes, [*keys, "depth", "node"], "left")
    return joined.groupBy(*keys, "x").agg(F.coalesce(F.min("lo"), F.lit(0.0)).alias("lo"), F.coalesce(F.max("hi"), F.lit(0.0)).alias("hi"))


def divergence(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """x, delta: the larger of the differences of upper and lower envelopes at the same columns."""
    left = a.select(*keys, "x", F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
    right = b.select(*keys, "x", F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    delta = F.greatest(F.abs(F.col("a_hi") - F.col("b_hi")), F.abs(F.col("a_lo") - F.col("b_lo")))
    return left.join(right, [*keys, "x"]).select(*keys, "x", delta.alias("delta"))


def align(signal: DataFrame, keys: list[str], member: str) -> DataFrame:
    """The members of each key, cut to the shortest one's length."""
    lengths = signal.groupBy(*keys, member).agg((F.max("i") + 1).alias("n")).groupBy(*keys).agg(F.min("n").alias("shortest"))
    return signal.join(lengths, keys).where(F.col("i") < F.col("shortest")).drop("shortest")


def residual(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """a - b at the positions that both have."""
    return a.join(b.select(*keys, "i", F.col("v").alias("other")), [*keys, "i"]).select(*keys, "i", (F.col("v") - F.col("other")).alias("v"))


def normalize(signal: DataFrame, keys: list[str], dbfs: float = -5.0) -> DataFrame:
    """v scaled so that the signal's peak is at dbfs, and gain; silence is left as it is.

    Peaks are summed by key and joined, so a long signal is not sorted into one window.
    """
    target = 10 ** (dbfs / 20)
    peaks = signal.groupBy(*keys).agg(F.max(F.abs("v")).alias("peak"))
    gain = F.when(F.col("peak") > EPSILON, F.lit(target) / F.col("peak")).otherwise(1.0)
    return signal.join(peaks, keys).withColumn("gain", gain).withColumn("v", F.col("v") * F.col("gain")).drop("peak")


def to_db(frames: DataFrame, keys: list[str], amin: float = 1e-5, top: float = 80.0) -> DataFrame:
    """db: magnitudes relative to their key's greatest, not below -top."""
    most = frames.groupBy(*keys).agg(F.greatest(F.max(F.abs("v")), F.lit(amin)).alias("most"))
    db = 20 * F.log10(F.greatest(F.abs("v"), F.lit(amin)) / F.col("most"))
    return frames.join(most, keys).withColumn("db", F.greatest(db, F.lit(-top))).drop("most")


def ensemble(frames: DataFrame, keys: list[str], model: str, algo: str = "max") -> DataFrame:
    """One value a key from several models: of greatest or least magnitude (the first model on ties), or the mean.

    For complex bins v may be a struct with `mag`; for real values the magnitude is abs(v).
    """
    complex_ = dict(frames.dtypes)["v"].startswith("struct")
    size = F.col("v.mag") if complex_ else F.abs("v")
    if algo == "avg":
        return frames.groupBy(*keys).agg(F.avg(F.col("v").cast("double")).alias("v"))
    if algo == "max":
        return frames.groupBy(*keys).agg(F.max_by("v", F.struct(size, -F.col(model))).alias("v"))
    if algo == "min":
        return frames.groupBy(*keys).agg(F.min_by("v", F.struct(size, F.col(model))).alias("v"))
    raise ValueError(f"algo is max, min or avg, not {algo}")


def bucket_seconds(bucket: Column, length: Column, duration: Column) -> Column:
    """Where a bucket of an envelope of `length` buckets begins, in seconds."""
    return F.try_divide(bucket.cast("double"), length) * duration


def positions(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """A signal from rows: i numbers a key's rows in the order given."""
    at = Window.partitionBy(*keys).orderBy(order)
    return rows.select(*keys, (F.row_number().over(at) - 1).cast("long").alias("i"), F.col(value).alias("v"))


def long_positions(rows: DataFrame, keys: list[str], by: str, order: str, value: str, slice_rows: int | None = None) -> DataFrame:
    """positions() of few and long signals, and their lengths: keys (not null), i, v, n. `by` is a column of whole numbers
    that never falls along `order`.

    Rows are cut by equal widths of `by` into slices of about slice_rows (SLICE_ROWS); a row's number is the rows of its key's slices
    before, and its number within its own, so no task has a whole signal. The widths are equal, so a slice is
    as many times larger as `by` is denser there than on average; the numbers are right whatever the slices.
    """
    slice_rows = slice_rows or SLICE_ROWS
    low, high, n = rows.agg(F.min(by), F.max(by), F.count("*")).first()
    width = max(1, (high - low + 1) * slice_rows // n) if low is not None else 1
    # nulls come first in the order
    place = F.coalesce(F.expr(f"({by} - {low or 0}) div {width}"), F.lit(-1)).cast("long")
    placed = rows.select(*keys, place.alias("slice"), F.col(order).alias("at"), F.col(value).alias("v"))
    counts = placed.groupBy(*keys, "slice").agg(F.count("*").alias("held"))
    own = Window.partitionBy(*keys)
    upto = own.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "slice", F.coalesce(F.sum("held").over(upto), F.lit(0)).alias("start"), F.sum("held").over(own).alias("n"))
    within = F.row_number().over(Window.partitionBy(*keys, "slice").orderBy("at")) - 1
    dealt = placed.repartition(max(1, -(-n // slice_rows)), *keys, "slice").select(*keys, "slice", within.alias("k"), "v")
    return dealt.join(starts, [*keys, "slice"]).select(*keys, (F.col("start") + F.col("k")).cast("long").alias("i"), "v", "n")
