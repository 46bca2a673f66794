"""Short-time Fourier transform, its inverse and ensembles of spectra, in chunks of frames.

Spark deals samples to chunks of 64 frames, with the half frame that they need on either side, and
groups by signal and chunk: a task holds one chunk's samples and spectra (for an ensemble, of
all members), whatever the signal's length. The inverse deals frames to chunks of samples likewise.
Window, centring and padding: periodic Hann, centred, padded with zeros.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as chunk_form

SIZE, HOP = 4096, 1024
#: Frames of a chunk.
CHUNK = 64


def window(size: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)


def forward(x: np.ndarray, size: int = SIZE, hop: int = HOP) -> np.ndarray:
    """[frames, size // 2 + 1] complex."""
    padded = np.pad(x, size // 2)
    frames = np.lib.stride_tricks.sliding_window_view(padded, size)[::hop]
    return np.fft.rfft(frames * window(size), axis=1)


def inverse(spectrum: np.ndarray, length: int, size: int = SIZE, hop: int = HOP) -> np.ndarray:
    """Overlapped frames over the overlapped squared windows, cut to `length`."""
    frames = np.fft.irfft(spectrum, n=size, axis=1) * window(size)
    total = size + hop * (len(frames) - 1)
    sums, weight = np.zeros(max(total, length + size)), np.zeros(max(total, length + size))
    for k, frame in enumerate(frames):
        sums[k * hop : k * hop + size] += frame
        weight[k * hop : k * hop + size] += window(size) ** 2
    out = sums / np.where(weight > 1e-10, weight, 1)
    return out[size // 2 : size // 2 + length]


def merged(spectra: list[np.ndarray], algo: str) -> np.ndarray:
    """Per bin the value of greatest or least magnitude, phase kept; the first model on ties."""
    stack = np.stack(spectra)
    sizes = np.abs(stack)
    pick = sizes.argmax(0) if algo == "max" else sizes.argmin(0)
    return np.take_along_axis(stack, pick[None], 0)[0]


def kinds_of(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in df.select(*keys).dtypes)


def lengths_of(signal: DataFrame, keys: list[str]) -> DataFrame:
    return signal.groupBy(*keys).agg((F.max("i") + 1).alias("n"))


def keyed(out: pd.DataFrame, keys: list[str], key: tuple, columns: list[str]) -> pd.DataFrame:
    for name, value in zip(keys, key, strict=False):
        out[name] = value
    return out[[*keys, *columns]]


def stft(signal: DataFrame, keys: list[str], size: int = SIZE, hop: int = HOP, lengths: DataFrame | None = None) -> DataFrame:
    """keys, frame, re, im (arrays over bins). signal: keys, i, v; lengths: keys, n, if signals are to be cut."""
    known = (lengths if lengths is not None else lengths_of(signal, keys)).select(*keys, "n")
    half = size // 2
    # sample i is in frames from ceil((i - half + 1) / hop) to floor((i + half) / hop); of those the chunks
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - half + 1) / hop))
    last = F.least(F.floor((F.col("i") + half) / hop), F.floor(F.col("n") / hop))
    placed = signal.select(*keys, "i", "v").join(known, keys).where("i < n").select(*keys, "i", F.col("v").cast("double").alias("v"), "n", F.explode(F.sequence(F.floor(first / CHUNK), F.floor(last / CHUNK))).alias("chunk"))

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        chunk, n = int(key[-1]), int(rows["n"].iloc[0])
        frames = np.arange(chunk * CHUNK, min((chunk + 1) * CHUNK, n // hop + 1))
        begin = frames[0] * hop - half
        x = np.zeros((len(frames) - 1) * hop + size)
        at = rows["i"].to_numpy() - begin
        inside = (at >= 0) & (at < len(x))
        x[at[inside]] = rows["v"].to_numpy()[inside]
        spectrum = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(x, size)[::hop] * window(size), axis=1)
        return keyed(pd.DataFrame({"frame": frames, "re": list(spectrum.real), "im": list(spectrum.imag)}), keys, key, ["frame", "re", "im"])

    return placed.groupBy(*keys, "chunk").applyInPandas(run, f"{kinds_of(signal, keys)}, frame long, re array<double>, im array<double>")


def istft(frames: DataFrame, lengths: DataFrame, keys: list[str], size: int = SIZE, hop: int = HOP) -> DataFrame:
    """keys, i, v. lengths: keys, n."""
    half, span = size // 2, CHUNK * hop
    # frame f covers samples from f * hop - half on, `size` of them
    first = F.floor(F.greatest(F.lit(0), F.col("frame") * hop - half) / span)
    last = F.floor(F.greatest(F.lit(0), F.least(F.col("frame") * hop + half - 1, F.col("n") - 1)) / span)
    placed = frames.select(*keys, "frame", "re", "im").join(lengths.select(*keys, "n"), keys).where("n > 0").withColumn("chunk", F.explode(F.sequence(first, F.greatest(first, last))))

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        begin, n = int(key[-1]) * span, int(rows["n"].iloc[0])
        length = min(span, n - begin)
        if length <= 0:
            return keyed(pd.DataFrame({"i": [], "v": []}), keys, key, ["i", "v"])
        spectrum = np.stack(rows["re"].to_list()) + 1j * np.stack(rows["im"].to_list())
        parts = np.fft.irfft(spectrum, n=size, axis=1) * window(size)
        sums, weight = np.zeros(length + 2 * size), np.zeros(length + 2 * size)
        for frame, part in zip(rows["frame"].to_numpy(), parts, strict=True):
            at = int(frame) * hop - half - begin + size
            if 0 <= at <= length + size:
                sums[at : at + size] += part
                weight[at : at + size] += window(size) ** 2
        v = (sums / np.where(weight > 1e-10, weight, 1))[size : size + length]
        return keyed(pd.DataFrame({"i": np.arange(begin, begin + length), "v": v}), keys, key, ["i", "v"])

    return placed.groupBy(*keys, "chunk").applyInPandas(run, f"{kinds_of(frames, keys)}, i long, v double")


def picked(frames: DataFrame, keys: list[str], model: str, algo: str = "max") -> DataFrame:
    """keys, frame, re, im: per bin the member's value of greatest or least magnitude, phase kept; the first member on ties."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        members = [g.sort_values("frame") for _, g in rows.groupby(model, sort=True)]
        best = merged([np.stack(g["re"].to_list()) + 1j * np.stack(g["im"].to_list()) for g in members], algo)
        return keyed(pd.DataFrame({"frame": members[0]["frame"].to_numpy(), "re": list(best.real), "im": list(best.imag)}), keys, key, ["frame", "re", "im"])

    chunked = frames.select(*keys, model, "frame", "re", "im", F.floor(F.col("frame") / CHUNK).alias("chunk"))
    return chunked.groupBy(*keys, "chunk").applyInPandas(run, f"{kinds_of(frames, keys)}, frame long, re array<double>, im array<double>")


def spectral_ensemble(signal: DataFrame, keys: list[str], model: str, algo: str = "max", size: int = SIZE, hop: int = HOP) -> DataFrame:
    """keys, i, v: the members of each key (in the order of `model`), cut to the shortest and merged.

    max and min choose per bin of the members' spectra; avg is the mean of the samples.
    """
    lengths = lengths_of(signal, [*keys, model]).groupBy(*keys).agg(F.min("n").alias("n"))
    if algo == "avg":
        return signal.join(lengths, keys).where("i < n").groupBy(*keys, "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    members = signal.select(*keys, model).distinct().join(lengths, keys)
    spectra = stft(signal, [*keys, model], size, hop, members)
    return istft(picked(spectra, keys, model, algo), lengths, keys, size, hop)


def chunk_ensemble(chunks: DataFrame, keys: list[str], model: str, algo: str = "max", size: int = SIZE, hop: int = HOP, span: int = chunk_form.SIZE) -> DataFrame:
    """spectral_ensemble of signals in chunk form (keys, model, chunk, samples of `span`): keys, chunk, samples.

    Each chunk of the result gets the members' samples that it needs, which are its own and a frame on either side, in one
    shuffle; the members' spectra, the choice per bin and the inverse exist within one task's chunk only.
    """
    if algo == "avg":
        return chunk_form.ensemble(chunks, keys, model, "avg", span)
    lengths = chunk_form.lengths(chunks, [*keys, model], span).groupBy(*keys).agg(F.min("n").alias("n")).where("n > 0")
    start = F.col("chunk") * F.lit(span).cast("long")
    stop = F.least(chunk_form.end(span), F.col("n"))
    last = F.floor((F.col("n") - 1) / span)
    wanted = F.sequence(F.greatest(F.lit(0).cast("long"), F.floor((start - size) / span)), F.least(last, F.floor((stop - 1 + size) / span)))
    dealt = chunks.join(lengths, keys).where(start < F.col("n")).withColumns({"start": start, "stop": stop}).select(*keys, model, "n", "start", "stop", "samples", F.explode(wanted).alias("chunk"))
    lo = F.greatest(F.col("start"), F.col("chunk") * F.lit(span).cast("long") - size)
    hi = F.least(F.col("stop"), (F.col("chunk") + 1) * F.lit(span).cast("long") + size)
    piece = F.slice("samples", (lo - F.col("start") + 1).cast("int"), F.greatest(F.lit(0).cast("long"), hi - lo).cast("int"))
    each = F.array_sort(F.collect_list(F.struct(F.col(model).alias("m"), lo.alias("at"), piece.alias("x"))))
    met = dealt.groupBy(*keys, "chunk", "n").agg(each.alias("each"))
    ranks = F.transform("each", lambda e: F.array_position(F.array_distinct(F.transform("each", lambda o: o["m"])), e["m"]))
    kernel = _chunk_kernel(algo, size, hop, span)
    return met.select(*keys, "chunk", kernel(ranks, F.transform("each", lambda e: e["at"]), F.transform("each", lambda e: e["x"]), "chunk", "n").alias("samples"))


def _chunk_kernel(algo: str, size: int, hop: int, span: int):
    half, shape = size // 2, window(size)

    def of(ranks, places, pieces, chunk: int, n: int) -> np.ndarray:
        begin, length = chunk * span, min(span, n - chunk * span)
        first = max(0, (begin + half - size) // hop + 1)
        frames = min(n // hop, -(-(begin + length + half) // hop) - 1) - first + 1
        base = first * hop - half
        members = np.zeros((int(max(ranks)), (frames - 1) * hop + size))
        for rank, at, x in zip(ranks, places, pieces, strict=True):
            lo, hi = max(0, at - base), min(members.shape[1], at - base + len(x))
            if lo < hi:
                members[rank - 1, lo:hi] = x[lo - (at - base) : hi - (at - base)]
        spectra = [np.fft.rfft(np.lib.stride_tricks.sliding_window_view(x, size)[::hop] * shape, axis=1) for x in members]
        parts = np.fft.irfft(merged(spectra, algo) if len(spectra) > 1 else spectra[0], n=size, axis=1) * shape
        sums, weight = np.zeros(members.shape[1]), np.zeros(members.shape[1])
        for k, part in enumerate(parts):
            sums[k * hop : k * hop + size] += part
            weight[k * hop : k * hop + size] += shape**2
        return (sums / np.where(weight > 1e-10, weight, 1))[begin - base : begin - base + length]

    @F.pandas_udf(chunk_form.SAMPLES)
    def kernel(ranks: pd.Series, places: pd.Series, pieces: pd.Series, chunk: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([of(*row) for row in zip(ranks, places, pieces, chunk, n, strict=True)], dtype=object)

    return kernel


def resampled(x: np.ndarray, rate: int, wanted: int, width: int = 32) -> np.ndarray:
    """x at another rate, by a polyphase filter: a sinc under a Kaiser window, `width` zero crossings to either side."""
    if rate == wanted or not len(x):
        return x
    return resampled_range(x, 0, len(x), 0, resampled_length(len(x), rate, wanted), rate, wanted, width)


def resampled_length(n: int, rate: int, wanted: int) -> int:
    return -(-n * (wanted // math.gcd(rate, wanted)) // (rate // math.gcd(rate, wanted)))


@lru_cache(maxsize=8)
def polyphase(rate: int, wanted: int, width: int) -> tuple[int, int, int, np.ndarray]:
    """(up, down, delay, taps by phase) of the filter from one rate to the other."""
    up, down = wanted // math.gcd(rate, wanted), rate // math.gcd(rate, wanted)
    most = max(up, down)
    t = np.arange(-width * most, width * most + 1) / most
    taps = np.sinc(t) * np.kaiser(len(t), 12.0) * up / most
    return up, down, width * most, np.concatenate([taps, np.zeros(-len(taps) % up)]).reshape(-1, up)


def needed(lo: int, hi: int, rate: int, wanted: int, width: int = 32) -> tuple[int, int]:
    """The input samples from which the output samples lo to hi are made; they may lie beyond the signal."""
    up, down, delay, taps = polyphase(rate, wanted, width)
    return (lo * down + delay) // up - len(taps) + 1, ((hi - 1) * down + delay) // up + 1


def resampled_range(x: np.ndarray, offset: int, total: int, lo: int, hi: int, rate: int, wanted: int, width: int = 32) -> np.ndarray:
    """Output samples lo to hi of a signal of `total` samples, of which x holds those from `offset` on that they need:
    the phase of an output sample follows from its own number, so ranges are the same as the whole."""
    up, down, delay, taps = polyphase(rate, wanted, width)
    out = np.arange(lo, hi)
    phase, newest = (out * down + delay) % up, (out * down + delay) // up
    sums = np.zeros(len(out))
    for k, column in enumerate(taps):
        at = newest - k
        inside = (at >= 0) & (at < total)
        sums[inside] += column[phase[inside]] * x[at[inside] - offset]
    return sums


def bins(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Long form of stft(): keys, frame, bin, v as struct(re, im, mag), for ensemble() and to_db()."""
    each = frames.select(*keys, "frame", F.posexplode(F.arrays_zip("re", "im")).alias("bin", "z"))
    return each.select(*keys, "frame", "bin", F.struct(F.col("z.re").alias("re"), F.col("z.im").alias("im"), F.sqrt(F.col("z.re") * F.col("z.re") + F.col("z.im") * F.col("z.im")).alias("mag")).alias("v"))


def log_bins(size: int, rate: int, rows: int, least: float = 20.0) -> list[int]:
    """The bin nearest to each of `rows` frequencies from `least` to half the rate, in equal ratios."""
    top = rate / 2
    return [min(size // 2, math.floor(least * (top / least) ** (k / max(1, rows - 1)) * size / rate + 0.5)) for k in range(rows)]


def log_spectrogram(frames: DataFrame, keys: list[str], size: int = SIZE, rate: int = 44_100, rows: int = 256, amin: float = 1e-5, top: float = 80.0) -> DataFrame:
    """keys, frame, db (array over frequencies in equal ratios from 20 Hz to half the rate), relative to the signal's greatest
    magnitude over all its bins and not below -top. frames: those of stft(). A first pass over the frames has each one's greatest
    magnitude, a second one the few bins that are shown; no bin becomes a row.
    """
    size_of = F.zip_with("re", "im", lambda a, b: F.sqrt(a * a + b * b))
    sizes = frames.select(*keys, "frame", size_of.alias("m"))
    most = sizes.groupBy(*keys).agg(F.greatest(F.max(F.array_max("m")), F.lit(amin)).alias("most"))
    shown = F.array(*[F.lit(b) for b in log_bins(size, rate, rows)])
    db = F.transform(shown, lambda b: F.greatest(20 * F.log10(F.greatest(F.get("m", b), F.lit(amin)) / F.col("most")), F.lit(-top)))
    return sizes.join(most, keys).select(*keys, "frame", db.alias("db"))
