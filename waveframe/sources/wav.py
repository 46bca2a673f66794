"""WAV files as a partitioned source and as a sink of loose files, for Spark's Python data sources.

Source: a file is cut into byte ranges, small files share a task, up to 1,024 of them. A range reads the header (a few bytes) and then
only its own chunks; a chunk belongs to the range that holds its first byte. Resampled chunks read the
input samples around them that the filter needs, so they equal those of the whole file bit for bit.

Sink: a task streams its files into a folder of its attempt, below a staging folder that readers skip. When
all tasks are done, the commit moves the files to their names; a failed job deletes the staging folder. Each file is
there whole or not at all. A file is written by one task, chunk after chunk.

Files are reached through pyarrow's file systems (local and mounted folders, and the stores that it knows by URI).

Defined results: mono is doubled; a file without samples has one empty chunk a channel; a size in the header that goes
beyond the file counts up to the file's end; a file that is no PCM or IEEE-float WAV is an error that
names it. On writing, samples beyond -1 to 1 are clipped, nulls are silence, channels of different lengths are an error,
a file of the same name is replaced, and with mode overwrite others in the folder are deleted.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from posixpath import dirname, join

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..operators import chunks as chunk_form
from ..operators.spectral import needed, resampled_length, resampled_range
from .files import below, dealt, in_threads, opened

NAME = "waveframe_wav"
SCHEMA = "path string, ch int, chunk long, start long, rate int, samples array<double>"
#: Bytes of a task, of one file or of several.
SPLIT = 64 << 20
#: Samples and rows of a batch, of one file or of several.
BATCH, BATCH_ROWS = 1 << 18, 10_000
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
UNKNOWN_SIZE = 0xFFFFFFFF


@dataclass(frozen=True)
class Header:
    data: int  # the place of the first sample
    n: int  # samples of a channel
    channels: int
    rate: int
    width: int  # bytes of a sample
    float_: bool

    @property
    def block(self) -> int:
        return self.channels * self.width


def header_of(file, size: int) -> Header:
    """The header of an open file of `size` bytes; chunks between its parts are skipped."""
    if file.read(4) not in (b"RIFF", b"RF64") or len(file.read(4)) < 4 or file.read(4) != b"WAVE":
        raise ValueError("no RIFF WAVE file")
    form, long_size = None, None
    while len(head := file.read(8)) == 8:
        kind, length = head[:4], struct.unpack("<I", head[4:])[0]
        if kind == b"data":
            if form is None:
                raise ValueError("samples before their format")
            tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", form[:16])
            tag = struct.unpack("<H", form[24:26])[0] if tag == EXTENSIBLE and len(form) >= 26 else tag
            width = bits // 8
            if (tag, width) not in {(PCM, 1), (PCM, 2), (PCM, 3), (PCM, 4), (FLOAT, 4), (FLOAT, 8)} or bits % 8 or not channels or not rate:
                raise ValueError(f"format {tag} with {bits} bits and {channels} channels is not supported")
            length = long_size if length == UNKNOWN_SIZE and long_size is not None else length
            return Header(file.tell(), max(0, min(length, size - file.tell())) // (channels * width), channels, rate, width, tag == FLOAT)
        body = file.read(length + length % 2) if kind in (b"fmt ", b"ds64") else file.seek(length + length % 2, 1)
        if kind == b"fmt ":
            form = body
        elif kind == b"ds64":
            long_size = struct.unpack("<Q", body[8:16])[0]
    raise ValueError("no samples")


def decoded(raw: bytes, header: Header) -> np.ndarray:
    """[channels, n] in -1 to 1."""
    raw = raw[: len(raw) // header.block * header.block]
    if header.float_:
        x = np.frombuffer(raw, f"<f{header.width}").astype(np.float64)
    elif header.width == 3:
        # the three bytes become the upper ones of 32 bits
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        x = wide.view("<i4").ravel() / float(1 << 31)
    else:
        x = (np.frombuffer(raw, {1: np.uint8, 2: "<i2", 4: "<i4"}[header.width]).astype(np.int64) - (128 if header.width == 1 else 0)) / float(1 << (8 * header.width - 1))
    return x.reshape(-1, header.channels).T


def encoded(x: np.ndarray, bits: int) -> bytes:
    """Interleaved PCM of [channels, n]."""
    width, top = bits // 8, float(1 << (bits - 1))
    whole = np.clip(np.round(np.nan_to_num(x.T.reshape(-1)) * top), -top, top - 1).astype("<i4") + (128 if width == 1 else 0)
    return whole.view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def made_header(n: int, channels: int, rate: int, bits: int) -> bytes:
    """The bytes before the samples; beyond 4 GB in the 64-bit form."""
    block, size = channels * bits // 8, n * channels * bits // 8
    form = b"fmt " + struct.pack("<IHHIIHH", 16, PCM, channels, rate, rate * block, block, bits)
    if size + 36 < UNKNOWN_SIZE:
        return b"RIFF" + struct.pack("<I", 36 + size + size % 2) + b"WAVE" + form + b"data" + struct.pack("<I", size)
    sizes = b"ds64" + struct.pack("<IQQQI", 28, 72 + size + size % 2, size, n, 0)
    return b"RF64" + struct.pack("<I", UNKNOWN_SIZE) + b"WAVE" + sizes + form + b"data" + struct.pack("<I", UNKNOWN_SIZE)


@dataclass
class Ranges(InputPartition):
    """Ranges of files: (path, size, first byte, byte after the last)."""

    ranges: list[tuple[str, int, int, int]]


class WavReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.split = options["path"], int(options.get("split", SPLIT))
        self.rate, self.chunk = int(options.get("rate") or 0), int(options.get("chunk", chunk_form.SIZE))

    def partitions(self) -> list[Ranges]:
        where, path = opened(self.folder)
        files = [(f.path, f.size) for f in below(where, path, "wav")]
        ranges = [((name, size, lo, min(size, lo + self.split)), min(size, lo + self.split) - lo) for name, size in files for lo in range(0, size, self.split)]
        return [Ranges(x) for x in dealt(ranges, self.split)]

    def read(self, partition: Ranges | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's one part of a source without parts
            return
        where, _ = opened(self.folder)
        held, n = [], 0
        for row in self._rows(where, partition):
            held.append(row)
            n += len(row[-1])
            if n >= BATCH or len(held) >= BATCH_ROWS:
                yield _batch(held)
                held, n = [], 0
        if held:
            yield _batch(held)

    def _rows(self, where: fs.FileSystem, partition: Ranges) -> Iterator[tuple]:
        for path, size, lo, hi in partition.ranges:
            with where.open_input_file(path) as file:
                try:
                    header = header_of(file, size)
                except ValueError as e:
                    raise ValueError(f"{path}: {e}") from e
                yield from self._chunks(file, path, header, lo, hi)

    def _chunks(self, file, path: str, header: Header, lo: int, hi: int) -> Iterator[tuple]:
        rate = self.rate or header.rate
        same = rate == header.rate
        total = header.n if same else resampled_length(header.n, header.rate, rate)

        def place(k: int) -> int:
            """The file's byte with which chunk k begins; the header goes with the first."""
            return header.data + k * self.chunk * header.rate // rate * header.block if k else 0

        k = 0 if lo == 0 else max(0, (lo - header.data) * rate // (self.chunk * header.block * header.rate) - 1)
        while place(k) < lo:
            k += 1
        while place(k) < hi and (k * self.chunk < total or k == 0):
            first, last = k * self.chunk, min(total, (k + 1) * self.chunk)
            a, b = (first, last) if same or first >= last else needed(first, last, header.rate, rate)
            a, b = max(0, a), min(header.n, b)
            file.seek(header.data + a * header.block)
            x = decoded(file.read(max(0, b - a) * header.block), header)
            if not same and first < last:
                x = np.stack([resampled_range(c, a, header.n, first, last, header.rate, rate) for c in x])
            for ch, samples in enumerate([x[0], x[0]] if len(x) == 1 else x):
                yield path, ch, k, first, rate, samples
            k += 1


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    *plain, samples = zip(*rows, strict=True)
    offsets = np.cumsum([0, *map(len, samples)]).astype(np.int32)
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
    columns = [pa.array(x, kind) for x, kind in zip(plain, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(samples)))], names=[c.split()[0] for c in SCHEMA.split(", ")])


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: where they are and the names that they get."""

    files: list[tuple[str, str]]


class WavWriter(DataSourceArrowWriter):
    """Rows (path, ch, start, n, channels, samples) in the order of path, start and channel."""

    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.rate, self.bits, self.overwrite = options["path"], int(options["rate"]), int(options.get("bits", 16)), overwrite
        if self.bits not in (8, 16, 24, 32):
            raise ValueError("bits are 8, 16, 24 or 32")
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, folder = opened(self.folder)
        own, done = join(folder, self.staging, uuid.uuid4().hex), []
        where.create_dir(own, recursive=True)
        stream, held, name, upto, n, channels = None, [], None, 0, 0, 0
        try:
            for row in (r for batch in iterator for r in _rows(batch)):
                if row["path"] != name:
                    if stream is not None:
                        _closed(stream, held, name, upto, n, self.bits, channels)
                    name, n, channels, upto, held = row["path"], row["n"], row["channels"], 0, []
                    if any(p in ("", ".", "..") for p in name.split("/")):
                        raise ValueError(f"{name!r} is no path below the folder")
                    done.append((join(own, f"{len(done)}.wav"), join(folder, name)))
                    stream = where.open_output_stream(done[-1][0])
                    stream.write(made_header(n, channels, self.rate, self.bits))
                if row["start"] != upto or held and len(held[0]) != len(row["samples"]):
                    raise ValueError(f"{name}: its channels or chunks don't fit together at sample {upto}")
                held.append(row["samples"])
                if len(held) == channels:
                    stream.write(encoded(np.stack(held), self.bits))
                    upto, held = upto + len(held[0]), []
            if stream is not None:
                _closed(stream, held, name, upto, n, self.bits, channels)
        except BaseException:
            if stream is not None and not stream.closed:
                stream.close()
            raise
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        where, folder = opened(self.folder)
        files = [f for m in messages if m is not None for f in m.files]
        names = {to for _, to in files}
        if len(names) < len(files):
            self.abort(messages)
            raise ValueError("a file was written by two tasks: rows must be dealt by path")
        for parent in sorted({dirname(to) for to in names}):
            where.create_dir(parent, recursive=True)
        in_threads(lambda f: where.move(*f), files)
        self.abort(messages)
        if self.overwrite:
            for f in where.get_file_info(fs.FileSelector(folder, recursive=True)):
                if f.is_file and f.extension.lower() == "wav" and f.path not in names and f"/_staging-" not in f.path:
                    where.delete_file(f.path)

    def abort(self, messages: list[Written | None]) -> None:
        where, folder = opened(self.folder)
        if where.get_file_info(at := join(folder, self.staging)).type == fs.FileType.Directory:
            where.delete_dir(at)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    plain = batch.drop_columns(["samples"]).to_pylist()
    for row, samples in zip(plain, batch.column("samples"), strict=True):
        x = np.zeros(0) if not samples.is_valid else samples.values.fill_null(0.0).to_numpy(zero_copy_only=False)
        yield row | {"samples": x}


def _closed(stream, held: list, name: str, upto: int, n: int, bits: int, channels: int) -> None:
    if held or upto != n:
        raise ValueError(f"{name}: {upto} of {n} samples are there for every channel")
    if n * channels * bits // 8 % 2:
        stream.write(b"\0")  # parts of a file begin at even places
    stream.close()


class WavSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WavReader:
        return WavReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WavWriter:
        return WavWriter(dict(self.options), overwrite)


def read(spark: SparkSession, folder: str, rate: int | None = None, chunk: int = chunk_form.SIZE, split: int = SPLIT) -> DataFrame:
    """Chunk form of the WAV files below a folder (path, ch, chunk, start, rate, samples), resampled to `rate` if one is given."""
    spark.dataSource.register(WavSource)
    return spark.read.format(NAME).options(path=folder, rate=rate or 0, chunk=chunk, split=split).load()


def write(chunks: DataFrame, folder: str, rate: int, bits: int = 16, mode: str = "append", size: int = chunk_form.SIZE) -> None:
    """The .wav file of each path (below the folder) from chunk form: path, ch, chunk, samples."""
    chunks.sparkSession.dataSource.register(WavSource)
    known = chunks.groupBy("path").agg(F.max(chunk_form.end(size)).alias("n"), F.count_distinct("ch").cast("int").alias("channels"))
    rows = chunks.select("path", F.col("ch").cast("int").alias("ch"), (F.col("chunk") * F.lit(size).cast("long")).alias("start"), F.col("samples").cast("array<double>").alias("samples")).join(known, "path")
    ordered = rows.select("path", "ch", "start", "n", "channels", "samples").repartition("path").sortWithinPartitions("path", "start", "ch")
    ordered.write.format(NAME).mode(mode).options(path=folder, rate=rate, bits=bits).save()
