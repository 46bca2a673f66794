"""Readers: file listings, manifests, index, peaks, jobs, PCM WAV. All are lazy DataFrames."""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.spectral import resampled
from . import schemas, snapshots


def listing(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """path, size, mtime of a folder's files; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def explicit(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, size, mtime of the files named, as often as they are named and whatever they are; those that don't exist are left out."""
    def there(path: str) -> bool:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)

    found = [p for p in paths if there(p)]
    if not found:
        return spark.createDataFrame([], "path string, size long, mtime timestamp")
    files = spark.read.format("binaryFile").load(found)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def assets(spark: SparkSession, library: str) -> DataFrame:
    """slug, rel, size, mtime of the files below a library's slug folders."""
    below = F.substring_index(F.col("path"), library.rstrip("/").split("://")[-1].rstrip("/") + "/", -1)
    rows = listing(spark, library).withColumn("below", below).where(F.contains("below", F.lit("/")))
    slug = F.substring_index("below", "/", 1)
    return rows.select(slug.alias("slug"), F.substr("below", F.char_length(slug) + 2).alias("rel"), "size", "mtime")


def inputs(column: Column) -> Column:
    """The `input` field, a string or an array of strings, as an array."""
    return F.when(column.startswith("["), F.from_json(column, "array<string>")).when(column.isNotNull(), F.array(column))


def parse_manifest(lines: DataFrame, mode: str = "last", extra: tuple[str, ...] = ("slug",)) -> DataFrame:
    """Records of JSON lines (columns of `extra`, line_no, line).

    mode `last`: bad lines are skipped, the last line of an id wins at its first position.
    mode `all`: bad lines and empty ids are skipped, every other line is kept.
    mode `strict`: a bad line fails the query when it is read.
    """
    blank = F.trim("line") == ""
    parsed = lines.where(~blank).withColumn("record", F.from_json("line", f"{schemas.VARIANT}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("record").isNull() | F.col("record._corrupt").isNotNull() | F.col("record.id").isNull()
    if mode == "strict":
        checked = F.when(bad, F.raise_error(F.concat(F.lit("bad manifest line: "), F.col("line")))).otherwise(F.col("record"))
        good = parsed.withColumn("record", checked)
    else:
        good = parsed.where(~bad & (F.col("record.id") != "") if mode == "all" else ~bad)
    rows = good.select(*extra, "line_no", "record.*").drop("_corrupt").withColumn("inputs", inputs(F.col("input"))).drop("input")
    if mode == "all":
        return rows.withColumnRenamed("line_no", "position")
    values = [c for c in rows.columns if c not in (*extra, "line_no", "id")]
    last = rows.groupBy(*extra, "id").agg(F.max_by(F.struct(*values), "line_no").alias("last"), F.min("line_no").alias("position"))
    return last.select(*extra, "position", "id", "last.*")


def manifests(spark: SparkSession, library: str, mode: str = "last", name: str = "manifest.jsonl") -> DataFrame:
    """Records of all manifests of a library, one JSON object a line, with their slug: the folder's name.

    With the name `part-*` it reads what writers.write_manifests has written (folders slug=...).
    """
    files = spark.read.option("recursiveFileLookup", "true").text(f"{library.rstrip('/')}/*/{name}", wholetext=True)
    folder = X.percent_decode(F.regexp_replace(F.element_at(F.split(F.col("path"), "/"), -2), "^slug=", ""))
    # a manifest is a file's few variants, so it is read whole for the numbers of its lines
    each = files.select(X.percent_decode(F.col("_metadata.file_path")).alias("path"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    return parse_manifest(each.select(folder.alias("slug"), F.col("line_no").cast("long").alias("line_no"), "line"), mode)


def index(spark: SparkSession, path: str) -> DataFrame:
    """The index's files, of a document or of what writers.write_index left; none if it is missing or no object."""
    if found := snapshots.current(spark, path):
        path = f"{path.rstrip('/')}/{found['folders']['']}"
    try:
        whole = spark.read.schema(f"{schemas.INDEX}, _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schemas.FILE)
    return whole.select(F.explode("files").alias("f")).select("f.*")


def peaks(spark: SparkSession, glob: str) -> DataFrame:
    """path, bucket, lo, hi of peaks files that have both arrays."""
    rows = spark.read.schema(schemas.PEAKS).option("multiLine", True).json(glob)
    both = rows.where(F.col("min").isNotNull() & F.col("max").isNotNull())
    return both.select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.arrays_zip("min", "max")).alias("bucket", "z")).select("path", "bucket", F.col("z.min").alias("lo"), F.col("z.max").alias("hi"))


def index_table(spark: SparkSession, folder: str) -> DataFrame:
    """The index's files as writers.write_index_table leaves them, one JSON line each."""
    return snapshots.read(spark, folder, schemas.FILE)


def index_summary(spark: SparkSession, folder: str) -> dict:
    """When the index table was generated, and its files' count."""
    found = snapshots.current(spark, folder)
    return {"generated": found["about"]["generated"], "count": index_table(spark, folder).count()} if found else {}


def manifest_table(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all slugs as writers.write_manifest_table leaves them."""
    return snapshots.read(spark, folder, f"slug string, position long, {schemas.VARIANT}").withColumn("inputs", inputs(F.col("input"))).drop("input")


def jobs(spark: SparkSession, path: str) -> DataFrame:
    """Jobs as writers.write_jobs leaves them, one JSON line each; none if there are none yet."""
    return snapshots.read(spark, path, schemas.JOB)


def decode_wav(content: bytes) -> tuple[np.ndarray, int]:
    """[channels, n] in -1 to 1 and the rate, of PCM with 8, 16, 24 or 32 bits."""
    with wave.open(io.BytesIO(content)) as w:
        raw, width, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    if width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000
    else:
        x = np.frombuffer(raw, {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(np.int64) - (128 if width == 1 else 0)
    return (x / float(1 << (8 * width - 1))).reshape(-1, channels).T, rate


def wav_frames(spark: SparkSession, folder: str, rate: int | None = None, chunk: int = 1 << 20) -> DataFrame:
    """path, ch, chunk, start, rate, samples of all WAV files; mono is doubled; files of another rate than asked for are resampled."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[wW][aA][vV]").load(folder)
    return frames_of(files, rate, chunk)


def frames_of(files: DataFrame, rate: int | None = None, chunk: int = 1 << 20) -> DataFrame:
    """The same of WAV files that are rows (path, content)."""
    names = ["path", "ch", "chunk", "start", "rate", "samples"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x, own = decode_wav(content.as_py())
                x = np.vstack([x, x]) if len(x) == 1 else x
                if rate is not None and own != rate:
                    x, own = np.stack([resampled(c, own, rate) for c in x]), rate
                for ch, samples in enumerate(x):
                    for k in range(0, max(1, len(samples)), chunk):
                        part = samples[k : k + chunk]
                        lists = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.array(part))
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([ch], pa.int32()), pa.array([k // chunk], pa.int32()), pa.array([k], pa.int64()), pa.array([own], pa.int32()), lists], names=names)

    return files.select("path", "content").mapInArrow(run, "path string, ch int, chunk int, start long, rate int, samples array<double>")


def long_form(frames: DataFrame) -> DataFrame:
    """One row a sample: path, ch, i, v."""
    return frames.select("path", "ch", "start", F.posexplode("samples").alias("at", "v")).select("path", "ch", (F.col("start") + F.col("at")).alias("i"), "v")


def wav_header(frames: int, channels: int, rate: int, width: int) -> bytes:
    size = frames * channels * width
    return b"RIFF" + struct.pack("<I", 36 + size) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * channels * width, channels * width, 8 * width) + b"data" + struct.pack("<I", size)
