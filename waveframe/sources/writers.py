"""Sinks: manifests, index, jobs, peaks, WAV files as rows.

Jobs, the index and the manifest table are versions (snapshots): a reader sees the old rows or the new ones.
Folders of manifests and of peaks are overwritten by Spark, which deletes the old files first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import snapshots
from .readers import wav_header


def write_manifests(variants: DataFrame, folder: str) -> None:
    """One folder of JSON lines a slug, each slug's records in order of position; only the slugs written are replaced.
    A write that fails can leave such a slug without records; write_manifest_table can't."""
    rows = variants.repartition("slug").sortWithinPartitions("slug", "position").drop("position")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slug").json(folder)


def write_manifest_table(variants: DataFrame, folder: str, buckets: int = snapshots.BUCKETS) -> None:
    """Records of all slugs as one versioned table: those of the slugs written replace these slugs' old ones, at once."""
    snapshots.merge(variants, folder, ["slug"], kind="json", buckets=buckets)


def index_document(files: DataFrame, generated: int) -> DataFrame:
    """The index as one JSON string: generated, count, files by slug. It is one document by its format."""
    each = F.array_sort(F.collect_list(F.struct("slug", *[c for c in files.columns if c != "slug"])))
    return files.agg(F.to_json(F.struct(F.lit(generated).alias("generated"), F.count("*").alias("count"), each.alias("files"))).alias("value"))


def write_index(files: DataFrame, folder: str, generated: int) -> None:
    """The document as the next version."""
    snapshots.commit(index_document(files, generated), folder, kind="text")


def write_index_table(files: DataFrame, folder: str, generated: int) -> None:
    """The index for a library of any size: one JSON line a file in ranges of slug, as the next version."""
    snapshots.commit(files.orderBy("slug"), folder, kind="json", about={"generated": generated})


def write_jobs(jobs: DataFrame, folder: str) -> None:
    """Jobs as JSON lines, the next version: a reader sees the old table or the new one."""
    snapshots.commit(jobs, folder, kind="json")


def write_peaks(envelope: DataFrame, keys: list[str], folder: str) -> None:
    """min and max arrays, one JSON line for each key. An envelope has fewer than 3,200 buckets."""
    pairs = F.array_sort(F.collect_list(F.struct("bucket", "lo", "hi")))
    rows = envelope.groupBy(*keys).agg(pairs.alias("p")).select(*keys, F.transform("p", lambda x: x["lo"]).alias("min"), F.transform("p", lambda x: x["hi"]).alias("max"))
    rows.write.mode("overwrite").partitionBy(*keys).json(folder)


def encode_wav(x: np.ndarray, rate: int, bits: int = 16) -> bytes:
    """PCM of [channels, n] in -1 to 1."""
    width, top = bits // 8, float(1 << (bits - 1))
    whole = np.clip(np.round(x.T.reshape(-1) * top), -top, top - 1).astype("<i4") + (128 if width == 1 else 0)  # eight bits are unsigned
    raw = whole.view(np.uint8).reshape(-1, 4)[:, :width].tobytes()
    return wav_header(x.shape[1], x.shape[0], rate, width) + raw


def wav_bytes(frames: DataFrame, rate: int, bits: int = 16) -> DataFrame:
    """path, content: the WAV file of each path. frames: path, ch, start, samples. A file is one group, as its format asks."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ch", "start"])
        x = np.stack([np.concatenate(g["samples"].to_list()) for _, g in rows.groupby("ch", sort=True)])
        return pd.DataFrame({"path": [rows["path"].iloc[0]], "content": [encode_wav(x, rate, bits)]})

    return frames.select("path", "ch", "start", "samples").groupBy("path").applyInPandas(run, "path string, content binary")


def write_wav(frames: DataFrame, folder: str, rate: int, bits: int = 16) -> None:
    """WAV files as rows (path, content) of a Parquet table: Spark has no sink for loose binary files."""
    wav_bytes(frames, rate, bits).write.mode("overwrite").parquet(folder)
