"""The extension point for source separation and cleanup models, which are not part of this engine."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Separator(Protocol):
    """A model. It is made once in each task by a factory, then called for every signal."""

    def separate(self, samples: np.ndarray) -> dict[str, np.ndarray]:
        """Stems by name, each as long as the samples."""


def separate(frames: DataFrame, factory: Callable[[], Separator], tag: str) -> DataFrame:
    """slug, id (tag_stem), ch, samples of every stem. frames: slug, ch, samples (array of float or double)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1)
                for stem, v in model.separate(row.column(2).flatten().to_numpy().astype(float)).items():
                    lists = pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v))
                    yield pa.RecordBatch.from_arrays([row.column(0), pa.array([f"{tag}_{stem}"]), row.column(1), lists], names=["slug", "id", "ch", "samples"])

    return frames.select("slug", F.col("ch").cast("int").alias("ch"), F.col("samples").cast("array<double>").alias("samples")).mapInArrow(run, "slug string, id string, ch int, samples array<double>")
