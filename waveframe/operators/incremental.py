"""Work that is still to be done: anti-joins on what exists, freshness, eligibility."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

MOST_MODELS = 1000


def todo(expected: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(existing.select(*keys), keys, "left_anti")


def paired(a: DataFrame, b: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that both inputs have and the output lacks."""
    return a.join(b.select(*keys), keys, "left_semi").join(done.select(*keys), keys, "left_anti")


def all_done(expected: DataFrame, existing: DataFrame, group: list[str], keys: list[str]) -> DataFrame:
    """group, done: whether each group's expected keys all exist."""
    found = existing.select(*keys).distinct().withColumn("there", F.lit(True))
    return expected.join(found, keys, "left").groupBy(*group).agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("done"))


def expand(files: DataFrame, models: DataFrame, present: DataFrame, model: str) -> DataFrame:
    """Every file with every model that is there. The models, a few rows, become one array that each file is exploded with;
    more than MOST_MODELS raise an error."""
    there = models.join(present.select(model), model, "left_semi")
    rows = there.limit(MOST_MODELS + 1).collect()
    if len(rows) > MOST_MODELS:
        raise ValueError(f"more than {MOST_MODELS} models")
    kind = there.schema.simpleString()
    each = F.from_json(F.lit(json.dumps([r.asDict() for r in rows], default=str)), f"array<{kind}>")
    return files.withColumn("_model", F.explode(each)).select(*files.columns, "_model.*").select(model, *files.columns, *[c for c in there.columns if c != model])


def freshness(sources: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """keys, state: missing, stale (older than its source) or fresh. Both have mtime."""
    made = targets.select(*keys, F.col("mtime").alias("made"))
    state = F.when(F.col("made").isNull(), "missing").when(F.col("made") < F.col("mtime"), "stale").otherwise("fresh")
    return sources.join(made, keys, "left").select(*keys, state.alias("state"))


def eligible(variants: DataFrame, assets: DataFrame, keys: list[str], target: float) -> DataFrame:
    """Instrumentals that are done, exist and are not at the target level yet, with the description they get."""
    open_ = variants.where((F.col("stem") == "Instrumental") & (F.col("status") == "done") & ~F.coalesce(F.col("normalized_dbfs") == target, F.lit(False)))
    suffix = f" · normalized to {target:g} dBFS peak"
    text = F.when(F.lower("description").contains("normaliz"), F.col("description")).otherwise(F.concat("description", F.lit(suffix)))
    return open_.join(assets.select(*keys), keys, "left_semi").withColumn("description", text).withColumn("normalized_dbfs", F.lit(target))


def stream_plan(variants: DataFrame, assets: DataFrame) -> DataFrame:
    """slug, id, stream (what it should be), encode (whether it must be made), changed (whether the record must be).

    variants: slug, id, output, stream. assets: slug, rel, mtime. A WAV streams as an encoded file beside
    it, made anew if missing or older; other outputs stream as they are. Outputs that don't exist are left out.
    """
    wav = F.lower("output").endswith(".wav")
    target = F.when(wav, F.concat(F.expr("left(output, char_length(output) - 4)"), F.lit(".m4a"))).otherwise(F.col("output"))
    source = assets.select("slug", F.col("rel").alias("output"), F.col("mtime").alias("source_time"))
    made = assets.select("slug", F.col("rel").alias("target"), F.col("mtime").alias("made_time"))
    rows = variants.select("slug", "id", "output", F.col("stream").alias("before"), target.alias("target"), wav.alias("wav")).join(source, ["slug", "output"]).join(made, ["slug", "target"], "left")
    encode = F.col("wav") & (F.col("made_time").isNull() | (F.col("made_time") < F.col("source_time")))
    return rows.select("slug", "id", F.col("target").alias("stream"), encode.alias("encode"), (~F.col("before").eqNullSafe(F.col("target"))).alias("changed"))


def one_shot(stems: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, action: what is made of a file's stems; two or more are merged, one is copied."""
    n = F.count_if(F.col("stem").isNotNull())
    return stems.groupBy(*keys).agg(n.alias("n")).withColumn("action", F.when(F.col("n") >= 2, "ensemble").when(F.col("n") == 1, "copy").otherwise("nothing"))


def counted(rows: DataFrame, **conditions: Column) -> tuple[DataFrame, Observation]:
    """rows, and an observation that has `processed` and the number of rows of each condition once rows are read."""
    seen = Observation()
    return rows.observe(seen, F.count("*").alias("processed"), *[F.count_if(c).alias(name) for name, c in conditions.items()]), seen


def present_models(models: DataFrame, files: DataFrame, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """The configured models (column file) whose file is in the listing (column path); with suffixes, of those endings only."""
    names = files.select(F.substring_index("path", "/", -1).alias("file")).distinct()
    kept = models.where(F.lower(F.regexp_extract("file", r"(\.[^.]*)$", 1)).isin(list(suffixes))) if suffixes else models
    return kept.join(names, "file", "left_semi")
