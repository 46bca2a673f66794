"""Tables in versions: a pointer file names the folders of the current one, and one rename swaps it.

`commit` writes a whole new version; `merge` writes only the buckets that hold keys of the new rows and
takes over the others' folders from the version before. Readers go through the pointer, so
until the rename they see the old rows and after it the new ones; a write that fails halfway leaves folders that no pointer
names. Folders that only versions before the last `KEPT` name are deleted after the swap, so a reader that
began in the version before can end.

Rows are plain files of a Spark format; the pointer is a JSON object with a folder for each bucket (a table has as many
as its first version was given, so the pointer stays small). There is one writer at a time: a commit that
finds another version than it began with fails. The rename replaces the pointer at once on HDFS and on local and mounted folders.

Defined results: a root without a pointer is a table that was never written: it reads as empty with the schema asked for;
an empty table can be written and read; a merge of no rows is a version without changes; of new rows with equal keys
the caller keeps one; null keys are keys; a merge with an epoch that is already there does nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTER = "CURRENT"
#: Versions whose folders stay: the current one and the one before.
KEPT = 2
BUCKETS = 64
BUCKET = "_bucket"


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def current(spark: SparkSession, root: str) -> dict | None:
    """What the pointer holds, or None if there is none."""
    files, at = _file_system(spark, f"{root.rstrip('/')}/{POINTER}")
    if not files.exists(at):
        return None
    stream = files.open(at)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _swap(spark: SparkSession, root: str, found: dict | None, new: dict) -> None:
    """Make `new` the pointer if it is still `found`."""
    now = current(spark, root)
    if (now or {}).get("id") != (found or {}).get("id"):
        raise RuntimeError(f"{root}: another writer has made version {(now or {}).get('version')}")
    files, made = _file_system(spark, f"{root.rstrip('/')}/.{POINTER}-{new['id']}")
    stream = files.create(made, True)
    stream.write(bytearray(json.dumps(new), "utf-8"))
    stream.close()
    jvm = spark._jvm.org.apache.hadoop.fs
    over = spark.sparkContext._gateway.new_array(getattr(jvm, "Options$Rename"), 1)
    over[0] = getattr(jvm, "Options$Rename").OVERWRITE
    jvm.FileContext.getFileContext(made.toUri(), spark._jsc.hadoopConfiguration()).rename(made, _file_system(spark, f"{root.rstrip('/')}/{POINTER}")[1], over)


def _cleared(spark: SparkSession, root: str, gone: set[str], kept: set[str]) -> None:
    for folder in gone - kept:
        files, at = _file_system(spark, f"{root.rstrip('/')}/{folder}")
        files.delete(at, True)


def _published(spark: SparkSession, root: str, found: dict | None, folders: dict[str, str], rest: dict) -> None:
    before = [(found or {}).get("folders", {}), *(found or {}).get("before", [])] if found else []
    new = rest | {"version": (found or {}).get("version", -1) + 1, "id": uuid.uuid4().hex, "folders": folders, "before": before[: KEPT - 1]}
    _swap(spark, root, found, new)
    named = {f for each in [folders, *new["before"]] for f in each.values()}
    _cleared(spark, root, {f for each in before[KEPT - 1 :] for f in each.values()}, named)


def _bucket(keys: list[str], n: int):
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def _bucketed(rows: DataFrame, root: str, folder: str, keys: list[str], n: int, kind: str) -> None:
    rows.withColumn(BUCKET, _bucket(keys, n)).repartition(BUCKET).sortWithinPartitions(BUCKET, *keys).write.partitionBy(BUCKET).format(kind).save(f"{root.rstrip('/')}/{folder}")


def commit(rows: DataFrame, root: str, keys: list[str] | None = None, kind: str = "parquet", buckets: int = BUCKETS, about: dict | None = None) -> None:
    """Make the rows the table's next version; with `keys` it is held in buckets, and merges can follow."""
    spark, folder = rows.sparkSession, f"data-{uuid.uuid4().hex}"
    found = current(spark, root)
    if keys:
        _bucketed(rows, root, folder, keys, buckets, kind)
        folders = {str(b): f"{folder}/{BUCKET}={b}" for b in _there(spark, root, folder)}
    else:
        rows.write.format(kind).save(f"{root.rstrip('/')}/{folder}")
        folders = {"": folder}
    _published(spark, root, found, folders, {"keys": keys, "kind": kind, "buckets": buckets if keys else 0, "schema": rows.schema.json(), "about": about or {}})


def _there(spark: SparkSession, root: str, folder: str) -> list[int]:
    """The buckets that a folder has."""
    files, at = _file_system(spark, f"{root.rstrip('/')}/{folder}")
    return sorted(int(s.getPath().getName().split("=")[1]) for s in files.listStatus(at) if s.getPath().getName().startswith(f"{BUCKET}="))


def merge(rows: DataFrame, root: str, keys: list[str], resolve: Callable[[DataFrame, DataFrame], DataFrame] | None = None, kind: str = "parquet", buckets: int = BUCKETS, epoch: int | None = None) -> None:
    """Bring the rows into the table: they replace all old rows with their keys, or what resolve(old rows of their buckets, rows) says stays.

    Only the buckets of the rows' keys are read and written.
    """
    spark, root = rows.sparkSession, root.rstrip("/")
    found = current(spark, root)
    if found and epoch is not None and found["about"].get("epoch", -1) >= epoch:
        return
    n = found["buckets"] if found else buckets
    if found and found["keys"] != keys:
        raise ValueError(f"{root} is held by {found['keys']}")
    # the rows are written once, so that what is merged is what their buckets were taken from
    came = f"new-{uuid.uuid4().hex}"
    rows.write.parquet(f"{root}/{came}")
    new = spark.read.schema(rows.schema).parquet(f"{root}/{came}")
    touched = sorted(r[0] for r in new.select(_bucket(keys, n)).distinct().collect())  # n numbers at most
    held = dict(found["folders"]) if found else {}
    old = _read(spark, root, found, rows.schema, [held[str(b)] for b in touched if str(b) in held])
    if resolve:
        merged = resolve(old, new).select(*rows.columns)
    else:
        gone = new.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
        same = None
        for k in keys:
            same = old[k].eqNullSafe(gone[f"_{k}"]) if same is None else same & old[k].eqNullSafe(gone[f"_{k}"])
        merged = old.join(gone, same, "left_anti").unionByName(new)
    folder = f"data-{uuid.uuid4().hex}"
    if touched:
        _bucketed(merged, root, folder, keys, n, found["kind"] if found else kind)
        made = set(_there(spark, root, folder))
        held = {b: f for b, f in held.items() if int(b) not in touched} | {str(b): f"{folder}/{BUCKET}={b}" for b in made}
    _published(spark, root, found, held, {"keys": keys, "kind": found["kind"] if found else kind, "buckets": n, "schema": rows.schema.json(), "about": (found or {"about": {}})["about"] | ({"epoch": epoch} if epoch is not None else {})})
    _cleared(spark, root, {came}, set())


def _read(spark: SparkSession, root: str, found: dict | None, schema: T.StructType, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(found["kind"]).load([f"{root.rstrip('/')}/{f}" for f in folders])


def read(spark: SparkSession, root: str, schema: T.StructType | str | None = None) -> DataFrame:
    """The current version's rows; of a table that was never written none, for which a schema must be given."""
    found = current(spark, root)
    if schema is None:
        if found is None:
            raise ValueError(f"{root} was never written")
        schema = T.StructType.fromJson(json.loads(found["schema"]))
    return _read(spark, root, found, schema, sorted(found["folders"].values()) if found else [])
