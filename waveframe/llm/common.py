"""Helpers that the corpus operators share: tables between stages, text columns, word hashes."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only where a local session names no shared folder, as in tests.
LOCAL_SHARED_DIR = "/tmp/checkpoints"
#: Bytes of text that one numpy step handles; a longer text is a step of its own.
STEP_BYTES = 1 << 20
#: Paths of the tables written so far by the operators that run, the innermost last.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a cluster must set it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not found and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return found or LOCAL_SHARED_DIR


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors.

    Within a `scoped` operator it is deleted when the operator is done; else the folder's owner
    clears it when the application is over, as with checkpoints.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/waveframe-{uuid.uuid4().hex}"
    if scopes := _SCOPES.get():
        scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def scoped(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The operator with its result written, and all other tables that it wrote deleted after that."""

    @wraps(operator)
    def run(*args, **kwargs) -> DataFrame:
        own: list[str] = []
        outer = _SCOPES.get()
        token = _SCOPES.set((*outer, own))
        try:
            result = written(operator(*args, **kwargs))
        finally:
            _SCOPES.reset(token)
        deleted(result.sparkSession, own[:-1])
        if outer:
            outer[-1].append(own[-1])
        return result

    return run


#: Rows of ids and numbers (a few tens of bytes each) that a broadcast may hold.
BROADCAST_ROWS = 300_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, broadcast in joins if it has `most` rows at most; it is counted first, so it should be a written table."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(df: DataFrame, column: str = "text"):
    """The text column with null read as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def steps(column: pa.Array, limit: int = STEP_BYTES):
    """Cut an Arrow string column into runs of rows with about `limit` bytes each, in order.

    After the last one, memory that Arrow holds but doesn't use goes back: workers live on between tasks.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset :]
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to, column.slice(at, to - at)
        at = to
    pa.default_memory_pool().release_unused()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of a large_string array without nulls."""
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Python's white space within ASCII.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: All but ASCII letters and the bytes of other scripts.
NOT_LETTERS = np.ones(256, bool)
NOT_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _BASE)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = len(_POWERS["up"])
    if size < n or size > 4 * max(n, STEP_BYTES):  # a very long text's table isn't kept
        for name, by in (("up", _BASE), ("down", _INVERSE)):
            full = np.full(max(n, 2), by, np.uint64)
            full[0] = 1
            _POWERS[name] = np.multiply.accumulate(full)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES, beginnings: tuple[int, ...] = ()):
    """64-bit hash of every word of every row, and each row's offset into them.

    A rolling polynomial over bytes, so no word becomes a Python object. With `beginnings`, also
    a list of (numbers of the words with more bytes than that, hashes of so many first bytes).
    """
    n = len(data)
    if not n:
        empty = np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
        return (*empty, []) if beginnings else empty
    gap = separators[data]
    filled = offsets[:-1] < offsets[1:]
    before = np.empty(n, bool)
    before[0], before[1:] = True, gap[:-1]
    before[offsets[:-1][filled]] = True
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, gap[1:]
    after[offsets[1:][filled] - 1] = True
    starts = np.flatnonzero(~gap & before)
    ends = np.flatnonzero(~gap & after) + 1
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts])
    rows = np.searchsorted(starts, offsets)
    if not beginnings:
        return hashes, rows
    parts = []
    for size in beginnings:
        longer = np.flatnonzero(ends - starts > size)
        own = starts[longer]
        parts.append((longer, mixed((sums[own + size] - sums[own]) * down[own] + np.uint64(size))))
    return hashes, rows, parts


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, size: int = 5):
    """Hashes of all runs of `size` words of every row; a shorter row that has words is one run."""
    counts = np.diff(offsets)
    runs = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    out_offsets = np.concatenate([[0], np.cumsum(runs)])
    if not len(words):
        return np.zeros(0, np.uint64), out_offsets
    padded = np.concatenate([words, np.zeros(size - 1, np.uint64)])
    rolled = np.zeros(len(words), np.uint64)
    row = np.repeat(np.arange(len(counts)), counts)
    left = offsets[1:][row] - np.arange(len(words))  # words from here to the row's end
    for k in range(size):
        part = padded[k : k + len(words)] * np.uint64(2 * k + 3)
        rolled = rolled * np.uint64(0x100000001B3) + np.where(left > k, part, np.uint64(0))
    place = np.arange(len(words)) - offsets[:-1][row]
    return mixed(rolled[place < runs[row]]), out_offsets
