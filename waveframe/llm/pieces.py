"""SentencePiece encoding and decoding through a table of distinct chunks.

The vocabulary has no piece in which a white-space marker follows another character, so a text
falls into chunks (a run of markers and the characters up to the next marker) that the model
segments independently. Each task keeps a table from chunk to ids: the library segments a
distinct chunk once, and the ids of a text are its chunks' entries, joined by position. The
model's own check (`pieces_stay_within_chunks`) runs when it is loaded.

The table is of a task and bounded (`table_entries`), not of the whole corpus: a shuffle of all
word positions would move several times the input.

Defined results: null and empty texts have only the end id; any text round-trips as the
library's decode has it; null ids decode to an empty text; repeated rows count each; other
columns pass through untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import STEP_BYTES, steps

MARK = "▁"
#: Chunks of a text that begins with a marker; the first alternative is all that has a marker in front.
CHUNK = re.compile(f"[ {MARK}]+[^ {MARK}]*")
TABLE_ENTRIES = 200_000
#: Longer chunks are segmented each time and not kept.
KEPT_CHARS = 64


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def pieces_stay_within_chunks(model) -> bool:
    """No piece crosses into a marker, and the model neither changes nor drops white space."""
    crossing = any(re.search(f"[^{MARK}]{MARK}", model.id_to_piece(i)) for i in range(model.vocab_size()))
    probe = "a  b\t ｆ \n c "
    return not crossing and model.decode(model.encode(probe)) == probe


class ChunkTable:
    """From chunk to its ids as bytes of int32."""

    def __init__(self, model, entries: int = TABLE_ENTRIES):
        if not pieces_stay_within_chunks(model):
            raise ValueError("this model's pieces cross white-space markers or it rewrites text")
        self.model, self.entries, self.known = model, entries, {}
        self.lone = np.array([model.piece_to_id(MARK)], np.int32).tobytes()

    def _segment(self, chunks: list[str]) -> list[bytes]:
        # the model puts one marker before each text it is given, which stands for the chunk's first
        found = self.model.encode([c[1:] for c in chunks], num_threads=1)
        return [np.array(ids, np.int32).tobytes() if ids else self.lone for ids in found]

    def encode(self, texts: list[str], end: bytes) -> list[bytes]:
        split = [CHUNK.findall(" " + t) if t else [] for t in texts]
        new = set().union(*split).difference(self.known)
        rest: dict[str, bytes] = {}
        if new:
            new = sorted(new)
            long = [c for c in new if len(c) > KEPT_CHARS]
            short = [c for c in new if len(c) <= KEPT_CHARS]
            if len(self.known) + len(short) > self.entries:
                self.known.clear()
                short = sorted({c for chunks in split for c in chunks if len(c) <= KEPT_CHARS})
            self.known.update(zip(short, self._segment(short), strict=True))
            for c in long:
                rest[c] = self._segment([c])[0]
        if not rest:
            get = self.known.__getitem__
            return [b"".join(map(get, chunks)) + end for chunks in split]
        return [b"".join(rest[c] if c in rest else self.known[c] for c in chunks) + end for chunks in split]


def decoded_texts(model, lists: pa.Array) -> pa.Array:
    return pa.array(model.decode([x or [] for x in lists.to_pylist()], num_threads=1), pa.string())


def encode(
    docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids", add_end: bool = True, table_entries: int = TABLE_ENTRIES, decoded: str | None = None
) -> DataFrame:
    """docs with `ids array<int>`: the whole text's ids, then the end id; columns of that name are replaced.

    With `decoded`, also a column of that name with the library's decode of the ids, made in the same task:
    a second pass of `decode` would hold another worker with another model for each core.
    """
    path = path or model_path()
    kept = [c for c in docs.columns if c not in (ids, decoded)]
    more = [decoded] if decoded else []
    out = T.StructType([*[docs.schema[c] for c in kept], T.StructField(ids, T.ArrayType(T.IntegerType())), *[T.StructField(c, T.StringType()) for c in more]])
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        table = ChunkTable(model, table_entries)
        end = np.array([model.eos_id()] if add_end else [], np.int32).tobytes()
        for batch in batches:
            for lo, hi, part in steps(batch.column(at), STEP_BYTES // 2):
                found = table.encode(part.to_pylist(), end)
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
                values = np.frombuffer(b"".join(found), np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
                both = [lists, decoded_texts(model, lists)] if decoded else [lists]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, *both], names=[*kept, ids, *more])

    return docs.select(*kept).mapInArrow(run, out)


def decode(rows: DataFrame, path: str | None = None, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """rows with `decoded string`: the library's decode of the ids. The column `decoded` is replaced if there is one."""
    path = path or model_path()
    kept = [c for c in rows.columns if c != decoded]
    out = T.StructType([*[rows.schema[c] for c in kept], T.StructField(decoded, T.StringType())])
    at = kept.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            column = batch.column(at)
            lengths = np.asarray(column.value_lengths().fill_null(0))
            groups = np.cumsum(lengths) // (STEP_BYTES // 4)
            lo = 0
            while lo < len(lengths):
                hi = max(lo + 1, int(np.searchsorted(groups, groups[lo], side="right")))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, decoded_texts(model, column.slice(lo, hi - lo))], names=[*kept, decoded])
                lo = hi

    return rows.select(*kept).mapInArrow(run, out)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    both = encode(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), path, decoded="decoded")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
