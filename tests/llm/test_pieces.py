"""SentencePiece ids and texts against the library itself."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from waveframe.llm import pieces

TEXTS = [None, "", " ", "  ", "▁", "a ▁ b", " \n ", "a  b ", "\t", "x" * 3000 + " y", "\x00 a", " " * 40 + "z", "a" + " " * 17 + "b", "ｆｕｌｌ ﬁ", "</s> <s>", "😀 é"]
MODEL = pieces.load(pieces.model_path())


def test_digests_match_the_library(spark):
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r for r in pieces.digests(docs).collect()}
    for i, t in enumerate(TEXTS):
        ids = MODEL.encode(t or "", add_eos=True)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(MODEL.decode(ids).encode()).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab ▁é\n😀.1"), max_size=4))
def test_chunk_table_matches_the_library(texts):
    table = pieces.ChunkTable(MODEL, entries=3)
    for found, want in zip(table.encode(texts, b""), MODEL.encode(texts), strict=True):
        assert [int.from_bytes(found[i : i + 4], "little") for i in range(0, len(found), 4)] == want


def test_whole_table(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    ids = {r["doc_id"]: r["ids"] for r in pieces.encode(docs).select("doc_id", "ids").collect()}
    assert all(ids[r["doc_id"]] == MODEL.encode(r["text"], add_eos=True) for r in docs.collect())


def test_empty(spark):
    assert pieces.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_decode_in_the_same_task_equals_decode(spark):
    docs = spark.createDataFrame([(i, t, "k", "k") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string, decoded string")
    once = pieces.encode(docs, decoded="decoded")
    assert once.columns == ["doc_id", "text", "ids", "decoded"]
    twice = pieces.decode(pieces.encode(docs.drop("decoded"))).select(*once.columns)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
