"""The tokenization automaton against plain merging and against the library."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from waveframe.llm import bpe

TEXTS = [
    None, "", " ", " \n\t ", "a", "Hello, WORLD's 123 don't they'll", "x" * 5000 + " y", "\x00 a\x1c\x1fb", "é e\u0301 \u0301a ＡＢ ﬁ İ Σας ß ẞ", "日本語のテキスト 한국어 русский Ελληνικά",
    "a<|endoftext|>b <|startoftext|><|ENDOFTEXT|> <|endoftext", "😀👍🏽 é😀", "\u2000a\u2028b\u3000c\xa0d\x85e", "naïve Ärger ÀÖØÞßöøÿ×÷ªº", "''s 's't 'LL '", "１２３ ½ ²", "aaaaaaaaaaaaaaaaaaaaa " * 50,
]
LIBRARY = Tokenizer.from_file(bpe.model_path())
ENCODER = bpe.Encoder(bpe.model_path(), entries=50)


def want(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def ints(found: bytes) -> list[int]:
    return [int.from_bytes(found[i : i + 4], "little") for i in range(0, len(found), 4)]


def merged(word: str, merges: list[tuple[str, str]]) -> list[str]:
    """Each merge in its order, from left to right."""
    parts = list(word)
    for a, b in merges:
        out, k = [], 0
        while k < len(parts):
            pair = parts[k : k + 2] == [a, b]
            out.append(a + b if pair else parts[k])
            k += 1 + pair
        parts = out
    return parts


@st.composite
def merge_lists(draw):
    tokens, merges = ["a", "b", "c"], []
    for _ in range(draw(st.integers(0, 12))):
        a, b = draw(st.sampled_from(tokens)), draw(st.sampled_from(tokens))
        # trained lists: a merge makes a new token, and of tokens that meet
        if a + b not in tokens and merged(a + b, merges) == [a, b]:
            merges.append((a, b))
            tokens.append(a + b)
    return merges


@settings(max_examples=300, deadline=None)
@given(merge_lists(), st.lists(st.text(alphabet="abc", min_size=1, max_size=14), max_size=8))
def test_paths_equal_plain_merging(merges, words):
    automaton = bpe.Automaton("abc", merges)
    for word in words:
        assert automaton.path(word) == merged(word, merges)


@settings(max_examples=100, deadline=None)
@given(merge_lists(), st.lists(st.sampled_from(range(15)), min_size=1, max_size=5))
def test_accepts_tokenizations_only(merges, picks):
    automaton = bpe.Automaton("abc", merges)
    tokens = list(automaton.made)
    path = [tokens[k % len(tokens)] for k in picks]
    accepted = all(automaton.has_arc(a, b) for a, b in zip([None, *path], path))
    assert accepted == (merged("".join(path), merges) == path)


def test_merges_that_no_training_makes_are_refused():
    for merges in ([("ab", "c")], [("a", "b"), ("a", "b")], [("a", "b"), ("b", "c"), ("ab", "c"), ("a", "bc")], [("a", "a"), ("a", "aa")]):
        with pytest.raises(ValueError):
            bpe.Automaton("abc", merges)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="abEé\u0301ßİ \n'sт1½.😀<|endoftext>\u2028\x1c"), max_size=4))
def test_encoder_matches_the_library(texts):
    assert [ints(x) for x in ENCODER.encode(texts)] == [want(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_encoder_matches_the_library_on_any_text(text):
    assert ints(ENCODER.encode([text])[0]) == want(text)


def test_digests_match_the_library(spark):
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r for r in bpe.digests(docs).collect()}
    for i, t in enumerate(TEXTS):
        ids = want(t)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_whole_table(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    ids = {r["doc_id"]: r["ids"] for r in bpe.encode(docs).select("doc_id", "ids").collect()}
    assert all(ids[r["doc_id"]] == want(r["text"]) for r in docs.collect())


def test_decode_in_the_same_task_equals_decode(spark):
    docs = spark.createDataFrame([(i % 9, t, "k", "k") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string, decoded string")
    once = bpe.encode(docs, decoded="decoded")
    assert once.columns == ["doc_id", "text", "ids", "decoded"]
    twice = bpe.decode(bpe.encode(docs.drop("decoded"))).select(*once.columns)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def test_decode_of_null_and_unknown_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [320, 60000, -1, None])], "k int, ids array<int>")
    assert {r["k"]: r["decoded"] for r in bpe.decode(rows).collect()} == {1: "", 2: "", 3: LIBRARY.decode([320], skip_special_tokens=False)}


def test_empty_table(spark):
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_file_that_keeps_spaces_is_encoded_as_a_whole():
    path = bpe.model_path("byte_bpe_50k.json")
    encoder, library = bpe.Encoder(path), Tokenizer.from_file(path)
    assert not encoder.chunked
    for text in ("Hello  world, it's\n 12", "", "naïve <|endoftext|> x"):
        ids = library.encode(text, add_special_tokens=False).ids
        assert ints(encoder.encode([text])[0]) == ids and encoder.decode(ids) == library.decode(ids, skip_special_tokens=False)
