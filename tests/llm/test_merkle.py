"""Merkle fingerprints: equality, likeness, edits, order."""

from pyspark.sql import functions as F

from waveframe.llm import merkle


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, range int")


def test_equal_texts_alone_have_equal_fingerprints(spark):
    texts = ["", "a", "a\n", "a\nb", "a\n\nb", "a. b", "a.b", "a\n\n\nb", None, "a. "]
    got = [r["fingerprint"] for r in merkle.fingerprints(docs(spark, [(i, t, 0) for i, t in enumerate(texts)])).orderBy("doc_id").collect()]
    assert got[0] == got[8]
    assert len(set(got)) == len(texts) - 1


def test_edits_are_located(spark):
    a, b = docs(spark, [(1, "one\ntwo\nthree", 0), (2, "same", 0)]), docs(spark, [(1, "one\n2\nthree", 0), (2, "same", 0)])
    r = merkle.edits(merkle.fingerprints(a), merkle.fingerprints(b)).collect()
    assert [(x["doc_id"], x["changed_in_a"], x["changed_in_b"]) for x in r] == [(1, [1], [1])]


def test_branches_apart_follow_the_tree(spark):
    rows = [("a\nb\n\nc\nd", "a\nb\n\nc\nx", ["1.1"]), ("a", "a", []), ("a\n\nb", "a", ["1.0"]), ("a\nb", "x\nb\ny", ["0.0", "0.2"]), ("", "a\n\nb", ["0.0", "1.0"])]
    df = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "i int, a string, b string")
    trees = df.select("i", *[merkle.digested(merkle.sections(F.col(c))).alias(c) for c in "ab"])
    got = trees.select("i", merkle.branches_apart(F.col("a"), F.col("b")).alias("apart")).orderBy("i").collect()
    assert [r["apart"] for r in got] == [r[2] for r in rows]


def test_next_goes_down_and_wraps(spark):
    ids = [*range(0, 4000, 3), 5, 5, None, -7, 10**12]
    rows = [(i, f"t{i}", 0) for i in ids]
    got = sorted((-(r["doc_id"] if r["doc_id"] is not None else -(10**15)), r["text"], r["next_text"] != r["text"], r["next_text"]) for r in merkle.with_next(docs(spark, rows)).collect())
    assert len(got) == len(rows)
    assert all(a[3] == b[1] for a, b in zip(got, [*got[1:], got[0]], strict=True))


def test_edges(spark):
    assert merkle.edit_check(docs(spark, [])).count() == 0
    one = merkle.edit_check(docs(spark, [(1, None, 0)])).first()
    assert (one["n_chars"], one["near_edited"], one["near_next"]) == (0, 1.0, 1.0)
    two = merkle.edit_check(docs(spark, [(1, "😀é. x", 0), (2, "a", 0)])).orderBy("doc_id").collect()
    assert [r["n_chars"] for r in two] == [5, 1]
