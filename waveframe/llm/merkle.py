"""Merkle fingerprints of documents, in DataFrame operations only.

A document is sections (parted by a blank line) of paragraphs (lines) of sentences (parted by a
full stop and a space). A sentence's leaf is its SHA-256; a paragraph's, section's and the
document's digest is the SHA-256 of its children's digests. All three partings are on fixed
strings, so equal roots mean equal texts. The fingerprint string is the root, the sections'
digests, the paragraphs' and the sentences', the lower levels cut to 16 hex digits.

Edits are located from the root down: where roots differ, sections are compared by their place, and
only within those that differ paragraphs are.

The likeness of two fingerprints is twice the distinct leaves they share over the sum of both
counts: 1 for equal texts, about a half for a text of which half was replaced.

Defined results: a null text is an empty one, which has one empty leaf; repeated rows count
each; rows that tie on doc_id follow each other by text; nulls in doc_id come last; an empty table
gives none. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of

DIGITS = 16
#: Most ranges of doc_id, and the rows that each should have at least.
MOST_RANGES, RANGE_ROWS = 1024, 500


def _short(x: Column) -> Column:
    return F.substring(x, 1, DIGITS)


def sections(text: Column) -> Column:
    """array of sections: array of paragraphs: array of leaves (hex)."""
    def paragraph(p):
        return F.transform(F.split(p, r"\. ", -1), lambda s: F.sha2(s, 256))

    return F.transform(F.split(text, "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), paragraph))


def digested(tree: Column) -> Column:
    """struct of root, sections, paragraphs and leaves from sections()."""
    paragraphs = F.transform(tree, lambda s: F.transform(s, lambda p: F.sha2(F.array_join(p, ","), 256)))
    blocks = F.transform(paragraphs, lambda s: F.sha2(F.array_join(s, ","), 256))
    return F.struct(
        F.sha2(F.array_join(blocks, ","), 256).alias("root"),
        F.transform(blocks, _short).alias("sections"),
        F.transform(paragraphs, lambda s: F.transform(s, _short)).alias("branches"),
        F.transform(F.flatten(paragraphs), _short).alias("paragraphs"),
        F.transform(F.flatten(F.flatten(tree)), _short).alias("leaves"),
    )


def fingerprint(tree: Column) -> Column:
    """The struct of digested() as one string."""
    return F.concat_ws("/", tree["root"], F.array_join(tree["sections"], "."), F.array_join(tree["paragraphs"], "."), F.array_join(tree["leaves"], "."))


def branches_apart(a: Column, b: Column) -> Column:
    """array of "section.paragraph" places (from 0) at which two trees of digested() differ, in order."""
    def places(x, y):
        return F.filter(F.sequence(F.lit(0), F.greatest(F.size(x), F.size(y)) - 1), lambda k: ~F.get(x, k).eqNullSafe(F.get(y, k)))

    def within(k):
        own, other = (F.coalesce(F.get(t["branches"], k), F.array().cast("array<string>")) for t in (a, b))
        return F.transform(places(own, other), lambda p: F.concat_ws(".", k.cast("string"), p.cast("string")))

    apart = F.flatten(F.transform(places(a["sections"], b["sections"]), within))
    return F.when(a["root"] == b["root"], F.array().cast("array<string>")).otherwise(apart)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, of two arrays of distinct leaves."""
    return (2 * F.size(F.array_intersect(a, b))).cast("double") / (F.size(a) + F.size(b)).cast("double")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, root, sections, paragraphs, leaves, fingerprint of every document."""
    tree = docs.select("doc_id", sections(text_of(docs)).alias("tree")).select("doc_id", digested(F.col("tree")).alias("t"))
    return tree.select("doc_id", "t.*", fingerprint(F.col("t")).alias("fingerprint"))


def edits(a: DataFrame, b: DataFrame) -> DataFrame:
    """Where documents of the same doc_id differ: doc_id, and the paragraphs of a and of b (from 0)
    whose digests the other lacks. Documents with equal roots are left out."""
    def lacking(x, y):
        return F.filter(F.transform(x, lambda p, i: F.when(~F.array_contains(y, p), i)), lambda i: i.isNotNull())

    both = a.select("doc_id", "root", "paragraphs").join(b.select("doc_id", F.col("root").alias("other_root"), F.col("paragraphs").alias("others")), "doc_id")
    return both.where("root != other_root").select("doc_id", lacking(F.col("paragraphs"), F.col("others")).alias("changed_in_a"), lacking(F.col("others"), F.col("paragraphs")).alias("changed_in_b"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text: the document that follows by descending doc_id; after the last, the first.

    Ids are cut into ranges of about equal numbers of rows. A range also gets the first rows of
    the range after it, so each range is a window of its own and texts are shuffled once.
    """
    ids = docs.select(docs["doc_id"].cast("long").alias("doc_id"))
    rows = ids.count()
    n = max(1, min(MOST_RANGES, rows // RANGE_ROWS))
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    if not rows:
        return texts.withColumn("next_text", F.col("text"))
    bounds = ids.select(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 100 * n)).first()[0] if n > 1 else []
    bounds = sorted(set(bounds or []))
    above = F.size(F.filter(F.array(*[F.lit(x) for x in bounds]), lambda x: x < F.col("doc_id"))) if bounds else F.lit(0)
    # 0 is the range of the greatest ids; ids that are null make one of their own at the end
    place = F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(F.lit(len(bounds)) - above)
    firsts = ids.withColumn("range", place).groupBy("range").agg(F.max("doc_id").alias("first")).orderBy("range").collect()  # one row a range
    before = {r["first"]: firsts[k - 1]["range"] for k, r in enumerate(firsts)}  # the very first row follows the last range
    also = F.create_map(*[F.lit(x) for k, v in before.items() if k is not None for x in (k, v)])[F.col("doc_id")] if any(k is not None for k in before) else F.lit(None).cast("int")
    if None in before:
        also = F.when(F.col("doc_id").isNull(), before[None]).otherwise(also)
    kinds = F.array_compact(F.array(F.struct(place.alias("range"), F.lit(False).alias("guest")), F.when(also.isNotNull(), F.struct(also.alias("range"), F.lit(True).alias("guest")))))
    dealt = texts.select("*", F.explode(kinds).alias("at")).select("doc_id", "text", "at.*")
    follow = Window.partitionBy("range").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    return dealt.withColumn("next_text", F.lead("text").over(follow)).where(~F.col("guest")).select("doc_id", "text", "next_text")


def edit_check(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, whose last floor(n_chars / 2) code
    points are replaced by as many first ones of the next document, with how many paragraphs differ and
    where the first of them is (null if the text is as it was)."""
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - int(floor(char_length(text) / 2)))"), F.expr("substring(next_text, 1, int(floor(char_length(text) / 2)))"))
    rows = with_next(docs).select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "text", "next_text", edited.alias("edited"))
    trees = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *[sections(F.col(c)).alias(c) for c in ("text", "edited", "next_text")])
    done = trees.select("doc_id", "n_chars", "edited_sha256", *[digested(F.col(c)).alias(c) for c in ("text", "edited")], F.array_distinct(F.transform(F.flatten(F.flatten("next_text")), _short)).alias("next_leaves"))
    leaves = done.select("*", branches_apart(F.col("text"), F.col("edited")).alias("apart"), F.array_distinct("text.leaves").alias("a"), F.array_distinct("edited.leaves").alias("b"))
    return leaves.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"), likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("next_leaves")).alias("near_next"), F.size("apart").cast("long").alias("n_edited_paragraphs"), F.get("apart", F.lit(0)).alias("first_edit"))
