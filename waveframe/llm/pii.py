"""Personal data by patterns and by bootstrapped context, in DataFrame operations only.

Base spans are matches of four patterns (email, ip, card, phone). They seed the method: the word
before an entity is a lexical pattern for its kind, and the entity's text is an instance. All
strings that look like an identifier, base spans or not, make a graph of patterns and instances.
Spark scores it in rounds: a pattern by the mean confidence of its instances times the share of
the word's occurrences in the whole corpus that an identifier of the kind follows; an instance by
its patterns together (1 minus the product of what they leave). Patterns with enough support and
score then discover identifiers that no base pattern matches, as extra spans. Base spans stay.

All steps are projections, aggregations by word or instance, and joins on them; a frequent word
is summed before it is shuffled.

Positions are code points: a text's matches and the gaps between them alternate, so a match
starts after the lengths of all before it. Sums and pieces are gathered in chunks of matches, so a text of
very many is not copied for each. The expressions have possessive repeats and look-behinds that
keep them linear in the text and match the same as the plain patterns in KINDS.

Defined results: null and empty texts have no spans; repeated rows count each in the output and
once in the graph; rows without a doc_id are kept; an empty table gives none. Other columns are not read by
`find`, and pass through `redact`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

# The base patterns.
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LINEAR = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What looks like an identifier: an address with @, or digits with single separators.
IDENTIFIER = r"(?:\G|(?<![^\s<>\"'=:;,()\[\]]))[^\s@<>\"'=:;,()\[\]]++@[^\s@<>\"'=:;,()\[\]]++|[+(]?[0-9](?:[\x20().-]{0,2}[0-9])++"
LEAST_DIGITS = 7
#: Distinct seeds that a pattern needs, its least score, an instance's least confidence, and rounds.
LEAST_SUPPORT, LEAST_SCORE, LEAST_CONFIDENCE, ROUNDS = 3, 0.5, 0.5, 3
#: Matches or spans of a chunk.
CHUNK = 256
NOT_LETTER = r"[^\p{L}]+"
#: Extra spans that a broadcast may hold.
BROADCAST_ROWS = 100_000
NUMBERED = {kind: k for k, kind in enumerate(KINDS)}
SPAN = "array<struct<start:int,kind:int,end:int>>"
SEEN = "array<struct<start:int,kind:int,end:int,value:string,word:string>>"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def passes_luhn(number: Column) -> Column:
    """From the right, every second digit counts twice (less 9 above 9); the sum is a multiple of 10."""
    def worth(c, i):
        d = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return d - F.when(d > 9, 9).otherwise(0)

    each = F.transform(F.filter(F.split(F.reverse(number), ""), lambda c: c != ""), worth)
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def holds(kind: str, match: Column) -> Column:
    """What a match must be beyond the pattern."""
    n = F.length(digits(match))
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(999)) <= 255))
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), passes_luhn(digits(match))).otherwise(False)
    return (n >= 9) & (n <= 15) if kind == "phone" else F.lit(True)


def chunked(items: Column, start: Column, kind: str, first, step) -> Column:
    """step(state, item) over items; states are struct(at, out: array<kind>, ...). Gives struct(at, out).

    first(at, items of a chunk) is a chunk's first state: `out` grows in chunks and those are put
    together, so n items cost n times the square root of n at most, not the square of n.
    """
    def chunk(whole, k):
        own = F.slice(items, k * CHUNK + 1, F.lit(CHUNK))
        done = F.aggregate(own, first(whole["at"], own), step, lambda s: F.struct(s["at"].alias("at"), s["out"].alias("out")))
        return F.aggregate(F.array(done), whole, lambda a, d: F.struct(d["at"].alias("at"), F.concat(a["out"], F.array(d["out"])).alias("out")))

    chunks = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int"))).otherwise(F.array().cast("array<int>"))
    empty = F.struct(start.alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    return F.aggregate(chunks, empty, chunk, lambda w: F.struct(w["at"].alias("at"), F.flatten(w["out"]).alias("out")))


def _placed(text: Column, pattern: str, item, kind: str, keep) -> Column:
    """array<kind> of item(start, match, gap before) for the matches that keep() accepts."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("match"), keep(m).alias("ok")))

    def step(a, x):
        start = a["at"] + F.char_length(x["gap"])
        out = F.when(x["ok"], F.concat(a["out"], F.array(item(start, x["match"], x["gap"])))).otherwise(a["out"])
        return F.struct((start + F.char_length(x["match"])).alias("at"), out.alias("out"))

    # the matches are found once and handed on, as the one item of an outer array
    whole = F.transform(F.array(pairs), lambda p: chunked(p, F.lit(0), kind, lambda at, _: F.struct(at.alias("at"), F.array().cast(kind).alias("out")), step))
    return F.element_at(whole, 1)["out"]


def base_spans(text: Column) -> Column:
    """array of struct(start, kind, end), sorted."""
    def of(kind: str) -> Column:
        found = _placed(text, LINEAR[kind], lambda s, m, g: F.struct(s.alias("start"), F.lit(NUMBERED[kind]).alias("kind"), (s + F.char_length(m)).alias("end")), SPAN, lambda m: holds(kind, m))
        return F.when(F.contains(text, F.lit("@")) if kind == "email" else F.contains(text, F.lit("+")) if kind == "phone" else text.rlike("[0-9][0-9 .-]{2}" if kind == "card" else r"[0-9]\.[0-9]"), found).otherwise(F.array().cast(SPAN))

    return F.array_sort(F.concat(*[of(k) for k in KINDS]))


def shape(match: Column) -> Column:
    """The kind that an identifier's form allows, as its number, or null."""
    n = F.length(digits(match))
    return (
        F.when(F.contains(match, F.lit("@")), NUMBERED["email"])
        .when(match.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), NUMBERED["ip"])
        .when((n >= 12) & (n <= 19) & ~match.rlike(r"[+().]"), NUMBERED["card"])
        .when((n >= LEAST_DIGITS) & (n <= 15), NUMBERED["phone"])
    )


def identifiers(text: Column) -> Column:
    """array of struct(start, kind, end, value, word before)."""

    def item(s, m, g):
        word = F.lower(F.reverse(F.regexp_extract(F.reverse(g), r"\p{L}+", 0)))
        return F.struct(s.alias("start"), shape(m).alias("kind"), (s + F.char_length(m)).alias("end"), F.lower(m).alias("value"), word.alias("word"))

    return _placed(text, IDENTIFIER, item, SEEN, lambda m: shape(m).isNotNull())


def seeds(base: Column, seen: Column) -> Column:
    """array of whether each of `seen` overlaps one of `base`: in the order of positions, a span
    overlaps if the furthest end of base spans that start before its end lies beyond its start."""
    starts = F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("side"), b["end"].alias("to")))
    ends = F.transform(seen, lambda x: F.struct(x["end"].alias("at"), F.lit(0).alias("side"), x["start"].alias("to")))

    def step(a, e):
        far = F.when(e["side"] == 1, F.greatest(a["at"], e["to"])).otherwise(a["at"])
        out = F.when(e["side"] == 1, a["out"]).otherwise(F.concat(a["out"], F.array(a["at"] > e["to"])))
        return F.struct(far.alias("at"), out.alias("out"))

    whole = F.transform(F.array(F.array_sort(F.concat(starts, ends))), lambda p: chunked(p, F.lit(0), "array<boolean>", lambda at, _: F.struct(at.alias("at"), F.array().cast("array<boolean>").alias("out")), step))
    return F.element_at(whole, 1)["out"]


def scanned(docs: DataFrame) -> DataFrame:
    """A slim table of every row: doc_id, copy (a hash of its text), base spans, identifiers and whether base spans meet them."""
    text = text_of(docs)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("copy"), text.alias("text"))
    found = F.when(F.col("text").rlike("[0-9]|@"), identifiers(F.col("text"))).otherwise(F.array().cast(SEEN))
    spans = rows.select("doc_id", "copy", base_spans(F.col("text")).alias("base"), found.alias("seen"))
    return written(spans.withColumn("seed", F.when(F.size("seen") > 0, seeds(F.col("base"), F.col("seen"))).otherwise(F.array().cast("array<boolean>"))))


def word_counts(docs: DataFrame, words: DataFrame) -> DataFrame:
    """word, total: occurrences in all texts of the words given."""
    few = words.count() <= BROADCAST_ROWS
    each = docs.select(F.explode(F.split(F.lower(text_of(docs)), NOT_LETTER)).alias("word")).where("word != ''")
    return (each.join(F.broadcast(words), "word") if few else each.groupBy("word").count().join(words, "word").withColumnRenamed("count", "n")).groupBy("word").agg((F.count("*") if few else F.sum("n")).alias("total"))


def patterns(docs: DataFrame, slim: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(occurrences of identifiers, accepted patterns, accepted instances) after the rounds."""
    once = slim.where(F.size("seen") > 0).dropDuplicates(["doc_id", "copy"])
    both = F.zip_with("seen", "seed", lambda x, seed: F.struct(x.alias("x"), seed.alias("seed")))
    seen = written(once.select("doc_id", "copy", F.explode(both).alias("s")).select("doc_id", "copy", "s.x.*", "s.seed"))
    edges = seen.where("word != ''").groupBy("word", "kind", "value").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    # a word with fewer instances than the least support can never be a pattern
    spread = edges.groupBy("word", "kind").agg(F.count("*").alias("instances"), F.sum("n").alias("followed")).where(F.col("instances") >= LEAST_SUPPORT)
    totals = word_counts(docs, spread.select("word").distinct())
    specific = written(spread.join(totals, "word").select("word", "kind", "instances", (F.col("followed") / F.col("total")).alias("specificity")).where(F.col("specificity") >= LEAST_SCORE))
    graph = written(edges.join(specific, ["word", "kind"]).withColumn("confidence", F.col("seed").cast("double")))
    known = graph
    for _ in range(rounds):
        scored = known.groupBy("word", "kind").agg((F.avg("confidence") * F.first("specificity")).alias("score"), F.sum("confidence").alias("support"))
        scored = scored.withColumn("score", F.when(F.col("support") >= LEAST_SUPPORT, F.col("score")).otherwise(0.0))
        both = graph.drop("confidence").join(scored, ["word", "kind"])
        instances = both.groupBy("kind", "value").agg(F.max("seed").alias("seed"), (1 - F.product(1 - F.least("score", F.lit(0.999)))).alias("found"))
        instances = instances.select("kind", "value", F.when(F.col("seed"), 1.0).otherwise(F.col("found")).alias("confidence"))
        known = written(graph.drop("confidence").join(instances, ["kind", "value"]))
    accepted = known.groupBy("word", "kind").agg((F.avg("confidence") * F.first("specificity")).alias("score"), F.sum("confidence").alias("support")).where((F.col("score") >= LEAST_SCORE) & (F.col("support") >= LEAST_SUPPORT))
    return seen, written(accepted), known.where(F.col("confidence") >= LEAST_CONFIDENCE).select("kind", "value").distinct()


def discovered(docs: DataFrame, slim: DataFrame) -> DataFrame:
    """doc_id, copy, extra (spans) of rows in which the method finds more than the base patterns."""
    seen, accepted, instances = patterns(docs, slim)
    extra = seen.where(~F.col("seed")).join(accepted.select("word", "kind"), ["word", "kind"]).join(instances, ["kind", "value"])
    return written(extra.groupBy("doc_id", "copy").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("extra")))  # of one text


def with_extra(rows: DataFrame, extra: DataFrame) -> DataFrame:
    """rows (doc_id, copy, ...) with `extra`, an empty array where there is none."""
    found = extra.select(F.col("doc_id").alias("its_doc_id"), F.col("copy").alias("its_copy"), "extra")
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    joined = rows.join(found, rows["doc_id"].eqNullSafe(found["its_doc_id"]) & (rows["copy"] == found["its_copy"]), "left")
    return joined.drop("its_doc_id", "its_copy").withColumn("extra", F.coalesce("extra", F.array().cast(SPAN)))


def united(base: Column, extra: Column) -> Column:
    """All spans, sorted; extra spans meet no base span, so none is there twice."""
    return F.array_sort(F.concat(base, extra))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base, spans: sorted arrays of struct(start, kind, end); kind is a place in KINDS."""
    slim = scanned(docs)
    both = with_extra(slim.select("doc_id", "copy", "base"), discovered(docs, slim))
    return both.select("doc_id", "base", united(F.col("base"), F.col("extra")).alias("spans"))


def as_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def n_of(spans: Column, kind: str) -> Column:
    """How many of the spans are of the kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == F.lit(NUMBERED[kind]))).cast("long")


def report(docs: DataFrame) -> DataFrame:
    """Counts of base spans by kind, the digest of base spans and all spans of every document."""
    found = find(docs)
    counts = [n_of(F.col("base"), kind).alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """text with every span replaced by its kind in brackets; of spans that overlap, the first has the tag."""
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def first(at, own):
        # a chunk's part of the text is cut out once, its pieces from that
        part = F.substring(text, at + 1, F.array_max(F.transform(own, lambda s: s["end"])) - at)
        return F.struct(at.alias("at"), F.array().cast("array<string>").alias("out"), at.alias("base"), part.alias("part"))

    def step(a, s):
        fresh = s["start"] >= a["at"]
        piece = F.substring(a["part"], a["at"] - a["base"] + 1, s["start"] - a["at"])
        out = F.when(fresh, F.concat(a["out"], F.array(piece, F.element_at(tags, s["kind"] + 1)))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), out.alias("out"), a["base"].alias("base"), a["part"].alias("part"))

    def end(done):
        return F.concat(F.array_join(done["out"], ""), F.substring(text, done["at"] + 1, F.char_length(text)))

    whole = F.transform(F.array(spans), lambda own: end(chunked(own, F.lit(0), "array<string>", first, step)))
    return F.element_at(whole, 1)


def redact(docs: DataFrame) -> DataFrame:
    """The input's rows and columns, with personal data in `text` masked; a null text stays null."""
    extra = discovered(docs, scanned(docs))
    text = text_of(docs)
    held = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("copy"), F.struct(*docs.columns).alias("row"))
    whole = F.coalesce(F.col("row.text"), F.lit(""))
    spans = with_extra(held, extra).withColumn("spans", united(base_spans(whole), F.col("extra")))
    changed = F.when(F.col("row.text").isNotNull(), masked(whole, F.col("spans")))
    return spans.select(*[changed.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
