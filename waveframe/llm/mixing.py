"""Mixing of sources to target weights by weighted fair queueing, in DataFrame operations only.

Every document of a source, in a shuffled order that depends on its id alone, gets a virtual
finish time: the words that its source has sent up to its end, over the source's target. All
documents are then taken in the order of that time until the total budget is spent. A source
whose target exceeds its size goes round again, `max_repeats` times at most.

No step needs a source's documents in one task. A source is cut into 4,096 slices (16 times as
many for every 16-fold rows beyond 400 million) by the first digits of the shuffle key; running sums
are those of slices, then those within a slice. The budget's cut is found from sums over 2,048
intervals of virtual time, then over 4,096 parts of the one that crosses it, then among the few rows
of that part.

Within a round of its source, a document is taken if it stands no later than the last one taken. So the
mix itself needs one boundary for each source and round, and no text is shuffled.

Defined results: a null text has size 0; a null source is a source, ordered last; rows that
repeat count each; rows that tie go by doc_id, size and a hash of the text; of a doc_id's rows with equal
texts, `mix` takes all or none in a round; a source of size 0 has target 0; an empty table
gives none. Other columns of the input are neither read nor able to clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scoped, small, written

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of sources in the order of their names, again and again.
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = "fair-queue-1"
INTERVALS, PARTS = 1024, 4096
LEAST_ID = -(1 << 63)
#: Rows for three digits of the shuffle key; 16 times as many have one digit more.
SLICED_ROWS = 400_000_000


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _order(docs: DataFrame, seed: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(docs["doc_id"].cast("string"), F.lit(""))), 256)


def _rest(docs: DataFrame) -> Column:
    """What decides between rows of one order: doc_id, size, hash of the text."""
    return F.struct(F.coalesce(docs["doc_id"].cast("long"), F.lit(LEAST_ID)).alias("doc_id"), n_words(docs["text"]).alias("size"), F.xxhash64(docs["text"].cast("string")).alias("hash"))


def _keyed(docs: DataFrame, seed: str) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), n_words(docs["text"]).alias("size"), _order(docs, seed).alias("order"), _rest(docs).alias("rest"))


def _digits(n: int) -> int:
    """Digits of the shuffle key that name a slice, so that slices stay about as large."""
    digits = 3
    while n > SLICED_ROWS:
        n, digits = n // 16, digits + 1
    return digits


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size -> rank, weight, target: the total shared by weight, none above
    max_repeats times its source's size, the excess shared by weight among the rest.

    In order of size over weight, a source is capped if an equal share of what the capped ones
    before it leave would exceed its cap; one row for each source goes through one window.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long")
    ranked = sizes.withColumn("rank", F.row_number().over(by_name).cast("long")).withColumn("weight", weight).withColumn("cap", F.lit(max_repeats) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    shared = ranked.select("*", F.sum("source_size").over(everything).alias("total"), F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("capped"), F.sum("weight").over(after).alias("open"))
    # the first source in this order whose share is within its cap sets the level for all after it
    within = F.col("weight") * (F.col("total") - F.col("capped")) <= F.col("cap") * F.col("open")
    ordered = shared.withColumn("within", within).withColumn("place", F.row_number().over(by_ratio))
    level = F.min(F.when(F.col("within"), F.struct("place", "capped", "open"))).over(everything)
    levelled = ordered.withColumn("level", level)
    share = F.try_divide((F.col("weight") * (F.col("total") - F.col("level.capped"))).cast("double"), F.col("level.open").cast("double"))
    target = F.when(F.col("place") >= F.col("level.place"), share).otherwise(F.col("cap").cast("double"))
    return levelled.select("source", "source_size", "rank", "weight", F.coalesce(target, F.lit(0.0)).alias("target"), "total")


def _queued(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """rows with words up to their end within one round of their source (`sent`)."""
    own = Window.partitionBy("source", "slice").orderBy("order", "rest").rowsBetween(Window.unboundedPreceding, 0)
    within = rows.withColumn("within", F.sum("size").over(own))
    same = within["source"].eqNullSafe(starts["source"]) & (within["slice"] == starts["slice"])
    return within.join(starts, same).select(*[within[c] for c in within.columns], starts["source_size"], starts["rank"], starts["target"], starts["total"], (starts["start"] + within["within"]).alias("sent"))


def _finish(repeat: Column) -> Column:
    return F.try_divide((repeat * F.col("source_size") + F.col("sent")).cast("double"), F.col("target"))


def _tie() -> Column:
    return F.struct("rank", "order", "rest")


def _crossing(sums: DataFrame, place: str, spent: int, budget: int):
    """The first place in whose words the budget ends, and the words before it."""
    running = sums.withColumn("upto", F.sum("words").over(Window.orderBy(place)) + spent)
    return running.where(F.col("upto") > budget).orderBy(place).select(place, (F.col("upto") - F.col("words")).alias("before")).first()


@scoped
def _queue(docs: DataFrame, weights, max_repeats, seed) -> DataFrame:
    """Of every row: doc_id, source, size, order, rest, source_size, rank, target and took (by round, whether it is taken)."""
    slim = written(_keyed(docs, seed))
    slim = slim.withColumn("slice", F.substring("order", 1, _digits(slim.count())))
    slices = written(slim.groupBy("source", "slice").agg(F.sum("size").alias("words")))
    targets = source_targets(slices.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_repeats)
    upto = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    each = slices.withColumn("start", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    starts = written(each.join(targets, each["source"].eqNullSafe(targets["source"])).select(each["source"], "slice", "start", "source_size", "rank", "target", "total"))

    head = starts.select("total").first()
    budget = int(head["total"]) if head else 0
    repeats = F.sequence(F.lit(0), F.lit(max_repeats - 1))
    queued = written(_queued(slim, starts).drop("slice", "within", "total"))
    # Up to time 2 every source has sent its target at least, so the budget ends before that.
    copies = queued.where("target > 0").select("*", F.explode(repeats).alias("repeat")).withColumn("finish", _finish(F.col("repeat"))).where("finish <= 2")
    times = copies.select("finish", "size", _tie().alias("tie")).withColumn("interval", F.floor(F.col("finish") * INTERVALS))
    cut = None
    if found := _crossing(times.groupBy("interval").agg(F.sum("size").alias("words")), "interval", 0, budget):
        part = F.floor((F.col("finish") * INTERVALS - found["interval"]) * PARTS)
        inside = times.where(F.col("interval") == found["interval"]).withColumn("part", part)
        second = _crossing(inside.groupBy("part").agg(F.sum("size").alias("words")), "part", found["before"], budget)
        last = inside.where(F.col("part") == second["part"]).withColumn("upto", F.sum("size").over(Window.orderBy("finish", "tie").rowsBetween(Window.unboundedPreceding, 0)) + second["before"])
        cut = last.where(F.col("upto") > budget).orderBy("finish", "tie").select("finish", "tie").first()

    def taken(repeat: Column) -> Column:
        at = _finish(repeat)
        if cut is None:
            return at <= 2
        tie = cut["tie"]
        rest = F.struct(*[F.lit(tie["rest"][k]).cast("long").alias(k) for k in ("doc_id", "size", "hash")])
        until = F.struct(F.lit(tie["rank"]).cast("long").alias("rank"), F.lit(tie["order"]).alias("order"), rest.alias("rest"))
        return (at < cut["finish"]) | ((at == cut["finish"]) & (_tie() < until))

    return queued.withColumn("took", F.transform(repeats, taken))


def mix_plan(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """Of every document: doc_id, source, size, source_size, target, copies, taken (words)."""
    copies = F.size(F.filter("took", lambda x: x)).cast("long")
    return _queue(docs, weights, max_repeats, seed).select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mix(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """The mix itself: the input's rows and columns, each row as often as it is taken."""
    queue = _queue(docs, weights, max_repeats, seed)
    last = [F.max(F.when(F.col("took")[e], F.struct("order", "rest"))).alias(f"last_{e}") for e in range(max_repeats)]
    bounds = written(queue.groupBy("source").agg(*last).select(F.col("source").alias("of_source"), F.array(*[f"last_{e}" for e in range(max_repeats)]).alias("bounds")))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["source"].cast("string").alias("its_source"), _order(docs, seed).alias("order"))
    rows = rows.join(small(bounds), F.col("its_source").eqNullSafe(F.col("of_source")))
    # text is only looked at where a row has the order of a boundary
    whole = F.struct(F.coalesce(F.col("row.doc_id").cast("long"), F.lit(LEAST_ID)).alias("doc_id"), n_words(F.col("row.text")).alias("size"), F.xxhash64(F.col("row.text").cast("string")).alias("hash"))
    times = F.size(F.filter("bounds", lambda b: F.coalesce(F.when(F.col("order") == b["order"], whole <= b["rest"]).otherwise(F.col("order") < b["order"]), F.lit(False))))
    return rows.select(F.explode(F.array_repeat("row", times)).alias("row")).select("row.*")
