"""Near-duplicate documents by ProbMinHash, banding and verification.

A document is its runs of five words (lower case) weighted by their counts. Two documents'
similarity is their probability Jaccard: the sum over common runs i of
1 / sum over all j of max(x_j / x_i, y_j / y_i), which is plain Jaccard where no run repeats.

Signatures: every run is a source of points in a Poisson process whose rate is its weight; each
point falls on one of 216 registers, which keeps the earliest point's run. Points come in order
of arrival, and a run stops when its next point is later than all registers' (early
termination). A register of two documents agrees with the probability of their similarity.

Banding: 36 bands of six registers. Documents that share a band's key are candidates; at a
similarity of 0.8 a pair shares none with probability (1 - 0.8^6)^36 < 0.00002.

Candidates come twice. First every document proposes one partner: the least document of its
bucket, the one that most of its buckets have. Proposals are verified exactly from the texts and
components are joined. Then buckets that still hold two components are searched to their end, in two
passes of tasks of two blocks each (at most 1,024 documents a block, so no group is in one task). The first has
signatures only, block by block of every bucket, and says of each document which homes hold a partner of
another component whose signature estimates 0.66 or more (five standard deviations below 0.8). A home is a block of the documents whose proposals lead to the same
document in four steps, of at most 2,048 documents and 32 MB of text. The second has the texts of two homes, each document once
for every home that holds a partner, however many buckets they share: pairs of different components with such an estimate are verified
exactly there, unless links found before have joined them. Only documents and links leave a task, never lists of pairs.

Exact copies are one node from the start. Ids, keys and signatures are shuffled, texts only of
documents that share a bucket, and in the search only of those with a partner left: one copy of a text for each home of its partners.

Defined results: texts without words (null and empty ones too) and rows without a doc_id are
classes of their own; a text of fewer than five words is one run; rows that share a doc_id are one
document, in one class with the copies of each of its texts; an empty table gives none; extra columns
are not read by `classes` and pass through `dedup`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mixed, scoped, shingle_hashes, small, steps, text_bytes, text_of, word_hashes, written
from .components import extended

BANDS, WIDTH = 36, 6
REGISTERS = BANDS * WIDTH
SIZE, THRESHOLD, LEAST_ESTIMATE = 5, 0.8, 0.66
#: For rounding: similarities are fractions that lie further apart.
SLACK = 1e-9
#: Documents of a block of a bucket; documents and bytes of text of a home.
BLOCK, HOME, HOME_BYTES = 1024, 2048, 32 << 20


def weighted_runs(part: pa.Array, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, run and count of every distinct run of every text."""
    runs, offsets = shingle_hashes(*word_hashes(*text_bytes(part)), size)
    row = np.repeat(np.arange(len(part)), np.diff(offsets))
    order = np.lexsort((runs, row))
    row, runs = row[order], runs[order]
    if not len(row):
        return row, runs, np.zeros(0)
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (runs[1:] != runs[:-1])]))
    return row[first], runs[first], np.diff(np.append(first, len(row))).astype(float)


def signatures(row: np.ndarray, runs: np.ndarray, weights: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """[n, registers]: the run that each register of each row keeps (0 for rows without runs)."""
    first = np.full(n * registers, np.inf)
    kept = np.zeros(n * registers, np.uint64)
    latest = np.full(n, np.inf)
    active, at, point = np.arange(len(runs)), np.zeros(len(runs)), np.zeros(len(runs), np.int64)
    while len(active):
        # so many points that all registers of a row are likely hit in a few turns
        each = np.maximum(1, 5 * registers // 2 // np.bincount(row[active], minlength=n)[row[active]])
        begin = np.cumsum(each) - each
        of = np.repeat(np.arange(len(active)), each)
        number = np.arange(len(of)) - begin[of] + point[active][of]
        source = active[of]
        draw = mixed(runs[source] + (number + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        gap = -np.log(((draw >> np.uint64(11)).astype(float) + 1) * 2.0**-53) / weights[source]
        total = np.cumsum(gap)
        arrival = at[source] + total - (total[begin] - gap[begin])[of]
        at[active], point[active] = arrival[begin + each - 1], point[active] + each
        use = np.flatnonzero(arrival < latest[row[source]])
        place = row[source[use]] * registers + (mixed(draw[use] ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, place, arrival[use])
        won = first[place] == arrival[use]
        kept[place[won]] = runs[source[use[won]]]
        latest = first.reshape(n, registers).max(1)
        active = active[at[active] < latest[row[active]]]
    return kept.reshape(n, registers)


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, key (digest of the text), sketch (a byte a register), bands of rows that have words and an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, part in steps(batch.column(2)):
                row, runs, weights = weighted_runs(part)
                kept = signatures(row, runs, weights, hi - lo)
                has = np.flatnonzero(np.bincount(row, minlength=hi - lo) > 0)
                kept = kept[has]
                keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(has), 1))
                for k in range(WIDTH):
                    keys = mixed(keys * np.uint64(0x100000001B3) + kept[:, k::WIDTH])
                sketch = (mixed(kept) & np.uint64(255)).astype(np.uint8)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * BANDS), pa.array(keys.view(np.int64).reshape(-1)))
                own = batch.slice(lo, hi - lo).take(pa.array(has))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array([x.tobytes() for x in sketch], pa.binary()), bands], names=["doc_id", "key", "sketch", "bands"])

    text = F.lower(text_of(docs))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_key(text).alias("key"), text.alias("text")).where("doc_id IS NOT NULL")
    return rows.mapInArrow(run, "doc_id long, key binary, sketch binary, bands array<long>")


class Runs:
    """The sorted runs and weights of many texts."""

    def __init__(self, texts: pa.Array):
        parts, counts = [], []
        for _, _, some in steps(texts):
            row, runs, weights = weighted_runs(some)
            parts.append((runs, weights))
            counts.append(np.bincount(row, minlength=len(some)))
        self.runs = np.concatenate([p[0] for p in parts] or [np.zeros(0, np.uint64)])
        self.weights = np.concatenate([p[1] for p in parts] or [np.zeros(0)])
        self.counts = np.concatenate([*counts, np.zeros(0, np.int64)]).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.counts)])
        self.totals = np.diff(np.concatenate([[0.0], np.cumsum(self.weights)])[self.offsets])

    def similarities(self, i: int, others: np.ndarray) -> np.ndarray:
        """Probability Jaccard of text i with each of the others."""
        mine = slice(self.offsets[i], self.offsets[i + 1])
        own, own_weights = self.runs[mine], self.weights[mine]
        counts = self.counts[others]
        owner = np.repeat(np.arange(len(others)), counts)
        if not len(own) or not len(owner):
            return np.zeros(len(others))
        place = np.arange(len(owner)) + np.repeat(self.offsets[others] - (np.cumsum(counts) - counts), counts)
        at = np.minimum(np.searchsorted(own, self.runs[place]), len(own) - 1)
        both = own[at] == self.runs[place]
        o, a, b = owner[both], own_weights[at[both]], self.weights[place[both]]
        # runs of one side alone have the ratio a / b of infinity or 0 and count by that side
        alone_a = self.totals[i] - np.bincount(o, a, len(others))
        alone_b = self.totals[others] - np.bincount(o, b, len(others))
        # in order of a / b: the larger ratios count by a, the smaller by b
        order = np.lexsort((a / b, o))
        o, a, b = o[order], a[order], b[order]
        upto_a, upto_b = np.cumsum(a), np.cumsum(b)
        ends = np.searchsorted(o, np.arange(len(others)), side="right")
        begins = np.searchsorted(o, np.arange(len(others)), side="left")
        sums_a, sums_b = np.append(0.0, upto_a), np.append(0.0, upto_b)
        from_here = sums_a[ends][o] - (upto_a - a) + alone_a[o]
        before = (upto_b - b) - sums_b[begins][o] + alone_b[o]
        return np.bincount(o, 1 / (from_here / a + before / b), len(others))


def verified(pairs: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts' similarity reaches the threshold."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    texts = held.select("doc_id", "text").join(small(ids), "doc_id", "left_semi")
    both = pairs.select("a", "b")
    for side in ("b", "a"):
        both = both.join(texts.select(F.col("doc_id").alias(side), F.col("text").alias(f"text_{side}")), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                # a text that several pairs of the part share is cut into runs once
                texts = pa.concat_arrays([part.column(c).cast(pa.large_string()) for c in (2, 3)]).dictionary_encode()
                runs, number = Runs(texts.dictionary), texts.indices.to_numpy()
                linked = [runs.similarities(x, np.array([y]))[0] >= threshold - SLACK for x, y in zip(number[: len(part)], number[len(part) :], strict=True)]
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(linked, pa.bool_())) for c in part.columns[:2]], names=["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of the runs of rows whose first `keys` columns are equal; rows come sorted by them."""
    held: list[pa.RecordBatch] = []

    def same(a, i, b, j) -> bool:
        return all(a.column(k)[i] == b.column(k)[j] for k in range(keys))

    for batch in batches:
        if not len(batch):
            continue
        columns = [np.asarray(batch.column(k)) for k in range(keys)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        bounds = [0, *change.tolist(), len(batch)]
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            if lo == 0 and held and not same(held[-1], len(held[-1]) - 1, batch, 0):
                yield pa.Table.from_batches(held)
                held = []
            elif lo:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def found_links(ids, sketch, bands, texts, label, block, own, band: int, threshold: float, least: float = LEAST_ESTIMATE):
    """Links that join all documents of the blocks {own} that pairs at the threshold join.

    Of pairs of different labels and, if these differ, different blocks, those with an estimate of `least` or
    more are verified, unless links found before join them. Rows of the commonest label do not ask: their
    partners of other labels do. A pair that shares several buckets is left to the one that is first in the
    list of bands.
    """
    at = int((bands[0] == band).argmax())
    values, parent = np.unique(label, return_inverse=True)
    counts = np.bincount(parent)
    quiet = counts.argmax() if counts.max() > 1 else -1
    mine, joined = parent.copy(), np.arange(len(values))  # label numbers, and what each has become part of
    runs, out = None, []
    asks = np.flatnonzero(parent != quiet)
    for lo in range(0, len(asks), 16):
        who = asks[lo : lo + 16]
        agree = (sketch[who][:, None, :] == sketch[None, :, :]).mean(2)
        if own[0] != own[1]:
            agree[block[who][:, None] == block[None, :]] = -1
        for k, i in enumerate(who):
            near = np.flatnonzero((agree[k] >= least) & (joined[mine] != joined[mine[i]]))
            if len(near):
                near = near[(bands[near] == bands[i]).argmax(1) == at]
            if not len(near):
                continue
            runs = Runs(texts) if runs is None else runs
            for j in near[runs.similarities(i, near) >= threshold - SLACK]:
                old, new = joined[mine[j]], joined[mine[i]]
                if old != new:
                    joined[joined == old] = new
                    out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def first_proposals(members: DataFrame) -> DataFrame:
    """Pairs (a, b): every document b and the least of its bucket, the one that most of its buckets have."""
    votes = members.where("low < doc_id").groupBy("doc_id", "low").count()
    return votes.groupBy("doc_id").agg(F.max_by("low", F.struct(F.col("count"), -F.col("low"))).alias("a")).select("a", F.col("doc_id").alias("b"))


def near_homes(sketch, label, home, block, own, least: float = LEAST_ESTIMATE) -> tuple[np.ndarray, np.ndarray]:
    """Rows and homes, each pair once: which rows have a partner of another label in which home, or are it, of the blocks {own}.

    Rows of the commonest label don't ask, as their partners of other labels do. If the blocks differ, pairs are across them.
    """
    homes, at = np.unique(home, return_inverse=True)
    values, parent = np.unique(label, return_inverse=True)
    counts = np.bincount(parent)
    quiet = counts.argmax() if counts.max() > 1 else -1
    asks = np.flatnonzero(parent != quiet)
    mark = np.zeros((len(label), len(homes)), bool)
    for lo in range(0, len(asks), 16):
        who = asks[lo : lo + 16]
        near = (sketch[who][:, None, :] == sketch[None, :, :]).mean(2) >= least
        near &= parent[who][:, None] != parent[None, :]
        if own[0] != own[1]:
            near &= block[who][:, None] != block[None, :]
        i, j = np.nonzero(near)
        mark[who[i], at[j]] = True
        mark[j, at[who[i]]] = True
    row, which = np.nonzero(mark)
    return row, homes[which]


def homes_of(named: DataFrame, tested: DataFrame) -> DataFrame:
    """doc_id, label, home of the rows (doc_id, label, bytes), home being a number of the block and the document that proposals (a, b) lead to in four steps."""
    led = tested.select(F.col("b").alias("doc_id"), F.col("a").alias("led"))
    for _ in range(2):  # two steps, then four
        further = led.select(F.col("doc_id").alias("led"), F.col("led").alias("further"))
        led = written(led.join(further, "led", "left").select("doc_id", F.coalesce("further", "led").alias("led")))
    each = written(named.select("doc_id", "label", "bytes").distinct().join(led, "doc_id", "left").withColumn("led", F.coalesce("led", "doc_id")))
    blocks = F.greatest(F.ceil(F.count("*") / HOME), F.ceil(F.sum("bytes") / HOME_BYTES))
    sizes = each.groupBy("led").agg(blocks.cast("int").alias("blocks"))
    # homes are named by a hash: two that share a name are searched as one
    return each.join(sizes, "led").select("doc_id", "label", F.xxhash64("led", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))).alias("home"))


def searched(members: DataFrame, held: DataFrame, labels: DataFrame, tested: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between components, from the buckets (band, doc_id) that hold more than one and aren't just a pair of `tested`."""
    named = members.select("band", "doc_id").join(labels.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").select("band", "doc_id", F.coalesce("component", "doc_id").alias("label"))
    named = written(named.join(held.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("bytes")), "doc_id"))
    parted = named.groupBy("band").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("low < high")
    parted = parted.join(tested.select("a", "b", F.lit(True).alias("known")), ["a", "b"], "left").where("n > 2 OR known IS NULL")
    rows = written(named.join(written(parted.select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))), "band"))
    homes = written(homes_of(rows, tested))
    dealt = rows.select("band", "doc_id", "blocks").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id").join(homes, "doc_id").join(held.select("doc_id", "sketch"), "doc_id")

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 3):
            if len(group) < 2:
                continue
            sketch = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint8).reshape(len(group), -1)
            ids, label, home, block = (group[c].to_numpy() for c in ("doc_id", "label", "home", "block"))
            row, other = near_homes(sketch, label, home, block, (group["i"][0].as_py(), group["j"][0].as_py()))
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[row], label[row], home[row], np.minimum(home[row], other), np.maximum(home[row], other))], names=["doc_id", "label", "home", "h", "k"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 2):
            sketch = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint8).reshape(len(group), -1)
            texts = pa.concat_arrays([c.cast(pa.large_string()) for c in group["text"].chunks])
            ids, label, home = (group[c].to_numpy() for c in ("doc_id", "label", "home"))
            own = group["h"][0].as_py(), group["k"][0].as_py()
            found = found_links(ids, sketch, np.zeros((len(ids), 1), np.int64), texts, label, home, own, 0, threshold)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    # as a number, so that small tables don't become few tasks: pairs cost time, not bytes
    tasks = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = dealt.select("band", "i", "j", "block", "label", "doc_id", "home", "sketch").repartition(tasks, "band", "i", "j").sortWithinPartitions("band", "i", "j")
    asked = written(spread.mapInArrow(estimate, "doc_id long, label long, home long, h long, k long").distinct())
    paired = asked.join(held.select("doc_id", "sketch", "text"), "doc_id").select("h", "k", "doc_id", "label", "home", "sketch", "text").repartition(tasks, "h", "k").sortWithinPartitions("h", "k")
    return paired.mapInArrow(verify, "a long, b long").where("a < b").distinct()


@scoped
def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (the least doc_id of its group), kept (whether it is that one) of every row."""
    words = F.lower(text_of(docs))
    ids = docs["doc_id"].cast("long").alias("doc_id")
    slim = written(docs.select(ids, text_key(words).alias("key"), words.rlike(r"[^\t-\r\x1c-\x20]").alias("worded")))
    # the least doc_id of each text, with its signature
    nodes = written(sketched(docs).groupBy("key").agg(F.min(F.struct("doc_id", "sketch", "bands")).alias("node")).select("key", "node.*"))
    bands = nodes.select("doc_id", F.explode("bands").alias("band"))
    buckets = written(bands.groupBy("band").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("band", "low"))
    # merged at every size, so that what is moved grows as the input does
    members = written(bands.join(buckets.hint("merge"), "band").select("doc_id", "band", "low"))
    near = written(nodes.join(small(written(members.select("doc_id").distinct())), "doc_id", "left_semi"))
    texts = docs.select(ids, text_key(words).alias("key"), words.alias("text")).join(small(near.select("doc_id", "key")), ["doc_id", "key"], "left_semi")
    held = written(near.join(texts.dropDuplicates(["key"]).select("key", "text"), "key").drop("key"))
    # the texts that share a doc_id belong together
    shared = slim.where("worded AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most").select("doc_id")
    shared = slim.where("worded").join(shared, "doc_id").join(nodes.select("key", F.col("doc_id").alias("first")), "key").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    tested = written(first_proposals(members))
    labels = extended(None, verified(tested, held, threshold).union(shared))
    labels = extended(labels, searched(members, held, labels, tested, threshold))
    first = nodes.join(labels.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").select("key", F.coalesce("component", "doc_id").alias("first"))
    named = slim.join(first, "key", "left").select("doc_id", F.when(F.col("worded"), F.col("first")).otherwise(F.col("doc_id")).alias("class_id"))
    return named.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"), F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"))


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores until no column of df has it (Spark's names have no case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, columns as they are, of each group's document with the least doc_id; one row of those that share it."""
    found = classes(docs, threshold)
    gone = free_name(docs, "gone_id")
    left = docs.join(small(written(found.where("NOT kept").select(F.col("doc_id").alias(gone)).distinct())), docs["doc_id"].cast("long") == F.col(gone), "left_anti")
    repeats = found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    if repeats.isEmpty():
        return left
    return left.where("doc_id IS NULL").unionByName(left.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))
