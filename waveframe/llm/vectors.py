"""Near-duplicate vectors by a robust-pruned flat graph on overlapping shards.

1. Shards: centres come from a bounded sample, those of one dense group become one; every distinct vector goes to its `OVERLAP`
   nearest centres' shards, but for those where nothing nearest to the centre can be in range. A shard above `CAP` vectors is dealt into blocks, and each two blocks
   are a group of their own, so no group is larger than that and none is searched in part.
2. Graph: within a group each vector's nearest ones are pruned (a candidate that is nearer to a
   chosen neighbour, by the factor ALPHA, than to the vector is dropped) and edges get their
   reverse. A vector's adjacency lists from all its groups are united.
3. Search: within a group, from its medoid, each vector walks greedily over the united lists with
   a beam; from what it finds in range the search expands over neighbours until no new one is in
   range.
4. Verification: cosines of what was found in double precision give each group's components; an exact check
   of each component's own pairs follows, so that none within one is lost. A pair that shares several shards
   is counted in the first of them alone.

Equal vectors are one node with a count, so copies are not expanded into pairs.

`audit` measures recall against brute force on a bounded set of queries.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link
with nothing, as do rows without a vec_id; vectors link with vectors of their own length only (a shard
holds one length); rows that share a vec_id are separate vectors that count each; an empty table gives none; other columns,
labels among them, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scoped, small, written
from .components import components
from .minhash import groups

THRESHOLD = 0.9
#: Vectors of a shard to aim at, shards that a vector is in, and the most of a group.
SHARD, OVERLAP, CAP = 1500, 6, 5000
SAMPLE_ROWS, MOST_CENTRES, SEED = 20_000, 4096, 11
#: Centres nearer than this become one if such a share of the pairs of their sampled vectors (so many of each) links.
MERGED, LINKED_SHARE, LINKED_OF = 0.9, 0.02, 200
#: What the length counts in a shard's number.
LENGTH = 1 << 20
#: Candidates, edges before their reverses, pruning factor, beam.
CANDIDATES, DEGREE, ALPHA, BEAM = 48, 16, 1.2, 24
#: Nearest ones that pruning never drops, and edges with the reverse ones.
NEAREST, WIDEST = 6, 64
#: Pairs of a step of a search.
STEP = 400_000


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centres(sample: np.ndarray, n: int, turns: int = 6, seed: int = SEED) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    n = max(1, min(n, len(sample)))
    found = sample[rng.choice(len(sample), n, replace=False)]
    for _ in range(turns):
        near = np.concatenate([(sample[k : k + 2000] @ found.T).argmax(1) for k in range(0, len(sample), 2000)])
        total = np.zeros_like(found)
        np.add.at(total, near, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        found = np.where(size > 1e-9, total / np.maximum(size, 1e-9), found)
    return found


def pruned(x: np.ndarray) -> np.ndarray:
    """[n, WIDEST] neighbours of a robust-pruned graph with reverse edges; -1 fills up."""
    n = len(x)
    k = min(CANDIDATES, n - 1)
    near = np.empty((n, k), np.int64)
    for lo in range(0, n, 1024):
        close = x[lo : lo + 1024] @ x.T
        close[np.arange(len(close)), np.arange(lo, lo + len(close))] = -2
        top = np.argpartition(-close, k - 1, axis=1)[:, :k]
        near[lo : lo + 1024] = np.take_along_axis(top, np.argsort(-np.take_along_axis(close, top, 1), axis=1, kind="stable"), 1)
    out = np.full((n, WIDEST), -1, np.int64)
    for lo in range(0, n, 256):
        own, mine = near[lo : lo + 256], x[lo : lo + 256]
        vectors = x[own]
        far = 1 - np.einsum("qkd,qd->qk", vectors, mine)
        between = 1 - np.einsum("qkd,qjd->qkj", vectors, vectors)
        open_ = np.ones_like(own, bool)
        rows = np.arange(len(own))
        for step in range(DEGREE):
            some = open_.any(1)
            if not some.any():
                break
            pick = open_.argmax(1)
            out[lo + rows[some], step] = own[rows[some], pick[some]]
            open_ &= ~(ALPHA * between[rows, pick] <= far) | ~some[:, None] | (np.arange(k) < NEAREST)
            open_[rows[some], pick[some]] = False
    # reverse edges in the places left, as far as they go
    a, b = np.nonzero(out >= 0)
    to, of = out[a, b], a
    order = np.argsort(to, kind="stable")
    to, of = to[order], of[order]
    used = (out >= 0).sum(1)
    first = np.searchsorted(to, np.arange(n))
    place = used[to] + np.arange(len(to)) - first[to]
    fits = place < out.shape[1]
    out[to[fits], place[fits]] = of[fits]
    return out


def reached(fresh: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """[queries, n] whether an edge leads there from a node that is fresh for the query."""
    out = np.zeros_like(fresh)
    for k, own in enumerate(fresh):
        if own.any():
            out[k, edges[own]] = True  # places without an edge are -1, the last node
    last = (edges == fresh.shape[1] - 1).any(1)
    out[:, -1] = (fresh & last).any(1)
    return out


def searched(x: np.ndarray, edges: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, found) pairs in range, other than a query itself, by beam search and range expansion."""
    n, beam = len(x), min(BEAM, len(x))
    whole = x.mean(0)
    medoid = int((x @ whole).argmax())
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for lo in range(0, n, 1024):
        q = np.arange(lo, min(n, lo + 1024))
        seen = np.zeros((len(q), n), bool)
        hit = np.zeros((len(q), n), bool)
        ids = np.full((len(q), beam), -1, np.int64)
        near = np.full((len(q), beam), -2.0)
        done = np.ones((len(q), beam), bool)
        ids[:, 0], near[:, 0], done[:, 0] = medoid, x[q] @ x[medoid], False
        seen[:, medoid] = True
        while True:
            active = np.flatnonzero(~done.all(1))
            if not len(active):
                break
            pick = np.where(done[active], -3.0, near[active]).argmax(1)
            done[active, pick] = True
            around = edges[ids[active, pick]]
            fresh = around >= 0
            fresh[fresh] = ~seen[active[np.nonzero(fresh)[0]], around[fresh]]
            r, c = np.nonzero(fresh)
            got = around[r, c]
            seen[active[r], got] = True
            close = np.full(around.shape, -2.0)
            close[r, c] = np.einsum("kd,kd->k", x[got], x[q[active[r]]])
            all_ids = np.concatenate([ids[active], np.where(fresh, around, -1)], 1)
            all_near = np.concatenate([near[active], close], 1)
            all_done = np.concatenate([done[active], ~fresh], 1)
            inside = close >= least
            hit[active[np.nonzero(inside)[0]], around[inside]] = True
            top = np.argpartition(-all_near, beam - 1, axis=1)[:, :beam]
            ids[active], near[active], done[active] = (np.take_along_axis(v, top, 1) for v in (all_ids, all_near, all_done))
        hit[np.arange(len(q)), q] = True  # a query's own edges expand too
        seen |= hit
        fresh = hit.copy()
        while fresh.any():
            around = reached(fresh, edges) & ~seen
            seen |= around
            fresh = np.zeros_like(hit)
            r, c = np.nonzero(around)
            for k in range(0, len(r), STEP):  # each node is compared with a query once
                who, at = r[k : k + STEP], c[k : k + STEP]
                inside = np.einsum("kd,kd->k", x[at], x[q[who]]) >= least
                fresh[who[inside], at[inside]] = True
            hit |= fresh
        hit[np.arange(len(q)), q] = False
        r, c = np.nonzero(hit)
        pairs.append((q[r], c))
    return np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least reachable number of each of n nodes."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def can_link(vector):
    """Whether a vector may link: it has components, all finite, not all zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(F.when(F.size(vector) > 0, finite & F.exists(vector, lambda v: v != 0)), F.lit(False))


def plain(vectors: DataFrame) -> DataFrame:
    """vec_id, vector (double, null where it cannot link) of every row."""
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("vector"))
    # 0.0 and -0.0 are equal
    same = F.transform("vector", lambda v: F.when(v == 0, 0.0).otherwise(v))
    return rows.select("vec_id", F.when(F.col("vec_id").isNotNull() & can_link(F.col("vector")), same).alias("vector"))


def usable(vectors: DataFrame) -> DataFrame:
    return plain(vectors).where("vector IS NOT NULL")


def nodes_of(vectors: DataFrame) -> DataFrame:
    """first (least vec_id), vector, n of every distinct vector."""
    return written(usable(vectors).groupBy("vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("n")).select("first", "vector", "n"))


def even(lists: pa.Array, width: int) -> np.ndarray:
    """Unit vectors of the lists' first `width` numbers, zeros after a shorter one's end."""
    flat, lengths = lists.flatten().to_numpy(zero_copy_only=False), np.asarray(lists.value_lengths())
    begins = np.cumsum(lengths) - lengths
    out = np.zeros((len(lengths), width))
    for length in np.unique(lengths):
        own, most = np.flatnonzero(lengths == length), min(int(length), width)
        out[own, :most] = flat[begins[own][:, None] + np.arange(most)]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def apart(found: np.ndarray, sample: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """The centres without those that stand for the same dense group as a centre with more of the sample: near it, and
    a good share of the sampled vectors of both link. So a dense group has one shard (dealt into blocks if it is large)."""
    near = np.concatenate([(sample[k : k + 2000] @ found.T).argmax(1) for k in range(0, len(sample), 2000)])
    counts = np.bincount(near, minlength=len(found))
    order = np.argsort(near, kind="stable")
    ends = np.cumsum(counts)
    own = [sample[order[max(end - n, end - LINKED_OF) : end]] for n, end in zip(counts, ends, strict=True)]
    kept: list[int] = []
    for k in np.argsort(-counts, kind="stable"):
        close = found[kept] @ found[k] if kept else np.zeros(0)
        best = np.argsort(-close)[:3]
        if not any(close[b] >= MERGED and len(own[k]) and (own[k] @ own[kept[b]].T >= threshold).mean() >= LINKED_SHARE for b in best):
            kept.append(int(k))
    return found[kept]


def reaches(nodes: DataFrame, centre: np.ndarray, width: int, threshold: float) -> np.ndarray:
    """For each centre the cosine below which a vector can link with none of those nearest to that centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.ones(len(centre))
        for batch in batches:
            for lo in range(0, len(batch), 2000):
                close = even(batch.column(0).slice(lo, 2000), width) @ centre.T
                np.minimum.at(least, close.argmax(1), close.max(1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centre))), pa.array(least)], names=["centre", "least"])

    least = np.ones(len(centre))
    for k, v in nodes.select("vector").mapInArrow(run, "centre long, least double").groupBy("centre").agg(F.min("least")).collect():  # a row a centre
        least[k] = v
    angle = np.arccos(np.clip(least, -1, 1)) + np.arccos(threshold) + 1e-6
    return np.where(angle < np.pi, np.cos(np.minimum(angle, np.pi)), -2.0)


def dealt(nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """shard (by length and centre), i, j, block, first, vector, n, shards (-1 fills up): the groups' members."""
    total = nodes.count()
    n = max(1, min(MOST_CENTRES, round(total * OVERLAP / SHARD)))
    chosen = nodes.orderBy(F.xxhash64("first"), "first").limit(SAMPLE_ROWS).select("first", "vector").collect()  # SAMPLE_ROWS at most
    lists = pa.array([r["vector"] for r in sorted(chosen, key=lambda r: r["first"])], pa.list_(pa.float64()))
    width = max(map(len, lists.to_pylist()), default=1)
    sample = even(lists, width) if chosen else np.zeros((1, width))
    centre = apart(centres(sample, n), sample, threshold)
    overlap, least = min(OVERLAP, len(centre)), reaches(nodes, centre, width, threshold)
    schema = nodes.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 2000):
                part = batch.slice(lo, 2000)
                close = even(part.column(1), width) @ centre.T
                top = np.sort(np.argpartition(-close, overlap - 1, axis=1)[:, :overlap], axis=1)
                near = np.take_along_axis(close, top, 1)
                useful = (near >= least[top]) | (near == near.max(1, keepdims=True))
                top = np.where(useful, top + np.asarray(part.column(1).value_lengths()).astype(np.int64)[:, None] * LENGTH, -1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * overlap), pa.array(top.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*schema.names, "shards"])

    placed = nodes.mapInArrow(run, "first long, vector array<double>, n long, shards array<long>")
    members = written(placed.select("first", "vector", "n", "shards", F.explode("shards").alias("shard")).where("shard >= 0"))
    sizes = small(written(members.groupBy("shard").agg(F.ceil(F.count("*") / (CAP // 2)).cast("int").alias("half"), F.count("*").alias("size"))))
    blocks = F.when(F.col("size") <= CAP, 1).otherwise(F.col("half"))
    block = F.pmod(F.xxhash64("first"), F.col("blocks")).cast("int")
    spread = members.join(sizes, "shard").withColumn("blocks", blocks).withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return spread.select("shard", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "first", "vector", "n", "shards")


def by_group(rows: DataFrame) -> DataFrame:
    return rows.repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j", "first")


def matrix(group: pa.Table) -> np.ndarray:
    return unit(group["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(group), -1))


def built(rows: DataFrame) -> DataFrame:
    """first, neighbours of every vector: its adjacency lists of all groups united."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 3):
            if len(group) < 2:
                continue
            ids, edges = group["first"].to_numpy(), pruned(matrix(group))
            filled = edges >= 0
            offsets = np.concatenate([[0], np.cumsum(filled.sum(1))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[edges[filled]]))], names=["first", "neighbours"])

    lists = by_group(rows).select("shard", "i", "j", "first", "vector").mapInArrow(run, "first long, neighbours array<long>")
    return lists.groupBy("first").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours"))  # a list for each group it is in


def counted(x: np.ndarray, root: np.ndarray, shards: np.ndarray, shard: int, block: np.ndarray | None, weight: np.ndarray, threshold: float) -> np.ndarray:
    """Links of each vector that this group counts: all those within the components that the search found, by an exact
    check, of pairs that share no earlier shard (there they are counted) and, with blocks, are in different ones."""
    count = np.zeros(len(x), np.int64)
    order = np.argsort(root, kind="stable")
    for members in np.split(order, np.flatnonzero(np.diff(root[order])) + 1):
        if len(members) < 2:
            continue
        own, earlier = x[members], np.where(shards[members] < shard, shards[members], -1)
        names, place = np.unique(earlier, return_inverse=True)
        within = np.zeros((len(members), len(names)), np.float32)
        within[np.arange(len(members))[:, None], place.reshape(earlier.shape)] = 1
        within[:, names == -1] = 0
        for lo in range(0, len(members), 512):
            close = own[lo : lo + 512] @ own.T
            p, q = np.nonzero(np.abs(close - threshold) < 1e-9)  # products of matrices may round otherwise
            close[p, q] = np.einsum("kd,kd->k", own[lo + p], own[q])
            mine = (close >= threshold) & (within[lo : lo + 512] @ within.T == 0)
            mine[np.arange(len(mine)), lo + np.arange(len(mine))] = False
            if block is not None:
                mine &= block[members[lo : lo + 512]][:, None] != block[members][None, :]
            count[members[lo : lo + 512]] = mine @ weight[members]
    return count


def found(rows: DataFrame, graph: DataFrame, threshold: float) -> DataFrame:
    """first, links (by number of vectors), root: of each vector in each group in which it has links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 3):
            n = len(group)
            if n < 2:
                continue
            x, ids = matrix(group), group["first"].to_numpy()
            lists = group["neighbours"].combine_chunks()
            lengths = np.asarray(lists.value_lengths().fill_null(0))
            own, to = np.repeat(np.arange(n), lengths), lists.flatten().to_numpy(zero_copy_only=False)
            order = np.argsort(ids)
            at = order[np.minimum(np.searchsorted(ids[order], to), n - 1)]
            here = ids[at] == to  # the united lists' members of this group
            own, at = own[here], at[here]
            counts = np.bincount(own, minlength=n)
            edges = np.full((n, max(1, int(counts.max()))), -1, np.int64)
            edges[own, np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)] = at
            a, b = searched(x, edges, threshold - 1e-9)
            parts = [np.einsum("kd,kd->k", x[a[lo : lo + STEP]], x[b[lo : lo + STEP]]) >= threshold for lo in range(0, len(a), STEP)]
            linked = np.concatenate([*parts, np.zeros(0, bool)])
            root = local_components(n, a[linked], b[linked])
            i, j, block = group["i"][0].as_py(), group["j"][0].as_py(), group["block"].to_numpy()
            shards = group["shards"].combine_chunks().flatten().to_numpy().reshape(n, -1)
            count = counted(x, root, shards, group["shard"][0].as_py(), block if i != j else None, group["n"].to_numpy(), threshold)
            some = np.flatnonzero(np.bincount(root, minlength=n)[root] > 1)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(count[some]), pa.array(ids[root[some]])], names=["first", "links", "root"])

    joined = rows.join(graph, "first", "left")
    columns = ["shard", "i", "j", "block", "first", "vector", "n", "shards", "neighbours"]
    return by_group(joined.select(*columns)).mapInArrow(run, "first long, links long, root long")


@scoped
def links(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    nodes = nodes_of(vectors)
    rows = written(dealt(nodes, threshold))
    graph = written(built(rows))
    parts = written(found(rows, graph, threshold))
    own = parts.groupBy("first").agg(F.sum("links").alias("links"))
    named = components(parts.select(F.col("first").alias("a"), F.col("root").alias("b")))
    known = nodes.join(own, "first", "left").join(named.select(F.col("id").alias("first"), "component"), "first", "left")
    known = known.select("vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "first").alias("component_id"))
    both = plain(vectors).join(known, "vector", "left")
    done = both.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return done.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def audit(vectors: DataFrame, result: DataFrame, queries: int = 200, threshold: float = THRESHOLD) -> float:
    """Recall of n_links: what `result` has over what brute force finds, for so many vectors of least hash of the commonest length."""
    good = usable(vectors)
    length = good.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), "length").first()
    if not length:
        return 1.0
    good = good.where(F.size("vector") == length["length"])
    chosen = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(queries).collect()  # `queries` at most
    ids, x = np.array([r["vec_id"] for r in chosen], np.int64), unit(np.array([r["vector"] for r in chosen], float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            if len(batch):
                near = x @ unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)).T
                total += (near >= threshold).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["vec_id", "near"])

    near = good.select("vec_id", "vector").mapInArrow(run, "vec_id long, near long").groupBy("vec_id").agg((F.sum("near") - 1).alias("near"))
    both = near.join(result.select("vec_id", "n_links"), "vec_id").agg(F.sum("near").alias("near"), F.sum("n_links").alias("found")).first()
    return 1.0 if not both["near"] else both["found"] / both["near"]
