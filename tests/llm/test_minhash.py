"""ProbMinHash near-dedup against brute force."""

import itertools
import random

import numpy as np
import pyarrow as pa

from waveframe.llm import common, minhash


def weights(text):
    runs, counts = minhash.weighted_runs(pa.array([text.lower()], pa.large_string()))[1:]
    return dict(zip(runs.tolist(), counts.tolist(), strict=True))


def similarity(x, y):
    """Probability Jaccard by its definition."""
    total = 0.0
    for i in x.keys() & y.keys():
        total += 1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys())
    return total


def brute(rows, threshold=0.8):
    texts = {}
    for i, t in rows:
        if i is not None and t and t.split():
            texts.setdefault(t.lower(), []).append(i)
    keys = list(texts)
    parent = list(range(len(keys)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [weights(k) for k in keys]
    for a, b in itertools.combinations(range(len(keys)), 2):
        if len(sets[a].keys() & sets[b].keys()) and plain(sets[a], sets[b]) >= threshold - 1e-9:
            parent[find(b)] = find(a)
    least = {}
    for k in range(len(keys)):
        least[find(k)] = min(least.get(find(k), 1 << 62), min(texts[keys[k]]))
    return {i: least[find(k)] for k, key in enumerate(keys) for i in texts[key]}


def plain(x, y):
    """The same; where no run repeats it is the Jaccard of sets."""
    if max(*x.values(), *y.values()) == 1:
        return len(x.keys() & y.keys()) / len(x.keys() | y.keys())
    return similarity(x, y)


def test_similarity_matches_its_definition():
    rng = random.Random(7)
    texts = [" ".join(rng.choices("ab", k=n)) for n in (3, 5, 30, 60)] + ["a b c d e f g h", "a b c d e f g x", "one", ""]
    held = minhash.Runs(pa.array(texts, pa.large_string()))
    each = [weights(t) for t in texts]
    for i in range(len(texts)):
        got = held.similarities(i, np.arange(len(texts)))
        assert np.allclose(got, [similarity(each[i], y) for y in each])
        assert not each[i] or not any(each) or np.allclose(got, [plain(each[i], y) if y else 0 for y in each])


def test_registers_agree_as_often_as_the_similarity():
    rng = np.random.default_rng(1)
    n = 60
    row, run, weight, want = [], [], [], []
    for k in range(n):
        base = rng.integers(1, 1 << 60, 40).astype(np.uint64)
        other = base.copy()
        other[: rng.integers(0, 30)] = rng.integers(1, 1 << 60, 1)[0]
        for side, part in enumerate((base, other)):
            values, counts = np.unique(part, return_counts=True)
            row += [2 * k + side] * len(values)
            run += values.tolist()
            weight += counts.tolist()
        want.append(similarity(*[dict(zip(*(u.tolist() for u in np.unique(p, return_counts=True)), strict=True)) for p in (base, other)]))
    kept = minhash.signatures(np.array(row), np.array(run, np.uint64), np.array(weight, float), 2 * n)
    got = (kept[::2] == kept[1::2]).mean(1)
    assert abs(got - want).mean() < 0.04 and abs(np.mean(got - want)) < 0.01


def test_classes_match_brute_force(spark):
    random.seed(3)
    words = [f"w{i}" for i in range(400)]
    rows, k = [], 0
    for group in range(12):
        base = random.choices(words, k=120)
        for _ in range(25 if group else 140):  # one group is large, with weak links in it
            text = base[:]
            for _ in range(random.randint(0, 4)):
                text[random.randrange(120)] = random.choice(words)
            rows.append((k := k + 1, " ".join(text)))
    rows += [(1001, None), (1002, ""), (1003, "  "), (1004, "one two"), (1005, "ONE two"), (None, "one two"), (1006, rows[0][1]), (rows[0][0], rows[0][1])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string")
    got = minhash.classes(docs).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] in want} == want
    assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] in (1001, 1002, 1003, None)} == {1001: 1001, 1002: 1002, 1003: 1003, None: None}
    left = minhash.dedup(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect() if r["doc_id"] is not None) == sorted({*want.values(), 1001, 1002, 1003})


def links(keys, texts, sketch=None, label=None, block=None, own=(0, 0), band=5000):
    n = len(texts)
    sketch = np.zeros((n, minhash.REGISTERS), np.uint8) if sketch is None else sketch
    label = np.arange(n) if label is None else np.array(label)
    block = np.zeros(n, int) if block is None else np.array(block)
    return minhash.found_links(np.arange(1, n + 1), sketch, np.array(keys), pa.array(texts, pa.large_string()), label, block, own, band, 0.8)


def test_equal_bytes_elsewhere_hide_no_pair():
    # documents 1 and 2 agree in all bytes, though they share one bucket only
    alike = ["a b c d e f"] * 3
    assert len(links([[1, 5000], [2, 5000], [3, 5000]], alike)) == 2
    # 1 and 2 share two buckets, and are left to the first; one label is not searched within
    keys = [[7, 5000], [7, 5000], [6, 5000]]
    assert links(keys, alike) == [(1, 3), (2, 3)] and links(keys, alike, band=7, label=[0, 1, 2]) == [(1, 2)]
    assert links(keys, alike, label=[4, 4, 4]) == []
    assert links([[5000]] * 3, alike, block=[0, 0, 1], own=(0, 1)) == [(1, 3), (2, 3)]


def test_a_low_estimate_in_a_crowded_bucket_is_still_verified():
    # 150 of 216 registers agree: 3.9 standard deviations below 0.8, which pairs right at 0.8 reach now and then
    sketch = np.zeros((3, minhash.REGISTERS), np.uint8)
    sketch[1, 150:], sketch[2] = 1, 2
    assert links([[5000]] * 3, ["a b c d e f"] * 3, sketch) == [(1, 2)]


def test_a_large_loose_group_and_the_whole_small_table_match_brute_force(spark, sf_small):
    random.seed(5)
    words, rows = [f"v{i}" for i in range(300)], []
    base = random.choices(words, k=100)
    for k in range(300):  # one edit spoils five of 96 runs: pairs lie about 0.7 to 0.9
        text = base[:]
        for _ in range(random.randint(1, 2)):
            text[random.randrange(100)] = random.choice(words)
        rows.append((k, " ".join(text)))
    small = [(r["doc_id"] + 1000, r["text"]) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    for part in (rows, small):
        docs = spark.createDataFrame(part, "doc_id long, text string")
        want = brute(part)
        assert {r["doc_id"]: r["class_id"] for r in minhash.classes(docs).collect() if r["doc_id"] in want} == want


def test_texts_that_share_an_id_and_clashing_names(spark):
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (2, "g h i j k l m"), (5, "g h i j k l m"), (6, None), (6, None)]
    docs = spark.createDataFrame([(i, t, i, "x", "y", "z") for i, t in rows], "doc_id long, text string, gone_id long, GONE_ID_ string, first string, label string")
    assert sorted((r["doc_id"], r["class_id"], r["kept"]) for r in minhash.classes(docs).collect()) == [(1, 1, True), (2, 1, False), (2, 1, False), (5, 1, False), (6, 6, True), (6, 6, True)]
    left = minhash.dedup(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 6]


def test_no_table_is_left_but_the_result(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    docs = spark.createDataFrame([(i, f"a b c d e f {i // 2}") for i in range(20)], "doc_id long, text string")
    assert minhash.classes(docs).count() == 20
    assert len(list(tmp_path.glob("waveframe-*"))) == 1


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.classes(docs).count() == 0
    assert minhash.dedup(docs).count() == 0


def test_homes_of_partners():
    sketch = np.zeros((4, minhash.REGISTERS), np.uint8)
    sketch[3] = 9
    ids, homes = minhash.near_homes(sketch, np.array([1, 1, 2, 3]), np.array([7, 8, 8, 9]), np.zeros(4, int), (0, 0))
    assert sorted(zip(ids.tolist(), homes.tolist(), strict=True)) == [(0, 8), (1, 8), (2, 7), (2, 8)]
    ids, _ = minhash.near_homes(sketch, np.array([1, 1, 2, 3]), np.array([7, 8, 8, 9]), np.array([0, 1, 1, 0]), (0, 1))
    assert sorted(set(ids.tolist())) == [0, 2]


def test_a_loose_group_sends_a_text_once_for_each_block(spark, monkeypatch):
    random.seed(8)
    words, rows = [f"v{i}" for i in range(300)], []
    base = random.choices(words, k=100)
    for k in range(240):
        text = base[:]
        for _ in range(random.randint(1, 2)):
            text[random.randrange(100)] = random.choice(words)
        rows.append((k, " ".join(text)))
    docs, want = spark.createDataFrame(rows, "doc_id long, text string"), brute(rows)
    sizes, kept = [], minhash.written

    def counted(df):
        out = kept(df)
        if set(out.columns) == {"doc_id", "label", "home", "h", "k"}:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(minhash, "written", counted)
    for block, copies in ((1024, 1.1), (60, 4.5)):  # 60: homes and buckets of several blocks each
        monkeypatch.setattr(minhash, "BLOCK", block)
        monkeypatch.setattr(minhash, "HOME", block)
        assert {r["doc_id"]: r["class_id"] for r in minhash.classes(docs).collect()} == want
        assert sizes.pop() <= copies * len(rows)
