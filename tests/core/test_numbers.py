"""Rounding by exact values against Python's round, and free names against a search one by one."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from waveframe.functions.numbers import round_exact
from waveframe.operators import catalog, incremental, jobs


def values():
    rng = random.Random(3)
    out = [0.0, -0.0, 0.5, 1.5, 2.5, -0.5, 2.675, 1.005, 0.125, 0.375, -0.125, 1e15 + 0.3, 2.0**52 + 0.5, 2.0**53, 1e300, -1e300, 5e-324, float("inf"), float("nan"), 4503599627370495.5, 45035996273.704945, 0.1 + 0.2]
    out += [k / 8 for k in range(-4000, 4000)] + [k / 1000 for k in range(0, 40000, 5)] + [round(k / 100 + 0.005, 3) for k in range(20000)]
    out += [rng.uniform(-1000, 1000) for _ in range(30000)] + [rng.uniform(-1, 1) * 10.0 ** rng.randint(-12, 17) for _ in range(30000)]
    return out + [x for x in (struct.unpack("<d", rng.randbytes(8))[0] for _ in range(5000)) if math.isfinite(x)]


@pytest.mark.parametrize("places", [0, 1, 2, 4, 5, 9])
def test_equals_pythons_round(spark, places):
    held = values()
    rows = spark.createDataFrame(list(enumerate(held)), "k long, x double").select("k", round_exact(F.col("x"), places).alias("r")).collect()
    bad = [(held[r["k"]], r["r"]) for r in rows if repr(r["r"]) != repr(float(round(held[r["k"]], places)) if math.isfinite(held[r["k"]]) else held[r["k"]])]
    assert not bad, bad[:5]


def test_null_stays_and_places_are_bounded(spark):
    assert spark.sql("SELECT CAST(NULL AS DOUBLE) AS x").select(round_exact(F.col("x"), 2)).first()[0] is None
    with pytest.raises(ValueError):
        round_exact(F.lit(1.0), 30)


def stored(names, there):
    """One by one: a name's first file keeps it if it is free, the others look for a number."""
    taken = set(there) | set(names)
    out, seen = [], set()
    for name in names:
        if name not in there and name not in seen:
            out.append(name)
        else:
            stem, dot, ext = name.rpartition(".")
            k = 1
            while f"{stem}_{k}{dot}{ext}" in taken:
                k += 1
            taken.add(f"{stem}_{k}{dot}{ext}")
            out.append(f"{stem}_{k}{dot}{ext}")
        seen.add(name)
    return out


def test_free_names_fill_gaps_and_never_clash(spark):
    rng = random.Random(1)
    for _ in range(4):
        pool = ["a.wav", "a_1.wav", "a_1_1.wav", "a_2.wav", "a_10.wav", "b.mp3", "a_01.wav", "a_0.wav", "c_1.wav"]
        names = [rng.choice(pool) for _ in range(25)]
        there = rng.sample([*pool, "a_3.wav", "a_5.wav", "b_1.mp3", "c_1_1.wav"], 6)
        files = spark.createDataFrame(list(enumerate(names)), "k long, name string")
        got = [r["stored"] for r in catalog.free_names(files, spark.createDataFrame([(x,) for x in there], "name string"), "k").orderBy("k").collect()]
        assert got == stored(names, there)
        assert len(set(got)) == len(got) and not set(got) & set(there)


def test_free_names_of_nothing(spark):
    files = spark.createDataFrame([], "k long, name string")
    none = spark.createDataFrame([], "name string")
    assert catalog.free_names(files, none, "k").count() == 0
    one = spark.createDataFrame([(1, "a_1.wav"), (2, "a_3.wav")], "k long, name string")
    assert sorted(r["stored"] for r in catalog.free_names(one, none, "k").collect()) == ["a_1.wav", "a_3.wav"]


def test_roots_with_excluded_names_above_them(spark):
    rows = [(f"{at}/{p}", 1, False) for at in ("/data/output", "/srv/models/x") for p in ("input/a.wav", "input/models/b.wav", "input/lib/c.wav", "input/q/d.wav")]
    files = spark.createDataFrame(rows, "path string, size long, top boolean")
    for root in ("/data/output", "file:/srv/models/x/", "file:///srv/models/x"):
        own = files.where(F.col("path").startswith(root.replace("file:", "").replace("///", "/").rstrip("/")))
        assert sorted(r["name"] for r in catalog.discover(own, root=root).collect()) == ["a.wav", "d.wav"]


def test_of_two_listings_the_tree_goes_first(spark):
    tree = spark.createDataFrame([("/r/input/z/a.wav", 5)], "path string, size long")
    root = spark.createDataFrame([("/r/a.wav", 5), ("/r/b.wav", 5)], "path string, size long")
    got = catalog.discover(catalog.both_listings(tree, root), root="/r")
    assert sorted(r["path"] for r in got.collect()) == ["/r/b.wav", "/r/input/z/a.wav"]


def test_present_models_and_ids(spark):
    models = spark.createDataFrame([("x.onnx", "X"), ("y.ckpt", "Y"), ("z.txt", "Z"), ("w.onnx", "W")], "file string, tag string")
    files = spark.createDataFrame([("/m/x.onnx",), ("/m/sub/y.ckpt",), ("/m/z.txt",)], "path string")
    assert sorted(r["tag"] for r in incremental.present_models(models, files).collect()) == ["X", "Y", "Z"]
    assert sorted(r["tag"] for r in incremental.present_models(models, files, (".onnx",)).collect()) == ["X"]
    ids = [r[0] for r in spark.range(200).select(jobs.new_id()).collect()]
    assert len(set(ids)) == 200 and all(len(i) == 12 and int(i, 16) >= 0 for i in ids)
