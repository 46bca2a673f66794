"""The WAV source against whole reads and the standard library's module; the sink's commits."""

import os
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from waveframe.operators import spectral
from waveframe.sources import readers, wav

RNG = np.random.default_rng(11)


def put(path, x, rate=44100, bits=16):
    """x: [channels, n], by the standard library."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with wave.open(str(path), "wb") as w:
        w.setnchannels(len(x))
        w.setsampwidth(bits // 8)
        w.setframerate(rate)
        w.writeframes(wav.encoded(x, bits))


def whole(df):
    out = {}
    for r in df.orderBy("path", "ch", "chunk").collect():
        out.setdefault((os.path.basename(r["path"]), r["ch"]), []).append((r["start"], np.array(r["samples"]), r["rate"]))
    for parts in out.values():
        assert [s for s, _, _ in parts] == np.cumsum([0] + [len(x) for _, x, _ in parts]).tolist()[:-1]
    return {k: np.concatenate([x for _, x, _ in parts]) for k, parts in out.items()}


@pytest.fixture
def library(tmp_path):
    put(tmp_path / "in" / "a.wav", RNG.uniform(-1, 1, (2, 5000)))
    put(tmp_path / "in" / "sub dir" / "b.WAV", RNG.uniform(-1, 1, (1, 1234)), 48000, 24)
    put(tmp_path / "in" / "c.wav", np.zeros((2, 0)))
    put(tmp_path / "in" / "d.wav", RNG.uniform(-1, 1, (3, 1000)), 8000, 8)
    put(tmp_path / "in" / "_staging-x" / "e.wav", np.zeros((2, 10)))
    return str(tmp_path / "in")


@pytest.mark.parametrize("rate", [None, 44100])
@pytest.mark.parametrize("split", [1000, 1 << 20])
def test_ranges_equal_the_whole_file(spark, library, rate, split):
    df = wav.read(spark, library, rate, chunk=128, split=split)
    got = whole(df)
    assert {k for k, _ in got} == {"a.wav", "b.WAV", "c.wav", "d.wav"}
    for folder, name in (("", "a.wav"), ("sub dir", "b.WAV"), ("", "c.wav"), ("", "d.wav")):
        x, own = readers.decode_wav(open(os.path.join(library, folder, name), "rb").read())
        x = np.vstack([x, x]) if len(x) == 1 else x
        for ch, c in enumerate(x):
            want = spectral.resampled(c, own, rate) if rate and own != rate else c
            assert np.array_equal(got[name, ch], want)
    if split == 1000:
        assert df.rdd.getNumPartitions() > 20


def test_empty_folder_has_no_rows(spark, tmp_path):
    assert wav.read(spark, str(tmp_path)).count() == 0


def test_chunks_are_read_by_one_range_each(spark, library):
    counts = wav.read(spark, library, chunk=100, split=777).groupBy("path", "ch", "chunk").count().where("count > 1").count()
    assert counts == 0


def test_other_headers(spark, tmp_path):
    x = RNG.uniform(-1, 1, 50).astype("<f4")
    extra = b"LIST" + struct.pack("<I", 3) + b"abc\0"
    form = struct.pack("<HHIIHH", 3, 1, 44100, 176400, 4, 32)
    body = b"WAVE" + extra + b"fmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", 0xFFFFFFFF) + x.tobytes() + b"\0"
    (tmp_path / "f.wav").write_bytes(b"RIFF" + struct.pack("<I", len(body)) + body)
    sub = struct.pack("<HHIIHHHHIH", 0xFFFE, 1, 44100, 88200, 2, 16, 22, 16, 4, 1) + bytes(14)
    data = struct.pack("<4h", 0, 1 << 14, -(1 << 15), 5)
    sizes = b"ds64" + struct.pack("<IQQQI", 28, 0, len(data), 4, 0)
    (tmp_path / "g.wav").write_bytes(b"RF64" + struct.pack("<I", 0xFFFFFFFF) + b"WAVE" + sizes + b"fmt " + struct.pack("<I", 40) + sub + b"data" + struct.pack("<I", 0xFFFFFFFF) + data)
    got = whole(wav.read(spark, str(tmp_path)))
    assert np.array_equal(got["f.wav", 0], x.astype(float)) and np.array_equal(got["f.wav", 1], x.astype(float))
    assert np.array_equal(got["g.wav", 0], [0.0, 0.5, -1.0, 5 / (1 << 15)])


@pytest.mark.parametrize("content", [b"", b"RIFF", b"nothing at all", b"RIFF\0\0\0\0WAVEdata\0\0\0\0", b"RIFF\0\0\0\0WAVEfmt \x10\0\0\0" + struct.pack("<HHIIHH", 85, 1, 1, 1, 1, 0) + b"data\0\0\0\0"])
def test_bad_file_is_named(spark, tmp_path, content):
    (tmp_path / "bad.wav").write_bytes(content or b"x")
    with pytest.raises(Exception, match="bad.wav"):
        wav.read(spark, str(tmp_path)).collect()


def frames(spark, lengths, size=64, channels=2):
    rows = [(k, ch, c, RNG.uniform(-1, 1, min(size, n - c * size)).tolist()) for k, n in lengths.items() for ch in range(channels) for c in range(max(1, -(-n // size)))]
    return spark.createDataFrame(rows, "path string, ch int, chunk long, samples array<double>").cache()


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
def test_sink_leaves_files_that_the_standard_library_reads(spark, tmp_path, bits):
    held = frames(spark, {"a.wav": 200, "sub/b.wav": 64, "c.wav": 1, "d.wav": 0}, channels=3 if bits == 24 else 2)
    wav.write(held, str(tmp_path), 22050, bits, size=64)
    assert sorted(os.path.relpath(os.path.join(d, f), tmp_path) for d, _, fs in os.walk(tmp_path) for f in fs) == ["a.wav", "c.wav", "d.wav", "sub/b.wav"]
    for name, n in {"a.wav": 200, "sub/b.wav": 64, "c.wav": 1, "d.wav": 0}.items():
        parts = {}
        for r in held.where(F.col("path") == name).orderBy("chunk").collect():
            parts.setdefault(r["ch"], []).extend(r["samples"])
        x = np.array([parts[ch] for ch in sorted(parts)]).reshape(len(parts), -1)
        with wave.open(str(tmp_path / name)) as w:
            assert (w.getframerate(), w.getsampwidth(), w.getnchannels(), w.getnframes()) == (22050, bits // 8, len(parts), n)
        back, _ = readers.decode_wav((tmp_path / name).read_bytes())
        assert back.shape == x.shape and np.abs(back - x).max(initial=0) <= 1.01 / (1 << (bits - 1))


def test_failed_job_leaves_nothing_and_old_files_stay(spark, tmp_path):
    wav.write(frames(spark, {"old.wav": 10}), str(tmp_path), 8000)
    before = (tmp_path / "old.wav").read_bytes()
    held = frames(spark, {f"{k}.wav": 100 for k in range(20)} | {"old.wav": 50}, size=64)
    bad = held.withColumn("samples", F.when((F.col("path") == "7.wav") & (F.col("chunk") == 1), F.raise_error(F.lit("lost")).cast("array<double>")).otherwise(F.col("samples")))
    with pytest.raises(Exception, match="lost"):
        wav.write(bad, str(tmp_path), 8000, size=64)
    assert os.listdir(tmp_path) == ["old.wav"] and (tmp_path / "old.wav").read_bytes() == before


def test_channels_that_differ_are_an_error(spark, tmp_path):
    rows = [("a.wav", 0, 0, [0.1, 0.2]), ("a.wav", 1, 0, [0.1])]
    with pytest.raises(Exception, match="don't fit"):
        wav.write(spark.createDataFrame(rows, "path string, ch int, chunk long, samples array<double>"), str(tmp_path), 8000)
    assert os.listdir(tmp_path) == []


def test_overwrite_replaces_the_folder(spark, tmp_path):
    wav.write(frames(spark, {"a.wav": 10, "x/b.wav": 10}), str(tmp_path), 8000)
    wav.write(frames(spark, {"a.wav": 30}), str(tmp_path), 8000, mode="overwrite")
    assert [f for _, _, fs in os.walk(tmp_path) for f in fs] == ["a.wav"]
    assert whole(wav.read(spark, str(tmp_path)))["a.wav", 1].shape == (30,)


def test_header_beyond_four_gigabytes_is_read_back(tmp_path):
    n = 3 << 30
    (tmp_path / "l.wav").write_bytes(wav.made_header(n, 2, 44100, 16))
    os.truncate(tmp_path / "l.wav", 80 + 4 * n)  # sparse
    with open(tmp_path / "l.wav", "rb") as f:
        assert wav.header_of(f, 80 + 4 * n) == wav.Header(80, n, 2, 44100, 2, False)


def test_small_files_share_batches_and_tasks_open_few(tmp_path):
    for k in range(1100):
        put(tmp_path / f"{k}.wav", np.full((1, 70), k / 2000))
    reader = wav.WavReader({"path": str(tmp_path), "chunk": "32"})
    parts = reader.partitions()
    assert max(len(p.ranges) for p in parts) <= 1024 and sum(len(p.ranges) for p in parts) == 1100
    batches = [b for p in parts for b in reader.read(p)]
    assert len(batches) < 10 and sum(b.num_rows for b in batches) == 1100 * 2 * 3
    found = {(r["path"].rsplit("/", 1)[-1], r["ch"], r["chunk"]): (r["start"], len(r["samples"]), r["samples"][0]) for b in batches for r in b.to_pylist()}
    assert all(found[f"{k}.wav", ch, c][:2] == (32 * c, (32, 32, 6)[c]) and abs(found[f"{k}.wav", ch, c][2] - k / 2000) < 1e-4 for k in range(1100) for ch in (0, 1) for c in range(3))
