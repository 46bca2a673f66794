"""Operators on the contract's worked examples and edges."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from waveframe.functions import text as X
from waveframe.operators import catalog, incremental, jobs, plugins, signal, spectral
from waveframe.plans.queries import peaks_files
from waveframe.sources import readers, writers
from waveframe.streaming import job_fold, job_states


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_slugify(spark):
    cases = {"a/My Song!.mp3": "My_Song", "x/.hidden.mp3": ".hidden", "b/..mp3": "..mp3", "Été è.wav": "t", "__a__.mp3": "a", "no_ext": "no_ext", "a.b.c.WAV": "a.b.c", "***.mp3": ""}
    assert column(spark, list(cases), X.slugify) == list(cases.values())


def test_sanitize(spark):
    cases = {"C:\\x\\My song?.mp3": "My song_.mp3", "": "upload", "...": "upload", "/a/b/": "upload", "x" * 300: "x" * 200}
    assert column(spark, list(cases), X.sanitize_filename) == list(cases.values())


def test_formats(spark):
    assert column(spark, [None, 0.0, 61.9, -3.0, float("nan")], X.fmt_time, "double") == ["--:--", "0:00", "1:01", "0:00", "--:--"]
    assert column(spark, [None, 0.5, 59.4, 119.6, 128.4], X.fmt_duration, "double") == ["—", "0.50s", "59s", "2m 00s", "2m 08s"]
    assert column(spark, [None, 59.0, 3661.0], X.fmt_elapsed, "double") == ["—", "0:59", "1:01:01"]


def test_fixed_decimals_round_the_scaled_double_as_sql(spark):
    values = [k / 1000 for k in range(0, 1000, 5)] + [148.48 / 1024, 1.005, -0.145, -2.5, 123456789.125]
    sql = duckdb.sql(f"SELECT printf('%.2f', round(unnest({values}::DOUBLE[]), 2))").fetchall()
    assert column(spark, values, X.fmt_fixed, "double") == [x for x, in sql]
    assert column(spark, [148.48 / 1024, 0.015, None, float("nan"), float("inf")], X.fmt_fixed, "double") == ["0.14", "0.02", "—", "—", "—"]


@pytest.mark.parametrize(("header", "want"), [(None, (200, 0, 99)), ("bytes=0-9", (206, 0, 9)), ("bytes=90-", (206, 90, 99)), ("bytes=-10", (206, 90, 99)), ("bytes=50-500", (206, 50, 99)), ("bytes=100-", (416, None, None)), ("bytes=9-3", (416, None, None)), ("bytes=-0", (200, 0, 99)), ("bytes=-", (200, 0, 99)), ("bytes=0-1,5-6", (200, 0, 99))])
def test_byte_range(spark, header, want):
    df = spark.createDataFrame([(100, header)], "size long, header string")
    assert tuple(df.select(catalog.byte_range(F.col("size"), F.col("header")).alias("r")).select("r.*").first()) == want


def test_long_positions_equal_positions_in_slices(spark):
    n = F.col("id")
    rows = spark.range(6000).select((n % 3).alias("key"), F.when(n % 50 > 0, (n * 7919) % 1000 - 300).alias("by"), n.alias("id"), F.sin("id").alias("v"))
    rows = rows.select("*", F.struct("by", "id").alias("at"))
    found = signal.long_positions(rows, ["key"], "by", "at", "v", 100)
    want = signal.positions(rows, ["key"], "at", "v").select("key", "i", "v", F.lit(2000).cast("long").alias("n"))
    assert sorted(found.collect()) == sorted(want.collect())
    assert signal.long_positions(rows.limit(0), ["key"], "by", "at", "v").count() == 0
    assert sorted(signal.envelope(found, ["key"], 16).collect()) == sorted(signal.envelope(want.drop("n"), ["key"], 16).collect())


def test_peaks_of_few_long_signals_are_dealt_to_many_tasks(spark, sf_small, monkeypatch):
    monkeypatch.setattr(signal, "SLICE_ROWS", 500)
    held = []
    monkeypatch.setattr(writers, "write_peaks", lambda envelope, keys, folder: held.append(envelope))
    monkeypatch.setattr(readers, "peaks", lambda spark, glob: spark.createDataFrame([], "path string, bucket int, lo double, hi double"))
    seen = []
    kept = signal.envelope
    monkeypatch.setattr(signal, "envelope", lambda s, *rest: seen.append(s) or kept(s, *rest))
    peaks_files(spark, sf_small)
    counts = [r["count"] for r in seen[0].groupBy(F.spark_partition_id()).count().collect()]
    assert sum(counts) > 5000 and max(counts) < sum(counts) / 8


@pytest.mark.parametrize(("n", "buckets"), [(1, 1), (1599, 1599), (1600, 1600), (3199, 3199), (3200, 1600), (3201, 1601)])
def test_envelope_lengths(spark, n, buckets):
    s = spark.range(n).select(F.lit("a").alias("id"), F.col("id").alias("i"), F.sin("id").alias("v")).select("id", "i", "v")
    e = signal.envelope(s, ["id"])
    assert e.count() == buckets
    low, high = s.agg(F.min("v"), F.max("v")).first()
    assert e.agg(F.min("lo"), F.max("hi")).first() == (low, high)


def test_normalize_is_idempotent_and_keeps_silence(spark):
    s = spark.createDataFrame([("a", 0, 0.5), ("a", 1, -2.0), ("z", 0, 0.0)], "id string, i long, v double")
    once = signal.normalize(s, ["id"]).select("id", "i", "v")
    twice = signal.normalize(once, ["id"]).select("id", "i", "v", "gain")
    peak = once.where("id = 'a'").agg(F.max(F.abs("v"))).first()[0]
    assert peak == pytest.approx(10 ** (-5 / 20))
    assert all(r["gain"] == pytest.approx(1) for r in twice.collect())


def test_stft_round_trip():
    rng = np.random.default_rng(0)
    for n in (1000, 41000, 50000):
        x = rng.normal(size=n)
        assert np.abs(spectral.inverse(spectral.forward(x), n) - x).max() < 1e-12
    assert spectral.forward(np.zeros(10_240)).shape == (1 + 10, 2049)


@pytest.mark.parametrize(("n", "size", "hop"), [(200_000, 4096, 1024), (70_000, 64, 16), (5, 64, 16), (1024, 64, 16)])
def test_chunks_equal_the_whole_signal(spark, n, size, hop):
    x = np.sin(np.arange(n) / 9.0) * np.exp(-np.arange(n) / 50_000.0)
    s = spark.range(n).select(F.lit("a").alias("id"), F.col("id").alias("i"), (F.sin(F.col("id") / 9.0) * F.exp(-F.col("id") / 50_000.0)).alias("v"))
    frames = spectral.stft(s, ["id"], size, hop)
    whole = spectral.forward(x, size, hop)
    assert frames.count() == len(whole)
    for r in frames.where("frame % 97 = 3 OR frame < 2").collect():
        assert np.abs(np.array(r["re"]) + 1j * np.array(r["im"]) - whole[r["frame"]]).max() < 1e-9
    back = spectral.istft(frames, spectral.lengths_of(s, ["id"]), ["id"], size, hop)
    assert back.join(s.select("i", F.col("v").alias("w")), "i").agg(F.count("*"), F.max(F.abs(F.col("v") - F.col("w"))) < 1e-9).first() == (n, True)


def test_small_and_24_bit_signals_keep_their_precision(spark):
    whole = [3, -2, 1, 8388607, -8388608]
    s = spark.createDataFrame([("a", c, i, v / 8388608) for c in (0, 1) for i, v in enumerate(whole)] + [("b", 0, i, 3e-5 * (-1) ** i) for i in range(4)], "id string, ch int, i long, v double")
    level = {r["id"]: r for r in signal.level(s, ["id"]).collect()}
    assert level["b"]["rms"] == pytest.approx(3e-5, rel=1e-12) and level["b"]["loudness"] == pytest.approx(20 * np.log10(3e-5 + 1e-9))
    assert [r["v"] * 8388608 for r in signal.mono(s, ["id"]).where("id = 'a'").orderBy("i").collect()] == whole
    assert signal.ensemble(spark.createDataFrame([(1, k, -1e-5 * k) for k in (1, 2, 3)], "i int, m int, v double"), ["i"], "m", "avg").first()["v"] == pytest.approx(-2e-5, rel=1e-12)
    assert {r["id"]: (r["peak"], r["rms"]) for r in signal.rounded_level(signal.level(s, ["id"])).collect()}["b"] == (0.0, 0.00003)


def test_resampling_keeps_a_tone_and_its_length():
    t = np.arange(48_000) / 48_000
    for rate in (44_100, 22_050, 96_000):
        y = spectral.resampled(np.sin(2 * np.pi * 440 * t), 48_000, rate)
        want = np.sin(2 * np.pi * 440 * np.arange(len(y)) / rate)
        assert len(y) == rate and np.abs(y - want)[200:-200].max() < 1e-4
    assert len(spectral.resampled(np.zeros(0), 8000, 44_100)) == 0


def test_ensemble_of_equals_is_itself_and_ties_go_to_the_first():
    a = np.array([[1 + 1j, 2]])
    b = np.array([[1 - 1j, 1]])
    assert (spectral.merged([a, a], "max") == a).all()
    assert (spectral.merged([a, b], "max") == np.array([[1 + 1j, 2]])).all()
    assert (spectral.merged([a, b], "min") == np.array([[1 + 1j, 1]])).all()


MANIFEST = ['{"id": "original", "kind": "source", "stem": "original", "duration_s": 128.4}', "", '{"id": "a", "kind": "separate", "input": "original"}', '{"id": "b"', "[]", '{"kind": "diff"}', '{"id": ""}', '{"id": "d", "kind": "diff", "input": ["a", "original"]}', '{"id": "a", "kind": "ensemble"}']


def test_manifest_modes(spark, tmp_path):
    folder = tmp_path / "lib" / "song"
    folder.mkdir(parents=True)
    (folder / "manifest.jsonl").write_text("\n".join(MANIFEST))
    last = {r["id"]: r for r in readers.manifests(spark, str(tmp_path / "lib")).collect()}
    assert set(last) == {"original", "a", "d", ""}
    assert (last["a"]["kind"], last["a"]["position"], last["d"]["inputs"], last["a"]["slug"]) == ("ensemble", 2, ["a", "original"], "song")
    every = [r["id"] for r in readers.manifests(spark, str(tmp_path / "lib"), "all").orderBy("position").collect()]
    assert every == ["original", "a", "d", "a"]
    with pytest.raises(Exception, match="bad manifest line"):
        readers.manifests(spark, str(tmp_path / "lib"), "strict").collect()


def test_index_round_trip(spark, tmp_path):
    files = spark.createDataFrame([("b", "B", "b.mp3", 2.0, 1, ["x"]), ("a", "A", "a.mp3", 1.0, 2, ["x", "y"])], "slug string, title string, original string, duration_s double, n_variants long, variants array<string>")
    writers.write_index(files, str(tmp_path / "index"), 7)
    assert sorted(map(tuple, readers.index(spark, str(tmp_path / "index")).select("slug", "n_variants").collect())) == [("a", 2), ("b", 1)]
    assert readers.index(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
def test_wav_round_trip(spark, tmp_path, bits):
    x = np.vstack([np.sin(np.arange(5000) / 9), np.cos(np.arange(5000) / 7)]) * 0.5
    got, rate = readers.decode_wav(writers.encode_wav(x, 44100, bits))
    assert rate == 44100 and np.abs(got - x).max() <= 2.0 ** (1 - bits)
    (tmp_path / "a.wav").write_bytes(writers.encode_wav(x[:1], 8000, bits))
    frames = readers.wav_frames(spark, str(tmp_path), 8000, chunk=2000)
    assert frames.count() == 6  # mono is doubled, 3 chunks each
    assert readers.long_form(frames).groupBy("ch").count().orderBy("ch").collect()[0]["count"] == 5000


def test_assets_and_peaks(spark, tmp_path):
    (tmp_path / "lib" / "s" / "out").mkdir(parents=True)
    (tmp_path / "lib" / "s" / "original.wav").write_bytes(b"1")
    (tmp_path / "lib" / "s" / "original.mp3").write_bytes(b"12")
    (tmp_path / "lib" / "s" / "out" / "p.json").write_text('{"min": [-1.0, 0.0], "max": [1.0, 0.5]}')
    found = readers.assets(spark, str(tmp_path / "lib"))
    assert sorted((r["slug"], r["rel"], r["size"]) for r in found.collect())[:2] == [("s", "original.mp3", 2), ("s", "original.wav", 1)]
    assert catalog.original_of(found).first()["original"] == "original.mp3"
    assert [(r["bucket"], r["lo"], r["hi"]) for r in readers.peaks(spark, str(tmp_path / "lib/*/out/p.json")).orderBy("bucket").collect()] == [(0, -1.0, 1.0), (1, 0.0, 0.5)]


def test_named_files_and_logs(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    got = readers.explicit(spark, [str(tmp_path / "a.txt"), str(tmp_path / "none.wav")])
    assert [(r["path"].rsplit("/", 1)[-1], r["size"]) for r in got.collect()] == [("a.txt", 1)]
    assert readers.explicit(spark, [str(tmp_path / "none.wav")]).count() == 0
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "1.json").write_text('{"job": "j", "seq": 1, "line": "JOB: processing 1 file(s)"}\n{"job": "j", "seq": 2, "line": "DONE: processed 1 file(s)"}\n')
    folded = job_fold.fold_available(spark, job_fold.log_source(spark, str(tmp_path / "logs")), str(tmp_path / "out"))
    assert [(r["job"], r["done"], r["lines"]) for r in folded.collect()] == [("j", True, 2)]
    seen = []
    query = job_fold.refreshed(job_fold.log_source(spark, str(tmp_path / "logs")), lambda rows, epoch: seen.extend(rows.collect()), str(tmp_path / "check"), "1 second")
    query.processAllAvailable()
    query.stop()
    assert [r["phase"] for r in seen] == ["finalizing"]


def test_cards_are_upgraded_once_ready(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, rows in enumerate(['{"id": "a", "audio_ready": false, "n": 1}\n{"id": "b", "audio_ready": true, "n": 1}', '{"id": "a", "audio_ready": true, "n": 2}\n{"id": "b", "audio_ready": true, "n": 2}\n{"id": "c", "audio_ready": false, "n": 2}']):
        (tmp_path / "in" / f"{k}.json").write_text(rows)
        os.utime(tmp_path / "in" / f"{k}.json", (k + 1, k + 1))
    cards = spark.readStream.schema("id string, audio_ready boolean, n int").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    got = job_states.cards_available(spark, cards, ["id"], str(tmp_path / "out"))
    assert sorted(tuple(r) for r in got.select("id", "audio_ready", "n").collect()) == [("a", True, 2), ("b", True, 1), ("c", False, 2)]


def test_counters(spark):
    rows, seen = incremental.counted(spark.range(10), even=F.col("id") % 2 == 0)
    assert rows.count() == 10 and seen.get == {"processed": 10, "even": 5}


def test_paths(spark):
    assert column(spark, ["a/../b", "../x", "a/../../b", "/../x", "a/b", "%2e%2e/x", ""], catalog.safe_path) == [True, False, False, True, True, False, True]
    assert column(spark, ["a/../b", "/../x//y/.", "../x"], X.normal_path) == ["b", "x/y", None]


def test_display_order(spark):
    ids = [("original", "source", "original", ""), ("roformer_instrumental", "separate", "Instrumental", ""), ("mdx23c_instrumental", "separate", "Instrumental", ""), ("ensemble_max_instrumental", "ensemble", "Instrumental", "roformer and mdx"), ("residual_voice", "diff", "residual", ""), ("deecho_dereverb_instrumental", "separate", "Instrumental", ""), ("deecho_dereverb_removed", "diff", "residual", "")]
    v = spark.createDataFrame([("s", *x) for x in ids], "slug string, id string, kind string, stem string, description string")
    assert [r["id"] for r in catalog.ordered(v).collect()] == ["original", "roformer_instrumental", "mdx23c_instrumental", "ensemble_max_instrumental", "deecho_dereverb_instrumental", "deecho_dereverb_removed", "residual_voice"]


def test_log_lines(spark):
    lines = ["JOB: processing 1 file(s)", "=== loading M (tag) ===", "=== tag: all 1 already separated ===", "  [ensemble] S", "[manifest] S: 6 entries", "normalized 3 instrumental tracks", "transcoded 6 new AAC streams", "DONE: processed 1 file(s); x", "else"]
    assert column(spark, lines, jobs.progress_of, "string") == [0.05, 0.25, 0.35, 0.6, 0.75, 0.85, 0.95, 0.99, None]
    log = spark.createDataFrame([("j", i, x) for i, x in enumerate([*lines, lines[1]])], "job string, seq long, line string")
    r = jobs.fold(log).first()
    assert (r["phase"], r["progress"], r["slug"], r["done"]) == ("separating (running models)", 0.99, "S", True)


def test_separator(spark):
    class HalfSplit:
        """A deterministic stand-in: a moving mean, and what it leaves."""

        def separate(self, samples):
            smooth = np.convolve(samples, np.ones(3) / 3, "same")
            return {"instrumental": smooth, "vocals": samples - smooth}

    frames = spark.createDataFrame([("s", 0, [1.0, 2.0, 3.0])], "slug string, ch int, samples array<double>")
    rows = {r["id"]: r["samples"] for r in plugins.separate(frames, HalfSplit, "t").collect()}
    assert np.allclose(np.add(rows["t_instrumental"], rows["t_vocals"]), [1, 2, 3])


def test_replayed_actions_change_nothing_in_later_triggers(spark, tmp_path):
    schema, rows = "job long, seq long, action string", [(1, 0, "start"), (1, 1, "cancel"), (1, 2, "finish"), (2, 0, "cancel")]
    got = {}
    for k, part in enumerate((rows[:2], rows[:3], rows, rows)):
        spark.createDataFrame(part, schema).coalesce(1).write.json(str(tmp_path / "in" / str(k)))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))

        def keep(df, _):
            got.update({r["job"]: (r["status"], r["refused"]) for r in df.collect()})

        job_states.states(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    want = {str(r["job"]): (r["status"], r["refused"]) for r in jobs.final_states(spark.createDataFrame(rows, schema)).collect()}
    assert got == want == {"1": ("done", 1), "2": ("canceled", 0)}
