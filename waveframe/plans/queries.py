"""Queries that apply the operators to the driver's tables, each an analogue with the same algebra."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.numbers import round_exact
from ..operators import catalog, chunks, incremental, jobs, signal, spectral
from ..sources import logs, readers, snapshots, wav, writers
from ..streaming import job_fold as fold_module
from ..streaming import job_states

# Log lines of the analogue by event type.
LINES = {"click": "[ensemble] file", "view": "=== loading model (tag) ===", "purchase": "DONE: processed 1 file(s)", "signup": "JOB: processing 1 file(s)", "error": "[manifest] slug_x: 6 entries"}


#: Samples of a chunk of the events' short signals.
EVENT_CHUNK = 32


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a cluster must set spark.checkpoint.dir."""
    found, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not found and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(found or '/tmp/checkpoints').rstrip('/')}/waveframe-{uuid.uuid4().hex}"


def event_signal(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    """user_id (and further keys), i, v: events' values in the order of their ids."""
    return signal.positions(load(spark, sf_dir, "events"), ["user_id", *keys], "event_id", "value")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, i, v: embeddings in long form."""
    return load(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v"))


def log_line(kind: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in LINES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, kind), F.lit("transcoded 6 new AAC streams"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), log_line(F.col("event_type")).alias("line"))


def event_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by event: id, seq, status, slug, started, ended, exit_code."""
    e = load(spark, sf_dir, "events")
    status = F.element_at(F.array(*[F.lit(s) for s in ("queued", "running", "done", "failed", "stopped", "canceled")]), (F.col("event_id") % 6 + 1).cast("int"))
    return e.select(F.col("event_id").alias("seq"), "user_id", status.alias("status"), F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("slug"), F.when(F.col("event_id") % 6 != 0, F.col("value")).alias("started"), F.when(F.col("event_id") % 6 > 1, F.col("value") * 2).alias("ended"))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as variant records: slug, id, kind, stem, description, status, normalized_dbfs, output, stream."""
    d = load(spark, sf_dir, "documents")
    n = F.col("doc_id")
    kind = F.when(n % 11 == 0, "source").when(n % 11 == 1, "diff").when(n % 11 == 2, "ensemble").otherwise("separate")
    stem = F.when(F.col("lang") == "en", "Instrumental").when(F.col("lang") == "de", "Vocals").when(F.col("lang") == "fr", "residual")
    name = F.element_at(F.array(*[F.lit(x) for x in ("roformer", "mdx23c", "deecho", "denoise", "x")]), (n % 5 + 1).cast("int"))
    return d.select(
        F.col("source").alias("slug"), F.concat(name, F.lit("_"), n.cast("string")).alias("id"), kind.alias("kind"), stem.alias("stem"),
        F.when(n % 3 == 0, "de-echo pass").when(n % 3 == 1, "normalized roformer mix").otherwise("plain").alias("description"),
        F.when(F.col("n_chars") > 200, "done").otherwise("error").alias("status"), F.when(n % 4 == 0, -5.0).alias("normalized_dbfs"),
        F.concat(F.lit("out/"), n.cast("string"), F.lit(".wav")).alias("output"), F.when(n % 2 == 0, F.concat(F.lit("out/"), n.cast("string"), F.lit(".m4a"))).alias("stream"), n.alias("doc_id"),
    )


def signal_level(spark, sf_dir):
    s = event_signal(spark, sf_dir).withColumn("ch", F.lit(0))
    return signal.level(s, ["user_id"]).select("user_id", "peak", F.round("rms", 6).alias("rms"), F.round("loudness", 6).alias("loudness"), "sr", "channels", "duration_s")


def signal_envelope(spark, sf_dir):
    return signal.envelope(event_signal(spark, sf_dir), ["user_id"], buckets=16)


def envelope_rebucket(spark, sf_dir):
    return signal.rebucket(signal.envelope(event_signal(spark, sf_dir), ["user_id"]), ["user_id"], 120)


def envelope_pyramid(spark, sf_dir):
    """envelope_rebucket read from a pyramid of doubled buckets."""
    return signal.from_pyramid(signal.pyramid(signal.envelope(event_signal(spark, sf_dir), ["user_id"]), ["user_id"]), ["user_id"], 120)


def envelope_divergence(spark, sf_dir):
    e = event_signal(spark, sf_dir, "event_type")
    sides = [signal.rebucket(signal.envelope(e.where(F.col("event_type") == kind).drop("event_type"), ["user_id"]), ["user_id"], 60) for kind in ("click", "view")]
    return signal.divergence(*sides, ["user_id"])


def peak_normalize(spark, sf_dir):
    return signal.normalize(event_signal(spark, sf_dir), ["user_id"])


def normalize_eligible(spark, sf_dir):
    assets = load(spark, sf_dir, "labels").select("doc_id")
    return incremental.eligible(variants(spark, sf_dir), assets, ["doc_id"], -5.0).select("doc_id", "slug", "description", "normalized_dbfs")


def _ensemble(algo):
    def query(spark, sf_dir):
        found = signal.ensemble(vectors(spark, sf_dir), ["label", "i"], "vec_id", algo)
        return found.withColumn("v", F.round("v", 9)) if algo == "avg" else found

    return query


def residual_diff(spark, sf_dir):
    v = vectors(spark, sf_dir).drop("label")
    return signal.residual(v, v.withColumn("vec_id", F.col("vec_id") - 1), ["vec_id"])


def align_shortest(spark, sf_dir):
    return signal.align(event_signal(spark, sf_dir, "event_type"), ["user_id"], "event_type")


def mono_mixdown(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supplier"), F.col("l_linenumber").alias("i"), F.col("l_extendedprice").alias("v"))
    return signal.mono(rows, ["supplier"]).withColumn("v", F.round("v", 6))


def amplitude_db(spark, sf_dir):
    return signal.to_db(vectors(spark, sf_dir).drop("label"), ["vec_id"]).select("vec_id", "i", F.round("db", 6).alias("db"))


def page_files(spark, sf_dir) -> DataFrame:
    """Pages as files: path, size, top."""
    p = load(spark, sf_dir, "pages")
    suffix = F.element_at(F.array(*[F.lit(x) for x in (".mp3", ".WAV", ".txt", ".Mp3")]), (F.col("page_id") % 4 + 1).cast("int"))
    folder = F.when(F.col("page_id") % 7 == 0, "models/").otherwise("")
    name = F.concat(F.when(F.col("page_id") % 13 == 0, ".").otherwise(""), F.regexp_extract("url", "//([^/]*)", 1))
    return p.select(F.concat(F.lit("input/"), folder, (F.col("page_id") % 5).cast("string"), F.lit("/"), name, suffix).alias("path"), (F.char_length("html") % 3).cast("long").alias("size"), (F.col("page_id") % 3 == 0).alias("top"))


def discover_inputs(spark, sf_dir):
    return catalog.discover(page_files(spark, sf_dir)).orderBy("path")


def slugify(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", X.slugify(F.col("url")).alias("slug"), X.extension(X.basename(F.col("url"))).alias("ext"))


def slug_collisions(spark, sf_dir):
    return catalog.slug_collisions(load(spark, sf_dir, "part"), "p_name", "p_partkey")


def sanitize_unique(spark, sf_dir):
    named = load(spark, sf_dir, "part").select("p_partkey", X.sanitize_filename(F.concat(F.lit("C:\\in\\"), F.col("p_name"), F.lit("!.mp3"))).alias("name"))
    number = F.row_number().over(Window.partitionBy("name").orderBy("p_partkey")) - 1
    return named.select("p_partkey", X.numbered(F.col("name"), number).alias("name"))


def manifest_last_wins(spark, sf_dir):
    return catalog.last_wins(load(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], "o_orderkey", ["o_orderstatus", "o_totalprice"])


def manifest_parse(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    line = F.when(F.col("event_id") % 7 == 0, F.expr("left(props, char_length(props) - 1)")).when(F.col("event_id") % 7 == 1, "[]").when(F.col("event_id") % 7 == 2, "").otherwise(F.concat(F.lit('{"id": "v'), F.col("event_type"), F.lit('", "kind": "separate", "duration_s": '), F.col("value").cast("string"), F.lit(', "input": ["a", "b"]}')))
    lines = e.select(F.col("user_id").alias("slug"), F.col("event_id").alias("line_no"), line.alias("line"))
    return readers.parse_manifest(lines, "last").select("slug", "id", "kind", "duration_s", F.size("inputs").alias("n_inputs"), "position")


def index_rollup(spark, sf_dir):
    o = load(spark, sf_dir, "orders").withColumn("id", F.when(F.col("o_orderpriority") == "1-URGENT", "original").otherwise(F.col("o_orderpriority")))
    return catalog.index_rollup(o, "o_custkey", "id", "o_orderkey", "o_totalprice", "o_orderstatus").withColumn("variants", F.array_join("variants", ","))


def listing_merge(spark, sf_dir):
    index = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("slug")).agg(F.min("o_orderstatus").alias("title"), F.max("o_orderpriority").alias("original"), F.max("o_totalprice").alias("duration_s"), F.count("*").alias("n_variants"))
    index = index.withColumn("original", F.when(F.col("slug") % 5 != 0, F.col("original"))).withColumn("duration_s", F.when(F.col("slug") % 3 != 0, F.col("duration_s")))
    live = load(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("slug"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("original"), (F.col("c_nationkey") % 2 == 0).alias("has_manifest"), (F.col("c_nationkey") % 4).cast("long").alias("n_live"), F.col("c_acctbal").alias("live_duration_s"))
    return catalog.listing(index, live).orderBy(F.lower(F.col("slug").cast("string")))


def variant_order(spark, sf_dir):
    at = F.row_number().over(Window.partitionBy("slug").orderBy("grp", "rank", "id"))
    return catalog.ordered(variants(spark, sf_dir)).select("slug", "id", "grp", "rank", "label", at.alias("place"))


def option_labels(spark, sf_dir):
    v = variants(spark, sf_dir)
    grp = catalog.display_group(F.col("kind"), F.col("stem"), F.col("id"))
    return v.select("id", catalog.option_label(grp, F.col("id"), F.col("stem")).alias("label"))


def default_slots(spark, sf_dir):
    return catalog.default_slots(catalog.ordered(variants(spark, sf_dir)), "slug")


def explorer_view(spark, sf_dir):
    v = variants(spark, sf_dir).withColumn("spectrogram", F.concat(F.lit("a b/"), F.col("doc_id").cast("string"), F.lit(".png"))).withColumn("peaks", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("out/"), F.col("doc_id").cast("string"), F.lit(".json"))))
    labels = load(spark, sf_dir, "labels")
    own = v.join(labels, "doc_id")
    played = F.when(F.col("doc_id") % 2 == 0, F.col("stream")).otherwise(F.col("output"))
    there = own.select("slug", F.explode(F.array(F.col("output"), played, F.when(F.col("quality") == 1, F.col("spectrogram")), F.when(F.col("toxic") == 0, F.col("peaks")))).alias("rel")).where("rel IS NOT NULL")
    return catalog.explorer(v.select("slug", "id", "output", "stream", "spectrogram", "peaks"), there).drop("output", "stream", "spectrogram", "peaks")


def with_original(spark, sf_dir):
    v = variants(spark, sf_dir).select("slug", "id", "kind", "stem", "description", "output", "status")
    originals = v.select(F.concat(F.col("slug"), F.when(F.length("id") % 2 == 0, "").otherwise("_new")).alias("slug")).distinct().withColumn("original", F.lit("original.mp3"))
    return catalog.with_original(v, originals).select("slug", "id", "kind", "output", "synthetic")


def lineage_presets(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("id")).distinct()
    diffs = c.withColumn("inputs", F.array(F.col("id") - 1, F.col("id") - 2))
    return catalog.presets(diffs, c, "conv_id")


def incremental_todo(spark, sf_dir):
    return incremental.todo(load(spark, sf_dir, "documents").select("doc_id", "source"), load(spark, sf_dir, "labels"), ["doc_id"])


def ensemble_pairs(spark, sf_dir):
    d, l = load(spark, sf_dir, "documents").select("doc_id", "lang"), load(spark, sf_dir, "labels")
    return incremental.paired(d, l, l.where("toxic = 1"), ["doc_id"])


def all_done(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("slug"), F.explode(F.array(F.lit("N"), F.lit("R"))).alias("stem"))
    found = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("slug"), F.col("l_returnflag").alias("stem"))
    return incremental.all_done(orders, found, ["slug"], ["slug", "stem"])


def model_cross(spark, sf_dir):
    nations = load(spark, sf_dir, "nation").select("n_name")
    models = load(spark, sf_dir, "region").select("r_regionkey", "r_name")
    present = load(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_regionkey").alias("r_regionkey")).distinct()
    return incremental.expand(nations, models, present, "r_regionkey")


def freshness(spark, sf_dir):
    sources = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("slug"), F.col("o_orderdate").alias("mtime"))
    targets = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("slug")).agg(F.min("l_shipdate").alias("mtime"))
    return incremental.freshness(sources, targets, ["slug"])


def phase_map(spark, sf_dir):
    return event_log(spark, sf_dir).select("seq", jobs.phase_of(F.col("line")).alias("phase"), jobs.progress_of(F.col("line")).alias("progress"))


def job_progress(spark, sf_dir):
    return jobs.running(event_log(spark, sf_dir))


def job_fold(spark, sf_dir):
    return jobs.fold(event_log(spark, sf_dir))


def job_log_tail(spark, sf_dir):
    return jobs.tail(event_log(spark, sf_dir)).withColumn("tail", F.array_join("tail", "\n"))


def job_outcome(spark, sf_dir):
    folded = jobs.fold(event_log(spark, sf_dir))
    return folded.select("job", jobs.outcome(F.col("job") % 5 == 0, (F.col("job") % 3).cast("int"), F.col("done")).alias("status"))


def job_snapshot(spark, sf_dir):
    return event_jobs(spark, sf_dir).select("seq", "status", jobs.elapsed(F.col("started"), F.col("ended"), F.lit(1000.0)).alias("elapsed"))


def job_actions(spark, sf_dir):
    return event_jobs(spark, sf_dir).select("seq", F.array_join(jobs.actions(F.col("status"), F.col("slug")), ",").alias("actions"))


def job_transitions(spark, sf_dir):
    action = F.element_at(F.array(*[F.lit(a) for a in ("start", "cancel", "stop", "remove")]), (F.col("seq") % 4 + 1).cast("int"))
    return event_jobs(spark, sf_dir).select("seq", jobs.transition(F.col("status"), action).alias("status"))


def crash_recovery(spark, sf_dir):
    return jobs.recovered(event_jobs(spark, sf_dir).withColumn("error", F.lit(None).cast("string"))).select("seq", "status", "error")


def fifo_next(spark, sf_dir):
    j = event_jobs(spark, sf_dir)
    active = j.agg(F.count_if(F.col("status").isin(jobs.ACTIVE)).alias("active"))
    return jobs.next_queued(j).select("seq", "status").crossJoin(active)  # one row by one row


def job_fold_stream(spark, sf_dir):
    schema = load(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    log = events.select(F.col("user_id").cast("string").alias("job"), F.col("event_id").alias("seq"), log_line(F.col("event_type")).alias("line"))
    return fold_module.fold_available(spark, log, shared_folder(spark))


def log_stream(spark, sf_dir):
    """Every job's log as a file of lines, read as a stream of byte ranges and folded."""
    folder = shared_folder(spark)
    logs.write(event_log(spark, sf_dir), f"{folder}/logs")
    return fold_module.fold_available(spark, logs.stream(spark, f"{folder}/logs"), folder)


def stem_classify(spark, sf_dir):
    name = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 4 == 0, "_(Instrumental)").when(F.col("doc_id") % 4 == 1, "_Vocals").when(F.col("doc_id") % 4 == 2, " No Vocals").otherwise(""))
    return load(spark, sf_dir, "documents").select("doc_id", catalog.stem_of(name).alias("stem"))


def cleanup_pick(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ord"), F.concat(F.col("role"), F.when(F.col("turn") % 3 == 2, " (No Echo)").otherwise(" (Echo)")).alias("name")).distinct()
    return catalog.cleanup_pick(c, ["conv_id"], F.lit("No Echo"))


def title_search(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 9 != 0, F.col("p_name")).alias("title"), F.col("p_brand").alias("slug"))
    return catalog.search(p, "  1 ").select("p_partkey", "title")


def format_fields(spark, sf_dir):
    v = F.col("value")
    return load(spark, sf_dir, "events").select(
        "event_id", X.fmt_time(v * 10).alias("time"), X.fmt_duration(F.when(F.col("event_id") % 2 == 0, v).otherwise(v / 1024)).alias("duration"), X.fmt_elapsed(v * 50).alias("elapsed"),
        X.clamp(v, 10.0, 200.0).alias("clamped"), X.capitalize(F.concat(F.col("event_type"), F.lit(" NO"))).alias("capital"), X.escape_html(F.concat(F.lit("<a&'b'>"), F.col("props"))).alias("escaped"),
    )


def path_fields(spark, sf_dir):
    rel = F.when(F.col("page_id") % 10 == 0, F.concat(F.lit("../"), F.col("url"))).otherwise(F.col("url"))
    name = F.concat((F.col("page_id") % 10).cast("string"), F.element_at(F.array(F.lit(".m4a"), F.lit(".WAV"), F.lit(".bin")), (F.col("page_id") % 3 + 1).cast("int")))
    return load(spark, sf_dir, "pages").select("page_id", catalog.safe_path(rel).alias("safe"), X.mime_type(name).alias("mime"), X.percent_encode(F.concat(F.lit("a b~*/"), F.col("page_id").cast("string"))).alias("encoded"), X.percent_decode(F.concat(F.lit("%C3%A9+%2F%zz"), F.when(F.col("page_id") % 2 == 0, F.lit("")).otherwise(F.col("page_id").cast("string")))).alias("malformed"), X.percent_decode(F.concat(F.lit("%C3%A9+%2F"), F.col("page_id").cast("string"))).alias("decoded"), X.normal_path(F.concat(F.lit("a/./b//../"), F.when(F.col("page_id") % 4 == 0, "../../").otherwise(""), F.col("page_id").cast("string"))).alias("normal"))


def range_slice(spark, sf_dir):
    p = load(spark, sf_dir, "pages").select("page_id", F.col("html"), F.char_length("html").cast("long").alias("size"))
    k = F.col("page_id") % 6
    header = F.when(k == 0, "bytes=0-9").when(k == 1, "bytes=90-").when(k == 2, "bytes=-10").when(k == 3, "bytes=99999999-").when(k == 4, "bytes=-0").otherwise("bytes=0-1,5-6")
    r = p.withColumn("r", catalog.byte_range(F.col("size"), header))
    part = F.when(F.col("r.status") == 206, F.substr("html", (F.col("r.first") + 1).cast("int"), (F.col("r.last") - F.col("r.first") + 1).cast("int")))
    return r.select("page_id", F.col("r.status").alias("status"), F.col("r.first").alias("first"), F.col("r.last").alias("last"), part.alias("part"))


def upload_triage(spark, sf_dir):
    f = page_files(spark, sf_dir).select(F.when(F.col("size") < 2, X.basename(F.col("path"))).alias("filename"), "size")
    return catalog.uploads(f).groupBy(F.coalesce("reason", F.lit("accepted")).alias("result")).agg(F.count("*").alias("n"))


def first_source(spark, sf_dir):
    o = load(spark, sf_dir, "orders").withColumn("d", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")))
    return catalog.first_source(o, "o_custkey", "o_orderkey", "d", F.col("o_orderpriority") == "1-URGENT")


def title_duration(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("slug"), F.col("o_orderkey").alias("position"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderstatus")).alias("title"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).alias("duration_s"))
    durations = catalog.first_source(o, "slug", "position", "duration_s", F.col("title") == "")
    return catalog.title_and_duration(load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("slug")), o, durations)


def limited_inputs(spark, sf_dir):
    return catalog.limited(catalog.discover(page_files(spark, sf_dir)), 7)


def newest_jobs(spark, sf_dir):
    return jobs.newest(event_jobs(spark, sf_dir)).limit(5).select("seq", "status")


def job_by_id(spark, sf_dir):
    return jobs.by_id(event_jobs(spark, sf_dir).withColumn("id", F.concat(F.lit("j"), F.col("seq").cast("string"))), "j77").select("id", "status", "slug")


def job_states_fold(spark, sf_dir):
    return jobs.final_states(job_events(spark, load(spark, sf_dir, "events")))


def job_events(spark, events: DataFrame) -> DataFrame:
    action = F.element_at(F.array(*[F.lit(a) for a in ("start", "stop", "finish", "start", "cancel", "remove", "fail")]), (F.col("event_id") % 7 + 1).cast("int"))
    return events.select(F.col("user_id").cast("string").alias("job"), F.col("event_id").alias("seq"), action.alias("action"))


def job_states_stream(spark, sf_dir):
    events = spark.readStream.schema(load(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return job_states.states_available(spark, job_events(spark, events), shared_folder(spark))


def ready_cards(spark, sf_dir):
    """Variants by slug and id as cards, ready if their text is long."""
    d = load(spark, sf_dir, "documents")
    return catalog.ordered(variants(spark, sf_dir)).join(d.select("doc_id", "n_chars"), "doc_id").select("slug", "id", "grp", "rank", (F.col("n_chars") > 300).alias("audio_ready"), (F.col("n_chars") / 7).alias("duration_s"), "doc_id")


def first_ready(spark, sf_dir):
    return catalog.first_ready(ready_cards(spark, sf_dir), "slug")


def slot_with_fallback(spark, sf_dir):
    return catalog.slot(ready_cards(spark, sf_dir), "slug", (F.col("grp") == 1) & F.col("id").contains("roformer") & (F.length("slug") % 2 == 0), 2)


def longest_chosen(spark, sf_dir):
    cards = ready_cards(spark, sf_dir)
    return catalog.longest_chosen(cards.where("doc_id % 5 < 2").select("slug", "id").unionByName(cards.select("slug", F.lit("none").alias("id")).distinct()), cards, ["slug"])


def card_upgrade(spark, sf_dir):
    cards = ready_cards(spark, sf_dir).select("slug", "id", "audio_ready", "duration_s", "doc_id")
    return catalog.upgraded(cards.where("doc_id % 3 != 0"), cards.where("doc_id % 3 != 1").withColumn("audio_ready", F.lit(True)).withColumn("duration_s", F.col("duration_s") + 1), ["slug", "id"])


def rounded_fields(spark, sf_dir):
    """Events' values over 8 (many exact halves) to 0 to 5 decimals, by their exact values."""
    x = F.col("value") / 8
    return load(spark, sf_dir, "events").select("event_id", *[round_exact(x, k).alias(f"r{k}") for k in range(6)])


def rounded_levels(spark, sf_dir):
    """Levels as records hold them."""
    return signal.rounded_level(chunks.level(event_chunks(spark, sf_dir), ["user_id"], size=EVENT_CHUNK, ch="user_id")).drop("sr", "channels")


def stored_names(spark, sf_dir):
    """Parts as uploads among suppliers' files, with gaps between the numbers that exist."""
    n = F.col("p_partkey")
    name = F.concat(F.lit("take"), (n % 9).cast("string"), F.when(n % 7 == 0, F.concat(F.lit("_"), (n % 4).cast("string"))).otherwise(""), F.lit(".wav"))
    k = F.col("s_suppkey")
    there = F.concat(F.lit("take"), (k % 5).cast("string"), F.when(k % 3 > 0, F.concat(F.lit("_"), (k % 11).cast("string"))).otherwise(""), F.lit(".wav"))
    return catalog.free_names(load(spark, sf_dir, "part").select("p_partkey", name.alias("name")), load(spark, sf_dir, "supplier").select(there.alias("name")), "p_partkey")


def log_spectrogram(spark, sf_dir):
    """Twelve frequencies of every frame of every user, in dB."""
    found = spectral.log_spectrogram(spectral.stft(event_signal(spark, sf_dir), ["user_id"], 64, 16), ["user_id"], 64, 44_100, 12)
    return found.select("user_id", "frame", F.posexplode("db").alias("y", "db")).withColumn("db", F.round("db", 5) + 0.0)


def both_listings(spark, sf_dir):
    """The pages' files as an input tree and as a root's own files, discovered together below a root."""
    f = page_files(spark, sf_dir)
    below = f.select(F.concat(F.lit("/srv/output/"), "path").alias("path"), "size")
    own = f.select(F.concat(F.lit("/srv/output/"), X.basename(F.col("path"))).alias("path"), "size")
    return catalog.discover(catalog.both_listings(below, own), root="file:/srv/output")


def present_models(spark, sf_dir):
    """Parts as configured models, kept if a file of that name is among the suppliers'."""
    models = load(spark, sf_dir, "part").select("p_partkey", F.concat((F.col("p_partkey") % 500).cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".onnx").otherwise(".ckpt")).alias("file"))
    files = load(spark, sf_dir, "supplier").select(F.concat(F.lit("/models/"), (F.col("s_suppkey") % 70).cast("string"), F.when(F.col("s_suppkey") % 3 == 0, ".ckpt").otherwise(".onnx")).alias("path"))
    return incremental.present_models(models, files, (".onnx", ".ckpt"))


def card_merge(spark, sf_dir):
    """card_upgrade through a versioned table: the first cards are its first version, a merge brings the refreshed ones."""
    cards = ready_cards(spark, sf_dir).select("slug", "id", "audio_ready", "duration_s", "doc_id")
    fresh = cards.where("doc_id % 3 != 1").withColumn("audio_ready", F.lit(True)).withColumn("duration_s", F.col("duration_s") + 1)
    root = shared_folder(spark)
    snapshots.commit(cards.where("doc_id % 3 != 0"), root, ["slug", "id"], buckets=8)
    snapshots.merge(fresh, root, ["slug", "id"], lambda old, new: catalog.upgraded(old, new, ["slug", "id"]))
    return snapshots.read(spark, root)


def manifest_merge(spark, sf_dir):
    """All brands' manifests as a versioned table, then those of some brands written again with every second record."""
    p = load(spark, sf_dir, "part").select(F.col("p_brand").alias("slug"), F.col("p_partkey").alias("position"), F.concat(F.lit("v"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_type").alias("kind"), F.col("p_retailprice").alias("duration_s"), F.lit("original").alias("input"))
    root = shared_folder(spark)
    writers.write_manifest_table(p, root, 8)
    again = p.where(F.col("slug").endswith("1") & (F.col("position") % 2 == 0)).withColumn("kind", F.lit("again"))
    writers.write_manifest_table(again, root)
    return readers.manifest_table(spark, root).select("slug", "position", "id", "kind", "duration_s", F.array_join("inputs", ",").alias("inputs"))


def metrics_fields(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", F.col("value").alias("duration_s"), F.when(F.col("event_id") % 2 == 0, F.col("event_id") / 8).alias("peak"), F.when(F.col("event_id") % 3 == 0, 0.5).alias("rms"), F.lit(None).cast("double").alias("lufs_approx"), F.element_at(F.array(F.lit(44100), F.lit(48000), F.lit(0)), (F.col("event_id") % 3 + 1).cast("int")).alias("sr"), (F.col("event_id") % 3).cast("int").alias("channels"))
    return catalog.metrics(e).select("event_id", F.array_join("metrics", "|").alias("metrics"))


def clock_fields(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    n = F.col("event_id")
    merged = catalog.merged_flags(F.create_map(F.lit("op"), F.lit("a"), F.lit("size"), n.cast("string")), F.when(n % 2 == 0, F.create_map(F.lit("op"), F.lit("b"))))
    return e.select("event_id", X.fmt_clock(n * 1000).alias("clock"), X.fmt_signed((n - 500) / 4).alias("gain"), F.element_at(merged, "op").alias("op"), F.size(merged).alias("flags"), signal.bucket_seconds(n, F.lit(1600), F.col("value")).alias("at"))


def upload_result(spark, sf_dir):
    f = page_files(spark, sf_dir).select((F.char_length("path") % 5).alias("request"), F.when(F.col("size") < 2, X.basename(F.col("path"))).alias("filename"), "size", F.when(F.char_length("path") % 3 == 0, "disk full").alias("failure"))
    found = catalog.upload_result(catalog.uploads(f), ["request"])
    return found.select("request", "ok", F.array_join("accepted", "|").alias("accepted"), F.array_join("rejected", "|").alias("rejected"))


def rejected_union(spark, sf_dir):
    f = page_files(spark, sf_dir)
    server = catalog.uploads(f.select(X.basename(F.col("path")).alias("filename"), "size")).where("reason IS NOT NULL")
    client = f.where(~F.lower("path").rlike(r"\.(mp3|wav)$")).select(X.basename(F.col("path")).alias("filename"), F.lit("extension").alias("reason"))
    return catalog.all_rejected(server, client).groupBy("filename", "reason", "side").agg(F.count("*").alias("n"))


def stream_plan(spark, sf_dir):
    v = variants(spark, sf_dir).withColumn("output", F.when(F.col("doc_id") % 5 == 0, F.replace("output", F.lit(".wav"), F.lit(".mp3"))).otherwise(F.col("output")))
    own = v.join(load(spark, sf_dir, "labels"), "doc_id")
    made = own.where("toxic = 0").select("slug", F.replace("output", F.lit(".wav"), F.lit(".m4a")).alias("rel"), (F.col("doc_id") % 7).alias("mtime")).where("rel LIKE '%.m4a'")
    return incremental.stream_plan(v, own.select("slug", F.col("output").alias("rel"), (F.col("doc_id") % 11).alias("mtime")).unionByName(made))


def one_shot(spark, sf_dir):
    return incremental.one_shot(load(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus")).alias("stem")), ["o_custkey"])


def manifest_files(spark, sf_dir):
    """Manifests written by slug and read back."""
    p = load(spark, sf_dir, "part").select(F.col("p_brand").alias("slug"), F.col("p_partkey").alias("position"), F.concat(F.lit("v"), (F.col("p_partkey") % 50).cast("string")).alias("id"), F.col("p_type").alias("kind"), F.col("p_retailprice").alias("duration_s"), F.lit("original").alias("input"))
    writers.write_manifests(p, folder := shared_folder(spark))
    return readers.manifests(spark, folder, "last", "part-*").select("slug", "id", "kind", "duration_s", F.array_join("inputs", ",").alias("inputs"))


def index_files(spark, sf_dir):
    """The index written as a table and read back."""
    c = load(spark, sf_dir, "customer").select(F.col("c_name").alias("slug"), F.col("c_mktsegment").alias("title"), F.lit(None).cast("string").alias("original"), F.col("c_acctbal").alias("duration_s"), F.lit(1).cast("long").alias("n_variants"), F.array("c_mktsegment").alias("variants"))
    writers.write_index_table(c, folder := shared_folder(spark), 7)
    return readers.index_table(spark, folder).select("slug", "title", "original", "duration_s", "n_variants", F.array_join("variants", ",").alias("variants"))


def peaks_files(spark, sf_dir):
    """Envelopes written as peaks documents and read back."""
    rows = load(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 8).alias("user_id"), "l_orderkey", F.struct("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate").alias("at"), F.col("l_extendedprice").alias("value"))
    s = signal.long_positions(rows, ["user_id"], "l_orderkey", "at", "value")
    writers.write_peaks(signal.envelope(s, ["user_id"], 100), ["user_id"], folder := shared_folder(spark))
    return readers.peaks(spark, f"{folder}/*/*.json").select(F.regexp_extract("path", "user_id=([0-9]+)", 1).cast("long").alias("user_id"), "bucket", "lo", "hi")


def wav_files(spark, sf_dir):
    """Signals written as 24-bit WAV files (rows of path and content) and decoded again; mono becomes two channels."""
    s = event_signal(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("i", (F.col("v") / 1000).alias("v")))).alias("each"))  # a user's events are one short file
    frames = s.select(F.col("user_id").cast("string").alias("path"), F.lit(0).alias("ch"), F.lit(0).cast("long").alias("start"), F.transform("each", lambda x: x["v"]).alias("samples"))
    writers.write_wav(frames, folder := shared_folder(spark), 44100, 24)
    back = readers.long_form(readers.frames_of(spark.read.parquet(folder), 44100))
    return back.select(F.col("path").cast("long").alias("user_id"), "ch", "i", "v")


def wav_source(spark, sf_dir):
    """Users' signals written as loose 24-bit files of two channels and read back in byte ranges: user_id, ch, i, v."""
    held = event_chunks(spark, sf_dir).withColumn("samples", F.transform("samples", lambda v: v / 1000)).withColumn("path", F.format_string("%d/%d.wav", F.col("user_id") % 10, F.col("user_id")))
    both = held.select("path", F.explode(F.array(F.lit(0), F.lit(1))).alias("ch"), "chunk", "samples")
    wav.write(both, folder := shared_folder(spark), 44100, 24, size=EVENT_CHUNK)
    back = wav.read(spark, folder, chunk=EVENT_CHUNK)
    return chunks.long_form(back.withColumn("user_id", F.regexp_extract("path", "([0-9]+)[.]wav$", 1).cast("long")), ["user_id", "ch"], EVENT_CHUNK)


def jobs_files(spark, sf_dir):
    """Jobs written as a table and loaded as after a crash."""
    j = event_jobs(spark, sf_dir).select(F.col("seq").cast("string").alias("id"), "status", "slug", F.col("started").alias("started_at"), F.array(F.lit("a"), "slug").alias("log_tail"))
    writers.write_jobs(j, folder := shared_folder(spark))
    return jobs.recovered(readers.jobs(spark, folder)).select("id", "status", "slug", "started_at", "error", F.array_join("log_tail", "|").alias("log_tail"))


def stft_bins(spark, sf_dir):
    """re, im of every user's frames and bins, at 64 samples and 16 apart."""
    found = spectral.bins(spectral.stft(event_signal(spark, sf_dir), ["user_id"], 64, 16), ["user_id"])
    # adding 0.0 makes a negative zero a zero
    return found.select("user_id", "frame", F.col("bin").cast("long").alias("bin"), (F.round("v.re", 6) + 0.0).alias("re"), (F.round("v.im", 6) + 0.0).alias("im"))


def stft_roundtrip(spark, sf_dir):
    """user_id, i, v after a transform of the library's own size and its inverse."""
    s = event_signal(spark, sf_dir)
    back = spectral.istft(spectral.stft(s, ["user_id"]), spectral.lengths_of(s, ["user_id"]), ["user_id"])
    return back.select("user_id", "i", F.round("v", 6).alias("v"))


def spectral_ensemble(spark, sf_dir):
    s = event_signal(spark, sf_dir, "event_type").where(F.col("event_type").isin("click", "view"))
    held = chunks.chunked(s, ["user_id", "event_type"], EVENT_CHUNK)
    found = spectral.chunk_ensemble(held, ["user_id"], "event_type", "max", 64, 16, EVENT_CHUNK)
    return chunks.long_form(found, ["user_id"], EVENT_CHUNK).select("user_id", "i", (F.round("v", 6) + 0.0).alias("v"))


def event_chunks(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    """Events' values in chunk form."""
    return chunks.chunked(event_signal(spark, sf_dir, *keys), ["user_id", *keys], EVENT_CHUNK)


def chunk_level(spark, sf_dir):
    """Levels of all users, whose event types are the channels; the power is exact and rounded once."""
    found = chunks.level(event_chunks(spark, sf_dir, "event_type"), ["user_id"], size=EVENT_CHUNK, ch="event_type")
    return found.select("user_id", "peak", F.round("rms", 12).alias("rms"), F.round("loudness", 9).alias("loudness"), "sr", "channels", "duration_s")


def chunk_normalize(spark, sf_dir):
    return chunks.long_form(chunks.normalize(event_chunks(spark, sf_dir, "event_type"), ["user_id"]), ["user_id", "event_type"], EVENT_CHUNK)


def chunk_residual(spark, sf_dir):
    """Differences of neighbouring embeddings, each one chunk of its own table."""
    held = load(spark, sf_dir, "embeddings").select("vec_id", F.lit(0).cast("long").alias("chunk"), F.col("embedding").cast("array<double>").alias("samples"))
    return chunks.long_form(chunks.residual(held, held.withColumn("vec_id", F.col("vec_id") - 1), ["vec_id"]), ["vec_id"])


def _chunk_ensemble(algo):
    def query(spark, sf_dir):
        found = chunks.ensemble(event_chunks(spark, sf_dir, "event_type"), ["user_id"], "event_type", algo, EVENT_CHUNK)
        return chunks.long_form(found, ["user_id"], EVENT_CHUNK).withColumn("v", F.round("v", 9))

    return query


def chunk_envelope(spark, sf_dir):
    return chunks.envelope(event_chunks(spark, sf_dir), ["user_id"], 16, EVENT_CHUNK)


QUERIES = {f.__name__: f for f in (
    signal_level, signal_envelope, envelope_rebucket, envelope_divergence, peak_normalize, normalize_eligible, residual_diff, align_shortest, mono_mixdown, amplitude_db,
    discover_inputs, slugify, slug_collisions, sanitize_unique, manifest_last_wins, manifest_parse, index_rollup, listing_merge, variant_order, option_labels, default_slots,
    explorer_view, with_original, lineage_presets, incremental_todo, ensemble_pairs, all_done, model_cross, freshness, phase_map, job_progress, job_fold, job_log_tail, job_outcome,
    job_snapshot, job_actions, job_transitions, crash_recovery, fifo_next, job_fold_stream, stem_classify, cleanup_pick, title_search, format_fields, path_fields, range_slice,
    upload_triage, stft_bins, stft_roundtrip, spectral_ensemble, first_source, title_duration, limited_inputs, newest_jobs, job_by_id, job_states_fold, job_states_stream, first_ready,
    slot_with_fallback, longest_chosen, card_upgrade, metrics_fields, clock_fields, upload_result, rejected_union, stream_plan, one_shot, manifest_files, index_files, peaks_files, wav_files, jobs_files,
    chunk_level, chunk_normalize, chunk_residual, chunk_envelope, wav_source, card_merge, manifest_merge,
    rounded_fields, rounded_levels, stored_names, log_spectrogram, both_listings, present_models, log_stream, envelope_pyramid,
)} | {f"ensemble_{algo}": _ensemble(algo) for algo in ("max", "min", "avg")} | {f"chunk_ensemble_{algo}": _chunk_ensemble(algo) for algo in ("max", "min", "avg")}
