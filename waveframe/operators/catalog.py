"""Catalogue of files and their variants: discovery, manifests, index, listing, order, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# Names and labels of the catalogue.
EXCLUDED_DIRS = ["__pycache__", ".git", ".venv", "drive_pull", "lib", "models", "output"]
ORIGINAL_NAMES = ["original.mp3", "original.wav", "original.flac", "original.m4a"]
GROUP_LABELS = {0: "original", 1: "instrumental", 2: "vocals", 3: "other", 4: "diff"}


def discover(files: DataFrame, top: str = "top", root: str = "") -> DataFrame:
    """path, name, size of inputs: mp3 and wav, no dot files, none below an excluded directory of the root; of files with
    the same name and size the first by (top level last, path). files: path, size, top (boolean)."""
    name = X.basename(F.col("path"))
    plain = root.split("://")[-1].removeprefix("file:").rstrip("/")
    inside = F.substring_index("path", f"{plain}/", -1) if plain else F.col("path")
    below = F.exists(F.split(inside, "/"), lambda d: d.isin(EXCLUDED_DIRS))
    kept = files.withColumn("name", name).where(~F.col("name").startswith(".") & F.lower("name").rlike(r"\.(mp3|wav)$") & (F.col(top) | ~below))
    return kept.groupBy("name", "size").agg(F.min_by("path", F.struct(F.col(top), F.col("path"))).alias("path")).select("path", "name", "size")


def both_listings(tree: DataFrame, root: DataFrame, top: str = "top") -> DataFrame:
    """The recursive listing of the input tree and the root's own files, marked by `top`; of equal files discover() prefers the tree's."""
    columns = ["path", "size"]
    return tree.select(*columns, F.lit(False).alias(top)).unionByName(root.select(*columns, F.lit(True).alias(top)))


def free_names(files: DataFrame, existing: DataFrame, order: str, name: str = "name") -> DataFrame:
    """files with `stored`, a name that nothing else has: a name's first file (in the order given) keeps it if it is
    free; each other one gets the smallest number that is free for it, as base_number.ext.

    Names that exist and names that come are taken, so numbers fill the gaps between them. The j-th taken number t of
    a name (from 0) has t - j free ones before it, so the k-th file's number is k and the taken ones that stand before
    it by that measure: a window by name instead of a search. existing: name.
    """
    coming = files.select(F.col(name).alias("_name")).distinct()
    there = existing.select(F.col(name).alias("_name")).distinct()
    base = X.stem(F.col("_name"))
    parts = F.regexp_extract(base, "^(.*)_([1-9][0-9]{0,17})$", 1), F.regexp_extract(base, "^(.*)_([1-9][0-9]{0,17})$", 2)
    of = F.concat(parts[0], F.substr("_name", F.char_length(base) + 1))
    numbered = there.unionByName(coming).distinct().where(parts[1] != "").select(of.alias("_name"), parts[1].cast("long").alias("number"))
    taken = there.select("_name", F.lit(0).cast("long").alias("number")).unionByName(numbered).join(coming, "_name", "left_semi")
    before = F.row_number().over(Window.partitionBy("_name").orderBy("number")) - 1
    places = taken.select("_name", (F.col("number") - before).alias("place"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("_at"))
    own = (F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1).cast("long")
    rows = files.withColumn("_at", own)
    both = places.unionByName(rows.select(F.col(name).alias("_name"), F.col("_at").alias("place"), F.lit(1).alias("side"), "_at"))
    upto = F.sum(1 - F.col("side")).over(Window.partitionBy("_name").orderBy("place", "side").rowsBetween(Window.unboundedPreceding, 0))
    numbers = both.withColumn("number", F.col("_at") + upto).where("side = 1").select(F.col("_name").alias("_own"), F.col("_at").alias("_its"), "number")
    met = rows.join(numbers, rows[name].eqNullSafe(numbers["_own"]) & (rows["_at"] == numbers["_its"]))
    return met.withColumn("stored", X.numbered(F.col(name), F.col("number"))).select(*files.columns, "stored")


def original_of(assets: DataFrame) -> DataFrame:
    """slug, original: the first of the known names that a slug has. assets: slug, rel."""
    place = F.array_position(F.array(*[F.lit(x) for x in ORIGINAL_NAMES]), F.col("rel"))
    return assets.where(F.col("rel").isin(ORIGINAL_NAMES)).groupBy("slug").agg(F.min_by("rel", place).alias("original"))


def last_wins(records: DataFrame, keys: list[str], line: str, values: list[str]) -> DataFrame:
    """The last line's values for each key, at the first line's position."""
    last = F.max_by(F.struct(*values), F.col(line)).alias("last")
    return records.groupBy(*keys).agg(last, F.min(line).alias("position")).select(*keys, "last.*", "position")


def limited(files: DataFrame, most: int = 0) -> DataFrame:
    """Files by path, the first `most` of them (0: all)."""
    ordered_ = files.orderBy("path")
    return ordered_.limit(most) if most else ordered_


def index_rollup(records: DataFrame, slug: str, id_: str, position: str, duration: str, output: str | None = None) -> DataFrame:
    """slug, title, original, duration_s, n_variants (distinct), n_rows, variants: the ids of a file's variants,
    the original apart, in order of their first position.

    The title is the slug; the original is the output of the row with that id, or its usual name.
    """
    other = F.col(id_) != "original"
    each = records.groupBy(slug, id_).agg(F.min(position).alias("p"), F.count("*").alias("n"), F.max(duration).alias("d"), F.max(output if output else F.lit(None).cast("string")).alias("o"))
    ids = F.array_sort(F.collect_list(F.when(other, F.struct("p", F.col(id_).alias("id")))))
    whole = each.groupBy(slug).agg(
        F.max(F.when(~other, F.col("o"))).alias("original"), F.max(F.when(~other, F.col("d"))).alias("duration_s"),
        F.count_if(other).alias("n_variants"), F.coalesce(F.sum(F.when(other, F.col("n"))), F.lit(0)).alias("n_rows"), F.transform(ids, lambda x: x["id"]).alias("variants"),
    )
    return whole.select(slug, F.col(slug).cast("string").alias("title"), F.coalesce("original", F.lit(ORIGINAL_NAMES[0])).alias("original"), "duration_s", "n_variants", "n_rows", "variants")


def first_source(records: DataFrame, slug: str, position: str, duration: str, source: Column) -> DataFrame:
    """slug, live_duration_s: the duration of each slug's first source row, null if that row has none."""
    return records.where(source).groupBy(slug).agg(F.min_by(F.struct(F.col(duration).alias("d")), position)["d"].alias("live_duration_s"))


def title_and_duration(slugs: DataFrame, index: DataFrame, durations: DataFrame, slug: str = "slug") -> DataFrame:
    """slugs with title and duration_s of the index's first entry (position), else the slug itself and the first source's."""
    entry = index.groupBy(slug).agg(F.min_by(F.struct("title", "duration_s"), "position").alias("entry"))
    rows = slugs.join(entry, slug, "left").join(durations, slug, "left")
    title = F.coalesce(F.nullif(F.col("entry.title"), F.lit("")), F.col(slug).cast("string"))
    return rows.select(*slugs.columns, title.alias("title"), F.coalesce("entry.duration_s", "live_duration_s").alias("duration_s"))


def listing(index: DataFrame, live: DataFrame) -> DataFrame:
    """The stored index merged with what is on disk, one row a slug.

    index: slug, title, original, duration_s, n_variants. live: slug, original, has_manifest,
    n_live, live_duration_s. A slug on disk alone needs an original or a manifest.
    """
    i, d = index.alias("i"), live.alias("d")
    both = i.join(d, F.col("i.slug") == F.col("d.slug"), "full_outer")
    on_disk, manifest = F.col("d.slug").isNotNull(), F.coalesce(F.col("d.has_manifest"), F.lit(False))
    original = F.coalesce(F.col("i.original"), F.col("d.original"))
    status = F.when(~on_disk, "pending").when(manifest, "ready").when(original.isNotNull(), "processing").otherwise("pending")
    slug = F.coalesce(F.col("i.slug"), F.col("d.slug"))
    rows = both.where(F.col("i.slug").isNotNull() | F.col("d.original").isNotNull() | manifest)
    return rows.select(
        slug.alias("slug"), F.coalesce(F.nullif(F.col("i.title"), F.lit("")), slug.cast("string")).alias("title"), original.alias("original"),
        F.coalesce(F.col("i.duration_s"), F.when(manifest, F.col("d.live_duration_s"))).alias("duration_s"),
        F.coalesce(F.when(manifest, F.nullif(F.col("d.n_live"), F.lit(0))), F.col("i.n_variants")).alias("n_variants"), status.alias("status"),
    )


def display_group(kind: Column, stem: Column, id_: Column) -> Column:
    kind, stem = F.lower(F.coalesce(kind, F.lit(""))), F.lower(F.coalesce(stem, F.lit("")))
    return F.when((kind == "source") | (id_ == "original"), 0).when(kind == "diff", 4).when(stem.contains("instrument"), 1).when(stem.contains("vocal"), 2).otherwise(3)


def model_rank(kind: Column, id_: Column, description: Column, stem: Column) -> Column:
    """Order of models within a group: an ensemble's text names its models, so ensembles are told first."""
    own = F.lower(F.coalesce(id_, F.lit("")))
    text = F.lower(F.concat_ws(" ", F.coalesce(id_, F.lit("")), F.coalesce(description, F.lit("")), F.coalesce(stem, F.lit(""))))
    cleaned = text.rlike("deecho|de-echo|dereverb|de-reverb")
    return (
        F.when((kind == "ensemble") | own.contains("ensemble"), 2).when(cleaned, 3)
        .when(own.contains("roformer"), 0).when(own.contains("mdx"), 1)
        .when(text.contains("roformer"), 0).when(text.contains("mdx"), 1).otherwise(5)
    )


def ordered(variants: DataFrame) -> DataFrame:
    """variants with grp, rank, label, in display order within their slug: a global sort, no window."""
    grp = display_group(F.col("kind"), F.col("stem"), F.col("id"))
    rank = model_rank(F.col("kind"), F.col("id"), F.col("description"), F.col("stem"))
    labels = F.create_map(*[F.lit(x) for kv in GROUP_LABELS.items() for x in kv])
    return variants.withColumn("grp", grp).withColumn("rank", rank).withColumn("label", F.coalesce(F.try_element_at(labels, grp), F.lit("other"))).orderBy("slug", "grp", "rank", "id")


def option_label(grp: Column, id_: Column, stem: Column) -> Column:
    mark = F.when(grp == 4, "△ ").when(grp == 0, "◎ ").otherwise("")
    return F.concat(mark, id_, F.when(F.coalesce(stem, F.lit("")) != "", F.concat(F.lit("  ("), stem, F.lit(")"))).otherwise(""))


def asset_url(slug: Column, rel: Column, exists: Column) -> Column:
    return F.when(exists & rel.isNotNull(), F.concat(F.lit("/lib/"), X.percent_encode(slug), F.lit("/"), F.array_join(F.transform(F.split(rel, "/"), X.percent_encode), "/")))


def explorer(variants: DataFrame, assets: DataFrame) -> DataFrame:
    """variants with URLs of audio, spectrogram and peaks, download names, and whether each is ready.

    variants: slug, id, output, stream, spectrogram, peaks. assets: slug, rel. An URL is there only if the file is.
    lossless_url is there if the output differs from what is played.
    """
    rows = variants.withColumn("played", F.coalesce(F.nullif(F.col("stream"), F.lit("")), F.col("output")))
    there = assets.select("slug", "rel", F.lit(True).alias("there")).distinct()
    for name, rel in (("audio", "played"), ("spec", "spectrogram"), ("peaks", "peaks"), ("whole", "output")):
        found = there.select(F.col("slug").alias("_slug"), F.col("rel").alias("_rel"), F.col("there").alias(f"_{name}"))
        rows = rows.join(found, (F.col("slug") == F.col("_slug")) & (F.col(rel) == F.col("_rel")), "left").drop("_slug", "_rel").withColumn(f"_{name}", F.coalesce(f"_{name}", F.lit(False)))

    def named(rel: str, usual: str) -> Column:
        return F.concat(F.col("slug"), F.lit("__"), F.col("id"), F.coalesce(F.nullif(X.extension(X.basename(F.col(rel))), F.lit("")), F.lit(usual)))

    url = {name: asset_url(F.col("slug"), F.col(rel), F.col(f"_{name}")) for name, rel in (("audio", "played"), ("spec", "spectrogram"), ("peaks", "peaks"), ("whole", "output"))}
    lossless = F.when(F.col("output") != F.col("played"), F.concat(url["whole"], F.lit("?dl="), X.percent_encode(named("output", ".wav"))))
    return rows.select(
        *variants.columns, url["audio"].alias("audio_url"), url["spec"].alias("spectrogram_url"), url["peaks"].alias("peaks_url"), F.when(F.col("_audio"), named("played", ".m4a")).alias("download_name"),
        lossless.alias("lossless_url"), F.col("_audio").alias("audio_ready"), F.col("_spec").alias("spec_ready"), F.col("_peaks").alias("peaks_ready"),
    )


def first_ready(variants: DataFrame, slug: str) -> DataFrame:
    """slug, id: the first variant in display order whose audio is there."""
    return variants.where("audio_ready").groupBy(slug).agg(F.min_by("id", F.struct("grp", "rank", "id")).alias("id"))


def longest_chosen(chosen: DataFrame, variants: DataFrame, keys: list[str]) -> DataFrame:
    """The longest duration of the variants chosen for comparison, 0 if none has one. chosen: keys, id."""
    rows = chosen.join(variants.select(*keys, "id", "duration_s"), [*keys, "id"], "left")
    return rows.groupBy(*keys).agg(F.coalesce(F.max("duration_s"), F.lit(0.0)).alias("duration_s"))


def upgraded(cards: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Cards after a refresh: complete ones stay, pending ones give way to fresh ones, new ones are added. Both have audio_ready."""
    columns = [c for c in cards.columns if c not in keys]
    both = cards.select(*keys, F.struct(*columns).alias("old")).join(fresh.select(*keys, F.struct(*columns).alias("new")), keys, "full_outer")
    row = F.when(F.col("old.audio_ready") | F.col("new").isNull(), F.col("old")).otherwise(F.col("new"))
    return both.select(*keys, row.alias("row")).select(*keys, "row.*")


def metrics(variants: DataFrame) -> DataFrame:
    """variants with `metrics`: label and text of the fields that each has, in a fixed order; the rate in kHz."""
    shown = [
        ("dur", F.lit(True), X.fmt_duration(F.col("duration_s"))), ("peak", F.col("peak").isNotNull(), X.fmt_fixed(F.col("peak"), 3)), ("rms", F.col("rms").isNotNull(), X.fmt_fixed(F.col("rms"), 3)),
        ("lufs", F.col("lufs_approx").isNotNull(), X.fmt_fixed(F.col("lufs_approx"), 1)),
        ("sr", F.coalesce(F.col("sr") > 0, F.lit(False)), F.concat(F.regexp_replace((F.col("sr") / 1000).cast("decimal(12,3)").cast("string"), r"\.?0+$", ""), F.lit("k"))),
        ("ch", F.coalesce(F.col("channels") > 0, F.lit(False)), F.col("channels").cast("string")),
    ]
    each = F.array(*[F.when(there, F.concat(F.lit(f"{label} "), text)) for label, there, text in shown])
    return variants.withColumn("metrics", F.filter(each, lambda x: x.isNotNull()))


def merged_flags(base: Column, over: Column) -> Column:
    """Two maps in one; where both have a key the second counts."""
    empty = F.create_map().cast("map<string,string>")
    kept = F.map_filter(F.coalesce(base, empty), lambda k, _: ~F.map_contains_key(F.coalesce(over, empty), k))
    return F.map_concat(kept, F.coalesce(over, empty))


def with_original(variants: DataFrame, originals: DataFrame) -> DataFrame:
    """variants and, for slugs with an original file but no source row, a made one."""
    have = variants.where((F.col("id") == "original") | (F.col("kind") == "source")).select("slug").distinct()
    made = originals.join(have, "slug", "left_anti").select("slug", F.lit("original").alias("id"), F.lit("source").alias("kind"), F.lit("original").alias("stem"), F.lit("Original mix").alias("description"), F.col("original").alias("output"), F.lit("done").alias("status"), F.lit(True).alias("synthetic"))
    return variants.withColumn("synthetic", F.lit(False)).unionByName(made, allowMissingColumns=True)


def presets(diffs: DataFrame, variants: DataFrame, slug: str, most: int = 5) -> DataFrame:
    """The first `most` diffs of a slug whose two inputs both exist. diffs: slug, id, inputs (array)."""
    pair = diffs.where(F.size("inputs") == 2).withColumn("pre", F.get("inputs", 0)).withColumn("post", F.get("inputs", 1))
    ids = variants.select(slug, "id").distinct()
    kept = pair.join(ids.withColumnRenamed("id", "pre"), [slug, "pre"], "left_semi").join(ids.withColumnRenamed("id", "post"), [slug, "post"], "left_semi")
    return kept.withColumn("n", F.row_number().over(Window.partitionBy(slug).orderBy("id"))).where(F.col("n") <= most).select(slug, "id", "pre", "post", "n")


def slot(variants: DataFrame, slug: str, wanted: Column, place: int) -> DataFrame:
    """slug, id: the first variant in display order that is wanted, else the one at `place` (from 0), else an empty id."""
    at = F.row_number().over(Window.partitionBy(slug).orderBy("grp", "rank", "id")) - 1
    rows = variants.withColumn("at", at).groupBy(slug).agg(F.min_by("id", F.when(wanted, F.col("at"))).alias("found"), F.max(F.when(F.col("at") == place, F.col("id"))).alias("there"))
    return rows.select(slug, F.coalesce("found", "there", F.lit("")).alias("id"))


def default_slots(variants: DataFrame, slug: str) -> DataFrame:
    """slug, a, b, c: the variants that a comparison starts with (source; ensemble or any instrumental; residual or any diff)."""
    place = F.struct("grp", "rank", "id")
    def first(condition):
        return F.min_by("id", F.when(condition, place))

    g, id_ = F.col("grp"), F.col("id")
    a, b, b2, c, c2 = first(g == 0), first((g == 1) & F.lower(id_).contains("ensemble")), first(g == 1), first(id_ == "residual_voice"), first(g == 4)
    return variants.groupBy(slug).agg(a.alias("a"), F.coalesce(b, b2).alias("b"), F.coalesce(c, c2).alias("c"))


def stem_of(name: Column) -> Column:
    """Instrumental or vocals from a separator's output name, instrumental first; null if neither."""
    low = F.lower(name)
    return F.when(low.contains("(instrumental)") | low.contains("_instrumental") | low.contains("no vocals"), "instrumental").when(low.contains("(vocals)") | low.contains("_vocals"), "vocals")


def cleanup_pick(outputs: DataFrame, keys: list[str], keep: Column) -> DataFrame:
    """The first output whose name has the stem to keep, else the first. outputs: keys, name, ord.

    Only the stem counts: a `no` elsewhere in a model's name picks nothing.
    """
    squeezed = F.replace(F.lower("name"), F.lit(" "), F.lit(""))
    miss = ~F.contains(squeezed, F.replace(F.lower(keep), F.lit(" "), F.lit("")))
    return outputs.groupBy(*keys).agg(F.min_by("name", F.struct(miss, F.col("ord"))).alias("name"))


def search(rows: DataFrame, query: str, title: str = "title", slug: str = "slug") -> DataFrame:
    wanted = query.strip().lower()
    shown = F.lower(F.coalesce(F.nullif(F.col(title), F.lit("")), F.col(slug)))
    return rows.where(F.contains(shown, F.lit(wanted))) if wanted else rows


def slug_collisions(files: DataFrame, path: str, id_: str) -> DataFrame:
    """slug, n, first of slugs that several files would share."""
    return files.groupBy(X.slugify(F.col(path)).alias("slug")).agg(F.count("*").alias("n"), F.min(id_).alias("first")).where("n > 1")


def uploads(parts: DataFrame) -> DataFrame:
    """Uploaded parts with `reason`, null if accepted. parts: filename, size, and failure (a text, if a write failed)."""
    name = F.coalesce(F.col("filename"), F.lit(""))
    reason = F.when(name == "", "ignored").when(~X.extension(name).isin(".mp3", ".wav"), "only .mp3/.wav accepted").when(F.col("size") == 0, "empty file")
    failed = F.col("failure") if "failure" in parts.columns else F.lit(None).cast("string")
    return parts.withColumn("reason", F.coalesce(reason, F.concat(F.lit("write failed: "), failed)))


def upload_result(triaged: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ok (whether any is accepted), accepted and rejected (names in order) of each request. A request's parts are few."""
    ok, name = F.col("reason").isNull(), F.col("filename")
    return triaged.groupBy(*keys).agg(
        F.bool_or(ok).alias("ok"), F.array_sort(F.collect_list(F.when(ok, name))).alias("accepted"),
        F.array_sort(F.collect_list(F.when(~ok & (F.col("reason") != "ignored"), name))).alias("rejected"),
    )


def all_rejected(server: DataFrame, client: DataFrame) -> DataFrame:
    """What the server and what the client has rejected, in one table."""
    return server.select("filename", "reason", F.lit("server").alias("side")).unionByName(client.select("filename", "reason", F.lit("client").alias("side")))


def byte_range(size: Column, header: Column) -> Column:
    """struct(status, first, last) for a Range header: 200 whole, 206 part, 416 outside."""
    m = [F.regexp_extract(F.coalesce(header, F.lit("")), r"^bytes=(\d*)-(\d*)$", k) for k in (1, 2)]
    first, last = (F.nullif(x, F.lit("")).try_cast("long") for x in m)
    suffix = first.isNull() & (last > 0)
    start = F.when(first.isNotNull(), first).when(suffix, F.greatest(size - last, F.lit(0)))
    end = F.when(suffix | last.isNull(), size - 1).otherwise(F.least(last, size - 1))
    whole = F.struct(F.lit(200).alias("status"), F.lit(0).cast("long").alias("first"), (size - 1).alias("last"))
    outside = F.struct(F.lit(416).alias("status"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"))
    part = F.struct(F.lit(206).alias("status"), start.alias("first"), end.alias("last"))
    return F.when(start.isNull(), whole).when((start >= size) | (start > end), outside).otherwise(part)


def safe_path(rel: Column) -> Column:
    """Whether a path, decoded and with its . and .. parts resolved, stays below its root."""
    return X.normal_path(X.percent_decode(rel)).isNotNull()
