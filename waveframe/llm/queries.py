"""One query for each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, licences, merkle, minhash, mixing, pages, pieces, pii, quality, resampling, toxicity, vectors, whitening
from .common import table


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"))


def op3_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.links(table(spark, sf_dir, "embeddings"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op8_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edit_check(table(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digest(table(spark, sf_dir, "embeddings"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash, op2_sentencepiece, op3_vectors, op4_quality, op5_mixing, op6_toxicity, op7_licences, op8_merkle, op9_html, op10_pii,
        op11_bpe, op12_whitening, op13_resampling,
    )
}

ORACLES = {
    "op5_mixing": r"""
WITH docs AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         sha256('fair-queue-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS ord
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank
  FROM docs GROUP BY source),
weighed AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight,
         3 * source_size AS cap FROM sources),
filled AS (
  SELECT *, row_number() OVER (ORDER BY cap::DOUBLE / weight, rank) AS place,
         sum(source_size) OVER ()::BIGINT AS total,
         coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped,
         sum(weight) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS open
  FROM weighed),
level AS (
  SELECT place, capped, open FROM filled WHERE weight * (total - capped) <= cap * open ORDER BY place LIMIT 1),
targets AS (
  SELECT f.source, f.source_size, f.rank, f.total,
         CASE WHEN f.place >= l.place THEN (f.weight * (f.total - l.capped))::DOUBLE / l.open::DOUBLE ELSE f.cap::DOUBLE END AS target
  FROM filled f, level l),
sent AS (
  SELECT d.*, t.source_size, t.rank, t.target, t.total,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.doc_id, d.size ROWS UNBOUNDED PRECEDING)::BIGINT AS sent
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT *, (r.e * source_size + sent)::DOUBLE / nullif(target, 0) AS finish
  FROM sent, (SELECT unnest([0, 1, 2])::BIGINT AS e) r),
queue AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rank, ord, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM copies WHERE finish <= 2)
SELECT d.doc_id, d.size, d.source_size, d.target,
       coalesce(q.taken, 0)::BIGINT AS taken
FROM sent d LEFT JOIN (SELECT doc_id, sum(size) AS taken FROM queue WHERE upto <= total GROUP BY doc_id) q ON q.doc_id = d.doc_id
""",
    "op8_merkle": r"""
WITH docs AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text FROM documents),
follow AS (
  SELECT doc_id, text, length(text)::BIGINT AS n_chars,
         coalesce(lead(text) OVER (ORDER BY doc_id DESC NULLS LAST, text), first_value(text) OVER (ORDER BY doc_id DESC NULLS LAST, text)) AS next_text
  FROM docs),
edited AS (
  SELECT *, left(text, n_chars - n_chars // 2) || left(next_text, n_chars // 2) AS edited FROM follow),
trees AS (
  SELECT doc_id, n_chars, sha256(edited) AS edited_sha256,
    list_transform(string_split(text, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: list_transform(string_split(p, '. '), lambda x: sha256(x)))) AS a,
    list_transform(string_split(edited, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: list_transform(string_split(p, '. '), lambda x: sha256(x)))) AS b,
    list_transform(string_split(next_text, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: list_transform(string_split(p, '. '), lambda x: sha256(x)))) AS c
  FROM edited),
paragraphs AS (
  SELECT *, list_transform(a, lambda s: list_transform(s, lambda p: sha256(array_to_string(p, ',')))) AS pa,
            list_transform(b, lambda s: list_transform(s, lambda p: sha256(array_to_string(p, ',')))) AS pb FROM trees),
blocks AS (
  SELECT *, list_transform(pa, lambda s: sha256(array_to_string(s, ','))) AS sa,
            list_transform(pb, lambda s: sha256(array_to_string(s, ','))) AS sb FROM paragraphs),
apart AS (
  SELECT *, flatten(list_transform(list_filter(range(greatest(len(sa), len(sb))), lambda k: sa[k + 1] IS DISTINCT FROM sb[k + 1]), lambda k:
    list_transform(list_filter(range(greatest(coalesce(len(pa[k + 1]), 0), coalesce(len(pb[k + 1]), 0))), lambda p: pa[k + 1][p + 1] IS DISTINCT FROM pb[k + 1][p + 1]), lambda p: k || '.' || p))) AS apart FROM blocks),
leaves AS (
  SELECT *, list_transform(flatten(flatten(a)), lambda x: left(x, 16)) AS la, list_transform(flatten(flatten(b)), lambda x: left(x, 16)) AS lb,
            list_transform(flatten(flatten(c)), lambda x: left(x, 16)) AS lc FROM apart)
SELECT doc_id, n_chars, edited_sha256,
  sha256(array_to_string(sa, ',')) || '/' || array_to_string(list_transform(sa, lambda x: left(x, 16)), '.') || '/' || array_to_string(list_transform(flatten(pa), lambda x: left(x, 16)), '.') || '/' || array_to_string(la, '.') AS fingerprint,
  sha256(array_to_string(sb, ',')) || '/' || array_to_string(list_transform(sb, lambda x: left(x, 16)), '.') || '/' || array_to_string(list_transform(flatten(pb), lambda x: left(x, 16)), '.') || '/' || array_to_string(lb, '.') AS edited_fingerprint,
  (2 * len(list_intersect(list_distinct(la), list_distinct(lb))))::DOUBLE / (len(list_distinct(la)) + len(list_distinct(lb)))::DOUBLE AS near_edited,
  (2 * len(list_intersect(list_distinct(la), list_distinct(lc))))::DOUBLE / (len(list_distinct(la)) + len(list_distinct(lc)))::DOUBLE AS near_next,
  len(apart)::BIGINT AS n_edited_paragraphs, apart[1] AS first_edit
FROM leaves
""",
    "op13_resampling": r"""
WITH RECURSIVE texts AS (
  SELECT true AS own, CAST(doc_id AS BIGINT) AS doc_id, row_number() OVER () AS row_id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT false, NULL, -row_number() OVER (), coalesce(text, '') FROM benchmark),
split AS (
  SELECT own, doc_id, row_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
docs AS (
  SELECT *, len(w)::BIGINT AS n_words, (len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0))::BIGINT AS n_features FROM split),
runs AS (
  SELECT own, row_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM docs),
counted AS (SELECT own, row_id, f, count(*) AS n FROM runs GROUP BY ALL),
crc_table AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce([b, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS b))),
hashed AS (
  SELECT f, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(f), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM counted), crc_table),
entries AS (SELECT own, row_id, bucket, sum(n)::BIGINT AS n FROM counted JOIN hashed USING (f) GROUP BY ALL),
sums AS (
  SELECT b AS bucket, coalesce(s, 0) AS s, coalesce(t, 0) AS t, sum(coalesce(s, 0)) OVER () AS all_s, sum(coalesce(t, 0)) OVER () AS all_t
  FROM (SELECT unnest(range(10000)) AS b) LEFT JOIN (SELECT bucket, sum(n) FILTER (own)::BIGINT AS s, sum(n) FILTER (NOT own)::BIGINT AS t FROM entries GROUP BY bucket) ON b = bucket),
gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain FROM sums),
weighed AS (SELECT row_id, sum(n * gain)::BIGINT AS weight FROM entries JOIN gains USING (bucket) WHERE own GROUP BY row_id),
scored AS (
  SELECT doc_id, n_words, n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((CAST('0x' || left(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM docs LEFT JOIN weighed USING (row_id) WHERE own),
placed AS (
  SELECT *, row_number() OVER (ORDER BY n_words < 20, score DESC, doc_id NULLS LAST, weight DESC, n_features DESC, n_words) AS place,
         5 * count(*) FILTER (n_words >= 20) OVER () // 100 AS drawn FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM placed
""",
}
