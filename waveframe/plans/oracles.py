"""DuckDB SQL for the queries of queries.py, written apart from the operators."""

SIGNAL = "sig AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, value AS v FROM events)"
KINDS = "sig AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS i, value AS v FROM events)"
VECTORS = "vec AS (SELECT vec_id, label, unnest(generate_series(0, len(embedding) - 1))::INT AS i, unnest(embedding) AS v FROM embeddings)"
LOG = """log AS (SELECT user_id AS job, event_id AS seq,
  CASE event_type WHEN 'click' THEN '[ensemble] file' WHEN 'view' THEN '=== loading model (tag) ===' WHEN 'purchase' THEN 'DONE: processed 1 file(s)'
    WHEN 'signup' THEN 'JOB: processing 1 file(s)' WHEN 'error' THEN '[manifest] slug_x: 6 entries' ELSE 'transcoded 6 new AAC streams' END AS line FROM events),
marked AS (SELECT *,
  CASE WHEN contains(line, 'JOB: processing') THEN 'starting' WHEN contains(line, '=== loading') THEN 'separating (running models)' WHEN contains(line, '[ensemble]') THEN 'ensembling'
    WHEN contains(line, '[manifest]') THEN 'variants written' WHEN contains(line, 'transcoded') THEN 'transcoding (AAC)' WHEN contains(line, 'DONE: processed') THEN 'finalizing' END AS phase,
  CASE WHEN contains(line, 'JOB: processing') THEN 0.05 WHEN contains(line, '=== loading') THEN 0.25 WHEN contains(line, '[ensemble]') THEN 0.6
    WHEN contains(line, '[manifest]') THEN 0.75 WHEN contains(line, 'transcoded') THEN 0.95 WHEN contains(line, 'DONE: processed') THEN 0.99 END::DOUBLE AS progress,
  CASE WHEN contains(line, '[manifest]') THEN regexp_extract(line, '\\[manifest\\]\\s+(.+?):', 1) END AS slug FROM log)"""
JOBS = """jobs AS (SELECT event_id AS seq, user_id, (['queued', 'running', 'done', 'failed', 'stopped', 'canceled'])[event_id % 6 + 1] AS status,
  CASE WHEN event_id % 4 != 0 THEN event_type END AS slug, CASE WHEN event_id % 6 != 0 THEN value END AS started, CASE WHEN event_id % 6 > 1 THEN value * 2 END AS ended FROM events)"""
VARIANTS = """variants AS (SELECT source AS slug, (['roformer', 'mdx23c', 'deecho', 'denoise', 'x'])[doc_id % 5 + 1] || '_' || doc_id AS id,
  CASE doc_id % 11 WHEN 0 THEN 'source' WHEN 1 THEN 'diff' WHEN 2 THEN 'ensemble' ELSE 'separate' END AS kind,
  CASE lang WHEN 'en' THEN 'Instrumental' WHEN 'de' THEN 'Vocals' WHEN 'fr' THEN 'residual' END AS stem,
  CASE doc_id % 3 WHEN 0 THEN 'de-echo pass' WHEN 1 THEN 'normalized roformer mix' ELSE 'plain' END AS description,
  CASE WHEN n_chars > 200 THEN 'done' ELSE 'error' END AS status, CASE WHEN doc_id % 4 = 0 THEN -5.0 END::DOUBLE AS normalized_dbfs,
  'out/' || doc_id || '.wav' AS output, CASE WHEN doc_id % 2 = 0 THEN 'out/' || doc_id || '.m4a' END AS stream, doc_id FROM documents),
ranked AS (SELECT *, CASE WHEN kind = 'source' OR id = 'original' THEN 0 WHEN kind = 'diff' THEN 4 WHEN stem = 'Instrumental' THEN 1 WHEN stem = 'Vocals' THEN 2 ELSE 3 END AS grp,
  CASE WHEN kind = 'ensemble' THEN 2 WHEN id LIKE 'deecho%' OR description LIKE '%de-echo%' THEN 3 WHEN id LIKE 'roformer%' THEN 0 WHEN id LIKE 'mdx%' THEN 1
    WHEN description LIKE '%roformer%' THEN 0 ELSE 5 END AS rank FROM variants)"""
FILES = """files AS (SELECT 'input/' || CASE WHEN page_id % 7 = 0 THEN 'models/' ELSE '' END || (page_id % 5) || '/' || CASE WHEN page_id % 13 = 0 THEN '.' ELSE '' END || regexp_extract(url, '//([^/]*)', 1)
  || (['.mp3', '.WAV', '.txt', '.Mp3'])[page_id % 4 + 1] AS path, (length(html) % 3)::BIGINT AS size, page_id % 3 = 0 AS top FROM pages),
named AS (SELECT *, regexp_extract(path, '[^/]*$') AS name FROM files)"""
ENVELOPE = "peaks AS (SELECT user_id, i AS bucket, v AS lo, v AS hi, max(i + 1) OVER (PARTITION BY user_id) AS n FROM sig)"


def _rebucket(name: str, source: str, width: int) -> str:
    return f"""{name}_cols AS (SELECT user_id, n, unnest(generate_series(0, {width - 1}))::INT AS x FROM (SELECT DISTINCT user_id, n FROM {source})),
{name} AS (SELECT c.user_id, c.x, coalesce(min(p.lo), 0.0) AS lo, coalesce(max(p.hi), 0.0) AS hi FROM {name}_cols c LEFT JOIN {source} p ON p.user_id = c.user_id
  AND p.bucket >= floor(c.x / {width}.0::DOUBLE * c.n) AND p.bucket < greatest(floor(c.x / {width}.0::DOUBLE * c.n) + 1, floor((c.x + 1) / {width}.0::DOUBLE * c.n)) GROUP BY c.user_id, c.x)"""


def _side(name: str, kind: str) -> str:
    return f"{name} AS (SELECT user_id, i AS bucket, v AS lo, v AS hi, max(i + 1) OVER (PARTITION BY user_id) AS n FROM sig WHERE event_type = '{kind}')"


def _best(order: str) -> str:
    return f"WITH {VECTORS} SELECT label, i, v FROM (SELECT *, row_number() OVER (PARTITION BY label, i ORDER BY {order}, vec_id) AS r FROM vec) WHERE r = 1"


def _frames(source: str, keys: str, lengths: str) -> str:
    """Frames of 64 samples, 16 apart, centred, under a periodic Hann window: their transform by its definition."""
    return f"""lengths AS ({lengths}),
framed AS (SELECT {keys}, f AS frame, i - f * 16 + 32 AS p, v * (0.5 - 0.5 * cos(pi() * (i - f * 16 + 32) / 32)) AS x FROM {source} JOIN (SELECT *, unnest(range(n // 16 + 1)) AS f FROM lengths) USING ({keys}) WHERE i < n AND i - f * 16 + 32 BETWEEN 0 AND 63),
grid AS (SELECT {keys}, unnest(range(n // 16 + 1)) AS frame FROM lengths),
spectra AS (SELECT {keys}, frame, bin, coalesce(sum(x * cos(pi() * bin * p / 32)), 0.0) AS re, coalesce(-sum(x * sin(pi() * bin * p / 32)), 0.0) AS im FROM grid LEFT JOIN framed USING ({keys}, frame), (SELECT unnest(range(33)) AS bin) GROUP BY ALL)"""


CARDS = VARIANTS + ", cards AS (SELECT slug, id, grp, rank, n_chars > 300 AS audio_ready, n_chars / 7 AS duration_s, doc_id FROM ranked JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id))"


def _states(columns: str) -> str:
    """Each job's actions from its first to its last."""
    return f"""WITH RECURSIVE acts AS (SELECT user_id::VARCHAR AS job, (['start', 'stop', 'finish', 'start', 'cancel', 'remove', 'fail'])[event_id % 7 + 1] AS action, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
run AS (SELECT DISTINCT job, 0::BIGINT AS k, 'queued' AS status, 0::BIGINT AS refused FROM acts
  UNION ALL SELECT r.job, a.k, coalesce(m.after, r.status), r.refused + CASE WHEN m.after IS NULL THEN 1 ELSE 0 END FROM run r JOIN acts a ON a.job = r.job AND a.k = r.k + 1
  LEFT JOIN (VALUES ('start', 'queued', 'running'), ('cancel', 'queued', 'canceled'), ('stop', 'running', 'stopped'), ('finish', 'running', 'done'), ('fail', 'running', 'failed'),
    ('remove', 'done', 'removed'), ('remove', 'failed', 'removed'), ('remove', 'stopped', 'removed'), ('remove', 'canceled', 'removed')) m(action, before, after) ON m.action = a.action AND m.before = r.status)
SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY k DESC) AS last FROM run) WHERE last = 1"""


ORACLES = {
    "signal_level": f"WITH {SIGNAL} SELECT user_id, max(abs(v)) AS peak, round(sqrt(avg(v * v)), 6) AS rms, round(20 * log10(sqrt(avg(v * v)) + 1e-9), 6) AS loudness, 44100 AS sr, 1::BIGINT AS channels, count(*) / 44100.0::DOUBLE AS duration_s FROM sig GROUP BY user_id",
    "signal_envelope": f"WITH {SIGNAL}, l AS (SELECT user_id, greatest(1, count(*) // 16) AS step FROM sig GROUP BY user_id) SELECT user_id, i // step AS bucket, min(v) AS lo, max(v) AS hi FROM sig JOIN l USING (user_id) GROUP BY user_id, i // step",
    "envelope_rebucket": f"WITH {SIGNAL}, l AS (SELECT user_id, greatest(1, count(*) // 1600) AS step FROM sig GROUP BY user_id), e AS (SELECT user_id, i // step AS bucket, min(v) AS lo, max(v) AS hi FROM sig JOIN l USING (user_id) GROUP BY user_id, i // step), peaks AS (SELECT *, max(bucket + 1) OVER (PARTITION BY user_id) AS n FROM e), {_rebucket('r', 'peaks', 120)} SELECT * FROM r",
    "envelope_divergence": f"WITH {KINDS}, {_side('a', 'click')}, {_side('b', 'view')}, {_rebucket('ra', 'a', 60)}, {_rebucket('rb', 'b', 60)} SELECT ra.user_id, ra.x, greatest(abs(ra.hi - rb.hi), abs(ra.lo - rb.lo)) AS delta FROM ra JOIN rb ON ra.user_id = rb.user_id AND ra.x = rb.x",
    "peak_normalize": f"WITH {SIGNAL}, g AS (SELECT user_id, 0.5623413251903491 / max(abs(v)) AS gain FROM sig GROUP BY user_id) SELECT user_id, i, v * gain AS v, gain FROM sig JOIN g USING (user_id)",
    "normalize_eligible": f"WITH {VARIANTS} SELECT doc_id, slug, CASE WHEN contains(lower(description), 'normaliz') THEN description ELSE description || ' · normalized to -5 dBFS peak' END AS description, -5.0::DOUBLE AS normalized_dbfs FROM variants WHERE stem = 'Instrumental' AND status = 'done' AND normalized_dbfs IS DISTINCT FROM -5.0 AND doc_id IN (SELECT doc_id FROM labels)",
    "ensemble_max": _best("abs(v) DESC"),
    "ensemble_min": _best("abs(v)"),
    "ensemble_avg": f"WITH {VECTORS} SELECT label, i, round(avg(v::DOUBLE), 9) AS v FROM vec GROUP BY label, i",
    "residual_diff": f"WITH {VECTORS} SELECT a.vec_id, a.i, a.v - b.v AS v FROM vec a JOIN vec b ON b.vec_id = a.vec_id + 1 AND b.i = a.i",
    "align_shortest": f"WITH {KINDS}, n AS (SELECT user_id, min(c) AS shortest FROM (SELECT user_id, event_type, count(*) AS c FROM sig GROUP BY ALL) GROUP BY user_id) SELECT user_id, event_type, i, v FROM sig JOIN n USING (user_id) WHERE i < shortest",
    "mono_mixdown": "SELECT l_suppkey AS supplier, l_linenumber AS i, round(avg(l_extendedprice), 6) AS v FROM lineitem GROUP BY l_suppkey, l_linenumber",
    "amplitude_db": f"WITH {VECTORS}, m AS (SELECT vec_id, greatest(max(abs(v))::DOUBLE, 1e-5) AS most FROM vec GROUP BY vec_id) SELECT vec_id, i, round(greatest(20 * log10(greatest(abs(v)::DOUBLE, 1e-5) / most), -80.0), 6) AS db FROM vec JOIN m USING (vec_id)",
    "discover_inputs": f"WITH {FILES} SELECT path, name, size FROM (SELECT *, row_number() OVER (PARTITION BY name, size ORDER BY top, path) AS r FROM named WHERE name NOT LIKE '.%' AND regexp_matches(lower(name), '\\.(mp3|wav)$') AND (top OR NOT contains(path, '/models/'))) WHERE r = 1",
    "slugify": "WITH b AS (SELECT page_id, regexp_extract(url, '[^/]*$') AS base FROM pages), s AS (SELECT *, regexp_replace(base, '^(\\.*[^.].*)\\.[^.]*$', '\\1') AS stem FROM b) SELECT page_id, regexp_replace(regexp_replace(stem, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, lower(substr(base, length(stem) + 1)) AS ext FROM s",
    "slug_collisions": "SELECT regexp_replace(regexp_replace(p_name, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1 HAVING count(*) > 1",
    "sanitize_unique": "WITH s AS (SELECT p_partkey, regexp_replace(p_name || '!', '[^A-Za-z0-9._ -]+', '_', 'g') AS base FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) - 1 AS k FROM s) SELECT p_partkey, base || CASE WHEN k = 0 THEN '' ELSE '_' || k END || '.mp3' AS name FROM n",
    "manifest_last_wins": "SELECT o_custkey, o_orderpriority, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus, arg_max(o_totalprice, o_orderkey) AS o_totalprice, min(o_orderkey) AS position FROM orders GROUP BY o_custkey, o_orderpriority",
    "manifest_parse": "SELECT user_id AS slug, 'v' || event_type AS id, 'separate' AS kind, arg_max(value, event_id) AS duration_s, 2 AS n_inputs, min(event_id) AS position FROM events WHERE event_id % 7 > 2 GROUP BY user_id, event_type",
    "index_rollup": """WITH e AS (SELECT o_custkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'original' ELSE o_orderpriority END AS id, min(o_orderkey) AS p, count(*) AS n, max(o_totalprice) AS d, max(o_orderstatus) AS o FROM orders GROUP BY ALL)
SELECT o_custkey, o_custkey::VARCHAR AS title, coalesce(max(o) FILTER (id = 'original'), 'original.mp3') AS original, max(d) FILTER (id = 'original') AS duration_s, count(*) FILTER (id <> 'original') AS n_variants,
  coalesce(sum(n) FILTER (id <> 'original'), 0)::BIGINT AS n_rows, coalesce(string_agg(id, ',' ORDER BY p) FILTER (id <> 'original'), '') AS variants FROM e GROUP BY o_custkey""",
    "listing_merge": """WITH i AS (SELECT o_custkey AS slug, min(o_orderstatus) AS title, CASE WHEN o_custkey % 5 != 0 THEN max(o_orderpriority) END AS original, CASE WHEN o_custkey % 3 != 0 THEN max(o_totalprice) END AS duration_s, count(*) AS n_variants FROM orders GROUP BY o_custkey),
d AS (SELECT c_custkey AS slug, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS original, c_nationkey % 2 = 0 AS has_manifest, (c_nationkey % 4)::BIGINT AS n_live, c_acctbal AS live FROM customer WHERE c_acctbal > 0)
SELECT coalesce(i.slug, d.slug) AS slug, coalesce(nullif(i.title, ''), coalesce(i.slug, d.slug)::VARCHAR) AS title, coalesce(i.original, d.original) AS original,
  coalesce(i.duration_s, CASE WHEN has_manifest THEN live END) AS duration_s, coalesce(CASE WHEN has_manifest THEN nullif(n_live, 0) END, n_variants) AS n_variants,
  CASE WHEN d.slug IS NULL THEN 'pending' WHEN has_manifest THEN 'ready' WHEN coalesce(i.original, d.original) IS NOT NULL THEN 'processing' ELSE 'pending' END AS status
FROM i FULL OUTER JOIN d ON i.slug = d.slug WHERE i.slug IS NOT NULL OR d.original IS NOT NULL OR has_manifest""",
    "variant_order": f"WITH {VARIANTS} SELECT slug, id, grp, rank, (['original', 'instrumental', 'vocals', 'other', 'diff'])[grp + 1] AS label, (row_number() OVER (PARTITION BY slug ORDER BY grp, rank, id))::INT AS place FROM ranked",
    "option_labels": f"WITH {VARIANTS} SELECT id, CASE grp WHEN 4 THEN '△ ' WHEN 0 THEN '◎ ' ELSE '' END || id || coalesce('  (' || stem || ')', '') AS label FROM ranked",
    "default_slots": f"WITH {VARIANTS} SELECT slug, arg_min(id, (rank, id)) FILTER (grp = 0) AS a, coalesce(arg_min(id, (rank, id)) FILTER (grp = 1 AND contains(lower(id), 'ensemble')), arg_min(id, (rank, id)) FILTER (grp = 1)) AS b, coalesce(arg_min(id, (rank, id)) FILTER (id = 'residual_voice'), arg_min(id, (rank, id)) FILTER (grp = 4)) AS c FROM ranked GROUP BY slug",
    "explorer_view": f"""WITH {VARIANTS}, p AS (SELECT v.*, coalesce(stream, output) AS played, l.doc_id IS NOT NULL AS ready, coalesce(quality = 1, false) AS spec, coalesce(toxic = 0 AND v.doc_id % 3 = 0, false) AS peak FROM variants v LEFT JOIN labels l USING (doc_id))
SELECT slug, id, CASE WHEN ready THEN '/lib/' || slug || '/' || played END AS audio_url, CASE WHEN spec THEN '/lib/' || slug || '/a%20b/' || doc_id || '.png' END AS spectrogram_url, CASE WHEN peak THEN '/lib/' || slug || '/out/' || doc_id || '.json' END AS peaks_url,
  CASE WHEN ready THEN slug || '__' || id || right(played, 4) END AS download_name, CASE WHEN ready AND output <> played THEN '/lib/' || slug || '/' || output || '?dl=' || slug || '__' || id || '.wav' END AS lossless_url,
  ready AS audio_ready, spec AS spec_ready, peak AS peaks_ready FROM p""",
    "with_original": f"WITH {VARIANTS}, o AS (SELECT DISTINCT slug || CASE WHEN length(id) % 2 = 0 THEN '' ELSE '_new' END AS slug FROM variants) SELECT slug, id, kind, output, false AS synthetic FROM variants UNION ALL SELECT slug, 'original', 'source', 'original.mp3', true FROM o WHERE slug NOT IN (SELECT slug FROM variants WHERE kind = 'source')",
    "lineage_presets": "WITH c AS (SELECT DISTINCT conv_id, turn AS id FROM conversations), k AS (SELECT conv_id, id, id - 1 AS pre, id - 2 AS post FROM c WHERE EXISTS (SELECT 1 FROM c x WHERE x.conv_id = c.conv_id AND x.id = c.id - 1) AND EXISTS (SELECT 1 FROM c x WHERE x.conv_id = c.conv_id AND x.id = c.id - 2)), n AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY id))::INT AS n FROM k) SELECT * FROM n WHERE n <= 5",
    "incremental_todo": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "ensemble_pairs": "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "all_done": "SELECT o_orderkey AS slug, bool_and(EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = f)) AS done FROM orders, (VALUES ('N'), ('R')) v(f) GROUP BY o_orderkey",
    "model_cross": "SELECT r_regionkey, n_name, r_name FROM nation, region WHERE r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey % 2 = 0)",
    "freshness": "SELECT o_orderkey AS slug, CASE WHEN m IS NULL THEN 'missing' WHEN m < o_orderdate THEN 'stale' ELSE 'fresh' END AS state FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS m FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey",
    "phase_map": f"WITH {LOG} SELECT seq, phase, progress FROM marked",
    "job_progress": f"WITH {LOG} SELECT job, seq, last_value(phase IGNORE NULLS) OVER w AS phase, coalesce(max(progress) OVER w, 0.0) AS progress, first_value(slug IGNORE NULLS) OVER w AS slug FROM marked WINDOW w AS (PARTITION BY job ORDER BY seq ROWS UNBOUNDED PRECEDING)",
    "job_fold": f"WITH {LOG} SELECT job, arg_max(phase, seq) FILTER (phase IS NOT NULL) AS phase, coalesce(max(progress), 0.0) AS progress, arg_min(slug, seq) FILTER (slug IS NOT NULL) AS slug, bool_or(contains(line, 'DONE: processed')) AS done FROM marked GROUP BY job",
    "job_log_tail": f"WITH {LOG}, n AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY seq DESC) AS n FROM log) SELECT job, string_agg(left(line, 500), chr(10) ORDER BY seq) AS tail FROM n WHERE n <= 40 GROUP BY job",
    "job_outcome": f"WITH {LOG} SELECT job, CASE WHEN job % 5 = 0 THEN 'stopped' WHEN job % 3 = 0 AND bool_or(contains(line, 'DONE: processed')) THEN 'done' ELSE 'failed' END AS status FROM log GROUP BY job",
    "job_snapshot": f"WITH {JOBS} SELECT seq, status, CASE WHEN started IS NOT NULL THEN coalesce(ended, 1000.0) - started END AS elapsed FROM jobs",
    "job_actions": f"WITH {JOBS} SELECT seq, CASE status WHEN 'running' THEN 'stop' WHEN 'queued' THEN 'cancel' WHEN 'done' THEN CASE WHEN coalesce(slug, '') <> '' THEN 'remove,open' ELSE 'remove' END ELSE 'remove' END AS actions FROM jobs",
    "job_transitions": f"WITH {JOBS} SELECT seq, CASE WHEN seq % 4 = 0 AND status = 'queued' THEN 'running' WHEN seq % 4 = 1 AND status = 'queued' THEN 'canceled' WHEN seq % 4 = 2 AND status = 'running' THEN 'stopped' WHEN seq % 4 = 3 AND status NOT IN ('queued', 'running') THEN 'removed' END AS status FROM jobs",
    "crash_recovery": f"WITH {JOBS} SELECT seq, CASE status WHEN 'running' THEN 'failed' ELSE status END AS status, CASE status WHEN 'running' THEN 'interrupted by server restart' END AS error FROM jobs",
    "fifo_next": f"WITH {JOBS} SELECT min(seq) FILTER (status = 'queued') AS seq, 'queued' AS status, count(*) FILTER (status IN ('queued', 'running')) AS active FROM jobs",
    "job_fold_stream": f"WITH {LOG} SELECT job::VARCHAR AS job, arg_max(phase, seq) FILTER (phase IS NOT NULL) AS phase, coalesce(max(progress), 0.0) AS progress, arg_min(slug, seq) FILTER (slug IS NOT NULL) AS slug, bool_or(contains(line, 'DONE: processed')) AS done, count(*) AS lines FROM marked GROUP BY job",
    "stem_classify": "WITH n AS (SELECT doc_id, lower(coalesce(text, '') || CASE doc_id % 4 WHEN 0 THEN '_(Instrumental)' WHEN 1 THEN '_Vocals' WHEN 2 THEN ' No Vocals' ELSE '' END) AS name FROM documents) SELECT doc_id, CASE WHEN contains(name, '(instrumental)') OR contains(name, '_instrumental') OR contains(name, 'no vocals') THEN 'instrumental' WHEN contains(name, '(vocals)') OR contains(name, '_vocals') THEN 'vocals' END AS stem FROM n",
    "cleanup_pick": "SELECT conv_id, arg_min(name, (miss, turn)) AS name FROM (SELECT conv_id, turn, role || CASE WHEN turn % 3 = 2 THEN ' (No Echo)' ELSE ' (Echo)' END AS name, CASE WHEN turn % 3 = 2 THEN 0 ELSE 1 END AS miss FROM conversations) GROUP BY conv_id",
    "title_search": "SELECT p_partkey, title FROM (SELECT p_partkey, CASE WHEN p_partkey % 9 != 0 THEN p_name END AS title, p_brand FROM part) WHERE contains(lower(coalesce(nullif(title, ''), p_brand)), '1')",
    "format_fields": """WITH e AS (SELECT *, value * 10 AS t, CASE WHEN event_id % 2 = 0 THEN value ELSE value / 1024 END AS d, value * 50 AS l FROM events),
f AS (SELECT *, floor(t)::BIGINT AS whole, floor(d + 0.5)::BIGINT AS ds, floor(l)::BIGINT AS ls FROM e)
SELECT event_id, (whole // 60)::VARCHAR || ':' || lpad((whole % 60)::VARCHAR, 2, '0') AS time,
  CASE WHEN d < 1 THEN printf('%.2f', round(d, 2)) || 's' WHEN ds >= 60 THEN (ds // 60)::VARCHAR || 'm ' || lpad((ds % 60)::VARCHAR, 2, '0') || 's' ELSE ds::VARCHAR || 's' END AS duration,
  CASE WHEN ls >= 3600 THEN (ls // 3600)::VARCHAR || ':' || lpad((ls % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((ls % 60)::VARCHAR, 2, '0') ELSE (ls // 60)::VARCHAR || ':' || lpad((ls % 60)::VARCHAR, 2, '0') END AS elapsed,
  greatest(10.0, least(200.0, value)) AS clamped, upper(left(event_type, 1)) || lower(substr(event_type, 2) || ' NO') AS capital,
  replace(replace(replace(replace(replace('<a&''b''>' || props, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped FROM f""",
    "path_fields": "SELECT page_id, page_id % 10 <> 0 AS safe, (['audio/mp4', 'audio/wav', 'application/octet-stream'])[page_id % 3 + 1] AS mime, 'a%20b~%2A%2F' || page_id AS encoded, '%C3%A9+%2F%zz' || CASE WHEN page_id % 2 = 0 THEN '' ELSE page_id::VARCHAR END AS malformed, 'é+/' || page_id AS decoded, CASE WHEN page_id % 4 = 0 THEN NULL ELSE 'a/' || page_id END AS normal FROM pages",
    "range_slice": """WITH p AS (SELECT page_id, html, length(html)::BIGINT AS size, page_id % 6 AS k FROM pages),
r AS (SELECT *, CASE k WHEN 0 THEN 206 WHEN 1 THEN 206 WHEN 2 THEN 206 WHEN 3 THEN 416 ELSE 200 END::INT AS status,
  CASE k WHEN 0 THEN 0 WHEN 1 THEN 90 WHEN 2 THEN size - 10 WHEN 3 THEN NULL ELSE 0 END::BIGINT AS first, CASE k WHEN 0 THEN 9 WHEN 3 THEN NULL ELSE size - 1 END::BIGINT AS last FROM p)
SELECT page_id, status, first, last, CASE WHEN status = 206 THEN substr(html, first + 1, last - first + 1) END AS part FROM r""",
    "upload_triage": f"WITH {FILES}, u AS (SELECT CASE WHEN size < 2 THEN name END AS filename, size FROM named) SELECT CASE WHEN coalesce(filename, '') = '' THEN 'ignored' WHEN NOT regexp_matches(lower(filename), '\\.(mp3|wav)$') THEN 'only .mp3/.wav accepted' WHEN size = 0 THEN 'empty file' ELSE 'accepted' END AS result, count(*) AS n FROM u GROUP BY 1",
    "first_source": "SELECT o_custkey, CASE WHEN k % 4 <> 0 THEN d END AS live_duration_s FROM (SELECT o_custkey, min(o_orderkey) AS k, arg_min(o_totalprice, o_orderkey) AS d FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey)",
    "title_duration": """WITH o AS (SELECT o_custkey AS slug, o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS title, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS d FROM orders),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY k) AS r FROM o) WHERE r = 1), s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY k) AS r FROM o WHERE title = '') WHERE r = 1)
SELECT c_custkey AS slug, coalesce(nullif(f.title, ''), c_custkey::VARCHAR) AS title, coalesce(f.d, s.d) AS duration_s FROM customer LEFT JOIN f ON f.slug = c_custkey LEFT JOIN s ON s.slug = c_custkey""",
    "limited_inputs": f"WITH {FILES} SELECT path, name, size FROM (SELECT *, row_number() OVER (PARTITION BY name, size ORDER BY top, path) AS r FROM named WHERE name NOT LIKE '.%' AND regexp_matches(lower(name), '\\.(mp3|wav)$') AND (top OR NOT contains(path, '/models/'))) WHERE r = 1 ORDER BY path LIMIT 7",
    "newest_jobs": f"WITH {JOBS} SELECT seq, status FROM jobs ORDER BY seq DESC LIMIT 5",
    "job_by_id": f"WITH {JOBS} SELECT 'j' || seq AS id, status, slug FROM jobs WHERE seq = 77",
    "job_states_fold": _states("job, status, refused::INT AS refused"),
    "job_states_stream": _states("job, status, refused::INT AS refused"),
    "first_ready": f"WITH {CARDS} SELECT slug, arg_min(id, (grp, rank, id)) AS id FROM cards WHERE audio_ready GROUP BY slug",
    "slot_with_fallback": f"WITH {CARDS}, n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY grp, rank, id) - 1 AS seat FROM cards) SELECT slug, coalesce(arg_min(id, seat) FILTER (grp = 1 AND contains(id, 'roformer') AND length(slug) % 2 = 0), max(id) FILTER (seat = 2), '') AS id FROM n GROUP BY slug",
    "longest_chosen": f"WITH {CARDS} SELECT slug, coalesce(max(duration_s) FILTER (doc_id % 5 < 2), 0.0) AS duration_s FROM cards GROUP BY slug",
    "card_upgrade": f"WITH {CARDS} SELECT slug, id, CASE doc_id % 3 WHEN 1 THEN audio_ready ELSE true END AS audio_ready, CASE WHEN doc_id % 3 = 1 OR (doc_id % 3 = 2 AND audio_ready) THEN duration_s ELSE duration_s + 1 END AS duration_s, doc_id FROM cards",
    "metrics_fields": """WITH e AS (SELECT *, floor(value + 0.5)::BIGINT AS ds, event_id / 8 AS peak FROM events)
SELECT event_id, concat_ws('|', 'dur ' || CASE WHEN value < 1 THEN printf('%.2f', round(value, 2)) || 's' WHEN ds >= 60 THEN (ds // 60)::VARCHAR || 'm ' || lpad((ds % 60)::VARCHAR, 2, '0') || 's' ELSE ds::VARCHAR || 's' END,
  CASE WHEN event_id % 2 = 0 THEN 'peak ' || printf('%.3f', peak) END, CASE WHEN event_id % 3 = 0 THEN 'rms 0.500' END, CASE event_id % 3 WHEN 0 THEN 'sr 44.1k' WHEN 1 THEN 'sr 48k' END, CASE WHEN event_id % 3 > 0 THEN 'ch ' || event_id % 3 END) AS metrics FROM e""",
    "clock_fields": """SELECT event_id, strftime(make_timestamp(event_id * 1000000000), '%Y-%m-%d %H:%M:%S') AS clock,
  CASE WHEN event_id < 500 AND round_even((event_id - 500) / 4.0, 1) <> 0 THEN '' ELSE '+' END || printf('%.1f', round_even((event_id - 500) / 4.0, 1)) AS gain,
  CASE WHEN event_id % 2 = 0 THEN 'b' ELSE 'a' END AS op, 2 AS flags, event_id / 1600.0::DOUBLE * value AS at FROM events""",
    "upload_result": f"""WITH {FILES}, u AS (SELECT length(path) % 5 AS request, CASE WHEN size < 2 THEN name END AS filename, size, length(path) % 3 = 0 AS failure FROM named),
t AS (SELECT *, CASE WHEN coalesce(filename, '') = '' THEN 0 WHEN NOT regexp_matches(lower(filename), '[^.].*\\.(mp3|wav)$') OR size = 0 OR failure THEN 1 ELSE 2 END AS r FROM u)
SELECT request::INT AS request, bool_or(r = 2) AS ok, coalesce(string_agg(filename, '|' ORDER BY filename) FILTER (r = 2), '') AS accepted, coalesce(string_agg(filename, '|' ORDER BY filename) FILTER (r = 1), '') AS rejected FROM t GROUP BY request""",
    "rejected_union": f"""WITH {FILES}, u AS (SELECT name AS filename, CASE WHEN NOT regexp_matches(lower(name), '[^.].*\\.(mp3|wav)$') THEN 'only .mp3/.wav accepted' WHEN size = 0 THEN 'empty file' END AS reason, 'server' AS side FROM named
  UNION ALL SELECT name, 'extension', 'client' FROM named WHERE NOT regexp_matches(lower(path), '\\.(mp3|wav)$')) SELECT filename, reason, side, count(*) AS n FROM u WHERE reason IS NOT NULL GROUP BY ALL""",
    "stream_plan": f"""WITH {VARIANTS}, o AS (SELECT v.slug, v.id, v.doc_id, v.stream AS before, 'out/' || v.doc_id || CASE WHEN v.doc_id % 5 = 0 THEN '.mp3' ELSE '.wav' END AS output, toxic FROM variants v JOIN labels USING (doc_id))
SELECT slug, id, replace(output, '.wav', '.m4a') AS stream, doc_id % 5 <> 0 AND (toxic <> 0 OR doc_id % 7 < doc_id % 11) AS encode, before IS DISTINCT FROM replace(output, '.wav', '.m4a') AS changed FROM o""",
    "one_shot": "SELECT o_custkey, n, CASE WHEN n >= 2 THEN 'ensemble' WHEN n = 1 THEN 'copy' ELSE 'nothing' END AS action FROM (SELECT o_custkey, count(*) FILTER (o_orderpriority = '1-URGENT') AS n FROM orders GROUP BY o_custkey)",
    "manifest_files": "SELECT p_brand AS slug, 'v' || p_partkey % 50 AS id, arg_max(p_type, p_partkey) AS kind, arg_max(p_retailprice, p_partkey) AS duration_s, 'original' AS inputs FROM part GROUP BY 1, 2",
    "index_files": "SELECT c_name AS slug, c_mktsegment AS title, NULL::VARCHAR AS original, c_acctbal AS duration_s, 1::BIGINT AS n_variants, c_mktsegment AS variants FROM customer",
    "peaks_files": """WITH s AS (SELECT l_suppkey % 8 AS user_id, row_number() OVER (PARTITION BY l_suppkey % 8 ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_shipdate) - 1 AS i, l_extendedprice AS v FROM lineitem),
l AS (SELECT user_id, greatest(1, count(*) // 100) AS step FROM s GROUP BY user_id) SELECT user_id, (i // step)::INT AS bucket, min(v) AS lo, max(v) AS hi FROM s JOIN l USING (user_id) GROUP BY user_id, i // step""",
    "wav_files": f"WITH {SIGNAL} SELECT user_id, unnest([0, 1])::INT AS ch, i, round_even(v / 1000 * 8388608, 0) / 8388608 AS v FROM sig",
    "jobs_files": f"WITH {JOBS} SELECT seq::VARCHAR AS id, CASE status WHEN 'running' THEN 'failed' ELSE status END AS status, slug, started AS started_at, CASE status WHEN 'running' THEN 'interrupted by server restart' END AS error, 'a' || coalesce('|' || slug, '') AS log_tail FROM jobs",
    "stft_bins": f"WITH {SIGNAL}, {_frames('sig', 'user_id', 'SELECT user_id, count(*) AS n FROM sig GROUP BY user_id')} SELECT user_id, frame, bin, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM spectra",
    "stft_roundtrip": f"WITH {SIGNAL} SELECT user_id, i, round(v, 6) AS v FROM sig",
    "spectral_ensemble": f"""WITH {KINDS.replace('FROM events', "FROM events WHERE event_type IN ('click', 'view')")}, n AS (SELECT user_id, min(c) AS n FROM (SELECT user_id, event_type, count(*) AS c FROM sig GROUP BY ALL) GROUP BY user_id),
{_frames('sig', 'user_id, event_type', 'SELECT DISTINCT user_id, event_type, n FROM sig JOIN n USING (user_id)')},
best AS (SELECT user_id, frame, bin, re, im FROM (SELECT *, row_number() OVER (PARTITION BY user_id, frame, bin ORDER BY sqrt(re * re + im * im) DESC, event_type) AS r FROM spectra) WHERE r = 1),
back AS (SELECT user_id, frame, p, sum(CASE WHEN bin IN (0, 32) THEN re * cos(pi() * bin * p / 32) ELSE 2 * (re * cos(pi() * bin * p / 32) - im * sin(pi() * bin * p / 32)) END) / 64 AS y FROM best, (SELECT unnest(range(64)) AS p) GROUP BY ALL),
laid AS (SELECT user_id, frame * 16 + p - 32 AS i, y * (0.5 - 0.5 * cos(pi() * p / 32)) AS a, pow(0.5 - 0.5 * cos(pi() * p / 32), 2) AS b FROM back)
SELECT l.user_id, i, round(CASE WHEN sum(b) > 1e-10 THEN sum(a) / sum(b) ELSE sum(a) END, 6) + 0.0 AS v FROM laid l JOIN n ON n.user_id = l.user_id WHERE i >= 0 AND i < n.n GROUP BY l.user_id, i""",
    "manifest_merge": """WITH again AS (SELECT DISTINCT p_brand FROM part WHERE p_brand LIKE '%1' AND p_partkey % 2 = 0)
SELECT p_brand AS slug, p_partkey AS position, 'v' || p_partkey AS id, CASE WHEN p_brand IN (FROM again) THEN 'again' ELSE p_type END AS kind, p_retailprice AS duration_s, 'original' AS inputs
FROM part WHERE p_brand NOT IN (FROM again) OR p_partkey % 2 = 0""",
    "wav_source": f"WITH {SIGNAL} SELECT user_id, unnest([0, 1])::INT AS ch, i, round_even(v / 1000 * 8388608, 0) / 8388608 AS v FROM sig",
    "chunk_level": f"""WITH {KINDS} SELECT user_id, max(abs(v)) AS peak, round(sqrt(sum(v * v) / count(*)), 12) AS rms, round(20 * log10(sqrt(sum(v * v) / count(*)) + 1e-9), 9) AS loudness, 44100 AS sr,
  count(DISTINCT event_type)::BIGINT AS channels, (max(i) + 1) / 44100.0::DOUBLE AS duration_s FROM sig GROUP BY user_id""",
    "chunk_normalize": f"WITH {KINDS}, g AS (SELECT user_id, 0.5623413251903491 / max(abs(v)) AS gain FROM sig GROUP BY user_id) SELECT user_id, event_type, i, v * gain AS v FROM sig JOIN g USING (user_id)",
    "chunk_residual": f"WITH {VECTORS} SELECT a.vec_id, a.i::BIGINT AS i, a.v::DOUBLE - b.v::DOUBLE AS v FROM vec a JOIN vec b ON b.vec_id = a.vec_id + 1 AND b.i = a.i",
    "chunk_envelope": f"""WITH {SIGNAL}, n AS (SELECT user_id, greatest(1, count(*) // 16) AS step FROM sig GROUP BY user_id)
SELECT user_id, i // step AS bucket, min(v) AS lo, max(v) AS hi FROM sig JOIN n USING (user_id) GROUP BY user_id, i // step""",
} | {
    f"chunk_ensemble_{algo}": f"""WITH {KINDS}, n AS (SELECT user_id, min(n) AS n FROM (SELECT user_id, event_type, count(*) AS n FROM sig GROUP BY ALL) GROUP BY user_id)
SELECT user_id, i, round({value}, 9) AS v FROM sig JOIN n USING (user_id) WHERE i < n GROUP BY user_id, i"""
    for algo, value in (("avg", "avg(v)"), ("max", "first(v ORDER BY abs(v) DESC, event_type)"), ("min", "first(v ORDER BY abs(v), event_type)"))
}
ORACLES["card_merge"] = ORACLES["card_upgrade"]
ORACLES |= {
    # printf rounds a double's exact value
    "rounded_fields": "SELECT event_id, " + ", ".join(f"CAST(printf('%.{k}f', value / 8) AS DOUBLE) AS r{k}" for k in range(6)) + " FROM events",
    "rounded_levels": f"""WITH {SIGNAL}, l AS (SELECT user_id, max(abs(v)) AS peak, sqrt(sum(v * v) / count(*)) AS rms, count(*) / 44100.0::DOUBLE AS duration_s FROM sig GROUP BY user_id)
SELECT user_id, CAST(printf('%.4f', peak) AS DOUBLE) AS peak, CAST(printf('%.5f', rms) AS DOUBLE) AS rms, CAST(printf('%.1f', 20 * log10(rms + 1e-9)) AS DOUBLE) AS loudness, CAST(printf('%.2f', duration_s) AS DOUBLE) AS duration_s FROM l""",
    "stored_names": """WITH coming AS (SELECT p_partkey, 'take' || (p_partkey % 9) || CASE WHEN p_partkey % 7 = 0 THEN '_' || (p_partkey % 4) ELSE '' END AS base FROM part),
there AS (SELECT DISTINCT 'take' || (s_suppkey % 5) || CASE WHEN s_suppkey % 3 > 0 THEN '_' || (s_suppkey % 11) ELSE '' END AS base FROM supplier),
files AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS place FROM coming),
wanted AS (SELECT base, unnest(range(count(*) + (SELECT count(*) FROM there) + (SELECT count(DISTINCT base) FROM coming) + 2)) AS n FROM coming GROUP BY base),
named AS (SELECT base, n, base || CASE WHEN n = 0 THEN '' ELSE '_' || n END AS stored FROM wanted),
free AS (SELECT base, stored, row_number() OVER (PARTITION BY base ORDER BY n) AS place FROM named
  WHERE stored NOT IN (SELECT base FROM there) AND (n = 0 OR stored NOT IN (SELECT base FROM coming)))
SELECT p_partkey, base || '.wav' AS name, stored || '.wav' AS stored FROM files JOIN free USING (base, place)""",
    "log_spectrogram": f"""WITH {SIGNAL}, {_frames('sig', 'user_id', 'SELECT user_id, count(*) AS n FROM sig GROUP BY user_id')},
sizes AS (SELECT user_id, frame, bin, sqrt(re * re + im * im) AS m FROM spectra),
most AS (SELECT user_id, greatest(max(m), 1e-5) AS most FROM sizes GROUP BY user_id),
shown AS (SELECT y::INT AS y, least(32, floor(20.0::DOUBLE * pow(22050.0::DOUBLE / 20, y / 11.0::DOUBLE) * 64 / 44100 + 0.5)) AS bin FROM (SELECT unnest(range(12)) AS y))
SELECT user_id, frame, y, round(greatest(20 * log10(greatest(m, 1e-5) / most), -80.0), 5) + 0.0 AS db FROM sizes JOIN most USING (user_id) JOIN shown USING (bin)""",
    "both_listings": f"""WITH {FILES}, every AS (SELECT '/srv/output/' || path AS path, name, size, 0 AS top, contains(path, '/models/') AS pruned FROM named
  UNION ALL SELECT '/srv/output/' || name, name, size, 1, false FROM named)
SELECT path, name, size FROM (SELECT *, row_number() OVER (PARTITION BY name, size ORDER BY top, path) AS r FROM every WHERE name NOT LIKE '.%' AND regexp_matches(lower(name), '\\.(mp3|wav)$') AND NOT pruned) WHERE r = 1""",
    "present_models": """WITH m AS (SELECT p_partkey, (p_partkey % 500) || CASE WHEN p_partkey % 2 = 0 THEN '.onnx' ELSE '.ckpt' END AS file FROM part)
SELECT * FROM m WHERE file IN (SELECT (s_suppkey % 70) || CASE WHEN s_suppkey % 3 = 0 THEN '.ckpt' ELSE '.onnx' END FROM supplier)""",
}
ORACLES["log_stream"] = ORACLES["job_fold_stream"]
ORACLES["envelope_pyramid"] = ORACLES["envelope_rebucket"]
