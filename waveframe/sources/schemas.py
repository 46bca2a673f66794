"""Schemas of the catalogue's tables."""

VARIANT = (
    "id string, kind string, stem string, description string, models array<string>, flags map<string,string>, input string, "
    "output string, stream string, spectrogram string, peaks string, status string, duration_s double, sr int, channels int, "
    "peak double, rms double, lufs_approx double, normalized_dbfs double"
)
FILE = "slug string, title string, original string, duration_s double, n_variants long, variants array<string>"
INDEX = f"generated long, count long, files array<struct<{', '.join(c.replace(' ', ': ', 1) for c in FILE.split(', '))}>>"
PEAKS = "min array<double>, max array<double>"
JOB = (
    "id string, filename string, path string, status string, phase string, progress double, slug string, created_at double, "
    "started_at double, ended_at double, exit_code int, error string, log_tail array<string>"
)
LOG = "job string, seq long, ts timestamp, line string"
