"""Every core query against its SQL, and plans of native queries without Python."""

import duckdb
import pytest

from waveframe.plans.oracles import ORACLES
from waveframe.plans.queries import QUERIES

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "labels", "conversations"]
WITH_PYTHON = {"stft_bins", "stft_roundtrip", "spectral_ensemble", "job_fold_stream", "job_states_stream", "wav_files", "wav_source"}
WITH_PYTHON |= {name for name in QUERIES if name.startswith("chunk_")} | {"rounded_levels", "log_spectrogram", "log_stream"}


@pytest.fixture(scope="module")
def duck(sf_small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, sf_small, name):
    df = QUERIES[name](spark, sf_small)
    found = duck.execute(ORACLES[name])
    columns = [x[0] for x in found.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted(repr(r) for r in found.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == want
    assert want or name in {"slug_collisions"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WITH_PYTHON))
def test_native(spark, sf_small, name):
    plan = QUERIES[name](spark, sf_small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
