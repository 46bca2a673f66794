"""The pipeline stage by stage, each held against its own input."""

import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from waveframe.llm import minhash, mixing, pieces, pii

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns

    clean = stages["toxicity"](spark, docs, SF)
    kept = {r["doc_id"]: r for r in clean.collect()}
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert clean.columns == columns
    gone = [d for d in toxic if d not in kept]
    assert sum(toxic[d] for d in gone) >= 0.8 * len(gone)
    assert len(kept) >= 0.85 * docs.count()

    single = stages["minhash"](spark, clean, SF)
    left = {r["doc_id"] for r in single.collect()}
    assert single.columns == columns
    assert left == {r["class_id"] for r in minhash.classes(clean).collect()}

    masked = stages["pii"](spark, single, SF)
    assert masked.columns == columns and masked.dtypes == docs.dtypes
    rows = masked.collect()
    assert {r["doc_id"] for r in rows} == left
    assert not any(re.search(pii.KINDS["email"], r["text"]) for r in rows)
    assert masked.agg(F.sum(F.size(pii.base_spans(F.col("text"))))).first()[0] == 0
    assert all(r["n_chars"] == len(r["text"]) for r in rows)

    mixed = stages["mixing"](spark, masked, SF)
    taken = mixed.collect()
    assert mixed.columns == columns
    assert set(map(tuple, taken)) <= set(map(tuple, rows))
    plan = mixing.mix_plan(masked).collect()
    assert Counter(r["doc_id"] for r in taken) == {r["doc_id"]: r["copies"] for r in plan if r["copies"]}
    by_source = Counter()
    for r in plan:
        by_source[r["source"], r["target"]] += r["taken"]
    assert all(abs(n - target) <= 3 * max(r["size"] for r in plan if r["source"] == source) for (source, target), n in by_source.items())

    encoded = stages["sentencepiece"](spark, mixed, SF).collect()
    assert len(encoded) == len(taken)
    model = pieces.load(pieces.model_path())
    texts = {r["doc_id"]: r["text"] for r in taken}
    assert all(r["ids"] == model.encode(texts[r["doc_id"]], add_eos=True) and r["n_tokens"] == len(r["ids"]) and r["round_trip"] for r in encoded)


def test_edges(spark, tmp_path):
    rows = [(None, None, None, None, None, 1), (1, "", "en", "a", 0, 2), (1, "", "en", "a", 0, 2), (2, "call a@b.co now please ok", "en", None, 25, 3), (3, "long words of a text " * 40_000, "en", "a", 840_000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= {None, 1, 2, 3}
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
