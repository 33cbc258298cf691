"""The stages one after another, each on what the one before kept."""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import brute

import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    kept = {"documents": {r["doc_id"]: r["text"] for r in docs.collect()}}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == names
            kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert 0 < len(kept["toxicity"]) < len(kept["documents"])
    groups = brute.near(list(kept["toxicity"].items()), 5)
    assert set(kept["near_dedup"]) == {d for d, (_, _, own) in groups.items() if own}
    cut = brute.substrings(list(kept["near_dedup"].items()))
    assert set(kept["substring_dedup"]) == {d for d, (n, gone, _) in cut.items() if not gone or gone < n}
    assert set(kept["mixing"]) <= set(kept["substring_dedup"])
    assert docs.where("piece = 0").count() == spark.read.parquet(str(tmp_path / "mixing")).count()


def test_run(spark):
    assert pipeline.run(spark, SF).count() > 0
