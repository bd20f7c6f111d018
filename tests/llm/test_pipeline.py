"""The pipeline against its stages done one after another in plain Python."""

from __future__ import annotations

import brute
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    now = docs
    for name, stage in pipeline.STAGES:
        before = {r.doc_id: r.text for r in now.collect()}
        out = stage(spark, now, SF)
        if name == "mixing":
            want = {r.doc_id: r.taken for r in pipeline.run(spark, SF).collect()}
            got = {r.doc_id: r.taken for r in out.collect()}
            assert got == want and set(got) == set(before)
            break
        assert out.columns == docs.columns
        after = {r.doc_id: r.text for r in out.collect()}
        if name == "quality_rules":
            assert all(brute.op3_base(t)[0] >= 10 for t in after.values()) and len(after) >= 0.7 * len(before)
        if name == "line_dedup":
            want = brute.op1(list(before.items()))
            assert {d: brute.sha(t) for d, t in after.items()} == {d: v[2] for d, v in want.items()}
        if name == "near_duplicates":
            assert set(after) == brute.one_of_each(list(before.items()))
        if name == "decontamination":
            assert set(after) == {d for d, v in brute.op9(list(before.items()), items).items() if not v[4]}
        now = out.withColumn("n_chars", F.col("n_chars"))
