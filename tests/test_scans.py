"""Queries over the hits of a set of questions leave the documents where they lie."""

from __future__ import annotations

import os
import shutil

import pytest

import __spark_entry__ as entry
from harrier.sources.shared import few, shared_folder

DATA = "/root/testdata/sf0.01"


@pytest.fixture
def own(tmp_path):
    """Tables of their own, of which no query has kept anything yet."""
    for name in ("documents", "benchmark", "embeddings", "labels"):
        shutil.copy(f"{DATA}/{name}.parquet", tmp_path)
    return str(tmp_path)


def parquet_bytes(top):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(top) for f in names if f.endswith(".parquet"))


def test_few_rows_are_broadcast(spark):
    told = lambda rows: "ResolvedHint" in rows._jdf.queryExecution().analyzed().toString() or "broadcast" in rows._jdf.queryExecution().analyzed().toString()
    assert told(few(spark.range(3))) and not told(few(spark.range(3), 2))


@pytest.mark.parametrize("name, rows", [("confidence_class", 40), ("rank_shift", 1_200), ("report_series", 17), ("evidence_quality", 40), ("retrieval_comparison", 2)])
def test_hits_meet_documents_where_these_lie(spark, own, name, rows):
    """No index of postings is written, and no join sorts or shuffles the documents."""
    folder = shared_folder(spark).removeprefix("file://")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = parquet_bytes(folder)
        made = entry.queries()[name](spark, own)
        assert made.count() == rows
        assert parquet_bytes(folder) - before < 0.6 * os.path.getsize(f"{own}/documents.parquet")
        assert "SortMergeJoin" not in made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
