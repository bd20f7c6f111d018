"""The driver contract: queries run, and give the rows of their SQL."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ("hybrid_topk", "bm25_scoped", "rrf_provenance", "query_variants", "context_fit_chars", "greedy_pack", "overlap_concat", "evidence_quality", "acl_visible", "folder_closure", "manifest_diff", "move_detect", "eval_rank", "eval_by_group", "search_page", "percentile_nearest_rank", "debounce_sessions", "sliding", "event_metrics_stream", "chunk_payload_contract", "gap_audit", "reference_markers")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def plain(rows, columns):
    order = [columns.index(c) for c in sorted(columns)]
    value = lambda v: v.replace(tzinfo=None) if hasattr(v, "tzinfo") else "nan" if isinstance(v, float) and math.isnan(v) else v
    return sorted(([value(r[i]) for i in order] for r in rows), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, SF), duck.sql(entry.oracle_sql()[name])
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), want.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys() and len(entry.queries()) > 150


def test_entry_without_the_optional_parts(tmp_path):
    """The library imports and lists its queries where the llm folders and the pipeline are not there."""
    import shutil
    import subprocess
    import sys

    home = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(f"{home}/harrier", tmp_path / "harrier", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{home}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') and n[2].isdigit() for n in q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 140 and out[1] == "False"


def test_variants_of_texts_that_hold_glossary_terms(spark, tmp_path):
    """Related terms come from the question's own words, also where the text it quotes holds a term or a related one."""
    texts = ["ciónqueue del", "the hoppe PPE and Hazard", "runway", "plain", "  "]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    con.sql(f"create view benchmark as select * from '{tmp_path}/benchmark.parquet/*.parquet'")
    got, want = entry.queries()["query_variants"](spark, str(tmp_path)), con.sql(entry.oracle_sql()["query_variants"])
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), want.columns)
