"""Defaults of the retrieval, evidence and evaluation operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Defaults:
    # Results depend on them.
    chunk_size: int = 700
    chunk_overlap: int = 120
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    idf_floor: float = 0.25
    overlap_scale: float = 1e-6
    rrf_k: int = 60
    dense_depth: int = 10
    bm25_depth: int = 10
    fused_depth: int = 10
    rerank_pool: int = 30
    max_variants: int = 4
    neighbor_window: int = 1
    context_chars: int = 3000
    context_tokens: int = 4096
    overlap_limit: int = 250
    min_selected: int = 3
    max_selected: int = 8
    score_threshold: float = -4.0
    per_source: int = 2
    redundancy: float = 0.85
    token_budget: int = 2400
    target_min: int = 800
    target_max: int = 1500
    strong: float = 0.65
    medium: float = 0.35


DEFAULTS = Defaults()
