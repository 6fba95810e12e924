"""Limits and weights shared by the operators (fixed values of the retrieval design)."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    chunk_tokens: int = 600
    chunk_overlap: int = 100
    chars_per_token: float = 3.4
    candidates: int = 30
    rrf_k: int = 60
    tool_budget: int = 1000
    frame_tokens: int = 60
    page_chars: int = 8000
    table_rows: int = 40
    low_conf: float = 0.60
    native_chars: int = 120
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25


LIMITS = Limits()
