"""Options of the operators, and the places where a model can be plugged in."""
from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field, fields

from pyspark.sql import Column


@dataclass(frozen=True)
class Settings:
    """Defaults; ``from_environment`` takes JURILOOM_<NAME> where it is set and fits the type."""

    rrf_k: int = 60
    hybrid_alpha: float = 0.55
    dense_top_k: int = 50
    bm25_top_k: int = 50
    fusion_top_k: int = 30
    final_top_k: int = 5
    summary_top_k: int = 12
    direct_top_k: int = 8
    judge_top_k: int = 4
    evidence_top_k: int = 4
    max_hops: int = 3
    use_reranker: bool = False
    retry_rounds: int = 1
    retry_step: int = 4

    @classmethod
    def from_environment(cls, env: dict[str, str] | None = None) -> Settings:
        env, found = os.environ if env is None else env, {}
        for f in fields(cls):
            raw = env.get(f"JURILOOM_{f.name.upper()}", "").strip()
            try:
                if raw:
                    found[f.name] = raw.lower() in ("1", "true", "yes") if f.type == "bool" else {"int": int, "float": float}[f.type](raw)
            except ValueError:
                continue
        return cls(**found)


@dataclass(frozen=True)
class Providers:
    """Functions from columns to columns, as Arrow UDFs are; None leaves the deterministic rule in place, without a network."""

    embed: Callable[[Column], Column] | None = None
    rerank: Callable[[Column, Column], Column] | None = None
    segment: Callable[[Column], Column] | None = None
    answer: Callable[[Column, Column], Column] | None = None
    judge: Callable[[Column, Column], Column] | None = None
    extra: dict[str, Callable] = field(default_factory=dict)
