"""Settings of the engine, from the environment where it has them."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class EngineConfig:
    chunk_tokens: int = 450
    chunk_overlap: int = 75
    embedding_batch: int = 64
    embedding_model: str = "unnamed"
    max_upload_mb: int = 25
    distance_threshold: float | None = None
    hybrid: bool = True
    rrf_k: int = 10
    rerank: bool = False
    candidate_depth: int = 50
    temperature: float = 0.1
    k1: float = 0.9
    b: float = 0.4

    @classmethod
    def from_env(cls, prefix: str = "QUERN_") -> EngineConfig:
        """Each field from ``<prefix><FIELD>``; an empty value is None where None is allowed."""
        found = {}
        for f in fields(cls):
            raw = os.environ.get(prefix + f.name.upper())
            if raw is None:
                continue
            kind = str(f.type).split(" |")[0]
            if raw == "" and "None" in str(f.type):
                found[f.name] = None
            elif kind == "bool":
                found[f.name] = raw.strip().lower() in ("1", "true", "yes", "on")
            else:
                found[f.name] = {"int": int, "float": float, "str": str}[kind](raw)
        return cls(**found)


def check_request(question: str, top_k: int, most: int = 20) -> None:
    """Bounds of a search request: 1 to 2000 characters, 1 to ``most`` results."""
    if not 1 <= len(question) <= 2000:
        raise ValueError("a question has 1 to 2000 characters")
    if not 1 <= top_k <= most:
        raise ValueError(f"top_k is 1 to {most}")
