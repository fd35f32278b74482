"""Settings of retrieval, chunking and context assembly, validated as a set."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

# Bounds of the numeric settings.
BOUNDS = {
    "chunk_target": (100, 8000), "chunk_overlap": (0, 4000), "chunk_max": (100, 16000), "semantic_min_chars": (2000, 100000),
    "semantic_percentile": (50, 99), "candidates": (4, 120), "rrf_k": (1, 200), "fused_window": (2, 20), "wiki_window": (0, 12),
    "supplement_queries": (0, 4), "source_priority": (1, 12), "vector_source_priority": (1, 12), "vector_min_score": (0, 1),
    "vector_score_gap": (0, 1), "pool_multiplier": (1, 16), "pool_min": (1, 2048), "max_passages": (1, 24), "total_chars": (1000, 64000),
    "passage_chars": (128, 16000), "neighbor_count": (0, 2), "wiki_chars": (0, 10000), "wiki_sections": (0, 12), "graph_chars": (0, 12000),
    "rerank_snippet": (16, 2000), "embedding_input_chars": (128, 32000),
}


@dataclass(frozen=True)
class Config:
    chunk_strategy: str = "structure"
    chunk_target: int = 800
    chunk_overlap: int = 120
    chunk_max: int = 1200
    semantic_min_chars: int = 4000
    semantic_percentile: int = 85
    embedding_input_chars: int = 6000
    contextual_embed: bool = True
    candidates: int = 24
    rrf_k: int = 60
    fused_window: int = 20
    wiki_window: int = 4
    supplement_queries: int = 2
    source_priority: int = 2
    vector_source_priority: int = 1
    vector_min_score: float = 0.45
    vector_score_gap: float = 0.08
    pool_multiplier: int = 4
    pool_min: int = 64
    max_passages: int = 8
    total_chars: int = 7000
    passage_chars: int = 1200
    neighbor_count: int = 2
    wiki_chars: int = 1000
    wiki_sections: int = 2
    graph_chars: int = 2500
    rerank_snippet: int = 120

    def __post_init__(self):
        for name, (low, high) in BOUNDS.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be from {low} to {high}")
        if self.chunk_strategy not in ("structure", "semantic_long"):
            raise ValueError("chunk_strategy must be structure or semantic_long")
        rules = [
            (self.chunk_overlap < self.chunk_target, "chunk_overlap must be below chunk_target"),
            (self.chunk_max >= self.chunk_target, "chunk_max must not be below chunk_target"),
            (self.fused_window <= self.candidates, "fused_window must not exceed candidates"),
            (self.wiki_window < self.fused_window, "wiki_window must be below fused_window"),
            (self.max_passages <= self.candidates, "max_passages must not exceed candidates"),
            (self.passage_chars <= self.total_chars, "passage_chars must not exceed total_chars"),
            (self.wiki_chars + self.graph_chars <= self.total_chars - 256, "wiki_chars and graph_chars must leave 256 of total_chars"),
        ]
        for holds, message in rules:
            if not holds:
                raise ValueError(message)

    def but(self, **changes) -> Config:
        """A copy with changes, validated again."""
        unknown = set(changes) - {f.name for f in fields(self)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return replace(self, **changes)
