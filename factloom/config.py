"""Engine settings."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ScoringWeights:
    """Weights of the hybrid score's signals."""

    # Fixed values of the scoring contract.
    vector: float = 1.0
    text: float = 0.5
    structure: float = 0.8
    recency: float = 0.3
    validity: float = 1.0


@dataclass(frozen=True)
class EngineConfig:
    """``data_dir`` holds the operation log; ``vector_dim`` is the length expected of embeddings."""

    data_dir: str = "./factloom-data"
    vector_dim: int = 1536
    scoring: ScoringWeights = field(default_factory=ScoringWeights)
