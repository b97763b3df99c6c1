"""Settings of the operators: frozen, validated, with the documented defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class WindowConfig:
    """Overlapping token windows; ``slice_tokens``: tokens that are embedded together."""

    max_tokens: int = 4096
    overlap_tokens: int = 128
    slice_tokens: int = 4000

    def __post_init__(self):
        if not 0 <= self.overlap_tokens < self.max_tokens:
            raise ValueError("overlap_tokens must be at least 0 and below max_tokens")
        if not 1 <= self.slice_tokens <= 8192:
            raise ValueError("slice_tokens must be from 1 to 8192")


@dataclass(frozen=True)
class SemanticConfig:
    """Sentence merging, context groups, neighbour distances and semantic chunks."""

    sentence_max: int = 500
    sentence_min: int = 15
    group_limit: int = 8000
    group_overlap: int = 150
    num_neighbors: int = 3
    current_chunk_size: int = 1
    hard_ratio: float = 5.0
    min_ratio: float = 2.5
    soft_min_tokens: int = 50
    max_tokens: int = 1000
    metric: str = "cosine"
    pooling: str = "mean"
    repeat_boundary: bool = True

    def __post_init__(self):
        if not 1 <= self.sentence_min <= self.sentence_max:
            raise ValueError("sentence_min must be from 1 to sentence_max")
        if self.group_limit < self.sentence_max or self.group_overlap < 0:
            raise ValueError("group_limit must hold the longest sentence, and group_overlap be at least 0")


@dataclass(frozen=True)
class SplitConfig:
    """Scores of elements and sizes of structural chunks, in tokens."""

    min_tokens: int = 30
    expected_tokens: int = 400
    max_tokens: int = 800
    title_token_threshold: int = 100
    multiplier: int = 2
    max_passes: int = 100

    def __post_init__(self):
        if not self.min_tokens < self.expected_tokens < self.max_tokens:
            raise ValueError("min_tokens < expected_tokens < max_tokens is required")
