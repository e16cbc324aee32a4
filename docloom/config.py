"""Settings with the defaults of the method, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SkeletonConfig:
    """How blocks are shortened, folded and cut into windows."""

    head_chars: int = 40
    tail_chars: int = 30
    fold: bool = True
    fold_least: int = 3
    fold_most: int = 10
    window_threshold: int = 500
    window_size: int = 300
    window_overlap: int = 50
    snippet_least: int = 35
    snippet_extra: int = 25

    def __post_init__(self) -> None:
        if self.window_overlap >= self.window_size:
            raise ValueError("window_overlap must be strictly less than window_size")
        if min(self.fold_most, self.window_size) < 1:
            raise ValueError("fold_most and window_size must be positive")


@dataclass(frozen=True)
class ResolverConfig:
    """How anchors are corrected, levelled and completed."""

    radius: int = 5
    least_similarity: float = 0.4
    short_snippet: int = 5
    match_similarity: float = 0.7
    font_tolerance: float = 0.5
    duplicate_ids: int = 3
    duplicate_similarity: float = 0.8
    orphan_chars: int = 40


@dataclass(frozen=True)
class RoutingConfig:
    """How the windows of a document are routed."""

    speculative: bool = False
    boundary_tolerance: int = 1
    at_once: int = 8  # windows of a document asked at the same time


@dataclass(frozen=True)
class LimiterConfig:
    """Requests a key may make in a window of seconds."""

    most: int = 10
    seconds: int = 3600
