"""Settings of each stage; nothing is shared between stages, so one stage's keys cannot overwrite another's."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ChunkSettings:
    size: int = 512
    overlap: int = 50
    section_min: int = 50
    section_overlap: int = 30
    sentence_size: int = 256

    def __post_init__(self):
        check_window(self.size, self.overlap)


@dataclass(frozen=True)
class EmbedSettings:
    provider: str = "hashed_tfidf"
    model: str | None = None
    dimensions: int = 512
    batch_size: int = 100
    cache_ttl_seconds: int = 3600


@dataclass(frozen=True)
class RetrievalSettings:
    top_k: int = 10
    overfetch: int = 3
    final_k: int = 5
    threshold: float = 0.45
    min_docs_before_expansion: int = 3
    expansion_enabled: bool = True
    expansion_terms: int = 20
    rerank: bool = True
    dense: bool = True
    filter_keys: tuple[str, ...] = ("service", "environment")
    filter_mode: str = "pre"
    missing_passes: bool = False


@dataclass(frozen=True)
class Settings:
    chunks: ChunkSettings = field(default_factory=ChunkSettings)
    embed: EmbedSettings = field(default_factory=EmbedSettings)
    retrieval: RetrievalSettings = field(default_factory=RetrievalSettings)


def check_window(size: int, overlap: int) -> None:
    """A window that does not advance would never end."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError(f"need 0 <= overlap < size, got size={size}, overlap={overlap}")
