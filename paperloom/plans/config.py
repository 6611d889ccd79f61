"""Thresholds of the document pipeline, with the bounds that requests may use."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PipelineConfig:
    chunk_size: int = 2000
    chunk_overlap: int = 200
    min_chunk_tokens: int = 50
    max_file_bytes: int = 50 * 1024 * 1024
    max_pages: int = 500
    heading_ratios: tuple[float, ...] = (1.8, 1.5, 1.3, 1.2)
    header_ratio: float = 0.5
    rate_limit: int = 60
    rate_window_s: int = 60
    output_format: str = "text"
    order_scope: str = "page"

    def __post_init__(self) -> None:
        if not 100 <= self.chunk_size <= 32000:
            raise ValueError("chunk_size must be in 100..32000")
        if not 0 <= self.chunk_overlap <= 4000 or self.chunk_overlap >= self.chunk_size:
            raise ValueError("chunk_overlap must be in 0..4000 and below chunk_size")
        if self.output_format not in ("text", "markdown", "semantic_html"):
            raise ValueError(f"unknown output format {self.output_format!r}")
