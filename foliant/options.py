"""Tunable limits shared by the operators, with the defaults of the system we stay compatible with."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    # retrieval
    top_k: int = 15
    document_wide_top_k: int = 30
    min_score: float = 0.45
    max_per_page: int = 3
    keyword_score: float = 0.92
    fallback_rows: int = 3
    overfetch: int = 2
    # context budgets, in characters
    max_context_chars: int = 16000
    max_chunk_chars: int = 2400
    small_document_chars: int = 50000
    full_document_chars: int = 48000
    pass_chars: int = 0
    max_passes: int = 5
    candidate_hints: int = 50
    verification_pass: bool = False
    # chunking
    chunk_chars: int = 3000
    overlap_chars: int = 300
    min_split_chars: int = 150
    min_chunk_chars: int = 80
    # answers
    min_confidence: float = 95.0
    first_values: int = 10
    # ingestion
    max_attempts: int = 3
    lock_minutes: int = 30
    structured_ready_first: bool = True
    # index
    index_prefix: str = "chunks"
    preview_chars: int = 500
    log_preview_chars: int = 1000

    @property
    def chars_per_pass(self) -> int:
        return self.pass_chars if self.pass_chars > 0 else self.full_document_chars


DEFAULTS = Options()
