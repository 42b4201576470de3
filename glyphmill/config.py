"""Settings of the engine; a value object, no global state."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class EngineConfig:
    # Limits and thresholds that results depend on.
    max_chars: int = 300_000
    max_upload_bytes: int = 10 * 1024 * 1024
    min_words: int = 80
    recommended_words: int = 250
    confident_words: int = 500
    paraphrase_min_words: int = 5
    paraphrase_max_words: int = 400
    similarity_min_words: int = 80
    level_medium: float = 0.35
    level_high: float = 0.65
    min_sentence_tokens: int = 30
    min_paragraph_words: int = 8
    mattr_window: int = 50
    ngram: int = 5
    overlap_min_words: int = 8
    overlap_threshold: float = 0.4
    max_queries: int = 8
    keywords_per_query: int = 6
    query_paragraph_words: int = 25
    lm_chunk: int = 512
    lm_context: int = 64
    classifier_chunk: int = 382
    use_token_stats: bool = True
    use_classifier: bool = True

    @classmethod
    def from_environment(cls, env: Mapping[str, str] | None = None, prefix: str = "GLYPHMILL_") -> EngineConfig:
        """Fields overridden by variables like GLYPHMILL_MIN_WORDS; values that don't parse raise ValueError."""
        env = os.environ if env is None else env
        given = {}
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper())
            if raw is not None:
                kind = type(f.default)
                given[f.name] = raw.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw)
        return cls(**given)
