"""Parameters of the engine with their shipped values; a settings file and the environment may replace them."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Parameters:
    chunk_size: int = 800
    chunk_overlap: int = 100
    top_k: int = 5
    candidate_k: int = 20
    rrf_k: int = 60
    expand_n: int = 2
    rerank_top_n: int = 5
    embed_batch: int = 16
    embed_retries: int = 2
    index_retries: int = 3
    backoff_seconds: int = 5
    short_term_minutes: int = 60
    short_term_messages: int = 20
    long_term_messages: int = 50
    token_budget: int = 3000
    keep_recent: int = 6
    summary_trigger: int = 8
    hybrid: bool = True
    expand: bool = False
    structure: bool = True

    def pool(self) -> int:
        """Candidates for each question: as set, else four times the results and at least ten."""
        return self.candidate_k if self.candidate_k > 0 else max(10, 4 * self.top_k)


def load(settings: Mapping[str, object] | None = None, environment: Mapping[str, str] | None = None, prefix: str = "LOREWELL_") -> Parameters:
    """Settings first, then the environment over them; a number of 0 or less falls back to the default."""
    env = os.environ if environment is None else environment
    out, default = Parameters(), Parameters()
    for f in fields(Parameters):
        raw = env.get(prefix + f.name.upper(), (settings or {}).get(f.name))
        if raw is None:
            continue
        if isinstance(getattr(default, f.name), bool):
            value: object = str(raw).strip().lower() in ("1", "true", "yes", "on")
        else:
            value = int(str(raw).strip())
            value = value if value > 0 or f.name in ("candidate_k", "chunk_overlap") else getattr(default, f.name)
        out = replace(out, **{f.name: value})
    return out
