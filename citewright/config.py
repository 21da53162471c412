"""Policy and settings. All of it is plan-time input; nothing here touches data."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields, replace

SECRET_WORDS = ("key", "secret", "token", "password", "credential", "dsn", "redis_url")


def split_list(raw: str | list[str] | None) -> list[str]:
    """A list setting written as JSON or with commas; blanks go."""
    if raw is None:
        return []
    if isinstance(raw, (list, tuple)):
        return [str(x).strip() for x in raw if str(x).strip()]
    text = raw.strip()
    if text.startswith("["):
        return [str(x).strip() for x in json.loads(text) if str(x).strip()]
    return [x.strip() for x in text.split(",") if x.strip()]


@dataclass(frozen=True)
class Policy:
    """What a request may set, with the defaults of the pipeline."""

    banned_domains: tuple[str, ...] = ()
    authoritative_domains: tuple[str, ...] = ()
    low_quality_domains: tuple[str, ...] = ()
    exclude_default_domains: tuple[str, ...] = ()
    source_weight: float = 0.4
    chunk_weight: float = 0.6
    relevance_weight: float = 0.6
    quality_weight: float = 0.4
    quality_threshold: float = 0.2
    max_ranked_chunks: int = 10
    max_chunks_per_request: int = 200
    max_rewrite_loops: int = 3
    max_retrieval_retries: int = 1
    answerability_floor: float = 0.15
    semantic_verification: bool = True
    rrf_k: int = 60

    def __post_init__(self) -> None:
        for name in ("source_weight", "chunk_weight", "relevance_weight", "quality_weight"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must lie in 0..1")
        for name, low, high in (("max_ranked_chunks", 1, 50), ("max_rewrite_loops", 1, 5), ("max_retrieval_retries", 0, 3)):
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must lie in {low}..{high}")
        for name in ("banned_domains", "authoritative_domains", "low_quality_domains", "exclude_default_domains"):
            if len(getattr(self, name)) > 100:
                raise ValueError(f"{name} takes at most 100 entries")

    def under(self, server: Policy) -> Policy:
        """The request's policy with the trust lists and the semantic switch of the server."""
        return replace(self, authoritative_domains=server.authoritative_domains, low_quality_domains=server.low_quality_domains, exclude_default_domains=server.exclude_default_domains, semantic_verification=server.semantic_verification)


@dataclass(frozen=True)
class Settings:
    """Service settings: environment over file over default."""

    search_backend: str = "corpus"
    search_api_key: str = ""
    embedding_model: str = ""
    llm_api_key: str = ""
    redis_url: str = ""
    api_keys: tuple[str, ...] = ()
    allowed_metric_models: tuple[str, ...] = ()
    cache_ttl_s: int = 300
    cache_size: int = 256
    rate_limit: str = "20/minute"
    audit_retention: int = 0
    max_llm_calls: int = 64
    max_llm_tokens: int = 0
    sources: dict[str, str] = field(default_factory=dict, compare=False)

    @classmethod
    def load(cls, env: dict[str, str] | None = None, file: dict[str, str] | None = None, prefix: str = "CITEWRIGHT_") -> Settings:
        env = os.environ if env is None else env
        values, sources = {}, {}
        for f in fields(cls):
            if f.name == "sources":
                continue
            for where, table in (("env", env), ("file", file or {})):
                raw = table.get(prefix + f.name.upper())
                if raw is not None:
                    values[f.name] = tuple(split_list(raw)) if "tuple" in str(f.type) else int(raw) if f.type == "int" else raw
                    sources[f.name] = where
                    break
            else:
                sources[f.name] = "default"
        return cls(**values, sources=sources)

    def describe(self) -> list[tuple[str, str, str]]:
        """name, value, where it came from; every secret is masked."""
        out = []
        for f in fields(self):
            if f.name == "sources":
                continue
            value = getattr(self, f.name)
            secret = any(w in f.name for w in SECRET_WORDS) and not f.name.startswith("max_")
            out.append((f.name, ("***" if value else "") if secret else str(value), self.sources.get(f.name, "default")))
        return out
