"""Engine settings, each overridable by an environment variable."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


def as_flag(value: str | None, default: bool = False) -> bool:
    """Read ``1``, ``true``, ``yes`` or ``on`` in any case as true."""
    return default if value is None else value.strip().lower() in ("1", "true", "yes", "on")


def _env(name: str, default: str):
    return field(default_factory=lambda: os.environ.get(name, default))


def _env_int(name: str, default: int):
    return field(default_factory=lambda: int(os.environ.get(name, default)))


@dataclass(frozen=True)
class Settings:
    embedding_model: str = _env("EMBEDDING_MODEL", "BAAI/bge-small-zh-v1.5")
    legacy_embedding_version: str = "bge-small-zh-v1.5"
    default_search_k: int = _env_int("DEFAULT_SEARCH_K", 150)
    max_results_display: int = _env_int("MAX_RESULTS_DISPLAY", 50)


def clamp_limit(value: object, least: int = 1, most: int = 50, default: int = 10) -> int:
    """A result limit between 1 and 50; anything that is no whole number gives 10."""
    try:
        return max(least, min(most, int(str(value))))
    except ValueError:
        return default
