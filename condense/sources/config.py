"""Settings: typed, with defaults for whatever a file lacks or has wrong."""

from __future__ import annotations

import dataclasses
import json
import os
import tempfile


@dataclasses.dataclass(frozen=True)
class Config:
    # Default limits.
    hash_prefix: int = 12
    cap_bytes: int = 48 << 20
    cap_blobs: int = 9000
    gc_age_ms: int = 30 * 60_000
    recall_chars: int = 2000
    fidelity_chars: int = 24 << 10
    toc_entries: int = 24
    active_ttl_ms: int = 5 * 60_000
    prose_least_chars: int = 500
    prose_ratio: float = 0.65
    mask_keep_last: int = 8
    mask_polling: int = 16
    mask_least_chars: int = 500
    mask_least_savings: float = 0.1
    breaker_threshold: int = 3
    breaker_rest: int = 5
    playbook_cap: int = 24
    log_level: str = "info"


def merge(base: Config, values: dict) -> Config:
    """``base`` with the values whose name and type fit."""
    fit = {}
    for f in dataclasses.fields(base):
        kind = type(getattr(base, f.name))
        v = values.get(f.name)
        if isinstance(v, bool):
            continue
        if isinstance(v, kind) or (kind is float and isinstance(v, int)):
            fit[f.name] = kind(v)
    return dataclasses.replace(base, **fit)


def load(path: str) -> Config:
    """Settings from a JSON file; defaults where it is missing or broken."""
    try:
        with open(path, encoding="utf-8") as f:
            values = json.load(f)
    except (OSError, ValueError):
        return Config()
    return merge(Config(), values) if isinstance(values, dict) else Config()


def save(config: Config, path: str) -> None:
    """Write to a temporary file and rename it."""
    fd, temp = tempfile.mkstemp(dir=os.path.dirname(path) or ".", suffix=".tmp")
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        json.dump(dataclasses.asdict(config), f)
    os.replace(temp, path)
