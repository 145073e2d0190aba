"""Settings of a workspace: where they come from, in which order they hold, and how they are written."""

from __future__ import annotations

import json
import os
import re
import uuid
from dataclasses import asdict, dataclass, fields, replace

FOLDER = ".chunkwise"


@dataclass(frozen=True)
class Settings:
    store_dir: str | None = None
    chunk_size: int = 1000
    min_chunk_chars: int = 200
    top_k: int = 5
    search_mode: str = "hybrid"
    analyzer: str = "standard"
    rerank_candidates: int | None = None
    url_freshness_hours: int = 24
    binary_extensions: tuple[str, ...] = ()

    def candidates(self) -> int:
        """Candidates given to a reranker: three times the results unless set."""
        return self.rerank_candidates or 3 * self.top_k


def snake(key: str) -> str:
    """``chunk-size`` and ``chunkSize`` name the same setting."""
    return re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", key).replace("-", "_").lower()


def read(path: str) -> dict:
    """Known settings of a YAML or JSON file; a missing or empty file has none; unknown keys are errors."""
    if not os.path.exists(path):
        return {}
    import yaml

    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f) or {}
    known = {f.name for f in fields(Settings)}
    out = {snake(k): v for k, v in raw.items()}
    unknown = sorted(set(out) - known)
    if unknown:
        raise ValueError(f"unknown settings in {path}: {', '.join(unknown)}")
    return out


def merge(home: dict, local: dict) -> dict:
    """Local settings before those of the home folder; a local store folder is not taken."""
    return {**home, **{k: v for k, v in local.items() if k != "store_dir"}}


def resolve(command: dict | None = None, startup: dict | None = None, environment: dict | None = None, file: dict | None = None) -> Settings:
    """The first source that names a setting stands: command, startup, environment (``CHUNKWISE_…``), file, default."""
    env = {k[len("CHUNKWISE_") :].lower(): v for k, v in (environment or {}).items() if k.startswith("CHUNKWISE_")}
    out = Settings()
    for f in fields(Settings):
        for source in (command or {}, startup or {}, env, file or {}):
            value = source.get(f.name)
            if value is None:
                continue
            if isinstance(f.default, int) or f.name == "rerank_candidates":
                value = int(value)
            elif f.name == "binary_extensions":
                value = tuple(value.split(",")) if isinstance(value, str) else tuple(value)
            out = replace(out, **{f.name: value})
            break
    return out


def workspace(start: str) -> str | None:
    """The nearest folder at or above ``start`` that holds a workspace folder."""
    at = os.path.abspath(start)
    while True:
        if os.path.isdir(os.path.join(at, FOLDER)):
            return os.path.join(at, FOLDER)
        up = os.path.dirname(at)
        if up == at:
            return None
        at = up


def write(path: str, settings: Settings) -> None:
    """Write the settings that differ from the defaults; the file appears whole or not at all."""
    plain = {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(settings).items() if v != getattr(Settings(), k)}
    draft = f"{path}.{uuid.uuid4().hex}"
    with open(draft, "w", encoding="utf-8") as f:
        json.dump(plain, f, indent=2)
    os.replace(draft, path)
