"""Settings with safe defaults: read leniently, written without secrets."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field, fields
from typing import Any

SCHEMA = 1
_SECRET = re.compile(r"key|token|secret|password|authorization|bearer", re.I)
DEEPEST = 4


@dataclass
class Settings:
    schema: int = SCHEMA
    root: str = "Memory"
    include_folders: list[str] = field(default_factory=list)
    exclude_folders: list[str] = field(default_factory=list)
    exclude_patterns: list[str] = field(default_factory=list)
    exclude_tags: list[str] = field(default_factory=list)
    retrieval_mode: str = "lexical"
    embedding_provider: str = "none"
    embedding_model: str = ""
    embedding_endpoint: str = ""
    embedding_key: str = ""
    batch_size: int = 16
    direct_writes: bool = False
    drop_near_duplicates: bool = False
    note_cap: bool = False
    host: str = "127.0.0.1"
    port: int = 7331

    @classmethod
    def read(cls, stored: Any) -> Settings:
        """Known fields of the right kind are taken over, everything else stays at its default; numbers are clamped."""
        out = cls()
        if not isinstance(stored, dict):
            return out
        for f in fields(cls):
            value, default = stored.get(f.name), getattr(out, f.name)
            if isinstance(default, bool):
                if isinstance(value, bool):
                    setattr(out, f.name, value)
            elif isinstance(default, list):
                if isinstance(value, list):
                    setattr(out, f.name, [v.strip() for v in value if isinstance(v, str) and v.strip()])
            elif isinstance(value, type(default)) and not isinstance(value, bool):
                setattr(out, f.name, value)
        out.schema = SCHEMA
        out.batch_size = max(1, min(512, out.batch_size))
        if out.retrieval_mode not in ("lexical", "vector", "hybrid"):
            out.retrieval_mode = "lexical"
        if not 1 <= out.port <= 65535:
            out.port = cls.port
        return out

    def backup(self) -> dict:
        return redacted(asdict(self))


def redacted(value: Any, depth: int = 0) -> Any:
    """A copy in which whatever is named like a secret is hidden."""
    if depth > DEEPEST:
        return "…"
    if isinstance(value, dict):
        return {k: "[redacted]" if _SECRET.search(str(k)) and v else redacted(v, depth + 1) for k, v in value.items()}
    if isinstance(value, list):
        return [redacted(v, depth + 1) for v in value]
    return value


def entries(text: str) -> list[str]:
    """A list typed with commas or on lines."""
    return [x.strip() for x in re.split(r"[,\n]", text) if x.strip()]


def what_changed(old: Settings, new: Settings) -> set[str]:
    """Which parts of an index a change of settings makes stale: root, embedding, scan."""
    groups = {
        "root": ("root",),
        "embedding": ("embedding_provider", "embedding_model", "embedding_endpoint", "embedding_key"),
        "scan": ("include_folders", "exclude_folders", "exclude_patterns", "exclude_tags"),
    }
    return {g for g, names in groups.items() if any(getattr(old, n) != getattr(new, n) for n in names)}
