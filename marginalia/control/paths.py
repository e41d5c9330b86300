"""Paths inside a vault: relative, normal, never leading out of it."""

from __future__ import annotations

import re


class UnsafePath(ValueError):
    """A path that is absolute, leaves its root or holds control characters."""


def normal(path: str) -> str:
    """Forward slashes, no empty or ``.`` segments, ``..`` resolved; what would leave the root is refused."""
    if re.search(r"[\x00-\x1f\x7f]", path):
        raise UnsafePath("control characters in a path")
    flat = path.strip().replace("\\", "/")
    if flat.startswith("/") or re.match(r"^[A-Za-z]:", flat):
        raise UnsafePath("absolute path")
    out: list[str] = []
    for part in flat.split("/"):
        if part == "..":
            if not out:
                raise UnsafePath("path leads out of its root")
            out.pop()
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def join(*parts: str) -> str:
    return normal("/".join(p.strip("/") for p in parts if p))


def inside(path: str, root: str) -> bool:
    try:
        p, r = normal(path), normal(root)
    except UnsafePath:
        return False
    return not r or p == r or p.startswith(r + "/")


def resolve(root: str, path: str) -> str:
    """A path below the root, checked."""
    full = join(root, normal(path))
    if not inside(full, root):
        raise UnsafePath("path leads out of its root")
    return full
