"""The Markdown files of a memory folder: read if there, append, create if missing, and the review inbox.

Single files on any Hadoop file system. Bulk work on entries is in ``operators/memory.py``; blocks are rendered by it too, so
there is one form of a block. Reads and writes of the inbox are serialised within the process.
"""

from __future__ import annotations

import threading
import uuid
from datetime import datetime

from pyspark.sql import SparkSession

from marginalia.control import paths
from marginalia.functions import text as T
from marginalia.operators import memory

INBOX_HEADER = "# Pending memory\n\nProposals to review: apply or discard them.\n\n---\n\n"
ENTRY = "entry_type string, content string, project string, source string, origin_tool string, confidence string, tags array<string>, related_paths array<string>, timestamp_label string, status string, raw string"
_TITLES = {"profile": "Profile", "preferences": "Preferences", "conventions": "Conventions", "overview": "Overview", "architecture": "Architecture", "decisions": "Decisions", "tasks": "Tasks", "open-questions": "Open questions"}


class Refused(ValueError):
    """What is not allowed, or no longer there."""


class MemoryFiles:
    def __init__(self, spark: SparkSession, base: str, root: str = "Memory", base_tag: str = "memory", allow_direct: bool = False):
        self.spark, self.base, self.root, self.tag, self.allow_direct = spark, base.rstrip("/"), root, base_tag, allow_direct
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._lock = threading.RLock()
        self.inbox = paths.resolve(root, "Inbox/pending-memory.md")

    def _at(self, path: str):
        return self._hadoop.Path(f"{self.base}/{path}" if path else self.base)

    # -- files

    def exists(self, path: str) -> bool:
        return bool(self._fs.exists(self._at(path)))

    def read(self, path: str) -> str | None:
        """The text of a file, None if it is missing or cannot be read."""
        if not self.exists(path):
            return None
        try:
            return self.spark.read.text(str(self._at(path)), wholetext=True).first()[0]
        except Exception:
            return None

    def write(self, path: str, text: str) -> None:
        """Replace a file: a new one is written beside it, the old one is put aside and comes back if the change fails."""
        target, aside = self._at(path), self._at(f"{path}.{uuid.uuid4().hex}.old")
        fresh = self._at(f"{path}.{uuid.uuid4().hex}.new")
        self._fs.mkdirs(target.getParent())
        out = self._fs.create(fresh, True)
        out.write(bytearray(text.encode()))
        out.close()
        had = self._fs.exists(target) and self._fs.rename(target, aside)
        if not self._fs.rename(fresh, target):
            if had:
                self._fs.rename(aside, target)
            raise OSError(f"cannot write {path}")
        if had:
            self._fs.delete(aside, False)

    def append(self, path: str, text: str) -> None:
        """Add to the end of a file; a missing one is made."""
        with self._lock:
            self.write(path, (self.read(path) or "") + text)

    def create(self, path: str, text: str) -> bool:
        """Write a file unless it is there; whether it was written."""
        with self._lock:
            if self.exists(path):
                return False
            self.write(path, text)
            return True

    # -- the inbox

    def _row(self, entry: dict):
        known = [f.split()[0] for f in ENTRY.split(", ")]
        full = {"entry_type": "note", "tags": [], "related_paths": [], "source": "", "status": "pending", "timestamp_label": datetime.now().strftime("%Y-%m-%d %H:%M")} | entry
        return self.spark.createDataFrame([tuple(full.get(k) for k in known)], ENTRY)

    def block(self, entry: dict) -> str:
        return self._row(entry).select(memory.pending_block(self.tag)).first()[0]

    def entries(self) -> list[dict]:
        """The entries of the inbox in order, each with its ``raw`` block."""
        parts = (self.read(self.inbox) or "").split("\n" + memory.HEADING)
        blocks = [memory.HEADING + p for p in parts[1:]] if parts[0].startswith(memory.HEADING) is False else [parts[0], *(memory.HEADING + p for p in parts[1:])]
        blocks = [b if i == len(blocks) - 1 else b + "\n" for i, b in enumerate(blocks)]
        return [{"raw": b} | found for b in blocks if (found := memory.parse_block(b, self.tag))]

    def propose(self, entry: dict) -> bool:
        """Add a proposal to the inbox; False if one that says the same is there already."""

        def same(x: dict) -> tuple:
            return " ".join((x.get("content") or "").split()).lower(), x.get("entry_type") or "note", x.get("project") or ""

        with self._lock:
            if not self.exists(self.inbox):
                self.write(self.inbox, INBOX_HEADER + self.block(entry))
                return True
            if any(same(x) == same(entry) for x in self.entries()):
                return False
            self.append(self.inbox, self.block(entry))
            return True

    def direct(self, path: str, entry: dict) -> str:
        """Append an entry to a memory file without review: only if that is allowed, and only below the root."""
        if not self.allow_direct:
            raise Refused("direct writes are not allowed")
        target = paths.resolve(self.root, path)
        self.append(target, ("\n" if self.exists(target) else "") + self.block(entry))
        return target

    def _without(self, raw: str) -> str:
        text = self.read(self.inbox)
        if text is None or raw not in text:
            raise Refused("the entry is no longer in the inbox")
        return text.replace(raw, "", 1)

    def apply(self, entry: dict) -> str:
        """Append an entry of the inbox to its file, then take it out of the inbox: a failure between leaves it in both, never in none."""
        with self._lock:
            rest = self._without(entry["raw"])
            row = self._row(entry).select(memory.destination(self.root).alias("path"), memory.applied_block(self.tag, "Applied from review").alias("block")).first()
            if not paths.inside(row["path"], self.root):
                raise Refused("the destination is outside the memory folder")
            self.append(row["path"], ("\n" if self.exists(row["path"]) else "") + row["block"])
            self.write(self.inbox, rest)
            return row["path"]

    def discard(self, entry: dict) -> None:
        with self._lock:
            self.write(self.inbox, self._without(entry["raw"]))

    # -- scaffold

    def scaffold(self) -> list[str]:
        """The global files, made where they are missing; the paths made."""
        made = [paths.resolve(self.root, f"Global/{n}.md") for n in ("profile", "preferences", "conventions")]
        return [p for p in made if self.create(p, f"# {_TITLES[p.rsplit('/', 1)[1][:-3]]}\n")]

    def project(self, name: str) -> str:
        """The folder of a project, its files made where they are missing."""
        folder = self.spark.range(1).select(T.project_folder(_lit(name))).first()[0]
        if not folder:
            raise Refused("a project needs a name")
        home = paths.resolve(self.root, f"Projects/{folder}")
        for n in ("overview", "architecture", "decisions", "tasks", "open-questions"):
            self.create(f"{home}/{n}.md", f"# {_TITLES[n]} — {folder}\n")
        return home

    def start_session(self, name: str, stamp: str) -> str:
        path = paths.resolve(f"{self.project(name)}", f"Sessions/{stamp}.md")
        self.create(path, f"# Session {stamp} — {name}\n\n## Goals\n\n## Notes\n\n## Outcomes\n")
        return path

    def end_session(self, path: str, summary: str) -> None:
        self.append(path, f"\n## Session closed\n\n{summary.strip()}\n")


def _lit(value: str):
    from pyspark.sql import functions as F

    return F.lit(value)
