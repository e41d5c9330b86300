"""Keeping an index up to date: changes of notes, cached vectors and extractions, persisted versions."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX_VERSION = 1


def changes(listing: DataFrame, indexed: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """note_path, change: ``added``, ``updated`` (another mtime, older ones too, or forced), ``removed`` or ``unchanged``.

    Both sides: note_path, mtime, one row a note (of several the largest mtime counts)."""
    new = listing.groupBy("note_path").agg(F.max("mtime").alias("new"))
    old = indexed.groupBy("note_path").agg(F.max("mtime").alias("old"))
    both = new.join(old, "note_path", "full_outer")
    redo = F.lit(False)
    if forced is not None:
        both = both.join(forced.select("note_path").distinct().withColumn("redo", F.lit(True)), "note_path", "left")
        redo = F.coalesce("redo", F.lit(False))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when((F.col("new") != F.col("old")) | redo, "updated").otherwise("unchanged")
    return both.select("note_path", change.alias("change"))


def refreshed(chunks: DataFrame, change: DataFrame, rechunked: DataFrame) -> DataFrame:
    """The new chunk table: chunks of unchanged notes and those of added and updated ones."""
    keep = change.where("change = 'unchanged'").select("note_path")
    redo = change.where(F.col("change").isin("added", "updated")).select("note_path")
    return chunks.join(keep, "note_path", "left_semi").unionByName(rechunked.join(redo, "note_path", "left_semi"))


def refresh(notes: DataFrame, chunks: DataFrame, forced: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(new chunk table, changes) of an index after the notes changed: only added and updated notes are cut into chunks again.

    ``notes``: note_path, mtime, content (null for a stub that was not read: its chunks are kept as they are); ``chunks``: the
    chunk table so far. Contents of unchanged notes are never looked at."""
    from marginalia.operators.chunker import chunk_notes

    change = changes(notes.select("note_path", "mtime"), chunks.select("note_path", "mtime"), forced)
    redo = notes.join(change.where(F.col("change").isin("added", "updated")).select("note_path"), "note_path", "left_semi")
    again = chunk_notes(redo)
    common = [c for c in chunks.columns if c in again.columns]
    return refreshed(chunks.select(*common), change, again.select(*common)), change


def counts(change: DataFrame, chunks: DataFrame, had_index: bool) -> DataFrame:
    """added, updated, removed of a refresh, one row. The first refresh, without an index, gives its chunks as added."""
    if not had_index:
        return chunks.agg(F.count("*").alias("added")).select("added", F.lit(0).cast("long").alias("updated"), F.lit(0).cast("long").alias("removed"))
    return change.agg(*[F.count(F.when(F.col("change") == c, 1)).alias(c) for c in ("added", "updated", "removed")])


class ExtractionCache:
    """Extracted texts by path and mtime, negative results (null text) too; written only when something was remembered or dropped.

    A cache of another version is taken as empty, and :meth:`consume_reset` then says once that all must be read again."""

    SCHEMA = "path string, mtime bigint, extracted_text string"

    def __init__(self, spark: SparkSession, root: str, version: int = INDEX_VERSION):
        self.store, self.spark = Store(spark, root, version), spark
        held = self.store.load()
        self.reset = held is None and bool(self.store._manifests())
        self.rows, self.dirty = (held if held is not None else spark.createDataFrame([], self.SCHEMA)), False

    def consume_reset(self) -> bool:
        found, self.reset = self.reset, False
        return found

    def lookup(self, files: DataFrame) -> DataFrame:
        """path, mtime, hit, text of the files (path, mtime)."""
        known = self.rows.select("path", "mtime", F.col("extracted_text").alias("text"), F.lit(True).alias("__hit")).dropDuplicates(["path", "mtime"])
        return files.join(known, ["path", "mtime"], "left").select("path", "mtime", F.coalesce("__hit", F.lit(False)).alias("hit"), "text")

    def remember(self, extracted: DataFrame) -> None:
        """Add results (path, mtime, text; null: nothing to extract). Older entries of these paths go."""
        new = extracted.select("path", "mtime", F.col("text").alias("extracted_text"))
        self.rows = self.rows.join(new.select("path"), "path", "left_anti").unionByName(new)
        self.dirty = True

    def prune(self, live: DataFrame) -> None:
        self.rows = pruned_cache(self.rows, live)
        self.dirty = True

    def persist(self) -> bool:
        """Write what changed; whether anything was written."""
        if not self.dirty:
            return False
        self.store.save(self.rows)
        self.rows, self.dirty = self.store.load(), False
        return True


def embedding_plan(chunks: DataFrame, stored: DataFrame, same_identity: bool = True) -> DataFrame:
    """chunk_id, action: ``reuse`` a stored vector (same text hash), ``embed``, or ``remove`` one whose chunk is gone.

    ``chunks``: chunk_id, h; ``stored``: chunk_id, h; one row a chunk. Another provider or model (identity) reuses nothing."""
    now = chunks.select("chunk_id", F.col("h").alias("now"), F.lit(True).alias("there"))
    old = stored.select("chunk_id", F.col("h").alias("old"), F.lit(True).alias("kept"))
    both = now.join(old, "chunk_id", "full_outer")
    action = F.when(F.col("there").isNull(), "remove").when((F.col("now") == F.col("old")) & F.lit(same_identity), "reuse").otherwise("embed")
    return both.select("chunk_id", action.alias("action"))


def cache_lookup(files: DataFrame, cache: DataFrame) -> DataFrame:
    """path, hit: whether a file (path, mtime) has an entry of its mtime; an entry without text is one too."""
    entries = cache.select("path", "mtime").distinct().withColumn("__hit", F.lit(True))
    return files.join(entries, ["path", "mtime"], "left").select("path", F.coalesce("__hit", F.lit(False)).alias("hit"))


def pruned_cache(cache: DataFrame, live: DataFrame) -> DataFrame:
    """Entries whose path still exists."""
    return cache.join(live.select("path").distinct(), "path", "left_semi")


class Store:
    """A persisted table in versions: data first, then a small manifest; a reader sees the old version or the new one."""

    def __init__(self, spark: SparkSession, root: str, version: int = INDEX_VERSION):
        self.spark, self.root, self.version = spark, root.rstrip("/"), version
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        folder = self._path(f"{self.root}/manifest")
        if not self._fs.exists(folder):
            return []
        return sorted(int(n[:-5]) for s in self._fs.listStatus(folder) if (n := s.getPath().getName()).endswith(".json") and n[:-5].isdigit())

    def properties(self) -> dict | None:
        """The properties of the current version; None if there is none, or it is unreadable or of another version."""
        for n in reversed(self._manifests()):
            try:
                found = json.loads(self.spark.read.text(f"{self.root}/manifest/{n:08d}.json", wholetext=True).first()[0])
            except Exception:
                return None
            return found if found.get("version") == self.version else None
        return None

    def load(self) -> DataFrame | None:
        found = self.properties()
        return self.spark.read.parquet(f"{self.root}/{found['data']}") if found else None

    def save(self, df: DataFrame, changed: int | None = None, identity_changed: bool = False, **properties) -> bool:
        """Write a new version; with ``changed`` = 0 nothing is written, unless the identity of the provider changed."""
        if changed == 0 and not identity_changed:
            return False
        data = f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{data}")
        n = max(self._manifests(), default=-1) + 1
        self._fs.mkdirs(self._path(f"{self.root}/manifest"))
        hidden = self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(hidden, True)
        out.write(bytearray(json.dumps({"version": self.version, "data": data} | properties).encode()))
        out.close()
        return bool(self._fs.rename(hidden, self._path(f"{self.root}/manifest/{n:08d}.json")))

    def clear(self) -> None:
        self._fs.delete(self._path(self.root), True)
