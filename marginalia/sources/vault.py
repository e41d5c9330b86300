"""Folders of notes and attachments as DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.control.paths import normal
from marginalia.functions.text import attachment_title
from marginalia.operators.budget import CLIP_CHARS, CORPUS_CHARS, within_corpus_budget
from marginalia.operators.filters import eligible, has_tag

MOST_BYTES = 50 << 20
NOTICE = "\n\n[text cut]"


def _relative(root: str):
    """The path of a file below the root; paths come as URIs, in which a plus sign stands for itself."""
    base = root.removeprefix("file:").rstrip("/") + "/"
    path = F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B")))
    return F.substring(path, F.instr(path, base) + len(base), F.length(path))


def list_files(spark: SparkSession, root: str, extensions: list[str] | None = None) -> DataFrame:
    """path (relative to the root), mtime in ms, size_bytes; contents are not read. Endings are compared whatever their case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    out = files.select(_relative(root).alias("path"), F.unix_millis("modificationTime").alias("mtime"), F.col("length").alias("size_bytes"))
    if extensions is not None:
        out = out.where(F.lower(F.regexp_extract("path", "\\.([^./]+)$", 1)).isin([e.lower().lstrip(".") for e in extensions]))
    return out


def list_notes(spark: SparkSession, root: str) -> DataFrame:
    return list_files(spark, root, ["md"])


def read_binary(spark: SparkSession, root: str, extensions: list[str] | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Files with their content, none larger than ``most_bytes``; the size is tested before a file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= most_bytes)
    out = files.select(_relative(root).alias("path"), F.unix_millis("modificationTime").alias("mtime"), "content")
    if extensions is not None:
        out = out.where(F.lower(F.regexp_extract("path", "\\.([^./]+)$", 1)).isin([e.lower().lstrip(".") for e in extensions]))
    return out


def read_text(files: DataFrame) -> DataFrame:
    """``content`` as text; malformed UTF-8 becomes U+FFFD."""
    return files.withColumn("content", F.make_valid_utf8(F.col("content").cast("string")))


def scan_notes(spark: SparkSession, root: str, include=(), exclude=(), patterns=(), exclude_tags=(), known: DataFrame | None = None) -> DataFrame:
    """note_path, mtime, content, unchanged of the eligible notes; ``known`` (note_path, mtime) gives stubs without content.

    Path rules and the comparison with ``known`` come before any content is read."""
    from marginalia.operators.chunker import note_metadata

    listing = list_notes(spark, root).where(eligible(F.col("path"), list(include), list(exclude), list(patterns))).withColumnRenamed("path", "note_path")
    stubs = listing.limit(0)
    if known is not None:
        stubs = listing.join(known.select("note_path", "mtime").distinct(), ["note_path", "mtime"], "left_semi")
        listing = listing.join(stubs.select("note_path"), "note_path", "left_anti")
    content = read_text(read_binary(spark, root, ["md"])).select(F.col("path").alias("note_path"), "content")
    notes = listing.join(content, "note_path")
    if exclude_tags:
        tags = note_metadata(notes).select("note_path", "tags")
        notes = notes.join(tags, "note_path").where(~has_tag(F.col("tags"), list(exclude_tags)))
    read = notes.select("note_path", "mtime", "content", F.lit(False).alias("unchanged"))
    return read.unionByName(stubs.select("note_path", "mtime", F.lit(None).cast("string").alias("content"), F.lit(True).alias("unchanged")))


def clip_text(text: str = "text", most: int = CLIP_CHARS):
    """Long extracted texts cut, with a notice; null stays null."""
    c = F.col(text)
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(NOTICE))).otherwise(c)


def attachments(extracted: DataFrame, budget: int = CORPUS_CHARS, group: str | None = None) -> DataFrame:
    """Attachment notes from extracted texts (path, mtime, text): note_path, mtime, content, title.

    Null texts yield no note; texts are clipped, then a corpus budget in the order of the paths applies (per ``group`` column
    if given: the order within a group is sequential by definition)."""
    some = extracted.where("text is not null").withColumn("text", clip_text())
    kept = within_corpus_budget(some, "text", [group] if group else [], ["path"], budget)
    return kept.select(F.col("path").alias("note_path"), "mtime", F.col("text").alias("content"), attachment_title(F.col("path")).alias("title"))


def scan_attachments(files: DataFrame, cache, extract: Callable[[DataFrame], DataFrame], most_bytes: int = MOST_BYTES, budget: int = CORPUS_CHARS, group: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(attachment notes, lookups) of attachment files (path, mtime, size_bytes): what the cache knows is not read again.

    ``cache``: an ``ExtractionCache``; ``extract``: (path, mtime, size_bytes) to (path, mtime, text), text null where there is
    none. Files over the size limit yield nothing and are remembered as that, as is every other result; then the corpus
    budget applies. ``lookups``: path, mtime, hit."""
    looked = cache.lookup(files)
    misses = files.join(looked.where("not hit").select("path", "mtime"), ["path", "mtime"], "left_semi")
    small, large = misses.where(F.col("size_bytes") <= most_bytes), misses.where(~(F.coalesce("size_bytes", F.lit(0)) <= most_bytes))
    fresh = extract(small).select("path", "mtime", "text").unionByName(large.select("path", "mtime", F.lit(None).cast("string").alias("text")))
    known = looked.where("hit").select("path", "mtime", "text").unionByName(fresh)
    own = known.join(files.select("path", group).distinct(), "path") if group else known
    cache.remember(fresh)
    return attachments(own, budget, group), looked.select("path", "mtime", "hit")


def write_files(rows: DataFrame, root: str) -> int:
    """Write texts (path, content) as files below a folder all executors share; how many."""
    base = root.removeprefix("file:").rstrip("/")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        there, at = fs.FileSystem.from_uri(base) if "://" in base else (fs.LocalFileSystem(), base)
        made: set[str] = set()
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                target = f"{at}/{normal(path)}"
                folder = target.rsplit("/", 1)[0]
                if folder not in made:
                    there.create_dir(folder, recursive=True)
                    made.add(folder)
                with there.open_output_stream(target) as out:
                    out.write((content or "").encode())
            yield pa.record_batch([pa.array([b.num_rows], pa.int64())], names=["n"])

    return rows.select("path", "content").mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0


def all_notes(notes: DataFrame, attached: DataFrame) -> DataFrame:
    """Notes and attachment notes in one table, notes first by ``kind``."""
    cols = ["note_path", "mtime", "content"]
    return notes.select(*cols, F.lit(0).alias("kind")).unionByName(attached.select(*cols, F.lit(1).alias("kind")))
