"""Processing each sequence number once: intervals of what is done, committed together with the output."""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from marginalia.session import materialize, release, scratch_dir

#: A ledger of more intervals than this is refused: the driver holds it (about 100 bytes an interval).
MAX_INTERVALS = 1_000_000
#: Up to so many intervals are a filter of plain comparisons; more are met by a join on blocks of sequence numbers.
MOST_COMPARISONS = 200
_BLOCK_BITS = 20


class IntervalSet:
    """A set of integers as sorted, disjoint, non-adjacent closed intervals."""

    def __init__(self, intervals: Iterable[tuple[int, int]] = ()):
        merged: list[tuple[int, int]] = []
        for lo, hi in sorted((int(a), int(b)) for a, b in intervals if a <= b):
            if merged and lo <= merged[-1][1] + 1:
                merged[-1] = (merged[-1][0], max(hi, merged[-1][1]))
            else:
                merged.append((lo, hi))
        self.intervals = tuple(merged)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, IntervalSet) and self.intervals == other.intervals

    def __hash__(self) -> int:
        return hash(self.intervals)

    def __bool__(self) -> bool:
        return bool(self.intervals)

    def __repr__(self) -> str:
        return f"IntervalSet({list(self.intervals)})"

    def union(self, other: IntervalSet) -> IntervalSet:
        return IntervalSet(self.intervals + other.intervals)

    def subtract(self, other: IntervalSet) -> IntervalSet:
        """What is in this set and not in the other: the gaps still to process."""
        left: list[tuple[int, int]] = []
        for lo, hi in self.intervals:
            at = lo
            for a, b in other.intervals:
                if b < at or a > hi:
                    continue
                if a > at:
                    left.append((at, a - 1))
                at = b + 1
            if at <= hi:
                left.append((at, hi))
        return IntervalSet(left)

    def contains(self, col: Column) -> Column:
        """A predicate of plain comparisons, which reaches the Parquet scan; null is in no set."""
        hit = F.lit(False)
        for lo, hi in self.intervals:
            hit = hit | ((col == lo) if lo == hi else col.between(lo, hi))
        return hit

    def rows_of(self, df: DataFrame, seq: str) -> DataFrame:
        """The rows of ``df`` whose ``seq`` is in the set: a filter, or for many intervals a join on blocks of 2**20 numbers
        that then tests the few intervals of the block."""
        if len(self.intervals) <= MOST_COMPARISONS:
            return df.where(self.contains(F.col(seq)))
        rows = df.sparkSession.createDataFrame(list(self.intervals), "lo long, hi long")
        block = F.explode(F.sequence(F.shiftright("lo", _BLOCK_BITS), F.shiftright("hi", _BLOCK_BITS)))
        held = rows.select(block.alias("__block"), "lo", "hi").groupBy("__block").agg(F.collect_list(F.struct("lo", "hi")).alias("__held"))
        met = df.withColumn("__block", F.shiftright(F.col(seq).cast("long"), _BLOCK_BITS)).join(held, "__block")
        return met.where(F.exists("__held", lambda x: F.col(seq).between(x["lo"], x["hi"]))).select(*df.columns)


def intervals_of(df: DataFrame, seq: str) -> IntervalSet:
    """The distinct values of ``seq`` as intervals, merged in Spark (gaps and islands); only the intervals reach the driver."""
    distinct = df.where(F.col(seq).isNotNull()).select(F.col(seq).cast("long").alias("s")).distinct()
    # islands inside blocks of a million numbers, in parallel; the pieces at block borders are merged by IntervalSet
    block = W.Window.partitionBy(F.shiftright("s", _BLOCK_BITS)).orderBy("s")
    islands = distinct.withColumn("g", F.col("s") - F.row_number().over(block)).groupBy(F.shiftright("s", _BLOCK_BITS), "g")
    rows = islands.agg(F.min("s").alias("lo"), F.max("s").alias("hi")).select("lo", "hi").limit(MAX_INTERVALS + 1).collect()
    if len(rows) > MAX_INTERVALS:
        raise ValueError(f"more than {MAX_INTERVALS} intervals: compact the sequence numbers first")
    return IntervalSet((r["lo"], r["hi"]) for r in rows)


class Ledger:
    """Intervals of processed sequence numbers, kept with the output they produced.

    A run writes its output into a folder of its own and then commits one new manifest that names all output folders and
    the merged intervals; the manifest is created under a number that must not exist yet, so of two runs one fails and
    commits nothing. A run that dies before that leaves a folder no manifest names: it is never read, and its numbers stay
    gaps. Numbers that are committed late are gaps below the highest number and are processed by the next run.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    def _latest(self) -> tuple[int, dict]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        if not numbers:
            return -1, {"intervals": [], "folders": []}
        lines = self.spark.read.text(f"{self.root}/manifests/{max(numbers):08d}.json", wholetext=True).first()
        return max(numbers), json.loads(lines[0])

    def processed(self) -> IntervalSet:
        return IntervalSet(tuple(x) for x in self._latest()[1]["intervals"])

    def output(self) -> DataFrame | None:
        """All committed output, None before the first commit."""
        folders = self._latest()[1]["folders"]
        return self.spark.read.parquet(*[f"{self.root}/data/{f}" for f in folders]) if folders else None

    def run(self, source: DataFrame, seq: str, process: Callable[[DataFrame], DataFrame], available: IntervalSet | None = None) -> IntervalSet:
        """Process the rows of ``source`` whose ``seq`` is available and not processed yet; returns the numbers it committed.

        The rows of the gaps are written once to the shared scratch folder, and both the processing and the numbers to
        commit come from that snapshot: what is committed is what was read, even if ``source`` grows meanwhile. A number
        that is available but has no row yet stays a gap, so its rows are processed by the run that first sees them. All
        rows of one number must become visible together. Rows with a null ``seq`` belong to no run and are left out.
        Nothing new: nothing is written.
        """
        number, last = self._latest()
        done = IntervalSet(tuple(x) for x in last["intervals"])
        gaps = (intervals_of(source, seq) if available is None else available).subtract(done)
        if not gaps:
            return gaps
        taken = materialize(gaps.rows_of(source, seq), "ledger-input")
        try:
            seen = intervals_of(taken, seq)
            if not seen:
                return seen
            folder = uuid.uuid4().hex
            process(taken).write.parquet(f"{self.root}/data/{folder}")
        finally:
            release(taken)
        self._commit(number + 1, {"intervals": done.union(seen).intervals, "folders": [*last["folders"], folder]})
        return seen

    def _commit(self, number: int, manifest: dict) -> None:
        temporary, final = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}"), self._path(f"{self.root}/manifests/{number:08d}.json")
        out = self._fs.create(temporary, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(temporary, final):
            raise RuntimeError("another run has committed in the meantime")


def handled(chunks: DataFrame, cache: DataFrame, vectors: DataFrame) -> DataFrame:
    """What the stored rows say was handled, by the run that wrote them: kind, record_key, state (mtime or hash, as text), run_id."""
    return (
        chunks.select(F.lit("note").alias("kind"), F.col("note_path").alias("record_key"), F.col("mtime").cast("string").alias("state"), "run_id")
        .unionByName(cache.select(F.lit("attachment").alias("kind"), F.col("path").alias("record_key"), F.col("mtime").cast("string").alias("state"), "run_id"))
        .unionByName(vectors.select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("record_key"), F.col("h").alias("state"), "run_id"))
        .distinct()
    )


def wanted(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """The records there are and their current state: kind, record_key, state. Live paths are notes or attachments; every chunk
    id counts with the hash of its present text (the row of the highest run)."""
    from marginalia.operators.orphans import file_states

    live = file_states(files).where("live")
    kind = F.when(F.col("path").endswith(".md"), "note").otherwise("attachment")
    present = (
        chunks.where(F.col("chunk_id").isNotNull())
        .groupBy(F.col("chunk_id").alias("record_key"))
        .agg(F.max(F.struct("run_id", "indexed_at", F.substring(F.md5(F.col("text")), 1, 16).alias("h"))).alias("s"))
        .select(F.lit("chunk").alias("kind"), "record_key", F.col("s.h").alias("state"))
    )
    return live.select(kind.alias("kind"), F.col("path").alias("record_key"), F.col("mtime").cast("string").alias("state")).unionByName(present)


def unprocessed(files: DataFrame, chunks: DataFrame, cache: DataFrame, vectors: DataFrame, runs: DataFrame, root: str | None = None) -> DataFrame:
    """Records that no successful run has handled in their current state, each once: kind, record_key.

    Run ids are the sequence numbers. The ledger at ``root`` (a new one in the shared scratch folder if None) keeps what
    the runs committed so far have handled: the succeeded run ids minus its intervals are the gaps, late runs among them;
    only the stored rows of those runs are read into it, and output and intervals are committed together. What a failed,
    running or unknown run wrote is never taken. The result is the current states the ledger's output does not hold. A
    ledger that is kept makes the next call read only new runs.

    Repeated rows count once, null keys are no record, a null text or mtime is never handled, empty tables give the
    records of the others.
    """
    ledger = Ledger(chunks.sparkSession, root or f"{scratch_dir(chunks.sparkSession)}/ledger-{uuid.uuid4().hex}")
    available = intervals_of(runs.where(F.col("status") == "succeeded"), "run_id")
    ledger.run(handled(chunks, cache, vectors), "run_id", lambda rows: rows.select("kind", "record_key", "state").distinct(), available)
    todo, known = wanted(files, chunks), ledger.output()
    if known is not None:
        todo = todo.join(known, ["kind", "record_key", "state"], "left_anti")
    return todo.select("kind", "record_key")


def replayed(rows: DataFrame, seq: str, root: str, steps: list[tuple[IntervalSet | None, IntervalSet | None, bool]]) -> DataFrame | None:
    """All committed output of a ledger after runs over ``rows``. A step names the numbers whose rows are visible to it (None:
    all), the numbers it is told are available (None: those it sees) and whether it dies between output and commit.
    Every number comes out once if a run that lives comes after its arrival."""
    for visible, available, dies in steps:
        seen = rows if visible is None else visible.rows_of(rows, seq)
        ledger = (_Dying if dies else Ledger)(rows.sparkSession, root)
        with contextlib.suppress(_Died):
            ledger.run(seen, seq, lambda taken: taken, available)
    return Ledger(rows.sparkSession, root).output()


class _Died(Exception):
    pass


class _Dying(Ledger):
    """A ledger whose runs end between writing their output and committing it."""

    def _commit(self, number: int, manifest: dict) -> None:
        raise _Died
