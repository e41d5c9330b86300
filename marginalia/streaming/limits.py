"""Rate limits and debounce over event time, in batch and as streams.

What a limiter accepts depends on what it accepted before, so it is a fold over the events of a key in order; the fold streams
over sorted partitions (batch) or keeps its state in the state store (stream). Memory a key is bounded by the limit.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def cooldown_step(gap_us: int) -> Callable[[deque, int], bool]:
    """Accepts an event at least ``gap_us`` after the last accepted one; a rejected one does not move the clock."""

    def step(accepted: deque, t: int) -> bool:
        if accepted and t - accepted[-1] < gap_us:
            return False
        accepted.clear()
        accepted.append(t)
        return True

    return step


def window_step(most: int, window_us: int) -> Callable[[deque, int], bool]:
    """Accepts an event if less than ``most`` were accepted within the last ``window_us``; rejected ones do not count."""

    def step(accepted: deque, t: int) -> bool:
        while accepted and accepted[0] <= t - window_us:
            accepted.popleft()
        if len(accepted) >= most:
            return False
        accepted.append(t)
        return True

    return step


def limited(events: DataFrame, key: str, ts: str, event_id: str, step: Callable[[deque, int], bool]) -> DataFrame:
    """key, event_id, accepted of all events, each key in the order of ``ts`` and then ``event_id``. Null keys and times are left out."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, accepted = object(), deque()
        for b in batches:
            out = np.empty(b.num_rows, bool)
            for i, (k, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if k != now:
                    now, accepted = k, deque()
                out[i] = step(accepted, t)
            yield pa.record_batch([b.column(0), b.column(2), pa.array(out)], names=[key, event_id, "accepted"])

    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    own = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(key, micros.alias("__t"), event_id)
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    return own.repartition(key).sortWithinPartitions(key, "__t", event_id).mapInArrow(fold, f"{key} {kinds[key]}, {event_id} {kinds[event_id]}, accepted boolean")


def limited_stream(events: DataFrame, key: str, ts: str, event_id: str, step: Callable[[deque, int], bool]) -> DataFrame:
    """The same over a stream, the accepted times kept in state; events of a batch are taken in the order of their time."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}

    def fold(group: tuple[Any, ...], rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        accepted = deque(state.get[0]) if state.exists else deque()
        batch = pd.concat(list(rows)).sort_values(["__t", event_id])
        batch["accepted"] = [step(accepted, int(t)) for t in batch["__t"]]
        state.update((list(accepted),))
        yield batch[[key, event_id, "accepted"]]

    own = events.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("__t"), event_id)
    return own.groupBy(key).applyInPandasWithState(fold, f"{key} {kinds[key]}, {event_id} {kinds[event_id]}, accepted boolean", "accepted array<bigint>", "append", GroupStateTimeout.NoTimeout)


def debounced(events: DataFrame, key: str, ts: str, gap: str, lateness: str | None = None) -> DataFrame:
    """Trailing debounce: one row a burst of events that are less than ``gap`` apart: key, first_at, fires_at, events.

    ``lateness`` makes it a stream aggregate with a watermark."""
    own = events.withColumn("__at", F.col(ts).cast("timestamp"))
    if lateness:
        own = own.withWatermark("__at", lateness)
    bursts = own.groupBy(key, F.session_window("__at", gap).alias("w")).agg(F.count("*").alias("events"))
    return bursts.select(key, F.col("w.start").alias("first_at"), F.col("w.end").alias("fires_at"), "events")


def file_events(sightings: DataFrame, own: list[str] = ()) -> DataFrame:
    """The events behind the sightings of files (path, mtime, listed_at, removed_at), each with its time: path, at, event.

    ``create`` for a path seen for the first time or after its removal, ``modify`` for another mtime, ``delete`` for a removal
    of a path that was there; a sighting that says nothing new is no event. Paths below the folders ``own`` are the
    index's own files and are left out. Sightings of one moment: removal last. A rename is a delete and a create."""
    kept = sightings.where(F.col("path").isNotNull()).select("path", "mtime", "listed_at", F.col("removed_at").isNotNull().alias("gone")).distinct()
    for folder in own:
        kept = kept.where(~F.col("path").startswith(folder.rstrip("/") + "/"))
    order = Window.partitionBy("path").orderBy("listed_at", "gone", "mtime")
    seen = kept.withColumn("before", F.lag(F.struct("gone", "mtime")).over(order))
    there = F.col("before").isNotNull() & ~F.col("before.gone")
    event = F.when(F.col("gone") & there, "delete").when(~F.col("gone") & ~F.coalesce(there, F.lit(False)), "create").when(~F.col("gone") & ~F.col("mtime").eqNullSafe(F.col("before.mtime")), "modify")
    return seen.withColumn("event", event).where("event is not null").select("path", F.col("listed_at").alias("at"), "event")


def change_feed(listing: DataFrame, apply: Callable[[DataFrame], None], checkpoint: str):
    """Run ``apply`` on each batch of a streamed listing, one at a time; batches are serial by construction."""
    return listing.writeStream.foreachBatch(lambda df, _: apply(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
