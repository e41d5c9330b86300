"""Extractive summaries of notes: sentences by word frequency or by closeness to the centroid, diverse ones preferred."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from marginalia.functions.text import sentences, summary_tokens

MOST_UNITS, DEFAULT, MOST, BALANCE = 200, 5, 20, 0.7


def clamp(k: int) -> int:
    return max(1, min(MOST, k))


def units(notes: DataFrame, key: str = "note_path", text: str = "text", order: list[str] | None = None) -> DataFrame:
    """key, pos (from 0), sentence: the distinct sentences of a note in order, the first of equals whatever the case, at most MOST_UNITS.

    ``order`` are the columns that order several texts of a note. The bound is part of the summary operator.
    """
    order = order or []
    each = notes.select(key, *order, F.posexplode(sentences(F.col(text))).alias("__i", "sentence"))
    place = F.struct(*order, "__i", "sentence")
    first = each.groupBy(key, F.lower("sentence")).agg(F.min(place).alias("f")).select(key, "f.*")
    w = W.Window.partitionBy(key).orderBy(*order, "__i")
    # the limit on a row number is applied to each part of a note before it is put together
    return first.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= MOST_UNITS).select(key, (F.col("__n") - 1).alias("pos"), "sentence")


def centrality(sentence_units: DataFrame, key: str = "note_path") -> DataFrame:
    """Mean frequency, within the note, of the content words of each unit: key, pos, sentence, score; 0 without words."""
    words = sentence_units.select(key, "pos", F.explode(summary_tokens(F.col("sentence"))).alias("w"))
    known = words.withColumn("n", F.count("*").over(W.Window.partitionBy(key, "w")))
    mean = known.groupBy(key, "pos").agg(F.avg("n").alias("score"))
    return sentence_units.join(mean, [key, "pos"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def best(scored: DataFrame, k: int = DEFAULT, key: str = "note_path") -> DataFrame:
    """The ``k`` best units of each note, in the order of the text."""
    w = W.Window.partitionBy(key).orderBy(F.desc(F.round("score", 9)), "pos")
    return scored.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= clamp(k)).drop("__n")


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of ``a`` with those of ``b``; 0 where one is all zero."""
    norms = [np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b)]
    a, b = (np.divide(x, n, out=np.zeros_like(x), where=n > 0) for x, n in zip((a, b), norms, strict=True))
    return a @ b.T


def pick_diverse(scores: np.ndarray, like: np.ndarray, k: int) -> list[int]:
    """Greedy choice of units that are good and unlike those chosen before (``like``: their similarities); the earliest of equals."""
    scores, closest, chosen = np.asarray(scores, float), np.zeros(len(scores)), []
    while len(chosen) < min(k, len(scores)):
        value = BALANCE * scores - (1 - BALANCE) * closest
        value[chosen] = -np.inf
        chosen.append(int(value.argmax()))
        closest = np.maximum(closest, like[chosen[-1]])
    return sorted(chosen)


def best_diverse(vector_units: DataFrame, k: int = DEFAULT, key: str = "note_path") -> DataFrame:
    """Units with vectors (key, pos, v): those nearest to the centroid of their note and unlike each other. A note has at most MOST_UNITS units.

    Vectors of another length than the longest of their note are like nothing."""

    def choose(note: pd.DataFrame) -> pd.DataFrame:
        note = note.sort_values("pos")
        width = max(map(len, note["v"]), default=0)
        x = np.array([np.pad(np.asarray(v, float), (0, width - len(v))) for v in note["v"]]).reshape(len(note), width)
        whole = np.array([len(v) == width for v in note["v"]])
        scores = np.where(whole, _cosines(x, x.mean(axis=0, keepdims=True))[:, 0], 0.0)
        like = np.where(whole[:, None] & whole[None, :], _cosines(x, x), 0.0)
        return note.iloc[pick_diverse(scores, like, clamp(k))][[key, "pos"]]

    kind = vector_units.schema[key].dataType.simpleString()
    return vector_units.select(key, F.col("pos").cast("int").alias("pos"), "v").groupBy(key).applyInPandas(choose, f"{key} {kind}, pos int")
