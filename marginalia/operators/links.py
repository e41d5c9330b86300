"""The link graph of notes: forward links and backlinks by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import link_key


def outbound(chunks: DataFrame) -> DataFrame:
    """note_path, key: distinct link keys of every note; empty keys are no links."""
    links = chunks.select("note_path", F.explode("links").alias("l")).distinct()
    return links.select("note_path", link_key(F.col("l")).alias("key")).where(F.length("key") > 0).distinct()


def note_keys(chunks: DataFrame) -> DataFrame:
    return chunks.select("note_path").distinct().select("note_path", link_key(F.col("note_path")).alias("key"))


def edges(chunks: DataFrame) -> DataFrame:
    """src, dst: a link reaches every note with its key, itself excepted. Links are collapsed to one row a note and key first."""
    targets = note_keys(chunks).select(F.col("note_path").alias("dst"), "key")
    return outbound(chunks).select(F.col("note_path").alias("src"), "key").join(targets, "key").where("src <> dst").select("src", "dst").distinct()


def related(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    """note_path, direction (``to`` or ``from``), other of the given notes."""
    e = edges(chunks)
    to = e.join(paths.select(F.col("note_path").alias("src")).distinct(), "src", "left_semi").select(F.col("src").alias("note_path"), F.lit("to").alias("direction"), F.col("dst").alias("other"))
    back = e.join(paths.select(F.col("note_path").alias("dst")).distinct(), "dst", "left_semi").select(F.col("dst").alias("note_path"), F.lit("from").alias("direction"), F.col("src").alias("other"))
    return to.unionByName(back)
