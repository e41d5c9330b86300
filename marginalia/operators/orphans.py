"""References to records that do not exist: Bloom filter first, exact join for what it cannot rule out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import link_key
from marginalia.operators import bloom
from marginalia.operators.skew import lookup
from marginalia.session import materialize


def file_states(files: DataFrame) -> DataFrame:
    """One row a path of the sightings: path, mtime, live, first_listed.

    The sighting with the latest ``listed_at`` is the current state; of several at that moment, a listing goes before a
    removal and then the larger mtime. Rows without a path are ignored; a null ``listed_at`` counts as earliest.
    """
    order = F.struct(F.col("listed_at"), F.col("removed_at").isNull().alias("live"), F.col("mtime"))
    return (
        files.where(F.col("path").isNotNull())
        .groupBy("path")
        .agg(F.max(order).alias("s"), F.min("listed_at").alias("first_listed"))
        .select("path", F.col("s.mtime").alias("mtime"), F.col("s.live").alias("live"), "first_listed")
    )


def orphan_references(refs: DataFrame, parents: DataFrame, expected_parents: int) -> DataFrame:
    """References without a usable parent.

    ``refs``: key, at (when the reference was made) and any other columns. ``parents``: key, live, first_listed, several
    rows a key allowed. Result: the columns of ``refs`` with ``reason``: ``missing`` if no parent has the key, ``deleted``
    if none of them is live, ``late`` if every live one was first listed after ``at``. A null key is no reference. The
    Bloom filter of all parent keys proves most missing parents without moving a row; only its positives are joined.
    """
    real = refs.where(F.col("key").isNotNull())
    # written once: the filter is probed once for the proven orphans, the hot keys and the exact join alike
    probed = materialize(bloom.build(parents, "key", expected_parents).probe(real, "key"), "probed")
    state = parents.groupBy("key").agg(
        F.max("live").alias("__live"), F.min(F.when(F.col("live"), F.col("first_listed"))).alias("__first")
    )
    missing = probed.where(~F.col("maybe")).drop("maybe").withColumn("reason", F.lit("missing"))
    verified = lookup(probed.where("maybe").drop("maybe"), state, "key")
    reason = (
        F.when(F.col("__live").isNull(), "missing").when(~F.col("__live"), "deleted").when(F.col("__first") > F.col("at"), "late")
    )
    judged = verified.withColumn("reason", reason).where(F.col("reason").isNotNull()).drop("__live", "__first")
    return missing.unionByName(judged)


def note_references(chunks: DataFrame) -> DataFrame:
    """References held by chunks: ref_field, chunk_id, ref, key, at. Empty and null references are none."""
    own = chunks.select("chunk_id", "note_path", "links", F.col("indexed_at").alias("at"))
    links = own.select("chunk_id", "at", F.explode("links").alias("ref")).select(
        F.lit("links").alias("ref_field"), "chunk_id", "ref", _space("links", link_key(F.col("ref"))).alias("key"), "at"
    )
    paths = own.select(F.lit("note_path").alias("ref_field"), "chunk_id", F.col("note_path").alias("ref"), _space("note_path", F.col("note_path")).alias("key"), "at")
    return links.unionByName(paths)


def file_parents(files: DataFrame) -> DataFrame:
    """What references can mean: every path under its link key and under the path itself."""
    both = F.array(_space("links", link_key(F.col("path"))), _space("note_path", F.col("path")))
    return file_states(files).select(F.explode(both).alias("key"), "live", "first_listed").where(F.col("key").isNotNull())


def orphans(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Orphan references of the chunks, each once: ref_field, chunk_id, ref, reason, period (``YYYY-MM`` of indexed_at).

    Repeated chunk rows give one row; a null ``indexed_at`` gives a null period and is never late. No chunks: no rows; no
    files: every reference is missing. Columns other than those named are ignored.
    """
    found = orphan_references(note_references(chunks), file_parents(files), expected_parents=2 * files.count())
    return found.select("ref_field", "chunk_id", "ref", "reason", F.date_format("at", "yyyy-MM").alias("period")).distinct()


def orphan_report(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Number of orphan references per field, period and reason."""
    return orphans(chunks, files).groupBy("ref_field", "period", "reason").agg(F.count("*").alias("orphans"), F.countDistinct("chunk_id").alias("chunks"))


def _space(field: str, key: Column) -> Column:
    """Keys of both kinds in one name space; an empty key is null."""
    return F.when(F.length(key) > 0, F.concat(F.lit(f"{field}:"), key))
