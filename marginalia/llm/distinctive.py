"""How distinctive a term is of a record: positive pointwise mutual information with smoothed record probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Exponent of the smoothed record (context) probabilities.
ALPHA = 0.75
#: A term is a longest run of letters, so many or more.
LETTERS = "\\p{L}{5,}"


def terms(*parts: Column) -> Column:
    """All terms of the given texts in lower case, with repetitions; null parts have none."""
    joined = F.concat_ws("\n", *parts)
    return F.transform(F.regexp_extract_all(joined, F.lit(LETTERS), F.lit(0)), F.lower)


def term_records(records: DataFrame, key: str, *parts: Column) -> DataFrame:
    """One row a record: record, terms. Repeated keys count once (the largest text of them); null keys are left out."""
    one = records.select(F.col(key).alias("record"), F.concat_ws("\n", *parts).alias("t")).where(F.col("record").isNotNull())
    return one.groupBy("record").agg(F.max("t").alias("t")).select("record", terms(F.col("t")).alias("terms"))


def ppmi(records: DataFrame, key: str, *parts: Column, alpha: float = ALPHA) -> DataFrame:
    """Scores of every term of every record: record, term, n, records, ppmi.

    ``n`` is the joint count, ``records`` the number of records with the term, ``ppmi`` the positive part of
    ``log2(p(term, record) / (p(term) * p_alpha(record)))``, where record probabilities are counts raised to ``alpha``, so
    that short records are not favoured. Records without terms and empty tables give no rows; ties are just equal scores.
    The texts move once, by record; the joint counts are made where they lie, and what is shuffled further are map-side
    combined term totals. A filter on ``n`` or ``records`` put behind this reaches below the join.
    """
    bags = term_records(records, key, *parts)
    length = F.size("terms")
    joint = bags.select("record", length.alias("len"), F.explode("terms").alias("term")).groupBy("record", "term").agg(F.count("*").alias("n"), F.first("len").alias("len"))
    marginal = joint.groupBy("term").agg(F.sum("n").alias("term_n"), F.count("*").alias("records"))
    z = bags.where(length > 0).agg(F.sum(F.pow(length, F.lit(alpha))).alias("z")).scalar()
    # p(t,r) / (p(t) p_alpha(r)) = (n / N) / ((n_t / N) (n_r^a / Z)) = n Z / (n_t n_r^a); N cancels
    score = F.greatest(F.lit(0.0), F.log2(F.col("n") * z / (F.col("term_n") * F.pow(F.col("len"), F.lit(alpha)))))
    return joint.join(marginal, "term").select("record", "term", "n", "records", score.alias("ppmi"))


def distinctive_terms(chunks: DataFrame, least: int = 3, most_records: int = 6) -> DataFrame:
    """Terms that a chunk uses at least ``least`` times and that 2 to ``most_records`` chunks use at all, with their score.

    The counts alone decide which terms these are, the score decides nothing: one of 0 stays, as a chunk may use such a term
    much less than another of the few. A query that leaves the score out has it pruned from its plan."""
    scored = ppmi(chunks, "chunk_id", F.col("text"), F.array_join("aliases", "\n"))
    return scored.where((F.col("n") >= least) & F.col("records").between(2, most_records)).withColumnRenamed("record", "chunk_id")
