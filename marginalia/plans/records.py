"""Queries over whole tables of records: orphan references and incremental processing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import incremental, orphans
from marginalia.plans import sqlparts as S
from marginalia.session import scratch_dir, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans(table(spark, d, "chunks"), table(spark, d, "vault_files"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(table(spark, d, "chunks"), table(spark, d, "vault_files"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.unprocessed(*(table(spark, d, t) for t in ("vault_files", "chunks", "cache_entries", "vectors", "index_runs")))


def p7_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The chunk rows of all runs through a ledger: some runs arrive late, one attempt dies before its commit, each comes out once."""
    rows = table(spark, d, "chunks").select("chunk_id", "run_id")
    early = incremental.intervals_of(rows.where(F.col("run_id") % 5 != 2), "run_id")
    upto = incremental.intervals_of(rows, "run_id")
    steps = [(early, upto, False), (None, upto, True), (None, upto, False), (None, None, False)]
    out = incremental.replayed(rows, "run_id", f"{scratch_dir(spark)}/ledger-{uuid.uuid4().hex}", steps)
    return out.groupBy("run_id").agg(F.count("*").alias("chunk_rows"), F.countDistinct("chunk_id").alias("chunks"))


QUERIES = {"p2_found": p2_found, "p2_report": p2_report, "p7_found": p7_found, "p7_ledger": p7_ledger}
_REFS = f"""{S.FILE_STATES},
  parents AS (SELECT 'l:' || {S.link_key('path')} AS key, live, first_listed FROM states UNION ALL SELECT 'n:' || path, live, first_listed FROM states),
  keys AS (SELECT key, bool_or(live) AS live, min(CASE WHEN live THEN first_listed END) AS first_listed FROM parents GROUP BY key),
  refs AS (SELECT DISTINCT 'links' AS ref_field, chunk_id, ref, indexed_at, {S.link_key('ref')} AS k FROM (SELECT chunk_id, unnest(links) AS ref, indexed_at FROM chunks)
    UNION SELECT 'note_path', chunk_id, note_path, indexed_at, note_path FROM chunks),
  judged AS (SELECT r.*, CASE WHEN p.key IS NULL THEN 'missing' WHEN NOT p.live THEN 'deleted' WHEN p.first_listed > r.indexed_at THEN 'late' END AS reason FROM refs r LEFT JOIN keys p ON p.key = CASE r.ref_field WHEN 'links' THEN 'l:' ELSE 'n:' END || r.k WHERE r.k <> ''),
  found AS (SELECT DISTINCT ref_field, chunk_id, ref, reason, strftime(indexed_at, '%Y-%m') AS period FROM judged WHERE reason IS NOT NULL)"""

SQL = {
    "p2_found": f"WITH {_REFS} SELECT ref_field, chunk_id, ref, reason, period FROM found",
    "p2_report": f"WITH {_REFS} SELECT ref_field, period, reason, count(*) AS orphans, count(DISTINCT chunk_id) AS chunks FROM found GROUP BY ALL",
    "p7_ledger": "SELECT run_id, count(*) AS chunk_rows, count(DISTINCT chunk_id) AS chunks FROM chunks WHERE run_id IS NOT NULL GROUP BY run_id",
    "p7_found": f"""WITH {S.FILE_STATES}, ok AS (SELECT run_id FROM index_runs WHERE status = 'succeeded'), live AS (SELECT path, mtime FROM states WHERE live)
        SELECT 'note' AS kind, path AS record_key FROM live l WHERE path LIKE '%.md' AND NOT EXISTS (SELECT 1 FROM chunks c JOIN ok USING (run_id) WHERE c.note_path = l.path AND c.mtime = l.mtime)
        UNION ALL SELECT 'attachment', path FROM live l WHERE path NOT LIKE '%.md' AND NOT EXISTS (SELECT 1 FROM cache_entries c JOIN ok USING (run_id) WHERE c.path = l.path AND c.mtime = l.mtime)
        UNION ALL SELECT 'chunk', chunk_id FROM (SELECT chunk_id, md5(max_by(text, (run_id, indexed_at)))[1:16] AS h FROM chunks GROUP BY chunk_id) t WHERE NOT EXISTS (SELECT 1 FROM vectors v JOIN ok USING (run_id) WHERE v.chunk_id = t.chunk_id AND v.h = t.h)""",
}
