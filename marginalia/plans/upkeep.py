"""Queries of index maintenance: scans, refresh, caches, attachment budgets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import chunker, filters, refresh
from marginalia.operators.lexical import distinct_chunks
from marginalia.operators.orphans import file_states
from marginalia.operators.vector import current_vectors
from marginalia.plans import sqlparts as S
from marginalia.session import materialize, scratch_dir, table
from marginalia.sources import vault


def _live(spark, d):
    return file_states(table(spark, d, "vault_files")).where("live")


def _indexed(spark, d):
    return table(spark, d, "chunks").select("note_path", "mtime").distinct()


def _changes(spark, d):
    listing = _live(spark, d).where(F.lower("path").endswith(".md")).select(F.col("path").alias("note_path"), "mtime")
    return refresh.changes(listing, _indexed(spark, d))


def a1_markdown_files(spark, d):
    return _live(spark, d).where(F.lower("path").endswith(".md")).select("path", "mtime")


def a2_files_by_extension(spark, d):
    return _live(spark, d).where(F.lower(F.regexp_extract("path", "\\.([^./]+)$", 1)).isin("pdf", "docx", "canvas")).select("path", "mtime")


def a7_unread_stubs(spark, d):
    return _live(spark, d).select(F.col("path").alias("note_path"), "mtime").join(_indexed(spark, d), ["note_path", "mtime"], "left_semi")


def a9_clipped_text(spark, d):
    return table(spark, d, "cache_entries").select("path", "run_id", vault.clip_text("extracted_text", 2000).alias("text")).distinct()


def _extracted(spark, d):
    c = table(spark, d, "cache_entries").groupBy("path").agg(F.max(F.struct("run_id", "mtime", "extracted_text")).alias("s"))
    return c.select("path", "s.mtime", F.col("s.extracted_text").alias("text"), F.substring_index("path", "/", 2).alias("folder"))


def a10_corpus_budget(spark, d):
    return vault.attachments(_extracted(spark, d), budget=1 << 17).select("note_path", "title")


def x17_titles(spark, d):
    return table(spark, d, "vault_files").select("path").distinct().select("path", T.attachment_title(F.col("path")).alias("title"))


def x16_normal_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normal_text(F.col("text")).alias("text"))


def j6_changes(spark, d):
    return _changes(spark, d)


def g9_change_counts(spark, d):
    return _changes(spark, d).groupBy("change").agg(F.count("*").alias("notes"))


def j7_removed_notes(spark, d):
    return _indexed(spark, d).select("note_path").join(_live(spark, d).select(F.col("path").alias("note_path")), "note_path", "left_anti").distinct()


def _note_states(spark, d):
    """(notes, older): the documents as notes, and an older state of them: some not there yet, some older, some since removed."""
    n = table(spark, d, "documents").select("doc_id", F.concat("note_path", F.lit("#"), "doc_id").alias("note_path"), F.unix_millis(F.col("modified_at").cast("timestamp")).alias("mtime"), F.col("text").alias("content"))
    older = n.where("doc_id % 3 <> 0").withColumn("mtime", F.when(F.col("doc_id") % 7 == 0, F.col("mtime") - 1).otherwise(F.col("mtime")))
    older = older.withColumn("content", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("# Older\n\n"), "content")).otherwise(F.col("content")))
    return n.where("doc_id % 11 <> 0").drop("doc_id"), older.drop("doc_id")


def i7_refreshed_chunks(spark, d):
    """An index of the older state refreshed to the notes as they are: every note's change, and whether its chunks are those of a full build."""
    notes, older = _note_states(spark, d)
    refreshed, change = refresh.refresh(notes, materialize(chunker.chunk_notes(older), "older-index"))

    def prints(c, name):
        return c.groupBy("note_path").agg(F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("chunk_id", "text", "start_line", "end_line", "mtime")).alias("x")).alias(name))

    both = change.join(prints(refreshed, "a"), "note_path", "left").join(prints(chunker.chunk_notes(notes), "b"), "note_path", "left")
    return both.select("note_path", "change", F.col("a").eqNullSafe(F.col("b")).alias("same"))


def i8_first_refresh(spark, d):
    """What a refresh reports: the first, without an index, and the next."""
    notes, older = _note_states(spark, d)
    chunks = distinct_chunks(table(spark, d, "chunks"))
    first = refresh.counts(_changes(spark, d), chunks, False).withColumn("refresh", F.lit("first"))
    return first.unionByName(refresh.counts(refresh.changes(notes, older), chunks, True).withColumn("refresh", F.lit("next")))


def a6_scanned_notes(spark, d):
    """The documents written as files and scanned: folders left out, known notes come as stubs without content. Spark lists no
    empty files, so a document without text is no note here."""
    root = f"{scratch_dir(spark)}/vault-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.when(F.col("doc_id") % 5 == 0, "Archive/").otherwise("Notes/"), F.lit("n"), "doc_id", F.lit(".md")).alias("path"), F.col("text").alias("content"))
    vault.write_files(docs, root)
    known = vault.list_notes(spark, root).withColumnRenamed("path", "note_path").where(F.col("note_path").endswith("7.md"))
    got = vault.scan_notes(spark, root, exclude=["Archive"], known=known)
    return got.select("note_path", "unchanged", F.length("content").alias("chars"))


def a8_scanned_attachments(spark, d):
    """Attachments read through the extraction cache: hits keep their text, misses are looked at and yield nothing here."""
    cache = refresh.ExtractionCache(spark, f"{scratch_dir(spark)}/cache-{uuid.uuid4().hex}")
    stored = table(spark, d, "cache_entries").groupBy("path", "mtime").agg(F.max_by(F.struct("extracted_text"), F.struct("run_id", F.coalesce("extracted_text", F.lit("")))).alias("s"))
    cache.remember(stored.select("path", "mtime", F.col("s.extracted_text").alias("text")))
    cache.persist()
    files = table(spark, d, "vault_files").where("path is not null").groupBy("path").agg(F.max(F.struct("listed_at", F.col("removed_at").isNull().alias("live"), "mtime", "size_bytes")).alias("s"))
    live = files.where("s.live").select("path", "s.mtime", "s.size_bytes").where(~F.lower("path").endswith(".md"))
    notes, looked = vault.scan_attachments(live, cache, lambda f: f.select("path", "mtime", F.lit(None).cast("string").alias("text")))
    return looked.join(notes.select(F.col("note_path").alias("path"), F.lit(True).alias("__note")), "path", "left").select("path", "hit", F.coalesce("__note", F.lit(False)).alias("note"))


def b11_foreign_paths(spark, d):
    """Paths whose changes matter: not the engine's own files."""
    return table(spark, d, "vault_files").select("path").distinct().where(~filters.own_artifact(F.col("path"), "Memory"))


def j8_embedding_plan(spark, d):
    c = distinct_chunks(table(spark, d, "chunks")).select("chunk_id", F.substring(F.md5("text"), 1, 16).alias("h"))
    return refresh.embedding_plan(c, current_vectors(table(spark, d, "vectors")))


def i9_embedding_counts(spark, d):
    return j8_embedding_plan(spark, d).groupBy("action").agg(F.count("*").alias("chunks"))


def j12_cache_hits(spark, d):
    files = _live(spark, d).where(~F.lower("path").endswith(".md")).select("path", "mtime")
    return refresh.cache_lookup(files, table(spark, d, "cache_entries"))


def x18_pruned_cache(spark, d):
    return refresh.pruned_cache(table(spark, d, "cache_entries").select("path", "mtime", "run_id").distinct(), _live(spark, d))


def u1_all_notes(spark, d):
    notes = _live(spark, d).where(F.lower("path").endswith(".md")).select(F.col("path").alias("note_path"), "mtime", F.lit(None).cast("string").alias("content"))
    return vault.all_notes(notes, vault.attachments(_extracted(spark, d))).select("note_path", "mtime", "kind")


QUERIES = {f.__name__: f for f in (a1_markdown_files, a2_files_by_extension, a7_unread_stubs, a9_clipped_text, a10_corpus_budget, x17_titles, x16_normal_text, j6_changes, g9_change_counts, j7_removed_notes, i7_refreshed_chunks, i8_first_refresh, a6_scanned_notes, a8_scanned_attachments, b11_foreign_paths, j8_embedding_plan, i9_embedding_counts, j12_cache_hits, x18_pruned_cache, u1_all_notes)}

_ST = f"WITH {S.FILE_STATES}, live AS (SELECT * FROM states WHERE live)"
_CH = f"""{_ST}, new AS (SELECT path AS note_path, mtime AS new FROM live WHERE lower(path) LIKE '%.md'), old AS (SELECT note_path, max(mtime) AS old FROM chunks GROUP BY 1),
  changes AS (SELECT coalesce(new.note_path, old.note_path) AS note_path, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' WHEN new <> old THEN 'updated' ELSE 'unchanged' END AS change FROM new FULL JOIN old ON new.note_path = old.note_path)"""
_EX = "ex AS (SELECT path, max_by(mtime, run_id) AS mtime, max_by(CASE WHEN extracted_text IS NULL THEN {'t': NULL} ELSE {'t': extracted_text} END, run_id).t AS text, array_to_string(string_split(path, '/')[1:2], '/') AS folder FROM cache_entries GROUP BY path)"
_WSI = r"[\t\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_PLAN = f"WITH {S.DISTINCT_CHUNKS}, {S.CURRENT_VECTORS}, plan AS (SELECT coalesce(c.chunk_id, v.chunk_id) AS chunk_id, CASE WHEN c.chunk_id IS NULL THEN 'remove' WHEN md5(c.text)[1:16] = v.h THEN 'reuse' ELSE 'embed' END AS action FROM dchunks c FULL JOIN cvectors v ON c.chunk_id = v.chunk_id)"

#: A note without text has no chunks, so an index does not know it.
_HELD = f"doc_id % 3 <> 0 AND text IS NOT NULL AND (doc_id % 7 = 0 OR {S.strip('text')} <> '')"
_STATES_DIFF = """SELECT coalesce(n.p, o.p) AS note_path, CASE WHEN o.p IS NULL THEN 'added' WHEN n.p IS NULL THEN 'removed' WHEN n.m <> o.m THEN 'updated' ELSE 'unchanged' END AS change
  FROM (SELECT note_path || '#' || doc_id AS p, 0 AS m, text FROM documents WHERE doc_id % 11 <> 0) n FULL JOIN (SELECT note_path || '#' || doc_id AS p, CASE WHEN doc_id % 7 = 0 THEN -1 ELSE 0 END AS m, text FROM documents WHERE doc_id % 3 <> 0) o ON n.p = o.p"""

SQL = {
    "a1_markdown_files": f"{_ST} SELECT path, mtime FROM live WHERE lower(path) LIKE '%.md'",
    "a2_files_by_extension": f"{_ST} SELECT path, mtime FROM live WHERE regexp_matches(lower(path), '[.](pdf|docx|canvas)$')",
    "a7_unread_stubs": f"{_ST} SELECT path AS note_path, mtime FROM live l WHERE EXISTS (SELECT 1 FROM chunks c WHERE c.note_path = l.path AND c.mtime = l.mtime)",
    "a9_clipped_text": "SELECT DISTINCT path, run_id, CASE WHEN length(extracted_text) > 2000 THEN extracted_text[1:2000] || chr(10) || chr(10) || '[text cut]' ELSE extracted_text END AS text FROM cache_entries",
    "a10_corpus_budget": f"WITH {_EX}, b AS (SELECT *, coalesce(sum(length(text)) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ex WHERE text IS NOT NULL) SELECT path AS note_path, regexp_replace(string_split(path, '/')[-1], '(?i)[.][a-z0-9]+$', '') AS title FROM b WHERE before < 131072",
    "x17_titles": "SELECT DISTINCT path, regexp_replace(string_split(path, '/')[-1], '(?i)[.][a-z0-9]+$', '') AS title FROM vault_files",
    "x16_normal_text": f"SELECT doc_id, regexp_replace(regexp_replace(text, '(?m){_WSI}+$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS text FROM documents",
    "j6_changes": f"{_CH} SELECT note_path, change FROM changes",
    "g9_change_counts": f"{_CH} SELECT change, count(*) AS notes FROM changes GROUP BY change",
    "j7_removed_notes": f"{_ST} SELECT DISTINCT note_path FROM chunks WHERE note_path NOT IN (SELECT path FROM live)",
    "i7_refreshed_chunks": f"SELECT note_path, change, true AS same FROM ({_STATES_DIFF.replace('doc_id % 3 <> 0', _HELD)})",
    "i8_first_refresh": f"WITH {S.DISTINCT_CHUNKS} SELECT count(*) AS added, 0 AS updated, 0 AS removed, 'first' AS refresh FROM dchunks UNION ALL SELECT count(*) FILTER (change = 'added'), count(*) FILTER (change = 'updated'), count(*) FILTER (change = 'removed'), 'next' FROM ({_STATES_DIFF})",
    "a6_scanned_notes": "SELECT 'Notes/n' || doc_id || '.md' AS note_path, doc_id % 10 = 7 AS unchanged, CASE WHEN doc_id % 10 <> 7 THEN coalesce(length(text), 0) END AS chars FROM documents WHERE doc_id % 5 <> 0 AND length(text) > 0",
    "a8_scanned_attachments": """WITH f AS (SELECT path, arg_max({'l': removed_at IS NULL, 'm': mtime}, (listed_at, removed_at IS NULL, mtime)) AS s FROM vault_files GROUP BY path), live AS (SELECT path, s.m AS mtime FROM f WHERE s.l AND lower(path) NOT LIKE '%.md'),
        c AS (SELECT path, mtime, max_by(CASE WHEN extracted_text IS NULL THEN {'t': NULL} ELSE {'t': extracted_text} END, (run_id, coalesce(extracted_text, ''))).t AS text FROM cache_entries GROUP BY path, mtime),
        k AS (SELECT l.path, c.path IS NOT NULL AS hit, c.text FROM live l LEFT JOIN c USING (path, mtime)), b AS (SELECT path, coalesce(sum(length(text)) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k WHERE text IS NOT NULL)
        SELECT path, hit, path IN (SELECT path FROM b WHERE before < 33554432) AS note FROM k""",
    "b11_foreign_paths": "SELECT DISTINCT path FROM vault_files WHERE NOT regexp_matches(path, '^Memory/(Index|Config)(/|$)')",
    "j8_embedding_plan": f"{_PLAN} SELECT chunk_id, action FROM plan",
    "i9_embedding_counts": f"{_PLAN} SELECT action, count(*) AS chunks FROM plan GROUP BY action",
    "j12_cache_hits": f"{_ST} SELECT path, EXISTS (SELECT 1 FROM cache_entries c WHERE c.path = l.path AND c.mtime = l.mtime) AS hit FROM live l WHERE lower(path) NOT LIKE '%.md'",
    "x18_pruned_cache": f"{_ST} SELECT DISTINCT path, mtime, run_id FROM cache_entries WHERE path IN (SELECT path FROM live)",
    "u1_all_notes": f"{_ST}, {_EX}, b AS (SELECT *, coalesce(sum(length(text)) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ex WHERE text IS NOT NULL) SELECT path AS note_path, mtime, 0 AS kind FROM live WHERE lower(path) LIKE '%.md' UNION ALL SELECT path, mtime, 1 FROM b WHERE before < 33554432",
}
