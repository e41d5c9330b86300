"""Queries of the inbox of proposed memories."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import memory
from marginalia.plans import sqlparts as S
from marginalia.session import table

BASE = "memory"


def _entries(spark, d):
    return table(spark, d, "pending_entries")


def e1_render_blocks(spark, d):
    return _entries(spark, d).select("entry_id", memory.pending_block(BASE).alias("block"))


def e2_split_inbox(spark, d):
    day = _entries(spark, d).withColumn("day", F.substring("timestamp_label", 1, 10))
    files = memory.inbox_text(day, "day", order="entry_id")
    return memory.split_inbox(files).select("day", "entry_index", F.length("raw").alias("chars"))


def e3_parse_blocks(spark, d):
    return memory.parse_inbox(_entries(spark, d), "entry_id").select(F.col("key").cast("long").alias("entry_id"), "timestamp_label", "source", "origin_tool", "status", F.array_join("tags", " ").alias("tags"))


def e3_round_trip(spark, d):
    """Blocks rendered and parsed again give the entry that was rendered."""
    own = _entries(spark, d).withColumn("raw", memory.pending_block(BASE))
    parsed = memory.parse_inbox(own, "entry_id", base_tag=BASE)
    return parsed.select(F.col("key").cast("long").alias("entry_id"), "entry_type", "content", F.size("tags").alias("tags"))


def e4_discard(spark, d):
    e = _entries(spark, d).withColumn("entry_index", F.col("entry_id"))
    return memory.without_first(e, e.agg(F.max_by("raw", "entry_id").alias("raw")).scalar()).select("entry_id")


def e5_propose(spark, d):
    e = _entries(spark, d)
    inbox = e.where(F.col("entry_index") % 5 == 0)
    return memory.proposals_to_keep(e.where(F.col("entry_index") % 5 != 0), inbox).select("entry_id")


def e6_coerced_types(spark, d):
    return _entries(spark, d).select("entry_id", memory.coerced_type(F.col("entry_type")).alias("entry_type"))


def e7_bounds(spark, d):
    return _entries(spark, d).where(memory.within_bounds()).select("entry_id")


def e8_applied_blocks(spark, d):
    return _entries(spark, d).select("entry_id", memory.applied_block(BASE, "Applied from review").alias("block"))


def e9_destinations(spark, d):
    return _entries(spark, d).select("entry_id", memory.destination().alias("path"))


def f14_content_keys(spark, d):
    return _entries(spark, d).select("entry_id", T.content_key(F.col("content")).alias("k"))


def f16_tag_lists(spark, d):
    return _entries(spark, d).select("entry_id", F.array_join(T.tag_list(F.coalesce("tags", F.array().cast("array<string>")), BASE), " ").alias("tags"))


def f17_one_line(spark, d):
    return _entries(spark, d).select("entry_id", T.one_line(F.col("content")).alias("line"))


def f21_project_folders(spark, d):
    return _entries(spark, d).select("entry_id", T.project_folder(F.col("project")).alias("folder"))


def k8_applied_files(spark, d):
    """The files after the decisions and tasks of the inbox were applied, and the inbox that is left: blocks and characters."""
    files, rest = memory.applied(_entries(spark, d), F.col("entry_type").isin("decision", "task"), BASE)
    both = files.select("path", "block").unionByName(rest.select(F.lit("Memory/Inbox/pending-memory.md").alias("path"), F.col("raw").alias("block")))
    return both.groupBy("path").agg(F.count("*").alias("blocks"), F.sum(F.length("block")).alias("chars"))


QUERIES = {f.__name__: f for f in (e1_render_blocks, e2_split_inbox, e3_parse_blocks, e3_round_trip, e4_discard, e5_propose, e6_coerced_types, e7_bounds, e8_applied_blocks, e9_destinations, f14_content_keys, f16_tag_lists, f17_one_line, f21_project_folders, k8_applied_files)}

_ONE = lambda x: S.strip(f"regexp_replace({x}, '{S.WS}*[\\r\\n]+{S.WS}*', ' ', 'g')")
_TAGS = f"list_concat(['{BASE}'], list_filter(list_transform(coalesce(tags, []), lambda t: regexp_replace({S.strip(f"regexp_replace({S.strip('t')}, '^#+', '')")}, '{S.WS}+', '-', 'g')), lambda t: t <> ''))"
_TAGLINE = f"(SELECT string_agg(t, ' ' ORDER BY i) FROM (SELECT t, min(i) AS i FROM (SELECT unnest({_TAGS}) AS t, generate_subscripts({_TAGS}, 1) AS i) GROUP BY t))"
_HASHTAGS = f"(SELECT string_agg('#' || t, ' ' ORDER BY i) FROM (SELECT t, min(i) AS i FROM (SELECT unnest({_TAGS}) AS t, generate_subscripts({_TAGS}, 1) AS i) GROUP BY t))"
_PATHS = f"CASE WHEN len(coalesce(related_paths, [])) > 0 THEN chr(10) || 'Related files:' || chr(10) || chr(10) || array_to_string(list_transform(related_paths, lambda p: '* ' || {_ONE('p')}), chr(10)) END"
_KEY = S.collapse(S.strip("content"))
FOLDER = S.strip(S.collapse(S.strip(f"regexp_replace(regexp_replace(regexp_replace({S.strip('project')}, '[\\\\/]+', '-', 'g'), '[<>:\"|?*]+', '', 'g'), '[.]+$', '')")))
_TITLE = "array_to_string(list_transform(string_split(replace(entry_type, '-', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
_APPLIED = f"concat_ws(chr(10), '## ' || {_TITLE} || ' — ' || timestamp_label || chr(10), {S.strip('content')}, {_PATHS}, chr(10) || '_Applied from review · ' || concat_ws(' · ', CASE WHEN coalesce(source, '') <> '' THEN 'source: ' || source END, 'tags: ' || {_HASHTAGS}) || '_' || chr(10))"
_DEST = f"""CASE WHEN coalesce({FOLDER}, '') NOT IN ('', '.', '..') THEN 'Memory/Projects/' || {FOLDER} || '/' || CASE entry_type WHEN 'architecture' THEN 'architecture' WHEN 'decision' THEN 'decisions' WHEN 'task' THEN 'tasks' WHEN 'action-item' THEN 'tasks' WHEN 'open-question' THEN 'open-questions' ELSE 'overview' END || '.md'
  ELSE 'Memory/Global/' || CASE WHEN entry_type = 'preference' THEN 'preferences' WHEN entry_type IN ('decision', 'architecture', 'action-item', 'task', 'open-question') THEN 'conventions' ELSE 'profile' END || '.md' END"""

SQL = {
    "e1_render_blocks": f"""SELECT entry_id, concat_ws(chr(10), '## Pending Memory: ' || {_ONE('timestamp_label')}, '', 'Type: ' || {_ONE('entry_type')}, CASE WHEN coalesce(project, '') <> '' THEN 'Project: ' || {_ONE('project')} END, 'Source: ' || {_ONE('source')},
        CASE WHEN coalesce(origin_tool, '') <> '' THEN 'Origin: ' || {_ONE('origin_tool')} END, CASE WHEN coalesce(confidence, '') <> '' THEN 'Confidence: ' || {_ONE('confidence')} END, 'Tags: ' || {_HASHTAGS}, chr(10) || 'Content:' || chr(10), {S.strip('content')}, {_PATHS}, chr(10) || 'Status: ' || {_ONE('status')}, chr(10) || '---' || chr(10)) AS block FROM pending_entries""",
    "e2_split_inbox": "SELECT timestamp_label[1:10] AS day, (row_number() OVER (PARTITION BY timestamp_label[1:10] ORDER BY entry_id) - 1)::INT AS entry_index, length(raw)::INT AS chars FROM pending_entries",
    "e3_parse_blocks": "SELECT entry_id, timestamp_label, source, origin_tool, status, array_to_string(coalesce(tags, []), ' ') AS tags FROM pending_entries",
    "e4_discard": "WITH r AS (SELECT max_by(raw, entry_id) AS raw FROM pending_entries) SELECT entry_id FROM pending_entries WHERE entry_id <> (SELECT min(entry_id) FROM pending_entries WHERE raw = (SELECT raw FROM r))",
    "e5_propose": f"""WITH e AS (SELECT *, lower({_KEY}) AS k, coalesce(entry_type, '') AS t, coalesce(project, '') AS p FROM pending_entries), o AS (SELECT *, row_number() OVER (PARTITION BY k, t, p ORDER BY proposed_at, entry_id) AS n FROM e WHERE entry_index % 5 <> 0)
        SELECT entry_id FROM o WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM e WHERE entry_index % 5 = 0 AND e.k = o.k AND e.t = o.t AND e.p = o.p)""",
    "e6_coerced_types": "SELECT entry_id, CASE WHEN entry_type IN ('note', 'decision', 'architecture', 'preference', 'task', 'action-item', 'open-question', 'session') THEN entry_type ELSE 'note' END AS entry_type FROM pending_entries",
    "e7_bounds": f"SELECT entry_id FROM pending_entries WHERE {S.strip("coalesce(content, '')")} <> '' AND length(content) <= 50000 AND len(coalesce(tags, [])) <= 64 AND len(list_filter(coalesce(tags, []), lambda t: length(t) > 128)) = 0 AND len(coalesce(related_paths, [])) <= 128 AND len(list_filter(coalesce(related_paths, []), lambda t: length(t) > 512)) = 0",
    "e8_applied_blocks": f"SELECT entry_id, {_APPLIED} AS block FROM pending_entries",
    "e9_destinations": f"SELECT entry_id, {_DEST} AS path FROM pending_entries",
    "f14_content_keys": f"SELECT entry_id, lower({_KEY}) AS k FROM pending_entries",
    "f16_tag_lists": f"SELECT entry_id, {_TAGLINE} AS tags FROM pending_entries",
    "f17_one_line": f"SELECT entry_id, {_ONE('content')} AS line FROM pending_entries",
    "f21_project_folders": f"SELECT entry_id, CASE WHEN coalesce({FOLDER}, '') NOT IN ('', '.', '..') THEN {FOLDER} END AS folder FROM pending_entries",
    "k8_applied_files": f"""SELECT path, count(*) AS blocks, sum(length(block))::BIGINT AS chars FROM (SELECT CASE WHEN entry_type IN ('decision', 'task') THEN {_DEST} ELSE 'Memory/Inbox/pending-memory.md' END AS path, CASE WHEN entry_type IN ('decision', 'task') THEN {_APPLIED} ELSE raw END AS block FROM pending_entries) GROUP BY path""",
    "e3_round_trip": f"SELECT entry_id, {_ONE('entry_type')} AS entry_type, {S.strip('content')} AS content, len(list_distinct({_TAGS}))::INT - 1 AS tags FROM pending_entries",
}
