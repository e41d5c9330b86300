"""Queries over notes: chunks and metadata, links, summaries, reading, budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import budget, chunker, context, embed, links, measure, ordered, summarize
from marginalia.operators.lexical import distinct_chunks, field_terms
from marginalia.plans import sqlparts as S
from marginalia.plans.memory import FOLDER
from marginalia.session import table

_EMPTY = "array<string>"


def _notes(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat("note_path", F.lit("#"), "doc_id").alias("note_path"), F.col("text").alias("content"), F.unix_millis(F.col("modified_at").cast("timestamp")).alias("mtime"))


def _chunks(spark, d):
    return distinct_chunks(table(spark, d, "chunks"))


def i1_chunk_notes(spark, d):
    c = chunker.chunk_notes(_notes(spark, d))
    return c.select("chunk_id", "ordinal", "heading", F.array_join("heading_path", " › ").alias("crumbs"), "text", "start_line", "end_line")


def i6_build_counts(spark, d):
    c = chunker.chunk_notes(_notes(spark, d))
    return c.agg(F.count("*").alias("chunks"), F.countDistinct("note_path").alias("notes"), F.max(F.length("text")).alias("longest"))


def i2_sections(spark, d):
    s = chunker.note_sections(_notes(spark, d))
    return s.select("note_path", "ordinal", "heading", F.array_join("heading_path", " › ").alias("crumbs"), "first_line", "last_line", F.length("body").alias("chars"))


def i1_whole_sections(spark, d):
    """Chunks that hold a whole section: their text in full."""
    c = chunker.chunk_notes(_notes(spark, d))
    one = c.groupBy("note_path", "heading", "heading_path", "start_line").agg(F.count("*").alias("n"), F.max("text").alias("text"), F.max("end_line").alias("end_line"))
    s = chunker.note_sections(_notes(spark, d)).select("note_path", "heading", "heading_path", F.col("first_line").alias("start_line"), F.col("last_line").alias("end_line"))
    return s.join(one.where("n = 1"), ["note_path", "heading", "heading_path", "start_line", "end_line"]).select("note_path", "start_line", "end_line", "text").where(F.length("text") <= chunker.MAX_CHARS)


def f7_metadata(spark, d):
    m = chunker.note_metadata(_notes(spark, d))
    return m.select("note_path", F.array_join("tags", " ").alias("tags"), F.array_join("aliases", " ").alias("aliases"), F.array_join("links", " ").alias("links"), "title", "body_line")


def f8_inline_tags(spark, d):
    return _chunks(spark, d).select("chunk_id", F.array_join(T.inline_tags(F.col("text")), " ").alias("tags"))


def f9_link_targets(spark, d):
    return chunker.targets(_chunks(spark, d), "chunk_id", "text").select("chunk_id", F.array_join("wiki", "\n").alias("targets"))


def f12_titles(spark, d):
    return chunker.note_metadata(_notes(spark, d)).select("note_path", "title")


def f15_fnv_hashes(spark, d):
    return table(spark, d, "vault_files").select("path").distinct().select("path", T.fnv1a(F.col("path")).alias("h"))


def f18_breadcrumbs(spark, d):
    return _chunks(spark, d).select("chunk_id", T.breadcrumb(F.col("heading_path"), F.col("heading")).alias("crumbs"))


def f19_line_ranges(spark, d):
    return _chunks(spark, d).select("chunk_id", T.line_range(F.col("start_line"), F.col("end_line")).alias("lines"))


def f20_clipped(spark, d):
    return _chunks(spark, d).select("chunk_id", T.clipped(F.col("text"), 300).alias("text"))


def d1_day_labels(spark, d):
    return table(spark, d, "vault_files").select("path", "mtime").distinct().select("path", "mtime", T.day_label(F.col("mtime")).alias("day"))


def q6_related_notes(spark, d):
    c = table(spark, d, "chunks")
    return links.related(c, c.select("note_path").distinct())


def j9_link_edges(spark, d):
    return links.edges(table(spark, d, "chunks"))


def g8_paths_per_key(spark, d):
    return links.note_keys(table(spark, d, "chunks")).groupBy("key").agg(F.count("*").alias("paths"))


def g11_note_mtimes(spark, d):
    ordinal = F.split("chunk_id", "::")[1].cast("int")
    return _chunks(spark, d).groupBy("note_path").agg(F.min_by("mtime", ordinal).alias("mtime"), F.count("*").alias("chunks"))


def w3_ordinals(spark, d):
    slim = _chunks(spark, d).select("note_path", "start_line", "end_line", "chunk_id")
    return ordered.running(slim, ["note_path"], ["start_line", "end_line", "chunk_id"]).select("chunk_id", (F.col("n") - 1).cast("int").alias("pos"))


def w6_budgeted_blocks(spark, d):
    out = budget.assembled(_chunks(spark, d).select("note_path", "chunk_id", "start_line", "text"), "text", ["note_path"], ["start_line", "chunk_id"], 1500)
    return out.select("chunk_id", F.col("kept"), F.length("shown").alias("shown"))


def w7_listed_links(spark, d):
    e = links.edges(table(spark, d, "chunks")).select(F.col("dst").alias("note_path"), F.col("src").alias("title"))
    return budget.listed(e, "title", ["note_path"], 200).groupBy("note_path").agg(F.sum(F.col("shown").cast("int")).alias("shown"), F.sum((~F.col("shown")).cast("int")).alias("more"))


def b9_line_range(spark, d):
    return _chunks(spark, d).where(context.in_range(10, 30)).select("chunk_id")


def q8_outline(spark, d):
    return context.outline(_chunks(spark, d))


def q8_passages(spark, d):
    return context.passage(_chunks(spark, d), most=2000)


def q9_project_context(spark, d):
    """The contexts of every project and of Memory/Global: the named files of each, in their order, within a budget."""
    here, everywhere = context.named_files("Projects", names=context.PROJECT_FILES), context.named_files(folder="Memory/Global", names=context.GLOBAL_FILES)
    notes = context.note_contents(_chunks(spark, d), here | everywhere, 2500)
    shared = context.assembled_context(notes, context.GLOBAL_FILES, "Memory/Global", 2500).withColumn("folder", F.lit("Memory/Global"))
    both = context.project_contexts(notes, "Projects", 2500).unionByName(shared)
    return both.select("folder", "ord", "note_path", "kept", F.length("shown").alias("chars"))


def q10_recent_sessions(spark, d):
    return context.recent(_chunks(spark, d).select("note_path").distinct(), "Meetings")


def g12_projects(spark, d):
    return context.projects(table(spark, d, "vault_files"), "Projects")


def g10_index_stats(spark, d):
    """Size and age of the index, and the attachments whose latest extraction gave no text."""
    built = _chunks(spark, d).agg(F.countDistinct("note_path").alias("notes"), F.count("*").alias("chunks"), F.max("mtime").alias("latest"), F.unix_micros(F.max("indexed_at").cast("timestamp")).alias("built_us"))
    cache = table(spark, d, "cache_entries").groupBy("path").agg(F.max_by(F.col("extracted_text").isNull(), F.struct("run_id", "mtime", F.col("extracted_text").isNull())).alias("none"))
    return built.withColumn("skipped", cache.agg(F.count(F.when(F.col("none"), 1)).alias("n")).scalar())


def j16_project_notes(spark, d):
    """How many notes lie in the folders of the projects that proposals name."""
    named = table(spark, d, "pending_entries").select(T.project_folder(F.col("project")).alias("folder")).where("folder is not null").distinct()
    notes = table(spark, d, "chunks").select("note_path").distinct().where(F.col("note_path").startswith("Projects/"))
    inside = notes.select("note_path", F.split("note_path", "/")[1].alias("folder"))
    return named.join(inside, "folder", "left").groupBy("folder").agg(F.count("note_path").alias("notes"))


def q7_summaries(spark, d):
    notes = table(spark, d, "eval_items").select(F.col("item_id").cast("string").alias("note_path"), "text")
    return summarize.best(summarize.centrality(summarize.units(notes)), 3).select("note_path", "pos", "sentence", F.round("score", 6).alias("score"))


def q7_note_summaries(spark, d):
    c = _chunks(spark, d).select("note_path", "start_line", "chunk_id", "text")
    return summarize.best(summarize.centrality(summarize.units(c, order=["start_line", "chunk_id"]))).select("note_path", "pos", "sentence")


def t6_diverse_vectors(spark, d):
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 100).cast("string").alias("note_path"), (F.col("vec_id") % 100).cast("int").alias("pos"), F.col("embedding").cast("array<double>").alias("v"))
    return summarize.best_diverse(e)


def u2_term_sources(spark, d):
    """How many distinct terms file name, aliases and ancestor headings of a chunk give together."""
    n = F.size(field_terms(F.col("note_path"), F.col("aliases"), F.col("heading_path")))
    return _chunks(spark, d).select("chunk_id", n.alias("n"))


def m2_hashed_words(spark, d):
    v = embed.hashed_words(table(spark, d, "documents"), "doc_id", "text")
    return v.select("doc_id", F.posexplode("v").alias("i", "x")).where("x <> 0").select("doc_id", "i", F.round("x", 6).alias("x"))


def f10_markdown_links(spark, d):
    return chunker.targets(_chunks(spark, d), "chunk_id", "text").select("chunk_id", F.array_join("markdown", "\n").alias("targets"))


def d2_minute_labels(spark, d):
    return table(spark, d, "pending_entries").select("entry_id", F.date_format("proposed_at", "yyyy-MM-dd HH:mm").alias("label"), F.date_format("proposed_at", "yyyy-MM-dd-HHmm").alias("stamp"))


def g17_distinct_sentences(spark, d):
    notes = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("note_path"), "text")
    return summarize.units(notes).groupBy("note_path").agg(F.count("*").alias("units"), F.sum(F.length("sentence")).alias("chars"))


def g18_percentiles(spark, d):
    out = measure.percentiles(table(spark, d, "documents"), "lang", "n_chars")
    return out.select("lang", "p50", "p95", F.round("mean", 6).alias("mean"))


def u4_removed_vectors(spark, d):
    return table(spark, d, "vectors").select("chunk_id").distinct().join(table(spark, d, "chunks").select("chunk_id").distinct(), "chunk_id", "left_anti")


QUERIES = {
    f.__name__: f
    for f in (
        m2_hashed_words, f10_markdown_links, d2_minute_labels, g17_distinct_sentences, g18_percentiles, u4_removed_vectors, i2_sections, i1_whole_sections, i1_chunk_notes, i6_build_counts, f7_metadata, f8_inline_tags, f9_link_targets, f12_titles, f15_fnv_hashes, f18_breadcrumbs, f19_line_ranges, f20_clipped, d1_day_labels, q6_related_notes, j9_link_edges, g8_paths_per_key,
        g11_note_mtimes, w3_ordinals, w6_budgeted_blocks, w7_listed_links, b9_line_range, q8_outline, q8_passages, q9_project_context, q10_recent_sessions, g12_projects, g10_index_stats, j16_project_notes, q7_summaries, q7_note_summaries, t6_diverse_vectors, u2_term_sources,
    )
}

_DC = f"WITH {S.DISTINCT_CHUNKS}"
_CRUMBS = f"list_filter(list_concat(coalesce(heading_path, []), [coalesce(heading, '')]), lambda x: {S.strip('x')} <> '')"
_EDGES = f"""outl AS (SELECT DISTINCT note_path AS src, {S.link_key('l')} AS key FROM (SELECT DISTINCT note_path, unnest(links) AS l FROM chunks)), nk AS (SELECT note_path AS dst, {S.link_key('note_path')} AS key FROM (SELECT DISTINCT note_path FROM chunks)),
  edges AS (SELECT DISTINCT src, dst FROM outl JOIN nk USING (key) WHERE key <> '' AND src <> dst)"""
_UNITS = "l AS (SELECT item_id::VARCHAR AS note_path, list_transform(regexp_split_to_array(text, '\\r?\\n+'), lambda x: trim(regexp_replace(trim(x), '^(?:#{1,6}\\s+|[-*+]\\s+|>\\s*|[0-9]+[.)]\\s+)', ''))) AS lines FROM eval_items)"

_MARKS = f"regexp_replace({S.strip('x')}, '^(?:#{{1,6}}{S.WS}+|[-*+]{S.WS}+|>{S.WS}*|[0-9]+[.)]{S.WS}+)', '')"
_GROUPS = f"""b AS (SELECT *, CASE WHEN coalesce(heading, '') <> '' THEN regexp_replace(text, '^#{{1,6}} [^\\n]*\\n\\n?', '') ELSE text END AS body FROM dchunks),
  p AS (SELECT *, lag(text) OVER o AS prev, lag({{'h': heading, 'p': heading_path}}) OVER o AS ph, row_number() OVER o AS rn FROM b WINDOW o AS (PARTITION BY note_path ORDER BY start_line, end_line, chunk_id)),
  c AS (SELECT *, CASE WHEN rn > 1 AND ph IS NOT DISTINCT FROM {{'h': heading, 'p': heading_path}} AND heading IS NOT NULL AND heading_path IS NOT NULL THEN coalesce(list_max(list_filter(range(12, 201), lambda n: length(body) >= n AND ends_with(prev, body[1:n]))), 0) ELSE 0 END AS carry FROM p),
  g AS (SELECT *, sum((carry = 0)::INT) OVER (PARTITION BY note_path ORDER BY start_line, end_line, chunk_id ROWS UNBOUNDED PRECEDING)::BIGINT AS group_no, CASE WHEN carry > 0 THEN {S.strip('body[carry + 1:]')} ELSE text END AS own, CASE WHEN len({_CRUMBS}) = 0 THEN '(top)' ELSE array_to_string({_CRUMBS}, ' › ') END AS label FROM c)"""


def _sentences(source: str) -> str:
    """CTEs up to ``u`` (note_path, pos, sentence) of the distinct sentences, the first 200 of each note, of a query of note_path, o1, o2, text."""
    split = "CASE WHEN len(regexp_extract_all(x, '[^.!?]+(?:[.!?]+|$)')) > 0 THEN regexp_extract_all(x, '[^.!?]+(?:[.!?]+|$)') ELSE [x] END"
    return f"""src AS ({source}), ls AS (SELECT note_path, o1, o2, list_transform(regexp_split_to_array(text, '\\r?\\n+'), lambda x: {S.strip(_MARKS)}) AS lines FROM src),
  ss AS (SELECT note_path, o1, o2, list_filter(list_transform(flatten(list_transform(lines, lambda x: {split})), lambda y: {S.strip('y')}), lambda z: length(z) >= 2) AS s FROM ls),
  es AS (SELECT note_path, o1, o2, unnest(s) AS sentence, generate_subscripts(s, 1) AS i FROM ss), fs AS (SELECT * FROM es QUALIFY row_number() OVER (PARTITION BY note_path, lower(sentence) ORDER BY o1, o2, i) = 1),
  us AS (SELECT note_path, sentence, row_number() OVER (PARTITION BY note_path ORDER BY o1, o2, i) AS n FROM fs), u AS (SELECT note_path, n - 1 AS pos, sentence FROM us WHERE n <= 200)"""


SQL = {
    "m2_hashed_words": f"""WITH t AS (SELECT doc_id, unnest({S.raw_tokens('text')}) AS w FROM documents), h AS (SELECT doc_id, list_reduce(list_transform(string_split(w, ''), lambda c: unicode(c)::HUGEINT), lambda h, c: (xor(h::BIGINT, c::BIGINT)::HUGEINT * 16777619) % 4294967296, 2166136261::HUGEINT)::BIGINT AS h FROM t),
        s AS (SELECT doc_id, (h % 64)::INT AS i, sum(CASE WHEN h % 2 = 1 THEN 1.0 ELSE -1.0 END)::DOUBLE AS s FROM h GROUP BY ALL), n AS (SELECT *, sqrt(sum(s * s) OVER (PARTITION BY doc_id)) AS n FROM s) SELECT doc_id, i, round(s / n, 6) AS x FROM n WHERE s <> 0""",
    "f10_markdown_links": f"{_DC} SELECT chunk_id, array_to_string(list_filter(regexp_extract_all(text, '\\[[^\\]]*\\]\\(([^)]+)\\)', 1), lambda t: NOT regexp_matches(t, '(?i)^([a-z][a-z0-9+.-]*://|mailto:)')), chr(10)) AS targets FROM dchunks",
    "d2_minute_labels": "SELECT entry_id, strftime(proposed_at, '%Y-%m-%d %H:%M') AS label, strftime(proposed_at, '%Y-%m-%d-%H%M') AS stamp FROM pending_entries",
    "u4_removed_vectors": "SELECT DISTINCT chunk_id FROM vectors WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks)",
    "f8_inline_tags": f"{_DC} SELECT chunk_id, array_to_string(list_filter(regexp_extract_all(text, '(^|{S.WS}|\\()#([A-Za-z0-9_][A-Za-z0-9_/-]*)', 2), lambda t: NOT regexp_full_match(t, '[0-9]+')), ' ') AS tags FROM dchunks",
    "f9_link_targets": f"{_DC} SELECT chunk_id, array_to_string(regexp_extract_all(text, '\\[\\[([^\\]|#]+)(?:[#|][^\\]]*)?\\]\\]', 1), chr(10)) AS targets FROM dchunks",
    "f12_titles": f"""WITH t AS (SELECT note_path || '#' || doc_id AS note_path, replace(text, chr(13) || chr(10), chr(10)) AS t FROM documents WHERE text IS NOT NULL),
        f AS (SELECT note_path, t, regexp_extract(t, '^---[ \\t]*\\n((?:.*\\n)*?)---[ \\t]*(?:\\n|$)', 1) AS front, regexp_replace(t, '^---[ \\t]*\\n(?:.*\\n)*?---[ \\t]*(?:\\n|$)', '') AS body FROM t)
        SELECT note_path, coalesce(nullif(regexp_replace(trim(regexp_extract(front, '(?mi)^title[ \\t]*:[ \\t]*(.*)$', 1)), '^["'']|["'']$', '', 'g'), ''), nullif({S.strip("regexp_extract(body, '(?m)^#[ \\t]+(.+)$', 1)")}, '')) AS title FROM f""",
    "f15_fnv_hashes": "WITH p AS (SELECT DISTINCT path FROM vault_files) SELECT path, lower(to_hex(list_reduce(list_transform(string_split(path, ''), lambda c: unicode(c)::HUGEINT), lambda h, c: (xor(h::BIGINT, c::BIGINT)::HUGEINT * 16777619) % 4294967296, 2166136261::HUGEINT)::BIGINT)) AS h FROM p",
    "f18_breadcrumbs": f"{_DC} SELECT chunk_id, CASE WHEN len({_CRUMBS}) = 0 THEN '(top)' ELSE array_to_string({_CRUMBS}, ' › ') END AS crumbs FROM dchunks",
    "f19_line_ranges": f"{_DC} SELECT chunk_id, CASE WHEN start_line = end_line THEN 'line ' || (start_line + 1) ELSE 'lines ' || (start_line + 1) || '-' || (end_line + 1) END AS lines FROM dchunks",
    "f20_clipped": f"{_DC} SELECT chunk_id, CASE WHEN length(text) > 300 THEN text[1:300] || chr(10) || '… (clipped)' ELSE text END AS text FROM dchunks",
    "d1_day_labels": "SELECT DISTINCT path, mtime, strftime(make_timestamp(mtime * 1000), '%Y-%m-%d') AS day FROM vault_files",
    "q6_related_notes": f"WITH {_EDGES} SELECT src AS note_path, 'to' AS direction, dst AS other FROM edges UNION ALL SELECT dst, 'from', src FROM edges",
    "j9_link_edges": f"WITH {_EDGES} SELECT src, dst FROM edges",
    "g8_paths_per_key": f"SELECT {S.link_key('note_path')} AS key, count(*) AS paths FROM (SELECT DISTINCT note_path FROM chunks) GROUP BY 1",
    "g11_note_mtimes": f"{_DC} SELECT note_path, min_by(mtime, string_split(chunk_id, '::')[2]::INT) AS mtime, count(*) AS chunks FROM dchunks GROUP BY note_path",
    "w3_ordinals": f"{_DC} SELECT chunk_id, (row_number() OVER (PARTITION BY note_path ORDER BY start_line, end_line, chunk_id) - 1)::INT AS pos FROM dchunks",
    "w6_budgeted_blocks": f"{_DC}, w AS (SELECT chunk_id, text, row_number() OVER o AS n, sum(length(text) + 7) OVER (o ROWS UNBOUNDED PRECEDING) - 7 AS total FROM dchunks WINDOW o AS (PARTITION BY note_path ORDER BY start_line, chunk_id)) SELECT chunk_id, total <= 1500 OR n = 1 AS kept, (CASE WHEN n = 1 THEN least(length(text), 1500) WHEN total <= 1500 THEN length(text) END)::INT AS shown FROM w",
    "w7_listed_links": f"WITH {_EDGES}, w AS (SELECT dst AS note_path, sum(length(src) + 1) OVER (PARTITION BY dst ORDER BY src ROWS UNBOUNDED PRECEDING) <= 200 OR row_number() OVER (PARTITION BY dst ORDER BY src) = 1 AS shown FROM edges) SELECT note_path, sum(shown::INT)::BIGINT AS shown, sum((NOT shown)::INT)::BIGINT AS more FROM w GROUP BY note_path",
    "b9_line_range": "SELECT DISTINCT chunk_id FROM chunks WHERE end_line + 1 >= 10 AND start_line + 1 <= 30",
    "q10_recent_sessions": "SELECT DISTINCT note_path FROM chunks WHERE starts_with(note_path, 'Meetings/') ORDER BY note_path DESC LIMIT 5",
    "g12_projects": "SELECT DISTINCT string_split(path, '/')[2] AS project FROM vault_files WHERE starts_with(path, 'Projects/')",
    "g10_index_stats": f"{_DC}, e AS (SELECT path, arg_max(extracted_text IS NULL, (run_id, mtime, extracted_text IS NULL)) AS none FROM cache_entries GROUP BY path) SELECT count(DISTINCT note_path) AS notes, count(*) AS chunks, max(mtime) AS latest, epoch_us(max(indexed_at)) AS built_us, (SELECT count(*) FROM e WHERE none) AS skipped FROM dchunks",
    "q7_summaries": f"""WITH {_UNITS}, s AS (SELECT note_path, list_filter(list_transform(flatten(list_transform(lines, lambda x: CASE WHEN len(regexp_extract_all(x, '[^.!?]+(?:[.!?]+|$)')) > 0 THEN regexp_extract_all(x, '[^.!?]+(?:[.!?]+|$)') ELSE [x] END)), lambda y: trim(y)), lambda z: length(z) >= 2) AS s FROM l),
        e AS (SELECT note_path, unnest(s) AS sentence, generate_subscripts(s, 1) AS i FROM s), f AS (SELECT note_path, sentence, i FROM e QUALIFY row_number() OVER (PARTITION BY note_path, lower(sentence) ORDER BY i) = 1),
        u AS (SELECT note_path, sentence, row_number() OVER (PARTITION BY note_path ORDER BY i) - 1 AS pos FROM f QUALIFY row_number() OVER (PARTITION BY note_path ORDER BY i) <= 200),
        w AS (SELECT note_path, pos, unnest({S.summary_tokens('sentence')}) AS w FROM u), n AS (SELECT *, count(*) OVER (PARTITION BY note_path, w) AS n FROM w), m AS (SELECT note_path, pos, avg(n) AS score FROM n GROUP BY ALL),
        r AS (SELECT u.note_path, u.pos, u.sentence, coalesce(m.score, 0) AS score FROM u LEFT JOIN m USING (note_path, pos))
        SELECT note_path, pos::INT AS pos, sentence, round(score, 6) AS score FROM r QUALIFY row_number() OVER (PARTITION BY note_path ORDER BY round(score, 9) DESC, pos) <= 3""",
    "u2_term_sources": f"""{_DC} SELECT chunk_id, len(list_distinct({S.tokens("array_to_string(list_concat([regexp_replace(string_split(note_path, '/')[-1], '[.][^.]+$', '')], list_concat(coalesce(aliases, []), coalesce(heading_path, []))), ' ')")}))::INT AS n FROM dchunks""",
    "g18_percentiles": "SELECT lang, quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.95) AS p95, round(avg(n_chars), 6) AS mean FROM documents WHERE n_chars IS NOT NULL GROUP BY lang",
    "g17_distinct_sentences": f"""WITH {_sentences("SELECT doc_id::VARCHAR AS note_path, 0 AS o1, '' AS o2, text FROM documents")} SELECT note_path, count(*) AS units, sum(length(sentence))::BIGINT AS chars FROM u GROUP BY note_path""",
    "q7_note_summaries": f"""{_DC}, {_sentences("SELECT note_path, start_line AS o1, chunk_id AS o2, text FROM dchunks")},
        w AS (SELECT note_path, pos, unnest({S.summary_tokens('sentence')}) AS w FROM u), n AS (SELECT *, count(*) OVER (PARTITION BY note_path, w) AS n FROM w), m AS (SELECT note_path, pos, avg(n) AS score FROM n GROUP BY ALL),
        r AS (SELECT u.note_path, u.pos, u.sentence, coalesce(m.score, 0) AS score FROM u LEFT JOIN m USING (note_path, pos))
        SELECT note_path, pos::INT AS pos, sentence FROM r QUALIFY row_number() OVER (PARTITION BY note_path ORDER BY round(score, 9) DESC, pos) <= 5""",
    "q8_outline": f"{_DC}, {_GROUPS} SELECT note_path, group_no, min_by(label, start_line) AS label, min(start_line) + 1 AS first_line, max(end_line) + 1 AS last_line FROM g GROUP BY note_path, group_no",
    "q8_passages": f"""{_DC}, {_GROUPS}, w AS (SELECT note_path, start_line, own, row_number() OVER o AS n, sum(length(own) + 7) OVER (o ROWS UNBOUNDED PRECEDING) - 7 AS total FROM g WINDOW o AS (PARTITION BY note_path ORDER BY start_line, end_line, chunk_id)),
        k AS (SELECT *, total <= 2000 OR n = 1 AS kept FROM w) SELECT note_path, sum(kept::INT)::BIGINT AS pieces, coalesce(sum(CASE WHEN n = 1 THEN least(length(own), 2000) WHEN kept THEN length(own) END), 0)::BIGINT AS chars, min(CASE WHEN NOT kept THEN start_line END) AS next_line FROM k GROUP BY note_path""",
    "q9_project_context": f"""{_DC}, own AS (SELECT note_path, CASE WHEN starts_with(note_path, 'Memory/Global/') THEN 'Memory/Global' ELSE array_to_string(string_split(note_path, '/')[1:2], '/') END AS folder, string_agg(text, chr(10) || chr(10) ORDER BY start_line, chunk_id) AS content FROM dchunks
          WHERE note_path IN ('Memory/Global/profile.md', 'Memory/Global/preferences.md', 'Memory/Global/conventions.md') OR regexp_full_match(note_path, 'Projects/[^/]+/(overview|architecture|decisions|tasks|open-questions)[.]md') GROUP BY note_path),
        t AS (SELECT folder, note_path, {S.strip('content')} AS content, list_position(CASE WHEN folder = 'Memory/Global' THEN ['profile', 'preferences', 'conventions'] ELSE ['overview', 'architecture', 'decisions', 'tasks', 'open-questions'] END, regexp_extract(note_path, '([^/]+)[.]md$', 1)) - 1 AS ord FROM own),
        w AS (SELECT *, row_number() OVER o AS n, sum(length(content) + 7) OVER (o ROWS UNBOUNDED PRECEDING) - 7 AS total FROM t WHERE content <> '' WINDOW o AS (PARTITION BY folder ORDER BY ord))
        SELECT folder, ord, note_path, total <= 2500 OR n = 1 AS kept, CASE WHEN n = 1 THEN least(length(content), 2500) WHEN total <= 2500 THEN length(content) END AS chars FROM w""",
}
_MMR = """WITH RECURSIVE e AS (SELECT floor(vec_id / 100)::INT AS note, (vec_id % 100)::INT AS pos, embedding::DOUBLE[] AS v FROM embeddings),
    f AS (SELECT note, i, avg(x) AS x FROM (SELECT note, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) GROUP BY note, i), m AS (SELECT note, list(x ORDER BY i) AS c FROM f GROUP BY note),
    u AS (SELECT note, pos, v, list_cosine_similarity(v, c) AS score FROM e JOIN m USING (note)),
    r AS (SELECT note, 0 AS step, []::INT[] AS chosen, []::DOUBLE[][] AS vs FROM m UNION ALL
      SELECT note, step + 1, list_append(chosen, pos), list_append(vs, v) FROM (SELECT r.note, r.step, r.chosen, r.vs, u.pos, u.v, 0.7 * u.score - 0.3 * greatest(0, coalesce(list_max(list_transform(r.vs, lambda w: list_cosine_similarity(w, u.v))), 0)) AS value
        FROM r JOIN u ON u.note = r.note WHERE r.step < 5 AND NOT list_contains(r.chosen, u.pos)) QUALIFY row_number() OVER (PARTITION BY note ORDER BY value DESC, pos) = 1)
    SELECT note::VARCHAR AS note_path, unnest(chosen) AS pos FROM r WHERE step = 5"""
SQL["t6_diverse_vectors"] = _MMR
_SECTIONS = f"""raw AS (SELECT note_path || '#' || doc_id AS note_path, regexp_split_to_array(text, '\\r?\\n') AS ls FROM documents WHERE text IS NOT NULL),
  fm AS (SELECT *, CASE WHEN regexp_full_match(ls[1], '---\\s*') THEN coalesce(list_min(list_filter(range(2, len(ls) + 1), lambda i: regexp_full_match(ls[i], '---\\s*'))), 0) ELSE 0 END AS skip FROM raw),
  st AS (SELECT *, list_transform(ls[skip + 1:], lambda x: {{'f': regexp_extract(x, '^\\s*(```|~~~)', 1), 'm': '', 'o': []::BOOLEAN[]}}) AS marks FROM fm),
  fl AS (SELECT note_path, ls, skip, list_reduce(list_prepend({{'f': '', 'm': '', 'o': []::BOOLEAN[]}}, marks), lambda a, x: {{'f': '', 'm': CASE WHEN x.f = '' THEN a.m WHEN a.m = '' THEN x.f WHEN a.m = x.f THEN '' ELSE a.m END, 'o': list_append(a.o, a.m = '' AND x.f = '')}}).o AS free FROM st),
  ln AS (SELECT note_path, unnest(ls[skip + 1:]) AS x, unnest(free) AS free, skip + generate_subscripts(free, 1) - 1 AS i FROM fl),
  hd AS (SELECT *, CASE WHEN free THEN length(regexp_extract(x, '^(#{{1,6}})\\s+(.+?)\\s*#*\\s*$', 1)) ELSE 0 END AS lvl, regexp_extract(x, '^(#{{1,6}})\\s+(.+?)\\s*#*\\s*$', 2) AS head FROM ln),
  gr AS (SELECT *, sum((lvl > 0)::INT) OVER (PARTITION BY note_path ORDER BY i) AS g FROM hd),
  se AS (SELECT note_path, g, max(lvl) AS lvl, coalesce(max(CASE WHEN lvl > 0 THEN head END), '') AS heading, min(i) AS first_line, max(i) AS last_line, coalesce({S.strip("string_agg(CASE WHEN lvl = 0 THEN x END, chr(10) ORDER BY i)")}, '') AS body FROM gr GROUP BY note_path, g),
  up AS (SELECT a.note_path, a.g, b.g AS bg, b.heading, b.lvl FROM se a JOIN se b ON a.note_path = b.note_path AND b.g < a.g AND b.lvl > 0 AND b.lvl < a.lvl WHERE a.lvl > 0 AND NOT EXISTS (SELECT 1 FROM se c WHERE c.note_path = a.note_path AND c.g > b.g AND c.g < a.g AND c.lvl > 0 AND c.lvl <= b.lvl)),
  pa AS (SELECT note_path, g, list(heading ORDER BY bg) AS path FROM up GROUP BY ALL),
  sections AS (SELECT se.*, coalesce(path, []) AS path, row_number() OVER (PARTITION BY note_path ORDER BY g) - 1 AS ordinal FROM se LEFT JOIN pa USING (note_path, g) WHERE heading <> '' OR body <> '')"""
SQL["i2_sections"] = f"WITH {_SECTIONS} SELECT note_path, ordinal::INT AS ordinal, heading, array_to_string(path, ' › ') AS crumbs, first_line::INT AS first_line, last_line::INT AS last_line, length(body)::INT AS chars FROM sections"
SQL["i1_whole_sections"] = f"""WITH {_SECTIONS}, w AS (SELECT note_path, first_line::INT AS start_line, last_line::INT AS end_line, concat_ws(chr(10) || chr(10), CASE WHEN heading <> '' THEN repeat('#', len(path) + 1) || ' ' || heading END, nullif(body, '')) AS text FROM sections) SELECT * FROM w WHERE length(text) <= 2000"""
_ONCE = lambda x: f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"
_FRONT = lambda names, take: f"list_filter(list_transform(string_split(regexp_replace(regexp_extract(front, '(?mi)^(?:{names})[ \\t]*:[ \\t]*(.*)$', 1), '^\\[|\\]\\s*$', '', 'g'), ','), lambda v: regexp_replace(regexp_replace(trim(v), '^[\"'']|[\"'']$', '', 'g'), '{take}', '')), lambda v: v <> '')"
SQL["f7_metadata"] = f"""WITH {_SECTIONS}, pr AS (SELECT note_path, string_agg(x, chr(10) ORDER BY i) FILTER (free) AS prose, string_agg(x, chr(10) ORDER BY i) AS body FROM ln GROUP BY note_path),
    al AS (SELECT fm.note_path, skip, array_to_string(ls[2 : skip - 1], chr(10)) AS front, coalesce(prose, '') AS prose, coalesce(body, '') AS body FROM fm LEFT JOIN pr USING (note_path)),
    ls AS (SELECT note_path, skip, front, body, list_concat({_FRONT('tags?', '^#')}, list_filter(regexp_extract_all(prose, '(?:^|[\\s(])#([A-Za-z0-9_][A-Za-z0-9_/-]*)', 1), lambda t: NOT regexp_full_match(t, '[0-9]+'))) AS tags, {_FRONT('alias(?:es)?', '')} AS aliases,
      list_concat(list_transform(regexp_extract_all(prose, '\\[\\[([^\\]|#]+)(?:[#|][^\\]]*)?\\]\\]', 1), lambda t: trim(t)), list_filter(list_transform(regexp_extract_all(prose, '\\[[^\\]]*\\]\\(([^)]+)\\)', 1), lambda t: trim(t)), lambda t: NOT regexp_matches(t, '(?i)^([a-z][a-z0-9+.-]*://|mailto:)'))) AS links FROM al)
    SELECT note_path, array_to_string({_ONCE('tags')}, ' ') AS tags, array_to_string({_ONCE('aliases')}, ' ') AS aliases, array_to_string({_ONCE('links')}, ' ') AS links,
      coalesce(nullif(regexp_replace(trim(regexp_extract(front, '(?mi)^title[ \\t]*:[ \\t]*(.*)$', 1)), '^["'']|["'']$', '', 'g'), ''), nullif({S.strip("regexp_extract(body, '(?m)^#[ \\t]+(.+)$', 1)")}, '')) AS title, skip::INT AS body_line FROM ls"""
SQL["j16_project_notes"] = f"""WITH f AS (SELECT DISTINCT {FOLDER} AS folder FROM pending_entries), n AS (SELECT note_path, string_split(note_path, '/')[2] AS folder FROM (SELECT DISTINCT note_path FROM chunks WHERE starts_with(note_path, 'Projects/')))
    SELECT folder, count(note_path) AS notes FROM f LEFT JOIN n USING (folder) WHERE coalesce(folder, '') NOT IN ('', '.', '..') GROUP BY folder"""
