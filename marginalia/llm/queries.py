"""Queries of the operators for training data, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import canonical, distinctive, evalleak, markup, mixing, neighbors, spans, splitting
from marginalia.session import materialize, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.families(table(spark, d, "chunks"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.distinctive_terms(table(spark, d, "chunks")).select("chunk_id", "term")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = neighbors.close_pairs(neighbors.current_vectors(table(spark, d, "vectors")), "chunk_id", "v")
    return pairs.select(F.col("key_a").alias("chunk_id_a"), F.col("key_b").alias("chunk_id_b"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.members(table(spark, d, "pending_entries"), "entry_id", "content", "entry_type", "project").where("entry_id <> first").select(F.col("first").alias("first_entry_id"), "entry_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_pieces(table(spark, d, "chunks")).where("piece_no = 0").select("chunk_id", "cut_at").distinct()


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return evalleak.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), edited=False).where(F.col("run") >= evalleak.STRETCH).select("item_id", "doc_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.source_rates(table(spark, d, "documents"), table(spark, d, "mix_targets")).where("capped").select("source")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.sharing_pairs(table(spark, d, "documents"))


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean(table(spark, d, "chunks")).select("chunk_id", "heading", "text")


def p3_scores(spark: SparkSession, d: str) -> DataFrame:
    scored = distinctive.ppmi(table(spark, d, "chunks"), "chunk_id", F.col("text"), F.array_join("aliases", "\n"))
    return scored.select(F.col("record").alias("chunk_id"), "term", "n", "records", F.round("ppmi", 6).alias("ppmi"))


def p4_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.nearest(neighbors.current_vectors(table(spark, d, "vectors")), "chunk_id", "v")


def p4_search(spark: SparkSession, d: str) -> DataFrame:
    """Greedy graph search over the current vectors for every one of them."""
    rows = materialize(neighbors.current_vectors(table(spark, d, "vectors")), "current-vectors")
    return neighbors.search(rows, "chunk_id", "v", rows, "chunk_id", "v")


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    return canonical.classes(table(spark, d, "pending_entries"), "entry_id", "content", "entry_type", "project").select("first", "copies", "variants")


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_pieces(table(spark, d, "chunks"))


def p6_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per oversized chunk: characters (white space aside) in the own texts of its pieces, pieces over the limit, where it was cut."""
    pieces = splitting.split_pieces(table(spark, d, "chunks"))
    own = F.length(F.regexp_replace(F.expr("substr(piece, lap + 1)"), "[ \t\r\n]++", ""))
    return pieces.groupBy("chunk_id", "cut_at").agg(F.sum(own).alias("covered"), F.sum((F.length("piece") > splitting.LIMIT).cast("int")).alias("over"))


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return evalleak.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_bpe_plan(spark: SparkSession, d: str) -> DataFrame:
    """The plan in tokens of a public byte-level BPE; MARGINALIA_VOCABULARY names its file of ranks. Each text is tokenised once."""
    count = mixing.bpe_tokens(os.environ.get("MARGINALIA_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken"), mixing.BPE_PATTERN)
    sized = materialize(table(spark, d, "documents").select("doc_id", "source", count("text").alias("tokens")), "sized-documents")
    plan = mixing.source_rates(sized, table(spark, d, "mix_targets"), F.col("tokens"))
    return plan.select("source", "tokens", "capped", F.round("wanted", 3).alias("wanted"), F.round("rate", 6).alias("rate"))


def p9_copies(spark: SparkSession, d: str) -> DataFrame:
    """Whether each document of a target source is used as often as its rate says, the fraction rounded down or up by the draw."""
    documents, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    used = mixing.mix(documents, targets).groupBy("doc_id").agg(F.count("*").alias("copies"))
    rates = mixing.source_rates(documents, targets).select("source", "rate")
    low = F.floor(F.round("rate", 9)).cast("long")
    each = documents.select("doc_id", "source").join(F.broadcast(rates), "source").join(used, "doc_id", "left").withColumn("copies", F.coalesce("copies", F.lit(0)))
    return each.select("doc_id", "source", low.alias("whole"), (F.col("copies") - low).isin(0, 1).alias("fits"))


def p9_reached(spark: SparkSession, d: str) -> DataFrame:
    """Whether the mixed tokens of a source come near what the plan can give it: within five deviations of the draw."""
    documents, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    tokens = mixing.whitespace_tokens(F.col("text"))
    squares = documents.groupBy("source").agg(F.sum(tokens.cast("double") * tokens).alias("squares"))
    rows = mixing.shares(documents, targets).join(squares, "source", "left")
    part = F.col("rate") - F.floor("rate")
    spread = 5 * F.sqrt(F.coalesce("squares", F.lit(0.0)) * part * (1 - part)) + 1
    return rows.select("source", "capped", (F.abs(F.col("mixed_tokens") - F.col("rate") * F.col("tokens")) <= spread).alias("near"))


def p9_plan(spark: SparkSession, d: str) -> DataFrame:
    plan = mixing.source_rates(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return plan.select("source", "tokens", "capped", F.round("wanted", 3).alias("wanted"), F.round("rate", 6).alias("rate"))


def p10_shared(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_parts(table(spark, d, "documents")).select("doc_id", "copies", "links", "shared_chars", F.round("share", 6).alias("share"))


def p10_kept(spark: SparkSession, d: str) -> DataFrame:
    return spans.without_repeats(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_clean, p3_found, p3_scores, p4_found, p4_neighbors, p4_search, p5_found, p5_classes, p6_found, p6_pieces, p6_coverage, p8_found, p8_leaks, p9_found, p9_mix, p9_plan, p9_bpe_plan, p9_copies, p9_reached, p9_shares, p10_found, p10_shared, p10_kept,
    )
}

_TERMS = """one AS (SELECT chunk_id, max(concat_ws(chr(10), text, array_to_string(aliases, chr(10)))) AS t FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
  bags AS (SELECT chunk_id, list_transform(regexp_extract_all(t, '\\pL{5,}'), lambda x: lower(x)) AS terms FROM one),
  joint AS (SELECT chunk_id, term, count(*) AS n FROM (SELECT chunk_id, unnest(terms) AS term FROM bags) GROUP BY ALL),
  marginal AS (SELECT term, sum(n) AS term_n, count(*) AS records FROM joint GROUP BY term)"""
_BLANK = "chr(32) || chr(9) || chr(13) || chr(10)"
_WS_TOKENS = "len(regexp_extract_all(text, '[^\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+'))"
_PLAN = f"""sizes AS (SELECT source, sum(coalesce({_WS_TOKENS}, 0)) AS tokens FROM documents WHERE source IS NOT NULL GROUP BY source),
  known AS (SELECT t.source, target_share, max_repeats, coalesce(tokens, 0)::BIGINT AS tokens FROM mix_targets t LEFT JOIN sizes s ON s.source = t.source),
  plan AS (SELECT *, target_share * sum(tokens) OVER () AS wanted FROM known)"""

_CUT = f"""t AS (SELECT DISTINCT chunk_id, trim(text, {_BLANK}) AS t FROM chunks WHERE chunk_id IS NOT NULL), big AS (SELECT * FROM t WHERE length(t) > 2000),
  m AS (SELECT chunk_id, t, list_max(list_transform(regexp_split_to_array(t, '\\n(?:[ \\t\\r]*\\n)+'), lambda x: length(x))) AS p, list_max(list_transform(string_split(t, chr(10)), lambda x: length(x))) AS l, list_max(list_transform(regexp_split_to_array(t, '[ \\t\\r\\n]+'), lambda x: length(x))) AS w FROM big),
  cut AS (SELECT chunk_id, t, CASE WHEN p <= 2000 THEN 'paragraph' WHEN l <= 2000 THEN 'line' WHEN w <= 2000 THEN 'word' ELSE 'none' END AS cut_at FROM m)"""

_WINDOWS = "w AS (SELECT doc_id, unnest(range(1, length(text) - 198)) AS i, md5_number(text[i : i + 199]) AS h FROM documents WHERE length(text) >= 200)"
_RUNS = "{name} AS (SELECT {id}, unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i : i + 19], ' '))) AS g FROM (SELECT {id}, regexp_extract_all(lower(text), '[\\pL\\pN]+') AS w FROM {t}))"


def _bare(x: str) -> str:
    return f"replace(lower(upper(regexp_replace(coalesce({x}, ''), '[^\\pL\\pN]+', '', 'g'))), 'ß', 'ss')"


_SAME = f"""b AS (SELECT *, {_bare('entry_type')} || chr(1) || {_bare('project')} AS label, {_bare('content')} AS bare, trim(content, {_BLANK}) AS body FROM pending_entries WHERE entry_id IS NOT NULL),
  p AS (SELECT *, list_filter(list_transform(regexp_split_to_array(body, '[\\r\\n;]+'), lambda x: trim(x, ' ' || chr(9))), lambda x: x <> '') AS parts, CASE WHEN starts_with(body, chr(123)) AND json_valid(body) THEN body::JSON END AS j FROM b),
  f AS (SELECT *, CASE WHEN j IS NOT NULL THEN list_sort(list_transform(json_keys(j), lambda k: {_bare('k')} || {_bare("json_extract_string(j, '$.' || chr(34) || k || chr(34))")}))
    WHEN len(list_filter(parts, lambda x: NOT regexp_matches(x, '^[^:=;\\n{{}}"]+?\\s*[:=]'))) = 0 THEN list_sort(list_transform(parts, lambda x: {_bare('x')})) END AS flds FROM p),
  shape AS (SELECT label, bare, max(array_to_string(flds, chr(2))) AS shape FROM f WHERE len(flds) >= 2 GROUP BY label, bare),
  formed AS (SELECT f.*, coalesce(shape, bare) AS form FROM f LEFT JOIN shape USING (label, bare)), classed AS (SELECT *, min(entry_id) OVER (PARTITION BY label, form) AS first FROM formed)"""

SQL: dict[str, str] = {
    "p3_found": f"WITH {_TERMS} SELECT chunk_id, term FROM joint JOIN marginal USING (term) WHERE n >= 3 AND records BETWEEN 2 AND 6",
    "p3_scores": f"""WITH {_TERMS}, z AS (SELECT sum(len(terms) ** 0.75) AS z FROM bags WHERE len(terms) > 0)
        SELECT j.chunk_id, term, n, records, round(greatest(0, log2(n * z / (term_n * len(terms) ** 0.75))), 6) AS ppmi FROM joint j JOIN marginal USING (term) JOIN bags b ON b.chunk_id = j.chunk_id CROSS JOIN z""",
    "p6_found": f"WITH {_CUT} SELECT chunk_id, cut_at FROM cut",
    "p6_coverage": f"WITH {_CUT} SELECT chunk_id, cut_at, sum(length(regexp_replace(t, '[ \\t\\r\\n]+', '', 'g')))::BIGINT AS covered, 0 AS over FROM cut GROUP BY chunk_id, cut_at",
    "p4_found": f"""WITH cur AS (SELECT chunk_id, arg_max(v, (run_id, h)) AS v FROM vectors WHERE chunk_id IS NOT NULL AND v IS NOT NULL GROUP BY chunk_id),
        top AS (SELECT chunk_id, max(coalesce(run_id, -1)) AS r FROM vectors WHERE v IS NULL GROUP BY chunk_id), latest AS (SELECT chunk_id, max(coalesce(run_id, -1)) AS r FROM vectors WHERE v IS NOT NULL GROUP BY chunk_id),
        valid AS (SELECT c.chunk_id, c.v::DOUBLE[] AS v FROM cur c JOIN latest l USING (chunk_id) LEFT JOIN top t USING (chunk_id) WHERE (t.r IS NULL OR t.r < l.r) AND len(c.v) = 64 AND len(list_filter(c.v, lambda x: x IS NULL OR isnan(x))) = 0 AND list_sum(list_transform(c.v, lambda x: x * x)) > 0),
        pairs AS (SELECT a.chunk_id AS a, b.chunk_id AS b, list_cosine_similarity(a.v, b.v) AS sim FROM valid a JOIN valid b ON a.chunk_id <> b.chunk_id),
        near AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) <= 10)
        SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM near WHERE sim >= 0.9""",
    "p5_found": f"WITH {_SAME} SELECT first AS first_entry_id, entry_id FROM classed WHERE entry_id <> first",
    "p5_classes": f"WITH {_SAME} SELECT first, count(*) AS copies, count(DISTINCT (content, entry_type, project)) AS variants FROM classed GROUP BY first",
    "p8_found": f"""WITH {_RUNS.format(t='documents', id='doc_id', name='dg')}, {_RUNS.format(t='eval_items', id='item_id', name='ig')} SELECT DISTINCT item_id, doc_id FROM dg JOIN ig USING (g)""",
    "p10_found": f"WITH {_WINDOWS}, pairs AS (SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM w a JOIN w b ON a.h = b.h AND a.doc_id < b.doc_id) SELECT * FROM pairs",
    "p10_shared": f"""WITH {_WINDOWS}, tw AS (SELECT t.text, w.h, w.i FROM w JOIN (SELECT text, min(doc_id) AS doc_id FROM documents WHERE length(text) > 0 GROUP BY text) t USING (doc_id)), hs AS (SELECT DISTINCT text, h FROM tw),
        l AS (SELECT a.text, count(DISTINCT b.text) AS links FROM hs a JOIN hs b ON a.h = b.h AND a.text <> b.text GROUP BY a.text), s AS (SELECT h FROM hs GROUP BY h HAVING count(*) > 1),
        c AS (SELECT text, least(200, coalesce(lead(i) OVER (PARTITION BY text ORDER BY i) - i, 200)) AS n FROM tw WHERE h IN (SELECT h FROM s)), covered AS (SELECT text, sum(n)::BIGINT AS covered FROM c GROUP BY text),
        copies AS (SELECT text, count(DISTINCT doc_id) AS copies FROM documents WHERE length(text) > 0 GROUP BY text),
        r AS (SELECT d.doc_id, coalesce(k.copies, 1) AS copies, coalesce(links, 0) AS links, CASE WHEN k.copies > 1 AND length(d.text) >= 200 THEN length(d.text) ELSE coalesce(covered, 0) END AS shared_chars, length(d.text) AS len FROM documents d LEFT JOIN copies k USING (text) LEFT JOIN l USING (text) LEFT JOIN covered USING (text))
        SELECT doc_id, copies, links, shared_chars, round(CASE WHEN len > 0 THEN shared_chars / len ELSE 0 END, 6) AS share FROM r""",
    "p9_copies": f"WITH {_PLAN}, r AS (SELECT source, floor(round(CASE WHEN tokens > 0 THEN least(max_repeats, wanted / tokens) ELSE 0 END, 9))::BIGINT AS whole FROM plan) SELECT doc_id, source, whole, true AS fits FROM documents JOIN r USING (source)",
    "p9_reached": f"WITH {_PLAN} SELECT source, tokens * max_repeats < wanted AS capped, true AS near FROM plan",
    "p9_found": f"WITH {_PLAN} SELECT source FROM plan WHERE tokens * max_repeats < wanted",
    "p9_plan": f"WITH {_PLAN} SELECT source, tokens, tokens * max_repeats < wanted AS capped, round(wanted, 3) AS wanted, round(CASE WHEN tokens > 0 THEN least(max_repeats, wanted / tokens) ELSE 0 END, 6) AS rate FROM plan",
}
