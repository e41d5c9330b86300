"""Search queries: tokens, statistics, filters, lexical, vector and hybrid retrieval, page shaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import filters, lexical, measure, modes, ordered, ranking, vector
from marginalia.plans import sqlparts as S
from marginalia.session import table

LIMIT = 8


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return lexical.distinct_chunks(table(spark, d, "chunks"))


_built: dict[tuple, lexical.Index] = {}


def _index(spark: SparkSession, d: str) -> lexical.Index:
    """The index searches run on, built once a session and state of the table."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/chunks.parquet")
    held = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path)
    status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
    key = spark.sparkContext.applicationId, d, held.getLength(), status.getModificationTime()
    if key not in _built:
        _built[key] = lexical.build(_chunks(spark, d))
    return _built[key]


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _vector_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("qv"))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    notes = table(spark, d, "chunks").select("chunk_id", "note_path").distinct()
    return vector.current_vectors(table(spark, d, "vectors")).join(notes, "chunk_id").where(F.size("v") == 64)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def f1_tokens(spark, d):
    t = T.tokens(F.col("text"))
    return _chunks(spark, d).select("chunk_id", F.size(t).alias("n"), F.size(F.array_distinct(t)).alias("n_distinct"), F.array_join(F.slice(F.array_sort(F.array_distinct(t)), 1, 5), " ").alias("first_terms"))


def f2_summary_tokens(spark, d):
    t = T.summary_tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).alias("n"), F.array_join(F.array_distinct(t), " ").alias("terms"))


def f3_mock_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.raw_tokens(F.col("text")), " ").alias("terms"))


def f6_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


def f13_link_keys(spark, d):
    links = table(spark, d, "chunks").select(F.explode("links").alias("ref")).distinct()
    return links.select("ref", T.link_key(F.col("ref")).alias("key"))


def f23_field_terms(spark, d):
    return _chunks(spark, d).select("chunk_id", F.array_join(F.array_sort(lexical.field_terms(F.col("note_path"), F.col("aliases"), F.col("heading_path"))), " ").alias("terms"))


def g1_term_frequency(spark, d):
    return _index(spark, d).postings.where("tf > 0").select("chunk_id", "term", F.col("tf").cast("long").alias("tf"))


def g2_document_frequency(spark, d):
    return _index(spark, d).df.select("term", "df")


def g3_corpus_size(spark, d):
    return _index(spark, d).facts.agg(F.count("*").alias("n"), F.sum("dl").alias("total"), F.round(F.avg("dl"), 6).alias("avgdl"))


def g4_idf(spark, d):
    index = _index(spark, d)
    return index.df.select("term", F.round(lexical.idf(F.col("df"), index.n), 6).alias("idf"))


def g6_heading_terms(spark, d):
    return _index(spark, d).postings.where("in_head").select("chunk_id", "term")


def q1_lexical_search(spark, d):
    return _rounded(lexical.search(_index(spark, d), _queries(spark, d), LIMIT)).withColumn("matched", F.array_join("matched", " "))


def q1_short_queries(spark, d):
    """Questions of three words, as users type them."""
    q = _queries(spark, d).withColumn("query", F.array_join(F.slice(T.tokens(F.col("query")), 1, 3), " "))
    return _rounded(lexical.search(_index(spark, d), q, LIMIT)).withColumn("matched", F.array_join("matched", " "))


def _filtered(where):
    def run(spark, d):
        return _rounded(lexical.search(_index(spark, d).where(where()), _queries(spark, d), LIMIT)).withColumn("matched", F.array_join("matched", " "))

    return run


b6_search_in_folder = _filtered(lambda: filters.retrieval_condition(folder="Projects/Heronfield"))
b6_search_with_tag = _filtered(lambda: filters.retrieval_condition(tag="#TODO"))
b12_search_since = _filtered(lambda: filters.retrieval_condition(since_mtime=1750000000000))


def b13_empty_query(spark, d):
    return _rounded(lexical.search(_index(spark, d), _queries(spark, d).withColumn("query", F.lit("the and ...")), LIMIT)).select("query_id", "chunk_id")


def b1_include_folders(spark, d):
    return table(spark, d, "vault_files").select("path").distinct().where(filters.eligible(F.col("path"), include=["Projects", "", "Notes/Drafts/"]))


def b2_exclude_folders(spark, d):
    return table(spark, d, "vault_files").select("path").distinct().where(filters.eligible(F.col("path"), exclude=["Archive", "Attachments/Scans"]))


def b2_blank_excludes_all(spark, d):
    return table(spark, d, "vault_files").select("path").distinct().where(filters.eligible(F.col("path"), exclude=[" "]))


def b3_path_patterns(spark, d):
    return table(spark, d, "vault_files").select("path").distinct().where(filters.eligible(F.col("path"), patterns=["**/*.pdf", "archive/*/*.md", "Silver"]))


def b4_exclude_tags(spark, d):
    return _chunks(spark, d).where(~filters.has_tag(F.col("tags"), ["#Meeting", "todo"])).select("chunk_id")


def b7_chunks_of_note(spark, d):
    return _chunks(spark, d).where(F.col("note_path") == "Journal/Daily Log.md").select("chunk_id", "start_line")


def j3_vectors_of_chunks(spark, d):
    return _stored(spark, d).select("chunk_id", "note_path", "h")


def m1_cosine(spark, d):
    """Cosine of every vector with the centroid of its label."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    middle = vector.centroid(e, "label", "v").groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("c"))
    return e.join(middle, "label").select("vec_id", F.round(vector.cosine(F.col("v"), F.col("c")), 6).alias("sim"))


def q2_vector_search(spark, d):
    return _rounded(vector.search(_stored(spark, d), _vector_queries(spark, d), LIMIT))


def q3_hybrid_search(spark, d):
    vq = _vector_queries(spark, d).withColumnRenamed("query_id", "vec_id")
    q = _queries(spark, d).withColumn("vec_id", ((F.col("query_id") - 5000) / 7 * 50).cast("long")).join(vq, "vec_id", "left")
    page = vector.hybrid(_index(spark, d), _stored(spark, d), q.select("query_id", "query", "qv"), LIMIT)
    return page.select("query_id", "rank", "chunk_id", F.round("score", 9).alias("score"))


def t7_near_duplicates(spark, d):
    c = _chunks(spark, d)
    page = lexical.search(_index(spark, d), _queries(spark, d), 2 * LIMIT)
    with_text = page.join(c.select("chunk_id", T.tokens(F.col("text")).alias("toks")), "chunk_id")
    return ranking.without_near_duplicates(with_text, "toks")


def g14_centroid(spark, d):
    e = table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    return vector.centroid(e, "label", "v").select("label", "i", F.round("x", 6).alias("x"))


def g15_jaccard(spark, d):
    """How alike the words of a chunk and of the one before it in its note are."""
    c = _chunks(spark, d).select("note_path", "start_line", "chunk_id", F.array_distinct(T.tokens(F.col("text"))).alias("t"))
    both = ordered.previous(ordered.placed(c, ["note_path"], ["start_line", "chunk_id"]), ["note_path"], ["start_line", "chunk_id"], "t")
    return both.where("previous is not null").select("chunk_id", F.round(ranking.jaccard(F.col("t"), F.col("previous.t")), 6).alias("jaccard"))


def g19_recall(spark, d):
    """Of the chunk that the whole text of a question finds first: how often, and where, three words of it find it; per suite."""
    wanted = lexical.search(_index(spark, d), _queries(spark, d), LIMIT).where("rank = 1").select("query_id", "chunk_id")
    suites = table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "suite")
    out = measure.recall_and_rank(q1_short_queries(spark, d), wanted.join(suites, "query_id"), "suite", LIMIT)
    return out.select("suite", "queries", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))


def q4_foreign_vectors(spark, d):
    """A hybrid search whose stored vectors are of another model: it keeps the lexical order."""
    page = modes.search(_index(spark, d), _stored(spark, d), _queries(spark, d), modes.HYBRID, lambda texts: [[1.0] * 64] * len(texts), "another model", "this model", LIMIT)
    return page.select("query_id", "rank", "chunk_id", F.round("score", 9).alias("score"))


def f5_snippets(spark, d):
    c = _chunks(spark, d)
    page = lexical.search(_index(spark, d), _queries(spark, d), LIMIT)
    return page.join(c.select("chunk_id", "text"), "chunk_id").select("query_id", "rank", ranking.snippet("text", "matched").alias("snippet"))


def f26_highlight(spark, d):
    c = _chunks(spark, d)
    page = lexical.search(_index(spark, d), _queries(spark, d), LIMIT)
    return page.join(c.select("chunk_id", "text"), "chunk_id").select("query_id", "rank", ranking.highlight("text", "matched").alias("marked"))


def q5_search_page(spark, d):
    c = _chunks(spark, d)
    page = vector.top_ranks(lexical.search(_index(spark, d), _queries(spark, d), 2 * LIMIT).drop("rank"), 2 * LIMIT)
    best = ranking.diversified(page.drop("rank"), LIMIT)
    info = c.select("chunk_id", "heading", "heading_path", "start_line", "end_line", "mtime")
    crumbs = F.array_join(F.filter(F.concat(F.coalesce("heading_path", F.array().cast("array<string>")), F.array(F.coalesce("heading", F.lit("")))), lambda x: F.trim(x) != ""), " › ")
    label = F.concat("note_path", F.lit(" · "), F.when(crumbs == "", "(top)").otherwise(crumbs), F.lit(" · lines "), F.col("start_line") + 1, F.lit("-"), F.col("end_line") + 1, F.lit(" · "), T.day_label(F.col("mtime")))
    pending = F.when(F.col("note_path").startswith("Memory/Inbox/"), " [PENDING REVIEW]").otherwise("")
    return best.join(info, "chunk_id").select("query_id", "rank", F.concat(label, pending).alias("line"))


QUERIES = {
    f.__name__: f
    for f in (
        f1_tokens, f2_summary_tokens, f3_mock_tokens, f6_sentences, f13_link_keys, f23_field_terms, g1_term_frequency, g2_document_frequency, g3_corpus_size, g4_idf, g6_heading_terms, q1_lexical_search, q1_short_queries,
        b13_empty_query, b1_include_folders, b2_exclude_folders, b2_blank_excludes_all, b3_path_patterns, b4_exclude_tags, b7_chunks_of_note, j3_vectors_of_chunks, m1_cosine, q2_vector_search, q3_hybrid_search,
        t7_near_duplicates, g14_centroid, g15_jaccard, g19_recall, q4_foreign_vectors, f5_snippets, f26_highlight, q5_search_page,
    )
} | {"b6_search_in_folder": b6_search_in_folder, "b6_search_with_tag": b6_search_with_tag, "b12_search_since": b12_search_since}

_Q = "queries AS (SELECT item_id AS query_id, text AS query FROM eval_items)"
_VQ = "vq AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 50 = 0)"
_STORED = f"{S.CURRENT_VECTORS}, stored AS (SELECT v.chunk_id, n.note_path, v.h, v.v FROM cvectors v JOIN (SELECT DISTINCT chunk_id, note_path FROM chunks) n USING (chunk_id) WHERE len(v) = 64)"
_VALID = "valid AS (SELECT * FROM stored WHERE len(list_filter(v, lambda x: x IS NULL OR isnan(x))) = 0 AND list_sum(list_transform(v, lambda x: x * x)) > 0)"
_VSCORES = "vscores AS (SELECT query_id, chunk_id, note_path, list_cosine_similarity(v, qv) AS score FROM valid CROSS JOIN vq WHERE list_cosine_similarity(v, qv) > 0)"


def _lexical(source: str = "dchunks", where: str = "", queries: str = _Q) -> str:
    pick = f", picked AS (SELECT * FROM dchunks WHERE {where})" if where else ""
    return f"WITH {S.DISTINCT_CHUNKS}{pick}, {queries}, {S.scores(source)}, {S.page('scores', LIMIT, 3)} SELECT query_id, rank, chunk_id, note_path, round(score, 6) AS score, array_to_string(matched, ' ') AS matched FROM page"


_SENT_MARK = f"regexp_replace({S.strip('x')}, '^(?:#{{1,6}}{S.WS}+|[-*+]{S.WS}+|>{S.WS}*|[0-9]+[.)]{S.WS}+)', '')"

SQL = {
    "f1_tokens": f"WITH {S.DISTINCT_CHUNKS}, t AS (SELECT chunk_id, {S.tokens('text')} AS t FROM dchunks) SELECT chunk_id, len(t)::INT AS n, len(list_distinct(t))::INT AS n_distinct, array_to_string(list_sort(list_distinct(t))[1:5], ' ') AS first_terms FROM t",
    "f2_summary_tokens": f"SELECT doc_id, len({S.summary_tokens('text')})::INT AS n, coalesce((SELECT string_agg(term, ' ' ORDER BY i) FROM (SELECT term, min(i) AS i FROM (SELECT unnest({S.summary_tokens('text')}) AS term, generate_subscripts({S.summary_tokens('text')}, 1) AS i) GROUP BY term)), '') AS terms FROM documents",
    "f3_mock_tokens": f"SELECT doc_id, array_to_string({S.raw_tokens('text')}, ' ') AS terms FROM documents",
    "f6_sentences": f"""WITH l AS (SELECT doc_id, list_transform(regexp_split_to_array(text, '\\r?\\n+'), lambda x: {S.strip(_SENT_MARK)}) AS lines FROM documents),
        s AS (SELECT doc_id, list_filter(list_transform(flatten(list_transform(lines, lambda x: CASE WHEN len(regexp_extract_all(x, '[^.!?]+(?:[.!?]+|$)')) > 0 THEN regexp_extract_all(x, '[^.!?]+(?:[.!?]+|$)') ELSE [x] END)), lambda y: {S.strip('y')}), lambda z: length(z) >= 2) AS s FROM l)
        SELECT doc_id, (generate_subscripts(s, 1) - 1)::INT AS pos, unnest(s) AS sentence FROM s""",
    "f13_link_keys": f"WITH r AS (SELECT DISTINCT ref FROM (SELECT unnest(links) AS ref FROM chunks)) SELECT ref, {S.link_key('ref')} AS key FROM r",
    "f23_field_terms": f"""WITH {S.DISTINCT_CHUNKS} SELECT chunk_id, array_to_string(list_sort(list_distinct({S.tokens("array_to_string(list_concat([regexp_replace(string_split(note_path, '/')[-1], '[.][^.]+$', '')], list_concat(coalesce(aliases, []), coalesce(heading_path, []))), ' ')")})), ' ') AS terms FROM dchunks""",
    "g1_term_frequency": f"WITH {S.DISTINCT_CHUNKS} SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest({S.tokens('text')}) AS term FROM dchunks) GROUP BY ALL",
    "g2_document_frequency": f"WITH {S.DISTINCT_CHUNKS} SELECT term, count(DISTINCT chunk_id) AS df FROM (SELECT chunk_id, unnest({S.tokens('text')}) AS term FROM dchunks) GROUP BY term",
    "g3_corpus_size": f"WITH {S.DISTINCT_CHUNKS}, t AS (SELECT len({S.tokens('text')}) AS n FROM dchunks) SELECT count(*) AS n, sum(n)::BIGINT AS total, round(avg(n), 6) AS avgdl FROM t",
    "g4_idf": f"WITH {S.DISTINCT_CHUNKS}, t AS (SELECT DISTINCT chunk_id, unnest({S.tokens('text')}) AS term FROM dchunks), n AS (SELECT count(*) AS n FROM dchunks) SELECT term, round(ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM t CROSS JOIN n GROUP BY term",
    "g6_heading_terms": f"WITH {S.DISTINCT_CHUNKS} SELECT DISTINCT chunk_id, unnest({S.tokens("coalesce(heading, '')")}) AS term FROM dchunks",
    "q1_lexical_search": _lexical(),
    "q1_short_queries": _lexical(queries=f"queries AS (SELECT item_id AS query_id, array_to_string({S.tokens('text')}[1:3], ' ') AS query FROM eval_items)"),
    "b6_search_in_folder": _lexical("picked", "note_path = 'Projects/Heronfield' OR starts_with(note_path, 'Projects/Heronfield/')"),
    "b6_search_with_tag": _lexical("picked", "len(list_filter(coalesce(tags, []), lambda t: lower(t) = 'todo' OR lower(t) = '#todo')) > 0"),
    "b12_search_since": _lexical("picked", "mtime >= 1750000000000"),
    "b13_empty_query": "SELECT item_id AS query_id, '' AS chunk_id FROM eval_items WHERE false",
    "b1_include_folders": "SELECT DISTINCT path FROM vault_files WHERE starts_with(path, 'Projects/') OR starts_with(path, 'Notes/Drafts/')",
    "b2_exclude_folders": "SELECT DISTINCT path FROM vault_files WHERE NOT starts_with(path, 'Archive/') AND NOT starts_with(path, 'Attachments/Scans/')",
    "b2_blank_excludes_all": "SELECT path FROM vault_files WHERE false",
    "b3_path_patterns": "SELECT DISTINCT path FROM vault_files WHERE NOT regexp_matches(path, '(?i)^.*/[^/]*[.]pdf$') AND NOT regexp_matches(path, '(?i)^archive/[^/]*/[^/]*[.]md$') AND NOT contains(lower(path), 'silver')",
    "b4_exclude_tags": f"WITH {S.DISTINCT_CHUNKS} SELECT chunk_id FROM dchunks WHERE len(list_filter(coalesce(tags, []), lambda t: lower(regexp_replace(t, '^#', '')) IN ('meeting', 'todo'))) = 0",
    "b7_chunks_of_note": "SELECT DISTINCT chunk_id, start_line FROM chunks WHERE note_path = 'Journal/Daily Log.md'",
    "j3_vectors_of_chunks": f"WITH {_STORED} SELECT chunk_id, note_path, h FROM stored",
    "m1_cosine": """WITH c AS (SELECT label, i, sum(x) / count(*) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i), m AS (SELECT label, list(x ORDER BY i) AS c FROM c GROUP BY label)
        SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], c), 6) AS sim FROM embeddings JOIN m USING (label)""",
    "q2_vector_search": f"WITH {_STORED}, {_VALID}, {_VQ}, {_VSCORES}, {S.page('vscores', LIMIT, 3)} SELECT query_id, rank, chunk_id, note_path, round(score, 6) AS score FROM page",
    "q3_hybrid_search": f"""WITH {S.DISTINCT_CHUNKS}, {_Q}, {S.scores()}, {S.page('scores', 32, 11, name='lpage')}, {_STORED}, {_VALID},
        vq AS (SELECT 5000 + vec_id // 50 * 7 AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 50 = 0 AND vec_id // 50 < 240), {_VSCORES}, {S.page('vscores', 32, 11, name='vpage')},
        fused AS (SELECT coalesce(l.query_id, v.query_id) AS query_id, coalesce(l.chunk_id, v.chunk_id) AS chunk_id, coalesce(l.note_path, v.note_path) AS note_path, coalesce(1.0 / (60 + l.rank), 0) + coalesce(1.0 / (60 + v.rank), 0) AS score, coalesce(v.rank, 1073741824) AS vr, coalesce(l.rank, 1073741824) AS lr
          FROM lpage l FULL JOIN vpage v ON l.query_id = v.query_id AND l.chunk_id = v.chunk_id AND l.note_path = v.note_path), {S.page('fused', LIMIT, 3, 'round(score, 9) DESC, vr, lr')}
        SELECT query_id, rank, chunk_id, round(score, 9) AS score FROM page""",
    "g14_centroid": "SELECT label, (i - 1)::INT AS i, round(sum(x) / count(*), 6) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i",
    "g15_jaccard": f"WITH {S.DISTINCT_CHUNKS}, c AS (SELECT note_path, start_line, chunk_id, list_distinct({S.tokens('text')}) AS t FROM dchunks), n AS (SELECT chunk_id, t, lag(t) OVER (PARTITION BY note_path ORDER BY start_line, chunk_id) AS u FROM c) SELECT chunk_id, round(CASE WHEN len(t) > 0 AND len(u) > 0 THEN len(list_intersect(t, u)) / len(list_distinct(list_concat(t, u))) ELSE 0 END, 6) AS jaccard FROM n WHERE u IS NOT NULL",
    "q5_search_page": f"""WITH {S.DISTINCT_CHUNKS}, {_Q}, {S.scores()}, {S.page('scores', 16, 6, name='pool')}, {S.page('(SELECT * EXCLUDE (rank) FROM pool)', LIMIT, 3)}
        SELECT query_id, rank, note_path || ' · ' || CASE WHEN crumbs = '' THEN '(top)' ELSE crumbs END || ' · lines ' || (start_line + 1) || '-' || (end_line + 1) || ' · ' || strftime(make_timestamp(mtime * 1000), '%Y-%m-%d') || CASE WHEN starts_with(note_path, 'Memory/Inbox/') THEN ' [PENDING REVIEW]' ELSE '' END AS line
        FROM (SELECT p.query_id, p.rank, p.note_path, c.start_line, c.end_line, c.mtime, array_to_string(list_filter(list_concat(coalesce(heading_path, []), [coalesce(heading, '')]), lambda x: trim(x) <> ''), ' › ') AS crumbs FROM page p JOIN dchunks c USING (chunk_id))""",
}
SQL["q4_foreign_vectors"] = SQL["q3_hybrid_search"].replace("vec_id // 50 < 240)", "false)")
SQL["g19_recall"] = f"""WITH pages AS ({SQL['q1_short_queries']}), truth AS (SELECT query_id, chunk_id FROM ({SQL['q1_lexical_search']}) WHERE rank = 1),
    m AS (SELECT suite, t.query_id, p.rank FROM truth t JOIN eval_items e ON e.item_id = t.query_id LEFT JOIN pages p ON p.query_id = t.query_id AND p.chunk_id = t.chunk_id)
    SELECT suite, count(*) AS queries, round(avg((rank IS NOT NULL)::INT), 6) AS recall, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM m GROUP BY suite"""
SQL["t7_near_duplicates"] = f"""WITH RECURSIVE {S.DISTINCT_CHUNKS}, {_Q}, {S.scores()}, {S.page('scores', 16, 6)}, rows AS (SELECT p.query_id, p.rank, p.chunk_id, list_distinct({S.tokens('text')}) AS t FROM page p JOIN dchunks c USING (chunk_id)),
    kept AS (SELECT query_id, 1 AS step, [{{'c': chunk_id, 't': t}}] AS k FROM rows WHERE rank = 1 UNION ALL
      SELECT k.query_id, k.step + 1, CASE WHEN len(list_filter(k.k, lambda x: len(x.t) > 0 AND len(r.t) > 0 AND len(list_intersect(x.t, r.t)) / len(list_distinct(list_concat(x.t, r.t))) >= 0.8)) > 0 THEN k.k ELSE list_append(k.k, {{'c': r.chunk_id, 't': r.t}}) END FROM kept k JOIN rows r ON r.query_id = k.query_id AND r.rank = k.step + 1),
    last AS (SELECT query_id, max_by(k, step) AS k FROM kept GROUP BY query_id) SELECT query_id, generate_subscripts(k, 1)::INT AS rank, unnest(list_transform(k, lambda x: x.c)) AS chunk_id FROM last"""
_PAGE_TEXT = f"{S.DISTINCT_CHUNKS}, {_Q}, {S.scores()}, {S.page('scores', LIMIT, 3)}, shown AS (SELECT p.query_id, p.rank, p.matched, c.text FROM page p JOIN dchunks c USING (chunk_id))"
SQL["f26_highlight"] = f"WITH {_PAGE_TEXT} SELECT query_id, rank, array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9]+'), lambda x: CASE WHEN list_contains(matched, lower(x)) THEN '<mark>' || x || '</mark>' ELSE x END), '') AS marked FROM shown"
SQL["f5_snippets"] = f"""WITH {_PAGE_TEXT}, flat AS (SELECT query_id, rank, matched, trim(regexp_replace(text, '[\\s\\x1C-\\x1F\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g')) AS t FROM shown),
    runs AS (SELECT query_id, rank, matched, length(t) AS len, unnest(regexp_extract_all(t, '[A-Za-z0-9]+|[^A-Za-z0-9]+')) AS x, generate_subscripts(regexp_extract_all(t, '[A-Za-z0-9]+|[^A-Za-z0-9]+'), 1) AS i FROM flat WHERE length(t) > 220),
    placed AS (SELECT *, sum(length(x)) OVER (PARTITION BY query_id, rank ORDER BY i) AS e FROM runs), m AS (SELECT query_id, rank, e - length(x) AS s, e, greatest(0, least(e - length(x) - 73, len - 220)) AS lo FROM placed WHERE list_contains(matched, lower(x))),
    n AS (SELECT a.query_id, a.rank, a.s, a.lo, count(*) AS n FROM m a JOIN m b ON a.query_id = b.query_id AND a.rank = b.rank AND b.s >= a.lo AND b.e <= a.lo + 220 GROUP BY ALL), best AS (SELECT query_id, rank, lo FROM n QUALIFY row_number() OVER (PARTITION BY query_id, rank ORDER BY n DESC, s) = 1)
    SELECT query_id, rank, CASE WHEN length(t) <= 220 THEN t ELSE CASE WHEN coalesce(lo, 0) > 0 THEN '…' ELSE '' END || trim(t[coalesce(lo, 0) + 1 : coalesce(lo, 0) + 220]) || CASE WHEN coalesce(lo, 0) + 220 < length(t) THEN '…' ELSE '' END END AS snippet FROM flat LEFT JOIN best USING (query_id, rank)"""
