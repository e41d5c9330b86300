"""Pieces of SQL that several oracles share."""

from marginalia.functions.text import STOP_WORDS, SUMMARY_STOP_WORDS


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


WS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def raw_tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda t: length(t) >= 2)"


def tokens(x: str) -> str:
    return f"list_filter({raw_tokens(x)}, lambda t: NOT list_contains({_list(STOP_WORDS)}, t))"


def summary_tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9][a-z0-9''-]*'), lambda t: NOT list_contains({_list(SUMMARY_STOP_WORDS)}, t))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+', ' ', 'g')"


def link_key(x: str) -> str:
    last = f"coalesce(list_filter(string_split(replace(regexp_replace({x}, '(?s)[#|].*', ''), chr(92), '/'), '/'), lambda s: s <> '')[-1], '')"
    return f"CASE WHEN {x} IS NOT NULL THEN lower({strip(f"regexp_replace({strip(last)}, '(?i)[.]md$', '')")}) END"


DISTINCT_CHUNKS = """dchunks AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY run_id DESC, indexed_at DESC) AS rn FROM chunks WHERE chunk_id IS NOT NULL) WHERE rn = 1)"""

FILE_STATES = """states AS (
  SELECT path, max_by(mtime, listed_at) AS mtime, max_by(removed_at IS NULL, listed_at) AS live, min(listed_at) AS first_listed FROM vault_files GROUP BY path)"""

CURRENT_VECTORS = """cvectors AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY run_id DESC, h DESC) AS rn FROM vectors WHERE chunk_id IS NOT NULL) WHERE rn = 1)"""


def scores(chunks: str = "dchunks", queries: str = "queries") -> str:
    """CTEs up to ``scores`` (query_id, chunk_id, note_path, score, matched) over CTEs of distinct chunks and of queries (query_id, query)."""
    fields = tokens("array_to_string(list_concat([regexp_replace(string_split(note_path, '/')[-1], '[.][^.]+$', '')], list_concat(coalesce(aliases, []), coalesce(heading_path, []))), ' ')")
    return f"""
asked AS (SELECT DISTINCT query_id, unnest({tokens('query')}) AS term FROM {queries}),
own AS (SELECT chunk_id, note_path, {tokens('text')} AS toks, {tokens("coalesce(heading, '')")} AS heads, {fields} AS fields FROM {chunks}),
totals AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM own),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(toks) AS term FROM own) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
ft AS (SELECT DISTINCT chunk_id, unnest(fields) AS term FROM own),
facts AS (SELECT coalesce(a.chunk_id, f.chunk_id) AS chunk_id, coalesce(a.term, f.term) AS term, coalesce(tf, 0) AS tf FROM tf a FULL JOIN (SELECT * FROM ft WHERE term IN (SELECT term FROM asked)) f ON a.chunk_id = f.chunk_id AND a.term = f.term),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
parts AS (SELECT f.chunk_id, o.note_path, f.term, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) * CASE WHEN tf > 0 THEN tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(o.toks) / avgdl)) * CASE WHEN list_contains(heads, f.term) THEN 1.15 ELSE 1 END ELSE 1 END AS part
  FROM facts f JOIN own o USING (chunk_id) CROSS JOIN totals LEFT JOIN dfs ON dfs.term = f.term),
scores AS (SELECT query_id, chunk_id, note_path, sum(part) AS score, list_sort(list(DISTINCT p.term)) AS matched FROM parts p JOIN asked q ON q.term = p.term GROUP BY ALL HAVING sum(part) > 0)"""


def page(source: str, limit: int, cap: int, order: str = "round(score, 6) DESC, chunk_id", name: str = "page") -> str:
    return f"""
{name}_n AS (SELECT *, row_number() OVER (PARTITION BY query_id, note_path ORDER BY {order}) AS note_n FROM {source}),
{name} AS (SELECT * EXCLUDE (note_n) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY note_n > {cap}, {order}) AS rank FROM {name}_n) WHERE rank <= {limit})"""
