"""Search, fusion, pages, snippets, filters."""

import math
import random

from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import filters, lexical, ranking, vector

CHUNK = "chunk_id string, note_path string, heading string, heading_path array<string>, text string, tags array<string>, aliases array<string>, links array<string>, mtime bigint, run_id int, indexed_at timestamp_ntz, start_line int, end_line int"


def corpus(spark, rows):
    full = [(r["id"], r.get("path", r["id"]), r.get("heading", ""), r.get("up", []), r.get("text", ""), r.get("tags", []), r.get("aliases"), None, r.get("mtime", 1000), 1, None, 0, 0) for r in rows]
    return spark.createDataFrame(full, CHUNK)


def ask(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")


BASE = [
    {"id": "a", "path": "Notes/a.md", "text": "The vault indexing pipeline chunks markdown notes for retrieval."},
    {"id": "b", "path": "Notes/b.md", "text": "Embedding providers include local and compatible backends."},
    {"id": "c", "path": "Projects/x/decisions.md", "heading": "Indexing decision", "text": "# Indexing decision\n\nWe index by section.", "tags": ["Decision"]},
]


def test_lexical_search(spark):
    c = corpus(spark, BASE)
    got = lexical.search(c, ask(spark, "indexing markdown", "", "zebra")).orderBy("query_id", "rank").collect()
    assert got[0]["chunk_id"] == "a" and {r["query_id"] for r in got} == {0}
    assert lexical.search(filters.retrieval_filter(c, tag="#decision"), ask(spark, "indexing")).count() == 1
    assert lexical.search(c.limit(0), ask(spark, "indexing")).count() == 0


def test_names_and_aliases_match_and_endings_do_not(spark):
    c = corpus(
        spark,
        [
            {"id": "q", "path": "Ref/Quartzine Protocol.md", "text": "generic words"},
            {"id": "d", "path": "x/scan.pdf", "text": "other words"},
            {"id": "p", "path": "x/other.md", "text": "a pdf invoice"},
            {"id": "al", "path": "x/z.md", "text": "more", "aliases": ["bramblewood"]},
        ],
    )
    got = {(r["query_id"], r["chunk_id"]): r["matched"] for r in lexical.search(c, ask(spark, "quartzine protocol", "pdf invoice", "bramblewood")).collect()}
    assert got == {(0, "q"): ["protocol", "quartzine"], (1, "p"): ["invoice", "pdf"], (2, "al"): ["bramblewood"]}


def test_one_note_does_not_flood_a_page(spark):
    c = corpus(spark, [{"id": f"l{i}", "path": "Notes/long.md", "text": "kettle kettle"} for i in range(5)] + [{"id": "o", "path": "Notes/other.md", "text": "kettle and many other words in here to rank it low"}])
    got = [r["chunk_id"] for r in lexical.search(c, ask(spark, "kettle"), 4).orderBy("rank").collect()]
    assert len(got) == 4 and "o" in got


def test_diversified_equals_the_greedy_fill(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for q in range(60):
        page = [(q, f"{i:02d}", f"n{rng.randrange(4)}", float(rng.randrange(8))) for i in range(rng.randrange(1, 15))]
        rows += page
        ordered = sorted(page, key=lambda r: (-r[3], r[1]))
        limit, kept, rest, seen = 5, [], [], {}
        for r in ordered:
            seen[r[2]] = seen.get(r[2], 0) + 1
            (kept if seen[r[2]] <= 2 else rest).append(r[1])
        want[q] = (kept + rest)[:limit]
    df = spark.createDataFrame(rows, "query_id int, chunk_id string, note_path string, score double")
    got = {}
    for r in ranking.diversified(df, 5, 2).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert got == want


def test_near_duplicates(spark):
    df = spark.createDataFrame([(1, 1, "a", ["x", "y"]), (1, 2, "b", ["y", "x"]), (1, 3, "c", ["z"]), (1, 4, "d", []), (1, 5, "e", [])], "query_id int, rank int, chunk_id string, t array<string>")
    assert [r["chunk_id"] for r in ranking.without_near_duplicates(df, "t").orderBy("rank").collect()] == ["a", "c", "d", "e"]


def test_term_spans_and_snippets():
    assert ranking.term_spans("restart art", ["art"]) == [(8, 11)]
    assert ranking.term_spans("cat dog cat", ["cat"]) == [(0, 3), (8, 11)]
    text = "filler " * 60 + "alpha beta alpha " + "filler " * 60
    s = ranking.snippet_of(text, ["alpha", "beta"])
    assert "alpha beta alpha" in s and s[0] == s[-1] == "…" and "\n" not in s
    assert ranking.marked("a cat", ["cat"]) == "a <mark>cat</mark>"


def test_vector_search_and_hybrid(spark):
    stored = spark.createDataFrame([("a", "a", [1.0, 0.0, 0.0]), ("b", "b", [0.0, 1.0, 0.0]), ("c", "c", [0.0, 0.0, 1.0]), ("d", "d", [1.0]), ("z", "z", [0.0, 0.0, 0.0])], "chunk_id string, note_path string, v array<double>")
    q = spark.createDataFrame([(0, [0.9, 0.1, 0.0])], "query_id int, qv array<double>")
    assert [r["chunk_id"] for r in vector.search(stored, q).orderBy("rank").collect()] == ["a", "b"]
    c = corpus(spark, [{"id": "a", "text": "apple pie"}, {"id": "b", "text": "banana split"}, {"id": "c", "text": "apple tart"}])
    both = spark.createDataFrame([(0, "apple", [0.0, 1.0, 0.0]), (1, "apple", None)], "query_id int, query string, qv array<double>")
    pages = {}
    for r in vector.hybrid(c, stored, both).orderBy("query_id", "rank").collect():
        pages.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert "b" in pages[0] and pages[1] == [r["chunk_id"] for r in lexical.search(c, ask(spark, "apple")).orderBy("rank").collect()]


def test_filters(spark):
    paths = spark.createDataFrame([("Notes/a.md",), ("Private/secret.md",), ("a/b/secret.md",), ("top.md",), ("Notesx/c.md",)], "path string")

    def left(**rules):
        return {r[0] for r in paths.where(filters.eligible(F.col("path"), **rules)).collect()}

    assert left(include=["Notes", " "]) == {"Notes/a.md"}
    assert "Private/secret.md" not in left(exclude=["Private"]) and left(exclude=[""]) == set()
    assert left(patterns=["**/SECRET.md"]) == {"Notes/a.md", "top.md", "Notesx/c.md"}
    assert "a/b/secret.md" in left(patterns=["*.md"]) and "top.md" not in left(patterns=["*.md"])
    assert left(patterns=["otesx"]) == left() - {"Notesx/c.md"}
    assert filters.pattern_regex("*" * 13) is None


def test_text_functions(spark):
    def one(expr):
        return spark.range(1).select(expr.alias("x")).first()["x"]

    assert one(T.link_key(F.lit(" folder\\Some Note.MD #h|x"))) == "some note"
    assert one(T.link_key(F.lit("#h"))) == "" and one(T.link_key(F.lit(None).cast("string"))) is None
    assert one(T.sentences(F.lit("Hello world. Second sentence! Third?\n# Heading\n- item one\n- item two"))) == ["Hello world.", "Second sentence!", "Third?", "Heading", "item one", "item two"]
    assert one(T.fnv1a(F.lit("a"))) == "e40c292c"
    assert one(T.tokens(F.lit("The café's API-v2"))) == ["caf", "api", "v2"]
    assert one(T.project_folder(F.lit(" a/b:c.. "))) == "a-bc" and one(T.project_folder(F.lit(".."))) is None
    assert one(T.day_label(F.lit(None).cast("long"))) == ""
    assert one(T.title_words(F.lit("action-item"))) == "Action Item"


def test_project_context_takes_the_named_files(spark, tmp_path):
    from marginalia.plans import notes

    paths = ["Memory/Global/a.md", "Memory/Global/b.md", "Memory/Global/c.md", "Memory/Global/profile.md", "Projects/x/tasks.md", "Projects/x/overview.md", "Projects/x/other.md", "Projects/y/open-questions.md", "Projects/x/sub/tasks.md", "Projects/tasks.md", "Notes/overview.md"]
    corpus(spark, [{"id": p, "path": p, "text": "y" * (2490 if p.endswith("overview.md") else 20)} for p in paths]).write.parquet(f"{tmp_path}/chunks.parquet")
    runs = spark.createDataFrame([(1, None, None, "succeeded")], "run_id int, started_at timestamp_ntz, finished_at timestamp_ntz, status string")
    runs.write.parquet(f"{tmp_path}/index_runs.parquet")
    got = {(r["folder"], r["ord"], r["note_path"], r["kept"], r["chars"]) for r in notes.q9_project_context(spark, str(tmp_path)).collect()}
    assert got == {
        ("Memory/Global", 0, "Memory/Global/profile.md", True, 20),
        ("Projects/x", 0, "Projects/x/overview.md", True, 2490),
        ("Projects/x", 3, "Projects/x/tasks.md", False, None),
        ("Projects/y", 4, "Projects/y/open-questions.md", True, 20),
    }


def test_vector_pages_equal_brute_force_over_many_batches_and_blocks(spark, monkeypatch):
    """Notes with many near chunks, ties, invalid vectors of every kind, queries in several blocks."""
    rng = random.Random(3)
    hot = [rng.gauss(0, 1) for _ in range(6)]
    rows = [(f"c{i}", f"n{i % 9 if i % 3 else 0}", [round(h + rng.gauss(0, 0.05 if i % 3 == 0 else 2), 1) for h in hot]) for i in range(900)]
    bad = [("x1", "n", None), ("x2", "n", []), ("x3", "n", [0.0] * 6), ("x4", "n", [1.0] * 5), ("x5", "n", [float("nan")] * 6), ("x6", "n", [None] * 6)]
    stored = spark.createDataFrame([*rows, *bad], "chunk_id string, note_path string, v array<double>").repartition(5)
    asked = [(q, [h + rng.gauss(0, 0.4) for h in hot]) for q in range(12)] + [(50, [0.0] * 6), (51, None), (None, hot)]
    monkeypatch.setattr(vector, "MOST_QUERIES", 6)
    got = {(r["query_id"], r["rank"]): r["chunk_id"] for r in vector.search(stored, spark.createDataFrame(asked, "query_id int, qv array<double>"), 8, 3).collect()}
    want = {}
    for q, v in asked[:12]:
        norm = math.sqrt(sum(x * x for x in v))
        scored = sorted((-round(sum(a * b for a, b in zip(v, w, strict=True)) / norm / math.sqrt(sum(x * x for x in w)), 6), c, n) for c, n, w in rows if sum(a * b for a, b in zip(v, w, strict=True)) > 0)
        first, behind, seen = [], [], {}
        for _, c, n in scored:
            seen[n] = seen.get(n, 0) + 1
            (first if seen[n] <= 3 else behind).append(c)
        want |= {(q, i + 1): c for i, c in enumerate((first + behind)[:8])}
    assert got == want


def test_written_index_gives_the_same_pages(spark):
    rows = [(f"{n}::{i}", n, "H" if i else None, ["Up"], f"kettle word{i} {'lamp ' * (i % 4)} {n}", i, i, ["t"], ["Alias"], None, i, 1, None) for n in ("a.md", "b.md", "kettle.md") for i in range(9)]
    c = spark.createDataFrame(rows, "chunk_id string, note_path string, heading string, heading_path array<string>, text string, start_line int, end_line int, tags array<string>, aliases array<string>, links array<string>, mtime bigint, run_id int, indexed_at timestamp")
    index = lexical.build(c, buckets=3)
    q = ask(spark, "kettle lamp", "alias up", "nothing", "word3")

    def pages(x):
        return sorted(map(str, lexical.search(x, q).withColumn("score", F.round("score", 9)).collect()))

    assert pages(index) == pages(c) and len(pages(c)) > 10
    some = F.col("note_path") == "a.md"
    assert pages(index.where(some)) == pages(c.where(some)) and index.where(some).n == 9


def test_fnv_hashes_run_over_utf16_units(spark):
    def fnv(s):
        h = 2166136261
        raw = s.encode("utf-16-le")
        for i in range(0, len(raw), 2):
            h = ((h ^ int.from_bytes(raw[i : i + 2], "little")) * 16777619) & 0xFFFFFFFF
        return f"{h:x}"

    texts = ["", "a", "Notes/é.md", "emoji 😀 字"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.fnv1a(F.col("t"))).collect()
    assert [r[0] for r in got] == [fnv(t) for t in texts]
