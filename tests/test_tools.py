"""Memory files, the ten tools, the listener, modes, measures, refresh and caches."""

import json
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from marginalia.control import files, listener, tools
from marginalia.operators import chunker, lexical, measure, modes, ordered, refresh
from marginalia.session import materialize
from marginalia.sources import vault
from marginalia.streaming import limits


@pytest.fixture
def memory(spark, tmp_path):
    return files.MemoryFiles(spark, str(tmp_path / "vault"), allow_direct=True)


def test_files_are_read_written_and_appended(memory):
    assert memory.read("a/b.md") is None and memory.create("a/b.md", "x") and not memory.create("a/b.md", "y")
    memory.append("a/b.md", "\nmore")
    memory.append("new.md", "é")
    assert memory.read("a/b.md") == "x\nmore" and memory.read("new.md") == "é"
    assert sorted(s.getPath().getName() for s in memory._fs.listStatus(memory._at("a")) if not s.getPath().getName().startswith(".")) == ["b.md"]


def test_inbox_takes_each_memory_once_and_lets_go_of_it(memory):
    one = {"content": "Use  spaces\n\nContent:\nStatus: x", "entry_type": "decision", "project": "P/q", "tags": ["#a b"], "source": "s"}
    assert memory.propose(one) and not memory.propose(one | {"content": "use SPACES content: status: X", "source": "other"})
    assert memory.propose({"content": "second"}) and memory.propose(one | {"entry_type": "task"})
    assert memory.read(memory.inbox).startswith(files.INBOX_HEADER)
    found = memory.entries()
    assert [x["entry_type"] for x in found] == ["decision", "note", "task"] and found[0]["content"] == one["content"] and found[0]["tags"] == ["a-b"]
    where = memory.apply(found[0])
    assert where == "Memory/Projects/P-q/decisions.md" and "Use  spaces" in memory.read(where)
    with pytest.raises(files.Refused):
        memory.apply(found[0])
    assert memory.read(where).count("Use  spaces") == 1
    memory.apply(found[0] | {"raw": memory.entries()[1]["raw"]})
    assert memory.read(where).count("Use  spaces") == 2 and "\n\n## " in memory.read(where)
    memory.discard(memory.entries()[0])
    assert memory.entries() == [] and memory.read(memory.inbox) == files.INBOX_HEADER


def test_apply_writes_the_destination_before_the_inbox(memory, monkeypatch):
    memory.propose({"content": "keep me"})
    entry = memory.entries()[0]
    whole = memory.write

    def fails(path, text):
        if path != memory.inbox:
            raise OSError("full")
        whole(path, text)

    monkeypatch.setattr(memory, "write", fails)
    with pytest.raises(OSError):
        memory.apply(entry)
    assert len(memory.entries()) == 1


def test_direct_writes_are_gated_and_stay_below_the_root(spark, tmp_path, memory):
    assert memory.direct("Global/profile.md", {"content": "me"}) == "Memory/Global/profile.md" and memory.direct("Global/profile.md", {"content": "again"})
    assert memory.read("Memory/Global/profile.md").count("## Pending Memory: ") == 2
    with pytest.raises(ValueError):
        memory.direct("../out.md", {"content": "x"})
    with pytest.raises(files.Refused):
        files.MemoryFiles(spark, str(tmp_path / "v2")).direct("a.md", {"content": "x"})


def test_scaffold_projects_and_sessions(memory):
    assert len(memory.scaffold()) == 3 and memory.scaffold() == []
    home = memory.project(" My: Project ")
    assert home == "Memory/Projects/My Project" and memory.read(home + "/tasks.md").startswith("# Tasks")
    memory.write(home + "/tasks.md", "mine")
    session = memory.start_session("My Project", "2026-01-02-0930")
    memory.end_session(session, " done ")
    assert memory.read(home + "/tasks.md") == "mine" and memory.read(session).endswith("## Session closed\n\ndone\n")
    with pytest.raises(files.Refused):
        memory.project(" .. ")


NOTES = [
    ("Memory/Global/profile.md", "# Profile\nI like tea.", 1),
    ("Memory/Projects/Zed/overview.md", "# Zed\nThe [[Kettle]] project boils water. It is about heat.", 2),
    ("Memory/Projects/Zed/Sessions/2026-01-02.md", "# Session\nWe met.", 3),
    ("Kettle.md", "# Kettle\nA kettle boils water.\n\n## Parts\nLid and spout. Lid is round.", 1_700_000_000_000),
]


@pytest.fixture(scope="module")
def chunks(spark):
    return chunker.chunk_notes(spark.createDataFrame(NOTES, "note_path string, content string, mtime bigint")).withColumn("run_id", F.lit(1)).withColumn("indexed_at", F.lit(None).cast("timestamp")).cache()


@pytest.fixture
def desk(spark, chunks, memory):
    index = lexical.as_index(chunks)
    return tools.Desk(chunks, index, memory, lambda: (len(NOTES), chunks, index), clock=lambda: 1_700_000_100.0)


def call(server, name, **arguments):
    r = server.answer({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": arguments}})["result"]
    return r["isError"], r["content"][0]["text"]


def test_the_ten_tools(desk):
    s = tools.server(desk)
    assert len(s.answer({"jsonrpc": "2.0", "id": 1, "method": "tools/list"})["result"]["tools"]) == 10
    bad, text = call(s, "search_vault_memory", query="kettle water")
    assert not bad and text.startswith("1. Kettle.md · Kettle") and "overview.md" in text
    assert "Kettle.md" not in call(s, "search_vault_memory", query="water", project="Zed")[1].replace("[[Kettle]]", "")
    assert call(s, "search_vault_memory", query="kettle", sinceDays=1) == (False, text) or "Kettle.md" in call(s, "search_vault_memory", query="kettle", sinceDays=1)[1]
    assert call(s, "search_vault_memory", query="zzz")[1] == 'No results for "zzz".'
    assert call(s, "search_vault_memory")[0] and call(s, "search_vault_memory", query="x", other=1)[0] and call(s, "search_vault_memory", query="x", limit=99)[0]
    assert "review" in call(s, "add_memory", content="Tea is good", type="odd")[1] and "already" in call(s, "add_memory", content="tea  IS good")[1]
    assert call(s, "add_memory", content="x", tags=["t" * 200])[0]
    assert "boils" in call(s, "get_project_context", project="Zed")[1] and "tea" in call(s, "get_global_context")[1]
    assert call(s, "list_projects") == (False, "Zed") and call(s, "get_recent_sessions", project="Zed")[1].endswith("2026-01-02.md")
    assert call(s, "summarize_note", path="Kettle.md", maxSentences=2)[1].count("•") == 2
    assert call(s, "summarize_note", path="not/indexed.md") == (True, "not in the index: not/indexed.md")
    assert call(s, "get_note_context", path="Kettle.md", outline=True)[1] == "1-3 Kettle\n4-5 Kettle › Parts"
    assert "spout" in call(s, "get_note_context", path="Kettle.md", startLine=4)[1] and "A kettle" not in call(s, "get_note_context", path="Kettle.md", startLine=4)[1]
    assert call(s, "find_related_notes", path="Kettle.md")[1] == "← Memory/Projects/Zed/overview.md"
    assert call(s, "reindex_vault")[1].startswith("Reindexed: 4 note(s)") and call(s, "reindex_vault")[0]


def test_listener_refuses_and_answers(desk):
    with pytest.raises(ValueError):
        listener.listener(tools.server(desk), "t", "0.0.0.0")
    http = listener.listener(tools.server(desk), "secret")
    threading.Thread(target=http.serve_forever, daemon=True).start()

    def post(body, token="secret", method="POST"):
        r = urllib.request.Request(f"http://127.0.0.1:{http.server_address[1]}/", body, {"Content-Type": "application/json", "Authorization": f"Bearer {token}"}, method=method)
        try:
            with urllib.request.urlopen(r, timeout=20) as x:
                return x.status, json.loads(x.read() or b"null")
        except urllib.error.HTTPError as x:
            return x.code, None

    assert post(b'{"jsonrpc":"2.0","id":1,"method":"ping"}') == (200, {"jsonrpc": "2.0", "id": 1, "result": {}})
    assert post(b"{", "wrong")[0] == 401 and post(b"{}", method="PUT")[0] == 405
    assert post(b"{")[1]["error"]["code"] == -32700 and post(b'{"jsonrpc":"2.0","method":"ping"}')[0] == 202
    http.shutdown()


def test_modes(spark, chunks):
    index = lexical.as_index(chunks)
    stored = chunks.select("chunk_id", "note_path", F.when(F.col("note_path") == "Kettle.md", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("v"))
    q = spark.createDataFrame([(1, "tea")], "query_id int, query string")

    def fails(texts):
        raise RuntimeError

    def first(configured, provider, stored_identity="id"):
        return [r["note_path"] for r in modes.search(index, stored, q, configured, provider, stored_identity, "id").orderBy("rank").collect()]

    near = lambda texts: [[1.0, 0.0]] * len(texts)
    assert first("vector", None) == first("lexical", near) == first("hybrid", fails) == first("hybrid", near, "another") == first("hybrid", near, None) == ["Memory/Global/profile.md"]
    assert first("vector", fails) == [] and first("vector", near, "another") == []
    assert first("vector", near)[0] == "Kettle.md" and {"Kettle.md", "Memory/Global/profile.md"} <= set(first("hybrid", near))
    with pytest.raises(TimeoutError):
        modes.within(0.05, lambda: threading.Event().wait(1))
    assert modes.within(5, lambda: 3) == 3


def test_a_newer_search_drops_the_older(spark):
    newest = modes.Newest(spark)
    begun, out = threading.Event(), {}

    def slow():
        begun.set()
        return threading.Event().wait(1)

    t = threading.Thread(target=lambda: out.update(old=newest.run(slow)))
    t.start()
    begun.wait()
    assert newest.run(lambda: 7) == (True, 7)
    t.join()
    assert out["old"] == (False, None)


def test_measures(spark):
    df = spark.createDataFrame([("a", x) for x in (5, 1, 3, 3, None, 9)] + [("b", 4), (None, 2)], "g string, x int")
    got = {r["g"]: (r["p50"], r["p95"], r["mean"]) for r in measure.percentiles(df, "g", "x").collect()}
    assert got == {"a": (3, 9, 4.2), "b": (4, 4, 4.0), None: (2, 2, 2.0)}
    pages = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 9, "y"), (3, 3, "z")], "query_id int, rank int, chunk_id string")
    truth = spark.createDataFrame([(1, "y", "k"), (1, "q", "k"), (2, "y", "k"), (3, "z", "l")], "query_id int, chunk_id string, kind string")
    got = {r["kind"]: (r["queries"], r["recall"], r["mrr"]) for r in measure.recall_and_rank(pages, truth, "kind").collect()}
    assert got == {"k": (2, 0.25, 0.25), "l": (1, 1.0, 1 / 3)}


def test_refresh_cuts_only_what_changed(spark):
    old = chunker.chunk_notes(spark.createDataFrame([("a.md", "# A\nx", 1), ("b.md", "# B\ny", 1), ("gone.md", "z", 1)], "note_path string, content string, mtime bigint"))
    notes = spark.createDataFrame([("a.md", None, 1), ("b.md", "# B\nnew\n# C\nz", 2), ("n.md", "fresh", 5)], "note_path string, content string, mtime bigint")
    new, change = refresh.refresh(notes, old)
    assert {r["chunk_id"]: r["text"] for r in new.collect()} == {"a.md::0": "# A\n\nx", "b.md::0": "# B\n\nnew", "b.md::1": "# C\n\nz", "n.md::0": "fresh"}
    assert refresh.counts(change, new, True).first().asDict() == {"added": 1, "updated": 1, "removed": 1}
    assert refresh.counts(change, new, False).first().asDict() == {"added": 4, "updated": 0, "removed": 0}
    forced = spark.createDataFrame([("a.md",)], "note_path string")
    assert {r["note_path"]: r["change"] for r in refresh.refresh(notes, old, forced)[1].collect()}["a.md"] == "updated"


def test_extraction_cache_and_attachment_scan(spark, tmp_path):
    listing = spark.createDataFrame([("a.pdf", 1, 10), ("b.pdf", 2, 10), ("big.pdf", 1, 1 << 40), ("none.pdf", 1, 5)], "path string, mtime bigint, size_bytes bigint")
    seen = []

    def extract(f):
        seen.append(sorted(r["path"] for r in f.collect()))
        return f.select("path", "mtime", F.when(F.col("path") != "none.pdf", F.concat(F.lit("text of "), "path")).alias("text"))

    cache = refresh.ExtractionCache(spark, str(tmp_path / "cache"))
    assert not cache.persist() and not cache.consume_reset()
    notes, looked = vault.scan_attachments(listing, cache, extract)
    assert {r["note_path"] for r in notes.collect()} == {"a.pdf", "b.pdf"} and not any(r["hit"] for r in looked.collect())
    assert cache.persist() and not cache.persist() and seen[-1] == ["a.pdf", "b.pdf", "none.pdf"]
    again = refresh.ExtractionCache(spark, str(tmp_path / "cache"))
    changed = listing.withColumn("mtime", F.when(F.col("path") == "b.pdf", 3).otherwise(F.col("mtime")))
    notes, _ = vault.scan_attachments(changed, again, extract)
    assert seen[-1] == ["b.pdf"] and notes.count() == 2
    again.prune(changed.where("path <> 'a.pdf'"))
    assert again.persist() and "a.pdf" not in {r["path"] for r in again.rows.collect()}
    other = refresh.ExtractionCache(spark, str(tmp_path / "cache"), version=99)
    assert other.consume_reset() and not other.consume_reset() and other.rows.count() == 0


def test_written_files_are_scanned(spark, tmp_path):
    rows = spark.createDataFrame([("Notes/a b.md", "one"), ("Notes/Draft/ü.md", "two #todo"), ("x.txt", "no")], "path string, content string")
    assert vault.write_files(rows, str(tmp_path / "v")) == 3
    got = {r["note_path"]: r["content"] for r in vault.scan_notes(spark, str(tmp_path / "v"), exclude_tags=["todo"]).collect()}
    assert got == {"Notes/a b.md": "one"}


def test_file_events(spark):
    rows = [("a.md", 1, "2025-01-01", None), ("a.md", 1, "2025-01-02", None), ("a.md", 2, "2025-01-03", None), ("a.md", 2, "2025-01-04", "x"), ("a.md", 2, "2025-01-05", None), ("b.md", 1, "2025-01-01", "x"), ("Memory/Index/c", 1, "2025-01-01", None)]
    df = spark.createDataFrame([*rows, rows[0]], "path string, mtime bigint, listed_at string, removed_at string")
    got = [(r["path"], r["at"][-1], r["event"]) for r in limits.file_events(df, ["Memory/Index"]).orderBy("path", "at").collect()]
    assert got == [("a.md", "1", "create"), ("a.md", "3", "modify"), ("a.md", "4", "delete"), ("a.md", "5", "create")]


def test_running_totals_and_previous_rows_of_groups_in_parts(spark, monkeypatch):
    rows = [("hot", i, i % 7) for i in range(300)] + [("cold", 1, 5), (None, 1, 2), (None, 2, None)]
    df = spark.createDataFrame(rows, "g string, i int, s int").repartition(5)
    monkeypatch.setattr(ordered, "materialize", lambda x, label: materialize(x.repartition(3).drop("__part").repartitionByRange(4, "g", "i").withColumn("__part", F.spark_partition_id()), label))
    got = {(r["g"], r["i"]): (r["n"], r["before_s"]) for r in ordered.running(df, ["g"], ["i"], s="s").collect()}
    assert got == {(g, i): (i + (g == "hot"), sum(x or 0 for h, j, x in rows if h == g and j < i)) for g, i, _ in rows}
    held = ordered.placed(df, ["g"], ["i"])
    assert held.where("g = 'hot'").select("__part").distinct().count() > 1
    before = {(r["g"], r["i"]): r["previous"]["i"] if r["previous"] else None for r in ordered.previous(held, ["g"], ["i"], "i").collect()}
    assert before == {(g, i): i - 1 if (g, i - 1) in {(h, j) for h, j, _ in rows} else None for g, i, _ in rows}
    assert ordered.running(df.limit(0), ["g"], ["i"], s="s").count() == 0


def test_importing_needs_no_session():
    import subprocess
    import sys

    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) > 90"], check=True)


def test_commands(spark, tmp_path, capsys):
    from marginalia.__main__ import main

    home, store = str(tmp_path / "vault"), str(tmp_path / "store")
    vault.write_files(spark.createDataFrame([(p, c) for p, c, _ in NOTES], "path string, content string"), home)
    assert main(["search", home, "--store", store, "--query", "kettle"]) == 1
    assert main(["index", home, "--store", store]) == 0
    assert main(["search", home, "--store", store, "--query", "kettle", "--limit", "2"]) == 0
    out = capsys.readouterr().out
    assert "no index" in out and "4 notes" in out and "1. Kettle.md" in out
