"""The ten tools over an index and a memory folder, each a Spark query behind argument checks and a rate limit."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.control.files import MemoryFiles
from marginalia.control.rpc import Server, Tool
from marginalia.functions import text as T
from marginalia.operators import context, filters, lexical, links, memory, modes, ranking, summarize
from marginalia.streaming.limits import cooldown_step, window_step

#: Limits of the tools (fixed values).
MOST_RESULTS, DEFAULT_RESULTS, MOST_QUERY, MINUTE = 25, 8, 2000, 60_000_000
_PATH = {"type": "string", "description": "Path of a note of the index."}


@dataclass
class Desk:
    """What the tools work on. ``reindex`` builds the index anew and returns (notes, chunks, index)."""

    chunks: DataFrame
    index: lexical.Index
    files: MemoryFiles
    reindex: Callable[[], tuple[int, DataFrame, lexical.Index]] | None = None
    root: str = "Memory"
    clock: Callable[[], float] = time.time
    limits: dict[str, deque] = field(default_factory=dict)

    def admit(self, name: str, step: Callable[[deque, int], bool]) -> None:
        if not step(self.limits.setdefault(name, deque()), int(self.clock() * 1e6)):
            raise ValueError(f"too many calls of {name}: try again later")


def _text(args: dict, name: str, most: int, needed: bool = False) -> str:
    value = args.get(name, "")
    if not isinstance(value, str) or len(value) > most or (needed and not value.strip()):
        raise ValueError(f"{name} must be a text of at most {most} characters")
    return value


def _number(args: dict, name: str, default: int, low: int, high: int) -> int:
    value = args.get(name, default)
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not low <= value <= high:
        raise ValueError(f"{name} must be a number from {low} to {high}")
    return int(value)


def _texts(args: dict, name: str, most: int, longest: int) -> list[str]:
    value = args.get(name, [])
    if not isinstance(value, list) or len(value) > most or any(not isinstance(x, str) or len(x) > longest for x in value):
        raise ValueError(f"{name} must be a list of at most {most} texts")
    return value


def search_vault_memory(desk: Desk, args: dict) -> str:
    query, limit = _text(args, "query", MOST_QUERY, True), _number(args, "limit", DEFAULT_RESULTS, 1, MOST_RESULTS)
    days = _number(args, "sinceDays", 0, 0, 36_500)
    project = _text(args, "project", 200)
    where = filters.retrieval_condition(_text(args, "folder", 1000) or None, _text(args, "tag", 200) or None, f"{desk.root}/Projects/{project}" if project else None, int((desk.clock() - days * 86400) * 1000) if days else None)
    asked = desk.chunks.sparkSession.createDataFrame([(0, query)], "query_id int, query string")
    pool = lexical.search(desk.index.where(where), asked, 2 * limit)
    text = desk.chunks.select("chunk_id", "text", "heading", "heading_path", "start_line", "end_line", "mtime")
    found = pool.join(text, "chunk_id")
    kept = ranking.without_near_duplicates(found.withColumn("toks", T.tokens(F.col("text"))), "toks").select("query_id", "chunk_id")
    page = ranking.diversified(found.join(kept, ["query_id", "chunk_id"], "left_semi").drop("rank"), limit)
    label = F.concat("note_path", F.lit(" · "), T.breadcrumb(F.col("heading_path"), F.col("heading")), F.lit(" · "), T.line_range(F.col("start_line"), F.col("end_line")), F.lit(" · "), T.day_label(F.col("mtime")))
    pending = F.when(F.col("note_path").startswith(f"{desk.root}/Inbox/"), " [PENDING REVIEW]").otherwise("")
    rows = page.select("rank", F.concat(label, pending, F.lit("\n"), ranking.snippet("text", "matched")).alias("line")).orderBy("rank").collect()
    return "\n\n".join(f"{r['rank']}. {r['line']}" for r in rows) or f'No results for "{query}".'


def add_memory(desk: Desk, args: dict) -> str:
    entry = {
        "content": _text(args, "content", memory.MOST_CONTENT, True),
        "entry_type": t if (t := _text(args, "type", 40)) in memory.TYPES else "note",
        "project": _text(args, "project", 200) or None,
        "source": _text(args, "source", 200) or "MCP",
        "origin_tool": "mcp:add_memory",
        "tags": _texts(args, "tags", memory.MOST_TAGS, memory.LONGEST_TAG),
        "related_paths": _texts(args, "relatedPaths", memory.MOST_PATHS, memory.LONGEST_PATH),
    }
    return f"Proposed in {desk.files.inbox} for review." if desk.files.propose(entry) else f"The same memory already waits for review in {desk.files.inbox}; not added again."


def _context(desk: Desk, folder: str, names: list[str], args: dict) -> str:
    most = _number(args, "maxChars", context.DEFAULT_CHARS, context.LEAST_CHARS, context.MOST_CHARS)
    notes = context.note_contents(desk.chunks, context.named_files(folder=folder, names=names), most)
    rows = context.assembled_context(notes, names, folder, most).orderBy("ord").collect()
    left = [r["note_path"] for r in rows if not r["kept"]]
    parts = [f"## {r['note_path']}\n\n{r['shown']}" for r in rows if r["kept"]]
    return "\n\n---\n\n".join([*parts, *([f"Left out: {', '.join(left)}"] if left else [])]) or f"Nothing in {folder}."


def get_project_context(desk: Desk, args: dict) -> str:
    name = _text(args, "project", 200, True)
    folder = desk.chunks.sparkSession.range(1).select(T.project_folder(F.lit(name))).first()[0]
    if not folder:
        raise ValueError("a project needs a name")
    return _context(desk, f"{desk.root}/Projects/{folder}", context.PROJECT_FILES, args)


def get_global_context(desk: Desk, args: dict) -> str:
    return _context(desk, f"{desk.root}/Global", context.GLOBAL_FILES, args)


def list_projects(desk: Desk, args: dict) -> str:
    names = [r["project"] for r in context.projects(desk.chunks.select(F.col("note_path").alias("path")).distinct(), f"{desk.root}/Projects").orderBy("project").limit(1000).collect()]
    return "\n".join(names) or "No projects."


def get_recent_sessions(desk: Desk, args: dict) -> str:
    limit = _number(args, "limit", context.SESSIONS, 1, context.MOST_SESSIONS)
    project = _text(args, "project", 200, True)
    paths = context.recent(desk.chunks.select("note_path").distinct(), f"{desk.root}/Projects/{project}/Sessions", limit).collect()
    return "\n".join(r["note_path"] for r in paths) or "No sessions."


def reindex_vault(desk: Desk, args: dict) -> str:
    if desk.reindex is None:
        raise ValueError("indexing is off")
    desk.admit("reindex_vault", cooldown_step(30_000_000))
    notes, desk.chunks, desk.index = desk.reindex()
    return f"Reindexed: {notes} note(s), {desk.index.n} chunk(s)."


def summarize_note(desk: Desk, args: dict) -> str:
    path, k = _text(args, "path", 1000, True), _number(args, "maxSentences", summarize.DEFAULT, 1, summarize.MOST)
    own = modes.require_indexed(desk.chunks, path).select("note_path", "start_line", "chunk_id", "text")
    rows = summarize.best(summarize.centrality(summarize.units(own, order=["start_line", "chunk_id"])), k).orderBy("pos").collect()
    return "\n".join(f"• {r['sentence']}" for r in rows) or f'Nothing to summarise in "{path}".'


def get_note_context(desk: Desk, args: dict) -> str:
    path, most = _text(args, "path", 1000, True), _number(args, "maxChars", context.DEFAULT_CHARS, context.LEAST_CHARS, context.MOST_CHARS)
    first, last = _number(args, "startLine", 0, 0, 1 << 30), _number(args, "endLine", 0, 0, 1 << 30)
    own = modes.require_indexed(desk.chunks, path).where(context.in_range(first, last))
    if args.get("outline") is True:
        rows = context.outline(own).orderBy("group_no").limit(2000).collect()
        return "\n".join(f"{r['first_line']}-{r['last_line']} {r['label']}" for r in rows)
    pieces = context.section_groups(own)
    shown = context.budget.assembled(pieces, "own_text", ["note_path"], ["start_line", "end_line", "chunk_id"], most)
    rows = shown.where("kept").orderBy("start_line", "end_line", "chunk_id").select("start_line", "end_line", "shown", T.breadcrumb(F.col("heading_path"), F.col("heading")).alias("label")).collect()
    after = shown.where("not kept").agg(F.min("start_line").alias("n")).first()["n"]
    body = "\n\n".join(f"[{r['label']} · {r['start_line'] + 1}-{r['end_line'] + 1}]\n{r['shown']}" for r in rows)
    return body + (f"\n\nGo on with startLine={after + 1}." if after is not None else "")


def find_related_notes(desk: Desk, args: dict) -> str:
    path = _text(args, "path", 1000, True)
    one = modes.require_indexed(desk.chunks, path).select("note_path").distinct()
    rows = links.related(desk.chunks, one).orderBy("direction", "other").limit(2000).collect()
    return "\n".join(f"{'→' if r['direction'] == 'to' else '←'} {r['other']}" for r in rows) or "No related notes."


def _schema(needed: list[str], **fields: dict | str) -> dict:
    return {"type": "object", "properties": {k: {"type": v} if isinstance(v, str) else v for k, v in fields.items()}, "required": needed, "additionalProperties": False}


_LIST = {"type": "array", "items": {"type": "string"}}
#: name: (what runs, calls a minute, description, schema). Names and argument names are those clients call (fixed values).
TOOLS: dict[str, tuple[Callable[[Desk, dict], str], int, str, dict]] = {
    "search_vault_memory": (search_vault_memory, 60, "Chunks that match a query, with path, heading, lines, date and snippet.", _schema(["query"], query="string", limit="number", folder="string", tag="string", project="string", sinceDays="number")),
    "add_memory": (add_memory, 20, "Proposes a memory in the inbox, where it waits for review.", _schema(["content"], content="string", type={"type": "string", "enum": memory.TYPES}, project="string", tags=_LIST, source="string", relatedPaths=_LIST)),
    "get_project_context": (get_project_context, 60, "The memory files of a project, in their order.", _schema(["project"], project="string", maxChars="number")),
    "get_global_context": (get_global_context, 60, "The memory files that hold for all projects.", _schema([], maxChars="number")),
    "list_projects": (list_projects, 60, "The projects there are.", _schema([])),
    "get_recent_sessions": (get_recent_sessions, 60, "The latest sessions of a project.", _schema(["project"], project="string", limit="number")),
    "reindex_vault": (reindex_vault, 60, "Builds the index anew; only now and then.", _schema([])),
    "summarize_note": (summarize_note, 60, "A few of a note's own sentences.", _schema(["path"], path=_PATH, maxSentences="number")),
    "get_note_context": (get_note_context, 60, "The text of a note of the index, a range of it, or its outline.", _schema(["path"], path=_PATH, maxChars="number", startLine="number", endLine="number", outline="boolean")),
    "find_related_notes": (find_related_notes, 60, "Notes linked from a note or to it.", _schema(["path"], path=_PATH)),
}


def server(desk: Desk) -> Server:
    """A server of the ten tools. A note outside the index is refused like any wrong argument."""
    out = Server()

    def bound(name: str, run: Callable[[Desk, dict], str], most: int) -> Callable[[dict], str]:
        def call(args: dict) -> str:
            desk.admit(f"{name}:minute", window_step(most, MINUTE))
            if not isinstance(args, dict) or set(args) - set(TOOLS[name][3]["properties"]):
                raise ValueError("unknown arguments")
            try:
                return run(desk, args)
            except LookupError as x:
                raise ValueError(str(x.args[0])) from None

        return call

    for name, (run, most, description, schema) in TOOLS.items():
        out.add(Tool(name, description, schema, bound(name, run, most)))
    return out
