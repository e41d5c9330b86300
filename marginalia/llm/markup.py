"""Markup residue in texts: HTML, wiki, LaTeX and Markdown become clean text that keeps its structure.

A scanner turns all four families into one stream of events (elements and text); a tree builder closes what is implied (a list
item ends the one before it, a cell its neighbour, a block the open paragraph); a renderer emits the visible text block by
block: headings as ``# ...``, list items with marks and indentation, code and formulas unchanged, table cells aligned.
Comments, scripts, styles, templates and elements that are hidden are not visible. The scanner also names the families it met.
All scanning is linear: constructs are found by their ends, and an end that is missing is looked for once; braces of
templates are matched with a stack.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAMILIES = ("html", "wiki", "latex", "markdown")

_ANY = re.compile(r"[<&{\\$`*_~#|\[>=\t]|''|^ {0,3}(?:[-+]|\d{1,9}[.)])|^[-=]{2,}|^ {4}|^;", re.M)
_FENCE = re.compile(r"^([ \t]*)(`{3,}|~{3,})([^\n]*)$")
_CODE = re.compile(r"(?<!`)(`+)(?!`)")
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9-]*)((?:\s+[^<>]*)?)(/?)>")
_ENTITY = re.compile(r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_ATTRIBUTE = re.compile(r"([^\s\"'=<>/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_HTML = set(
    "a abbr address article aside audio b big blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt em "
    "figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark meta nav "
    "nowiki ol option p pre q ref s samp script section select small source span strike strong style sub summary sup svg table tbody td "
    "template textarea tfoot th thead title tr tt u ul var video".split()
)
_VOID = {"br", "hr", "img", "input", "link", "meta", "source", "col"}
_INVISIBLE = {"script", "style", "head", "template", "title", "ref", "svg", "iframe"}
_BLOCKS = set("address article aside blockquote body center dd details div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Which open elements a new element ends, as far up as the given boundary.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}
_MATH = set(
    "equation equation* align align* aligned alignat alignat* alignedat flalign flalign* math displaymath gather gather* gathered multline multline* eqnarray eqnarray* "
    "split array subequations cases dcases rcases matrix pmatrix bmatrix Bmatrix vmatrix Vmatrix smallmatrix".split()
)
#: What shows that an environment of another name holds mathematics, and formulas within that do not count for it.
_MATHLIKE = re.compile(r"\^|_\{|\b[A-Za-z]_\w\b|\\(?:d?frac|sqrt|sum|int|prod|leq?|geq?|neq?|infty|times|cdot|alpha|beta|gamma|delta|theta|lambda|mu|sigma|phi|omega|math[a-z]+)\b")
_FORMULAS = re.compile(r"\$\$[^$]*\$\$|\$[^$]*\$")
_TEXTUAL = set("document itemize enumerate description tabular table figure center quote quotation abstract".split())
_VERBATIM = {"verbatim", "lstlisting", "minted"}
#: Environments of rows and cells, by the number of arguments in front of the first row.
_TABULAR = {"tabular": 1, "tabular*": 2, "tabularx": 2, "longtable": 1, "tabulary": 2}
_TABULAR_RULES = re.compile(r"\\(?:hline|toprule|midrule|bottomrule|endhead|endfirsthead|endfoot|endlastfoot)(?![A-Za-z])|\\(?:cline|cmidrule)(?:\([^()]*\))?\{[^{}]*\}")
#: LaTeX commands that stand alone (fixed values); any other needs a brace to count as one.
_COMMANDS = set(
    "item alpha beta gamma delta epsilon theta lambda mu pi sigma phi omega sum int prod frac sqrt infty leq geq le ge neq times cdot ldots dots "
    "LaTeX TeX maketitle tableofcontents newpage clearpage noindent par centering hline quad qquad newline bigskip medskip smallskip appendix".split()
)
_LATEX_HEADS = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}
_LATEX_MUTE = set("label cite ref eqref citep citet pageref usepackage documentclass bibliography bibliographystyle vspace hspace input include index".split())
_LATEX = re.compile(r"(?<![:\\/])\\([A-Za-z]+)\*?((?:\[[^\[\]\n]*\])?)(\{?)")
_MATHS = re.compile(r"(?<![\\$\w])\$(?![\s$])([^$]+?)(?<![\s\\])\$(?![\d$\w])")
_WIKI_HEAD = re.compile(r"^(={2,6})[ \t]*([^=\n][^\n]*?)[ \t]*\1[ \t]*$")
_WIKI_LINK = re.compile(r"\[\[([^\[\]|]+)((?:\|[^\[\]|]*)*)\]\]")
_WIKI_STRONG = re.compile(r"('{5}|'{3}|'{2})(?!')([^'\n]+(?:'[^'\n]+)*)\1(?!')")
_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r"^ {0,3}(=+|-{2,})[ \t]*$")
_RULE = re.compile(r"^ {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r"^([ \t]*)([-*+]|\d{1,9}[.)])[ \t]+(.*)$")
_TASK = re.compile(r"^\[[ xX]\][ \t]+")
_QUOTE = re.compile(r"^ {0,3}>[ \t]?(.*)$")
_DELIMITER = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_MD_LINK = re.compile(r"(!?)\[([^\[\]]*)\]\(([^()\s]*(?:\([^()\s]*\)[^()\s]*)?)(?:\s+(?:\"[^\"()]*\"|'[^'()]*'|\"[^\"\n]*\"|'[^'\n]*'))?\)")
_MD_REF = re.compile(r"\[([^\[\]\n]+)\]\[([^\[\]\n]*)\]|\[\^([^\[\]\s]+)\]:?")
_MD_DEF = re.compile(r"^ {0,3}\[(?!\^)[^\[\]\n]+\]:[ \t]*\S+(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*$")
_WIKI_ITEM = re.compile(r"^(\*{2,})[ \t]+(.*)$")
_AUTOLINK = re.compile(r"<((?:https?|ftp|mailto):[^\s<>]+)>")
_MD_STRONG = re.compile(r"(?<![\\*])(\*{1,3})(?![\s*])([^*]+?)(?<![\s*\\])\1(?!\*)|(?<![\w\\])(_{1,3})(?![\s_])([^_\n]+(?:_[^_\n]+)*?)(?<![\s_])\3(?!\w)|(?<!~)~~(?![\s~])([^~]+?)(?<![\s~])~~(?!~)")


#: Constructs that may wrap, and lines that begin another block, so that none wraps into them.
_WRAPPING = (_MATHS, re.compile(r"<[A-Za-z/][^<>]*>"), _WIKI_LINK, _MD_LINK, re.compile(r"(?<![\\*])(\*{1,3})(?![\s*])([^*]+?)(?<![\s*\\])\1(?!\*)|(?<!~)~~(?![\s~])([^~]+?)(?<![\s~])~~(?!~)|(?<![\w\\_])(_{1,3})(?![\s_])([^_]+?)(?<![\s_])\4(?!\w)"))
_NEW_BLOCK = re.compile(r"\n(?:[ \t]*(?:[-*+][ \t]|\d{1,9}[.)][ \t]|#{1,6}[ \t]|[>|]|={2,}|-{2,}|\n|\ue000\d+\ue001[ \t]*(?:\n|\Z))| {4}|\t)")
#: Commands whose first argument is a setting of the text in their last.
_STYLED = {"textcolor", "colorbox", "fontsize", "scalebox"}
#: Elements and arguments are nested so deep at most.
_DEEPEST = 100


def _note(name: str, attributes: str) -> str:
    """What the attributes of an element change: that it is hidden, or the number of a list or item."""
    found = {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or _UNSEEN.search(found.get("style", "")):
        return "hidden"
    number = found.get("start" if name == "ol" else "value", "") if name in ("ol", "li") else ""
    return number + "." if number.isdigit() else ""


class Node:
    __slots__ = ("tag", "kids", "text", "note")

    def __init__(self, tag: str, text: str = "", note: str = ""):
        self.tag, self.text, self.note, self.kids = tag, text, note, []


class Builder:
    """The tree of the events so far; closes what the next element implies."""

    def __init__(self) -> None:
        self.root = Node("root")
        self.stack = [self.root]

    def open(self, tag: str, note: str = "") -> None:
        ends, bound = _IMPLIED.get(tag, (set(), set()))
        if tag in _BLOCKS:
            ends = ends | {"p"}
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in bound or (self.stack[i].tag in _BLOCKS and self.stack[i].tag not in ends):
                break
            if self.stack[i].tag in ends:
                del self.stack[i:]
        if tag in ("td", "th") and self.stack[-1].tag in ("table", "tbody", "thead"):
            self.open("tr")
        node = Node(tag, note=note)
        self.stack[-1].kids.append(node)
        if tag not in _VOID and len(self.stack) < _DEEPEST:  # deeper elements lie side by side
            self.stack.append(node)

    def close(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def text(self, s: str, tag: str = "#") -> None:
        if s:
            self.stack[-1].kids.append(Node(tag, s))

    def whole(self, tag: str, s: str) -> None:
        self.open(tag)
        self.text(s, "=" if tag == "pre" else "#")
        self.close(tag)


class Scanner:
    """Reads one text into a Builder and remembers the families of the markup."""

    def __init__(self, text: str):
        self.families: set[str] = set()
        self.quoted = 0
        self.b = Builder()
        self.blocks(text.replace("\r\n", "\n").replace("\r", "\n"))

    # -- blocks --------------------------------------------------------------------------------------------------------

    def blocks(self, text: str) -> None:
        """Code fences first: what they hold is literal."""
        lines, at, prose, out, held = text.split("\n"), 0, [], [], []
        endless: set[str] = set()
        while at < len(lines):
            m = _FENCE.match(lines[at]) if lines[at].lstrip(" \t")[:1] in ("`", "~") else None
            if not m or (m[2][0] == "`" and "`" in m[3]):
                prose.append(lines[at])
                at += 1
                continue
            deep = len(m[1].expandtabs(4)) > 3  # in a list item; elsewhere such lines are code anyway
            close = re.compile(rf"^{'[ \\t]*' if deep else ' {0,3}'}{re.escape(m[2][0])}{{{len(m[2])},}}[ \t]*$")
            end = next((i for i in range(at + 1, len(lines)) if close.match(lines[i])), None) if not deep or m[2] not in endless else None
            if end is None and deep:
                endless.add(m[2])
                prose.append(lines[at])
                at += 1
                continue
            out += self.prepared(prose, held)
            body = [x[len(m[1]) :] if x.startswith(m[1]) else x.lstrip(" \t") for x in lines[at + 1 : end]]
            self.families.add("markdown")
            held.append(("pre", "\n".join(body)))
            out.append(f"{m[1]}\ue000{len(held) - 1}\ue001")
            prose, at = [], len(lines) if end is None else end + 1
        if not held and not _ANY.search("\n".join(prose)):
            self.paragraphs("\n".join(prose))
            return
        out += self.prepared(prose, held)
        self.lines(out, held)

    def prepared(self, lines: list[str], held: list) -> list[str]:
        """Lines in which code spans, formulas and constructs over several lines are held apart."""
        if not lines:
            return []
        text = "\n".join(lines)
        if not _ANY.search(text):
            return lines

        def hold(kind: str, s: str) -> str:
            held.append((kind, s))
            return f"\ue000{len(held) - 1}\ue001"

        text = text.replace("\ue000", "").replace("\ue001", "")
        if "`" in text:
            text = self.code_spans(text, hold)
        return self.unwrapped(self.braces(self.regions(text, hold, held)), hold).split("\n")

    @staticmethod
    def braces(text: str) -> str:
        """Arguments of commands that wrap within their paragraph on one line."""
        if "\\" not in text or "{" not in text:
            return text
        opened: list[int] = []
        spots: list[tuple[int, int]] = []
        for m in re.finditer(r"[{}]|\n[ \t]*\n", text):
            if m[0] == "{":
                opened.append(m.start())
            elif m[0] == "}":
                if opened:
                    spots.append((opened.pop(), m.end()))
            else:
                opened.clear()
        out, at = [], 0
        for lo, hi in sorted(spots):
            if lo >= at and "\n" in text[lo:hi] and re.search(r"\\[A-Za-z]+\*?(?:\[[^\[\]\n]*\])?$", text[max(at, lo - 200) : lo]) and not _NEW_BLOCK.search(text[lo:hi]):
                out += [text[at:lo], re.sub(r"[ \t]*\n[ \t]*", " ", text[lo:hi])]
                at = hi
        return "".join([*out, text[at:]])

    def code_spans(self, text: str, hold) -> str:
        """Code spans: a run of backticks up to the next run of that length within the paragraph."""
        out = []
        for part in re.split(r"(\n[ \t]*\n)", text):
            runs = [(m.start(), len(m[1])) for m in _CODE.finditer(part)]
            nearest: dict[int, int] = {}
            partner = {}
            for i in range(len(runs) - 1, -1, -1):
                partner[i] = nearest.get(runs[i][1])
                nearest[runs[i][1]] = i
            at, i = 0, 0
            while i < len(runs):
                j = partner[i]
                if j is None:
                    i += 1
                    continue
                (s, n), (e, _) = runs[i], runs[j]
                out += [part[at:s], hold("code", part[s + n : e].strip())]
                self.families.add("markdown")
                at, i = e + n, j + 1
            out.append(part[at:])
        return "".join(out)

    def unwrapped(self, text: str, hold) -> str:
        """Inline constructs that wrap within their paragraph on one line; formulas are held as they stand."""
        for pattern in _WRAPPING:

            def join(m: re.Match, pattern=pattern) -> str:
                if "\n" not in m[0] or _NEW_BLOCK.search(m[0]):
                    return m[0]
                if pattern is _MATHS:
                    self.families.add("latex")
                    return hold("code", m[0])
                return re.sub(r"[ \t]*\n[ \t]*", " ", m[0])

            text = pattern.sub(join, text)
        return text

    def regions(self, text: str, hold, held: list) -> str:
        """Constructs over several lines, found by their ends."""
        out, at, gone, templates = [], 0, set(), self.templates(text) if "{{" in text else {}
        for m in re.finditer(r"<!--|\$\$|\\\[|\\\(|\\begin\{([A-Za-z]+\*?)\}|\{\{|(?m:^)[ \t]*\{\||<(script|style|pre|nowiki)\b[^<>]*>", text):
            if m.start() < at:
                continue
            opener = m[0].strip()
            if opener == "{{":
                end, kind = templates.get(m.start(), -1), "wiki:"
            else:
                closer, kind = {"<!--": ("-->", "html:"), "$$": ("$$", "latex:math"), "\\[": ("\\]", "latex:math"), "\\(": ("\\)", "latex:formula"), "{|": ("\n|}", "wiki:table")}.get(opener, ("", ""))
                if m[1]:
                    closer, kind = f"\\end{{{m[1]}}}", "latex:pre" if m[1] in _VERBATIM else "latex:tabular" if m[1] in _TABULAR else "latex:math"
                    if m[1] not in _MATH and m[1] not in _VERBATIM and m[1] not in _TABULAR:
                        inner = text.find("\\begin{", m.end())
                        end = -1 if m[1] in _TEXTUAL else text.find(closer, m.end(), inner if inner >= 0 else len(text))
                        if end < 0 or not _MATHLIKE.search(_FORMULAS.sub("", text[m.end() : end])):
                            continue
                elif m[2]:
                    closer, kind = f"</{m[2].lower()}>", "html:pre" if m[2].lower() == "pre" else "html:plain" if m[2].lower() == "nowiki" else "html:"
                if closer in gone:
                    continue
                found = (text.lower() if m[2] else text).find(closer, m.end())
                if found < 0:
                    gone.add(closer)
                    continue
                end = found + len(closer)
            if end < 0:
                continue
            family, what = kind.split(":")
            self.families.add(family)
            out.append(text[at : m.start()])
            whole = text[m.start() : end]
            if what in ("table", "tabular"):
                inner = m.end()
                self.b, outer = Builder(), self.b
                if what == "table":
                    self.wiki_table(self.unwrapped(text[inner : end - 2], hold), held)
                else:
                    self.latex_table(text[inner : end - len(closer)], _TABULAR[m[1]], held)
                tree, self.b = self.b.root.kids, outer
                out.append("\n" + hold("tree", tree) + "\n")
            elif what == "pre":
                body = text[m.end() : end - len(closer)]
                if family == "html":
                    body = unescape(re.sub(r"</?[A-Za-z][^<>]*>", "", body))
                out.append("\n" + hold("pre", body.strip("\n")) + "\n")
            elif what == "plain":
                out.append(hold("code", text[m.end() : end - len(closer)]))
            elif what == "math":
                out.append("\n" + hold("pre", whole.strip()) + "\n")
            elif what == "formula":
                out.append(hold("code", whole))
            at = end
        out.append(text[at:])
        return "".join(out)

    @staticmethod
    def templates(text: str) -> dict[int, int]:
        """Where the templates end, by where they begin; an opening without an end has none and hides no other."""
        ends, opened = {}, []
        for m in re.finditer(r"\{\{|\}\}", text):
            if m[0] == "{{":
                opened.append(m.start())
            elif opened:
                ends[opened.pop()] = m.end()
        return ends

    def wiki_table(self, body: str, held: list) -> None:
        self.b.open("table")
        row = False
        for line in body.split("\n")[1:]:
            s = line.strip()
            if s.startswith("|+"):
                self.b.open("caption")
                self.inline(s[2:].rpartition("|")[2].strip() if "[[" not in s else s[2:].strip(), held)
                self.b.close("caption")
                continue
            if s.startswith("|-"):
                self.b.close("tr")
                row = False
            elif s[:1] in ("|", "!"):
                if not row:
                    self.b.open("tr")
                    row = True
                for cell in re.split(r"\|\||!!", s[1:]):
                    self.b.open("td")
                    self.inline(cell.rpartition("|")[2].strip() if "[[" not in cell else cell.strip(), held)
            elif s:
                self.inline(" " + s, held)
        self.b.close("table")

    def latex_table(self, body: str, arguments: int, held: list) -> None:
        """Rows end with a double backslash, cells with ``&``."""
        at = 0
        group = re.compile(r"\s*\{(?:[^{}]|\{[^{}]*\})*\}")
        for i in range(arguments):
            m = group.match(body, at) or (re.compile(r"\s*\[[^\[\]]*\]" + group.pattern).match(body, at) if not i or arguments > 1 else None)
            at = m.end() if m else at
        self.b.open("table")
        for row in re.split(r"\\\\(?:\*|\[[^\[\]\n]*\])?", _TABULAR_RULES.sub("", body[at:])):
            if not row.strip():
                continue
            self.b.open("tr")
            for cell in re.split(r"(?<!\\)&", row):
                self.b.open("td")
                self.inline(" ".join(cell.split()), held)
                self.b.close("td")
            self.b.close("tr")
        self.b.close("table")

    def paragraphs(self, text: str) -> None:
        for part in re.split(r"\n[ \t]*\n", text):
            if part.strip():
                self.b.whole("p", " ".join(x.strip() for x in part.split("\n")).strip())

    def lines(self, lines: list[str], held: list) -> None:
        """Markdown, wiki and LaTeX blocks line by line."""
        b, at, n = self.b, 0, len(lines)
        blank, open_p, lists = True, False, 0
        above: dict[int, int] = {}  # how deep the items of so many stars are
        while at < n:
            line = lines[at]
            s = line.strip()
            if not s:
                if open_p:
                    b.close("p")
                open_p, blank, at = False, True, at + 1
                continue
            code = blank and not lists and (line.startswith("    ") or line.startswith("\t"))
            atx, item, quote = _ATX.match(line), _ITEM.match(line), _QUOTE.match(line)
            wiki, rule = _WIKI_HEAD.match(s), _RULE.match(line)
            held_only = re.fullmatch(r"\ue000(\d+)\ue001", s)
            block = bool(held_only) and held[int(held_only[1])][0] != "code"
            stars, nxt_line = _WIKI_ITEM.match(line), lines[at + 1].strip() if at + 1 < n else ""
            nxt = lines[at + 1] if at + 1 < n else ""
            if lists and not item and not stars and (blank or block) and not line.startswith((" ", "\t")):
                for _ in range(lists):
                    b.close("li")
                    b.close("ul")
                lists = 0
            if block:
                b.close("p")
                open_p = False
                kind, what = held[int(held_only[1])]
                if kind == "tree":
                    b.stack[-1].kids.extend(what)
                else:
                    b.whole("pre", what)
                blank, at = True, at + 1
                continue
            elif code:
                self.families.add("markdown")
                body = []
                while at < n and (lines[at].startswith(("    ", "\t")) or not lines[at].strip()):
                    body.append(lines[at].removeprefix("    ").removeprefix("\t"))
                    at += 1
                b.whole("pre", self.plain("\n".join(body).rstrip(), held))
                blank = True
                continue
            elif atx:
                self.families.add("markdown")
                b.close("p")
                open_p = False
                self.heading(len(atx[1]), atx[2] or "", held)
            elif wiki:
                self.families.add("wiki")
                b.close("p")
                open_p = False
                self.heading(len(wiki[1]), wiki[2], held)
            elif rule and not (open_p and _SETEXT.match(line)):
                self.families.add("markdown")
                b.close("p")
                open_p = False
                b.open("hr")
            elif item:
                self.families.add("markdown")
                b.close("p")
                open_p = False
                depth = 1 + min(len(item[1].replace("\t", "    ")) // 2, lists)
                while lists > depth:
                    b.close("li")
                    b.close("ul")
                    lists -= 1
                if lists < depth:
                    b.open("ul")
                    lists += 1
                b.open("li", item[2] if item[2][0].isdigit() else "-")
                self.inline(_TASK.sub(lambda m: "[x] " if "x" in m[0].lower() else "[ ] ", item[3]), held)
            elif stars:  # a deeper item of a wiki list
                b.close("p")
                open_p = False
                if not lists:
                    above = {}
                depth = above.setdefault(len(stars[1]), min(len(stars[1]), lists + 1))
                while lists > depth:
                    b.close("li")
                    b.close("ul")
                    lists -= 1
                if lists < depth:
                    b.open("ul")
                    lists += 1
                b.open("li", "-")
                self.inline(stars[2], held)
            elif s[0] == ";" and nxt_line.startswith(":") and s[1:].strip():
                b.close("p")
                open_p = False
                for tag, what in (("dt", s), ("dd", nxt_line)):
                    b.open(tag)
                    self.inline(what[1:].strip(), held)
                    b.close(tag)
                at += 1
            elif quote:
                self.families.add("markdown")
                b.close("p")
                open_p, inner = False, []
                while at < n and (m := _QUOTE.match(lines[at])):
                    inner.append(m[1])
                    at += 1
                b.open("blockquote")
                self.quoted += 1
                self.lines([x.lstrip("> ") for x in inner] if self.quoted > _DEEPEST // 4 else inner, held)
                self.quoted -= 1
                b.close("blockquote")
                blank = False
                continue
            elif "|" in line and "-" in nxt and "|" in nxt and _DELIMITER.match(nxt):
                self.families.add("markdown")
                b.close("p")
                open_p = False
                b.open("table")
                rows = [line]
                at += 2
                while at < n and "|" in lines[at] and lines[at].strip():
                    rows.append(lines[at])
                    at += 1
                for r in rows:
                    b.open("tr")
                    for cell in re.split(r"(?<!\\)\|", re.sub(r"(?<!\\)\|$", "", r.strip().removeprefix("|"))):
                        b.open("td")
                        self.inline(cell.strip().replace("\\|", "|"), held)
                        b.close("td")
                    b.close("tr")
                b.close("table")
                blank = False
                continue
            elif not open_p and nxt and _SETEXT.match(nxt):
                self.families.add("markdown")
                self.heading(1 if "=" in nxt else 2, s, held)
                at += 1
            elif _MD_DEF.match(line):
                self.families.add("markdown")
            else:
                if not open_p and not lists:
                    b.open("p")
                    open_p = True
                elif not blank:
                    b.text(" ")
                self.inline(s, held)
            blank, at = False, at + 1
        b.close("p")
        for _ in range(lists):
            b.close("li")
            b.close("ul")

    def heading(self, level: int, s: str, held: list) -> None:
        tag = f"h{max(1, min(6, level))}"
        self.b.open(tag)
        self.inline(s.strip(), held)
        self.b.close(tag)

    # -- inline --------------------------------------------------------------------------------------------------------

    def inline(self, s: str, held: list) -> None:
        """One line: the first construct wins at each place, all of them by one pass."""
        s = self.markdown(self.wiki(self.latex(s, held), held), held)
        at, b = 0, self.b
        for m in re.finditer(r"<[^<>]*>|&[^&;\s]{1,33};", s) if "<" in s or "&" in s else ():
            tag, entity = _TAG.fullmatch(m[0]), _ENTITY.fullmatch(m[0])
            if tag and tag[2].lower() in _HTML:
                self.families.add("html")
                b.text(self.plain(s[at : m.start()], held))
                name = tag[2].lower()
                if tag[1]:
                    b.close(name)
                else:
                    b.open(name, _note(name, tag[3]))
                    if tag[4] or tag[3].endswith("/"):
                        b.close(name)
                at = m.end()
            elif entity and (entity[1][0] == "#" or f"{entity[1]};" in html5):
                self.families.add("html")
                b.text(self.plain(s[at : m.start()], held) + unescape(m[0]).replace("\xa0", " "))
                at = m.end()
        b.text(self.plain(s[at:], held))

    def latex(self, s: str, held: list, depth: int = 0) -> str:
        if "$" in s:

            def formula(m: re.Match) -> str:
                self.families.add("latex")
                held.append(("code", m[0]))
                return f"\ue000{len(held) - 1}\ue001"

            s = _MATHS.sub(formula, s)
        if "\\" not in s:
            return s
        out, at = [], 0
        ends, opened = {}, []
        for m in re.finditer(r"[{}]", s):
            if m[0] == "{":
                opened.append(m.start())
            elif opened:
                ends[opened.pop()] = m.start()
        for m in _LATEX.finditer(s):
            if m.start() < at or not (m[3] or m[1] in _COMMANDS) or (not m[3] and m.start() and (s[m.start() - 1].isalnum() or s[m.start() - 1] == "_")):
                continue
            self.families.add("latex")
            out.append(s[at : m.start()])
            arguments, at = [], m.end()
            if m[3] and m.end() - 1 in ends:
                at -= 1
                while at in ends:
                    arguments.append(s[at + 1 : ends[at]])
                    at = ends[at] + 1
            name = m[1]
            if name in ("begin", "end") and arguments:
                what = arguments[0].rstrip("*")
                if what in ("itemize", "enumerate", "description", "tabular"):
                    tag = "table" if what == "tabular" else "ul"
                    self.b.close("p")
                    (self.b.open if name == "begin" else self.b.close)(tag)
            elif name == "item":
                self.b.text(self.plain("".join(out), held))
                out = []
                self.b.close("p")
                self.b.open("li", "-")
                at += len(s[at:]) - len(s[at:].lstrip())
            elif name in _LATEX_HEADS:
                self.b.close("p")
                self.heading(_LATEX_HEADS[name], arguments[0] if arguments else "", held)
            elif name in ("LaTeX", "TeX"):
                out.append(name)
            elif name == "href" and len(arguments) > 1:
                out.append(arguments[1])
            elif name in _LATEX_MUTE or name in ("begin", "end"):
                pass
            elif len(arguments) > 1 and name not in _STYLED:
                held.append(("code", s[m.start() : at]))  # which argument is the text is not known
                out.append(f"\ue000{len(held) - 1}\ue001")
            elif arguments:
                out.append(self.latex(arguments[-1], held, depth + 1) if depth < _DEEPEST else arguments[-1])
            elif name in _COMMANDS:
                out.append(m[0])
        return "".join([*out, s[at:]])

    def wiki(self, s: str, held: list) -> str:
        if "[[" in s:

            def link(m: re.Match) -> str:
                self.families.add("wiki")
                if re.match(r"(?i)(?:category|file|image):", m[1].strip()):
                    return ""
                return m[2].rpartition("|")[2] or m[1].lstrip(":")

            s = _WIKI_LINK.sub(link, s)
        if "''" in s:

            def strong(m: re.Match) -> str:
                self.families.add("wiki")
                return m[2]

            s = _WIKI_STRONG.sub(strong, s)
        return s

    def markdown(self, s: str, held: list) -> str:
        def seen(text: str) -> str:
            self.families.add("markdown")
            return text

        if "<" in s:
            s = _AUTOLINK.sub(lambda m: seen(m[1]), s)
        if "[" in s:
            s = _MD_LINK.sub(lambda m: seen(m[2]), s)
            s = _MD_REF.sub(lambda m: seen(m[1] or ""), s)
        for _ in range(3):
            if "*" not in s and "_" not in s and "~" not in s:
                break
            t = _MD_STRONG.sub(lambda m: seen(m[2] or m[4] or m[5] or ""), s)
            if t == s:
                break
            s = t
        return s

    @staticmethod
    def plain(s: str, held: list) -> str:
        if "\ue000" not in s:
            return s
        return re.sub(r"\ue000(\d+)\ue001", lambda m: held[int(m[1])][1] if isinstance(held[int(m[1])][1], str) else "", s)


def _visible(node: Node) -> str:
    """The text of an element on one line."""
    if node.tag in _INVISIBLE or node.note == "hidden":
        return ""
    if node.tag in ("#", "="):
        return node.text
    if node.tag == "br":
        return "\n"
    return "".join(f" {_visible(k)} " if k.tag in _BLOCKS or k.tag == "option" else _visible(k) for k in node.kids)


def _squeeze(s: str) -> str:
    return "\n".join(" ".join(x.split()) for x in s.split("\n")).strip()


def _emit(node: Node, out: list[str], indent: int = 0) -> None:
    """Blocks of a tree in order; inline runs between blocks become one block."""
    run: list[str] = []

    def flush() -> None:
        text = _squeeze("".join(run))
        run.clear()
        if text:
            out.append(text)

    for k in node.kids:
        if k.note == "hidden" or k.tag in _INVISIBLE:
            continue
        if k.tag not in _BLOCKS:
            if any(x.tag in _BLOCKS for x in k.kids):  # an inline element around blocks
                flush()
                _emit(k, out, indent)
            else:
                run.append(_visible(k))
            continue
        flush()
        if k.tag == "pre":
            body = _code(k)
            if body:
                out.append(body)
        elif k.tag[0] == "h" and k.tag[1:].isdigit():
            text = " ".join(_squeeze(_visible(k)).split())
            if text:
                out.append("#" * int(k.tag[1:]) + " " + text)
        elif k.tag == "table":
            out += _table(k)
        elif k.tag in ("ul", "ol"):
            out.append("\n".join(_items(k, 0)))
        elif k.tag == "hr":
            continue
        else:
            _emit(k, out, indent)
    flush()


def _code(pre: Node) -> str:
    return "".join(x.text if x.tag in ("=", "#") else _visible(x) for x in pre.kids).strip("\n")


def _table(table: Node) -> list[str]:
    """Captions and whatever stands in no cell, then the rows with their cells aligned."""
    loose: list[str] = []
    rows = list(_rows(table, loose))
    width = [max((len(r[i]) for r in rows if i < len(r)), default=0) for i in range(max(map(len, rows), default=0))]
    text = "\n".join("  ".join(c.ljust(w) for c, w in zip(r, width, strict=False)).rstrip() for r in rows)
    return [x for x in (*loose, text) if x.strip()]


def _rows(table: Node, loose: list[str]) -> Iterator[list[str]]:
    for k in table.kids:
        if k.note == "hidden":
            continue
        if k.tag in ("tbody", "thead", "tfoot"):
            yield from _rows(k, loose)
        elif k.tag == "tr":
            yield [" ".join(_squeeze(_visible(c)).split()) for c in k.kids if c.tag in ("td", "th")]
            loose += [x for c in k.kids if c.tag not in ("td", "th") and (x := " ".join(_squeeze(_visible(c)).split()))]
        elif x := " ".join(_squeeze(_visible(k)).split()):
            loose.append(x)


def _items(lst: Node, depth: int) -> Iterator[str]:
    number = int(lst.note[:-1]) - 1 if lst.note[:1].isdigit() else 0
    for k in lst.kids:
        if k.note == "hidden" or k.tag in _INVISIBLE:
            continue
        if k.tag in ("ul", "ol"):
            yield from _items(k, depth + 1)
        elif k.tag == "li":
            number = int(re.match(r"\d+", k.note)[0]) if lst.tag == "ol" and k.note[:1].isdigit() else number + 1
            mark = k.note if k.note[:1].isdigit() else f"{number}." if lst.tag == "ol" else "-"
            parts: list[tuple[str, bool]] = []
            _item_parts(k, parts, depth)
            if not parts or parts[0][1]:
                parts.insert(0, ("", False))
            first = " ".join(x for x, own in _leading(parts))
            yield ("  " * depth + f"{mark} " + first).rstrip()
            for text, own in parts[len(list(_leading(parts))) :]:
                yield text if own else "  " * (depth + 1) + text
        else:
            text = " ".join(_squeeze(_visible(k)).split())
            if text:
                yield "  " * depth + text


def _leading(parts: list[tuple[str, bool]]) -> list[tuple[str, bool]]:
    """The first runs of text of an item: they stand behind its mark."""
    n = next((i for i, (_, own) in enumerate(parts) if own), len(parts))
    return parts[:n]


def _item_parts(node: Node, parts: list[tuple[str, bool]], depth: int) -> None:
    """What an item holds, in order: text, and whole lines (code, tables, lists) that are indented already."""
    run: list[str] = []

    def flush() -> None:
        text = " ".join(_squeeze("".join(run)).split())
        run.clear()
        if text:
            parts.append((text, False))

    inside = "  " * (depth + 1)
    for k in node.kids:
        if k.note == "hidden" or k.tag in _INVISIBLE:
            continue
        if k.tag not in _BLOCKS:
            run.append(_visible(k))
            continue
        flush()
        if k.tag == "pre":
            parts += [(inside + x if x else "", True) for x in _code(k).split("\n")]
        elif k.tag == "table":
            parts += [(inside + x, True) for t in _table(k) for x in t.split("\n")]
        elif k.tag in ("ul", "ol"):
            parts += [(x, True) for x in _items(k, depth + 1)]
        else:
            _item_parts(k, parts, depth)
    flush()


def render(text: str | None) -> tuple[str, set[str]]:
    """Clean text of one marked-up text, and the families of its markup. Null and blank texts give ('', nothing)."""
    if not text or not text.strip():
        return "", set()
    if not _ANY.search(text):
        return "\n\n".join(" ".join(p.split()) for p in re.split(r"\n[ \t\r]*\n", text.replace("\r\n", "\n")) if p.strip()), set()
    s = Scanner(text)
    out: list[str] = []
    _emit(s.b.root, out)
    return "\n\n".join(out), s.families


def body_of(text: str | None, heading: str | None) -> str:
    """The text without the heading line it opens with, if there is a heading and the first line that is not blank holds it."""
    if not text:
        return ""
    if not heading or not heading.strip():
        return text
    rest = text.lstrip(" \t\r\n")
    first, _, tail = rest.partition("\n")
    return tail if heading.strip() in first else text


def clean(chunks: DataFrame) -> DataFrame:
    """Clean text of the chunks and the families met: chunk_id, text, heading (clean), text_families, heading_families.

    Families are sorted arrays. ``text_families`` leaves the opening heading line out; the clean text keeps it. Null texts
    and headings become empty. One row a row; null ids stay; other columns are ignored. A map over rows, no shuffle.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for text, heading in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                body, tf = render(body_of(text, heading))
                head, hf = render(heading)
                cols[0].append("\n\n".join(x for x in (f"# {head}" if head else "", body) if x))
                cols[1].append(head)
                cols[2].append(sorted(tf))
                cols[3].append(sorted(hf))
            kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.record_batch([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["chunk_id", "text", "heading", "text_families", "heading_families"])

    return chunks.select("chunk_id", "text", "heading").mapInArrow(convert, "chunk_id string, text string, heading string, text_families array<string>, heading_families array<string>")


def families(chunks: DataFrame) -> DataFrame:
    """Which families of markup stand where, each once: chunk_id, field (``text`` or ``heading``), family."""
    met = clean(chunks).where(F.col("chunk_id").isNotNull()).select("chunk_id", F.explode(F.create_map(F.lit("text"), "text_families", F.lit("heading"), "heading_families")).alias("field", "f"))
    return met.select("chunk_id", "field", F.explode("f").alias("family")).distinct()
