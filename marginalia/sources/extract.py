"""Text of attachments: office files, RTF, plain text, canvases and rendered pages. Every extractor gives None instead of raising."""

from __future__ import annotations

import io
import json
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bounds of what an archive may inflate to, and of parts and depth (fixed values).
ENTRY_BYTES, ARCHIVE_BYTES, MOST_PARTS, MOST_DEPTH = 64 << 20, 256 << 20, 500, 4096
_NAMED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'"}

Extractor = Callable[[str, bytes | None], str | None]


class Archive:
    """The text parts of a ZIP file; inflated bytes are counted while they appear."""

    def __init__(self, data: bytes):
        self._zip, self._left = zipfile.ZipFile(io.BytesIO(data)), ARCHIVE_BYTES
        self.names = [i.filename for i in self._zip.infolist() if i.compress_type in (0, 8) and not i.flag_bits & 1]

    def text(self, name: str) -> str | None:
        if name not in self.names:
            return None
        out = io.BytesIO()
        with self._zip.open(name) as part:
            while piece := part.read(1 << 16):
                out.write(piece)
                self._left -= len(piece)
                if out.tell() > ENTRY_BYTES or self._left < 0:
                    raise ValueError("archive too large")
        return out.getvalue().decode("utf-8", "replace")


def decode_entities(s: str) -> str:
    """XML entities; numbers outside Unicode become U+FFFD; ``&amp;`` last, so nothing is decoded twice."""

    def number(m: re.Match) -> str:
        n = int(m[1][1:], 16) if m[1][0] in "xX" else int(m[1])
        return chr(n) if 0 < n <= 0x10FFFF and not 0xD800 <= n <= 0xDFFF else "\ufffd"

    s = re.sub(r"&#([xX][0-9a-fA-F]{1,8}|[0-9]{1,10});", number, s)
    return re.sub(r"&(lt|gt|quot|apos);", lambda m: _NAMED[m[1]], s).replace("&amp;", "&")


def elements(xml: str, tag: str) -> Iterator[tuple[str, str]]:
    """Attributes and inner text of the elements of a name, in one pass, whether or not the rest is well formed; not nested."""
    at, close = 0, f"</{tag}>"
    opening = re.compile(rf"<{re.escape(tag)}(?=[\s/>])([^>]*)>")
    while m := opening.search(xml, at):
        if m[1].endswith("/"):
            yield m[1][:-1], ""
            at = m.end()
            continue
        end = xml.find(close, m.end())
        if end < 0:
            return
        yield m[1], xml[m.end() : end]
        at = end + len(close)


def attribute(attributes: str, name: str) -> str | None:
    m = re.search(rf"(?:^|\s){re.escape(name)}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", attributes)
    return decode_entities(m[1] if m[1] is not None else m[2]) if m else None


def flat(xml: str) -> str:
    return decode_entities(re.sub(r"<[^>]*>", "", xml))


def runs(xml: str, tag: str) -> str:
    return "".join(flat(inner) for _, inner in elements(xml, tag))


def tidy(text: str) -> str | None:
    """Lines without trailing white space, at most one blank line in a row; None if nothing is left."""
    lines = re.sub(r"\n{3,}", "\n\n", "\n".join(x.rstrip() for x in text.split("\n"))).strip()
    return lines or None


def docx(archive: Archive) -> str:
    out = []
    for _, p in elements(archive.text("word/document.xml") or "", "w:p"):
        text = runs(re.sub(r"<w:tab\s*/>", "<w:t>\t</w:t>", re.sub(r"<w:br\s*/>", "<w:t>\n</w:t>", p)), "w:t")
        style = re.search(r"<w:pStyle\s[^>]*w:val=\"Heading\s*(\d)\"", p)
        out.append("#" * min(6, int(style[1]) + 1) + " " + text if style and text.strip() else text)
    return "\n\n".join(out)


def _numbered(archive: Archive, pattern: str) -> list[str]:
    found = sorted((int(m[1]), n) for n in archive.names if (m := re.fullmatch(pattern, n)))
    return [n for _, n in found[:MOST_PARTS]]


def pptx(archive: Archive) -> str:
    out = []
    for i, name in enumerate(_numbered(archive, r"ppt/slides/slide(\d+)\.xml"), 1):
        text = "\n".join(t for _, p in elements(archive.text(name) or "", "a:p") if (t := runs(p, "a:t")).strip())
        if text:
            out.append(f"## Slide {i}\n\n{text}")
    return "\n\n".join(out)


def xlsx(archive: Archive) -> str:
    shared = [runs(s, "t") for _, s in elements(archive.text("xl/sharedStrings.xml") or "", "si")]
    names = [attribute(a, "name") or "" for a, _ in elements(archive.text("xl/workbook.xml") or "", "sheet")]
    out = []
    for i, name in enumerate(_numbered(archive, r"xl/worksheets/sheet(\d+)\.xml")):
        rows = []
        for _, row in elements(archive.text(name) or "", "row"):
            cells = []
            for a, c in elements(row, "c"):
                kind = attribute(a, "t")
                if kind == "s":
                    n = runs(c, "v").strip()
                    cells.append(shared[int(n)] if n.isdigit() and int(n) < len(shared) else "")
                elif kind == "inlineStr":
                    cells.append(runs(c, "t"))
            if any(x.strip() for x in cells):
                rows.append(" ".join(x for x in cells if x.strip()))
        if rows:
            out.append(f"## {names[i] if i < len(names) and names[i] else f'Sheet {i + 1}'}\n\n" + "\n".join(rows))
    return "\n\n".join(out)


def open_document(archive: Archive) -> str:
    xml = archive.text("content.xml") or ""
    out = []
    for m in re.finditer(r"<(text:h|text:p|draw:page|table:table)(?=[\s/>])([^>]*)>", xml):
        tag, attributes = m[1], m[2]
        if tag == "table:table" or tag == "draw:page":
            name = attribute(attributes, "table:name" if tag == "table:table" else "draw:name")
            if name:
                out.append(f"## {name}")
        elif not attributes.endswith("/"):
            end = xml.find(f"</{tag}>", m.end())
            text = flat(re.sub(r"<text:(?:s|tab)\s*[^>]*/>", " ", re.sub(r"<text:line-break\s*/>", "\n", xml[m.end() : end if end >= 0 else len(xml)]))) if end >= 0 else ""
            if text.strip():
                level = attribute(attributes, "text:outline-level") if tag == "text:h" else None
                out.append("#" * min(6, int(level or 1) + 1) + " " + text if tag == "text:h" else text)
    return "\n\n".join(out)


OFFICE = {"docx": docx, "pptx": pptx, "xlsx": xlsx, "odt": open_document, "odp": open_document, "ods": open_document}


def office(path: str, data: bytes | None) -> str | None:
    try:
        return tidy(OFFICE[path.rsplit(".", 1)[-1].lower()](Archive(data or b"")))
    except (KeyError, ValueError, OSError, zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError):
        return None


#: Groups of RTF that hold no text, and control words that stand for characters (fixed values).
#: Destinations whose text is not part of the document (fixed values), and more of their kind.
_RTF_SKIP = set(
    "fonttbl colortbl stylesheet info pict object header footer footnote themedata colorschememapping latentstyles datastore xmlnstbl "
    "headerl headerr headerf footerl footerr footerf generator listtable listoverridetable filetbl revtbl rsidtbl".split()
)
_RTF_CHARS = {"par": "\n", "line": "\n", "sect": "\n", "page": "\n", "row": "\n", "tab": "\t", "cell": "\t", "emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”"}
_RTF = re.compile(rb"\\([A-Za-z]{1,32})(-?\d{1,10})? ?|\\'([0-9a-fA-F]{2})|\\([^A-Za-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)")


def rtf(path: str, data: bytes | None) -> str | None:
    """One pass over control words; groups that hold no text are skipped, Unicode escapes swallow their fallback."""
    if not data or not data.lstrip().startswith(b"{\\rtf"):
        return None
    out: list[str] = []
    stack: list[tuple[bool, int]] = []
    skip, fallback, swallow, at = False, 1, 0, 0
    while m := _RTF.match(data, at):
        at = m.end()
        word, number, code, symbol, brace, plain = m.groups()
        if brace == b"{":
            if len(stack) >= MOST_DEPTH:
                return None
            stack.append((skip, fallback))
        elif brace == b"}":
            if not stack:
                break
            skip, fallback = stack.pop()
            swallow = 0
        elif word:
            name = word.decode()
            if name == "bin":
                at += max(0, int(number or 0))
            elif name in _RTF_SKIP:
                skip = True
            elif name == "uc":
                fallback = min(64, max(0, int(number or 1)))
            elif skip:
                pass
            elif name == "u" and number:
                n = int(number) % 65536
                out.append(chr(n))
                swallow = fallback
            elif name in _RTF_CHARS:
                out.append(_RTF_CHARS[name])
        elif symbol == b"*":
            skip = True
        elif skip:
            continue
        elif code or symbol or plain:
            text = bytes([int(code, 16)]).decode("cp1252", "replace") if code else {"~": "\xa0", "_": "-", "-": ""}.get(symbol.decode("latin-1"), symbol.decode("latin-1")) if symbol else plain.decode("cp1252", "replace")
            cut = min(swallow, len(text))
            swallow -= cut
            out.append(text[cut:])
    joined = "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return tidy(joined)


def plain(path: str, data: bytes | None) -> str | None:
    body = (data or b"").decode("utf-8", "replace").removeprefix("\ufeff").strip()
    title = re.sub(r"\.[A-Za-z0-9]+$", "", path.rsplit("/", 1)[-1])
    return f"# {title}\n\n{body}" if body else None


def canvas(path: str, data: bytes | None) -> str | None:
    """Cards in reading order, then labels of groups, embedded files and labelled edges."""
    try:
        found = json.loads((data or b"").decode("utf-8", "replace"))
        nodes = [n for n in found.get("nodes") or [] if isinstance(n, dict)]
        edges = [e for e in found.get("edges") or [] if isinstance(e, dict)]
    except (ValueError, AttributeError):
        return None

    def place(n: dict) -> tuple[float, float]:
        return tuple(float(n[c]) if isinstance(n.get(c), (int, float)) else 0.0 for c in ("y", "x"))

    out = []
    for n in sorted(nodes, key=place):
        kind = n.get("type")
        if kind == "text" and str(n.get("text") or "").strip():
            out.append(str(n["text"]).strip())
        elif kind == "group" and str(n.get("label") or "").strip():
            out.append(f"## {str(n['label']).strip()}")
        elif kind == "file" and n.get("file"):
            out.append(f"[[{n['file']}]]")
        elif kind == "link" and n.get("url"):
            out.append(str(n["url"]))
    out += [str(e["label"]).strip() for e in edges if str(e.get("label") or "").strip()]
    return tidy("\n\n".join(out))


def rendered_pages(pages: list[str | None]) -> str | None:
    """Pages of a document as Markdown: ``## Page n`` for every page with text, of at most MOST_PARTS pages."""
    return tidy("\n\n".join(f"## Page {i}\n\n{p.strip()}" for i, p in enumerate(pages[:MOST_PARTS], 1) if p and p.strip()))


def nothing(path: str, data: bytes | None) -> str | None:
    """Stands for formats that need a plug-in (PDF, images): register a function for their endings."""
    return None


EXTRACTORS: dict[str, Extractor] = {e: office for e in OFFICE} | {"rtf": rtf, "txt": plain, "csv": plain, "canvas": canvas, "pdf": nothing, "png": nothing, "jpg": nothing, "jpeg": nothing}


def extract_text(files: DataFrame, extractors: dict[str, Extractor] | None = None) -> DataFrame:
    """path, mtime, text of files (path, mtime, content): text is null where nothing can be read. A map over rows."""
    known = EXTRACTORS | (extractors or {})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for path, data in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                try:
                    texts.append(known.get((path or "").rsplit(".", 1)[-1].lower(), nothing)(path or "", data))
                except Exception:  # an extractor never ends the scan
                    texts.append(None)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["path", "mtime", "text"])

    return files.select("path", "mtime", "content").mapInArrow(read, "path string, mtime bigint, text string")
