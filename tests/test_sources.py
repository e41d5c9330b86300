"""Vault folders, extractors, stores."""

import io
import json
import zipfile

from marginalia.operators import refresh
from marginalia.sources import extract as X
from marginalia.sources import vault


def archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


def test_office_files():
    doc = '<w:document><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t xml:space="preserve">a &amp;lt; </w:t></w:r><w:r><w:t>b</w:t></w:r></w:p><w:p/></w:document>'
    assert X.office("x.docx", archive(word__document_xml=doc)) == "## Title\n\na &lt; b"
    slide = "<a:p><a:r><a:t>{}</a:t></a:r></a:p>"
    deck = archive(**{f"ppt/slides/slide{i}.xml": slide.format(f"s{i}") for i in (10, 2, 1)})
    assert X.office("x.PPTX", deck) == "## Slide 1\n\ns1\n\n## Slide 2\n\ns2\n\n## Slide 3\n\ns10"
    book = archive(
        xl__workbook_xml='<sheets><sheet name="One &amp; all" sheetId="1"/></sheets>',
        xl__sharedStrings_xml="<sst><si><t>red</t></si><si><r><t>bl</t></r><r><t>ue</t></r></si></sst>",
        xl__worksheets__sheet1_xml='<row><c t="s"><v>0</v></c><c><v>5</v></c><c t="s"><v>1</v></c></row><row><c t="inlineStr"><is><t>in</t></is></c></row>',
    )
    assert X.office("x.xlsx", book) == "## One & all\n\nred blue\nin"
    odt = archive(content_xml='<office:text><text:h text:outline-level="2">Head</text:h><text:p>a<text:s/>b<text:span>c</text:span></text:p></office:text>')
    assert X.office("x.odt", odt) == "### Head\n\na bc"
    assert X.office("x.docx", b"no archive") is None and X.office("x.docx", None) is None
    assert X.office("x.docx", archive(word__document_xml="<w:p><w:t>open" * 1000)) is None


def test_archive_bombs(monkeypatch):
    monkeypatch.setattr(X, "ENTRY_BYTES", 1000)
    assert X.office("x.docx", archive(word__document_xml="<w:p><w:t>" + "a" * 5000 + "</w:t></w:p>")) is None
    monkeypatch.undo()
    monkeypatch.setattr(X, "ARCHIVE_BYTES", 1000)
    assert X.office("x.pptx", archive(**{f"ppt/slides/slide{i}.xml": "<a:p><a:t>" + "a" * 600 + "</a:t></a:p>" for i in range(1, 4)})) is None


def test_entities():
    assert X.decode_entities("&#65;&#x42;&lt;&amp;gt;&#1114112;&#xD800;") == "AB<&gt;��"
    assert [t for _, t in X.elements("<p>a</p><pre>x</pre><p/><p k='v'>b</p><p>open", "p")] == ["a", "", "b"]


def test_rtf():
    def read(s):
        return X.rtf("x.rtf", b"{\\rtf1\\ansi " + s + b"}")

    assert read(b"caf\\'e9 \\u8212?dash") == "café —dash"
    assert read(b"{\\fonttbl{\\f0 Arial;}}text {\\*\\hidden gone}more\\par next") == "text more\nnext"
    assert read(b"\\uc2\\u8364xx!") == "€!" and read(b"wrapped\r\nline") == "wrappedline"
    assert read(b"\\bin4 \\}{}x") == "x"
    assert X.rtf("x.rtf", b"plain") is None and X.rtf("x.rtf", b"{\\rtf1 " + b"{" * 100_000) is None


def test_plain_canvas_and_pages():
    assert X.plain("a/b.txt", b" hi \xff ") == "# b\n\nhi �" and X.plain("b.csv", b" ") is None
    nodes = [{"type": "text", "text": "two", "y": 10}, {"type": "text", "text": "one", "y": 0, "x": 5}, {"type": "group", "label": "G", "y": -1}, {"type": "file", "file": "a.md", "y": 20}, "junk"]
    assert X.canvas("x.canvas", json.dumps({"nodes": nodes, "edges": [{"label": "then"}, {}]}).encode()) == "## G\n\none\n\ntwo\n\n[[a.md]]\n\nthen"
    assert X.canvas("x.canvas", b"{") is None and X.canvas("x.canvas", b"[]") is None
    assert X.rendered_pages(["a", " ", None, "b"]) == "## Page 1\n\na\n\n## Page 4\n\nb"


def test_vault_scan_and_attachments(spark, tmp_path):
    root = tmp_path / "vault x+y"
    for name, text in {"Notes/a.md": "# A\nbody", "Notes/B.MD": "b", "Private/s.md": "secret", "Work/c.md": "#confidential text", "Files/t.txt": "plain", "Files/p.pdf": "%PDF"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    notes = vault.scan_notes(spark, str(root), exclude=["Private"], exclude_tags=["confidential"])
    assert {r["note_path"] for r in notes.collect()} == {"Notes/a.md", "Notes/B.MD"}
    known = notes.where("note_path = 'Notes/a.md'").select("note_path", "mtime")
    again = {r["note_path"]: r["unchanged"] for r in vault.scan_notes(spark, str(root), include=["Notes"], known=known).collect()}
    assert again == {"Notes/a.md": True, "Notes/B.MD": False}
    files = vault.read_binary(spark, str(root), ["txt", "pdf"])
    texts = {r["path"]: r["text"] for r in X.extract_text(files).collect()}
    assert texts == {"Files/t.txt": "# t\n\nplain", "Files/p.pdf": None}
    with_pdf = X.extract_text(files, {"pdf": lambda path, data: X.rendered_pages(["page"])})
    assert {r["note_path"] for r in vault.attachments(with_pdf).collect()} == {"Files/t.txt", "Files/p.pdf"}
    assert vault.read_binary(spark, str(root), most_bytes=4).count() == 2


def test_corpus_budget(spark):
    rows = spark.createDataFrame([("a", 1, "x" * 6), ("b", 1, "x" * 6), ("c", 1, "x"), ("n", 1, None)], "path string, mtime bigint, text string")
    assert [r["note_path"] for r in vault.attachments(rows, 10).orderBy("note_path").collect()] == ["a", "b"]


def test_changes_and_embedding_plan(spark):
    new = spark.createDataFrame([("a", 5), ("c", 1), ("s", 2), ("f", 2)], "note_path string, mtime bigint")
    old = spark.createDataFrame([("a", 9), ("b", 1), ("s", 2), ("f", 2)], "note_path string, mtime bigint")
    got = {r[0]: r[1] for r in refresh.changes(new, old, spark.createDataFrame([("f",)], "note_path string")).collect()}
    assert got == {"a": "updated", "b": "removed", "c": "added", "s": "unchanged", "f": "updated"}
    c, v = (spark.createDataFrame(x, "chunk_id string, h string") for x in ([("a", "1"), ("b", "2"), ("n", None)], [("a", "1"), ("b", "9"), ("x", "1")]))
    assert {r[0]: r[1] for r in refresh.embedding_plan(c, v).collect()} == {"a": "reuse", "b": "embed", "n": "embed", "x": "remove"}
    assert {r[1] for r in refresh.embedding_plan(c, v, same_identity=False).collect()} == {"embed", "remove"}


def test_store_versions(spark, tmp_path):
    store = refresh.Store(spark, str(tmp_path / "s"))
    assert store.load() is None
    assert store.save(spark.range(3), changed=0) is False and store.load() is None
    assert store.save(spark.range(3), note_count=3) and store.save(spark.range(5), note_count=5)
    assert store.load().count() == 5 and store.properties()["note_count"] == 5
    assert refresh.Store(spark, str(tmp_path / "s"), version=99).load() is None
    store.clear()
    assert store.load() is None
