"""Markup, splitting, distinctive terms, canonical duplicates, mixing: small tables with every awkward case."""

import collections
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from marginalia.llm import canonical, distinctive, markup, mixing, splitting

CASES = {
    "plain text, 5 * 3 * 4, a < b > c, R&D; costs $8 to $9, D:\\kiln\\x, x[4], {y}, a_b_c, I <3 it, #34": set(),
    "50 % | 20 %\nrow": set(),
    "see <b>bold</b>": {"html"},
    "a &amp; b": {"html"},
    "<!-- gone -->x": {"html"},
    "''x'' here": {"wiki"},
    "[[Note|shown]]": {"wiki"},
    "== Head ==": {"wiki"},
    "{{stub}}": {"wiki"},
    "{{Infobox\n|a=1\n|b=[x](y)\n}}": {"wiki"},
    '{| class="x"\n! a !! b\n|-\n| 1 || 2\n|}': {"wiki"},
    "\\section{A}": {"latex"},
    "$x_1$ and": {"latex"},
    "\\[ a \\]": {"latex"},
    "$$\na\n$$": {"latex"},
    "\\begin{itemize}\n\\item a\n\\end{itemize}": {"latex"},
    "## h": {"markdown"},
    "Head\n-----\ntext": {"markdown"},
    "- item": {"markdown"},
    "1. item": {"markdown"},
    "> quote": {"markdown"},
    "| a | b |\n|---|---|\n| 1 | 2 |": {"markdown"},
    "**b** ~~c~~": {"markdown"},
    "[a](b.md)": {"markdown"},
    "`<b>` and `[[x]]`": {"markdown"},
    "```\n<b>\n\n[[x]] $1$\n```": {"markdown"},
    "~~~\n\\x{y}": {"markdown"},
    "**b** and <i>i</i> and [[w]] and $x$": {"markdown", "html", "wiki", "latex"},
}


@pytest.mark.parametrize("text", CASES)
def test_families(text):
    assert markup.render(text)[1] == CASES[text]


def test_clean_text_keeps_structure():
    def clean(s):
        return markup.render(s)[0]

    assert clean("<h2>A</h2><p>one<p>two<ul><li>x<li>y</ul>") == "## A\n\none\n\ntwo\n\n- x\n- y"
    assert clean("<table><tr><td>a<td>bbb<tr><td>cc<td>d</table>") == "a   bbb\ncc  d"
    assert clean("<p>seen<span style='display:none'>not</span><script>x()</script></p>") == "seen"
    assert clean("```py\nx = 1\n\n  y\n```\nthen") == "x = 1\n\n  y\n\nthen"
    assert clean("\\section{T} text \\emph{x} $a_1$ \\cite{k}") .startswith("## T\n\ntext x $a_1$")
    assert clean("| a | b |\n|---|---|\n| 1 | 22 |") == "a  b\n1  22"
    assert clean("'''Bold''' [[a|b]] {{x}} [c](d) &lt;tag&gt;") == "Bold b c <tag>"
    assert clean("- a\n  - b\n- [x] c") == "- a\n  - b\n- [x] c"
    assert clean("1. a\n2. b") == "1. a\n2. b"
    assert clean("<pre><code>f(1)\n  g()</code></pre>") == "f(1)\n  g()"
    assert clean(None) == clean("") == clean(" \n") == ""


def test_markup_is_linear():
    for s in ("<!--", "{{", "[[", "$$", "\\[", "`", "**", "<b", "&", "''", "[", "\\begin{equation}", "<", "\\x{", "<div>", "<b>", "\\x{a}", "{{}}", "<li>"):
        markup.render(s * 20_000)
        markup.render((s + " ") * 20_000)


def test_markup_table(spark):
    rows = [("1", "# H <b>x</b>\n\ntext", "H <b>x</b>", "clash"), ("1", "# H <b>x</b>\n\ntext", "H <b>x</b>", "clash"), ("2", None, None, None), ("3", "", " ", ""), (None, "*a*", None, ""), ("4", "\r\n\r\n## *P*\r\n[[x]]", "*P*", "")]
    df = spark.createDataFrame(rows, "chunk_id string, text string, heading string, family string")
    assert {tuple(r) for r in markup.families(df).collect()} == {("1", "heading", "html"), ("4", "heading", "markdown"), ("4", "text", "wiki")}
    assert markup.clean(df).count() == 6 and markup.families(df.limit(0)).count() == 0


def chunks(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, heading_path array<string>, start_line int, text string, piece string, cut_at string")


def test_pieces(spark):
    rng = random.Random(2)
    words = " ".join("w" * rng.randrange(1, 12) for _ in range(2000))
    paras = "\n\n".join("\n".join("line %d of it." % i for i in range(rng.randrange(1, 9))) for _ in range(60))
    texts = {"words": words, "paras": "  \r\n\n" + paras + "\n \n", "none": "x" * 7001, "cjk": "字" * 4500, "crlf": paras.replace("\n", "\r\n"), "emoji": "😀 " * 2500, "short": "a" * 2000, "blank": " " * 5000, "long": "ab cd.\n" * 60_000}
    rows = [(k, ["H"], 10, t, "clash", "clash") for k, t in texts.items()] + [("words", ["H"], 10, words, "", ""), ("null", None, None, None, "", ""), (None, None, 1, words, "", "")]
    df = chunks(spark, rows)
    got = collections.defaultdict(list)
    for r in splitting.split_pieces(df).orderBy("chunk_id", "piece_no").collect():
        got[r["chunk_id"]].append(r)
    assert set(got) == {"words", "paras", "none", "cjk", "crlf", "emoji", "long"}
    for k, pieces in got.items():
        assert_pieces(texts[k], pieces, 2000, 150, 10)
        assert all(r["heading_path"] == ["H"] for r in pieces)
    assert {k: v[0]["cut_at"] for k, v in got.items()} == {"words": "word", "paras": "paragraph", "none": "none", "cjk": "none", "crlf": "paragraph", "emoji": "word", "long": "line"}
    assert splitting.split_pieces(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        splitting.split_pieces(df, 100, 100)


def assert_pieces(text, pieces, limit, overlap, first_line):
    """Pieces within the limit, each its overlap and its own text, in order, with nothing but white space between the own texts."""
    body, at = text.strip(" \t\r\n"), 0
    lead = text.index(body)
    for i, r in enumerate(pieces):
        own = r["piece"][r["lap"] :]
        assert r["piece_no"] == i and len(r["piece"]) <= limit and own.strip()
        start = at
        while not body.startswith(own, start):
            assert body[start] in " \t\r\n"
            start += 1
        assert r["lap"] == min(overlap, start, limit - len(own)) and r["piece"][: r["lap"]] == body[start - r["lap"] : start]
        assert r["start_line"] == first_line + text[: lead + start].count("\n")
        at = start + len(own)
    assert at == len(body)


def level_of(body, limit):
    """The definition, in plain Python."""
    for name, pattern in (("paragraph", r"\n(?:[ \t\r]*\n)+"), ("line", r"\n"), ("word", r"[ \t\r\n]+")):
        if max(map(len, re.split(pattern, body))) <= limit:
            return name
    return "none"


def test_pieces_of_random_texts_are_whole_and_cut_as_defined(spark):
    rng = random.Random(5)
    texts = {}
    for i in range(1500):
        marks = rng.choice(["a.", "ab \n", "a \n\n", "abc \t\n\n", "é.\n \t\r"])
        texts[f"t{i}"] = "".join(rng.choice(marks) * rng.choice([1, 1, 1, 2, 5, 19, 20, 21]) for _ in range(rng.randrange(1, 40)))
    rows = [(k, [], 0, t, "", "") for k, t in texts.items()]
    df = chunks(spark, rows)
    got = collections.defaultdict(list)
    for r in splitting.split_pieces(df, 20, 6).orderBy("chunk_id", "piece_no").collect():
        got[r["chunk_id"]].append(r)
    assert set(got) == {k for k, t in texts.items() if len(t.strip(" \t\r\n")) > 20}
    for k, pieces in got.items():
        assert_pieces(texts[k], pieces, 20, 6, 0)
        assert {r["cut_at"] for r in pieces} == {level_of(texts[k].strip(" \t\r\n"), 20)}, texts[k]
    levels = splitting.oversized(df, 20).select("chunk_id", splitting.cut_level(F.col("body"), 20).alias("l")).collect()
    assert {r["chunk_id"]: r["l"] for r in levels} == {k: v[0]["cut_at"] for k, v in got.items()}


def test_paragraphs_that_fit_stay_whole(spark):
    paragraphs = [" ".join(["word"] * 389) + " end." for _ in range(3)]
    paragraphs = [p[:1945].strip() + " end." for p in paragraphs]
    got = splitting.split_pieces(chunks(spark, [("c", [], 0, "\n\n".join(paragraphs), "", "")])).orderBy("piece_no").collect()
    assert [r["piece"][r["lap"] :] for r in got] == paragraphs and {r["cut_at"] for r in got} == {"paragraph"}


def test_very_long_text_takes_linear_time(spark):
    text = "\n\n".join("Sentence number one is here. And then another follows it, twice as long as that. " * 8 for _ in range(6000))
    began = time.time()
    rows = splitting.split_pieces(chunks(spark, [("c", [], 0, text, "", "")])).select("piece_no", F.length("piece").alias("n")).collect()
    assert len(rows) > 2000 and max(r["n"] for r in rows) <= 2000 and time.time() - began < 30
    blank = "x\n" + "\n" * 200_000 + "y" * 3000
    assert [r["cut_at"] for r in splitting.split_pieces(chunks(spark, [("b", [], 0, blank, "", "")])).collect()][0] == "none"


def test_ppmi_equals_brute_force(spark):
    rng = random.Random(4)
    words = ["alpha", "Bravo", "charlie", "élève", "delta", "tiny"]
    rows = [(f"c{i}", " ".join(rng.choices(words, k=rng.randrange(0, 12))), rng.choice([None, ["Bravo x", "ALPHA_2"]])) for i in range(30)]
    rows += [rows[0], ("n", None, None), (None, "alpha", None), ("e", "", [])]
    df = spark.createDataFrame(rows, "chunk_id string, text string, aliases array<string>").withColumn("term", F.lit("clash"))
    bags = {c: collections.Counter(x.lower() for s in [t or "", *(a or [])] for x in re.findall(r"[^\W\d_]+", s) if len(x) >= 5) for c, t, a in rows if c}
    z = sum(sum(b.values()) ** 0.75 for b in bags.values())
    total, seen = collections.Counter(), collections.Counter()
    for b in bags.values():
        total.update(b)
        seen.update(b.keys())
    want = {(c, t): (n, seen[t], round(max(0, math.log2(n * z / (total[t] * sum(b.values()) ** 0.75))), 6)) for c, b in bags.items() for t, n in b.items()}
    got = {(r["record"], r["term"]): (r["n"], r["records"], round(r["ppmi"], 6)) for r in distinctive.ppmi(df, "chunk_id", F.col("text"), F.array_join("aliases", "\n")).collect()}
    assert got == want
    assert distinctive.distinctive_terms(df.limit(0)).count() == 0


def test_counts_decide_what_is_distinctive_and_unused_scores_are_pruned(spark, tmp_path):
    from marginalia.llm import queries

    rows = [("much", "alpha " * 300, []), ("little", "alpha " * 3 + "other " * 997, []), ("twice", "bravo bravo", ["bravo"]), ("again", "bravo", None), ("alone", "delta " * 3, [])]
    df = spark.createDataFrame(rows, "chunk_id string, text string, aliases array<string>")
    got = {(r["chunk_id"], r["term"]): r["ppmi"] for r in distinctive.distinctive_terms(df).collect()}
    scores = {(r["record"], r["term"]): r["ppmi"] for r in distinctive.ppmi(df, "chunk_id", F.col("text"), F.array_join("aliases", "\n")).collect()}
    assert got.keys() == {("much", "alpha"), ("little", "alpha"), ("twice", "bravo")} and got == {k: scores[k] for k in got}
    assert got["little", "alpha"] == 0 < got["much", "alpha"]
    df.write.parquet(f"{tmp_path}/chunks.parquet")
    found = queries.p3_found(spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == got.keys()
    assert "log2" not in found._jdf.queryExecution().optimizedPlan().toString().lower()


def test_canonical_duplicates(spark):
    rows = [
        (5, "Keep it – simple.", "note", "My Project"),
        (3, "keep IT simple", "Note ", "my_project"),
        (4, "keep IT simple", "Note ", "my_project"),
        (9, "Keep it simple!", "note", None),
        (10, "Keep it simple!", "note", "  "),
        (11, '{"b": "2 x", "a": 1}', "note", None),
        (12, "A = 1; b = 2 X;", "note", ""),
        (13, "b: 2x\r\na : 1", "NOTE", ""),
        (14, "a1 b2x", "note", ""),
        (15, "b2x a1", "note", ""),
        (16, None, None, None),
        (17, "", "", "-"),
        (18, "straße", "note", "p"),
        (19, "STRASSE", "note", "p"),
        (20, "{broken", "note", "p"),
        (None, "keep it simple", "note", None),
    ]
    df = spark.createDataFrame(rows, "entry_id bigint, content string, entry_type string, project string").withColumn("first", F.lit(7)).withColumn("rep", F.lit(7))
    got = sorted((r["first"], r["copies"]) for r in canonical.classes(df, "entry_id", "content", "entry_type", "project").collect())
    assert got == [(3, 3), (9, 2), (11, 5), (16, 2), (18, 2), (20, 1)]
    pairs = {tuple(r) for r in canonical.members(df, "entry_id", "content", "entry_type", "project").where("entry_id <> first").collect()}
    assert pairs == {(3, 4), (3, 5), (9, 10), (11, 12), (11, 13), (11, 14), (11, 15), (16, 17), (18, 19)}
    assert canonical.members(df.limit(0), "entry_id", "content", "entry_type", "project").count() == 0
    many = spark.range(30_000).select(F.col("id").alias("entry_id"), F.lit("same thing").alias("content"), F.lit("note").alias("entry_type"), F.lit(None).cast("string").alias("project"))
    assert canonical.members(many, "entry_id", "content", "entry_type", "project").where("first = 0").count() == 30_000


def test_mixing(spark):
    rows = [(i, "w " * 10, "big") for i in range(4000)] + [(i, "w " * 10, "small") for i in range(4000, 4100)] + [(9000, "x", None), (9001, None, "small"), (9002, "x", "other"), (9003, "", "big")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("rate", F.lit(1)).withColumn("tokens", F.lit(5))
    targets = spark.createDataFrame([("big", 0.6, 3), ("small", 0.1, 2), ("small", 0.1, 2), ("none", 0.3, 5), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    plan = {r["source"]: r for r in mixing.source_rates(docs, targets).collect()}
    assert plan["big"]["tokens"] == 40_000 and abs(plan["big"]["rate"] - 0.615) < 1e-9 and not plan["big"]["capped"]
    assert plan["small"]["rate"] == 2.0 and plan["small"]["capped"] and plan["none"]["capped"] and plan["none"]["rate"] == 0
    mixed = mixing.mix(docs, targets).groupBy("source").agg(F.count("*").alias("n"), F.max("copy").alias("m")).collect()
    got = {r["source"]: r for r in mixed}
    assert got["small"]["n"] == 202 and got["small"]["m"] == 2 and abs(got["big"]["n"] - 2460) < 150
    again = mixing.mix(docs.repartition(7), targets)
    assert sorted(map(tuple, again.select("doc_id", "copy").collect())) == sorted(map(tuple, mixing.mix(docs, targets).select("doc_id", "copy").collect()))
    assert abs(sum(r["actual_share"] for r in mixing.shares(docs, targets).collect()) - 1) < 1e-9
    assert mixing.mix(docs.limit(0), targets).count() == 0 and mixing.shares(docs.limit(0), targets).count() == 3
    assert mixing.source_rates(docs, targets.limit(0)).count() == 0


def test_tokens_of_a_public_tokenizer(spark):
    public = pytest.importorskip("public_tokenizers")
    count = mixing.bpe_tokens(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    df = spark.createDataFrame([("Hello world",), (None,), ("",)], "text string")
    assert [r[0] for r in df.select(count("text")).collect()] == [2, 0, 0]


def test_stray_braces_hide_no_template():
    text, families = markup.render("a {{ stray, then {{stub}} and {{Infobox\n|a={{b}}\n}} end")
    assert families == {"wiki"} and text == "a {{ stray, then and end"
    assert markup.render("}} {{x}} y")[0] == "}} y"
    assert markup.render("{{ " * 20000)[1] == set() and markup.render("{{ " * 20000 + "{{x}}")[1] == {"wiki"}


def test_formulas_are_kept_whole():
    for formula in ("$a +\n\\frac{a}{b}$", "$" + "x + " * 200 + "\\frac{a}{b}$", "\\begin{aligned}\n\\frac{a}{b} &= c\n\\end{aligned}", "\\begin{own}\n\\frac{a}{b} = x^2\n\\end{own}"):
        text, families = markup.render(f"see {formula} here")
        assert formula in text and families == {"latex"}
    assert markup.render("so \\frac{a}{b} is")[0] == "so \\frac{a}{b} is"


def test_inline_markup_wraps_and_has_any_length():
    assert markup.render("a [long\nlink](u.md) b") == ("a long link b", {"markdown"})
    assert markup.render("a **bold\ntext** b ~~x\ny~~") == ("a bold text b x y", {"markdown"})
    assert markup.render('a <span\n class="x"\n id="z">y</span> b') == ("a y b", {"html"})
    assert markup.render("a [[Note|two\nwords]] b") == ("a two words b", {"wiki"})
    assert markup.render("![i](data:image/png;base64," + "A" * 5000 + ") b") == ("i b", {"markdown"})
    assert markup.render("**" + "x " * 900 + "y** b")[1] == {"markdown"}
    assert markup.render("- it costs *a\n- b* c")[0] == "- it costs *a\n- b* c"


SHOWN = [
    ("\\begin{tabular}{l|l}\n\\hline\na & b \\\\\nc & \\textbf{d} \\\\\n\\end{tabular}", "a  b\nc  d"),
    ('<p title="the hidden gem">words</p>', "words"),
    ('<p class="x hidden y">shown</p><p hidden>gone</p><p style="display: none">gone</p>', "shown"),
    ("<table><caption>Cap</caption><tr><td>a</td><td>b</td></tr>stray</table>", "Cap\n\nstray\n\na  b"),
    ("{|\n|+ Caption here\n! a !! b\n|-\n| 1 || 2\n|}", "Caption here\n\na  b\n1  2"),
    ("<select><option>one<option selected>two</select>", "one two"),
    ("<ul><li>x<pre>a\n  b\nc</pre></li></ul>", "- x\n  a\n    b\n  c"),
    ("- item\n\n  ```\n  code\n    more\n  ```\n- next", "- item\n  code\n    more\n- next"),
    ("- item\n```\ncode\n```\nafter", "- item\n\ncode\n\nafter"),
    ("\\textbf{two\nlines} end", "two lines end"),
    ("> - a\n> - b\n>\n> # c\n\nout", "- a\n- b\n\n# c\n\nout"),
    ("* one\n** two\n*** three\n* four", "- one\n  - two\n    - three\n- four"),
    ("; term\n: definition", "term\n\ndefinition"),
    ('<ol start="5"><li>a<li>b<li value="9">c</ol>', "5. a\n6. b\n9. c"),
    ("| a \\| x | b |\n|---|---|\n| 1 | 2 |", "a | x  b\n1      2"),
    ("<table><tr><td>out<table><tr><td>in1</td><td>in2</td></tr></table></td><td>z</td></tr></table>", "out in1 in2  z"),
    ("\\begin{quote}hi there\\end{quote}", "hi there"),
    ("body[^1]\n\n[^1]: footnote text", "body\n\nfootnote text"),
    ("[Note]: this is text that stays", "[Note]: this is text that stays"),
    ("<ul><li>a<ul><li>b<table><tr><td>1</td><td>2</td></tr></table></li></ul></li></ul>", "- a\n  - b\n    1  2"),
]


@pytest.mark.parametrize("text,want", SHOWN)
def test_visible_text_and_structure_stay(text, want):
    assert markup.render(text)[0] == want


def test_no_visible_word_is_lost_or_invented():
    """Words inside random markup of all families come out in order, each once."""
    rng = random.Random(11)
    inline = ["{}", "**{}**", "*{}*", "<b>{}</b>", "<i class='a hidden b'>{}</i>", "''{}''", "[[T|{}]]", "[{}](u)", "\\emph{{{}}}", "\\textbf{{{}}}", "~~{}~~", "<span\n id='x'>{}</span>", "`{}`"]
    blocks = ["{}", "# {}", "- {}\n- {}", "> {}", "> - {}\n> # {}", "== {} ==", "<p>{}", "<ul><li>{}<li>{}</ul>", "<table><tr><td>{}<td>{}<tr><td>{}</table>", "| {} | {} |\n|---|---|\n| {} | {} |", "{{|\n| {} || {}\n|-\n| {}\n|}}", "\\begin{{itemize}}\n\\item {}\n\\item {}\n\\end{{itemize}}", "\\begin{{tabular}}{{ll}}\n{} & {} \\\\\n{} & {}\n\\end{{tabular}}", "```\n{}\n  {}\n```", "- {}\n\n  ```\n  {}\n  ```", "<pre>{}\n{}</pre>", "1. {}\n   1. {}", "<blockquote>{}<p>{}</blockquote>", "<!-- gone -->{}", "<dl><dt>{}<dd>{}</dl>"]
    for _ in range(1500):
        count, parts = 0, []
        for _ in range(rng.randrange(1, 6)):
            block = rng.choice(blocks)
            literal = block.startswith(("```", "<pre", "- {}\n\n  ```"))
            holes = len(re.findall(r"(?<!\{)\{\}(?!\})", block))
            words = []
            for _ in range(holes):
                word = f"w{count}x"
                words.append(word if literal else rng.choice(inline).format(word))
                count += 1
            parts.append(block.format(*words))
        text = "\n\n".join(parts)
        assert re.findall(r"w\d+x", markup.render(text)[0]) == [f"w{i}x" for i in range(count)], text


def test_deep_and_hostile_markup_is_bounded():
    for text in ("> " * 3000 + "x", "- " * 3000 + "x", "\\textbf{" * 3000 + "x" + "}" * 3000, "<b>" * 3000 + "x", "    ```\n" * 3000, "\\a[" * 20000, "[" * 20000, "<ul><li>" * 400 + "x"):
        began = time.time()
        assert "x" in markup.render(text)[0] or "x" not in text
        assert time.time() - began < 5
