"""String functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as ECMAScript defines it (fixed values); Java's ``\\s`` and Spark's ``trim`` know less.
WS = "[\\t\\n\\x0B\\f\\r \\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"

WS_INLINE = "[\\t\\x0B\\f\\r \\xA0\\u1680\\u2000-\\u200A\\u202F\\u205F\\u3000\\uFEFF]"

#: Stop words of retrieval (fixed values).
STOP_WORDS = "the a an and or of to in is are was were for on with as at by it this that be from".split()

#: Stop words of summaries (fixed values).
SUMMARY_STOP_WORDS = (
    "the a an and or but if then else for of to in on at by is are was were be been being it its this that these those as with "
    "from into so such not no do does did can will would should may might must have has had we you they he she i our your their "
    "them us which who what when where how why there here than too very just"
).split()


#: The same characters one by one.
WS_CHARS = "\t\n\x0b\f\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def strip_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def collapse_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"{WS}++", " ")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def link_key(c: Column) -> Column:
    """Key under which links and paths meet: the last non-empty segment, trimmed, without ``.md``, in lower case; '' if none."""
    cut = F.translate(F.substring_index(F.substring_index(c, "#", 1), "|", 1), "\\", "/")
    last = strip_ws(F.substring_index(F.rtrim(cut, F.lit("/")), "/", -1))
    name = F.when(F.lower(last).endswith(".md"), F.substring(last, F.lit(1), F.length(last) - 3)).otherwise(last)
    return F.lower(strip_ws(name))


def tokens(c: Column) -> Column:
    """Terms of retrieval: lower case, runs of ``a-z0-9`` of two or more, without stop words."""
    return F.filter(raw_tokens(c), lambda t: ~t.isin(STOP_WORDS))


def raw_tokens(c: Column) -> Column:
    """As :func:`tokens`, stop words kept."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: F.length(t) >= 2)


def summary_tokens(c: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9][a-z0-9'-]*"), F.lit(0)), lambda t: ~t.isin(SUMMARY_STOP_WORDS))


def sentences(c: Column) -> Column:
    """Sentences of a text line by line: one marker (heading, list, quote or number) is taken off each line; two or more characters."""
    lines = F.split(c, "\\r?\\n+")
    bare = F.transform(lines, lambda x: strip_ws(F.regexp_replace(strip_ws(x), f"^(?:#{{1,6}}{WS}+|[-*+]{WS}+|>{WS}*|\\d+[.)]{WS}+)", "")))
    parts = F.flatten(
        F.transform(
            bare,
            lambda x: F.when(
                F.size(F.regexp_extract_all(x, F.lit("[^.!?]+(?:[.!?]+|$)"), F.lit(0))) > 0,
                F.regexp_extract_all(x, F.lit("[^.!?]+(?:[.!?]+|$)"), F.lit(0)),
            ).otherwise(F.array(x)),
        )
    )
    return F.filter(F.transform(parts, strip_ws), lambda s: F.length(s) >= 2)


def content_key(c: Column) -> Column:
    return F.lower(collapse_ws(strip_ws(c)))


def tag_list(tags: Column, base: str) -> Column:
    """Tags as written into a note: the base tag first, ``#`` off, white space as ``-``, each once."""
    clean = F.transform(tags, lambda t: F.regexp_replace(strip_ws(F.regexp_replace(strip_ws(t), "^#+", "")), f"{WS}++", "-"))
    return F.array_distinct(F.concat(F.array(F.lit(base)), F.filter(clean, lambda t: t != "")))


def day_label(ms: Column) -> Column:
    return F.coalesce(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd"), F.lit(""))


def one_line(c: Column) -> Column:
    """A value that must stay on one line: line breaks with the white space around them become a space."""
    return strip_ws(F.regexp_replace(c, f"{WS}*[\\r\\n]+{WS}*", " "))


def neutral_headings(c: Column) -> Column:
    """Lines that would read as the heading of an inbox block are indented by a space."""
    return F.regexp_replace(c, "(?m)^(?=## Pending Memory: )", " ")


def breadcrumb(heading_path: Column, heading: Column) -> Column:
    parts = F.filter(F.concat(F.coalesce(heading_path, F.array().cast("array<string>")), F.array(F.coalesce(heading, F.lit("")))), lambda x: strip_ws(x) != "")
    return F.when(F.size(parts) == 0, "(top)").otherwise(F.array_join(parts, " › "))


def line_range(start: Column, end: Column) -> Column:
    """Label of a 0-based line span, counted from 1."""
    return F.when(start == end, F.concat(F.lit("line "), (start + 1).cast("string"))).otherwise(F.concat(F.lit("lines "), (start + 1).cast("string"), F.lit("-"), (end + 1).cast("string")))


def clipped(c: Column, most: int, hint: str = "\n… (clipped)") -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(hint))).otherwise(c)


def project_folder(c: Column) -> Column:
    """A project name as one safe path segment; null if nothing safe is left."""
    clean = F.regexp_replace(strip_ws(c), "[\\\\/]+", "-")
    clean = F.regexp_replace(F.regexp_replace(clean, '[<>:"|?*]+', ""), "\\.+$", "")
    clean = strip_ws(collapse_ws(clean))
    return F.when((clean != "") & (clean != ".") & (clean != ".."), clean)


def title_words(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("-"), F.lit(" ")))


def attachment_title(path: Column) -> Column:
    return F.regexp_replace(basename(path), "(?i)\\.[a-z0-9]+$", "")


def normal_text(c: Column) -> Column:
    """Extracted text: lines without trailing white space, at most one blank line in a row."""
    return F.regexp_replace(F.regexp_replace(c, f"(?<!{WS_INLINE}){WS_INLINE}++(?=\\n|\\z)", ""), "\n{3,}", "\n\n")


def inline_tags(c: Column) -> Column:
    """``#tags`` of a text that follow its start, white space or an opening bracket; mere numbers are none."""
    found = F.regexp_extract_all(c, F.lit(f"(^|{WS}|\\()#([A-Za-z0-9_][A-Za-z0-9_/-]*)"), F.lit(2))
    return F.filter(found, lambda t: ~t.rlike("^[0-9]+$"))


def fnv1a(c: Column) -> Column:
    """FNV-1a of 32 bits over the UTF-16 units of a text, as hexadecimal digits."""
    codes = F.transform(F.filter(F.split(c, ""), lambda s: s != ""), lambda s: F.ascii(s).cast("long"))

    def units(x: Column) -> Column:
        beyond = x - 65536
        return F.when(x > 65535, F.array(F.shiftright(beyond, 10) + 55296, beyond.bitwiseAND(F.lit(1023)) + 56320)).otherwise(F.array(x))

    h = F.aggregate(F.flatten(F.transform(codes, units)), F.lit(2166136261).cast("long"), lambda a, x: (a.bitwiseXOR(x) * 16777619).bitwiseAND(F.lit(4294967295)))
    return F.lower(F.hex(h))
