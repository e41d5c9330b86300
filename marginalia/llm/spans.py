"""Long exact spans shared between records: runs of consecutive sentences, hashed and joined; characters compared where runs differ.

From every sentence start two spans slide over the following sentences: the run of the fewest whole sentences that make
``SPAN`` characters, and its first ``ANCHOR`` characters. The anchor's hash is the join key, the run's hash decides: where all
texts with an anchor have the same run, they share a stretch of ``SPAN`` characters, and nothing more is looked at. A shared
stretch starts in mid-sentence as often as not, so whole sentences alone would miss some; where no sentence starts for
``REACH`` characters, a start is set by content (the smallest hash of eight characters in every window), which two texts with
the same characters set alike. Hence each stretch of ``SPAN`` characters has a start in its first ``REACH`` characters, and
with ``REACH + ANCHOR = SPAN`` the anchor from there lies inside it. Texts with one anchor and different runs are compared
character by character around it, so that no stretch is missed and none is invented.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from marginalia.operators import bloom
from marginalia.session import materialize

SPAN = 200
ANCHOR = 80
REACH = SPAN - ANCHOR
#: Occurrences of one span up to which its texts are paired and compared; above, all windows around it are hashed instead.
MOST_PAIRED = 64
_GRAM = 8
_SLICE = 1 << 20
_B = np.uint64(0x9E3779B97F4A7C15)
_B_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STOPS = np.array([ord(c) for c in ".!?\n。！？"], np.uint32)
_BLANKS = np.array([ord(c) for c in " \t\r"], np.uint32)
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        seq = np.full(max(n, _SLICE), base, np.uint64)
        seq[0] = 1
        with np.errstate(over="ignore"):
            have = _powers[int(base)] = np.cumprod(seq, dtype=np.uint64)
    return have[:n]


def starts(texts: list[str], reach: int = REACH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where spans start in the texts: number of the text, position, hash of the ``anchor`` characters from there, and hash of the
    shortest run of whole sentences from there that has ``reach + anchor`` characters (0 where there is none)."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) for t in texts]).astype(np.int64)
    begins = ends - np.array([len(t) for t in texts], np.int64)
    n = len(chars)
    if n < anchor:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * _power(_B, n), out=sums[1:], dtype=np.uint64)
        inverse = _power(_B_INVERSE, n)

        def hashes(at: np.ndarray, length: int | np.ndarray) -> np.ndarray:
            h = (sums[at + length] - sums[at]) * inverse[at]
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            return h ^ (h >> np.uint64(29))

        stop, blank = np.isin(chars, _STOPS), np.isin(chars, _BLANKS)
        flag = np.zeros(n, bool)
        flag[1:] = stop[:-1]
        flag[2:] |= blank[1:-1] & stop[:-2]
        flag &= ~(stop | blank)
        flag[begins[begins < n]] = True  # the first sentence of each text
        width = reach - _GRAM
        found = np.flatnonzero(flag)
        owner = np.searchsorted(ends, found, side="right")
        last_of_text = np.append(owner[1:] != owner[:-1], True)
        until = np.where(last_of_text, ends[owner] - _GRAM + 1, np.append(found[1:], n))
        until = np.minimum(until, ends[np.minimum(owner, len(ends) - 1)] - _GRAM + 1)
        extra = [found]
        for lo, hi, first in zip(*(x[until - found >= width - 1] for x in (found, until, begins[owner])), strict=True):
            low = max(first, lo - 1)
            if hi - low >= width:
                h = hashes(np.arange(low, hi), _GRAM)
                extra.append(low + np.unique(np.lib.stride_tricks.sliding_window_view(h, width).argmin(axis=1) + np.arange(len(h) - width + 1)))
        at = np.unique(np.concatenate(extra))
        owner = np.searchsorted(ends, at, side="right")
        inside = at + anchor <= ends[owner]
        at, owner = at[inside], owner[inside]
        # a run ends with the last sentence that starts before the next start, blanks behind it aside, or with its text
        last = np.maximum.accumulate(np.where(blank, 0, np.arange(1, n + 1)))
        stops = np.append(np.where(found > 0, last[np.maximum(found - 1, 0)], 0), n)
        nxt = np.searchsorted(stops, at + reach + anchor)
        until = np.minimum(stops[np.minimum(nxt, len(stops) - 1)], ends[owner])
        whole = flag[at] & (until - at >= reach + anchor)
        run = np.where(whole, hashes(at, np.where(whole, until - at, anchor)).view(np.int64) | 1, 0)
        return owner, at - begins[owner], hashes(at, anchor).view(np.int64), run


def _sliced(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about _SLICE characters, with the number of the first: bounds the memory whatever the batch."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > _SLICE:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    yield first, texts[first:]


def _cls(text: str = "text") -> Column:
    """What documents of one text have in common: the 128 bits of its MD5."""
    return F.unhex(F.md5(F.col(text)))


def text_classes(documents: DataFrame) -> DataFrame:
    """doc_id, cls, len: documents of one text are one class; null ids, null and empty texts have none."""
    return documents.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select("doc_id", _cls().alias("cls"), F.length("text").alias("len"))


def sentence_spans(documents: DataFrame, span: int = SPAN, anchor: int = ANCHOR) -> DataFrame:
    """The hashed spans of every text: cls, pos, h (of the anchor), run (of the sentences, 0 if none)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in _sliced(b.column(1).to_pylist()):
                owner, at, h, run = starts(texts, span - anchor, anchor)
                yield pa.record_batch([b.column(0).take(pa.array(first + owner)), pa.array(at, pa.int32()), pa.array(h), pa.array(run)], names=["cls", "pos", "h", "run"])

    texts = documents.where(F.col("doc_id").isNotNull() & (F.length("text") >= span)).select(_cls().alias("cls"), "text")
    return texts.mapInArrow(scan, "cls binary, pos int, h long, run long")


def repeated_spans(documents: DataFrame, span: int = SPAN, anchor: int = ANCHOR) -> DataFrame:
    """Spans whose anchor several different texts have, each place once: cls, pos, h, run, agree (all its places have one run)."""
    spans = sentence_spans(documents, span, anchor)
    same = (F.min("run") == F.max("run")) & (F.min("run") != 0)
    repeated = spans.groupBy("h").agg(F.min(F.xxhash64("cls")).alias("lo"), F.max(F.xxhash64("cls")).alias("hi"), same.alias("agree")).where("lo < hi").select("h", "agree")
    return materialize(spans.join(repeated, "h").distinct(), "repeated-spans")


def contexts(documents: DataFrame, found: DataFrame, span: int = SPAN, anchor: int = ANCHOR) -> DataFrame:
    """The text around repeated spans: h, cls, pos, before, after (anchor included)."""
    near = bloom.build(found, "cls", found.count()).probe(documents.where(F.col("doc_id").isNotNull()).select(_cls().alias("cls"), "text"), "cls")
    texts = near.where("maybe").groupBy("cls").agg(F.min("text").alias("text"))
    lead = F.least("pos", F.lit(span - anchor))
    return found.join(texts, "cls").select(
        "h", "cls", "pos", F.substring(F.col("text"), F.col("pos") - lead + 1, lead).alias("before"), F.substring(F.col("text"), F.col("pos") + 1, F.lit(span)).alias("after")
    )


def shared_intervals(documents: DataFrame, found: DataFrame, span: int = SPAN, anchor: int = ANCHOR, most_paired: int = MOST_PAIRED) -> tuple[DataFrame, DataFrame]:
    """(links, windows): what texts share around the repeated spans ``found``, exactly.

    ``links``: cls_a < cls_b, from_a, to_a, from_b, to_b: stretches of at least ``span`` equal characters of two texts, for
    spans that at most ``most_paired`` places have. ``windows``: w (hash), cls, start: for more frequent spans, every window
    of ``span`` characters around them that stands in several texts; texts with the same w share it. Nothing is dropped: a
    frequent span costs ``span - anchor`` rows a place, not all pairs of places.
    """
    spans = materialize(contexts(documents, found, span, anchor), "span-contexts")
    sizes = spans.groupBy("h").agg(F.count("*").alias("n"))
    few = spans.join(sizes.where(F.col("n") <= most_paired).select("h"), "h")
    a = few.select("h", *[F.col(c).alias(f"{c}_a") for c in ("cls", "pos", "before", "after")])
    b = few.select("h", *[F.col(c).alias(f"{c}_b") for c in ("cls", "pos", "before", "after")])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            left = np.array([_common(p[::-1], q[::-1]) for p, q in zip(x.column(2).to_pylist(), x.column(6).to_pylist(), strict=True)], np.int32)
            right = np.array([_common(p, q) for p, q in zip(x.column(3).to_pylist(), x.column(7).to_pylist(), strict=True)], np.int32)
            pa_, pb = x.column(1).to_numpy(zero_copy_only=False), x.column(5).to_numpy(zero_copy_only=False)
            ok = pa.array((right >= anchor) & (left + right >= span))
            out = pa.record_batch([x.column(0), x.column(4), pa.array(pa_ - left), pa.array(pa_ + right), pa.array(pb - left), pa.array(pb + right)], names=["cls_a", "cls_b", "from_a", "to_a", "from_b", "to_b"])
            yield out.filter(ok)

    pairs = a.join(b, "h").where("cls_a < cls_b").drop("h")
    links = pairs.mapInArrow(extend, "cls_a binary, cls_b binary, from_a int, to_a int, from_b int, to_b int").distinct()
    many = spans.join(sizes.where(F.col("n") > most_paired).select("h"), "h")
    around = many.select("cls", (F.col("pos") - F.length("before")).alias("base"), F.concat("before", "after").alias("t"), F.length("before").alias("lead"))
    offsets = F.sequence(F.lit(0), F.least("lead", F.length("t") - span))
    windows = around.where(F.length("t") >= span).select("cls", "base", "t", F.explode(offsets).alias("o")).select(F.xxhash64(F.expr(f"substring(t, o + 1, {span})")).alias("w"), "cls", (F.col("base") + F.col("o")).alias("start")).distinct()
    shared = windows.groupBy("w").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi").select("w")
    return links, windows.join(shared, "w")


def _common(a: str, b: str) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def sharing_pairs(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """Pairs of documents that share ``span`` characters: doc_id_a < doc_id_b, copies of a text included.

    This is the fixed form of the result, one row a pair; :func:`shared_parts` gives the same knowledge in one row a document.
    Texts that meet in the same runs and frequent windows are one kind, kinds are paired, and pairs of documents are made
    last, each once and block by block, so that a passage of very many texts is not paired again for each of its windows.
    Documents with null ids or shorter than ``span`` are in no pair; repeated rows count once.
    """
    found = repeated_spans(documents, span)
    links, windows = shared_intervals(documents, found.where("not agree"), span)
    runs = found.where("agree").select(F.col("h").alias("w"), "cls")
    kinds, meets = kinds_that_meet(windows.select("w", "cls").unionByName(runs))
    members = materialize(text_classes(documents).where(F.col("len") >= span).select("doc_id", "cls").distinct().join(kinds, "cls", "left"), "members")
    by_kind = expanded(meets.where("kind <= other").select(F.col("kind").alias("x"), F.col("other").alias("y")), members.where("kind is not null").select(F.col("kind").alias("x"), "doc_id"))
    own = members.where("kind is null").groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select(F.col("cls").alias("x"), F.col("cls").alias("y"))
    others = not_meeting(links.select("cls_a", "cls_b").distinct(), kinds, meets).select(F.col("cls_a").alias("x"), F.col("cls_b").alias("y"))
    by_text = expanded(own.unionByName(others), members.select(F.col("cls").alias("x"), "doc_id"))
    return by_kind.unionByName(by_text)


def expanded(pairs: DataFrame, members: DataFrame, block: int = 1024) -> DataFrame:
    """The pairs of members (x, doc_id) of paired groups (x, y; each pair once, x = y for the pairs within a group): doc_id_a < doc_id_b.

    Members stand in blocks of about ``block``, and blocks are paired, so a hot group is spread over many tasks."""
    sizes = members.groupBy("x").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = members.join(sizes, "x").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    held = placed.groupBy("x", "block").agg(F.collect_list("doc_id").alias("docs"))
    left, right = held.select("x", F.col("block").alias("block_a"), F.col("docs").alias("a")), held.select(F.col("x").alias("y"), F.col("block").alias("block_b"), F.col("docs").alias("b"))
    both = pairs.join(left, "x").join(right, "y").where((F.col("x") != F.col("y")) | (F.col("block_a") <= F.col("block_b")))
    each = both.select((F.col("x") == F.col("y")).alias("same"), "block_a", "block_b", "b", F.explode("a").alias("a")).select("same", "block_a", "block_b", "a", F.explode("b").alias("b"))
    once = each.where(~F.col("same") | (F.col("block_a") < F.col("block_b")) | (F.col("a") < F.col("b")))
    return once.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b")).where("doc_id_a < doc_id_b")


def merged(intervals: DataFrame) -> DataFrame:
    """Disjoint intervals per cls from overlapping ones: cls, lo, hi (end exclusive)."""
    order = W.Window.partitionBy("cls").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(W.Window.unboundedPreceding, -1))
    marked = intervals.withColumn("new", (F.coalesce(reach, F.lit(-1)) < F.col("lo")).cast("int"))
    return marked.withColumn("g", F.sum("new").over(order)).groupBy("cls", "g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("g")


def kinds_that_meet(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kinds, meets) of the places (w, cls) of shared windows: cls, kind; and kind, other for kinds with a window in common.

    Windows that the same texts have are one group, and texts with the same groups are one kind; only kinds that meet in a
    group are paired, so a passage that very many texts have costs a row a text, not all pairs of texts. Sets are named by
    128 bits of their members and their number."""
    place = materialize(places.distinct(), "window-places")

    def named(rows: DataFrame, of: str, by: str, name: str) -> DataFrame:
        marks = (F.bit_xor(F.xxhash64(by)), F.bit_xor(F.xxhash64(by, F.lit(1))), F.count("*"))
        return rows.groupBy(of).agg(F.concat_ws(":", *marks).alias(name))

    groups = materialize(place.join(named(place, "w", "cls", "g"), "w").select("g", "cls").distinct(), "window-groups")
    kinds = materialize(named(groups, "cls", "g", "kind"), "text-kinds")
    within = groups.join(kinds, "cls").select("kind", "g").distinct()
    meets = materialize(within.join(within.withColumnRenamed("kind", "other"), "g").select("kind", "other").distinct(), "kinds-that-meet")
    return kinds, meets


def not_meeting(links: DataFrame, kinds: DataFrame, meets: DataFrame) -> DataFrame:
    """The links (cls_a, cls_b) of texts that are not already linked by their kinds."""
    known = links.join(kinds.select(F.col("cls").alias("cls_a"), "kind"), "cls_a", "left").join(kinds.select(F.col("cls").alias("cls_b"), F.col("kind").alias("other")), "cls_b", "left")
    return known.join(meets, ["kind", "other"], "left_anti").select("cls_a", "cls_b")


def link_counts(links: DataFrame, windows: DataFrame) -> DataFrame:
    """How many different other texts each text shares with, by pairs and frequent windows together: cls, links."""
    kinds, meets = kinds_that_meet(windows.select("w", "cls"))
    sizes = kinds.groupBy(F.col("kind").alias("other")).agg(F.count("*").alias("n"))
    frequent = kinds.join(meets.join(sizes, "other").groupBy("kind").agg((F.sum("n") - 1).alias("n")), "kind").select("cls", "n")
    one = not_meeting(links.select("cls_a", "cls_b").distinct(), kinds, meets)
    paired = one.select(F.col("cls_a").alias("cls")).unionByName(one.select(F.col("cls_b").alias("cls"))).groupBy("cls").agg(F.count("*").alias("n"))
    return frequent.unionByName(paired).groupBy("cls").agg(F.sum("n").alias("links"))


def shared_parts(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """One row a document: doc_id, cls (its text class), copies (documents with its text), links (other texts it shares with),
    shared_chars (of its text that stand, in stretches of ``span``, in another document), share (their part of the text).

    A text that has copies is shared as a whole. Documents without text have cls null and share 0. ``links`` counts each
    other text once, however many spans are shared with it and however frequent they are (see :func:`link_counts`).
    """
    links, windows = shared_intervals(documents, repeated_spans(documents, span), span)
    links, windows = materialize(links, "span-links"), materialize(windows, "span-windows")
    sides = links.select(F.col("cls_a").alias("cls"), F.col("from_a").alias("lo"), F.col("to_a").alias("hi")).unionByName(
        links.select(F.col("cls_b").alias("cls"), F.col("from_b").alias("lo"), F.col("to_b").alias("hi"))
    )
    count = link_counts(links, windows)
    parts = merged(sides.select("cls", "lo", "hi").unionByName(windows.select("cls", F.col("start").alias("lo"), (F.col("start") + span).alias("hi"))))
    covered = parts.groupBy("cls").agg(F.sum(F.col("hi") - F.col("lo")).alias("covered"))
    classes = text_classes(documents)
    copies = classes.groupBy("cls").agg(F.countDistinct("doc_id").alias("copies"), F.max("len").alias("len"))
    info = copies.join(count, "cls", "left").join(covered, "cls", "left")
    rows = documents.where(F.col("doc_id").isNotNull()).select("doc_id", F.when(F.length("text") > 0, _cls()).alias("cls")).distinct().join(info, "cls", "left")
    shared = F.when((F.col("copies") > 1) & (F.col("len") >= span), F.col("len")).otherwise(F.coalesce("covered", F.lit(0)))
    return rows.select(
        "doc_id", F.hex("cls").alias("cls"), F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"), shared.cast("long").alias("shared_chars"), F.coalesce(shared / F.col("len"), F.lit(0.0)).alias("share")
    )


def without_repeats(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """Texts without the sentences that a repeated span covers where it is not the first: doc_id, text, removed (sentences).

    Of the texts that share a stretch that with the smallest doc_id keeps it; of copies the first keeps its text and the
    others lose all of it (they are the repeated stretch as a whole) if it has ``span`` characters. A sentence goes only if
    it lies wholly in such a stretch. Documents without text keep theirs; null ids are left out.
    """
    links, windows = shared_intervals(documents, repeated_spans(documents, span), span)
    links, windows = materialize(links, "span-links"), materialize(windows, "span-windows")
    classes = text_classes(documents)
    firsts = classes.groupBy("cls").agg(F.min("doc_id").alias("first"))
    ranked = links.join(firsts.select(F.col("cls").alias("cls_a"), F.col("first").alias("a")), "cls_a").join(firsts.select(F.col("cls").alias("cls_b"), F.col("first").alias("b")), "cls_b")
    later = ranked.select(
        F.when(F.col("a") < F.col("b"), F.col("cls_b")).otherwise(F.col("cls_a")).alias("cls"),
        F.when(F.col("a") < F.col("b"), F.col("from_b")).otherwise(F.col("from_a")).alias("lo"),
        F.when(F.col("a") < F.col("b"), F.col("to_b")).otherwise(F.col("to_a")).alias("hi"),
    )
    of_window = windows.join(firsts, "cls")
    owner = of_window.groupBy("w").agg(F.min("first").alias("owner"))
    frequent = of_window.join(owner, "w").where(F.col("first") > F.col("owner")).select("cls", F.col("start").alias("lo"), (F.col("start") + span).alias("hi"))
    gone = merged(later.unionByName(frequent)).groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("gone"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, removed = [], []
            for text, copy, cuts in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                kept, n = strip_sentences(text or "", [(0, len(text or ""))] if copy else [(c["lo"], c["hi"]) for c in cuts or []])
                texts.append(kept)
                removed.append(n)
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int32())], names=["doc_id", "text", "removed"])

    rows = documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text", F.when(F.length("text") > 0, _cls()).alias("cls"))
    known = rows.join(firsts, "cls", "left").join(gone, "cls", "left")
    copy = F.coalesce((F.col("doc_id") > F.col("first")) & (F.length("text") >= span), F.lit(False))
    return known.select("doc_id", "text", copy.alias("copy"), "gone").mapInArrow(strip, "doc_id long, text string, removed int")


def strip_sentences(text: str, cuts: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without the sentences that lie wholly in one of the sorted, disjoint cuts, and how many they are."""
    if not cuts:
        return text, 0
    out, removed, at, c = [], 0, 0, 0
    for m in re.finditer(r"[^.!?\n。！？]*(?:[.!?。！？]+[ \t]*|\n+|\Z)", text):
        if m.start() == m.end():
            continue
        while c < len(cuts) and cuts[c][1] <= m.start():
            c += 1
        end = m.start() + len(m[0].rstrip())
        if c < len(cuts) and cuts[c][0] <= m.start() and end <= cuts[c][1] and m[0].strip():
            removed += 1
        else:
            out.append(m[0])
        at = m.end()
    return "".join([*out, text[at:]]), removed
