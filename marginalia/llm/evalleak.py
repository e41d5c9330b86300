"""Evaluation texts leaking into training text: n-gram seeds, then local alignment of the candidates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from marginalia.operators import bloom
from marginalia.operators.skew import lookup
from marginalia.session import materialize

#: Words of a seed, and words of the stretch within which the rarest seed is kept.
GRAM = 5
STRETCH = 20
#: Scores of the alignment: equal word, other word, gap.
MATCH, MISMATCH, GAP = 2, -1, -1
#: The filter of the items' n-grams that every task holds has so many bits an n-gram, and at most 2**29 (64 MB); the fuller it
#: is, the more n-grams are looked up in vain.
BITS_PER_GRAM, HASHES, MOST_BITS = 16, 4, 29
#: Distinct n-grams up to which they are joined by broadcast (8 bytes each), else by shuffle.
MOST_BROADCAST_GRAMS = 1_000_000
#: Cells of one step of an alignment, and of all its steps, that are held at once.
_WIDE, _LONG = 1 << 19, 1 << 24
_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Longest runs of letters and digits in lower case."""
    return _WORD.findall(text.lower()) if text else []


def _word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts on end, and where each text begins (one more entry at the end)."""
    seen: dict[str, int] = {}
    codes: list[int] = []
    starts = [0]
    for t in texts:
        for w in words(t):
            h = seen.get(w)
            if h is None:
                h = seen[w] = xxhash.xxh64_intdigest(w)
            codes.append(h)
        starts.append(len(codes))
    return np.array(codes, dtype=np.uint64), np.array(starts)


def gram_hashes(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All word n-grams of the texts: hash, text number, word position."""
    codes, starts = _word_hashes(texts)
    if len(codes) < n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = codes[: len(codes) - n + 1].copy()
    with np.errstate(over="ignore"):
        for k in range(1, n):
            h = (h ^ (h >> np.uint64(29))) * _BASE + codes[k : len(codes) - n + 1 + k]
        h = (h ^ (h >> np.uint64(32))) * _BASE
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))[: len(h)]
    at = np.arange(len(h)) - starts[owner]
    inside = at + n <= np.diff(starts)[owner]
    return h[inside].view(np.int64), owner[inside], at[inside]


def item_grams(items: DataFrame, n: int = GRAM) -> DataFrame:
    """N-grams of the test items, each place once: item_id, copy (hash of the text; repeated ids may have several), gram, pos."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, owner, at = gram_hashes(b.column(2).to_pylist(), n)
            yield pa.record_batch([b.column(0).take(pa.array(owner)), b.column(1).take(pa.array(owner)), pa.array(h), pa.array(at, pa.int32())], names=["item_id", "copy", "gram", "pos"])

    texts = items.select(F.col("item_id").cast("long"), F.xxhash64("text").alias("copy"), "text").where("item_id is not null")
    return texts.mapInArrow(cut, "item_id long, copy long, gram long, pos int").distinct()


def _bit_place(grams: np.ndarray, log: int, i: int) -> np.ndarray:
    """The i-th bit of each n-gram in a filter of 2**log bits."""
    g = grams.view(np.uint64)
    with np.errstate(over="ignore"):
        mixed = (g ^ (g >> np.uint64(33 + i))) * np.uint64((2 * i + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    return (mixed >> np.uint64(64 - log)).view(np.int64)


def gram_filter(grams: DataFrame, count: int) -> tuple[np.ndarray, int]:
    """A Bloom filter of the column ``gram`` as bytes, and the logarithm of its bits. Its blocks are made where the n-grams lie;
    only they reach the driver, and their number is bounded by MOST_BITS whatever the number of n-grams."""
    log = min(MOST_BITS, max(15, int(count * BITS_PER_GRAM).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique([_bit_place(b.column(0).to_numpy(), log, i) for i in range(HASHES)])
            yield pa.record_batch([pa.array(at >> 15), pa.array(at & 32767)], names=["block", "bit"])

    blocks = grams.select("gram").mapInArrow(places, "block long, bit long").groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    table = np.zeros((1 << log) // 8, np.uint8)
    for r in blocks.toLocalIterator():
        table[r["block"] * 4096 : (r["block"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return table, log


def gram_hits(documents: DataFrame, grams: DataFrame, n: int = GRAM) -> DataFrame:
    """Where the given n-grams stand in the documents: doc_id, gram, at (word of the document).

    A Bloom filter of the given n-grams goes to every task (see :func:`gram_filter`), so documents are read once, whole, and
    never moved; what passes is joined with the n-grams themselves, frequent ones by broadcast.
    """
    distinct = materialize(grams.select("gram").distinct(), "distinct-grams")
    count = distinct.count()
    bits, log = gram_filter(distinct, count)
    held = documents.sparkSession.sparkContext.broadcast(bits)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for b in batches:
            h, owner, word = gram_hashes(b.column(1).to_pylist(), n)
            if not len(h):
                continue
            for i in range(HASHES):
                at = _bit_place(h, log, i)
                real = (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
                h, owner, word = h[real], owner[real], word[real]
            yield pa.record_batch([b.column(0).take(pa.array(owner)), pa.array(h), pa.array(word, pa.int32())], names=["doc_id", "gram", "at"])

    hits = documents.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null").mapInArrow(scan, "doc_id long, gram long, at int")
    if count <= MOST_BROADCAST_GRAMS:
        return hits.join(F.broadcast(distinct), "gram", "left_semi").select("doc_id", "gram", "at")
    return lookup(materialize(hits, "filtered-grams"), distinct, "gram", "inner").select("doc_id", "gram", "at")


def rare_seeds(grams: DataFrame, hits: DataFrame, n: int = GRAM, stretch: int = STRETCH) -> DataFrame:
    """Of every stretch of ``stretch`` words of an item that may have leaked word for word its n-gram that occurs least: item_id, copy, gram, pos.

    It may have leaked so if all its n-grams occur somewhere. A document with all words of a stretch has each of its n-grams,
    so also the rarest: no leak of a stretch is lost, however common its other n-grams are. An item shorter than a stretch
    counts as one. Edited copies may lack just the rarest, see :func:`candidates`.
    """
    text = ["item_id", "copy"]
    df = hits.groupBy("gram").agg(F.count("*").alias("df"))
    length = grams.groupBy(text).agg((F.max("pos") + 1).alias("size"))
    known = grams.join(df, "gram").join(length, text)
    ahead = W.Window.partitionBy(text).orderBy("pos").rangeBetween(0, stretch - n)
    wide = F.least(F.lit(stretch - n + 1), "size")
    best = known.select(*text, "pos", "size", wide.alias("wide"), F.min(F.struct("df", "gram", "pos")).over(ahead).alias("b"), F.count("*").over(ahead).alias("there"))
    full = best.where((F.col("pos") + F.col("wide") <= F.col("size")) & (F.col("there") == F.col("wide")))
    return full.select(*text, F.col("b.gram").alias("gram"), F.col("b.pos").alias("pos")).distinct()


def candidates(hits: DataFrame, grams: DataFrame, seeds: DataFrame, n: int = GRAM) -> DataFrame:
    """doc_id, item_id of the pairs to align: the document has the seed of a stretch that may have leaked whole, or, as an edited
    copy has, any n-grams (rare or not) at two places of the item that do not overlap and lie about as far apart in the
    document; of an item too short for two, any n-gram.

    About as far apart: by less than MATCH * 2 * n words more or less. Two runs that are shorter than two n-grams are worth less than
    that, so an alignment never spans a larger difference to join them; a longer run has two such places itself. Differences
    are compared in bands of that width, each with the next, so some more pairs are aligned than need be and none fewer."""
    named = grams.withColumn("text", F.xxhash64("item_id", "copy"))  # one number a text keeps the rows that move small
    band = F.floor((F.col("at") - F.col("pos")) / F.lit(MATCH * 2 * n)).cast("int")
    met = hits.join(named.select("gram", "text", "pos"), "gram").select("doc_id", "text", "pos", F.explode(F.array(band, band + 1)).alias("band"))
    wide = met.groupBy("doc_id", "text", "band").agg((F.max("pos") - F.min("pos")).alias("wide"))
    texts = named.groupBy("text", "item_id").agg(F.max("pos").alias("last"))
    apart = wide.join(texts, "text").where((F.col("wide") >= n) | (F.col("last") < n))
    return apart.select("doc_id", "item_id").unionByName(hits.join(seeds, "gram").select("doc_id", "item_id")).distinct()


def mixed_grams(codes: np.ndarray, n: int = GRAM) -> np.ndarray:
    """One number for each n-gram of word codes; equal n-grams have equal numbers."""
    if len(codes) < n:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = codes[: len(codes) - n + 1].astype(np.uint64)
        for k in range(1, n):
            h = h * _BASE + codes[k : len(codes) - n + 1 + k].astype(np.uint64)
    return h


def stretches(doc: np.ndarray, doc_grams: np.ndarray, size: int, item_grams: np.ndarray, n: int = GRAM) -> list[np.ndarray]:
    """The parts of a document (word codes) that any alignment through an n-gram it shares with an item of ``size`` words can lie in.

    A local alignment has at most ``size`` equal words, so it pays for at most MATCH times as many gaps and edits and reaches
    no further than ``3 * size`` words from a shared n-gram. Shorter documents are one stretch."""
    reach = 3 * size
    if len(doc) <= reach + n or not len(item_grams):
        return [doc]
    some = np.sort(item_grams)
    at = np.flatnonzero(some[np.minimum(np.searchsorted(some, doc_grams), len(some) - 1)] == doc_grams)
    if not len(at):
        return []
    first = np.flatnonzero(np.append(True, np.diff(at) > 2 * reach + n))
    last = np.append(first[1:], len(at)) - 1
    return [doc[max(0, at[f] - reach) : at[z] + n + reach] for f, z in zip(first, last, strict=True)]


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman over words of many pairs at once: best score, longest run of equal words, score as part of the item's.

    All pairs advance together, one document word a step; gaps along the item are taken in doubled lengths. Words are
    numbered anew for the group, words of documents that no item has are all one number.
    """
    total = len(pairs)
    result = np.zeros(total, np.int32), np.zeros(total, np.int32)
    length = np.array([max(1, len(b)) for _, b in pairs])
    # the longest documents first: those that have ended stand behind the others and are left out of the steps
    order = sorted((i for i, (a, b) in enumerate(pairs) if len(a) and len(b)), key=lambda i: -len(pairs[i][0]))
    if not order:
        return *result, np.zeros(total, np.float64)
    k, rows, cols = len(order), len(pairs[order[0]][0]), max(len(pairs[i][1]) for i in order)
    known = np.unique(np.concatenate([pairs[i][1] for i in order]))
    kind = np.int16 if cols < 10_000 and len(known) < 32_000 else np.int32  # scores are at most MATCH a word
    A, B = np.zeros((rows, k), kind), np.full((cols, k), -1, kind)
    ends = np.array([len(pairs[i][0]) for i in order])
    for c, i in enumerate(order):
        a, b = pairs[i]
        at = np.minimum(np.searchsorted(known, a), len(known) - 1)
        A[: len(a), c] = np.where(known[at] == a, at + 1, 0)
        B[: len(b), c] = np.searchsorted(known, b) + 1
    H, N, R, S, score, run, cell = (np.zeros((cols + 1, k), kind) for _ in range(7))
    equal, most, now = np.empty((cols, k), kind), 0, k
    for r in range(rows):
        if ends[now - 1] <= r:
            now = int(np.searchsorted(-ends, -r))
            H, N, R, S, cell, equal = (x[:, :now] for x in (H, N, R, S, cell, equal))
        best, longest = score[:, :now], run[:, :now]
        np.equal(A[r, :now], B[:, :now], out=equal, casting="unsafe")
        np.add(H, kind(GAP), out=N)
        np.maximum(N, kind(0), out=N)
        np.multiply(equal, kind(MATCH - MISMATCH), out=cell[1:])
        np.add(cell[1:], kind(MISMATCH), out=cell[1:])
        np.add(cell[1:], H[:-1], out=cell[1:])
        np.maximum(N[1:], cell[1:], out=N[1:])
        most, gap = int(best.max()) + MATCH if r % 16 == 0 else most + MATCH, 1
        while gap <= cols and gap * -GAP < most:  # a longer gap leaves nothing of the best score so far
            np.add(N[:-gap], kind(gap * GAP), out=cell[gap:])
            np.maximum(N[gap:], cell[gap:], out=N[gap:])
            gap *= 2
        np.add(R[:-1], kind(1), out=S[1:])
        np.multiply(S[1:], equal, out=S[1:])
        H, N, R, S = N, H, S, R
        np.maximum(best, H, out=best)
        np.maximum(longest, R, out=longest)
    result[0][order], result[1][order] = score.max(axis=0), run.max(axis=0)
    return *result, result[0] / (MATCH * length)


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item_id, doc_id, text, item_text: the best values of every pair; what is held at once is bounded however long the texts."""
    for b in batches:
        columns = [b.column(c).to_pylist() for c in (2, 3)]
        texts = list(dict.fromkeys(t for c in columns for t in c))
        split = [words(t) for t in texts]
        size = np.array([len(w) for w in split], np.int64)
        ends = np.cumsum(size)
        codes = pd.factorize(np.array(list(chain.from_iterable(split)), object))[0].astype(np.int64)
        grams = mixed_grams(codes)  # those across two texts are cut off below
        coded = {t: (codes[e - n : e], grams[e - n : max(e - n, e - GRAM + 1)]) for t, n, e in zip(texts, size, ends, strict=True)}
        todo = []
        for i, pair in enumerate(zip(*columns, strict=True)):
            (doc, seen), (item, own) = coded[pair[0]], coded[pair[1]]
            todo += [(i, part, item) for part in stretches(doc, seen, len(item), own)]
        todo.sort(key=lambda x: len(x[2]))
        out, group, wide, long = np.zeros((3, b.num_rows)), [], 0, 0
        for x in [*todo, None]:
            if x is None or (group and (wide + len(x[2]) > _WIDE or (len(group) + 1) * max(long, len(x[1])) > _LONG)):
                at = [i for i, _, _ in group]
                for row, values in zip(out, align([(d, t) for _, d, t in group]), strict=True):
                    np.maximum.at(row, at, values)
                group, wide, long = [], 0, 0
            if x is not None:
                group.append(x)
                wide, long = wide + len(x[2]), max(long, len(x[1]))
        yield pa.record_batch(
            [b.column(0), b.column(1), pa.array(out[0].astype(np.int32)), pa.array(out[1].astype(np.int32)), pa.array(out[2])],
            names=["item_id", "doc_id", "score", "run", "part"],
        )


def leaks(documents: DataFrame, items: DataFrame, n: int = GRAM, stretch: int = STRETCH, edited: bool = True) -> DataFrame:
    """Documents that hold passages of test items: item_id, doc_id, score, run, part.

    ``score`` is the best local alignment of their words (edited and paraphrased copies included), ``run`` the longest run
    of consecutive equal words, ``part`` the score as a part of that of the whole item. Pairs are found by
    n-grams (see :func:`rare_seeds` and :func:`candidates`). Texts without words leak nothing and null ids are left out; of
    repeated ids each text counts and the best values are given. Texts are compared wherever an alignment through a shared
    n-gram can lie (see :func:`stretches`). Without ``edited`` only pairs
    that may share ``stretch`` consecutive words are compared: enough, and all, for runs of that length.
    """
    grams = materialize(item_grams(items, n), "item-grams")
    hits = materialize(gram_hits(documents, grams, n), "gram-hits")
    seeds = rare_seeds(grams, hits, n, stretch)
    met = candidates(hits, grams, seeds, n) if edited else hits.join(seeds, "gram").select("doc_id", "item_id").distinct()
    pairs = materialize(met, "leak-candidates")
    item_texts = items.select(F.col("item_id").cast("long"), F.col("text").alias("item_text")).distinct()
    near = bloom.build(pairs, "doc_id", pairs.count()).probe(documents.select(F.col("doc_id").cast("long"), "text"), "doc_id")
    texts = pairs.join(near.where("maybe").drop("maybe"), "doc_id").join(item_texts, "item_id")

    scored = texts.select("item_id", "doc_id", "text", "item_text").mapInArrow(_scored, "item_id long, doc_id long, score int, run int, part double")
    return scored.groupBy("item_id", "doc_id").agg(F.max("score").alias("score"), F.max("run").alias("run"), F.max("part").alias("part"))
