"""Shared spans, leaks and neighbours against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from marginalia.llm import evalleak, neighbors, spans


def _text(rng, n):
    out = []
    while sum(map(len, out)) < n:
        out.append(" ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(rng.randrange(3, 16))).capitalize() + rng.choice([". ", ".\n", "? ", "! "]))
    return "".join(out)[:n]


def _pairs(docs, span):
    grams = [{t[i : i + span] for i in range(len(t) - span + 1)} for _, t in docs]
    return {(min(docs[i][0], docs[j][0]), max(docs[i][0], docs[j][0])) for i in range(len(docs)) for j in range(i) if grams[i] & grams[j]}


def _corpus(seed):
    rng = random.Random(seed)
    docs = [(i, _text(rng, rng.randrange(0, 900))) for i in range(60)]
    donors = [_text(rng, 1200), "".join(rng.choices("abcdefghijklmnop", k=1200)), "字林" * 40 + "".join(chr(0x4E00 + rng.randrange(900)) for _ in range(1100)), "word " * 240]
    for i in range(60, 130):
        d, n = rng.choice(donors), rng.choice([199, 200, 201, 230, 400])
        at = rng.randrange(len(d) - n)
        docs.append((i, _text(rng, rng.randrange(0, 300)) + d[at : at + n] + _text(rng, rng.randrange(0, 300))))
    docs += [(200, docs[5][1]), (201, docs[70][1]), (202, "")]
    return docs


def test_sharing_pairs_equal_brute_force(spark):
    docs = _corpus(1)
    df = spark.createDataFrame([*docs, docs[70], (300, None), (None, docs[70][1])], "doc_id bigint, text string").withColumn("cls", F.lit(1)).withColumn("h", F.lit(1))
    want = _pairs(docs, 200)
    assert len(want) > 50
    assert {tuple(r) for r in spans.sharing_pairs(df).collect()} == want
    assert spans.sharing_pairs(df.limit(0)).count() == 0


def test_frequent_spans_are_resolved_exactly(spark):
    docs = _corpus(2)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    links, windows = spans.shared_intervals(df, spans.repeated_spans(df), most_paired=2)
    assert windows.count() > 0
    cls = {bytes(r["cls"]): r["doc_id"] for r in spans.text_classes(df).orderBy(F.desc("doc_id")).collect()}
    got = {frozenset((cls[bytes(r["cls_a"])], cls[bytes(r["cls_b"])])) for r in links.collect()}
    by = {}
    for r in windows.collect():
        by.setdefault(r["w"], set()).add(cls[bytes(r["cls"])])
    got |= {frozenset((a, b)) for group in by.values() for a in group for b in group if a < b}
    unique = {t: i for i, t in reversed(docs)}
    assert got == {frozenset(p) for p in _pairs([(i, t) for t, i in unique.items()], 200)}


def test_runs_of_sentences_decide_where_texts_agree(spark):
    rng = random.Random(9)
    common = _text(rng, 320).rsplit(". ", 1)[0] + ". "
    df = spark.createDataFrame([(i, _text(rng, 120).strip() + ". " + common + "Then something else %d. " % i + _text(rng, 90)) for i in range(5)], "doc_id bigint, text string")
    found = spans.repeated_spans(df).collect()
    assert {r["h"] for r in found if r["agree"]} and all(r["run"] != 0 for r in found if r["agree"])
    assert {tuple(r) for r in spans.sharing_pairs(df).collect()} == {(a, b) for a in range(5) for b in range(a + 1, 5)}


def test_pairs_of_a_hot_passage_come_out_once_and_in_blocks(spark):
    members = spark.createDataFrame([("k", i) for i in range(60)] + [("m", 100 + i) for i in range(7)] + [("o", 500)], "x string, doc_id bigint")
    pairs = spark.createDataFrame([("k", "k"), ("k", "m"), ("o", "o")], "x string, y string")
    got = [tuple(r) for r in spans.expanded(pairs, members, block=8).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in range(60) for b in range(a + 1, 60)} | {(a, 100 + b) for a in range(60) for b in range(7)}


def test_pairs_of_texts_with_many_common_passages_equal_brute_force(spark):
    rng = random.Random(10)
    parts = [_text(rng, 230) for _ in range(4)]
    docs = [(i, "".join(x for x in [_text(rng, 50), *rng.sample(parts, rng.randrange(0, 4)), _text(rng, 40)])) for i in range(150)]
    docs += [(200 + i, docs[i][1]) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = [tuple(r) for r in spans.sharing_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == _pairs(docs, 200)


def test_shared_parts_and_removal(spark):
    rng = random.Random(3)
    common = _text(rng, 400)
    docs = [(1, _text(rng, 200) + common), (2, common + _text(rng, 300)), (3, _text(rng, 500)), (4, _text(rng, 50)), (5, ""), (6, None)]
    docs.append((7, docs[2][1]))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in spans.shared_parts(df).collect()}
    assert rows[1]["links"] == 1 and 400 <= rows[1]["shared_chars"] <= 402 and rows[2]["shared_chars"] == rows[1]["shared_chars"]
    assert rows[3]["share"] == 1.0 and rows[3]["copies"] == 2 and rows[4]["share"] == 0 and rows[6]["cls"] is None
    kept = {r["doc_id"]: r for r in spans.without_repeats(df).collect()}
    assert kept[1]["text"] == docs[0][1] and kept[1]["removed"] == 0
    assert kept[2]["removed"] > 0 and len(kept[2]["text"]) < len(docs[1][1]) - 200 and kept[3]["removed"] == 0 and kept[7]["text"].strip() == ""


def test_links_count_every_other_text_once(spark):
    rng = random.Random(4)
    footer, licence, pair = (_text(rng, 260) for _ in range(3))
    docs = [(i, _text(rng, 60) + (footer if i < 80 else licence) + _text(rng, 40)) for i in range(160)]
    docs += [(200, _text(rng, 60) + footer + _text(rng, 60) + licence), (201, pair + _text(rng, 50) + footer), (202, pair + footer), (203, licence + pair)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    want = {d: 0 for d, _ in docs}
    for p in _pairs(docs, 200):
        for d in p:
            want[d] += 1
    assert spans.shared_intervals(df, spans.repeated_spans(df))[1].count() > 0 and want[200] == 163
    assert {r["doc_id"]: r["links"] for r in spans.shared_parts(df).collect()} == want


def test_strip_sentences():
    assert spans.strip_sentences("One. Two! Three", [(0, 4)]) == ("Two! Three", 1)
    assert spans.strip_sentences("One. Two! Three", [(2, 9)]) == ("One. Three", 1)
    assert spans.strip_sentences("", [(0, 3)]) == ("", 0)


def test_alignment():
    def code(s):
        return np.array([hash(w) % 1000 for w in s.split()], np.int64)

    a, b = "x x the quick brown fox jumps y", "the quick red fox jumps"
    score, run, part = evalleak.align([(code(a), code(b)), (code("p q"), code("r s t")), (code(""), code("a"))])
    assert list(score) == [7, 0, 0] and list(run) == [2, 0, 0] and part[0] == 0.7


def test_leaks_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["w%d" % i for i in range(40)] + ["ÉTÉ", "naïve"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([5, 19, 20, 40, 90])))) for i in range(20)]
    docs = []
    for i in range(150):
        w = rng.choices(vocabulary, k=rng.randrange(0, 120))
        if rng.random() < 0.6:
            src = rng.choice(items)[1].split()
            n = rng.choice([10, 19, 20, 21, 40])
            at = rng.randrange(max(1, len(src) - n + 1))
            w[len(w) // 2 : len(w) // 2] = src[at : at + n]
        docs.append((i, rng.choice([" ", ", ", "\r\n"]).join(w).upper()))
    want = set()
    for i, t in items:
        iw = evalleak.words(t)
        grams = {tuple(iw[k : k + 20]) for k in range(len(iw) - 19)}
        for d, x in docs:
            dw = evalleak.words(x)
            if any(tuple(dw[k : k + 20]) in grams for k in range(len(dw) - 19)):
                want.add((i, d))
    assert len(want) > 10
    df = spark.createDataFrame([*docs, docs[3], (500, None), (501, "")], "doc_id bigint, text string").withColumn("gram", F.lit(1)).withColumn("item_id", F.lit(1))
    it = spark.createDataFrame([*items, (90, None), (91, "")], "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    got = {(r["item_id"], r["doc_id"]) for r in evalleak.leaks(df, it).where("run >= 20").collect()}
    assert got == want
    assert evalleak.leaks(df.limit(0), it).count() == 0 and evalleak.leaks(df, it.limit(0)).count() == 0


def test_edited_copies_score_high(spark):
    rng = random.Random(6)
    item = ["t%d" % i for i in range(60)]
    edited = [w for w in item if rng.random() > 0.1]
    for i in range(0, len(edited), 12):
        edited[i] = "changed"
    docs = spark.createDataFrame([(1, " ".join(edited)), (2, "nothing of it here")], "doc_id bigint, text string")
    rows = evalleak.leaks(docs, spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")).collect()
    assert [(r["item_id"], r["doc_id"]) for r in rows] == [(7, 1)] and rows[0]["part"] > 0.5


def test_edited_copy_is_found_beside_a_verbatim_one(spark):
    item = ["t%d" % i for i in range(200)]
    edited = [f"e{i}" if i % 15 == 7 else w for i, w in enumerate(item)]
    docs = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(edited)), (3, "nothing of it here")], "doc_id bigint, text string")
    it = spark.createDataFrame([(7, " ".join(item))] * 2, "item_id bigint, text string")
    rows = {r["doc_id"]: r for r in evalleak.leaks(docs, it).collect()}
    assert set(rows) == {1, 2} and rows[1]["run"] == 200 and rows[2]["run"] == 14 and rows[2]["part"] > 0.85
    tail = spark.createDataFrame([(1, " ".join(item[40:60]))], "doc_id bigint, text string")
    assert [r["run"] for r in evalleak.leaks(tail, it).collect()] == [20]


def test_recall_of_planted_edited_copies(spark):
    """Passages of 18 words and more with up to one edit in ten words, among documents that hold the items verbatim."""
    rng = random.Random(8)
    vocabulary = ["v%d" % i for i in range(3000)]
    items = [[rng.choice(vocabulary) for _ in range(rng.choice([18, 24, 40, 90]))] for _ in range(60)]
    docs, want = [], set()
    for i, item in enumerate(items):
        for n in (18, 24, len(item)):
            copy = item[:n]
            for j in rng.sample(range(len(copy)), max(1, len(copy) // 12)):
                copy[j] = rng.choice(["edited", copy[j] + " added", ""])
            around = [[rng.choice(vocabulary) for _ in range(rng.choice([0, 30, 900]))] for _ in range(2)]
            want.add((i, len(docs)))
            docs.append((len(docs), " ".join([*around[0], *copy, *around[1]])))
        docs += [(len(docs) + k, " ".join(item)) for k in range(2)]
    rows = evalleak.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id bigint, text string")).collect()
    found = {(r["item_id"], r["doc_id"]): r["score"] for r in rows}
    assert sum(p in found for p in want) >= 0.97 * len(want)
    assert all(found[p] >= 18 for p in want if p in found)


def test_alignment_in_stretches_equals_that_of_whole_texts():
    rng = np.random.default_rng(3)
    for _ in range(40):
        item, doc = rng.integers(0, 60, 12), rng.integers(60, 90, 400)
        for at in rng.choice(380, 2, replace=False):
            doc[at : at + 8] = item[2:10]
            doc[at + 3] = 99
            doc[at + 8 : at + 13] = item[5:10]
        parts = evalleak.stretches(doc, evalleak.mixed_grams(doc), len(item), evalleak.mixed_grams(item))
        whole = evalleak.align([(doc, item)])
        score, run, _ = evalleak.align([(p, item) for p in parts])
        assert score.max() == whole[0][0] and run.max() == whole[1][0] and sum(map(len, parts)) < len(doc)


def test_a_very_long_document_and_a_short_item_stay_small(spark):
    text = " ".join("u%d" % (i % 5000) for i in range(400_000)) + " a1 a2 a3 a4 a5 a6"
    rows = evalleak.leaks(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), spark.createDataFrame([(1, "a1 a2 a3 a4 a5 a6"), (2, "a2 a3 a4 a5 z")], "item_id bigint, text string")).collect()
    assert [(r["item_id"], r["run"]) for r in rows] == [(1, 6)]


def _vectors(n=900, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 64)) @ np.diag(np.linspace(1, 0.2, 64))
    for i in range(0, 60, 3):
        x[i + 1] = x[i] + 0.05 * rng.standard_normal(64)
        x[i + 2] = 3 * x[i]
    x[100:130] = x[99]
    return x


def test_neighbours_recall_and_close_pairs(spark):
    x = _vectors()
    rows = [(f"v{i:04d}", [float(a) for a in v]) for i, v in enumerate(x)]
    bad = [("b1", None), ("b2", []), ("b3", [0.0] * 64), ("b4", [1.0] * 63), ("b5", [float("nan")] * 64), ("b6", [None] * 64), ("b7", [float("inf")] * 64), (None, rows[0][1]), rows[4]]
    df = spark.createDataFrame(rows + bad, "chunk_id string, v array<double>").withColumn("node", F.lit(1)).withColumn("sim", F.lit(1))
    got = {}
    for r in neighbors.nearest(df, "chunk_id", "v", trees=4, block=128).collect():
        got.setdefault(r["key"], []).append((r["rank"], r["other_key"], r["sim"]))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    hit = 0
    for i in range(len(x)):
        mine = sorted(got[f"v{i:04d}"])
        assert [m[0] for m in mine] == list(range(1, 11)) and all(m[1] != f"v{i:04d}" for m in mine)
        floor = np.sort(s[i])[-10] - 1e-6
        assert all(abs(s[i][int(m[1][1:])] - m[2]) < 1e-6 for m in mine)  # the cosines are exact
        hit += sum(s[i][int(m[1][1:])] >= floor for m in mine)
    assert hit / (10 * len(x)) >= 0.9
    assert set(got) == {k for k, _ in rows}
    small = df.where("chunk_id < 'v0060' or chunk_id like 'b%'")
    want = {(f"v{i:04d}", f"v{j:04d}") for i in range(60) for j in range(i + 1, 60) if s[i, j] >= 0.9}
    assert {tuple(r) for r in neighbors.close_pairs(small, "chunk_id", "v").collect()} == want
    assert neighbors.close_pairs(df.limit(0), "chunk_id", "v").count() == 0


def test_best_of_rows_and_packed_graphs():
    rng = np.random.default_rng(2)
    for width in (30, 700, 5000):
        s = rng.standard_normal((40, width)).astype(np.float32)
        s[3] = 1.0  # ties
        i, j = neighbors._best_of_rows(s, 6)
        for r in range(40):
            mine = s[r][j[i == r]]
            assert len(mine) >= 6 and np.allclose(np.sort(mine)[-6:], np.sort(s[r])[-6:])
    ids, others = np.array([1, 1, 4]), np.array([7, 8, 9])
    batch = neighbors._packed(ids, others, np.array([0.5, 0.25, 1.0], np.float32), np.array([True, False, True]))
    assert batch.num_rows == 2 and batch.column(5).to_pylist() == [1, 1]
    for part, want in ((batch, (ids, others)), (batch.slice(1), (ids[2:], others[2:])), (batch.slice(0, 0), (ids[:0], others[:0]))):
        got = neighbors._unpacked(part)
        assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=False))


def test_current_vectors(spark):
    df = spark.createDataFrame([("a", "h1", [1.0], 1), ("a", "h2", [2.0], 5), ("a", "h2", [2.0], 5), ("b", "h", None, 9), ("b", "h", [1.0], 2), (None, "h", [1.0], 1)], "chunk_id string, h string, v array<double>, run_id int")
    assert {r["chunk_id"]: r["v"] for r in neighbors.current_vectors(df).collect()} == {"a": [2.0], "b": None}


def test_greedy_search_recall(spark):
    x = _vectors(600, 2)
    df = spark.createDataFrame([(f"v{i:04d}", [float(a) for a in v]) for i, v in enumerate(x)], "k string, v array<double>")
    asked = df.where("k like '%0'").withColumnRenamed("k", "q")
    got = neighbors.search(df, "k", "v", asked, "q", "v", trees=4, block=128)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    rows = got.collect()
    hit = sum(s[int(r["query"][1:])][int(r["other_key"][1:])] >= np.sort(s[int(r["query"][1:])])[-10] - 1e-3 for r in rows)
    assert len(rows) == 600 and hit / 600 >= 0.9


def test_search_expands_until_nothing_changes(spark):
    turn = np.linspace(0, 3, 400)  # a chain: what is far from the entry is many steps away
    x = np.zeros((400, 64))
    x[:, 0], x[:, 1] = np.cos(turn), np.sin(turn)
    df = spark.createDataFrame([(f"v{i:04d}", [float(a) for a in v]) for i, v in enumerate(x)], "k string, v array<double>")
    asked = df.where("k in ('v0000', 'v0200', 'v0399')").withColumnRenamed("k", "q")
    got = {}
    for r in neighbors.search(df, "k", "v", asked, "q", "v", beam=12, starts=1, trees=4, block=128).collect():
        got.setdefault(int(r["query"][1:]), set()).add(int(r["other_key"][1:]))
    assert got[0] == set(range(1, 11)) and got[399] == set(range(389, 399)) and got[200] == {*range(195, 200), *range(201, 206)}


def test_search_query_runs_over_the_current_vectors(spark, tmp_path):
    from marginalia.llm import queries

    x = _vectors(600, 3)
    rows = [(f"n::{i}", "h", [float(a) for a in v], 1) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "chunk_id string, h string, v array<double>, run_id int").write.parquet(f"{tmp_path}/vectors.parquet")
    found = queries.p4_search(spark, str(tmp_path)).collect()
    assert found and len(found) == 10 * len({r["query"] for r in found}) and {r["query"] for r in found} | {r["other_key"] for r in found} <= {r[0] for r in rows}


def test_search_query_asks_for_every_current_vector(spark, tmp_path):
    from marginalia.llm import queries

    x = _vectors(150, 5)
    rows = [(f"n::{i}", "h", [float(a) for a in v], 1) for i, v in enumerate(x)]
    rows += [("n::copy", "h", rows[7][2], 1), ("n::none", "h", None, 1), ("n::zero", "h", [0.0] * 64, 1), ("n::short", "h", [1.0], 1), ("n::3", "h", rows[7][2], 2)]
    spark.createDataFrame(rows, "chunk_id string, h string, v array<double>, run_id int").write.parquet(f"{tmp_path}/vectors.parquet")
    current = {r[0]: np.array(r[2]) / np.linalg.norm(r[2]) for r in rows if r[2] and len(r[2]) == 64 and any(r[2])}
    got = {}
    for r in queries.p4_search(spark, str(tmp_path)).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["other_key"], r["sim"]))
        assert abs(r["sim"] - current[r["query"]] @ current[r["other_key"]]) < 1e-6
    assert got.keys() == current.keys() and all(sorted(a for a, _, _ in v) == list(range(1, 11)) for v in got.values())
    assert {o for _, o, _ in sorted(got["n::7"])[:2]} == {"n::3", "n::copy"}
    want = {c: {o for _, o in sorted((-(current[c] @ y), o) for o, y in current.items() if o != c)[:10]} for c in current}
    assert sum(len(want[c] & {o for _, o, _ in got[c]}) for c in current) >= 0.95 * 10 * len(current)
