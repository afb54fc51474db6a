"""Near duplicates, line windows, decontamination: against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.llm import common, fmindex, lines, minhash


def shingle_set(text, width=5):
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute_components(rows, percent):
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, u in sets[:k]:
            both = len(s & u)
            if a is not None and b is not None and both and 100 * both >= percent * len(s | u):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def varied(n_groups=12, seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, at = [], 0
    for _ in range(n_groups):
        base = [r.choice(vocabulary) for _ in range(r.randint(6, 150))]
        for _ in range(r.randint(1, 14)):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4, 8])):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            rows.append((at, " ".join(words)))
            at += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("percent", [80, 85])
@pytest.mark.parametrize("limits", [{}, {"group_docs": 6, "group_shingles": 300}])
def test_components_equal_brute_force(make, percent, limits):
    """Also where groups are too large for one task, so that blocks are compared."""
    rows = varied()
    got = {r["doc_id"]: r for r in minhash.near_duplicates(make(rows), percent, **limits).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(rows, percent)
    assert all(got[i]["n_shingles"] == len(shingle_set(t)) and got[i]["kept"] == (i == got[i]["component_id"]) for i, t in rows)


def test_odd_rows(odd):
    got = minhash.near_duplicates(odd.withColumn("component", F.lit(1)).withColumn("kept", F.lit(1))).collect()
    assert len(got) == 10
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert [r["n_shingles"] for i in (1, 2, 3) for r in by[i]] == [0, 0, 0] and by[4][0]["n_shingles"] == 1
    assert all(r["component_id"] == i and r["kept"] for i, rs in by.items() if i is not None for r in rs) and len(by[5]) == 2
    assert all(r["component_id"] is None and r["kept"] for r in by[None])


def test_no_rows(make):
    assert minhash.near_duplicates(make([])).count() == 0
    assert lines.dedup_lines(make([])).count() == 0


def test_copies_and_ties(make):
    rows = [(k, "the same seven words in every row") for k in range(60)] + [(100, "short text"), (101, "Short  TEXT"), (102, "other text")]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(make(rows)).collect()}
    assert set(got[k] for k in range(60)) == {0} and got[101] == got[100] == 100 and got[102] == 102


def test_a_doc_id_with_two_texts_is_one_document(make):
    rows = [(1, "a b c d e f g h"), (1, "k l m n o p q r"), (2, "a b c d e f g h"), (3, "k l m n o p q r")]
    assert {r["component_id"] for r in minhash.near_duplicates(make(rows)).collect()} == {1}


def test_stars_converge_on_long_chains(spark):
    links = spark.createDataFrame([(k + 1, k) for k in range(40)] + [(101, 100), (102, 101)], "a long, b long")
    got = {r["id"]: r["component"] for r in minhash.components(links).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100}


# Lines.
def brute_lines(rows, width=3):
    """(text, lines removed) of each row, in the order given."""
    raw = [(t or "").split("\n") for _, t in rows]
    full = [[k for k, x in enumerate(own) if re.search(r"[^\x20\x09-\x0D]", x)] for own in raw]
    seen, out = set(), {}
    for r in sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0, r)):
        gone = set()
        for k in range(len(full[r]) - width + 1):
            window = tuple(raw[r][p] for p in full[r][k : k + width])
            gone |= set(range(k, k + width)) if window in seen else set()
            seen.add(window)
        cut = {full[r][g] for g in gone} | {p for g in gone if g + 1 in gone for p in range(full[r][g], full[r][g + 1])}
        out[r] = rows[r][1] if not gone else "\n".join(x for p, x in enumerate(raw[r]) if p not in cut), len(gone)
    return [out[r] for r in range(len(rows))]


def test_line_windows_equal_brute_force(make):
    r = random.Random(5)
    rows = [(k, "\n".join(r.choice(["", "", *"abcdefgh"]) + r.choice(["", " ", "x"]) for _ in range(r.randint(0, 14)))) for k in range(60)]
    rows += [(60, "same\nsame\nsame\nsame\nsame"), (61, "one\n\n two\n\nthree\n"), (62, "one\n two\nthree\nfour"), (63, "before\n\none\n\n two\nthree\n\ntail\n\nend")]
    got = {x["doc_id"]: (x["text"], x["n_removed"]) for x in lines.dedup_lines(make(rows)).collect()}
    assert got == {i: x for (i, _), x in zip(rows, brute_lines(rows), strict=True)}
    assert got[62] == ("four", 3) and got[63] == ("before\n\n\ntail\n\nend", 3)


def test_rows_with_equal_or_no_ids_lose_their_copies(make):
    passage = "first line\nsecond line\nthird line"
    rows = [(1, passage), (1, passage), (None, passage), (None, passage + "\n\nown"), (None, "p\nq\nr"), (None, "p\nq\nr"), (0, "a\nb"), (0, "a\nb"), (None, None), (None, None)]
    got = lines.dedup_lines(make(rows)).collect()
    assert sorted(map(str, ((r["doc_id"], r["text"], r["n_removed"]) for r in got))) == sorted(map(str, ((i, *x) for (i, _), x in zip(rows, brute_lines(rows), strict=True))))
    assert sum(r["text"] == passage for r in got) == 1 and sum(r["text"] == "p\nq\nr" for r in got) == 1


def test_line_windows_of_odd_rows(odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = lines.dedup_lines(odd.withColumn("_of", F.lit(1)).withColumn("n_removed", F.lit("x"))).collect()
    assert len(got) == 10 and all(r["n_removed"] == 0 for r in got) and all(r["_of"] == 1 for r in got)
    assert sorted((r["text"] or "") for r in got) == sorted(t or "" for _, t in rows)


def test_a_sieve_loses_no_key(spark):
    rows = spark.range(5000).withColumn("x", F.lit("y"))
    for ids, bits in (([], 64), ([7], 64), (list(range(0, 5000, 3)), 1 << 12), (list(range(0, 5000, 3)), 1 << 26)):
        own = spark.createDataFrame([(i,) for i in ids], "k long")
        may, rest = common.sift(rows, "id", own, bits)
        passed = {r["id"] for r in may.collect()}
        assert set(ids) <= passed and passed | {r["id"] for r in rest.collect()} == set(range(5000)) and may.count() + rest.count() == 5000
        assert bits < 1 << 26 or len(passed) <= len(ids) + 5


def test_line_dedup_is_native(make):
    plan = lines.dedup_lines(make([(1, "a\nb\nc")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# Decontamination.
def alnum(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_hits(text, items, width=8):
    words, hit, found = alnum(text), set(), set()
    for item, t in items:
        own = alnum(t)
        if item is None or not own:
            continue
        n = min(width, len(own))
        for k in range(len(own) - n + 1):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == own[k : k + n]:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
    return words, hit, found


@pytest.mark.parametrize("shard_words, chunk, table", [(500_000, 4_000_000, 300_000), (40, 10, 300_000), (300, 40, 0)])
def test_decontamination_equals_brute_force(spark, make, monkeypatch, shard_words, chunk, table):
    """Also with shards and chunks of the benchmark so small that there are many of each, and with a vocabulary too large for a table."""
    monkeypatch.setattr(fmindex, "SHARD_WORDS", shard_words)
    monkeypatch.setattr(fmindex, "TABLE", table)
    r = random.Random(9)
    word = lambda: r.choice(["a", "B", "cc", "d1", "é", "x-y", "漢"])
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([3, 8, 9, 12, 20, 30])] + [(10, None), (11, "..."), (None, "a b c"), (3, "another text of item three with nine words here")]
    docs = [(k, " ".join(word() for _ in range(r.randint(0, 60)))) for k in range(40)]
    for k in range(12):
        own = alnum(items[r.choice([1, 2, 3, 4, 5])][1])
        docs.append((100 + k, " ".join([*(word() for _ in range(5)), *own[: r.choice([7, 8, 9, 99])], "zz"])))
    docs += [(200, None), (201, ""), (202, "a, b! c"), (202, "a, b! c")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = fmindex.contamination(make(docs), bench, chunk_words=chunk)
    got = sorted(map(tuple, fmindex.report(found).collect()))
    want = []
    for i, t in docs:
        words, hit, own = brute_hits(t, items)
        want.append((i, len(words), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), len(own) >= 2))
    assert got == sorted(want)


def test_chunks_hold_every_window_once(spark):
    r = random.Random(3)
    items = [(k, " ".join(f"w{r.randint(0, 9)}" for _ in range(r.choice([2, 5, 8, 30])))) for k in range(40)] + [(1, "w1 w2 w3")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(str(i), tuple(map(fmindex.hashed, w[k : k + 8]))) for i, t in items for w in [alnum(t)] for w in [[x.encode() for x in w]] for k in range(max(0, len(w) - 8) + 1)}
    for most in (7, 50, 10_000):
        got = []
        for c in fmindex.chunked(bench, 8, most):
            assert len(c.words) <= 2 * most + 7
            for w, (at, n) in enumerate(zip(c.at.tolist(), c.length.tolist(), strict=True)):
                got += [(c.ids[o], tuple(c.vocabulary[c.words[at : at + n] - 1].tolist())) for o in c.owners[c.first[w] : c.first[w + 1]]]
        assert set(got) == want and (most < 10_000 or len(got) == len(want))


def test_index_against_scan():
    import numpy as np

    r = np.random.default_rng(1)
    for n, sigma in ((3, 2), (200, 3), (500, 40)):
        seq = np.r_[0, r.integers(0, sigma, n), 0].astype(np.int64)
        index = fmindex.FMIndex(seq, sigma)
        for m in (1, 2, 4):
            if sigma < 2:
                continue
            pats = r.integers(1, sigma, (30, m)) if sigma > 1 else np.ones((30, m), dtype=int)
            low, high = index.search(pats)
            for p, a, b in zip(pats, low, high, strict=True):
                want = [i for i in range(len(seq) - m + 1) if (seq[i : i + m] == p).all()]
                assert sorted(index.locate(np.arange(a, b))) == want


def test_removal(make, spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine")], "item_id long, text string")
    docs = make([(1, "Start. One, two three-four five six SEVEN eight nine ten. End"), (2, "clean text stays. As it is!"), (3, None)])
    got = {r["doc_id"]: r["text"] for r in fmindex.clean(fmindex.contamination(docs, bench), docs.columns, least_items=1).collect()}
    assert got == {1: "Start.  ten. End", 2: "clean text stays. As it is!", 3: None}


def test_decontamination_of_odd_rows(odd, spark):
    bench = spark.createDataFrame([(1, "word1 word2 word3 word4 word5 word6 word7 word8 word9")], "item_id long, text string")
    got = fmindex.report(fmindex.contamination(odd.withColumn("spans", F.lit(1)), bench)).collect()
    assert len(got) == 10 and sorted(r["n_items"] for r in got) == [0] * 8 + [1, 1]
    none = fmindex.report(fmindex.contamination(odd, bench.limit(0))).agg(F.sum("n_hit")).first()[0]
    assert none == 0 and fmindex.contamination(odd.limit(0), bench).count() == 0
