"""The mix, shards, the pipeline, and all registered queries against their SQL."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import connect, same
from weftline.llm import cube, queries, shards


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_equals_sql(spark, sf, con, name):
    same(queries.QUERIES[name](spark, sf), con, queries.SQL[name])


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_returns_every_row(spark, sf, name):
    table = "pages" if name.startswith("op1_") else "documents"
    assert queries.QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/{table}.parquet").count()


# The mix.
def test_targets():
    got = cube.targets({"a": 100, "b": 100, "c": 100, None: 0})
    assert got["a"] == 200.0 and got[None] == 0.0
    assert sum(got.values()) == pytest.approx(450) and got["b"] == pytest.approx(250 * 2 / 3) and got["c"] == pytest.approx(250 / 3)
    many = cube.targets({f"s{k}": 10 + k for k in range(30)})
    assert sum(many.values()) == pytest.approx(1.5 * sum(10 + k for k in range(30))) and all(v <= 2 * (10 + int(s[1:])) + 1e-9 for s, v in many.items())
    assert cube.targets({}) == {} and cube.targets({"a": 0}) == {"a": 0.0}


def poured(sizes, weights=(5.0, 2.0, 1.0)):
    """Targets by pouring: the level at which min(twice the size, level * weight) adds up to 150 % of all sizes, by bisection."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weigh = {s: weights[k % 3] for k, s in enumerate(order)}
    low, high = 0.0, 4.0 * max(sum(sizes.values()), 1)
    for _ in range(200):
        level = (low + high) / 2
        low, high = (low, level) if sum(min(2 * sizes[s], level * weigh[s]) for s in order) >= 1.5 * sum(sizes.values()) else (level, high)
    return {s: min(2.0 * sizes[s], high * weigh[s]) for s in order}


def test_digest_of_the_mix_equals_sql_and_pouring(spark, sf, con):
    got = {r["doc_id"]: r for r in queries.op4_cube_mix(spark, sf).collect()}
    sql = r"""WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size FROM documents)
    SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source) AS source_size FROM d"""
    rows = con.execute(sql).fetchall()
    want = poured({s: int(n) for _, s, _, n in rows})
    taken, docs = Counter(), Counter()
    for i, source, size, source_size in rows:
        r = got.pop(i)
        assert (r["size"], r["source_size"]) == (size, source_size) and r["target"] == pytest.approx(want[source], rel=1e-9) and r["taken"] in (0, size, 2 * size) and r["taken"] >= size * int(want[source] / max(source_size, 1) + 1e-9)
        taken[source] += r["taken"]
        docs[source] += size > 0
    assert not got and all(abs(taken[s] - want[s]) <= 0.01 * want[s] + max(n for _, t, n, _ in rows if t == s) / 2 for s in want)


def test_flight_keeps_both_totals():
    r = np.random.default_rng(2)
    p, words = r.random(500), r.integers(0, 900, 500).astype(float)
    flown = cube.fly(p, words, np.ones(500), r.random(500))
    assert flown @ words == pytest.approx(p @ words) and flown.sum() == pytest.approx(p.sum())
    assert ((flown > 0) & (flown < 1)).sum() <= 2 and set(np.unique(cube.land(flown, words, np.ones(500)))) <= {0.0, 1.0}


def test_flight_is_unbiased():
    words, p, taken = np.array([5.0, 9, 2, 7, 1, 4, 8, 3]), np.full(8, 0.5), np.zeros(8)
    for k in range(600):
        taken += cube.fly(p, words, np.ones(8), np.random.default_rng(k).random(8))
    assert np.abs(taken / 600 - 0.5).max() < 0.09


@pytest.mark.parametrize("block", [2000, 12])
def test_mix(documents, block):
    own = documents.select("doc_id", "source", "text")
    got = cube.report(cube.mix(own, block=block)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, cube.report(cube.mix(own.repartition(7), block=block)).collect()))
    words = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in own.collect()}
    source = {r["doc_id"]: r["source"] for r in own.collect()}
    sums: Counter = Counter()
    for i, n in words.items():
        sums[source[i]] += n
    want, taken = cube.targets(dict(sums)), defaultdict(int)
    for r in got:
        assert r["size"] == words[r["doc_id"]] and r["source_size"] == sums[source[r["doc_id"]]] and r["target"] == pytest.approx(want[source[r["doc_id"]]]) and r["taken"] in (0, r["size"], 2 * r["size"])
        taken[source[r["doc_id"]]] += r["taken"]
    most = {s: max(words[i] for i in words if source[i] == s) for s in sums}
    assert all(abs(taken[s] - want[s]) <= most[s] for s in sums)


def test_mix_of_odd_rows(odd):
    got = cube.report(cube.mix(odd)).collect()
    assert len(got) == 10 and all(r["taken"] <= 2 * r["size"] for r in got)
    rows = cube.mixed(odd.withColumn("size", F.lit(1)).withColumn("key", F.lit(2)))
    assert rows.columns == [*odd.columns, "size", "key"]
    assert rows.select(F.sum(F.size(F.split(F.btrim("text"), "[\\x20\\x09-\\x0D]+")))).first()[0] >= sum(r["taken"] for r in got)
    assert cube.mix(odd.limit(0)).count() == 0 and cube.mixed(odd.limit(0)).count() == 0
    assert cube.mix(odd.where("text is null")).agg(F.sum("target")).first()[0] == 0


# Shards.
@pytest.mark.parametrize("limit", [10_000_000, 100_000, 9_000, 700])
def test_shards(documents, limit):
    got = shards.shard(documents, limit).collect()
    size: Counter = Counter()
    for r in got:
        size[r["shard"]] += r["n_bytes"]
    assert len(got) == documents.count() and all(size[r["shard"]] == r["shard_bytes"] and len(r["shard"]) == r["shard_depth"] for r in got)
    assert all(r["oversize"] == (r["shard_bytes"] > limit) for r in got) and all(r["shard_docs"] == 1 for r in got if r["oversize"])
    names = set(size)
    assert all(n[:k] not in names for n in names for k in range(len(n)))  # no shard's prefix is a shard
    for n in names:  # a shard was split off only where it had to be
        if n:
            assert sum(v for m, v in size.items() if m.startswith(n[:-1])) > limit


def test_shards_of_odd_rows(odd, tmp_path, spark):
    got = shards.shard(odd.withColumn("shard", F.lit("x")).withColumn("cell", F.lit(1)), 50).collect()
    assert len(got) == 10 and sum(r["oversize"] for r in got) == 2
    assert shards.shard(odd.limit(0)).count() == 0
    shards.write_shards(odd.where("doc_id is not null"), f"{tmp_path}/s", 50)
    assert spark.read.parquet(f"{tmp_path}/s").count() == 8


# The pipeline.
def test_pipeline(spark, sf, documents):
    import corpus_pipeline as cp
    from weftline.llm import fmindex, minhash

    docs = documents
    kept = []
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == documents.columns, name
        kept.append((name, docs))
    by = dict(kept)
    assert by["language"].count() >= 0.99 * documents.count()
    near = minhash.near_duplicates(by["language"])
    assert {r["doc_id"] for r in by["near_copies"].select("doc_id").collect()} == {r["doc_id"] for r in near.where("kept").collect()}
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert fmindex.report(fmindex.contamination(by["decontaminate"], bench)).where("n_items > 0").isEmpty()
    before = {r["doc_id"]: r["text"] for r in by["near_copies"].collect()}
    clean = {r["doc_id"] for r in fmindex.report(fmindex.contamination(by["near_copies"], bench)).where("n_items = 0").collect()}
    after = {r["doc_id"]: r for r in by["decontaminate"].collect()}
    assert clean <= set(after) and all(after[i]["text"] == before[i] for i in clean)
    copies = Counter(r["doc_id"] for r in by["mixture"].collect())
    want = {r["key"]: r["copies"] for r in cube.mix(by["decontaminate"]).collect()}
    assert {int(k): n for k, n in want.items() if n} == dict(copies)
    end = cp.run(spark, sf).collect()
    assert Counter(r["doc_id"] for r in end) == copies and all(r["shard_bytes"] <= cp.SHARD_BYTES or r["oversize"] for r in end)


def test_pipeline_stages_on_odd_rows(spark, sf, odd):
    import corpus_pipeline as cp

    more = {c: F.lit(7) for c in ("score", "spans", "items", "n_words", "key", "size", "component_id", "cell", "kept", "u_key", "a", "id")}
    for rows in (odd.withColumns(more), odd.limit(0)):
        docs = rows
        for name, stage in cp.STAGES:
            docs = stage(spark, docs, sf)
            assert set(rows.columns) <= set(docs.columns), name
        assert docs.count() >= 0 and all(r["score"] == r["spans"] == r["items"] == 7 for r in docs.collect() if "score" in rows.columns)


def test_copies_under_one_id_or_none_go(spark, make):
    import corpus_pipeline

    text = "the same eight words stand in this row"
    rows = [(1, text), (1, text), (None, text), (None, text), (2, text), (None, "another text that nobody has copied so far"), (None, None), (None, None), (3, ""), (3, "")]
    docs = make(rows).withColumn("__w_a", F.lit(1))
    got = corpus_pipeline.near_copies(spark, docs, "")
    assert got.columns == docs.columns
    left = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert sum(t == text for _, t in left) == 1 and len(left) == 6 and (1, text) in left


def test_the_pipeline_deletes_what_it_no_longer_needs(spark, sf, tmp_path, monkeypatch):
    import os

    import corpus_pipeline
    from weftline.llm import common

    for module in (common, corpus_pipeline):
        monkeypatch.setattr(module, "shared_dir", lambda spark: str(tmp_path))
    assert corpus_pipeline.run(spark, sf).count() > 0
    left = [x.split("-")[0] for x in os.listdir(tmp_path)]
    assert left.count("stage") == 1 and set(left) <= {"stage", "directory"}
    assert all(os.path.exists(p) for p in common._written if p.startswith(str(tmp_path)))


def test_documents_without_languages_stay(spark, make):
    import corpus_pipeline

    rows = [(k, f"plain words number {k}", None, "a") for k in range(20)] + [(20, None), (21, "12 _ 34"), (22, "")]
    got = corpus_pipeline.language(spark, make(rows), "")
    assert got.columns == make(rows).columns and sorted(r["doc_id"] for r in got.collect()) == list(range(20))


def test_targets_of_a_table_of_sources(spark):
    sizes = {f"é{k}": (k * k * 37) % 1000 for k in range(300)} | {None: 5, "": 70, "\U0001f600": 3, "\uffff": 4}
    for own in (sizes, {"a": 100, "b": 1}, {"a": 0}, {}):
        rows = spark.createDataFrame([(s, n, 1) for s, n in own.items()], "source string, size long, n long")
        got = {r["source"]: (r["source_no"], r["target"]) for r in cube.planned(rows).collect()}
        want = cube.targets(own)
        assert [s for s, _ in sorted(got.items(), key=lambda x: x[1][0])] == sorted(own, key=lambda s: (s is None, s or "")) and sorted(n for n, _ in got.values()) == list(range(len(own)))
        assert all(got[s][1] == pytest.approx(want[s]) for s in own)
    assert not hasattr(cube, "MAX_SOURCES")
