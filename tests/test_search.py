"""Cluster index, block-max lists, term statistics and the phrase automaton against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from heronry.functions.text import STOP_WORDS
from heronry.operators import retrieval as rt
from heronry.operators import termstats as ts
from heronry.operators import vectors as vx
from heronry.plans import base, catalog  # noqa: F401  registers the queries

WORDS = ["heron", "river", "stone", "lantern", "meadow", "copper", "violin", "saddle", "orchard", "timber", "falcon", "harbour", "the", "of"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def nearest(rows, queries, k):
    unit = lambda v: np.array(v, float) / np.linalg.norm(v)
    out = {}
    for q, v in queries:
        scores = sorted((-round(float(unit(v) @ unit(w)), 6), i) for i, w in rows)
        out |= {(q, i): n + 1 for n, (_, i) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("centres", [1, 7, 4096])
def test_cluster_index_is_exact(spark, monkeypatch, centres):
    """Clusters, copies of one vector, ties, and rows that take no part."""
    monkeypatch.setattr(vx, "QUERY_ROWS", 5)
    r = np.random.default_rng(2)
    middle = r.normal(size=(12, 8))
    rows = [(i, [float(x) for x in (middle[r.integers(12)] + 0.2 * r.normal(size=8) if i % 4 else middle[0])]) for i in range(400)]
    odd = [(500, None), (501, []), (502, [0.0] * 8), (503, [float("nan")] * 8), (504, [1.0, None]), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(3)
    index = vx.clustered(df, centres=centres)
    queries = [(i, v) for i, v in rows if i % 23 == 0] + [(900, [1.0] * 8)]
    asked = spark.createDataFrame([*queries, (901, None), (902, [0.0] * 8)], "query_id long, embedding array<double>")
    for k in (1, 6, 1000):
        got = {(x["query_id"], x["vec_id"]): x["rank"] for x in vx.search(index, asked, k).collect()}
        assert got == nearest(rows, queries, k)
    text = plan(vx.search(index, asked, 6))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    index.dropped()


def test_few_clusters_are_read(spark):
    """On vectors in clusters a question reads the blocks around it: less than a tenth of the table."""
    r = np.random.default_rng(3)
    middle = r.normal(size=(60, 16))
    v = middle[r.integers(60, size=6000)] + 0.05 * r.normal(size=(6000, 16))
    df = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    index = vx.clustered(df)
    queries = df.where("vec_id % 300 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    asked, _ = vx.bounded(index, queries, 10, "query_id", "embedding")
    read = vx.wanted(index, asked, 10).groupBy("query").agg(F.countDistinct("block").alias("n")).collect()
    blocks = index.blocks.count()
    assert len(read) == 20 and blocks > 60
    assert sum(x["n"] for x in read) / len(read) < 0.1 * blocks
    rows = [(i, list(map(float, x))) for i, x in enumerate(v)]
    got = {(x["query_id"], x["vec_id"]): x["rank"] for x in vx.search(index, queries, 10).collect()}
    assert got == nearest(rows, [q for q in rows if q[0] % 300 == 0], 10)


def test_cluster_index_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>")
    assert vx.search(vx.clustered(empty), asked, 5).collect() == []
    index = vx.clustered(spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>"))
    assert vx.search(index, asked.limit(0), 5).collect() == []


def tokens(text):
    return [w for w in (text or "").lower().split() if w not in STOP_WORDS]


def plain_bm25(docs, queries, k, weighting):
    t = {d: Counter(tokens(x)) for d, x in docs}
    n, avgdl = len(t), sum(sum(c.values()) for c in t.values()) / len(t)
    df = Counter(w for c in t.values() for w in c)
    weight = lambda tf, dl, w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))
    out = {}
    for q, x in queries:
        own = Counter(tokens(x))
        scores = defaultdict(float)
        for d, c in t.items():
            for w in own:
                if w in c:
                    scores[d] += weight(c[w], sum(c.values()), w) * (weight(own[w], sum(own.values()), w) if weighting == "weighted" else 1)
        best = sorted((-round(s, 6), d) for d, s in scores.items())[:k]
        out |= {(q, d): i + 1 for i, (_, d) in enumerate(best)}
    return out


@pytest.mark.parametrize("stored", [True, False])
def test_block_max_search_is_exact(spark, stored):
    r = random.Random(8)
    docs = [(i, " ".join(r.choices(WORDS, [2 ** -(j % 9) for j in range(len(WORDS))], k=r.choice((0, 1, 3, 20, 90))))) for i in range(500)]
    docs += [(600 + i, "heron river heron") for i in range(40)] + [(700, None), (701, "")]
    queries = [(i, " ".join(r.choices(WORDS, k=r.choice((1, 2, 2, 5))))) for i in range(30)] + [(90, "heron river"), (91, "absent"), (92, ""), (93, None)]
    df, asked = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(queries, "item_id long, text string")
    index = rt.indexed(df, stored=stored)
    for k, weighting in ((1, "weighted"), (7, "weighted"), (7, "binary"), (1000, "binary")):
        got = {(x["item_id"], x["doc_id"]): x["rank"] for x in rt.bm25_search(index, asked, k, weighting).collect()}
        assert got == plain_bm25(docs, queries, k, weighting)


@pytest.mark.parametrize(("cells", "questions"), [(1, 3), (50, 256), (1 << 20, 256)])
def test_search_moves_only_what_can_be_among_the_best(spark, monkeypatch, cells, questions):
    """Pieces and blocks of any size, many copies; postings are never dealt by document, and lists give the same."""
    monkeypatch.setattr(rt, "CELLS", cells)
    monkeypatch.setattr(rt, "QUESTIONS", questions)
    r = random.Random(10)
    docs = [(i, " ".join(r.choices(WORDS, k=r.choice((0, 2, 9))))) for i in range(120)] + [(200 + i, "copper violin") for i in reversed(range(60))]
    queries = [(i, " ".join(r.choices(WORDS, k=3))) for i in range(7)] + [(90, "violin copper")]
    df, asked = spark.createDataFrame(docs, "doc_id long, text string").repartition(2), spark.createDataFrame(queries, "item_id long, text string")
    index = rt.indexed(df, stored=True)
    out = rt.bm25_search(index, asked, 4)
    assert "hashpartitioning(item_id" in plan(out) and not re.search(r"hashpartitioning\([^)]*doc_id", plan(out))
    got = {(x["item_id"], x["doc_id"]): x["rank"] for x in out.collect()}
    assert got == plain_bm25(docs, queries, 4, "weighted")
    assert got == {(x["item_id"], x["doc_id"]): x["rank"] for x in rt.block_search(index, asked, 4).collect()}
    index.dropped()


def test_documents_that_share_an_id(spark):
    """As the queries' SQL has it: all rows are documents, those of one id and length count terms together, and an id's scores
    add up."""
    docs = [(1, "heron river"), (1, "heron stone"), (1, "heron"), (2, "river river stone"), (None, "heron meadow"), (None, "heron copper"), (3, "stone"), (4, "the")]
    index = rt.indexed(spark.createDataFrame(docs, "doc_id long, text string"))
    assert (index.n, index.avgdl) == (8, 13 / 8)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT * FROM (VALUES " + ", ".join(f"({d or 'NULL'}, {repr(t) if t else 'NULL'})" for d, t in docs) + ") d(doc_id, text)")
    con.execute("CREATE TABLE benchmark AS SELECT * FROM (VALUES (7, 'heron stone'), (8, 'river')) b(item_id, text)")
    want = con.execute(base.ORACLES["bm25_topk"]).fetchall()
    got = rt.bm25_search(index, spark.createDataFrame([(7, "heron stone"), (8, "river")], "item_id long, text string"), 10)
    assert {(r["item_id"], r["doc_id"], round(r["score"], 5)) for r in got.collect()} == {x[:3] for x in want}


def test_most_blocks_of_two_word_questions_are_left_out(spark):
    r = random.Random(9)
    names = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(r.choices(names, [1 / (j + 1) for j in range(300)], k=r.randrange(10, 120)))) for i in range(3000)]
    index = rt.indexed(spark.createDataFrame(docs, "doc_id long, text string"), stored=True)
    asked = spark.createDataFrame([(i, f"w{r.randrange(300)} w{r.randrange(300)}") for i in range(40)], "item_id long, text string")
    reads = rt.block_reads(index, asked, 10)
    n, read = reads.agg(F.count("*"), F.sum(F.col("needed").cast("int"))).first()
    assert n > 4000 and read < 0.5 * n
    # Folders of other terms aren't read at all.
    one = asked.where("item_id = 0")
    folders = index.of_terms(rt.token_rows(one, "item_id", "text"))
    assert "PartitionFilters: [part" in plan(folders) and folders.select("part").distinct().count() <= 2 < index.lists.select("part").distinct().count()


def test_an_index_of_files_that_changed_is_made_again(spark, tmp_path):
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(1, "heron"), (2, "river")], "doc_id long, text string").write.parquet(path)
    t = base.Tables(spark, str(tmp_path))
    asked = spark.createDataFrame([(1, "heron")], "item_id long, text string")
    first = t.index
    assert t.index is first and [x["doc_id"] for x in rt.bm25_search(first, asked, 5).collect()] == [1]
    spark.createDataFrame([(3, "heron heron"), (4, "stone")], "doc_id long, text string").write.mode("overwrite").parquet(path)
    assert [x["doc_id"] for x in rt.bm25_search(base.Tables(spark, str(tmp_path)).index, asked, 5).collect()] == [3]


SCOPED = [(i, f"scope{i % 3}" if i % 7 else None, f"s{i % 5}", " ".join(WORDS[(i * j) % 14] for j in range(1, i % 9)) if i % 11 else None) for i in range(80)]


def plain_stats(rows, by):
    groups = defaultdict(list)
    for r in rows:
        groups[r[by]].append(Counter(tokens(r[3])))
    return {g: (len(x), sum(sum(c.values()) for c in x) / len(x), Counter(w for c in x for w in c)) for g, x in groups.items()}


def test_statistics_add_up(spark):
    docs = spark.createDataFrame(SCOPED, "doc_id long, scope string, source string, text string")
    stats = ts.counted(docs)
    for name, by in (("scope", 1), ("source", 2)):
        got = {(r[name], r["term"]): (r["df"], r["n"], round(r["avgdl"], 9), round(r["idf"], 9)) for r in ts.weighed(stats, name).collect()}
        want = {(g, w): (df, n, round(avg, 9), round(math.log(1 + (n - df + 0.5) / (df + 0.5)), 9)) for g, (n, avg, dfs) in plain_stats(SCOPED, by).items() for w, df in dfs.items()}
        assert got == want
    assert ts.weighed(ts.counted(docs.limit(0)), "scope").collect() == []


def test_texts_are_read_once_for_statistics(spark, tmp_path):
    spark.createDataFrame(SCOPED, "doc_id long, scope string, source string, text string").write.parquet(f"{tmp_path}/docs")
    assert plan(ts.counted(spark.read.parquet(f"{tmp_path}/docs"))).count("FileScan") == 1
    assert plan(rt.indexed(spark.read.parquet(f"{tmp_path}/docs")).rows).count("Exchange") == 0


def test_statistics_follow_sources_without_old_texts(spark, tmp_path):
    """A source that comes again, a new one, and one that goes: only their own texts and folders are touched."""
    schema, path = "doc_id long, scope string, source string, text string", f"{tmp_path}/stats"
    ts.arrived(spark.createDataFrame(SCOPED, schema), path)
    before = {f for f in spark.read.parquet(path).inputFiles() if "source=s3" in f}
    fresh = [(900 + i, "scope1", f"s{1 + 8 * (i % 2)}", "heron lantern lantern") for i in range(6)]
    ts.arrived(spark.createDataFrame(fresh, schema), path)
    ts.departed(spark, path, ["s2"])
    now = [r for r in SCOPED if r[2] not in ("s1", "s2")] + fresh
    spark.catalog.clearCache()
    kept = ts.stored(spark, path)
    assert {tuple(r) for r in kept.collect()} == {tuple(r) for r in ts.counted(spark.createDataFrame(now, schema)).select(*ts.COLUMNS).collect()}
    assert {f for f in spark.read.parquet(path).inputFiles() if "source=s3" in f} == before
    both = ts.merged(ts.counted(spark.createDataFrame(SCOPED, schema)), ts.counted(spark.createDataFrame(fresh, schema)), spark.createDataFrame([("s2",)], "source string"))
    assert {tuple(r) for r in both.collect()} == {tuple(r) for r in kept.collect()}


def test_scoped_search_weighs_by_source_and_scope(spark):
    docs = spark.createDataFrame(SCOPED, "doc_id long, scope string, source string, text string")
    queries = [(i, " ".join(WORDS[(i + j) % 14] for j in range(3)), f"scope{i % 4}") for i in range(12)]
    asked = spark.createDataFrame(queries, "item_id long, text string, scope string")
    got = {(r["item_id"], r["doc_id"]): r["rank"] for r in ts.scoped_search(docs, ts.counted(docs), asked, 6).collect()}
    sources, scopes = plain_stats(SCOPED, 2), plain_stats(SCOPED, 1)

    def weight(tf, dl, w, stats):
        n, avg, df = stats
        return math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))

    want = {}
    for q, text, scope in queries:
        own, scores = Counter(tokens(text)), {}
        for d, s, source, x in SCOPED:
            c = Counter(tokens(x))
            hit = [w for w in own if w in c] if s == scope else []
            if hit:
                scores[d] = sum(weight(c[w], sum(c.values()), w, sources[source]) * weight(own[w], sum(own.values()), w, scopes[scope]) for w in hit)
        want |= {(q, d): i + 1 for i, (_, d) in enumerate(sorted((-round(s, 6), d) for d, s in scores.items())[:6])}
    assert got == want and got


@pytest.mark.parametrize("size", [1, 20, 1 << 18])
def test_phrases_in_texts(spark, size):
    """Anywhere in a text, inside words too, overlapping, repeated; null and empty phrases and texts."""
    docs = [(1, "red fox red"), (2, "blue fox"), (3, ""), (4, None), (5, "xredx é中文 fox")]
    phrases = [(10, "fox"), (11, "red f"), (12, "zz"), (13, "fox"), (14, ""), (15, None), (16, "é中"), (17, "red"), (18, "ed"), (19, "blue fox and more")]
    d = spark.createDataFrame([(*x, "n") for x in docs], "doc_id long, text string, phrase string")
    p = spark.createDataFrame(phrases, "item_id long, p string")
    out = rt.containing(d, p, "doc_id", "text", "item_id", "p", size)
    got = sorted((x["doc_id"], x["item_id"]) for x in out.collect())
    assert got == sorted((i, k) for i, t in docs for k, x in phrases if t and x and x in t)
    assert "Join" not in plan(out) and rt.containing(d, p.limit(0), "doc_id", "text", "item_id", "p").collect() == []
