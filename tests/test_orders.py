"""Places in orders, pages, exact percentiles, packs of sentences and levels against plain versions."""

import random
import statistics
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronry.operators import chunks as ck
from heronry.operators import events as ev
from heronry.operators import graph as gr
from heronry.operators import hashtree as ht
from heronry.operators import layout as ly
from heronry.operators import metrics as mt
from heronry.operators import ordering as od


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_percentiles_are_exact(spark):
    """Ties, groups of one, nulls, a null group, groups of nulls only, a group with most rows."""
    r = random.Random(6)
    rows = [(r.choice(["a", "b", None, "hot", "hot", "hot"]), r.choice([1.5, 2.0, r.gauss(0, 9), None])) for _ in range(900)] + [("one", 4.0), ("none", None), ("none", None)] + [("same", 7.0)] * 300
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    out = mt.percentiles(df, ["g"], "v", {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0})
    got = {x["g"]: tuple(x)[1:] for x in out.collect()}
    for g in {g for g, _ in rows}:
        v = [x for h, x in rows if h == g and x is not None]
        want = tuple(np.percentile(v, p) for p in (0, 50, 95, 100)) if v else (None,) * 4
        assert got[g] == (pytest.approx(want) if v else want)
    assert len(got) == 7 and "percentile" not in plan(out).lower() and "collect" not in plan(out).lower()
    whole = mt.percentiles(df, [], "v", {"p50": 0.5}).first()["p50"]
    assert whole == pytest.approx(statistics.median(x for _, x in rows if x is not None))
    assert mt.percentiles(df.limit(0), ["g"], "v", {"p50": 0.5}).collect() == []
    half = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 2.0), ("b", 3.0)], "g string, v double")
    assert {tuple(x) for x in mt.percentiles(half, ["g"], "v", {"p": 0.5}, True).collect()} == {("a", 2), ("b", 2)}


def test_upper_medians(spark):
    rows = [("a", 3), ("a", 1), ("a", 2), ("a", 9), ("b", 5), ("b", 5), ("c", None)]
    got = {tuple(x) for x in mt.upper_median(spark.createDataFrame(rows, "g string, v long"), ["g"], "v").collect()}
    assert got == {("a", 3, 4), ("b", 5, 2), ("c", None, 1)}


def test_pages_read_one_range(spark):
    """Every page of a shuffled table, the cursor's pages, and how much a late page reads."""
    n = 20_000
    df = spark.range(n).select(F.col("id"), (F.col("id") * 7919 % n).cast("int").alias("k")).repartition(5)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = od.ordered(df, [F.col("k").desc()])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert rows.rows.select("__range").distinct().count() > 1 and rows.counts().first()["n"] == n
    for offset, limit in ((0, 3), (9_990, 20), (n - 2, 10), (n, 5)):
        assert [x["k"] for x in rows.page(offset, limit).collect()] == list(range(n - 1, -1, -1))[offset : offset + limit]
    late = rows.page(10_000, 2)
    assert late.select(F.input_file_name()).distinct().count() == 1 and "PartitionFilters: [" in plan(late) and "Exchange hash" not in plan(late)
    last = rows.page(4_000, 5).collect()[-1]
    assert [x["k"] for x in rows.after(last["cursor"], 4).collect()] == [n - 1 - i for i in range(4_005, 4_009)]
    end = rows.page(n - 1, 1).first()["cursor"]
    assert rows.after(end, 4).collect() == [] and od.ordered(df.limit(0), [F.col("k")]).page(0, 5).collect() == []


def test_newest(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, None)], "g string, i long, v string")
    assert {tuple(x) for x in ev.newest(df, ["g"], "i").collect()} == {("a", 3, "y"), ("b", 2, None)}


def test_packs_are_greedy_and_linear(spark):
    r = random.Random(3)
    for _ in range(200):
        sizes, most = [r.choice((1, 2, 5, 40)) for _ in range(r.randrange(30))], r.choice((1, 7, 50))
        want, used = [], None
        for i, n in enumerate(sizes):
            if used is None or used + n > most:
                want, used = [*want, i], 0
            used += n
        assert ck.cuts_of(np.array(sizes), most) == want
    took = []
    for n in (50_000, 400_000):  # the longer text has some 10 MB
        df = spark.range(1).select(F.repeat(F.lit("Four words are here. "), n // 2).alias("text"))
        began = time.time()
        got = df.select(F.size(ck.packed_sentences(F.col("text"), 1024)).alias("n")).first()["n"]
        took.append(time.time() - began)
        assert got == -(-(n // 2) // 256)
    assert took[1] < 16 * took[0] + 8
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "One.")], "i int, text string")
    assert [x["p"] for x in rows.orderBy("i").select(ck.packed_sentences(F.col("text")).alias("p")).collect()] == [[], [], ["One."]]


def plain_levels(nodes, needs):
    out, left = {}, {n: {b for a, b in needs if a == n} for n in {*nodes, *(a for a, _ in needs)}}
    for n in nodes:
        if not left[n]:
            out[n] = 0
    while True:
        ready = {n: 1 + max(out[m] for m in s) for n, s in left.items() if n not in out and s and all(m in out for m in s)}
        if not ready:
            return {n: out.get(n) for n in nodes}
        out |= ready


@pytest.mark.parametrize("seed", range(3))
def test_levels(spark, seed):
    """Chains of all lengths between nodes with several needs, cycles, self-needs and missing needs."""
    r = random.Random(seed)
    nodes = list(range(60))
    needs = [(i, r.randrange(max(1, i))) for i in nodes[1:] for _ in range(r.choice((1, 1, 1, 2)))] + [(100, 101), (101, 100), (102, 100), (103, 103), (104, 999), (105, 104), (106, 5), (106, 100)]
    nodes += [100, 101, 102, 103, 104, 105, 106]
    got = {x["node"]: x["level"] for x in gr.levels(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(needs, "node long, need long")).collect()}
    assert got == plain_levels(nodes, needs)


def test_levels_of_a_long_chain(spark, monkeypatch):
    """Fifty thousand in a row: under forty tables of the chain."""
    made, real = [], gr.written
    monkeypatch.setattr(gr, "written", lambda df, tag, *a: made.append(tag) or real(df, tag, *a))
    monkeypatch.setattr(gr, "settled", lambda df, tag, *a: made.append(tag) or real(df, tag))
    n = 50_000
    nodes = spark.range(n).select(F.col("id").alias("node"))
    out = gr.levels(nodes, nodes.where("node > 0").select("node", (F.col("node") - 1).alias("need")))
    assert out.where("level = node").count() == n
    assert made.count("chains") < 40


def test_layouts_are_scanned_and_joined_where_they_lie(spark):
    """A scope's folder only, an anti-join without an exchange, and folders pruned by the other side of a join."""
    log = spark.range(3_000).select(F.col("id").alias("event_id"), (F.col("id") % 5).alias("scope_id"), F.lit("access").alias("kind"))
    gone = log.where("event_id % 3 = 0").select("event_id")
    a, b = ly.laid_out(log, "event_id", ("scope_id",)), ly.laid_out(gone, "event_id")
    scoped = a.rows.where("scope_id in (1, 3) and event_id <= 50")
    assert "PartitionFilters: [scope_id" in plan(scoped) and "LessThanOrEqual(event_id,50)" in plan(scoped) and scoped.count() == 20
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan is the one that runs
    try:
        scopes = spark.createDataFrame([(1, "x"), (2, "y")], "scope_id long, name string")
        joined = a.rows.join(ly.laid_out(scopes, "scope_id").rows.where("name = 'x'"), "scope_id")
        assert "dynamicpruning" in plan(joined).lower() and joined.count() == 600
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        left = ev.replay(a.rows, archived=b.rows)
        assert "Exchange" not in plan(left) and "LeftAnti" in plan(left) and left.count() == 2_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    a.dropped()
    b.dropped()


def test_hash_trees(spark):
    """Equal rows in any order, changed, missing and unexpected ones, nulls, groups, and updates by the changed rows."""
    base = [(f"g{i % 3}" if i % 10 else None, i, f"v{i}" if i % 7 else None, i * 0.5) for i in range(800)]
    schema, columns = "g string, id long, v string, x double", ["v", "x"]
    now = [r for r in base if r[1] not in (5, 6)] + [("g1", 900, "new", 1.0)]
    now = [(g, i, "other" if i == 40 else v, None if i == 41 else x) for g, i, v, x in now]
    a, b = spark.createDataFrame(base, schema), spark.createDataFrame(now, schema).repartition(4)
    tree = ht.leaves(a, "id", columns, ["g"])
    prints = lambda t: {tuple(r) for r in ht.fingerprints(t, ["g"]).collect()}
    assert prints(tree) == prints(ht.leaves(a.repartition(7), "id", columns, ["g"])) != prints(ht.leaves(b, "id", columns, ["g"]))
    gone, come = a.join(b.select("id", F.lit(1).alias("k")), "id", "left").where("k is null or id in (40, 41)").select(*a.columns), b.where("id in (40, 41, 900)")
    after = ht.updated(tree, gone, come, "id", columns, ["g"])
    assert {tuple(r) for r in after.collect()} == {tuple(r) for r in ht.leaves(b, "id", columns, ["g"]).collect()}
    leaves = ht.differing_leaves(tree, after, ["g"])
    assert 0 < leaves.count() <= 5 and ht.differing_leaves(tree, tree, ["g"]).collect() == []
    stored = ht.registered(a, "id")
    out = ht.drift(stored, b, tree, "id", columns, ["g"])
    assert {(r["id"], r["drift"]) for r in out.collect()} == {(5, "unexpected"), (6, "unexpected"), (900, "missing"), (40, "changed"), (41, "changed")}
    assert "PartitionFilters: [branch" in plan(out) and ht.drift(stored, a, tree, "id", columns, ["g"]).collect() == []
