"""The streaming entry fold against the batch fold, and expansion over undominated states against all paths."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from heronry.operators import events as ev
from heronry.operators import graph as gr
from heronry.streaming import entries as en

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, kind string, aggregate_id long, scope_id long, ts timestamp"


def log_rows(n=160, seed=1):
    r = random.Random(seed)
    kinds = ["assert", "revise", "revise", "retract", "access"]
    return [(i, r.choice(kinds), r.randrange(9) if i % 5 else 0, i % 4, T0 + dt.timedelta(hours=i * 3 + r.randrange(3))) for i in range(n)]


def appended(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def as_set(df):
    columns = ["memory_id", "aggregate_id", "scope_id", "status", "retention_stage", "valid_from", "valid_to", "superseded_by", "supersedes"]
    return {tuple(r) for r in df.select(*columns).collect()}


def batch_fold(spark, path):
    return ev.reduced_entries(spark.read.parquet(path).withColumn("ts", F.col("ts").cast("timestamp_ntz")))


def ran(query):
    query.awaitTermination(240)
    assert query.exception() is None and not query.isActive


def test_entry_stream_is_the_batch_fold(spark, tmp_path):
    """In pieces, with a restart in between, and with late events, which are refused."""
    log, out, cp = f"{tmp_path}/log", f"{tmp_path}/out", f"{tmp_path}/cp"
    rows = log_rows()
    for part in (rows[:50], rows[50:55]):
        appended(spark, part, log)
    ran(en.kept(en.entry_changes(stream(spark, log)), out, cp))
    assert as_set(en.entries(spark, out)) == as_set(batch_fold(spark, log))
    appended(spark, rows[55:], log)  # the query is started anew from its checkpoint
    ran(en.kept(en.entry_changes(stream(spark, log)), out, cp))
    want = as_set(batch_fold(spark, log))
    assert as_set(en.entries(spark, out)) == want and len(want) > 60
    late = [r for r in rows if r[1] == "assert"][:3]
    appended(spark, late, log)
    ran(en.kept(en.entry_changes(stream(spark, log)), out, cp))
    assert as_set(en.entries(spark, out)) == want
    refused = spark.read.parquet(out).where("change = 'refused'").select("version").collect()
    assert sorted(r[0] for r in refused) == sorted(r[0] for r in late)


def test_entry_stream_from_a_snapshot(spark, tmp_path):
    """The fold of a log's first part and a stream over the rest are the fold of the whole."""
    old, new, out = f"{tmp_path}/old", f"{tmp_path}/new", f"{tmp_path}/out"
    rows = log_rows(120, 4)
    appended(spark, rows[:70], old)
    appended(spark, rows[70:], new)
    log = spark.read.parquet(old).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    ran(en.kept(en.entry_changes(stream(spark, new), en.open_entries(log)), out, f"{tmp_path}/cp"))
    changed = {r[0]: r for r in as_set(en.entries(spark, out))}
    before = {r[0]: r for r in as_set(ev.reduced_entries(log))}
    whole = spark.read.parquet(old).unionByName(spark.read.parquet(new)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert set((before | changed).values()) == as_set(ev.reduced_entries(whole))


def test_entries_expire_by_a_timer(spark, tmp_path):
    """An entry that nothing closes expires once event time has passed it; closed ones don't."""
    log, out = f"{tmp_path}/log", f"{tmp_path}/out"
    hour = lambda n: T0 + dt.timedelta(hours=n)
    appended(spark, [(1, "assert", 1, 0, hour(0)), (2, "assert", 2, 0, hour(1)), (3, "retract", 2, 0, hour(2)), (4, "assert", 3, 0, hour(3))], log)
    appended(spark, [(5, "revise", 3, 0, hour(8)), (6, "assert", 4, 0, hour(12))], log)
    appended(spark, [(7, "assert", 5, 0, hour(13))], log)
    ran(en.kept(en.entry_changes(stream(spark, log), ttl=10 * 3600), out, f"{tmp_path}/cp"))
    assert {r["memory_id"] for r in spark.read.parquet(out).where("change = 'expired'").collect()} == {1}


def as_paths(df):
    return {(r["node"], r["start"], r["hop"], round(r["weight"], 9)) for r in df.select("node", "start", "hop", "weight").collect()}


@pytest.mark.parametrize(("seed", "nodes", "edges"), [(1, 8, 20), (2, 12, 60), (3, 30, 60), (4, 5, 25)])
def test_best_paths_without_all_paths(spark, seed, nodes, edges):
    r = random.Random(seed)
    rows = [(r.randrange(nodes), r.randrange(nodes), r.random() < 0.5) for _ in range(edges)]  # loops and repeats too
    e = spark.createDataFrame(rows, "src long, dst long, is_hard boolean")
    s = spark.createDataFrame([(r.randrange(nodes),) for _ in range(3)], "node long").distinct()
    for hops in (1, 2, 3):
        assert as_paths(gr.best_reached(e, s, hops)) == as_paths(gr.best_paths(gr.expanded(e, s, hops)))
    assert gr.best_reached(e, s.limit(0), 3).collect() == []


def test_states_stay_few_around_a_hub(spark):
    """Everything starts around one hub: a hop's rows are at most three times the edges, all paths are many times them."""
    hub = [(i, 0, i % 2 == 0) for i in range(1, 300)] + [(0, i, True) for i in range(1, 300)] + [(i, i + 1, False) for i in range(1, 299)]
    e = spark.createDataFrame(hub, "src long, dst long, is_hard boolean")
    s = e.where("src > 0").select(F.col("src").alias("node")).distinct()
    states = s.select("node", F.array().cast("array<bigint>").alias("trail"))
    first = e.join(states, e["src"] == states["node"]).select(F.col("dst").alias("node"), F.array("src").alias("trail")).distinct()
    kept = gr.undominated(first, 2)
    assert kept.where("node = 0").count() == 3 and first.where("node = 0").count() == 299
    second = e.join(kept, e["src"] == kept["node"]).where("not array_contains(trail, dst)")
    assert second.count() <= 3 * len(hub) < gr.expanded(e, s, 2).count()
    assert as_paths(gr.best_reached(e, s, 2)) == as_paths(gr.best_paths(gr.expanded(e, s, 2)))
