"""Identifiers, guards, plans, answers, extractors and the index against plain versions."""

import json
import math
import random
import uuid

import pytest
from pyspark.sql import functions as F

from heronry.functions import values as vl
from heronry.operators import events as ev
from heronry.operators import graph as gr
from heronry.operators import planning as pl
from heronry.operators import retrieval as rt
from heronry.sources import sinks


def column(spark, rows, expression, schema="x string"):
    return [r["y"] for r in spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], f"i int, {schema}").select("i", expression.alias("y")).orderBy("i").collect()]


def leaves(x):
    if isinstance(x, dict):
        return sum(leaves(v) for v in x.values())
    return sum(map(leaves, x)) if isinstance(x, list) else len(x) if isinstance(x, str) else 0


def test_identifiers(spark):
    names = ["", "a", "memory/v1/3/7/12", "é über", "x" * 500]
    assert column(spark, [(n,) for n in names], vl.uuid5(F.col("x"))) == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_string_leaves(spark):
    r = random.Random(1)
    words = ["", "a", 'q"uote', "back\\slash", "tab\tline\n", "é", "\U0001f600", "k: v", '"', "ends\\"]

    def made(depth):
        kind = r.random()
        if depth and kind < 0.3:
            return {r.choice(words) + str(i): made(depth - 1) for i in range(r.randrange(4))}
        if depth and kind < 0.6:
            return [made(depth - 1) for _ in range(r.randrange(4))]
        return r.choice([*words, 1, 2.5, True, None])

    documents = [made(4) for _ in range(200)] + [{}, [], {"a": {"b": ["c"]}}]
    for style in ({}, {"ensure_ascii": False}, {"indent": 1, "separators": (" , ", " : ")}):
        assert column(spark, [(json.dumps(d, **style),) for d in documents], vl.string_leaves(F.col("x"))) == [leaves(d) for d in documents]


def test_instants_and_numbers(spark):
    times = ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05+02:00", "2024-01-02 03:04:05.25-05:30", "2024-01-02T03:04Z", "2024-01-02T03:04:05", "2024-13-02T03:04:05Z", "x", None]
    got = column(spark, [(t,) for t in times], F.unix_micros(vl.instant(F.col("x"))))
    base = 1704164645_000000
    assert got == [base, base - 7200_000000, base + 19800_250000, base - 5_000000, None, None, None, None]
    documents = ['{"a": 5}', '{"a": true}', '{"a": 5.0}', '{"a": "5"}', "{}", "[", None, '{"a": -9007199254740993}', '{"a": [1]}']
    assert column(spark, [(d,) for d in documents], vl.whole_number(F.col("x"), "$.a")) == [5, None, None, None, None, None, None, -9007199254740993, None]
    assert column(spark, [(1.5,), (math.inf,), (-math.inf,), (math.nan,), (None,)], vl.finite(F.col("x")), "x double") == [1.5, None, None, None, None]


@pytest.mark.parametrize("budget", [0, 99, 100, 160, 300, 1000, 1037, 5000])
def test_size_budget_is_the_tail_drop_loop(spark, budget):
    r = random.Random(budget)
    groups = {g: [json.dumps({"id": i, "t": "é" * r.randrange(120)}, ensure_ascii=False, separators=(",", ":")) for i in range(n)] for g, n in (("a", 1), ("b", 7), ("c", 60))}
    rows = [(g, i, x) for g, xs in groups.items() for i, x in enumerate(xs)]
    out = pl.size_budget(spark.createDataFrame(rows, "g string, i int, item string"), "g", [F.col("i")], "item", budget).collect()
    for g, items in groups.items():
        items, dropped = items[:50], 0
        total = len(items)

        def answer(n):
            status = "partial" if n < total else "complete"
            body = lambda c: f'{{"completion_status":"{status}","counts":{{"characters":{c},"returned":{n},"truncated_by_budget":{total - n}}},"memories":[{",".join(items[:n])}]}}'  # noqa: E731, B023
            return next(c for c in range(10, 100_000) if len(body(c)) == c)

        while dropped < total and answer(total - dropped) > budget:
            dropped += 1
        mine = [x for x in out if x["g"] == g]
        assert [x["kept"] for x in sorted(mine, key=lambda x: x["pos"])] == [i < total - dropped for i in range(total)]
        assert {x["characters"] for x in mine} == {answer(total - dropped)} and {x["completion_status"] for x in mine} == {"partial" if dropped else "complete"}


def test_levels_of_a_deep_chain_and_a_cycle(spark):
    nodes = spark.createDataFrame([(i,) for i in range(90)] + [(200,), (201,), (202,), (300,)], "node long")
    needs = spark.createDataFrame([(i, i - 1) for i in range(1, 90)] + [(5, 2), (200, 201), (201, 200), (202, 201), (300, 999)], "node long, need long")
    got = {r["node"]: r["level"] for r in gr.levels(nodes, needs).collect()}
    assert got == {**{i: i for i in range(90)}, 200: None, 201: None, 202: None, 300: None}


def test_extractors(spark):
    assert gr.inverse_pairs() == {"calls": "called_by", "called_by": "calls", "references": "referenced_by", "referenced_by": "references"}
    for bad in ((("a", "", {"x": "y"}),), (("a", "f", {}),), (("a", "f", {"X": "y"}),), (("a", "f", {"x": "y", "y": "z"}),), (("a", "f", {"x": "y"}), ("b", "g", {"x": "z"}))):
        with pytest.raises(ValueError):
            gr.inverse_pairs(bad)
    calls = gr.call_edges(spark.createDataFrame([("p", "f", "A#f"), ("p", "f", "B#f"), ("q", "f", "C#f"), ("p", "g", "A#g")], "path string, name string, chunk string"), spark.createDataFrame([("p", "A#g", "f"), ("p", "A#g", "f"), ("p", "A#f", "f"), ("p", "A#f", "none")], "path string, caller string, name string"))
    assert {(r["src"], r["dst"], r["relation"]) for r in calls.collect()} == {("A#g", "A#f", "calls"), ("A#f", "A#g", "called_by")}


def test_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fox red"), (2, "blue fox"), (3, ""), (4, None), (5, "red blue heron heron heron")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "red heron"), (8, "fox of"), (9, "absent")], "item_id long, text string")
    plain, stored = rt.indexed(docs), rt.indexed(docs, stored=True)
    assert (plain.n, plain.avgdl) == (stored.n, stored.avgdl) == (5, 10 / 5)
    a, b = ({(r["item_id"], r["doc_id"]): round(r["score"], 9) for r in rt.bm25_search(x, asked, 10).collect()} for x in (plain, stored))
    assert a == b and set(a) == {(7, 1), (7, 5), (8, 1), (8, 2)}


def test_manifest_and_rounds(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, x string")
    assert {(r["name"], r["n"], r["matches_replay"]) for r in sinks.manifest(spark, {"p": rows, "none": rows.where("id > 9")}).collect()} == {("p", 3, True), ("none", 0, True)}
    prints = ev.fingerprint(spark.createDataFrame([("g", i % 50, "x") for i in range(200)] + [("h", i, "x") for i in range(3)], "g string, i int, x string"), ["i", "x"], ["g"])
    again = ev.fingerprint(spark.createDataFrame([("h", i, "x") for i in (2, 0, 1)] + [("g", i % 50, "x") for i in reversed(range(200))], "g string, i int, x string").repartition(3), ["i", "x"], ["g"])
    assert {tuple(r) for r in prints.collect()} == {tuple(r) for r in again.collect()}


def test_outcome_of_a_recall(spark):
    """Hits by path and question: none, one path's only, repeated ones, more than asked for."""
    questions = spark.createDataFrame([(1, 0), (2, 0), (3, 2), (4, 3)], "item_id long, round int")
    dense = spark.createDataFrame([(1, 10), (1, 11), (3, 10)], "item_id long, doc_id long")
    sparse = spark.createDataFrame([(1, 10), (1, 12), (1, 13), (4, 9)], "item_id long, doc_id long")
    got = {r["item_id"]: tuple(r)[1:] for r in pl.outcome({"dense": dense, "sparse": sparse}, questions, 3, F.col("round"), 3).collect()}
    assert got == {
        1: (3, [], 0, "complete", False),
        2: (0, ["dense", "sparse"], 3, "no_evidence", True),
        3: (1, ["sparse"], 2, "partial", True),
        4: (1, ["dense"], 2, "partial", False),
    }
