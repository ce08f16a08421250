"""The operators of heronry.llm against brute force, with nulls, empty and long texts, repeats, empty tables and
columns whose names clash with the operators' own."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronry.llm import classifier as cl
from heronry.llm import components as cc
from heronry.llm import decontamination as dc
from heronry.llm import htmltext as ht
from heronry.llm import lmscore as lm
from heronry.llm import mixing as mx
from heronry.llm import ngram_join as nj
from heronry.llm import preferences as pf
from heronry.llm import sharding as sh
from heronry.llm import suffix_dedup as sd
from heronry.llm import topk as tk
from heronry.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, size long, score double, bucket int, word string, component_id long"
WORDS = [a + b + c for a in ("th", "en", "or", "st", "é") for b in ("an", "re", "ou", "ñ") for c in ("", "ti", "le", "A")]


def corpus(seed=3):
    """Rows with copies, near copies, shared passages, nulls, blanks, one very long text, repeated rows."""
    r = random.Random(seed)
    say = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    base, passage = say(120), say(30)
    texts = [base, base, base + " x", "y " + base, say(200) + " " + passage + " " + say(40), say(90) + "\n" + passage, None, "", " \t\n", "one", "one two", "One  TWO", "a b c", say(20000), passage]
    near = base.split()
    for k in (1, 2, 3, 5, 8, 20):
        w = list(near)
        for _ in range(k):
            w[r.randrange(len(w))] = "zz" + str(r.random())
        texts.append(" ".join(w))
    texts += [say(r.randrange(5, 150)) for _ in range(25)]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    rows += [rows[0], rows[4], (None, base), (None, None)]
    r.shuffle(rows)
    out = []
    for i, (d, t) in enumerate(rows):
        out.append((d, t, "en", None if i % 9 == 0 else f"src{i % 4}", None if t is None else len(t), 7, -1, 0.5, 3, "w", 99))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in folded).split(" ") if w]


def shingles(text, k):
    w = words_of(text)
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def linked(rows, k, num, den):
    """Brute force: smallest doc_id reachable."""
    sets = [(d, shingles(t, k)) for d, t, *_ in rows if d is not None]
    near = defaultdict(set)
    for d, a in sets:
        for e, b in sets:
            if a and b and den * len(a & b) >= num * len(a | b):
                near[d].add(e)
    out = {}
    for d, _ in sets:
        seen, todo = {d}, [d]
        while todo:
            for e in near[todo.pop()] - seen:
                seen.add(e)
                todo.append(e)
        out[d] = min(seen)
    return out


@pytest.mark.parametrize(("k", "num", "den", "block", "lists"), [(3, 90, 100, nj.BLOCK_SHINGLES, nj.LIST_BYTES), (5, 80, 100, nj.BLOCK_SHINGLES, 900), (3, 50, 100, 150, 500), (1, 70, 100, 60, nj.LIST_BYTES), (2, 34, 100, 400, 2000)])
def test_jaccard(docs, k, num, den, block, lists):
    rows = docs.collect()
    got = nj.jaccard_components(docs, k, num, den, block, lists).collect()
    assert len(got) == len(rows)
    want = linked(rows, k, num, den)
    assert {(g["doc_id"], g["component_id"]) for g in got} == {(d, want.get(d)) for d in {r["doc_id"] for r in rows}}
    assert Counter(g["n_shingles"] for g in got) == Counter(len(shingles(r["text"], k)) for r in rows)


def test_jaccard_of_near_copies_and_of_a_shared_line(spark, monkeypatch):
    """Groups of near copies at all distances, and a line that all texts have: its lists aren't dealt."""
    r = random.Random(21)
    line = " ".join(r.choice(WORDS) for _ in range(6))
    rows = []
    for g in range(25):
        base = [r.choice(WORDS) + str(r.randrange(40)) for _ in range(r.choice((4, 9, 30, 70)))]
        for _ in range(r.choice((1, 2, 6))):
            w = list(base)
            for _ in range(r.randrange(0, 8)):
                w[r.randrange(len(w))] = r.choice(WORDS)
            rows.append((len(rows) * 7 % 1009, " ".join(w) + (" " + line if r.random() < 0.9 else "")))
    rows += [(2000 + i, line) for i in range(5)] + [(3000 + i, " ".join([line] * i)) for i in range(1, 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    seen = []
    kernel = nj._postings_kernel
    monkeypatch.setattr(nj, "_postings_kernel", lambda *x: seen.append(len(x[3])) or kernel(*x))
    for k, num in ((1, 60), (2, 70), (3, 90), (3, 40)):
        got = {g["doc_id"]: g["component_id"] for g in nj.jaccard_components(d, k, num, 100, 300, 400).collect()}
        assert got == linked(rows, k, num, 100), (k, num)
    assert max(seen) > 0


def test_t_occurrence_is_a_join():
    r = np.random.default_rng(1)
    for num in (90, 70, 35):
        for _ in range(60):
            base = [r.integers(0, 60, int(r.integers(1, 30))).astype(np.uint64) for _ in range(3)]
            sets = [np.unique(np.concatenate([r.permutation(base[r.integers(3)])[: int(r.integers(1, 30))], r.integers(0, 60, int(r.integers(0, 4))).astype(np.uint64)])) for _ in range(12)]
            label = np.arange(12)
            for i in range(12):
                for j in range(i):
                    both = len(np.intersect1d(sets[i], sets[j]))
                    if 100 * both >= num * (len(sets[i]) + len(sets[j]) - both):
                        label[label == label[i]] = label[j]
            got = nj.t_occurrence(sets, np.array([len(s) for s in sets]), num, 100)
            assert [[int(x == y) for y in got] for x in got] == [[int(x == y) for y in label] for x in label]


def test_one_of_each(docs, none):
    rows, want = docs.collect(), linked(docs.collect(), 5, 80, 100)
    kept = nj.one_of_each(docs, 5, 80, 100)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids == Counter({d: 1 for d in want if want[d] == d}) + Counter({None: sum(r["doc_id"] is None for r in rows)})
    assert nj.one_of_each(none, 5, 80, 100).count() == 0 and nj.jaccard_components(none, 3, 90, 100).count() == 0


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51), (52, 51), (60, 60)], "u long, v long")
    got = {r["node"]: r["component"] for r in cc.components(e).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 50: 50, 51: 50, 52: 50}


@pytest.mark.parametrize("rows", [0, 7, 300])
def test_top_k(spark, rows, monkeypatch):
    monkeypatch.setattr(tk, "BUCKET_ROWS", 40)
    monkeypatch.setattr(tk, "QUERY_ROWS", 6)
    r = np.random.default_rng(rows)
    v = [(i, [float(x) for x in r.normal(0, r.choice([0.1, 1, 3]), 8)]) for i in range(rows)]
    v += [(1000, v[0][1]), (1001, v[0][1])] if v else []
    good = list(v)
    v += [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame([(a, b, 1.0, 2) for a, b in v], "vec_id long, embedding array<float>, norm double, rank int").repartition(3)
    got = defaultdict(list)
    for x in tk.top_k(df, 20, 5).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append((x["vec_id"], x["score"]))
    q = {i: [math.floor(64 * float(np.float32(x))) for x in e] for i, e in good}
    want = {}
    for i in q:
        if i % 20 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(q[i], q[j], strict=True)), j) for j in q if j != i))[:5]
            want[i] = [(j, -s) for s, j in scores]
    assert dict(got) == {k: x for k, x in want.items() if x}


def test_top_k_of_large_numbers_and_repeated_ids(spark):
    """Products over 2**53 are exact, lengths differ, a repeated query id has one list, a score beyond a long is an error."""
    big = [(0, [2e7, 1.0]), (1, [2e7, 1.0 + 1 / 64]), (2, [2e7, 1.0]), (3, [-2e7, 5.0]), (4, [2e7]), (5, []), (6, [0.0, 0.0])]
    d = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in tk.top_k(d, 20, 9).orderBy("rank").collect()]
    q = {i: [math.floor(64 * x) for x in v] + [0] * (2 - len(v)) for i, v in big if v}
    assert got == [(j, -s) for s, j in sorted((-sum(a * b for a, b in zip(q[0], q[j], strict=True)), j) for j in q if j)]
    twice = spark.createDataFrame([(0, [1.0, 2.0]), (0, [1.0, 1.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [0.0, 2.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in tk.top_k(twice, 20, 9).orderBy("rank").collect()] == [(2, 8192), (2, 8192), (1, 4096)]
    over = spark.createDataFrame([(0, [1e18, 1e18]), (1, [1e18, 1e18])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="exceeds a long"):
        tk.top_k(over, 20, 9).collect()


def test_top_k_of_zero_vectors(spark, monkeypatch):
    """A bucket of zero vectors only is one level under the others, not one for each that lies between."""
    monkeypatch.setattr(tk, "BUCKET_ROWS", 4)
    rows = [(i, [float(i % 3), 1.0 - i % 2] if i < 12 else [0.0, 0.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in tk.top_k(df, 20, 30, 4).orderBy("query_id", "rank").collect()]
    scaled = {i: [int(4 * x) for x in v] for i, v in rows}
    want = []
    for q in (0, 20):
        best = sorted((-sum(a * b for a, b in zip(scaled[q], v, strict=True)), i) for i, v in scaled.items() if i != q)[:30]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == want
    zeros = spark.createDataFrame([(i, [0.0]) for i in range(30)], "vec_id long, embedding array<double>")
    assert [x["vec_id"] for x in tk.top_k(zeros, 20, 3).where("query_id = 20").orderBy("rank").collect()] == [0, 1, 2]
    assert tk.top_k(df.limit(0), 20, 3).collect() == []


def test_mix(docs, none):
    rows = docs.collect()
    a = mx.mix(docs).collect()
    b = mx.mix(docs.repartition(7)).collect()
    assert sorted(map(str, a)) == sorted(map(str, b)) and len(a) == len(rows)
    sizes, taken, target = Counter(), Counter(), {}
    for x in a:
        assert 0 <= x["taken"] <= 2 * x["size"]
        sizes[x["source"]] += x["size"]
        taken[x["source"]] += x["taken"]
        target[x["source"]] = x["target"]
    assert sizes == Counter({s: n for s, n in Counter({None: 0}).items() if n}) + sum((Counter({r["source"]: len(words_of(r["text"]))}) for r in rows), Counter())
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    weights = dict(zip(sorted(s for s in sizes if s is not None) + [None] * (None in sizes), [3, 1, 2, 3, 1, 2], strict=False))
    open_ = [s for s in sizes if target[s] < 2 * sizes[s] - 1e-6]
    assert len({round(target[s] / weights[s], 6) for s in open_}) <= 1
    pieces = defaultdict(int)
    for x in a:
        for p in x["pieces"]:
            assert p["words"] > 0 and 0 <= p["start"] <= x["size"] - p["words"] and 0 <= p["place"] < 1
            pieces[p["shard"]] += p["words"]
    assert sum(pieces.values()) == sum(taken.values()) and set(pieces) <= set(range(16))
    whole = mx.mix(docs, whole=True)
    assert all(x["taken"] in (0, x["size"], 2 * x["size"]) for x in whole.collect())
    assert mx.mixed_texts(docs, whole).columns == docs.columns
    assert mx.mix(none).count() == 0


def test_mixed_texts_deals_more_chunks_of_more_words(docs):
    """Small chunks give many tasks, and the same rows."""
    taken = mx.mix(docs, whole=True)
    few, many = mx.mixed_texts(docs, taken), mx.mixed_texts(docs, taken, 50)
    rows = lambda df: Counter(tuple(r) for r in df.collect())
    assert rows(few) == rows(many)
    assert many._jdf.queryExecution().optimizedPlan().toString().count("__chunk") and "* 8" in few._jdf.queryExecution().optimizedPlan().toString() and "* 8" not in many._jdf.queryExecution().optimizedPlan().toString()


def test_mixed_texts_of_rows_without_or_with_repeated_ids(spark):
    """Each row comes as often as the mix takes it: rows with a null doc_id, with one doc_id and several texts, or all alike."""
    r = random.Random(8)
    say = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    rows = [(i, say(r.randrange(5, 40)), f"s{i % 3}") for i in range(60)] + [(None, say(r.randrange(5, 40)), f"s{i % 3}") for i in range(60)]
    rows += [(7, say(r.randrange(5, 40)), f"s{i % 3}") for i in range(30)] + [(None, "all alike", "s0")] * 9 + [(None, "all alike", None), (5, None, None), (None, None, "s1")]
    d = spark.createDataFrame([(*x, "en") for x in rows], "doc_id long, text string, source string, lang string").repartition(3)
    taken = mx.mix(d, whole=True).cache()
    text = {x["k"]: (x["doc_id"], x["text"], x["source"]) for x in d.withColumn("k", mx.row_key()).collect()}
    want, target = Counter(), {}
    for x in taken.collect():
        want[text[x["row"]]] += len(x["pieces"])
        target[x["source"]] = x["target"]
    found = mx.mixed_texts(d, taken).collect()
    got = Counter((x["doc_id"], x["text"], x["source"]) for x in found)
    assert got == +want and set(target) == {"s0", "s1", "s2", None}
    for s, n in target.items():
        assert abs(sum(len(words_of(x["text"])) for x in found if x["source"] == s) - n) <= 120


def md5_hex(*parts):
    return hashlib.md5(":".join(str(x) for x in parts).encode()).hexdigest()


def md5_unit(*parts):
    return int(md5_hex(*parts)[:13], 16) / 2**52


def tree(quotas, shards, seed):
    """Brute force of the splitting tree: {(source, pos): shard} of quotas {source: number of blocks}."""
    name = lambda s: "~" if s is None else "=" + s
    out, todo = {}, [(0, shards, [(s, i) for s, n in quotas.items() for i in range(n)])]
    while todo:
        lo, hi, units = todo.pop()
        if hi - lo == 1:
            out |= dict.fromkeys(units, lo)
            continue
        half = (hi - lo) // 2
        units.sort(key=lambda u: md5_hex(seed, lo, hi, name(u[0]), u[1]))
        left = math.floor(len(units) * half / (hi - lo) + md5_unit(seed, lo, hi))
        todo += [(lo, lo + half, units[:left]), (lo + half, hi, units[left:])]
    return out


def test_splitting_tree_is_exact_and_random(spark):
    quotas = {"a": 100, "b": 37, None: 5, "z": 0}
    rows = [(s, i, 9) for s, n in quotas.items() for i in range(n)] + [("z", 0, 0), ("a", 100, 0)]
    q = spark.createDataFrame(rows, "source string, pos int, take long")
    parts = {seed: {(r["source"], r["pos"]): r["lo"] for r in mx.split_quotas(q, 7, seed).collect()} for seed in (1, 2)}
    for seed, p in parts.items():
        assert p == tree(quotas, 7, seed) | {("z", 0): None, ("a", 100): None}
        totals = Counter(x for x in p.values() if x is not None)
        assert set(totals) == set(range(7)) and max(totals.values()) - min(totals.values()) <= 4
    assert parts[1] != parts[2]


def test_mix_takes_the_blocks_that_the_tree_deals(docs):
    """Pieces against brute force: line of records, permuted blocks, quotas, shards of the tree."""
    rows, seed, name = mx.mix(docs).collect(), 17, lambda s: "~" if s is None else "=" + s
    block = max(1, math.ceil(sum(math.floor(t + 0.5) for t in {r["source"]: r["target"] for r in rows}.values()) / mx.BLOCKS))
    taken, quotas = {}, {}
    for source, size, target in {(r["source"], r["source_size"], r["target"]) for r in rows}:
        left, pos, quota = math.floor(target + 0.5), 0, math.floor(target + 0.5)
        for p in range(max(1, math.ceil(quota / max(1, size)))):
            for i in sorted(range(math.ceil(size / block)), key=lambda i: md5_hex(seed, "block", name(source), p, i)):
                take = min(block, size - i * block, left)
                if take > 0:
                    taken[source, pos] = (p, i, take)
                    pos, left = pos + 1, left - take
        quotas[source] = pos
    shard_of = tree(quotas, 16, seed)
    words = {}  # of each source's line: (pass, place) -> shard
    for source, n in quotas.items():
        for pos, shard in enumerate(sorted(shard_of[source, i] for i in range(n))):
            p, i, take = taken[source, pos]
            words |= {(source, p, w): shard for w in range(i * block, i * block + take)}
    for source in quotas:
        line = sorted((r for r in rows if r["source"] == source), key=lambda r: (md5_hex(seed, r["doc_id"] if r["doc_id"] is not None else r["row"]), r["doc_id"] is not None, r["doc_id"], r["row"] or "", r["size"]))
        at = 0
        for r in line:
            want = {(p, w): words[source, p, at + w] for p in (0, 1) for w in range(r["size"]) if (source, p, at + w) in words}
            assert {(x["pass"], w): x["shard"] for x in r["pieces"] for w in range(x["start"], x["start"] + x["words"])} == want
            at += r["size"]
    places = [x["place"] for r in rows for x in r["pieces"]]
    assert len(set(places)) > 0.9 * len(places) and 0.3 < np.mean(places) < 0.7


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a></header>
<nav><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul></nav><div class="cookie-notice">We use the cookies of this site</div>
<article><h1>Title &amp; more</h1><p><b>Lead</b><br>text of the  article&nbsp;that is here for you and has enough of the words in it to be read.
<p>Second &lt;part&gt;<script>var x = "</p>";</script> is short.<div class="ad">Buy the thing now</div><aside>See also the others</aside>
<form>Search <input></form><p>End</p><section id="comments"><p>I think that the article is bad and that it was not for me at all.</p></section></article>
<footer>&copy; 2024 The site</footer></body></html>"""


def test_html():
    assert ht.main_text(PAGE) == "Title & more\n\nLead text of the article that is here for you and has enough of the words in it to be read.\n\nSecond <part> is short.\n\nEnd"
    plain = "<body><div class=menu><a href=x>The first of the links</a> <a href=y>and the second</a></div><div><h2>Head</h2><p>" + "This is the text of the page and it is long enough for the rules. " * 6 + "</p><p>Short one</p><p>" + "It is the last of the parts that we have in the page and it is long. " * 5 + "</p></div><div>Copyright</div>"
    got = ht.main_text(plain).split("\n\n")
    assert got[0] == "Head" and "Short one" in got and "Copyright" not in got and len(got) == 4
    for odd in (None, "", "<", "<p", "<!-- x", "<script>x", "</p></div>", "<a href='", "&amp", "<p>" * 3000):
        assert isinstance(ht.main_text(odd), str)


LONG = "This is the text of the page and it is long enough for the rules that we have. " * 4
MID = "It was one of the parts that they have in the page, and it is there for you to read."
ODD_PAGES = {
    "head isn't closed": (f"<head><title>T</title><p>{LONG}<p>{LONG}", [LONG, LONG]),
    "no head, no body": (f"<title>T</title>{LONG}", [LONG]),
    "svg closes itself": (f"<article><p>{MID} <svg viewBox='0 0 1 1'/> {MID}</p><p>{MID}</p></article>", [MID + " " + MID, MID]),
    "svg with text": (f"<article><p>{MID} <svg><text>icon</text></svg> {MID}</p></article>", [MID + " " + MID]),
    "svg isn't closed": (f"<article><p>{MID}<svg><p>{MID}</p></article>", [MID, MID]),
    "math": (f"<article><p>{MID} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> {MID}</p></article>", [MID + " x=2 " + MID]),
    "hidden as a value": (f'<article><p data-x="hidden">{MID}</p><p title="not hidden">{MID}</p><p hidden>{MID} no</p></article>', [MID, MID]),
    "a form around the page": (f"<form id=main><div><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div><input type=hidden value=1></form>", ["Title", LONG, LONG]),
    "a form in the page": (f"<p>{LONG}</p><form>Your name <input> and {MID}</form><p>{LONG}</p>", [LONG, LONG]),
    "words of names": (f'<article><p id="notice-1">{MID}</p><section class="side"><p>{MID}</p></section><div class="search-results"><p>{MID}</p></div></article>', [MID, MID, MID]),
    "names of containers": (f'<article><p>{MID}</p><div class="cookie-notice"><p>{MID} a</p></div><section id=comments>{MID} b</section><p class="ad">{MID} c</p></article>', [MID]),
    "Italian": ("<body><nav><a href=/>Prima</a> <a href=/>Seconda</a></nav><p>" + "Quando arrivammo davanti alla casa vecchia nessuno aveva ancora acceso luci. " * 5 + "</p>", ["Quando arrivammo davanti alla casa vecchia nessuno aveva ancora acceso luci. " * 5]),
    "Japanese": ("<body><nav><a href=/>一番</a></nav><p>" + "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。" * 6 + "</p>", ["吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。" * 6]),
    "a teaser": (f"<div><p>{LONG}</p><p>{LONG}</p></div><article><h3>Next</h3><p>{MID}</p></article>", [LONG, LONG, MID]),
    "two articles": (f"<article><p>{LONG}</p></article><div class=ad>{MID}</div><article><p>{LONG}</p></article>", [LONG, LONG]),
    "an unclosed quote": (f'<article><p>{MID}</p><a href="x>y</a><p>{MID}</p></article>', [MID, MID]),
    "references": ("<article><p>1 &lt; 2 &amp;&amp; 3 &gt; 2 &#233;&eacute;&nbsp;&copy; &unknown; &amp;amp;</p></article>", ["1 < 2 && 3 > 2 éé © &unknown; &amp;"]),
    "stray signs": (f"<article><p>a < b and <3 {MID}</p></article>", [f"a < b and <3 {MID}"]),
    "a comment with tags": (f"<article><p>{MID}<!-- <p>no</p> > --> and more</p></article>", [MID + " and more"]),
    "crossed tags": (f"<article><p><b>{MID}<i>x</b></i></p></div></section><p>{MID}</p></article>", [MID + "x", MID]),
    "cut off": (f"<article><p>{MID}</p><p>end <a href='x", [MID, "end"]),
    "script with an end tag in a string": (f"<article><p>{MID}</p><script>var s = '<p>no</p>';</script><p>{MID}</p></article>", [MID, MID]),
    "links": (f"<article><p>{MID}</p><ul><li><a href=/1>The first of the links</a><li><a href=/2>The second of the links</a></ul><p>{MID}</p></article>", [MID, MID]),
    "a button in a sentence": (f"<article><p>{MID} <button>Press</button> {MID}</p></article>", [MID + " " + MID]),
    "a button that isn't closed": (f"<article><p>{MID}<button>Press</p><p>{MID}</p></article>", [MID + " Press", MID]),
    "nothing": ("<nav><a href=/>x</a></nav><footer>&copy; y</footer>", []),
}


@pytest.mark.parametrize("name", ODD_PAGES)
def test_html_of_odd_pages(name):
    page, want = ODD_PAGES[name]
    assert ht.main_text(page).split("\n\n") == ([" ".join(x.split()) for x in want] or [""])


class PlainReader(HTMLParser):
    """Blocks once more, from the library's parser, for pages whose tags are all closed."""

    def __init__(self, page):
        super().__init__()
        self.path, self.out, self.text, self.linked, self.numbers = [], [], "", 0, Counter()
        self.feed(page)
        self.close()
        self.end()

    def end(self):
        text = " ".join(self.text.split())
        if text:
            form = [x for x in self.path if x["name"] in ("form", "fieldset")]
            outer = next((x for i, x in enumerate(self.path) if x["name"] in ("article", "main") and not any(y["bad"] for y in self.path[: i + 1])), None)
            named = [x for x in self.path if x["said"]]
            self.out.append(
                {
                    "text": text, "links": min(self.linked, len(text)) / len(text), "bad": any(x["bad"] for x in self.path), "article": outer and outer["number"], "form": form and form[0]["number"],
                    "head": any(x["name"] in ht.HEADINGS for x in self.path), "named": [x["number"] for x in named], "readers": any(x["said"] & ht.READERS for x in named),
                }
            )
        self.text, self.linked = "", 0

    def handle_starttag(self, tag, attrs):
        self.end() if tag in ht.BLOCKS else None
        said = set()
        for key, value in attrs:
            for word in (value or "").lower().split():
                if tag in ht.TEXT_BLOCKS:
                    said |= {word} & ht.BAD_NAMES if key in ("class", "role") else set()
                elif key in ("class", "role", "id") and tag not in ("article", "main", "body", "html"):
                    parts = word.replace("_", "-").split("-")
                    said |= set(parts) & ht.BAD_NAMES if set(parts) <= ht.BAD_NAMES | ht.NEUTRAL else set()
        bad = tag in ("nav", "footer", "aside", "menu", "dialog") or ("hidden", None) in attrs
        bad = bad or (tag == "header" and not any(x["name"] in ("article", "main") for x in self.path))
        self.numbers[0] += 1
        self.path.append({"name": tag, "bad": bad, "number": self.numbers[0], "said": said})

    def handle_endtag(self, tag):
        self.end() if tag in ht.BLOCKS else None
        self.path.pop()

    def handle_data(self, data):
        self.text += data
        self.linked += len(data.strip()) if any(x["name"] == "a" for x in self.path) else 0


def plain_text(page):
    """The rules once more, each block looking for its run and its neighbours on its own."""
    found = PlainReader(page).out
    chars = lambda rows: sum(len(b["text"]) for b in rows)
    for b in found:
        b["words"] = [w.lower() in ht.STOP_WORDS for w in re.findall(r"[^\W\d_]+", b["text"])]
        b["stops"] = sum(b["words"]) / len(b["words"]) if b["words"] else 0
    free = [b for b in found if not b["bad"] and b["links"] <= 0.33]
    held = {n: chars(x for x in free if n in x["named"] and not x["readers"]) for b in found for n in b["named"]}
    largest = [n for n in held if held[n] == max(held.values()) and 2 * held[n] > chars(x for x in free if not x["readers"])]
    bad = [not all(x["readers"] for x in free) if b["readers"] else not set(b["named"]) <= set(largest) for b in found]
    for b, worse in zip(found, bad, strict=True):
        b["bad"] |= worse
    free = [b for b in found if not b["bad"]]
    bad = [bool(b["form"]) and 2 * chars(x for x in free if x["form"] == b["form"]) <= chars(free) for b in found]
    for b, worse in zip(found, bad, strict=True):
        b["bad"] |= worse

    def run(i):
        """The blocks around block i that neither a block of links nor an article's edge parts from it."""
        out = []
        for order in (range(i, -1, -1), range(i + 1, len(found))):
            for j in order:
                if not found[j]["bad"]:
                    if (found[j]["links"] > 0.33 and not found[j]["head"]) or found[j]["article"] != found[i]["article"]:
                        break
                    out.append(j)
        return sorted(out)

    runs = {tuple(run(i)) for i, b in enumerate(found) if not b["bad"] and (b["links"] <= 0.33 or b["head"])}
    share = lambda r: (lambda w: sum(w) / len(w) if w else 0)([x for i in r for x in found[i]["words"]])
    size = lambda r: chars(found[i] for i in r)
    long = [r for r in runs if size(r) >= 200] or list(runs)
    foreign = bool(long) and all(share(r) < 0.15 for r in long)
    dense = [r for r in runs if foreign or share(r) >= 0.15]
    decided = {i for r in dense for i in r if size(r) >= min(200, max(map(size, dense)))}
    free = [b for b in found if not b["bad"] and b["links"] <= 0.33]
    inside = chars(b for b in free if b["article"])
    use = inside and inside >= chars(b for b in free if not b["article"] and len(b["text"]) >= 200 and (foreign or b["stops"] >= 0.3))

    def first(i):
        b = found[i]
        art = use and b["article"]
        if b["bad"] or (use and not b["article"]) or (b["links"] > 0.33 and not (b["head"] and (art or i in decided))):
            return "bad"
        if len(b["text"]) < 70 or b["head"]:
            return "near" if i in decided and not b["head"] and b["stops"] >= 0.15 else "short"
        if foreign or b["stops"] >= (0.15 if i in decided else 0.3):
            return "good" if art or i in decided else "near"
        return "near" if art or i in decided or b["stops"] >= 0.15 else "bad"

    def label(i):
        kind = first(i)
        alone = kind in ("short", "near") and not found[i]["head"] and i in decided and not any(first(j) == "good" for j in run(i))
        return "good" if alone else kind

    labels = [label(i) for i in range(len(found))]

    def side(i, step):
        j = i + step
        while 0 <= j < len(found) and (not use or found[j]["article"] == found[i]["article"]):
            if labels[j] in ("good", "bad") and not (use and found[j]["article"] and found[j]["bad"]):
                return labels[j]
            j += step
        return "good" if use and found[i]["article"] else "bad"

    out = []
    for i, b in enumerate(found):
        kind = labels[i]
        if kind in ("short", "near"):
            before, after = side(i, -1), side(i, 1)
            kind = before if before == after else after if b["head"] else "good" if kind == "near" else "bad"
        if kind == "good":
            out.append(b["text"])
    return "\n\n".join(out)


PROSE = ["It was the end of the day and they had come to the river.", "He said that it is not for us to know, and she was of the same mind.", "The house by the road is old, but it was there when the war was over and there is no other like it in all of the land."]
AROUND = (
    '<div class="navbar"><a href=/a>First</a> <a href=/b>Second of them</a></div><div class="cookie-notice">We use the cookies that are in use on all of the sites and of the others.</div>',
    '<ul><li><a href=/x>More of the news of the day</a></li><li><a href=/y>And what they said of it</a></li></ul>',
    '<div id="comments"><p>I think that it was not true and that he is not the one who was there at the time.</p></div><footer>&copy; 2024 by the makers of the site</footer>',
)
BODIES = {
    "short paragraphs": [PROSE[0]] * 8,
    "one paragraph": [PROSE[2]],
    "two lines": [PROSE[0], PROSE[1]],
    "mixed": [PROSE[i % 3] for i in range(11)],
    "a long one": [" ".join(PROSE * 9), PROSE[0], " ".join(PROSE)],
}
WRAPS = {
    "div": "<div>{}</div>",
    "article": "<article>{}</article>",
    "a class with another's name": '<div class="content with-sidebar">{}</div>',
    "an overlay around all": '<div class="overlay"><div>{}</div></div>',
    "nested": '<div id="page"><div class="market-share"><section class="related-work">{}</section></div></div>',
}


@pytest.mark.parametrize("body", BODIES)
@pytest.mark.parametrize("wrap", WRAPS)
def test_html_of_known_articles(body, wrap):
    """No article is lost for the length of its paragraphs, the element that it is in, or a part of a name."""
    want = ["The title of it", *BODIES[body]]
    inner = "<h1>The title of it</h1>" + "".join(f"<p>{x}</p>" for x in BODIES[body])
    page = f"<html><body>{AROUND[0]}{AROUND[1]}{WRAPS[wrap].format(inner)}{AROUND[1]}{AROUND[2]}</body></html>"
    assert ht.main_text(page).split("\n\n") == want


def test_html_names_inside_an_article_that_drop_nothing():
    page = f'<article><p>{MID}</p><section class="related-work"><p>{MID} a</p></section><div id="market-share"><p>{MID} b</p></div><div class="overlay"><p>{MID} c</p></div></article>'
    assert ht.main_text(page).split("\n\n") == [MID, MID + " a", MID + " b"]
    assert ht.main_text(f'<div class="overlay"><article><p>{MID}</p></article></div><p>Close</p>') == MID


def test_html_rules_decide(monkeypatch):
    """Neither the stop words nor the links can be left out of the rules."""
    tags = "harbour lantern granite meadow copper violin saddle orchard timber falcon " * 4
    linked = " ".join(f"<a href=/{i}>one of the pages that we have</a> and of it" for i in range(9))
    page = f"<div>{LONG}</div><ul><li><a href=/q>A link of the page to another one</a></li></ul><div>{tags}</div><ul><li><a href=/r>A link of the page to the next one</a></li></ul><div>{LONG}</div><div>{linked}</div>"
    want = [" ".join(LONG.split())] * 2
    assert ht.main_text(page).split("\n\n") == want
    with monkeypatch.context() as m:
        m.setattr(ht, "STOP_WORDS", frozenset())
        assert ht.main_text(page).split("\n\n") != want
    with monkeypatch.context() as m:
        m.setattr(ht, "LINKS", 1.1)
        assert ht.main_text(page).split("\n\n") != want


def test_html_finds_the_article_without_its_element():
    """The pages' own articles, their elements renamed."""
    import pyarrow.parquet as pq

    kept = whole = 0
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist():
        want = ht.main_text(page).split("\n\n")
        got = set(ht.main_text(re.sub(r"<(/?)article\b", r"<\1div", page)).split("\n\n"))
        whole += sum(map(len, want))
        kept += sum(len(x) for x in want if x in got)
    assert kept >= 0.95 * whole > 0


def test_html_against_a_plain_version():
    r = random.Random(12)
    words = ["the", "of", "and", "is", "it", "that", "heron", "river", "stone", "quick", "blue", "lantern", "walks"]

    def text():
        stops = r.random() < 0.7
        return " ".join(r.choice(words if stops else words[6:]) for _ in range(r.choice((2, 6, 15, 60))))

    def part(depth):
        kind = r.random()
        if depth and kind < 0.45:
            tag = r.choice(("div", "section", "article", "main", "nav", "footer", "aside", "header", "form", "fieldset", "ul", "table"))
            mark = r.choice(("", "", "", ' class="side-ad x"', ' id="content"', " hidden", ' class="post_comments"', ' role="navigation"'))
            return f"<{tag}{mark}>" + "".join(part(depth - 1) for _ in range(r.randrange(1, 5))) + f"</{tag}>"
        if kind < 0.6:
            return f"<h2>{text()}</h2>"
        if kind < 0.7:
            return f"<li><a href='/'>{text()}</a> {r.choice(words)}</li>"
        return f"<p{r.choice(('', '', ' class=ad', ' id=ad'))}>{text()} <a href='/x'>{r.choice(words)}</a></p>"

    kept = 0
    for _ in range(1500):
        page = "<html><body>" + "".join(part(3) for _ in range(r.randrange(1, 8))) + "</body></html>"
        assert ht.main_text(page) == plain_text(page), page
        kept += bool(plain_text(page))
    assert 300 < kept < 1450


def test_html_takes_time_in_proportion():
    for part in ("<p>short one</p>", '<a title="x>y', "<p>", "<svg>", "<!-", "<b class='", "<button>x", "<li><ul>", "<textarea>", "<div class=ad>", "<p>one of the"):
        began = time.process_time()
        ht.main_text("<article>" + part * 30_000 + "</article>")
        assert time.process_time() - began < 3, part


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "y"), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    got = ht.extracted(df).collect()
    assert sorted((r["page_id"], r["n_chars"] == len(r["text"])) for r in got) == [(1, True), (1, True), (2, True)] and ht.extracted(df.limit(0)).count() == 0


def test_classifier_gradients():
    r = np.random.default_rng(0)
    model = cl.fresh_model(1)
    for p in model.parts():
        p += r.normal(0, 0.05, p.shape).astype(p.dtype)
    raw = [b"hello there, world of bytes " * 20, b"AB!! CD!! " * 90, b"", b"x"]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    buffer, first = cl.padded(data, off)
    y = np.array([1, 0, 1, 0], np.float32)

    def loss():
        z = (cl.pooled(model, buffer, first) @ model.out + model.out_bias).astype(np.float64)
        return float(np.mean(np.log1p(np.exp(-np.where(y > 0, z, -z)))))

    grads = cl.gradients(model, buffer, first, y)
    for p, g in zip(model.parts(), grads, strict=True):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old, step = p[at], 3e-3
        p[at] = old + step
        up = loss()
        p[at] = old - step
        down = loss()
        p[at] = old
        assert (up - down) / (2 * step) == pytest.approx(float(g[at]), rel=0.15, abs=2e-4)


def plain_score(model, raw):
    """The network once more, window by window."""
    first = [i for i in range(0, len(raw) + cl.WIDTH, cl.BLOCK_BYTES)] if raw else []
    text = lambda i: raw[i] if 0 <= i < len(raw) else 0
    window = lambda i: bytes(text(i + j) for j in range(cl.WIDTH))
    total = len(first) * cl.BLOCK
    again = [any(window(i * cl.STRIDE) == window(i * cl.STRIDE - lag) for lag in cl.LAGS) and any(window(i * cl.STRIDE)) for i in range(total + 3)]
    chunks, blocks = [], []
    for b in range(len(first)):
        acts = []
        for w in range(b * cl.BLOCK, (b + 1) * cl.BLOCK):
            if w == total - 1:
                continue
            x = [v for byte in window(w * cl.STRIDE) for v in model.embed[byte]] + [cl.EXTRA_SIZE * again[w], cl.EXTRA_SIZE * (w < total - 3 and all(again[w : w + 4]))]
            acts.append(np.array(x, np.float64) @ model.filters.astype(np.float64))
        blocks.append(np.maximum(np.max(acts, 0) + model.bias, 0))
    if len(blocks) <= cl.CHUNK:
        chunks = [np.max(blocks, 0)] if blocks else []
    else:
        at = 0
        while at == 0 or at + cl.CHUNK - cl.STEP < len(blocks):
            chunks.append(np.max(blocks[at : at + cl.CHUNK], 0))
            at += cl.STEP
    feats = np.concatenate([np.mean(chunks, 0), np.max(chunks, 0)]) if chunks else np.zeros(2 * cl.FILTERS)
    return 1 / (1 + math.exp(-float(feats @ model.out + model.out_bias[0])))


def test_classifier_scores_like_a_plain_pass(monkeypatch):
    monkeypatch.setattr(cl, "SLICE", 3)
    r, model = np.random.default_rng(3), cl.fresh_model(2)
    model.bias += r.normal(0, 0.2, cl.FILTERS).astype(np.float32)
    model.out += r.normal(0, 0.5, 2 * cl.FILTERS).astype(np.float32)
    texts = [b"", b"a", b"word word word word again and again " * 8, bytes(r.integers(32, 255, 2600).astype(np.uint8)), b"ab " * 400, b"x" * 256, b"y" * 249, "é über ".encode() * 300]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    assert cl.scores(model, data, off).tolist() == pytest.approx([plain_score(model, x) for x in texts], abs=1e-4)


def test_classifier(spark, docs, none):
    r = random.Random(5)
    say = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    rows = [(i, say(60) if i % 2 else "!! ".join(say(40).upper().split())) for i in range(400)]
    rows += [(5000, None), (5001, ""), (5002, rows[1][1] + " " + say(30000))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(400)] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    model = cl.trained(d, labels)
    got = {x["doc_id"]: x for x in cl.scored(d.withColumn("score", F.lit("mine")), model).select("doc_id", "score", "predicted").collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["predicted"] == i % 2 for i in held]) > 0.97
    assert got[5000]["score"] == got[5001]["score"] and 0 <= got[5000]["score"] <= 1 and got[5002]["predicted"] == 1
    marks = {x["doc_id"]: x["h"] for x in d.select("doc_id", cl.held_out().alias("h")).collect()}
    assert {i for i in range(400) if marks[i]} == set(held)
    # Labels of held-out rows change nothing.
    other = labels.withColumn("quality", F.when(cl.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert all((a == b).all() for a, b in zip(model.parts(), cl.trained(d, other).parts(), strict=True))
    assert cl.scored(none, cl.trained(none, labels)).count() == 0 and cl.scored(docs, model).count() == docs.count()
    clash = cl.scored(d.select("doc_id", "text", F.lit(1).alias("score"), F.lit(2).alias("in_score"), F.lit(3).alias("Predicted")), model)
    assert len({c.lower() for c in clash.columns}) == 7 and clash.columns[:2] == ["doc_id", "text"] and clash.columns[-2:] == ["score", "predicted"]
    twice = cl.trained(d.unionByName(d.withColumn("text", F.concat("text", F.lit("~")))), labels)
    assert all((a == b).all() for a, b in zip(model.parts(), twice.parts(), strict=True))


def edits(item, text):
    """Fewest edits from item to any stretch of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def budget(n):
    """Edits allowed for an item of n characters: a tenth; none under seven."""
    return n // 10


def folded(t):
    return " ".join(w for w in (t or "").translate({c: c + 32 for c in range(65, 91)}).split(" ") if w) if t is not None else ""


def test_decontamination(spark, docs, none):
    r = random.Random(9)
    say = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate((12, 25, 40, 8))]
    items += [(100 + n, (say(60) + "z")[: n - 1] + "#") for n in (*range(1, 31), 45, 60, 99, 150, 200)]
    items += [(10, "short"), (11, None), (None, say(9)), (12, ""), (13, "  "), (14, "What is the capital?")]

    def changed(t, k):
        t = list(t)
        for _ in range(k):
            i = r.randrange(len(t))
            t[i : i + 1] = r.choice((["q"], [], ["q", t[i]]))
        return "".join(t)

    rows = [(i, say(20)) for i in range(5)] + [(100, None), (101, ""), (102, say(1500) + items[0][1]), (103, "He asks: WHAT is  the\ncapital? of it")]
    n = 200
    for _, t in items:
        if t and t.strip():
            for k in sorted({0, 1, 2, int(len(t) * 0.04), int(len(t) * 0.08), int(len(t) * 0.1), int(len(t) * 0.2)}):
                rows.append((n, say(6) + "\n" + changed(t, k).upper() + " " + say(7)))
                n += 1
            rows.append((n, t.replace(" ", "  \n ")))
            n += 1
    d = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id long, text string, item_id int, edits int").repartition(3)
    b = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, answer string")
    want = defaultdict(set)
    known = [(i, folded(t)) for i, t in items if i is not None and t and t.strip()]
    for doc, t in rows:
        text = folded((t or "").replace("\n", " "))
        for item, x in known:
            if x in text or (budget(len(x)) and edits(x, text) <= budget(len(x))):
                want[doc].add(item)
    for block in (dc.BLOCK_BYTES, 200):
        got = {x["doc_id"]: set(x["item_ids"]) for x in dc.contamination(d, b, block).collect()}
        assert got == dict(want)
        assert {x["doc_id"] for x in dc.decontaminated(d, b, block).collect()} == {a for a, _ in rows} - set(want)
    assert dc.contamination(docs, b.limit(0)).count() == 0 and dc.decontaminated(docs, b.limit(0)).count() == docs.count()
    assert dc.contamination(none, b).count() == 0


@pytest.mark.parametrize("at_once", [dc.HITS_AT_ONCE, 3000])
def test_decontamination_of_items_with_one_stem(monkeypatch, at_once):
    """500 items that begin alike against a text that repeats their beginning: found as by brute force, in the time of a few."""
    monkeypatch.setattr(dc, "HITS_AT_ONCE", at_once)
    r = random.Random(6)
    stem = " ".join(r.choice(WORDS) for _ in range(40))[:98]
    items = [(i, stem + f" {i * 7919 % 1000:03d}{r.choice('abc')}") for i in range(500)]
    text = " ".join(stem[:-3] + f"{r.randrange(1000)}{r.choice(WORDS)}" for _ in range(18)) + " " + items[3][1] + "x " + items[499][1][:-2]
    index, raw = dc.Index(items), np.frombuffer(text.encode(), np.uint8)
    began, got = time.time(), {}
    for x in index.search(raw, np.array([0, len(raw)])):
        got[x[1]] = min(x[4], got.get(x[1], 99))
    assert time.time() - began < 5 or at_once == 3000
    assert got[3] == 0
    for i in range(3, 500, 31):
        assert got.get(i, 99) == (edits(items[i][1], text) if edits(items[i][1], text) <= budget(len(items[i][1])) else 99)


def test_decontamination_of_repetitive_text(monkeypatch):
    monkeypatch.setattr(dc, "HITS_AT_ONCE", 2000)
    item, text = "ab" * 30, "ab" * 900 + "c" + "ab" * 25
    found = dc.Index([(1, item)]).search(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    assert {x[4] for x in found} >= {0} and all(a[3] <= b[2] or b[3] <= a[2] for a in found for b in found if a is not b)
    assert sum(x[4] == 0 for x in found) == 900 * 2 // 60


def test_decontamination_budget_is_a_tenth():
    """24 substitutions in an item of 250 characters are in its budget, 27 are not."""
    r = random.Random(4)
    item = " ".join(r.choice(WORDS) for _ in range(80))[:250]

    def with_edits(k):
        t = list(item)
        for i in range(k):
            t[i * len(t) // k + 2] = "q"
        return ("zzz " + "".join(t) + " zzz").encode()

    index = dc.Index([(7, item)])
    for k, found in ((0, True), (24, True), (27, False)):
        raw = np.frombuffer(with_edits(k), np.uint8)
        assert {x[1] for x in index.search(raw, np.array([0, len(raw)]))} == ({7} if found else set())


def test_decontamination_finds_a_tenth_of_edits_at_every_length():
    """Items of 1 to 200 characters with as many edits as they may have, and with one more."""
    r = random.Random(14)
    letters = "abcdefghijklmnoprstuvwxyz"
    for n in range(1, 201):
        item = "".join(r.choice(letters) for _ in range(n))
        index = dc.Index([(n, item)])
        for k in (budget(n), budget(n) + 1):
            for _ in range(3):
                t = list(item)
                for i in sorted(r.sample(range(n), min(k, n)), reverse=True):
                    t[i : i + 1] = r.choice((["1"], [], [t[i], "2"], ["3"]))
                text = "4 5 6 7 " + "".join(t) + " 8 9 0 1 2"
                raw = np.frombuffer(text.encode(), np.uint8)
                found = {x[1]: x[4] for x in index.search(raw, np.array([0, len(raw)]))}
                fewest = edits(item, text)
                assert found.get(n, 99) == (fewest if fewest <= budget(n) else 99), (n, k, item, text)


def test_preferences(spark):
    turns = [
        (0, 0, "system", "be kind"), (0, 1, "user", "hi"), (0, 2, "assistant", "hello é"), (0, 3, "user", "more"), (0, 4, "assistant", "ok"),
        (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "go away"),
        (2, 0, "user", "same"), (2, 1, "assistant", "same"), (3, 0, "user", "same"), (3, 1, "assistant", "same"),
        (4, 0, None, None), (5, 0, "user", ""), (6, 0, "user", "alone"), (None, 0, "user", "lost"),
    ]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, prompt string")
    got = {r["pair_id"]: r for r in pf.paired(df).collect()}
    assert set(got) == {0, 1, 2}
    a = got[0]
    assert a["prompt"] == "<|system|>\nbe kind<|end|>\n<|user|>\nhi<|end|>\n" and a["prompt_turns"] == 2
    spans = [a["chosen"][s["begin"] : s["finish"]] for s in a["chosen_mask"]]
    assert spans == ["hello é<|end|>\n", "ok<|end|>\n"] and [a["rejected"][s["begin"] : s["finish"]] for s in a["rejected_mask"]] == ["go away<|end|>\n"]
    assert got[1]["prompt_turns"] == 1 and got[1]["chosen"] == got[1]["rejected"] and got[2]["prompt_turns"] == 0
    assert pf.paired(df.limit(0)).count() == 0


def test_preferences_of_repeats_ties_and_long_conversations(spark):
    """Repeated rows are turns each, equal turn numbers go by role and text, thousands of turns are one pair."""
    r = random.Random(2)
    long = [(i, r.choice(("user", "assistant")), f"line {i % 7}") for i in range(2500)]
    data = {0: [(0, "user", "a"), (0, "user", "a"), (1, "assistant", "z"), (1, "assistant", "b")], 1: [(1, "assistant", "b"), (0, "user", "a"), (0, "user", "a")], 2: long, 3: long[:1200] + [(1200, "assistant", "other")]}
    rows = [(c, *t, 7) for c, turns in data.items() for t in turns]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pair_id int").repartition(3)
    got = {x["pair_id"]: x for x in pf.paired(df).collect()}
    for pair in (0, 1):
        a, b = (sorted(data[2 * pair + i]) for i in (0, 1))
        shared = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x[1:] != y[1:]), min(len(a), len(b)))
        shared = min(shared, len(a) - 1, len(b) - 1)
        show = lambda turns: "".join(f"<|{role}|>\n{text}<|end|>\n" for _, role, text in turns)
        x = got[pair]
        assert (x["prompt_turns"], x["prompt"], x["chosen"], x["rejected"]) == (shared, show(a[:shared]), show(a[shared:]), show(b[shared:]))
        for text, mask, turns in ((x["chosen"], x["chosen_mask"], a[shared:]), (x["rejected"], x["rejected_mask"], b[shared:])):
            assert [text[m["begin"] : m["finish"]] for m in mask] == [f"{t}<|end|>\n" for _, role, t in turns if role == "assistant"]


def removal(rows):
    """Brute force: (bytes, removed, spans, hash) by (doc_id, text)."""
    first = {}
    for d, t in rows:
        raw = (t or "").encode()
        if d is not None:
            for i in range(len(raw) - 49):
                g = raw[i : i + 50]
                first[g] = min(first.get(g, d), d)
    out = Counter()
    for d, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 49 if d is not None else 0):
            if first[raw[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        spans = sum(1 for i in range(len(raw)) if gone[i] and not (i and gone[i - 1]))
        out[(d, len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest())] += 1
    return out


@pytest.mark.parametrize("frequent", [sd.FREQUENT, 1])
def test_suffix_dedup(spark, docs, none, frequent):
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in sd.deduplicated(docs, 2000, 3000, frequent).collect())
    assert got == removal([(r["doc_id"], r["text"]) for r in docs.collect()])
    runs = [(i, "ab" * (20 + i) + "c" * i * 3 + "x" * 70) for i in range(12)] + [(20, "x" * 49), (21, "x" * 50), (22, "x" * 500)]
    df = spark.createDataFrame(runs, "doc_id long, text string").repartition(4)
    assert Counter(tuple(r) for r in sd.deduplicated(df, 500, 500, frequent).collect()) == removal(runs)
    # One phrase in many surroundings, each of them in several texts.
    r = random.Random(3)
    ends = ["".join(r.choice("abcdefgh ") for _ in range(40)) for _ in range(12)]
    runs = [(i, " ".join(r.choice(ends) + " a phrase that many texts have in them " + r.choice(ends) for _ in range(r.randrange(1, 4)))) for i in range(60)]
    df = spark.createDataFrame(runs, "doc_id long, text string").repartition(4)
    assert Counter(tuple(r) for r in sd.deduplicated(df, 3000, 2000, frequent).collect()) == removal(runs)
    assert sd.deduplicated(none).count() == 0


def test_suffix_dedup_refuses_texts_that_places_cannot_hold(monkeypatch):
    data, offsets = np.frombuffer(b"ab" * 200, np.uint8), np.array([0, 400])
    assert len(sd.anchors(data, offsets)[0])
    monkeypatch.setattr(sd, "PLACE", np.uint64(8))
    with pytest.raises(ValueError, match="places have 8 bits"):
        sd.anchors(data, offsets)


def test_suffix_dedup_deals_rows_without_ids_evenly():
    import pyarrow as pa

    rows = pa.RecordBatch.from_pydict({"doc_id": pa.array([None] * 900 + list(range(100)), pa.int64()), "text": ["x"] * 1000})
    place_of = lambda d: (sd.mix(d.view(np.uint64) + np.uint64(77)) % np.uint64(10)).astype(np.int64)
    places = Counter(x for b in sd._placed(iter([rows, rows]), place_of) for x in b.column("place").to_pylist())
    assert len(places) == 10 and max(places.values()) < 300


def test_suffix_runs_cover_their_contexts_and_no_more():
    r = np.random.default_rng(7)
    rows = []
    for doc in range(6):
        at = 0
        for _ in range(40):
            more = int(r.integers(0, 35))
            if r.random() < 0.7:
                src = int(r.integers(2))
                rows.append((doc, doc * 3, at, more, src, src * 5, at + int(r.choice([0, 7]))))
            at += more + 1
    r.shuffle(rows)
    x = [np.array(c) for c in zip(*rows, strict=True)]
    run, length = sd.claimed_runs(*x)
    cells = lambda d, s, src, t, n: {(d, src, s + i, t + i) for i in range(n)}
    want = set().union(*[cells(d, s, src, t, m + sd.SPAN) for d, _, s, m, src, _, t in rows])
    got = [cells(x[0][i], x[2][i], x[4][i], x[6][i], n) for i, n in zip(run, length, strict=True)]
    assert set().union(*got) == want and sum(map(len, got)) == len(want) and len(run) < len(rows)
    assert len(sd.claimed_runs(*[c[:0] for c in x])[0]) == 0


def test_suffix_sort_is_a_sort():
    r = np.random.default_rng(2)
    data = np.append(r.integers(97, 99, 3000).astype(np.uint8), np.zeros(sd.SPAN, np.uint8))
    at, group = np.arange(3000), np.sort(r.integers(0, 5, 3000))
    order, near = sd.sort_suffixes(sd.prefix_hashes(data), data, at, group)
    text = [bytes(data[i : i + sd.SPAN]) for i in at]
    assert [(group[i], text[i]) for i in order] == sorted(zip(group, text, strict=True))
    for p in range(1, 200):
        a, b = text[order[p - 1]], text[order[p]]
        same = next((k for k in range(sd.SPAN) if a[k] != b[k]), sd.SPAN)
        assert near[p] == (same if group[order[p - 1]] == group[order[p]] else 0)


def backoff(rows, order=3, own=1):
    """Brute force: ({doc: score}, {doc: words}) of [(doc, words)]; documents without id are only counted."""
    grams, heads = Counter(), Counter()
    for _, w in rows:
        for n in (1, 2, 3):
            for i in range(len(w) - n + 1):
                grams[tuple(w[i : i + n])] += 1
                heads[tuple(w[i : i + n])] += i + n < len(w)
    total, score, count = sum(len(w) for _, w in rows), defaultdict(float), Counter()
    for d, w in rows:
        for i, x in enumerate(w):
            history, back = tuple(w[max(0, i - order + 1) : i]), 0.0
            while history and grams[*history, x] <= own:
                history, back = history[1:], back + math.log10(0.4)
            score[d] += back + (math.log10((grams[*history, x] - own) / (heads[history] - own)) if history else math.log10(grams[x,] / total))
        score[d] += 0.0
        count[d] += len(w)
    return {d: x for d, x in score.items() if d is not None}, count


def lines(seed, n, hot):
    """Texts with a frequent word, pair and line."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        w = [r.choice(WORDS[:12] + [f"w{r.randrange(400)}"] * 8) for _ in range(r.randrange(0, 40))]
        for _ in range(hot):
            at = r.randrange(len(w) + 1)
            w[at:at] = r.choice((["all", "of", "this"], ["all", "of"], ["this", "all", "of", "this", "line"], ["all"]))
        out.append(w)
    return out


@pytest.mark.parametrize(("coded", "bytes_", "order", "own"), [(None, lm.PARTITION_BYTES, 3, 1), (None, 700, 3, 1), (5, 400, 3, 1), (0, 900, 3, 1), (None, 700, 2, 1), (None, 700, 3, 0)])
def test_lm_scores(spark, docs, coded, bytes_, order, own):
    for rows in ([(r["doc_id"], words_of(r["text"])) for r in docs.collect()], list(enumerate(lines(4, 150, 4))), list(enumerate(lines(5, 60, 1)))):
        d = spark.createDataFrame([(i, " ".join(w), 1, "x") for i, w in rows], "doc_id long, text string, n long, word string").repartition(3)
        want, count = backoff(rows, order, own)
        got = {r["doc_id"]: r for r in lm.scored(d, order=order, own=own, partition_bytes=bytes_, coded=coded).collect()}
        assert {i: r["n_words"] for i, r in got.items()} == {i: count[i] for i in want}
        assert {i: r["log_score"] for i, r in got.items()} == pytest.approx(want, abs=1e-5)
        assert all((r["mean_score"] is None) == (not count[i]) for i, r in got.items())


def test_lm_of_nothing(none, spark):
    assert lm.scored(none).count() == 0
    d = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (3, "a")], "doc_id long, text string")
    assert {r["doc_id"]: (r["n_words"], r["mean_score"]) for r in lm.scored(d).collect()} == {1: (0, None), 2: (0, None), 3: (1, round(math.log10(2 / 3), 6))}


def test_lm_sends_frequent_ngrams_to_all(spark):
    """The lists hold the frequent words, pairs and lines with their counts; the paths past the buckets are taken."""
    rows = lines(4, 150, 4)
    known, _ = lm.known_of(spark.createDataFrame([(" ".join(w),) for w in rows], "text string").repartition(3), 12)
    assert known.spread.any() and len(known.pairs) and len(known.triples)
    at = lambda *w: lm.joined(*[known.number(lm.word_hashes_of(x))[:1] for x in w])[0]
    pairs = Counter(p for w in rows for p in zip(w, w[1:], strict=False))
    assert known.pair_cnt[known.pairs.tolist().index(at("all", "of"))] == pairs["all", "of"]
    threes = Counter(p for w in rows for p in zip(w, w[1:], w[2:], strict=False))
    assert known.triple_cnt[known.triples.tolist().index(at("all", "of", "this"))] == threes["all", "of", "this"]


def test_lm_words_with_one_code(spark):
    """Two words whose hashes agree in the leading 40 bits, and one whose code is a spare one, keep their own counts."""
    a, b, c = "w1682715", "w2893187", "w3311"
    h = np.concatenate([lm.word_hashes_of(x) for x in (a, b, c)]).view(np.uint64)
    assert h[0] >> np.uint64(24) == h[1] >> np.uint64(24) and h[0] != h[1] and h[2] >> np.uint64(24) >= (1 << 40) - (1 << 20)
    texts = [f"{a} x {a} y {a} x {a}", f"{b} x {b}", f"z {b} {a} x {b} x", f"{c} z {c} z {c}", f"y {c} {b} {a}"]
    want, _ = backoff(list(enumerate(map(str.split, texts))))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for coded in (None, 2, 0):
        assert {r["doc_id"]: r["log_score"] for r in lm.scored(d, coded=coded, partition_bytes=40).collect()} == pytest.approx(want, abs=2e-6)


def test_lm_words_that_share_a_hash_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(lm, "range_hashes", lambda prefix, a, b: (b - a).astype(np.uint64) + np.uint64(1 << 50))
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"text": ["same size", "other"]})]
    with pytest.raises(ValueError, match="share"):
        list(lm.counts(10, 0.1)(iter([pa.RecordBatch.from_pydict({"text": ["same size", "that fell"]}), *batches])))


def test_lm_packed_numbers():
    known = lm.Known(9, 2, *[np.zeros(0, np.int64)] * 2, np.zeros(9), np.zeros(9), np.arange(9) % 2 == 1, *[lm.EMPTY] * 6)
    r = np.random.default_rng(5)
    x = [np.where(r.random(70_000) < 0.3, r.integers(1 << 16, 1 << 40, 70_000), r.integers(0, 9, 70_000)) for _ in range(4)]
    x[3] = np.where(known.is_spread(x[2]), x[3], 0)
    doc = np.repeat(np.array([5, -3]), [69_990, 10])
    [row] = lm.packs(known, np.zeros(len(doc), np.int64), doc, x)
    words, docs_ = lm.unpack(known, row[1], 4)
    assert (docs_ == doc).all() and all((a == b).all() for a, b in zip(words, x, strict=True))


def test_sharding(docs, none):
    rows, got = docs.collect(), sh.shard(docs, 5, 64).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and sh.shard(none).count() == 0
    # Placement against a plain version: slots by hash, the largest first to the emptiest shard, rows by slot.
    def vslot(d, text):
        key = str(d) if d is not None else "text:" + hashlib.md5(text.encode()).hexdigest()
        return int(hashlib.md5(key.encode()).hexdigest()[:8], 16) % 64

    held = defaultdict(list)
    for r in rows:
        text = r["text"] or ""
        held[vslot(r["doc_id"], text)].append((r["doc_id"] is None, r["doc_id"], zlib.crc32(text.encode()), len(text.encode()) + 8))
    load, where = [0] * 5, {}
    for v in sorted(held, key=lambda v: (-sum(x[3] for x in held[v]), v)):
        where[v] = load.index(min(load))
        load[where[v]] += sum(x[3] for x in held[v])
    want, at = Counter(), Counter()
    for v in sorted(held):
        for _, d, crc, size in sorted(held[v]):
            want[(d, size, crc, "bytes", where[v], at[where[v]], None, v)] += 1
            at[where[v]] += 1
    assert Counter(map(tuple, got)) == want
    again = sh.shard(docs.repartition(5), 5, 64).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_sharding_of_many_is_even_and_rebalances(spark, tmp_path):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    sums = [(r["vslot"], r["rows"], r["bytes"]) for r in sh.slot_sums(sh.sized(df)).collect()]
    first = sh.new_map(sums, 24)

    def loads(rows):
        out = Counter()
        for _, _, s, _, _, size in rows:
            out[s] += size
        return out

    load = loads(first)
    assert max(load.values()) - min(load.values()) <= 0.01 * max(load.values())
    grown = sh.rebalanced(first, sums, 25)
    load = loads(grown)
    was = {x[1]: x[2] for x in first}
    assert len(load) == 25 and max(load.values()) <= 1.05 * min(load.values()) and {x[0] for x in grown} == {2}
    assert sum(was[x[1]] != x[2] for x in grown) <= len(grown) / 25 * 1.6
    sh.store_map(spark, first, f"{tmp_path}/m")
    sh.store_map(spark, first, f"{tmp_path}/m")  # again: still one copy
    sh.store_map(spark, grown, f"{tmp_path}/m")
    assert sh.load_map(spark, f"{tmp_path}/m") == sorted(grown, key=lambda x: x[1]) and sh.load_map(spark, f"{tmp_path}/m", 1) == sorted(first, key=lambda x: x[1])


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    r = random.Random(11)
    say = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    items = [(i, say(30)) for i in range(3)]
    clean = [say(r.randrange(40, 120)) for _ in range(60)]
    texts = clean + ["!! ".join(say(60).upper().split()) for _ in range(40)]
    texts += [clean[0], clean[1] + " end", say(30) + " " + items[0][1] + " " + say(20), items[1][1], None, ""]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, int(i < 60), 0) for i in range(100)]
    for name, data, schema in (("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept, seen = docs, []
    for name, stage in cp.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
        kept = kept.cache()
        seen.append([x["doc_id"] for x in kept.collect()])
    quality, near, bench, mixed = seen
    assert set(range(60)) <= set(quality) and not set(quality) & set(range(60, 100))
    groups = linked([rows[i] for i in quality], 5, 80, 100)
    assert sorted(near) == sorted(d for d in groups if groups[d] == d)
    assert set(near) - set(bench) == {d for d in near if texts[d] and any(t in texts[d] for _, t in items)}
    size = {i: len(words_of(t)) for i, t in enumerate(texts)}
    assert set(mixed) <= set(bench) and max(Counter(mixed).values()) <= 2
    assert abs(sum(size[d] for d in mixed) - 1.5 * sum(size[d] for d in bench)) <= 3 * max(size.values())
    last = cp.STAGES[-1][1](spark, kept, str(tmp_path)).collect()
    assert Counter(x["doc_id"] for x in last) == Counter(mixed)
    assert Counter((x["doc_id"], x["shard"], x["slot"]) for x in cp.run(spark, str(tmp_path)).collect()) == Counter((x["doc_id"], x["shard"], x["slot"]) for x in last)


def test_pipeline_accounts_for_every_row(spark, tmp_path):
    """Null and repeated doc_ids, rows all alike, long and blank texts, extra columns with the operators' own names."""
    import corpus_pipeline as cp

    r = random.Random(13)
    say = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    items = [(i, say(25)) for i in range(2)]
    rows = [(i, say(r.randrange(30, 90))) for i in range(40)] + [(None, say(40)) for _ in range(5)] + [(None, "one and the same text of a row that has no id at all")] * 3
    rows += [(3, say(50)), (3, rows[3][1]), (4, rows[5][1]), (50, say(9000)), (51, None), (52, "  "), (None, None), (53, say(20) + items[0][1]), (None, items[1][1] + " " + say(9))]
    rows += [(60 + i, "!! ".join(say(50).upper().split())) for i in range(20)] + [(None, "!! ".join(say(50).upper().split()))]
    extra = "score double, predicted int, row string, pieces int, kept_id long, bucket int, size long, component_id long"
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    docs = spark.createDataFrame([(d, t, "en", None if i % 7 == 0 else f"s{i % 2}", len(t or ""), 0.5, 7, "r", 1, 2, 3, 4, 5) for i, (d, t) in enumerate(rows)], schema)
    labels = [(i, 1, 0) for i in range(40)] + [(60 + i, 0, 0) for i in range(20)]
    for folder, n in (("all", 1 << 30), ("none", 0)):
        docs.limit(n).write.parquet(f"{tmp_path}/{folder}/documents.parquet")
        spark.createDataFrame(labels[:n], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{folder}/labels.parquet")
        spark.createDataFrame(items[:n], "item_id long, text string").write.parquet(f"{tmp_path}/{folder}/benchmark.parquet")
    path = f"{tmp_path}/all"
    many = lambda df: Counter((x["doc_id"], x["text"]) for x in df.collect())
    kept = spark.read.parquet(f"{path}/documents.parquet")
    model = cl.trained(kept, spark.read.parquet(f"{path}/labels.parquet"))
    stages = dict(cp.STAGES)
    now = stages["quality_classifier"](spark, kept, path)
    passed = {t: s >= cl.THRESHOLD for t in {t for _, t in rows} for s in cl.scores(model, np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())])).round(6)}
    want = Counter(x for x in rows if passed[x[1]])
    assert many(now) == want and now.columns == docs.columns and sum(want.values()) < len(rows) - 18
    assert {tuple(x) for x in now.select(*[c.split()[0] for c in extra.split(", ")]).distinct().collect()} == {(0.5, 7, "r", 1, 2, 3, 4, 5)}
    near = stages["ngram_jaccard_join"](spark, now, path)
    groups = linked(list(want.elements()), 5, 80, 100)
    texts = lambda c: Counter({x: n for x, n in c.items() if x[0] is None})
    assert texts(many(near)) == texts(want) and {x[0] for x in many(near)} - {None} == {d for d in groups if groups[d] == d}
    assert all(n == 1 for x, n in many(near).items() if x[0] is not None) and set(many(near)) <= set(want)
    clean = stages["benchmark_decontamination"](spark, near, path)
    assert many(clean) == Counter({x: n for x, n in many(near).items() if not any(folded(t) in folded(x[1] or "") for _, t in items)})
    mixed = stages["mixing"](spark, clean, path)
    assert mixed.columns == docs.columns and set(many(mixed)) <= set(many(clean)) and max(many(mixed).values()) <= 6
    assert any(x[0] is None for x in many(mixed)) and all(n <= 2 * many(clean)[x] for x, n in many(mixed).items())
    assert Counter(x["doc_id"] for x in stages["sharding"](spark, mixed, path).collect()) == Counter(d for d, _ in many(mixed).elements())
    assert cp.run(spark, f"{tmp_path}/none").count() == 0


def test_queries_are_registered():
    assert [k.split("_")[0] for k in QUERIES] == [f"op{i}" for i in range(1, 14)] + ["pipeline"]
