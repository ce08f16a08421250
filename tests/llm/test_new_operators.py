"""Operators 11 to 13 against brute force: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronry.llm import bpe
from heronry.llm import hard_negatives as hn
from heronry.llm import merkle as mk
from heronry.llm.queries import QUERIES

public_tokenizers = pytest.importorskip("public_tokenizers")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def plain_manifest(rows):
    groups = {}
    for d, text, lang, source, n in rows:
        tampered = d is not None and zlib.crc32(str(d).encode()) % 7 == 0
        leaf = H(*map(field, (d, source, lang, n, text)))
        claim = H(*map(field, (d, source, lang, n + 1 if tampered and n is not None else n, text)))
        groups.setdefault(lang, []).append(((d is not None, d or 0, leaf), d, leaf, claim))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g])]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for at, g in enumerate(order):
        for i, (_, d, leaf, claim) in enumerate(sorted(groups[g])):
            found, acc = [], claim
            for levels, j in ((trees[g], i), (top, at)):
                for row in levels[:-1]:
                    run = row[j - j % 2 : j - j % 2 + 2]
                    found += [x for k, x in enumerate(run) if k != j % 2]
                    acc = H(*[acc if k == j % 2 else x for k, x in enumerate(run)])
                    j //= 2
            out.append((d, leaf, trees[g][-1][0], top[-1][0], H(*found), acc, acc == top[-1][0]))
    return sorted(out, key=repr)


DOCS = "doc_id long, text string, lang string, source string, n_chars long, key long, leaf string, uid long, root string"


def manifest(df, bits, nodes):
    tampered = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)
    out = mk.proofs(mk.document_leaves(df, tampered), bits, nodes)
    rows = out.select("key", "leaf", "subroot", "root", F.sha2(F.array_join("siblings", ""), 256), "folded_root", F.col("folded_root") == F.col("root"))
    return sorted((tuple(r) for r in rows.collect()), key=repr)


@pytest.mark.parametrize(("bits", "nodes", "n", "langs"), [(1, 7, 60, 3), (2, 16, 200, 9), (10, 1 << 16, 300, 4), (2, 5, 1, 1), (1, 3, 17, 17), (2, 8, 250, 1)])
def test_manifest(spark, bits, nodes, n, langs):
    """Groups within and across partitions, one group, one leaf, groups of one leaf, vertices of several rounds."""
    r = random.Random(n)
    rows = []
    for i in range(n):
        lang = f"l{i % langs}" if langs in (1, 17) else r.choice([None, "", "é", *(f"l{k}" for k in range(langs)), *["hot"] * 12])
        rows.append((r.choice([None, i, i, i, i // 3]), r.choice([None, "", "é", f"t{i}", "x" * 5000]), lang, r.choice([None, "s"]), r.choice([None, 3, 2**63 - 1]), 1, "z", 0, "r"))
    rows += rows[:2] if langs not in (17,) and n > 1 else []
    got = manifest(spark.createDataFrame(rows, DOCS).repartition(3), bits, nodes)
    assert got == plain_manifest([x[:5] for x in rows])


def test_manifest_of_rows_that_are_alike_and_of_nothing(spark):
    rows = [(None, None, None, None, None, 1, "z", 0, "r")] * 70
    df = spark.createDataFrame(rows, DOCS)
    assert manifest(df, 2, 8) == plain_manifest([x[:5] for x in rows])
    assert manifest(df.limit(0), 2, 8) == []


def test_manifest_deals_one_group_to_many_tasks(spark):
    """One group holds all rows: its vertices still lie in several partitions."""
    leaves = spark.range(400).select(F.lit("g").alias("group"), F.col("id").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"), F.lit(None).cast("string").alias("claim"))
    out = mk.proofs(leaves, 2, 50)
    assert out.select(F.spark_partition_id()).distinct().count() > 3
    assert out.where("folded_root = root").count() == 400


def test_claims_are_caught(spark):
    leaves = spark.range(30).select(F.lit("g").alias("group"), F.col("id").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    bad = leaves.withColumn("claim", F.when(F.col("key") % 4 == 0, F.sha2(F.lit("other"), 256)))
    assert {r["key"] for r in mk.proofs(bad, 2, 10).where("folded_root <> root").collect()} == set(range(0, 30, 4))


def plain_negatives(rows, every, positives, negatives, low, high, scale):
    good = [(i, [int(np.floor(scale * float(x))) for x in v], l) for i, v, l in rows if i is not None and l is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    anchors = {}
    for i, v, l in good:
        if i % every == 0 and (i not in anchors or (v, l) < anchors[i]):
            anchors[i] = (v, l)
    out = []
    for a, (v, l) in anchors.items():
        pos = sorted((-dot(v, w), i) for i, w, m in good if m == l and i != a)[:positives]
        for p, i in pos:
            neg = sorted((-dot(v, w), j) for j, w, m in good if m != l and low * -p <= 100 * dot(v, w) <= high * -p)[:negatives]
            out += [(a, i, k + 1, j, -p, -s) for k, (s, j) in enumerate(neg)]
    return sorted(out)


def mined(df, *args):
    out = hn.hard_negatives(df, *args)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize(("rows", "anchors", "tile", "dense"), [(8192, 4096, 256, 0.05), (40, 7, 5, 0.0), (64, 16, 8, 1.0)])
def test_hard_negatives(spark, monkeypatch, rows, anchors, tile, dense):
    """Clusters, copies of one vector, zero vectors, ties, uneven lengths, nulls, repeated ids; blocks of several sizes."""
    monkeypatch.setattr(hn, "BLOCK_ROWS", rows)
    monkeypatch.setattr(hn, "ANCHOR_ROWS", anchors)
    r = np.random.default_rng(5)
    centres = r.normal(size=(6, 12))
    data = []
    for i in range(260):
        v = centres[r.integers(6)] + 0.5 * r.normal(size=12) if i % 3 else centres[0]
        data.append((i, [float(x) for x in v[: 12 - i % 2]], int(r.integers(3))))
    data += [(300, [0.0] * 12, 1), (301, [], 1), (302, None, 1), (303, [1.0, None], 1), (304, [float("nan")], 1), (305, [1.0], None), (None, [1.0], 1), (306, [float("inf")], 2)]
    data += [(10, [3.0] * 12, 2), (10, [3.0] * 12, 2), (20, [-1.0] * 5, 0), (-10, [0.5] * 12, 1)]
    df = spark.createDataFrame([(*x, 9, 0.5) for x in data], "vec_id long, embedding array<double>, label int, id long, score double").repartition(3)
    got = mined(df, 10, 4, 3, 50, 95, 16)
    assert got == plain_negatives(data, 10, 4, 3, 50, 95, 16)
    assert len(got) > 50
    assert mined(df.limit(0)) == []
    assert mined(df.where("vec_id % 10 > 0"), 10) == []


def test_survivors_hold_all_that_is_asked(monkeypatch):
    """Every pair above a bound survives, at every step, and few others do."""
    monkeypatch.setattr(hn, "DENSE", 1.1)
    r = np.random.default_rng(7)
    base = r.normal(size=(5, 40))
    real = np.floor(64 * (base[r.integers(5, size=900)] + 0.1 * r.normal(size=(900, 40))))
    turn = np.linalg.eigh(real.T @ real)[1][:, ::-1]
    cuts = [5, 10, 20, 40]
    side = hn.Side(np.arange(900), np.zeros(900, np.int64), real, turn, cuts)
    exact = (real @ real.T).astype(np.int64)
    bound = int(np.quantile(exact, 0.97))
    i, j, part = hn.survivors(side, side, slice(0, 200), slice(100, 900), cuts, lambda a, b, low, high: high >= bound)
    want = set(zip(*np.nonzero(exact[:200, 100:] >= bound), strict=True))
    got = set(zip(i.tolist(), (j - 100).tolist(), strict=True))
    assert want <= got and len(got) <= len(want) * 1.01 + 5
    assert np.allclose(part, exact[i, j])


def test_hard_negatives_of_large_numbers(spark):
    """Products that floats can't hold are whole numbers; beyond a long they are an error."""
    rows = [(0, [3e8, 1.0], 1), (1, [3e8, 2.0], 1), (2, [2.5e8, 7.0], 2), (3, [2.5e8, 8.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert mined(df, 50, 5, 3, 50, 95, 8) == plain_negatives(rows, 50, 5, 3, 50, 95, 8)
    with pytest.raises(Exception, match="exceeds a long"):
        mined(df, 50, 5, 3, 50, 95, 256)


def test_hard_negatives_go_round_the_driver(spark, monkeypatch):
    """No plan broadcasts a block, or copies it for each cell, however small Spark thinks that it is."""
    monkeypatch.setattr(hn, "BLOCK_ROWS", 20)
    monkeypatch.setattr(hn, "ANCHOR_ROWS", 6)
    plans = []
    for name in ("written", "settled"):
        f = getattr(hn, name)
        monkeypatch.setattr(hn, name, lambda df, *x, f=f: plans.append(df._jdf.queryExecution().executedPlan().toString()) or f(df, *x))
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(size=4)], i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert mined(df, 10, 4, 3, 50, 95, 64) == plain_negatives(rows, 10, 4, 3, 50, 95, 64)
    assert len(plans) >= 5
    for plan in plans:
        assert "Broadcast" not in plan and "Generate" not in plan, plan


POOL = [chr(c) for c in [*list(range(32, 127)) * 3, *range(0x80, 0x600)]] + ["<|endoftext|>", "<|startoftext|>", "ẛ̣", "Å", "'ll", "'S", " ", "\n", "꟎", "\U00010d50", "İ", "Σ", "힣", "가", "ཱུ", "\U0001f600", "\x1c", "\x85", " "]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_is_the_librarys(name):
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    own, library = bpe.Bpe(path), Tokenizer.from_file(path)
    r = random.Random(1)
    texts = ["", " ", "a", "'", "ab" * 40, "Hello world's  <|endoftext|>x", *("".join(r.choice(POOL) for _ in range(r.randrange(40))) for _ in range(1500))]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert own.ids(text) == want, text
        assert own.texts(pa.array([want], pa.list_(pa.int32())))[0].as_py() == library.decode(want, skip_special_tokens=False), text


def test_bpe_memo_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    own = bpe.Bpe(public_tokenizers.path("word_bpe_49k.json"))
    words = "the cat sat on the mat and the dog ran to the cat".split() * 3
    assert own.ids(" ".join(words)) == [i for w in words for i in own.merged(w.encode())]
    assert len(own.plain_words) <= 3 and len(own.plain_words.old) <= 3


def test_bpe_takes_little_more_than_linear_time():
    own = bpe.Bpe(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(4)
    word = "".join(r.choice("abcdefghij") for _ in range(120_000)).encode()
    took = []
    for n in (30_000, 120_000):
        began = time.process_time()
        own.merged(word[:n])
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 0.2


def test_bpe_rows(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [None, "", " \n", "One two", "One two", "x" * 3000, "é É 12", "<|endoftext|>", "word " * 50_000]
    df = spark.createDataFrame([(i if i != 3 else None, t, i, "n") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens long, decoded_sha256 string").repartition(2)
    both = bpe.decoded(bpe.encoded(df.select("doc_id", "text"), path), path)
    got = sorted(tuple(r) for r in bpe.digests(both).fillna(-1).collect())
    want = []
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i if i != 3 else -1, len(ids), H(" ".join(map(str, ids))), H(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want)
    assert bpe.decoded(bpe.encoded(df.limit(0), path), path).collect() == []
    with pytest.raises(ValueError, match="has a column"):
        bpe.encoded(df.withColumn("ids", F.lit(1)), path)


def test_bpe_refuses_what_it_cannot_do(tmp_path):
    import json

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        file = json.load(f)
    file["model"]["byte_fallback"] = True
    (tmp_path / "t.json").write_text(json.dumps(file), encoding="utf-8")
    with pytest.raises(ValueError, match="not supported"):
        bpe.Bpe(str(tmp_path / "t.json"))


def test_new_queries_are_registered():
    assert {"op11_hard_negative_mining", "op12_merkle_manifest", "op13_bpe_encoding"} <= set(QUERIES)
