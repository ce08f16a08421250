"""Operator 1: n-gram Jaccard self-join by T-occurrence search.

Two documents link when den * |A & B| >= num * |A | B| for their sets of word shingles.

1. Equal sets are one class, found by a 128-bit hash of the set, so that exact copies cost one row each.
2. Inverted lists of all shingles, dealt by shingle. Lists of one class tell nothing. Of each other list the length
   goes back to its classes. Who links with another class shares at least T = num / den * n of its n shingles with
   it; classes with fewer shingles in lists go.
3. Of a class the T - 1 longest lists are set aside; the short ones are merged: classes that meet in a list that
   is short for both are put in one block (connected components). Every link is in a block: lengths, and
   shingles where those agree, order all lists alike, and the first list of two linked classes' common ones
   is short for both, as T - 1 more follow it.
4. T-occurrence search in each block (DivideSkip) over the classes' lists: for each class the L longest of its
   lists are set aside, the short ones are merged, classes that reach T - L occurrences are probed by binary
   search in the long lists, and those that reach T link. Pairs that are connected already are not
   probed again, so a block of copies costs no pairs.
5. A block over the size limit is cut into parts, and each pair of parts is searched on its own; the
   links of those parts are joined by connected components.

A list that fills more than a quarter of a bucket isn't dealt: it is known as long by all tasks, fewer than four
times the buckets, and its classes have it at once. Lists are merged in each batch before any is dealt in step 3.
A shingle is told apart by its bucket and 48 bits of its hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .components import components
from .runtime import released, settled, written
from .textkernel import mix, shingle_sets, text_buffers, thrifty, trimmed

#: Shingles that one search task holds.
BLOCK_SHINGLES = 1_500_000
#: Bytes of text behind each bucket of lists, and of classes.
LIST_BYTES, CLASS_BYTES = 16 << 20, 40 << 20
#: Shingles that are dealt at once.
DEALT = 1 << 20
#: DivideSkip's weight of a long list's probes.
MU = 0.01
#: The level of a list that isn't dealt; those of others are by length, eight to a doubling.
LONGEST = 255

THIN = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("c1", T.LongType()),
        T.StructField("c2", T.LongType()),
    ]
)


def _set_names(s: np.ndarray) -> tuple[int, int]:
    return (
        int(np.add.reduce(mix(s ^ np.uint64(0x1234567)), dtype=np.uint64)),
        int(np.add.reduce(mix(s + np.uint64(0x7654321)), dtype=np.uint64)),
    )


def _as_long(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _named_sets(batch: pa.RecordBatch, k: int) -> tuple[list[np.ndarray], list[tuple]]:
    data, offsets = text_buffers(batch.column("text"))
    sets = shingle_sets(data, offsets, k)
    return sets, [_set_names(s) if len(s) else (None, None) for s in sets]


def _sets_kernel(k: int, parts: int):
    """Size and 128-bit name of each row's set; and, with n = -1, shingles (c1) that are in so many of a batch's
    classes (c2) that their lists may be too long to be dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, names = _named_sets(batch, k)
            valid = np.array(batch.column("doc_id").is_valid())
            own = [sets[i] for i in {name: i for i, name in enumerate(names) if name[0] is not None and valid[i]}.values()]
            least = max(8, sum(map(len, own)) / (8 * parts))
            slot = lambda s: (s >> np.uint64(44)).astype(np.int64)
            table = np.zeros(1 << 20, np.int32)
            for s in own:  # a shingle is in a set once, two of one slot seldom
                table[slot(s)] += 1
            often = [s[table[slot(s)] >= least] for s in own]
            often, count = np.unique(np.concatenate(often) if often else np.zeros(0, np.uint64), return_counts=True)
            often, count = often[count >= least].view(np.int64), count[count >= least]
            c1, c2 = ([None if x[i] is None else _as_long(x[i]) for x in names] for i in (0, 1))
            columns = [batch.column("doc_id").cast(pa.int64()).to_pylist() + [None] * len(often), [len(s) for s in sets] + [-1] * len(often), c1 + often.tolist(), c2 + count.tolist()]
            del sets, own
            trimmed()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "n", "c1", "c2"])

    return run


PACK = "bucket int, tokens binary, levels binary, owners binary, runs binary"


def _packed(bucket: np.ndarray, token: np.ndarray, own: np.ndarray, size: int, level: np.ndarray | None = None) -> list[tuple]:
    """A row per bucket: `size` bytes of each token, a byte of its level, owners as runs of equal ones."""
    order = np.lexsort((own, bucket))
    rows = []
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
        o = own[part]
        new = np.flatnonzero(np.append(True, o[1:] != o[:-1]))
        low = np.ascontiguousarray(token[part]).view(np.uint8).reshape(-1, 8)[:, :size]
        runs = np.diff(np.append(new, len(o))).astype(np.uint32).tobytes()
        rows.append((int(bucket[part[0]]), low.tobytes(), level[part].astype(np.uint8).tobytes() if level is not None else None, o[new].tobytes(), runs))
    return rows


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], names=[x.split()[0] for x in PACK.split(", ")])


def _unpacked(table: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, owner, level) of the packed rows of a bucket."""
    raw = {c: b"".join(x or b"" for x in table.column(c).to_pylist()) for c in ("tokens", "levels", "owners", "runs")}
    token = np.zeros((len(raw["tokens"]) // size, 8), np.uint8)
    token[:, :size] = np.frombuffer(raw["tokens"], np.uint8).reshape(-1, size)
    own = np.repeat(np.frombuffer(raw["owners"], np.int64), np.frombuffer(raw["runs"], np.uint32))
    return token.view("<u8").ravel(), own, np.frombuffer(raw["levels"], np.uint8)


def _in_order(token: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token, owner) by both, without repeats."""
    order = np.lexsort((own, token))
    token, own = token[order], own[order]
    new = np.append(True, (token[1:] != token[:-1]) | (own[1:] != own[:-1])) if len(token) else np.zeros(0, bool)
    return token[new], own[new]


def _bucket_of(token: np.ndarray, parts: int) -> np.ndarray:
    return (((token >> np.uint64(48)) * np.uint64(parts)) >> np.uint64(16)).astype(np.int64)


def _named(token: np.ndarray, bucket: np.ndarray | int) -> np.ndarray:
    """Bucket and 48 bits."""
    return (token & np.uint64((1 << 48) - 1)) | (np.asarray(bucket).astype(np.uint64) << np.uint64(48))


def _postings_kernel(k: int, parts: int, class_parts: int, longest: np.ndarray):
    """Shingles of the classes of a batch: in the buckets of their lists, or, if those aren't dealt, after those in the
    buckets of their classes."""

    longest = np.sort(longest)

    def dealt(flat: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        known = np.zeros(len(flat), bool)
        if len(longest):
            known = longest[np.minimum(np.searchsorted(longest, flat), len(longest) - 1)] == flat
        bucket = _bucket_of(flat, parts)
        rows = _packed(bucket[~known], flat[~known], own[~known], 6)
        level = np.full(int(known.sum()), LONGEST)
        return _table(rows + _packed(parts + own[known] % class_parts, _named(flat[known], bucket[known]), own[known], 8, level))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, names = _named_sets(batch, k)
            seen: set = set()
            held: list[int] = []
            size = 0
            for i, name in enumerate(names):  # whole classes, about DEALT shingles at a time
                if name[0] is not None and name not in seen:
                    seen.add(name)
                    held.append(i)
                    size += len(sets[i])
                if held and (size >= DEALT or i == len(names) - 1):
                    own = np.repeat(np.array([names[j][0] for j in held], np.uint64), [len(sets[j]) for j in held])
                    yield dealt(np.concatenate([sets[j] for j in held]), own.view(np.int64))
                    held, size = [], 0
            del sets
            trimmed()

    return run


def _lengths_kernel(parts: int, class_parts: int):
    """The lists of a bucket: of those with several classes each class gets shingle and level. What isn't a
    list goes on."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket >= parts:
            return table.set_column(0, "bucket", pa.array(np.full(table.num_rows, bucket - parts), pa.int32()))
        out = []
        token, own, _ = _unpacked(table, 6)
        some = token & np.uint64(7)
        for i in range(8):  # what is sorted at once stays small
            t, o = _in_order(token[some == i], own[some == i])
            if not len(t):
                continue
            new = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            number = np.diff(np.append(new, len(t)))
            length = np.repeat(number, number)
            keep = length > 1
            level = np.minimum(LONGEST - 1, np.floor(8 * np.log2(length[keep])))
            out += _packed(o[keep] % class_parts, _named(t[keep], bucket), o[keep], 8, level)
        return pa.Table.from_batches([_table(out)])

    return run


LISTS = "c1 long, rep long, n long, short binary, tokens binary"


def _lists_kernel(num: int, den: int):
    """Of each class that can link its lists, short ones first, and again those that are merged."""

    def run(lists: pa.Table, classes: pa.Table) -> pa.Table:
        token, own, level = _unpacked(lists, 8)
        order = np.lexsort((token, level, own))
        token, own = token[order], own[order]
        new = np.append(True, (token[1:] != token[:-1]) | (own[1:] != own[:-1])) if len(own) else np.zeros(0, bool)
        token, own = token[new], own[new]  # a long list may come from several batches
        start = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
        shared = np.diff(np.append(start, len(own)))
        name, rep, n = (classes.column(c).to_numpy() for c in ("c1", "rep", "n"))
        by = np.argsort(name)
        at = by[np.searchsorted(name[by], own[start])] if len(start) else start
        merged = shared - -(-n[at] * num // den) + 1
        alive = np.flatnonzero(merged > 0)
        columns = [name[at[alive]], rep[at[alive]], n[at[alive]]]
        short = [token[a : a + m].tobytes() for a, m in zip(start[alive].tolist(), merged[alive].tolist(), strict=True)]
        whole = [token[a : a + m].tobytes() for a, m in zip(start[alive].tolist(), shared[alive].tolist(), strict=True)]
        return pa.table([*[pa.array(c, pa.int64()) for c in columns], pa.array(short, pa.binary()), pa.array(whole, pa.binary())], names=[x.split()[0] for x in LISTS.split(", ")])

    return run


def _merge_kernel(parts: int):
    """Short lists dealt by shingle. Of a list only the first class in a batch is dealt; the others go with it as a list of
    their own that only the two have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("short").to_pylist()
            flat = mix(np.frombuffer(b"".join(raw), np.uint64))
            own = np.repeat(batch.column("c1").to_numpy(), [len(x) // 8 for x in raw])
            _, first, inverse = np.unique(flat, return_index=True, return_inverse=True)
            holder = own[first[inverse]]
            keep = np.arange(len(flat)) == first[inverse]
            pairs = np.unique(np.stack([own, holder], 1)[holder != own], axis=0)
            tie = mix(pairs[:, 0].astype(np.uint64) * np.uint64(3) + mix(pairs[:, 1].astype(np.uint64)))
            flat = np.concatenate([flat[keep], tie, tie])
            own = np.concatenate([own[keep], pairs[:, 0], pairs[:, 1]])
            yield _table(_packed(_bucket_of(flat, parts), flat, own, 8))

    return run


def _meetings(table: pa.Table) -> pa.Table:
    """Edges between each class of a bucket's lists and the least one of the same list."""
    token, own = _in_order(*_unpacked(table, 8)[:2])
    pairs = np.zeros((0, 2), np.int64)
    if len(token):
        new = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        least = np.repeat(np.minimum.reduceat(own, new), np.diff(np.append(new, len(own))))
        pairs = np.unique(np.stack([own, least], 1)[own != least], axis=0)
    return pa.table({"u": pa.array(pairs[:, 0], pa.int64()), "v": pa.array(pairs[:, 1], pa.int64())})


def t_occurrence(sets: list[np.ndarray], sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Component label (an index) of each of the sets, linked at num / den, by DivideSkip. sizes are those of the whole
    sets, of which elements that no other set has may be left out here."""
    m = len(sets)
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    label = np.arange(m)
    held = np.array([len(sets[i]) for i in order])
    tokens, codes = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    bounds = np.concatenate([[0], np.cumsum(held)])
    owner = np.repeat(np.arange(m), held)
    by_token = np.lexsort((owner, codes))
    posted = owner[by_token]
    start = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(tokens)))])
    length = np.diff(start)
    key = codes[by_token].astype(np.int64) * m + posted
    for i in range(m - 1):
        q = int(sizes[i])
        top = int(np.searchsorted(sizes, q * den // num, "right"))
        if top <= i + 1 or not held[i] or not (label[i + 1 : top] != label[i]).any():
            continue
        need = -(-2 * num * q // (num + den))
        mine = codes[bounds[i] : bounds[i + 1]]
        mine = mine[np.argsort(-length[mine], kind="stable")]
        longest = int(length[mine[0]])
        long = min(need - 1, int(need / (MU * max(1.0, np.log2(longest)) + 1)))
        short = mine[long:]
        short = short[length[short] > 1]
        if not len(short):
            continue
        # The lists are sorted runs, which this sort merges.
        merged = np.sort(np.concatenate([posted[start[t] : start[t + 1]] for t in short]), kind="stable")
        first = np.flatnonzero(np.append(True, merged[1:] != merged[:-1]))
        found, counts = merged[first], np.diff(np.append(first, len(merged)))
        good = (found > i) & (found < top) & (counts >= need - long)
        found, counts = found[good], counts[good]
        good = label[found] != label[i]
        found, counts = found[good], counts[good]
        by = np.argsort(-counts, kind="stable")
        found, counts = found[by], counts[by]
        far, step = mine[:long].astype(np.int64), 1
        while len(found):
            now, have, found, counts = found[:step], counts[:step], found[step:], counts[step:]
            step = min(step * 4, 256)
            probe = (far[:, None] * m + now[None, :]).ravel()
            at = np.searchsorted(key, probe)
            hits = (key[np.minimum(at, len(key) - 1)] == probe).reshape(len(far), len(now)).sum(0)
            both = have + hits
            for j in now[den * both >= num * (q + sizes[now] - both)]:
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
            good = label[found] != label[i]
            found, counts = found[good], counts[good]
    out = np.empty(m, np.int64)
    out[order] = order[label]
    return out


LINKS = "rep long, root long, whole boolean"


def _search_kernel(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()]
        rep, n, block = (table.column(c).to_numpy() for c in ("rep", "n", "block"))
        whole = table.column("parts").to_numpy() == 1
        rows = np.lexsort((rep, block))
        out: list[tuple[int, int, bool]] = []
        for group in np.split(rows, np.flatnonzero(np.diff(block[rows])) + 1) if len(rows) else []:
            if len(group) < 2:
                continue
            label = t_occurrence([sets[i] for i in group], n[group], num, den)
            ids = rep[group]
            by = np.argsort(label, kind="stable")
            for members in np.split(ids[by], np.flatnonzero(np.diff(label[by])) + 1):
                least = int(members.min())
                out += [(int(x), least, bool(whole[group[0]])) for x in members if x != least]
        columns = list(zip(*out, strict=True)) if out else [[]] * 3
        return pa.table({"rep": pa.array(columns[0], pa.int64()), "root": pa.array(columns[1], pa.int64()), "whole": pa.array(columns[2], pa.bool_())})

    return run


def jaccard_components(docs: DataFrame, k: int, num: int, den: int, block_shingles: int = BLOCK_SHINGLES, list_bytes: int = LIST_BYTES) -> DataFrame:
    """docs (doc_id long, text string, ...) -> (doc_id, n_shingles, component_id), a row for each row.

    Null text counts as empty. A document without words has n_shingles 0 and is linked with nothing.
    Rows with a null doc_id are sized, take no part in links and have a null component. Rows that
    repeat a doc_id each keep their own set. Other columns are not looked at."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = int(texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"])
    parts, class_parts = max(12, total // list_bytes), max(12, total // CLASS_BYTES)
    found = written(texts.mapInArrow(_sets_kernel(k, parts), THIN), "sets")
    thin = found.where("n >= 0")
    classes = thin.where("doc_id is not null and c1 is not null").groupBy("c1").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.min("c2").alias("low"), F.max("c2").alias("high"))
    classes = written(classes, "classes")
    state = classes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.count(F.when(F.col("low") != F.col("high"), 1)).alias("bad")).first()
    if state["bad"]:
        raise ValueError(f"{state['bad']} pairs of sets share a 64-bit hash")
    often = found.where("n = -1").groupBy("c1").agg(F.sum("c2").alias("lists")).where(F.col("lists") * F.lit(8 * parts) >= F.lit(state["all"]))
    longest = np.array([x["c1"] for x in often.select("c1").collect()], np.int64).view(np.uint64)  # at most 8 * parts
    postings = texts.where("doc_id is not null and text is not null").select("text").mapInArrow(_postings_kernel(k, parts, class_parts, longest), PACK)
    lengths = postings.groupBy("bucket").applyInArrow(thrifty(_lengths_kernel(parts, class_parts)), PACK)
    named = classes.select("c1", "rep", "n").groupBy(F.pmod("c1", F.lit(class_parts)).cast("int").alias("bucket"))
    run = thrifty(_lists_kernel(num, den))
    lists = written(lengths.groupBy("bucket").cogroup(named).applyInArrow(lambda x, y: run(x, y), LISTS), "lists")
    del postings, lengths
    released(spark)
    merged = lists.select("c1", "short").mapInArrow(_merge_kernel(parts), PACK)
    blocks = components(merged.groupBy("bucket").applyInArrow(thrifty(_meetings), "u long, v long"), "blocks")
    del merged
    released(spark)
    members = lists.select("c1", "rep", F.length("tokens").alias("size")).join(blocks, F.col("c1") == F.col("node")).select("c1", "size", F.col("component").alias("block"))
    members = written(members.withColumn("size", F.floor(F.col("size") / 8)), "members")
    totals = members.groupBy("block").agg(F.sum("size").alias("all"))
    totals = totals.select("block", F.greatest(F.lit(1), F.ceil(F.col("all") / F.lit(block_shingles))).cast("int").alias("parts"))
    tasks = max(48, int(members.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] // block_shingles) * 2)
    dealt = members.join(totals, "block")
    own = F.pmod(F.xxhash64("c1"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = dealt.select("*", own.alias("own")).select("*", other.alias("other"))
    dealt = dealt.withColumn("one", F.least("own", "other")).withColumn("two", F.greatest("own", "other"))
    bucket = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("block"), F.lit(tasks))).otherwise(F.lit(tasks) + F.pmod(F.xxhash64("block", "one", "two"), F.lit(1 << 40)))
    # A part pair of a large block is a block of its own.
    apart = F.when(F.col("parts") == 1, F.col("block")).otherwise(F.xxhash64("block", "one", "two"))
    dealt = dealt.select("c1", "parts", apart.alias("block"), bucket.alias("bucket"))
    # A merge join at every size: the members grow with the documents, so they are not to be broadcast.
    searched = lists.select("c1", "rep", "n", "tokens").join(dealt.hint("merge"), "c1").groupBy("bucket").applyInArrow(thrifty(_search_kernel(num, den)), LINKS)
    links = written(searched, "links")
    scratch = [found, classes, lists, blocks, members, links]
    if links.where("not whole").limit(1).count():
        many = components(links.select(F.col("rep").alias("u"), F.col("root").alias("v")), "joined")
        scratch.append(many)
        roots = many.select(F.col("node").alias("rep"), F.col("component").alias("root"))
    else:
        roots = links.select("rep", "root")
    roots = roots.groupBy("rep").agg(F.min("root").alias("root"))
    named = classes.join(roots, "rep", "left").select("c1", F.coalesce("root", "rep").alias("component"))
    held = thin.where("c1 is not null").join(named, "c1", "left").select("doc_id", "n", "component")
    out = held.unionByName(thin.where("c1 is null").select("doc_id", "n", F.lit(None).cast("long").alias("component")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return settled(out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")), "joined", *scratch)


def one_of_each(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """docs, all columns, with one document of each component: the one with the smallest doc_id. Rows that
    repeat both doc_id and text are one document. Rows with a null doc_id are in no group and stay."""
    found = jaccard_components(docs.select("doc_id", "text"), k, num, den)
    first = found.where("doc_id = component_id").select(F.col("doc_id").alias("__kept_id")).distinct()
    kept = docs.where("doc_id is not null").join(first, F.col("doc_id").cast("long") == F.col("__kept_id"), "left_semi")
    same = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id")
    once = kept.withColumn("__times", F.row_number().over(same)).where("__times = 1").drop("__times")
    return once.unionByName(docs.where("doc_id is null"))
