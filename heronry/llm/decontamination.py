"""Operator 6: benchmark decontamination by the q-gram lemma.

A text holds a benchmark item if some stretch of it is within e edits of the item; e is EDIT_RATE of the
item's characters. Then the two share at least len - q + 1 - q * e q-grams, at diagonals (place in the text less place in the
item) that differ by at most 2 * e. So q-grams are looked up in an index of the items, hits are counted in
overlapping bands of diagonals, and bands that reach the bound are verified by banded alignment, all bands
of a pass at once; items that begin alike share the rows of the alignment up to where they part. q is Q; for
items so short that Q grams would leave the lemma no bound, it is SHORT_Q, which leaves one. Items of fewer than
Q characters have no edits and are looked for as they are.

Texts and items are compared by characters, with A-Z as a-z and each run of white space as one blank; items
are stripped. The items are taken in blocks of bounded size; each block is sent to all tasks, and the texts
are read once per block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import FOLD, mix, passes, slices, text_buffers, trimmed

Q, SHORT_Q = 7, 5
EDIT_RATE = 0.1
#: Hits with their items that are held at once, and cells of an alignment.
HITS_AT_ONCE, CELLS = 1_000_000, 2_000_000
#: Bytes of items in a block that is sent to the tasks.
BLOCK_BYTES = 4 << 20
FILTER_BITS, TABLE_BITS = 22, 20
#: Bytes of text that are searched at once.
SEARCH_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets): folded case, each run of white space as one blank."""
    low = FOLD[data]
    blank = low == 32
    keep = np.ones(len(low), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    low = low[keep]
    kept = np.concatenate([[0], np.cumsum(keep)])[offsets]
    chars = np.concatenate([[0], np.cumsum((low & 0xC0) != 0x80)])[kept]
    return np.frombuffer(low.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32), chars


def grams(chars: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of the q characters from each place on."""
    n = len(chars) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    wide, acc = chars.astype(np.uint64), np.zeros(n, np.uint64)
    for j in range(q):
        acc = acc * _BASE + wide[j : j + n]
    return mix(acc)


def budget(size: int) -> int:
    """Edits that an item of so many characters may have."""
    return int(size * EDIT_RATE)


def bounded(size: int, q: int) -> bool:
    """Whether an item shares a q-gram with every stretch within its budget."""
    return size - q + 1 - q * budget(size) >= 1


class Part:
    """q-grams of items of q characters or more, for lookups by hash. Items are in the order of their characters."""

    def __init__(self, ids: np.ndarray, chars: list[np.ndarray], q: int = Q):
        self.ids, self.chars, self.q = ids, chars, q
        self.size = np.array([len(x) for x in chars], np.int64)
        self.edits = np.array([budget(n) for n in self.size.tolist()], np.int64)
        self.bound = self.size - q + 1 - q * self.edits
        flat = np.concatenate([grams(x, q) for x in chars])
        item = np.repeat(np.arange(len(chars)), self.size - q + 1)
        place = np.concatenate([np.arange(n - q + 1) for n in self.size])
        order = np.argsort(flat, kind="stable")
        self.gram, first = np.unique(flat[order], return_index=True)
        self.item, self.place = item[order], place[order]
        # Postings by gram and item, so that those of a gram and a range of items are one run.
        self.first = np.append(first, len(flat))
        self.key = np.repeat(np.arange(len(self.gram)), np.diff(self.first)) * len(chars) + self.item
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.gram >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        self.reach = int((self.size + self.edits).max())

    def search(self, chars: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item, start, end, edits) of stretches of at most `edits` edits."""
        h = grams(chars, self.q)
        at = np.flatnonzero(self.filter[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        own = h[at]
        spot = np.minimum(np.searchsorted(self.gram, own), len(self.gram) - 1)
        true = self.gram[spot] == own
        return self.bands(chars, bounds, at[true], spot[true], 0, len(self.chars))

    def bands(self, chars: np.ndarray, bounds: np.ndarray, at: np.ndarray, spot: np.ndarray, low: int, high: int) -> list[tuple[int, int, int, int, int]]:
        """Verified stretches among the hits of items [low, high). Too many hits to hold are taken by items,
        then by overlapping stretches of the text."""
        if high - low == len(self.chars):
            first, many = self.first[spot], self.first[spot + 1] - self.first[spot]
        else:
            first = np.searchsorted(self.key, spot * len(self.chars) + low)
            many = np.searchsorted(self.key, spot * len(self.chars) + high) - first
        total = int(many.sum())
        if not total:
            return []
        if total > HITS_AT_ONCE:
            mid, half = (low + high) // 2, int(at[0] + at[-1]) // 2
            if high - low > 1:
                return self.bands(chars, bounds, at, spot, low, mid) + self.bands(chars, bounds, at, spot, mid, high)
            if at[-1] - at[0] > 8 * self.reach:
                a, b = np.searchsorted(at, (half + 2 * self.reach, half - 2 * self.reach))
                return self.bands(chars, bounds, at[:a], spot[:a], low, high) + self.bands(chars, bounds, at[b:], spot[b:], low, high)
        own = np.repeat(np.arange(len(at)), many)
        posting = np.repeat(first, many) + (np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many))
        item, place = self.item[posting], self.place[posting]
        # Diagonals of one stretch span at most 2 * edits; bands of twice that overlap by half. First a count of
        # the hits of each half in a table that halves may share: what can't reach the bound there goes.
        shift = int(self.size.max())
        line = at[own] - place + shift
        cell = line // (2 * self.edits[item] + 1) * len(self.chars) + item
        number = np.bincount(slot(cell), minlength=1 << TABLE_BITS)
        beside = np.maximum(number[slot(cell + len(self.chars))], number[slot(cell - len(self.chars))])
        keep = np.flatnonzero(number[slot(cell)] + beside >= self.bound[item])
        own, item, place, line = own[keep], item[keep], place[keep], line[keep]
        doc = np.searchsorted(bounds, at[own], "right") - 1
        keep = np.flatnonzero(at[own] + self.q <= bounds[doc + 1])
        item, place, line, doc = item[keep], place[keep], line[keep], doc[keep]
        if not len(doc):
            return []
        # Whole items have a hit at each of their places, all on one diagonal.
        heads, number = counted(doc, item, line)
        full = number == self.size[heads[:, 1]] - self.q + 1
        out = [(d, i, x - shift, x - shift + int(self.size[i]), 0) for d, i, x in heads[full].tolist() if np.array_equal(chars[x - shift : x - shift + self.size[i]], self.chars[i])]
        # Places of the item in each half of a band; halves come in order, so the next one of a document and item is beside.
        heads = counted(doc, item, line // (2 * self.edits[item] + 1), place)[0][:, :3]
        heads, number = counted(*heads.T)
        after = np.append((heads[1:] == heads[:-1] + (0, 0, 1)).all(1), False)
        both = number + np.where(after, np.append(number[1:], 0), 0)
        alone = np.append(True, (heads[1:] != heads[:-1] + (0, 0, 1)).any(1))  # its first half is empty
        heads = np.concatenate([heads[both >= self.bound[heads[:, 1]]], heads[alone & (number >= self.bound[heads[:, 1]])] - (0, 0, 1)])
        heads = np.unique(heads[self.edits[heads[:, 1]] > 0], axis=0)
        half = 2 * self.edits[heads[:, 1]] + 1
        lowest = heads[:, 2] * half - shift
        if out and len(heads):  # a band with the whole item in it needs no alignment
            d, i, s = (np.array(x) for x in list(zip(*out, strict=True))[:3])
            half_of = 2 * self.edits[i] + 1
            known = {(x, y, z - k) for x, y, z, in zip(d.tolist(), i.tolist(), ((s + shift) // half_of).tolist(), strict=True) for k in (0, 1)}
            todo = np.array([tuple(x) not in known for x in heads.tolist()], bool)
            heads, half, lowest = heads[todo], half[todo], lowest[todo]
        for e in np.unique(self.edits[heads[:, 1]]).tolist():
            mine = np.flatnonzero(self.edits[heads[:, 1]] == e)
            # In runs of bounded size: cells of a row of the table, and characters of items that are compared.
            step = max(1, CELLS // max(6 * e + 2, int(self.size[heads[mine, 1]].max())))
            mine = mine[np.lexsort((heads[mine, 1], lowest[mine], heads[mine, 0]))]
            for a in range(0, len(mine), step):
                m = mine[a : a + step]
                d, i = heads[m, 0], heads[m, 1]
                start, end, cost = align(self.chars, i, chars, lowest[m], lowest[m] + 2 * half[m], bounds[d], bounds[d + 1], e)
                good = np.flatnonzero(cost <= e)
                out += zip(d[good].tolist(), i[good].tolist(), start[good].tolist(), end[good].tolist(), cost[good].tolist(), strict=True)
        return out


class Index:
    """A block of items: those of fewer than Q characters by their length, the others by their q-grams."""

    def __init__(self, items: list[tuple[int, str]]):
        found = []
        for item, text in items:
            raw = np.frombuffer((text or "").strip().encode(), np.uint8)
            chars, _ = folded(raw, np.array([0, len(raw)]))
            if len(chars):
                found.append((chars.tolist(), item, chars))
        found.sort(key=lambda x: x[:2])
        long = [x for x in found if len(x[0]) >= Q]
        by_q = {Q: [x for x in long if bounded(len(x[0]), Q)], SHORT_Q: [x for x in long if not bounded(len(x[0]), Q)]}
        self.parts = [Part(np.array([x[1] for x in own], np.int64), [x[2] for x in own], q) for q, own in by_q.items() if own]
        self.short: dict[int, dict[int, list[tuple[int, np.ndarray]]]] = {}
        for x in found:
            if len(x[0]) < Q:
                self.short.setdefault(len(x[0]), {}).setdefault(int(grams(x[2], len(x[0]))[0]), []).append((x[1], x[2]))

    def search(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item id, start, end, edits): of each item the stretches that hold it, of overlapping ones
        the one with the fewest edits."""
        chars, bounds = folded(data, offsets)
        out: dict[tuple[int, int], set] = {}
        for part in self.parts:
            for d, i, s, e, k in part.search(chars, bounds) if len(chars) >= part.q else ():
                out.setdefault((d, int(part.ids[i])), set()).add((s - int(bounds[d]), e - int(bounds[d]), k))
        for size, items in self.short.items():
            h = grams(chars, size)
            names = np.sort(np.array(list(items), np.uint64))
            spot = np.minimum(np.searchsorted(names, h), len(names) - 1)
            at = np.flatnonzero(names[spot] == h)
            doc = np.searchsorted(bounds, at, "right") - 1
            for s, d in zip(at[at + size <= bounds[doc + 1]].tolist(), doc[at + size <= bounds[doc + 1]].tolist(), strict=True):
                for item, x in items[int(h[s])]:
                    if np.array_equal(chars[s : s + size], x):
                        out.setdefault((d, item), set()).add((s - int(bounds[d]), s - int(bounds[d]) + size, 0))
        return [(d, i, *x) for (d, i), found in out.items() for x in disjoint(found)]


def slot(cell: np.ndarray) -> np.ndarray:
    """Place of a cell in a table of 2 ** TABLE_BITS."""
    return ((cell.astype(np.uint64) * _BASE) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def counted(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of columns of small numbers, in order, with how often each is there."""
    sizes = [int(x.max()) + 1 for x in columns]
    if float(np.prod(np.array(sizes, float))) >= 2.0**62:
        return np.unique(np.stack(columns, 1), axis=0, return_counts=True)
    key = columns[0]  # one number per row sorts much faster
    for x, n in zip(columns[1:], sizes[1:], strict=True):
        key = key * n + x
    key, number = np.unique(key, return_counts=True)
    out = np.empty((len(key), len(columns)), np.int64)
    for c in range(len(columns) - 1, 0, -1):
        key, out[:, c] = np.divmod(key, sizes[c])
    out[:, 0] = key
    return out, number


def disjoint(found: set) -> list[tuple[int, int, int]]:
    """Of overlapping stretches the one with the fewest edits; found holds (start, end, edits)."""
    out: list[tuple[int, int, int]] = []
    for k in sorted({x[2] for x in found}):
        taken = sorted(out)
        ends, at = -1, 0
        for s, e, _ in sorted(x for x in found if x[2] == k):
            while at < len(taken) and taken[at][1] <= s:
                at += 1
            if s >= ends and (at == len(taken) or taken[at][0] >= e):
                out.append((s, e, k))
                ends = e
    return sorted(out)


def align(items: list[np.ndarray], own: np.ndarray, text: np.ndarray, low: np.ndarray, high: np.ndarray, begin: np.ndarray, end: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, edits) of the best stretch of text[begin:end] within `most` edits of each of the items `own`, its
    diagonals within most of [low, high); edits over most where there is none. All bands are of one width.

    Row r of a band's table has, for each diagonal, the fewest edits with which the first r characters of
    the item end there; starts are free. Bands that follow one another with the same place and with items
    that begin alike have the same rows up to where the items part: those are made once."""
    n, width, big = len(own), int(high[0] - low[0]) + 2 * most, 1 << 20
    size = np.array([len(items[i]) for i in own], np.int64)
    letters = np.full((n, int(size.max())), -1, np.int64)
    for row, i in enumerate(own.tolist()):
        letters[row, : size[row]] = items[i]
    parted = np.zeros(n, np.int64)  # characters that a band's item shares with that of the band before
    differ = letters[1:] != letters[:-1]
    shared = np.where(differ.any(1), differ.argmax(1), letters.shape[1])
    parted[1:] = np.where((low[1:] == low[:-1]) & (begin[1:] == begin[:-1]), np.minimum(shared, np.minimum(size[1:], size[:-1])), 0)
    left = low - most
    steps = np.arange(width)
    result = [np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, big)]
    row = np.flatnonzero(parted == 0)  # the bands whose rows are made; each stands for those up to the next
    column = left[row][:, None] + steps
    cost = np.where((column >= begin[row][:, None]) & (column <= end[row][:, None]), 0, big)
    start = column.copy()
    dead = np.zeros(n, bool)
    for r in range(1, letters.shape[1] + 1):
        now = np.flatnonzero((parted < r) & ~dead & (size >= r))
        if not len(now):
            break
        parent = np.searchsorted(row, now, "right") - 1
        cost, start, row = cost[parent], start[parent], now
        j = left[now][:, None] + steps + r  # place in the text after this row
        lo, hi = begin[now][:, None], end[now][:, None]
        ok = (j > lo) & (j <= hi)
        same = text[np.clip(j - 1, 0, len(text) - 1)] == letters[now, r - 1][:, None]
        best = np.where(ok, cost + ~same, big)
        up = np.full_like(cost, big)
        up[:, :-1] = cost[:, 1:] + 1
        up_start = np.zeros_like(start)
        up_start[:, :-1] = start[:, 1:]
        origin = np.where(up < best, up_start, start)
        best = np.minimum(best, up)
        # A run of characters that the item lacks: least of cost - place, from the left.
        run = np.minimum.accumulate((best - steps) * (width + 1) + (width - steps), axis=1)
        source = width - (run % (width + 1))
        value = np.take_along_axis(best, source, 1) + steps - source
        origin = np.where(value < best, np.take_along_axis(origin, source, 1), origin)
        best = np.minimum(best, value)
        cost = np.minimum(np.where((j >= lo) & (j <= hi), best, big), big)
        start = origin
        done = np.flatnonzero(size == r)
        done = done[~dead[done]]
        if len(done):
            mine = np.searchsorted(row, done, "right") - 1
            place = np.argmin(cost[mine] * (width + 1) + steps, axis=1)
            result[0][done], result[2][done] = start[mine, place], cost[mine, place]
            result[1][done] = left[done] + place + r
        # A band is over once every diagonal has too many edits, and with it those whose rows it stands for.
        over = cost.min(1) > most
        if over.any():
            owner = np.searchsorted(row, np.arange(n), "right") - 1
            follows = (owner >= 0) & (parted >= r) | np.isin(np.arange(n), row)
            dead |= follows & over[np.maximum(owner, 0)]
    return result[0], result[1], result[2]


HITS = "doc_id long, item_id long, begin long, finish long, edits int"


def indexes(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list:
    """Broadcast indexes of the items, each of about block_bytes at most; one for most benchmarks."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("b")).first()["b"]
    blocks = max(1, -(-int(total) // block_bytes))
    out = []
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        out.append(docs.sparkSession.sparkContext.broadcast(Index(sorted((x["item_id"], x["text"]) for x in own.collect()))))
    return out


def searched(batch: pa.RecordBatch, index: Index) -> list[tuple[int, int, int, int, int]]:
    """Index.search over the texts of a batch; documents are its rows."""
    data, offsets = text_buffers(batch.column("text"))
    found = []
    for a, b in passes(offsets, SEARCH_BYTES):
        found += [(x[0] + a, *x[1:]) for x in index.search(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])]
    return found


def matches(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> (doc_id, item_id, begin, finish, edits): every
    stretch (character places after folding) that holds an item."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def of(index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (x for whole in batches for x in slices(whole)):
                found = searched(batch, index.value)
                columns = list(zip(*found, strict=True)) if found else [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(arrays[0]), *arrays[1:]], names=["doc_id", "item_id", "begin", "finish", "edits"])

        return rows.mapInArrow(run, HITS)

    return reduce(DataFrame.unionByName, [of(x) for x in indexes(docs, benchmark, block_bytes)])


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_ids, n_matches, least_edits), a row for each document that holds an item. Null and empty
    texts and items match nothing; rows that repeat a doc_id count together, rows without one don't count."""
    found = matches(docs, benchmark, block_bytes).where("doc_id is not null")
    return found.groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.count("*").alias("n_matches"), F.min("edits").alias("least_edits"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows whose text holds an item; all columns stay, and nothing is shuffled."""
    for index in indexes(docs, benchmark, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole):
                    clean = np.ones(batch.num_rows, bool)
                    clean[[x[0] for x in searched(batch, index.value)]] = False
                    yield batch.filter(pa.array(clean))
                trimmed()

        docs = docs.mapInArrow(run, docs.schema)
    return docs
