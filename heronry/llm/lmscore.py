"""Operator 9: language-model scores by stupid backoff over count tables partitioned by hash.

A word's score is log10 of the longest of these that has been seen elsewhere in the corpus, with ALPHA for each
order given up: c(u v w) / c(u v .), c(v w) / c(v .), c(w) / N. c(h .) counts h before another word. Counts
are those of all documents less `own` (one, the occurrence that is scored; it is in the corpus too, so that
without this nothing would ever be unseen); c(w) / N has all. The first word of a document has c(w) / N, the
second begins with c(v w) / c(v .). A document's score is the sum over its words.

Words have 64-bit hashes, which are checked against their letters in the table of words. N-grams of all
documents are exploded into buckets, and each bucket makes its part of the count tables and joins it with
the n-grams there; sums by document follow.

  The n-gram (t a b) is dealt by a. So its bucket has all of (t a b), (t a), (a b) and a.
  A word a that fills more than a quarter of a bucket is spread: its n-grams are dealt by (a b). Their
  bucket lacks c(t a .); for that the n-gram (s t a) before, whose bucket has it, carries b too.
  A pair (a b) of spread words that fills more than a quarter of a bucket has its counts sent to all tasks, and
  its n-grams are dealt by (t a b). An n-gram (t a b) that does is scored where it stands.
  The words for which no n-gram is seen elsewhere meet the table of words, dealt by the word.

Lists sent to all tasks: the CODED most frequent words, and fewer pairs and n-grams than four times the buckets.
N-grams travel in packed columns, a row per bucket and CHUNK_WORDS words: two bytes (three over 16 thousand
buckets) for a frequent word, five more for another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import released, settled, written
from .textkernel import mix, passes, prefix_hashes, range_hashes, text_buffers, thrifty, trimmed, word_spans

ALPHA, ORDER, OWN = 0.4, 3, 1
#: Bytes of text for each bucket of n-grams, and behind each place where sums of documents meet.
PARTITION_BYTES, PLACE_BYTES = 14 << 20, 48 << 20
#: A word that isn't frequent has the leading BITS of its hash as code. Words that would share a code, and those
#: whose code is one of the last SPARE, have a spare code each.
BITS, SPARE = 40, 1 << 20
#: Words that are counted, and n-grams that are packed, at once.
CHUNK_WORDS = 3 << 18
NOBODY = np.iinfo(np.int64).min
EMPTY = np.zeros(0, np.int64)
NUMBERS = ("prev", "first", "second", "next")


def small(x: np.ndarray, size: int) -> bytes:
    return np.ascontiguousarray(x).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def unsmall(raw: bytes | memoryview, size: int) -> np.ndarray:
    out = np.zeros((len(raw) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8).reshape(-1, size)
    return out.view("<i8").ravel()


def word_rows(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, check, row) of each word of each pass over a column of texts; the check is made of length and letters."""
    data, offsets = text_buffers(texts)
    for a, b in passes(offsets):
        low, begin, end, doc = word_spans(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) if offsets[b] > offsets[a] else (None, EMPTY, EMPTY, EMPTY)
        if len(begin):
            letters = [low[x].astype(np.int64) for x in (begin, end - 1, (begin + end) // 2)]
            check = ((end - begin) & 127) << 24 | letters[0] << 16 | letters[1] << 8 | letters[2]
            yield range_hashes(prefix_hashes(low), begin, end).view(np.int64), check, doc + a


def word_hashes_of(text: str) -> np.ndarray:
    return np.concatenate([x[0] for x in word_rows(pa.array([text]))] or [EMPTY])


def found_in(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each x is in the sorted table, its place there)."""
    if not len(table):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return table[at] == x, at


def joined(*parts: np.ndarray) -> np.ndarray:
    """A 63-bit name of a run of words or numbers; the order counts."""
    acc = np.full(len(parts[0]), len(parts), np.uint64)
    for x in parts:
        acc = mix(acc * np.uint64(0xD6E8FEB86659FD93) + x.astype(np.uint64))
    return (acc >> np.uint64(1)).astype(np.int64)


@dataclass
class Known:
    """What all tasks know. A word's number: 1 on for the frequent ones, by how often they occur, else limit + its code;
    0 is no word."""

    total: int
    width: int  # bytes of a frequent word's number
    hashes: np.ndarray  # of the frequent words, sorted, with their numbers
    numbers: np.ndarray
    cnt: np.ndarray  # by number
    heads: np.ndarray
    spread: np.ndarray  # whether the word is dealt by pairs
    special: np.ndarray  # sorted hashes of the words with spare codes
    pairs: np.ndarray  # names of frequent pairs of spread words, sorted; how often they occur, and before another word
    pair_cnt: np.ndarray
    pair_heads: np.ndarray
    triples: np.ndarray
    triple_cnt: np.ndarray

    @property
    def limit(self) -> int:
        return 1 << 8 * self.width

    def number(self, words: np.ndarray) -> np.ndarray:
        code = (words.view(np.uint64) >> np.uint64(64 - BITS)).astype(np.int64)
        own, at = found_in(self.special, words)
        code = np.where(own, (1 << BITS) - SPARE + at, code) + self.limit
        own, at = found_in(self.hashes, words)
        return np.where(own, self.numbers[at], code) if len(self.hashes) else code

    def is_spread(self, x: np.ndarray) -> np.ndarray:
        return self.spread[np.where(x < self.limit, x, 0)]

    def packed(self, x: np.ndarray) -> bytes:
        """Frequent words by their numbers; others as the largest number here, with their codes at the end."""
        rare = x >= self.limit
        return small(np.where(rare, self.limit - 1, x), self.width) + small(x[rare] - self.limit, 5)

    def unpacked(self, raw: memoryview, n: int) -> np.ndarray:
        x = unsmall(raw[: n * self.width], self.width)
        x[x == self.limit - 1] = unsmall(raw[n * self.width :], 5) + self.limit
        return x


def counts(chunk: int, least: float):
    """(kind, name, cnt, heads, check): words with all their counts (kind 1), and n-grams of 2 and 3 words, by their
    words' hashes, that are over the share `least` of a chunk."""

    def summed(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        word, check = (np.concatenate([x[i] for x in found]) for i in (0, 1))
        heads = np.concatenate([np.append(x[2][1:] == x[2][:-1], False) for x in found])  # passes end with a text
        names, first, inverse, n = np.unique(word, return_index=True, return_inverse=True, return_counts=True)
        out = [(np.ones(len(names), np.int64), names, n, np.bincount(inverse, heads, len(names)).astype(np.int64), check[first])]
        if (check != check[first][inverse]).any():
            raise ValueError("two words share a 64-bit hash")
        for size in (2, 3):
            at = np.flatnonzero(heads[:-1] if size == 2 else heads[:-2] & heads[1:-1])
            bits = 20
            name = joined(*[word[at + i] for i in range(size)])
            slot = name & ((1 << bits) - 1)
            name = np.sort(name[np.bincount(slot, minlength=1 << bits)[slot] >= max(8, least * len(word))])
            name, n = np.unique(name, return_counts=True)
            keep = n >= max(8, least * len(word))
            out.append((np.full(int(keep.sum()), size), name[keep], n[keep], n[keep] * 0, n[keep] * 0))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)], names=["kind", "name", "cnt", "heads", "check"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for rows in word_rows(batch.column("text")):
                found.append(rows)
                if sum(len(x[0]) for x in found) > chunk:
                    yield thrifty(summed)(found)
                    found = []
        if found:
            yield summed(found)

    return run


def exact_counts(names: dict[int, np.ndarray]):
    """(kind, name, cnt, heads) of the wanted n-grams: all their counts, and those before another word. With the
    hashes of their first words, by which their pairs are found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros((len(x), 2), np.int64) for k, x in names.items()}
        words = {k: np.zeros((len(x), 3), np.int64) for k, x in names.items()}
        for batch in batches:
            for word, _, row in word_rows(batch.column("text")):
                for size, table in names.items():
                    at = np.flatnonzero(row[size - 1 :] == row[: len(row) - size + 1]) if len(row) >= size else EMPTY
                    own, place = found_in(table, joined(*[word[at + i] for i in range(size)]))
                    at, place = at[own], place[own]
                    follows = np.append(row, -1)[at + size] == row[at]
                    sums[size] += np.stack([np.bincount(place, minlength=len(table)), np.bincount(place, follows, len(table)).astype(np.int64)], 1)
                    for i in range(size):
                        words[size][place, i] = word[at + i]
        for size, table in names.items():
            seen = np.flatnonzero(sums[size][:, 0])
            columns = [np.full(len(seen), size), table[seen], *sums[size][seen].T, *words[size][seen].T]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["kind", "name", "cnt", "heads", "a", "b", "c"])

    return run


PACK = "bucket int, words binary, place int, sums binary"
LONGEST = (1 << 16) - 1


def blob(*parts: np.ndarray | bytes) -> bytes:
    """Columns of bytes behind one another, compressed."""
    raw = [x if isinstance(x, bytes) else x.tobytes() for x in parts]
    return zstandard.compress(np.cumsum([len(x) for x in raw]).astype("<i8").tobytes() + b"".join(raw), 2)


def unblob(packed: pa.Buffer | bytes, columns: int) -> list[memoryview]:
    raw = memoryview(zstandard.decompress(packed))
    ends = np.frombuffer(raw[: 8 * columns], "<i8") + 8 * columns
    return [raw[a:b] for a, b in zip(np.append(8 * columns, ends), ends, strict=False)]


def runs_of(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents as runs of equal ones; a run over LONGEST is several."""
    new = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    n = np.diff(np.append(new, len(doc)))
    pieces = -(-n // LONGEST)
    runs = np.full(int(pieces.sum()), LONGEST)
    runs[np.cumsum(pieces) - 1] = n - (pieces - 1) * LONGEST
    return np.repeat(doc[new], pieces), runs.astype(np.uint16)


def documents(docs: memoryview, runs: memoryview) -> np.ndarray:
    return np.repeat(np.frombuffer(docs, np.int64), np.frombuffer(runs, np.uint16))


def by_bucket(bucket: np.ndarray) -> list[np.ndarray]:
    """Rows of each bucket, in their order."""
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []


def packs(known: Known, bucket: np.ndarray, doc: np.ndarray, columns: list[np.ndarray]) -> list[tuple]:
    """A packed row for each bucket: documents, runs, words; the last of four columns only where the third is a spread word."""
    out = []
    for part in by_bucket(bucket):
        raw = [known.packed(x[part]) for x in columns[:3]]
        if len(columns) == 4:
            raw.append(known.packed(columns[3][part][known.is_spread(columns[2][part])]))
        out.append((int(bucket[part[0]]), blob(*runs_of(doc[part]), *raw), None, None))
    return out


def unpack(known: Known, words: pa.Buffer | bytes, columns: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(columns of words, documents)."""
    parts = unblob(words, columns + 2)
    doc = documents(*parts[:2])
    out = [known.unpacked(x, len(doc)) for x in parts[2:5]]
    if columns == 4:
        some = np.flatnonzero(known.is_spread(out[2]))
        out.append(np.zeros(len(doc), np.int64))
        out[3][some] = known.unpacked(parts[5], len(some))
    return out, doc


def table_of(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    names = [x.split()[0] for x in PACK.split(", ")]
    return pa.table({n: pa.array(c, pa.int32() if n in ("bucket", "place") else pa.binary()) for n, c in zip(names, columns, strict=True)})


def times(x: np.ndarray) -> np.ndarray:
    """How often each element occurs."""
    order = np.argsort(x)
    s = x[order]
    new = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else EMPTY
    number = np.diff(np.append(new, len(s)))
    out = np.empty(len(x), np.int64)
    out[order] = np.repeat(number, number)
    return out


def per_document(doc: np.ndarray, value: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, sums, word counts)."""
    ids, inverse = np.unique(doc, return_inverse=True)
    return ids, np.bincount(inverse, value, len(ids)), np.bincount(inverse, n, len(ids)).astype(np.int64)


def sums_by_place(doc: np.ndarray, value: np.ndarray, n: np.ndarray, places: int) -> list[tuple]:
    """Sums by document, packed by place: steps between ids, sums, word counts."""
    real = doc != NOBODY
    ids, sums, n = per_document(doc[real], value[real], n[real])
    place = (mix(ids.view(np.uint64) + np.uint64(7)) % np.uint64(places)).astype(np.int64)
    return [(None, None, int(place[p[0]]), blob(np.diff(ids[p], prepend=0), sums[p], n[p].astype(np.uint32))) for p in by_bucket(place)]


def _totals(table: pa.Table) -> pa.Table:
    """(doc, value, n) of the documents of a place."""
    parts = [unblob(x.as_buffer(), 3) for x in table.column("sums")]
    ids = np.concatenate([np.cumsum(np.frombuffer(x[0], np.int64)) for x in parts])
    value, n = np.concatenate([np.frombuffer(x[1], np.float64) for x in parts]), np.concatenate([np.frombuffer(x[2], np.uint32) for x in parts])
    ids, value, n = per_document(ids, value, n)
    return pa.table({"doc": pa.array(ids, pa.int64()), "value": pa.array(value), "n": pa.array(n)})


class Scorer:
    """The kernels: exploding, scoring in a bucket, and the words that are left."""

    def __init__(self, known, parts: int, places: int, alpha: float, order: int, own: int):
        self.sent, self.parts, self.places, self.back, self.order, self.own = known, parts, places, float(np.log10(alpha)), order, own

    def bucket_of(self, x: np.ndarray) -> np.ndarray:
        return (mix(x.astype(np.uint64)) % np.uint64(self.parts)).astype(np.int64)

    def log(self, x: np.ndarray) -> np.ndarray:
        return np.log10(x - self.own)

    def pair_heads(self, known: Known, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What a frequent pair (a b) before a seen n-gram takes off; other pairs nothing here."""
        own, at = found_in(known.pairs, joined(a, b))
        out = np.zeros(len(a))
        out[own] = self.log(known.pair_heads[at[own]])
        return out

    def exploded(self, known: Known, w: np.ndarray, row: np.ndarray, doc: np.ndarray) -> list[tuple]:
        """Packed rows of a run of whole texts: n-grams by bucket, words that are left, and sums of what is scored here."""
        head = np.append(True, row[1:] != row[:-1])
        begin, pair = np.flatnonzero(head), np.flatnonzero(~head) - 1
        frequent = w[begin] < known.limit
        scores = [(doc[begin[frequent]], np.log10(known.cnt[w[begin[frequent]]] / known.total))]
        rest = begin[~frequent]
        a, b, d = w[pair], w[pair + 1], doc[pair]
        t = np.where(head[pair], 0, w[pair - 1]) if self.order > 2 else np.zeros_like(a)
        after = np.minimum(pair + 2, len(w) - 1)
        x = np.where((pair + 2 < len(w)) & ~head[after], w[after], 0) if self.order > 2 else np.zeros_like(a)
        common = np.zeros(len(a), bool)
        some = np.flatnonzero(known.is_spread(a) & known.is_spread(b)) if len(known.pairs) else EMPTY
        own, at = found_in(known.pairs, joined(a[some], b[some]))
        some, at = some[own], at[own]
        common[some] = True
        triple, where = found_in(known.triples, joined(t[some], a[some], b[some]))
        triple &= t[some] > 0
        here = some[triple]
        scores.append((d[here], self.log(known.triple_cnt[where[triple]]) - self.pair_heads(known, t[here], a[here])))
        second = t[some] == 0
        scores.append((d[some[second]], self.log(known.pair_cnt[at[second]]) - self.log(known.heads[a[some[second]]])))
        deal = some[~triple & ~second]
        out = packs(known, self.parts + self.bucket_of(joined(t[deal], a[deal], b[deal])), d[deal], [y[deal] for y in (t, a, b)])
        deal = np.flatnonzero(~common)
        bucket = self.bucket_of(np.where(known.is_spread(a[deal]), joined(a[deal], b[deal]), a[deal]))
        out += packs(known, bucket, d[deal], [y[deal] for y in (t, a, b, x)])
        out += self.left(known, w[rest], doc[rest])
        doc, value = (np.concatenate(y) for y in zip(*scores, strict=True))
        return out + sums_by_place(doc, value, np.ones(len(doc), np.int64), self.places)

    def left(self, known: Known, w: np.ndarray, doc: np.ndarray) -> list[tuple]:
        """Words that wait for their counts, packed by bucket."""
        keep = np.flatnonzero(doc != NOBODY)
        keep = keep[np.argsort(doc[keep], kind="stable")]  # long runs of each document
        w, doc = w[keep], doc[keep]
        bucket = 2 * self.parts + self.bucket_of(w)
        return [(int(bucket[p[0]]), blob(*runs_of(doc[p]), small(w[p] - known.limit, 5)), None, None) for p in by_bucket(bucket)]

    def explode(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, at = self.sent.value, [], 0

        def packed() -> pa.RecordBatch:
            w, row, doc = (np.concatenate(x) for x in zip(*held, strict=True))
            return table_of(self.exploded(known, w, row, doc)).combine_chunks().to_batches()

        for batch in batches:
            # Texts without doc_id are counted under no id.
            names = np.array(batch.column("doc_id").fill_null(NOBODY))
            for words, _, row in word_rows(batch.column("text")):
                held.append((known.number(words), row + at, names[row]))
                if sum(len(x[0]) for x in held) >= CHUNK_WORDS:
                    yield from packed()
                    held = []
            at += batch.num_rows
            trimmed()
        if held:
            yield from packed()

    def score(self, table: pa.Table) -> pa.Table:
        """Scores of the n-grams of a bucket; words that are left go on. A bucket is scored in parts by what it is dealt by."""
        known, bucket = self.sent.value, table.column("bucket")[0].as_py()
        columns = 4 if bucket < self.parts else 3
        size = sum(int(np.frombuffer(unblob(w.as_buffer(), columns + 2)[1], np.uint16).sum()) for w in table.column("words"))
        x, at = [np.empty(size, np.int64) for _ in range(columns + 1)], 0
        for words in table.column("words"):
            found, doc = unpack(known, words.as_buffer(), columns)
            for column, values in zip(x, [*found, doc], strict=True):
                column[at : at + len(doc)] = values
            at += len(doc)
        key = x[2] * 31 + x[1] if columns == 3 else np.where(known.is_spread(x[1]), x[2] * 31 + x[1], x[1])
        part = (mix(key.astype(np.uint64)) >> np.uint64(61)).astype(np.uint8)
        del key
        scores, left = [], []
        for i in range(8):
            mine = np.flatnonzero(part == i)
            doc = x[-1][mine]
            if columns == 3:
                value = self.of_frequent_pairs(known, *(c[mine] for c in x[:3]))
                scores.append(per_document(doc, value, np.ones(len(doc), np.int64)))
            else:
                b = x[2][mine]
                value, waits = self.of_pairs(known, x[0][mine], x[1][mine], b, x[3][mine])
                n = np.ones(len(doc), np.int64)
                n[waits] = 0
                scores.append(per_document(doc, value, n))
                left.append((b[waits], doc[waits]))
        out = sums_by_place(*(np.concatenate(c) for c in zip(*scores, strict=True)), self.places)
        return table_of(out + self.left(known, *(np.concatenate(c) for c in zip(*left, strict=True))) if left else out)

    def of_frequent_pairs(self, known: Known, t: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Scores of n-grams (t a b) of frequent pairs (a b); all of each are here."""
        seen = times(joined(t, a, b))
        at = found_in(known.pairs, joined(a, b))[1]
        value = self.back + self.log(known.pair_cnt[at]) - self.log(known.heads[a])
        good = np.flatnonzero(seen > self.own)
        value[good] = self.log(seen[good]) - self.pair_heads(known, t[good], a[good])
        return value

    def of_pairs(self, known: Known, t: np.ndarray, a: np.ndarray, b: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores of n-grams (t a b), rows whose word waits for its count); all of each a, or of each (a b), are here."""
        spread = known.is_spread(a)
        pair = joined(a, b)
        value = np.where(t > 0, self.back, 0.0)  # of giving up the longest order
        both = times(pair)
        one = np.where(spread, known.heads[np.where(spread, a, 0)], 0)
        tight = np.flatnonzero(~spread)
        one[tight] = times(a[tight])
        longer = np.flatnonzero(t > 0)
        seen = times(joined(t[longer], pair[longer]))
        third = np.zeros(len(a), bool)
        third[longer] = seen > self.own
        value[longer[seen > self.own]] = self.log(seen[seen > self.own])
        # c(t a .): here if a isn't spread; else in the bucket of (t a), or with the frequent pairs.
        inside = np.flatnonzero((t > 0) & ~spread)
        before = times(joined(t[inside], a[inside]))
        mine = third[inside]
        value[inside[mine]] -= self.log(before[mine])
        outside = np.flatnonzero(third & spread)
        value[outside] -= self.pair_heads(known, t[outside], a[outside])
        second = ~third & (both > self.own)
        value[second] += self.log(both[second]) - self.log(one[second])
        last = ~third & ~second
        frequent = last & (b < known.limit)
        value[last] += self.back
        value[frequent] += np.log10(known.cnt[b[frequent]] / known.total)
        # And c(a b .) for the n-gram (a b x) if b is spread.
        goes = np.flatnonzero(known.is_spread(b) & (after > 0))
        follows, triple = times(pair[goes]), times(joined(a[goes], b[goes], after[goes]))
        value[goes[triple > self.own]] -= self.log(follows[triple > self.own])
        return value, np.flatnonzero(last & ~frequent)

    def pack_words(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The table of words without the frequent ones, packed in the buckets of the words that are left."""
        known = self.sent.value
        for batch in batches:
            w, c = known.number(batch.column("name").to_numpy()), batch.column("cnt").to_numpy()
            w, c = w[w >= known.limit], c[w >= known.limit]
            bucket = self.bucket_of(w)
            rows = [(int(bucket[p[0]]), small(w[p] - known.limit, 5), c[p].tobytes()) for p in by_bucket(bucket)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], names=["bucket", "w", "cnt"])

    def unigrams(self, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return table_of([])
        word = unsmall(b"".join(right.column("w").to_pylist()), 5)
        cnt = np.frombuffer(b"".join(right.column("cnt").to_pylist()), np.int64)
        order = np.argsort(word)
        word, cnt = word[order], cnt[order]
        parts = [unblob(x.as_buffer(), 3) for x in left.column("words")]
        doc = np.concatenate([documents(*x[:2]) for x in parts])
        value = np.log10(cnt[np.searchsorted(word, np.concatenate([unsmall(x[2], 5) for x in parts]))] / self.sent.value.total)
        return table_of(sums_by_place(doc, value, np.ones(len(doc), np.int64), self.places))


def without_own_code(words: DataFrame) -> np.ndarray:
    """Sorted hashes of the words that need a spare code, of all words; at 40 million words about 1600."""
    code = F.shiftrightunsigned("name", 64 - BITS)
    shared = [x["code"] for x in words.groupBy(code.alias("code")).agg(F.count("*").alias("n")).where("n > 1").select("code").collect()]
    found = words.where(code.isin(shared) | (code >= (1 << BITS) - SPARE)).select("name").collect()
    if len(found) > SPARE:
        raise ValueError(f"{len(found)} words need one of {SPARE} spare codes")
    return np.sort(np.array([x["name"] for x in found], np.int64))


def known_of(rows: DataFrame, parts: int, coded: int | None = None, chunk: int = CHUNK_WORDS) -> tuple[Known, DataFrame]:
    """What all tasks are to know, and the table of words (kind 1: name, cnt)."""
    spark = rows.sparkSession
    texts = rows.select("text")
    fill = 4 * parts  # a word, pair or n-gram over 1 / fill of all words fills a quarter of a bucket
    counted = texts.mapInArrow(counts(max(chunk, 64 * parts), 0.5 / fill), "kind long, name long, cnt long, heads long, check long")
    sums = [F.sum("cnt").alias("cnt"), F.sum("heads").alias("heads"), (F.min("check") != F.max("check")).alias("bad")]
    names = written(counted.groupBy("kind", "name").agg(*sums), "words")
    released(spark)
    words = names.where("kind = 1")
    state = words.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("n"), F.count_if("bad").alias("bad")).first()
    if state["bad"]:
        raise ValueError(f"{state['bad']} pairs of words share a 64-bit hash")
    total = int(state["n"])
    special = without_own_code(words)
    width = 2 if fill < 1 << 16 else 3
    coded = min(coded if coded is not None else 1 << 30, (1 << 8 * width) - 2)
    top = words.where(F.col("cnt") * F.lit(1 << 8 * width) > F.lit(total)).orderBy(F.col("cnt").desc(), "name").limit(coded).select("name", "cnt", "heads").toArrow()
    hashes, cnt, heads = (np.append(0, top.column(i).to_numpy()).astype(np.int64) for i in range(3))
    order = np.argsort(hashes[1:])
    spread = cnt * fill > total
    known = Known(total, width, hashes[1:][order], order + 1, cnt, heads, spread, special, EMPTY, EMPTY, EMPTY, EMPTY, EMPTY)
    likely = names.where((F.col("kind") > 1) & (F.col("cnt") * F.lit(2 * fill) >= F.lit(total))).select("kind", "name").collect()  # fewer than 2 * fill of a kind
    if likely and spread.any():
        wanted = {k: np.sort(np.array([x["name"] for x in likely if x["kind"] == k], np.int64)) for k in (2, 3)}
        shape = "kind long, name long, cnt long, heads long, a long, b long, c long"
        exact = texts.mapInArrow(exact_counts(wanted), shape).groupBy("kind", "name").agg(F.sum("cnt").alias("cnt"), F.sum("heads").alias("heads"), *[F.max(F.struct("cnt", "a", "b", "c")).alias("x")])
        got = [(x["kind"], known.number(np.array(x["x"][1 : 1 + x["kind"]], np.int64)), x["cnt"], x["heads"]) for x in exact.collect() if x["cnt"] * fill > total]
        two = sorted((int(joined(*w[:, None])[0]), n, h) for k, w, n, h in got if k == 2 and known.is_spread(w).all())
        known.pairs, known.pair_cnt, known.pair_heads = (np.array([x[i] for x in two], np.int64) for i in range(3))
        inside = lambda w: found_in(known.pairs, joined(w[:-1], w[1:]))[0].all()
        three = sorted((int(joined(*w[:, None])[0]), n) for k, w, n, _ in got if k == 3 and inside(w))
        known.triples, known.triple_cnt = (np.array([x[i] for x in three], np.int64) for i in range(2))
    return known, names


def scored(docs: DataFrame, alpha: float = ALPHA, order: int = ORDER, own: int = OWN, partition_bytes: int = PARTITION_BYTES, coded: int | None = None) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, n_words, log_score, mean_score), a row per doc_id; order is 2 or 3. A
    document without words has 0 words, score 0 and a null mean. Rows that repeat a doc_id are scored as one
    document with that many texts; rows without one count in the corpus under no id and aren't returned."""
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = int(rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"])
    parts, places = max(12, size // partition_bytes), max(12, size // PLACE_BYTES)
    known, names = known_of(rows, parts, coded)
    released(spark)
    scorer = Scorer(spark.sparkContext.broadcast(known), parts, places, alpha, order, own)
    exploded = rows.mapInArrow(scorer.explode, PACK)
    # Sums of what was scored where it stood, and words left there, go past the buckets of n-grams.
    dealt = exploded.withColumn("way", F.when(F.col("bucket") < 2 * parts, F.col("bucket")).otherwise(F.lit(-1) - F.coalesce(F.col("place"), F.col("bucket"))))
    half = written(dealt.groupBy("way").applyInArrow(thrifty(lambda table: _scored_or_passed(scorer, table)), PACK), "ngrams")
    del exploded, dealt
    released(spark)
    rest = half.where("bucket is not null").select((F.col("bucket") - 2 * parts).alias("bucket"), "words")
    counted = names.where("kind = 1").select("name", "cnt").mapInArrow(scorer.pack_words, "bucket int, w binary, cnt binary")
    backed = rest.groupBy("bucket").cogroup(counted.groupBy("bucket")).applyInArrow(thrifty(lambda left, right: scorer.unigrams(left, right)), PACK)
    packed = half.where("place is not null").select("place", "sums").unionByName(backed.select("place", "sums"))
    sums = packed.groupBy("place").applyInArrow(_totals, "doc long, value double, n long")
    every = rows.where("doc_id is not null").select("doc_id").distinct()
    out = every.join(sums, F.col("doc_id") == F.col("doc"), "left")
    n, value = F.coalesce("n", F.lit(0)).cast("long"), F.coalesce("value", F.lit(0.0))
    out = out.select("doc_id", n.alias("n_words"), F.round(value, 6).alias("log_score"), F.when(n > 0, F.round(value / n, 6)).alias("mean_score"))
    return settled(out, "scores", names, half)


def _scored_or_passed(scorer: Scorer, table: pa.Table) -> pa.Table:
    way = table.column("way")[0].as_py()
    table = table.drop_columns(["way"])
    return scorer.score(table) if way >= 0 else table
