"""Operator 8: removal of repeated passages by hash-compared suffix sorting.

A byte goes if it is covered by a SPAN-byte string that also starts in a document with a smaller doc_id.

1. Anchors. In each window of SPAN bytes the GRAM-byte string with the least hash is its anchor, so equal
   windows have equal anchors at equal offsets. The windows of an anchor are a run; its bytes are the
   anchor's context. Anchors are dealt by their hash: contexts that an earlier document has too (by prefix
   polynomial hashes) go entire; anchors that other documents have in other contexts are in doubt.
2. Suffix sort. The contexts in doubt are fetched from the texts and dealt by anchor. Suffixes that start
   at the same offset from the same anchor are sorted by mergesort; two suffixes are compared by their
   longest common extension, found by binary search over prefix polynomial hashes. Neighbours that agree
   in SPAN bytes are verified byte by byte, and each such class keeps its smallest doc_id.
3. The contexts of step 1 are verified too. Those that follow one another in a text and in its earlier text are
   one run. Inside a batch the bytes of both are compared; else a run's 128-bit BLAKE2 digest is sent to the earlier
   text, which must give the same for its own bytes. A difference is a collision of hashes, and an error.
4. The spans of all steps meet the texts once more, by document.

A context that an earlier text of the same batch has isn't dealt by its anchor. An anchor with many contexts
in doubt is dealt by the hash of each window, and of a window only the first document of a place of texts is
dealt. So a partition has a frequent window at most once per place, and a frequent context once per batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import settled, written
from .textkernel import mix, passes, powers, prefix_hashes, range_hashes, text_buffers, thrifty, trimmed

SPAN, GRAM = 50, 16
WINDOW = SPAN - GRAM + 1
#: Bytes of text behind each partition of anchors, and of each partition of documents.
PARTITION_BYTES, DOC_BYTES = 18 << 20, 12 << 20
#: Contexts in doubt from which an anchor is dealt by windows.
FREQUENT = 1_000
#: Bytes of text whose contexts are compared before any is dealt.
FIND_BYTES = 8 << 20
PLACE = np.uint64(28)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each run of windows with one anchor: (document, anchor hash, context hash, first window's start
    in the document, number of windows less 1, anchor's offset from the first window)."""
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    n = len(data)
    if n < SPAN:
        return none
    if n >> int(PLACE):
        raise ValueError(f"a text of {n} bytes: places have {PLACE} bits")
    prefix = prefix_hashes(data)
    start = np.arange(n - GRAM + 1)
    gram = range_hashes(prefix, start, start + GRAM)
    # A window's anchor is the leftmost of the least grams: the hash above, the place below.
    key = ((gram >> PLACE) << PLACE) | start.astype(np.uint64)
    least, width = key, 1
    while width * 2 <= WINDOW:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < WINDOW:
        least = np.minimum(least[: len(least) - (WINDOW - width)], least[WINDOW - width :])
    place = (least & np.uint64((1 << int(PLACE)) - 1)).astype(np.int64)  # by window start
    doc = np.searchsorted(offsets, np.arange(len(place)), "right") - 1
    real = np.arange(len(place)) + SPAN <= offsets[doc + 1]
    at = np.flatnonzero(real)
    if not len(at):
        return none
    new = np.flatnonzero(np.append(True, (place[at][1:] != place[at][:-1]) | (at[1:] != at[:-1] + 1) | (doc[at][1:] != doc[at][:-1])))
    first, last = at[new], at[np.append(new[1:], len(at)) - 1]
    spot = place[first]
    context = mix(range_hashes(prefix, first, last + SPAN) + (spot - first).astype(np.uint64))
    return doc[first], gram[spot].view(np.int64), context.view(np.int64), first - offsets[doc[first]], last - first, spot - first


def small(x: np.ndarray, size: int) -> bytes:
    return np.ascontiguousarray(x).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def unsmall(raw: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(raw) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8).reshape(-1, size)
    return out.view("<i8").ravel()


#: Packed columns and the bytes of a number in each.
FIELDS = {"a": 6, "c": 6, "start": 4, "more": 4, "shift": 1, "src": 8, "src_name": 4, "src_start": 4}
#: What a packed row has: windows that go; contexts in doubt; windows that go and their earlier text; digests for an earlier text.
GOES, DOUBT, CLAIMED, DIGEST = range(4)
COLUMNS = ("docs", "names", "runs", *FIELDS, "data")
PACK = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("packed", pa.binary())])
PACK_SQL = "bucket int, kind int, packed binary"


def packs(kind: int, bucket: np.ndarray, doc: np.ndarray, name: np.ndarray, fields: dict[str, np.ndarray], data: list[bytes] | None = None) -> list[dict]:
    """A packed row per bucket, compressed; documents (id and text hash) as runs of equal ones."""
    out = []
    order = np.argsort(bucket, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
        d, t = doc[part], name[part]
        new = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (t[1:] != t[:-1])))
        raw = [d[new].tobytes(), small(t[new], 4), small(np.diff(np.append(new, len(d))), 4)]
        raw += [small(fields[k][part], size) if k in fields else b"" for k, size in FIELDS.items()]
        raw.append(b"".join(data[i] for i in part) if data is not None else b"")
        ends = np.cumsum([len(x) for x in raw]).astype("<i8").tobytes()
        out.append({"bucket": int(bucket[part[0]]), "kind": kind, "packed": zstandard.compress(ends + b"".join(raw), 1)})
    return out


def unpack(packed: pa.ChunkedArray) -> dict[str, np.ndarray]:
    """The columns of packed rows of one kind; a field that they don't have is empty."""
    found: dict[str, list] = {k: [] for k in COLUMNS}
    for x in packed:
        raw = memoryview(zstandard.decompress(x.as_buffer()))
        ends = np.frombuffer(raw[: 8 * len(COLUMNS)], "<i8") + 8 * len(COLUMNS)
        for k, i, j in zip(COLUMNS, [8 * len(COLUMNS), *ends[:-1].tolist()], ends.tolist(), strict=True):
            found[k].append(raw[i:j])
    raw = {k: b"".join(v) for k, v in found.items()}
    runs = unsmall(raw["runs"], 4)
    out = {"doc": np.repeat(np.frombuffer(raw["docs"], np.int64), runs), "name": np.repeat(unsmall(raw["names"], 4), runs)}
    return out | {k: unsmall(raw[k], size) for k, size in FIELDS.items()} | {"data": np.frombuffer(raw["data"], np.uint8)}


def of_kind(table: pa.Table, *kinds: int) -> pa.ChunkedArray:
    return table.filter(np.isin(table.column("kind").to_numpy(), kinds)).column("packed") if table.num_rows else pa.chunked_array([], pa.binary())


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, number of the group of each row in that order) of rows by keys, the last one first."""
    order = np.lexsort(keys)
    change = np.zeros(len(order), bool)
    for k in keys:
        change[1:] |= k[order][1:] != k[order][:-1]
    return order, np.cumsum(change)


def least_of(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The smallest value of each row's group; groups are numbered in order."""
    heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    return np.minimum.reduceat(value, heads)[group - group[0]] if len(group) else value


def sort_suffixes(prefix: np.ndarray, data: np.ndarray, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mergesort of the suffixes data[at : at + SPAN] within groups (numbers in ascending order) -> (order,
    common extension of each with the one before it). All merges of a level are done at once: each suffix finds its place in the
    run beside its own by binary search."""
    down = powers(len(prefix))[1]

    def common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros(len(x), np.int64), np.full(len(x), SPAN)
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = (prefix[x + mid] - prefix[x]) * down[x] == (prefix[y + mid] - prefix[y]) * down[y]
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def before(x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether x sorts before y; equal ones as ties says."""
        length = common(x, y)
        whole = length >= SPAN
        end = np.minimum(length, SPAN - 1)
        return np.where(whole, ties, data[x + end] < data[y + end])

    n = len(at)
    order = np.arange(n)
    begin = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, n))
    base = np.repeat(begin, size)
    limit = np.repeat(begin + size, size)
    index = np.arange(n) - base
    run = 1
    while n and run < size.max():
        rows = np.flatnonzero(limit - base > run)  # groups that still have runs to merge
        own = index[rows] // run
        other = (own ^ 1) * run + base[rows]
        left = own % 2 == 0
        there = other < limit[rows]
        lo, hi = np.minimum(other, limit[rows]), np.minimum(other + run, limit[rows])
        hi = np.where(there, hi, lo)
        first = lo.copy()
        me = at[order[rows]]
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            less = before(at[order[mid]], me[open_], ~left[open_])
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        pair = (own // 2) * 2 * run + base[rows]
        target = pair + (index[rows] - own * run) + (lo - first)
        moved = order[rows]
        order = order.copy()
        order[target] = moved
        run *= 2
    # Common extension of each with the one before it in its group.
    near = np.zeros(n, np.int64)
    if n > 1:
        near[1:] = np.where(group[:-1] == group[1:], common(at[order[:-1]], at[order[1:]]), 0)
    return order, near


def classes(data: np.ndarray, at: np.ndarray, order: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Class of each sorted suffix: neighbours that agree in SPAN bytes, verified byte by byte."""
    new = np.ones(len(order), bool)
    same = np.flatnonzero(near >= SPAN)
    for a in range(0, len(same), 1 << 15):
        part = same[a : a + (1 << 15)]
        x, y = at[order[part - 1]][:, None] + np.arange(SPAN), at[order[part]][:, None] + np.arange(SPAN)
        new[part[(data[x] == data[y]).all(1)]] = False
    return np.cumsum(new) - 1


def extensions(prefix: np.ndarray, data: np.ndarray, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Longest common extension, up to SPAN, of each suffix with any other of its group."""
    order, near = sort_suffixes(prefix, data, at, group)
    out = np.empty(len(at), np.int64)
    out[order] = np.maximum(near, np.append(near[1:], 0))
    return out


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals; those that touch are one."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > reach[:-1])
    return start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]


def gone_spans(doc: np.ndarray, name: np.ndarray, start: np.ndarray, bucket_of) -> list[dict]:
    """Packed runs of windows that go, by the bucket of their document."""
    order = np.lexsort((start, name, doc))
    doc, name, start = doc[order], name[order], start[order]
    if not len(doc):
        return []
    new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (name[1:] != name[:-1]) | (start[1:] > start[:-1] + 1)))
    end = start[np.append(new[1:], len(start)) - 1]
    return packs(GOES, bucket_of(doc[new]), doc[new], name[new], {"start": start[new], "more": end - start[new]})


def claimed_runs(doc: np.ndarray, name: np.ndarray, start: np.ndarray, more: np.ndarray, src: np.ndarray, src_name: np.ndarray, src_start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Contexts and the same ones in earlier texts -> (first context of each run, its length): runs go on as long as
    contexts touch in both texts."""
    shift = src_start - start
    order = np.lexsort((start, shift, src_name, src, name, doc))
    same = np.ones(max(0, len(order) - 1), bool)
    for x in (doc, name, src, src_name, shift):
        same &= x[order][1:] == x[order][:-1]
    end = (start + more + SPAN)[order]
    # Contexts of a text come in order of their ends as of their starts.
    new = np.flatnonzero(np.append(True, ~(same & (start[order][1:] <= end[:-1])))) if len(order) else np.zeros(0, np.int64)
    last = np.append(new[1:], len(order)) - 1
    return order[new], end[last] - start[order[new]] if len(order) else start


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def deduplicated(docs: DataFrame, partition_bytes: int = PARTITION_BYTES, doc_bytes: int = DOC_BYTES, frequent: int = FREQUENT) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, n_bytes, n_removed, n_spans, kept_sha256), a row for each row.

    A null text has no bytes; one of 2 ** PLACE bytes (256 MB) or more is an error. Rows without doc_id lose nothing and take nothing from others. Rows that repeat
    a doc_id lose nothing to each other; each loses what smaller ids have. Texts under SPAN bytes stay."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    total = int(rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"])
    parts, places = max(12, total // partition_bytes), max(48, total // doc_bytes)

    def named(batch) -> tuple:
        data, offsets = text_buffers(batch.column("text"))
        ids = batch.column("doc_id")
        null = np.array(ids.is_null())
        return data, offsets, np.array(ids.fill_null(0)), null

    def text_names(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """32 bits of each text's hash, to tell apart rows with one doc_id."""
        return (range_hashes(prefix_hashes(data), offsets[:-1], offsets[1:]) >> np.uint64(32)).astype(np.int64)

    def place_of(doc: np.ndarray) -> np.ndarray:
        return (mix(doc.view(np.uint64) + np.uint64(77)) % np.uint64(places)).astype(np.int64)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, ids, null = named(batch)
            for low_row, high_row in passes(offsets, FIND_BYTES):
                got = []
                for a, b in passes(offsets[low_row : high_row + 1]):
                    a, b = a + low_row, b + low_row
                    piece, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                    found = anchors(piece, off)
                    names = text_names(piece, off)
                    keep = ~null[found[0] + a]
                    got.append([ids[found[0][keep] + a], names[found[0][keep]], found[0][keep] + a, *[x[keep] for x in found[1:]]])
                doc, name, row, a, c, start, more, shift = (np.concatenate(x) for x in zip(*got, strict=True))
                order, _ = groups(doc, c, a)
                new = np.append(True, (a[order][1:] != a[order][:-1]) | (c[order][1:] != c[order][:-1]))[: len(order)]
                first = np.empty(len(doc), np.int64)  # the row of the first document with the context
                first[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
                known = doc > doc[first]  # an earlier document of these has the context
                mine, its = np.flatnonzero(known), first[known]
                run, length = claimed_runs(row[mine], mine * 0, start[mine], more[mine], row[its], its * 0, start[its])
                for x, y, n in zip((offsets[row[mine]] + start[mine])[run].tolist(), (offsets[row[its]] + start[its])[run].tolist(), length.tolist(), strict=True):
                    if not np.array_equal(data[x : x + n], data[y : y + n]):
                        raise RuntimeError("contexts with equal hashes differ")
                fields = {"a": a, "c": c, "start": start, "more": more, "shift": shift}
                bucket = (mix(a.view(np.uint64) & np.uint64((1 << 48) - 1)) % np.uint64(parts)).astype(np.int64)
                out = packs(DOUBT, bucket[~known], doc[~known], name[~known], {k: v[~known] for k, v in fields.items()})
                out += packs(GOES, parts + place_of(doc[known]), doc[known], name[known], {k: fields[k][known] for k in ("start", "more")})
                yield pa.RecordBatch.from_pylist(out, PACK)
            trimmed()

    def judge(table: pa.Table) -> pa.Table:
        """Packed rows by place of document: windows that go, and contexts in doubt."""
        bucket = table.column("bucket")[0].as_py()
        if bucket >= parts:
            place = pa.array([bucket - parts] * table.num_rows, pa.int32())
            return table.set_column(0, "bucket", place)
        x = unpack(table.column("packed"))
        del x["data"], x["src"], x["src_name"], x["src_start"]
        order, group = groups(x["doc"], x["c"], x["a"])
        x = {k: v[order] for k, v in x.items()}
        new = np.append(True, (x["a"][1:] != x["a"][:-1]) | (x["c"][1:] != x["c"][:-1]))[: len(order)]
        first = np.flatnonzero(new)[np.cumsum(new) - 1]  # a context's first document comes first
        gone = np.flatnonzero(x["doc"] > x["doc"][first])
        # Of each context the rows of its first document; of each anchor those with other contexts and documents.
        left = np.flatnonzero(x["doc"] == x["doc"][first])
        y = {k: v[left] for k, v in x.items()}
        anchor = np.cumsum(np.append(False, y["a"][1:] != y["a"][:-1])) if len(left) else np.zeros(0, np.int64)
        several = least_of(anchor, y["doc"]) != -least_of(anchor, -y["doc"]) if len(left) else np.zeros(0, bool)
        many = np.bincount(anchor)[anchor] > frequent if len(left) else several
        source = {"src": x["doc"][first[gone]], "src_name": x["name"][first[gone]], "src_start": x["start"][first[gone]]}
        out = packs(CLAIMED, place_of(x["doc"][gone]), x["doc"][gone], x["name"][gone], {k: x[k][gone] for k in ("start", "more")} | source)
        # c is 1 for anchors that are dealt by windows
        doubt = {k: y[k][several] for k in ("a", "start", "more", "shift")} | {"c": many[several].astype(np.int64)}
        out += packs(DOUBT, place_of(y["doc"][several]), y["doc"][several], y["name"][several], doubt)
        return pa.Table.from_pylist(out, PACK)

    def fetch(texts: pa.Table, spans: pa.Table) -> pa.Table:
        """Bytes of the contexts in doubt, dealt by anchor; digests of the runs that earlier texts have, for those."""
        doubt, claimed = of_kind(spans, DOUBT), of_kind(spans, CLAIMED)
        if not len(doubt) and not len(claimed):
            return pa.Table.from_pylist([], PACK)
        data, offsets, ids, null = named(texts)
        names = np.concatenate([text_names(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in passes(offsets)])
        where = places_of(ids, names, null)
        out: list[dict] = []
        if len(claimed):
            x = unpack(claimed)
            run, length = claimed_runs(x["doc"], x["name"], x["start"], x["more"], x["src"], x["src_name"], x["src_start"])
            y = {k: x[k][run] for k in ("doc", "name", "start", "src", "src_name", "src_start")}
            begin = offsets[[where[p] for p in zip(y["doc"].tolist(), y["name"].tolist(), strict=True)]] + y["start"]
            digests = [digest(data[i : i + n]) for i, n in zip(begin.tolist(), length.tolist(), strict=True)]
            out += packs(DIGEST, parts + place_of(y["src"]), y["src"], y["src_name"], {"start": y["src_start"], "more": length}, digests)
        if not len(doubt):
            return pa.Table.from_pylist(out, PACK)
        x = unpack(doubt)
        pair = [where[p] for p in zip(x["doc"].tolist(), x["name"].tolist(), strict=True)]
        begin = offsets[pair] + x["start"]
        wide = x["c"] == 1
        pieces = [data[b : b + m + SPAN].tobytes() for b, m in zip(begin.tolist(), x["more"].tolist(), strict=True)]
        bucket = (mix(x["a"].view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        tight = np.flatnonzero(~wide)
        fields = ("a", "start", "more", "shift")
        out += packs(DOUBT, bucket[tight], x["doc"][tight], x["name"][tight], {k: x[k][tight] for k in fields}, [pieces[i] for i in tight])
        if wide.any():
            index = np.flatnonzero(wide)
            times = x["more"][index] + 1
            row = np.repeat(index, times)
            step = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            windows = [pieces[i][s : s + SPAN] for i, s in zip(row.tolist(), step.tolist(), strict=True)]
            own = np.array([int.from_bytes(hashlib.blake2b(w, digest_size=6).digest(), "little") for w in windows], np.int64)
            # Of a window only the first document's places are dealt; what later documents here have of it goes at once.
            doc, start = x["doc"][row], x["start"][row] + step
            order = np.lexsort((doc, own))
            group = np.cumsum(np.append(False, own[order][1:] != own[order][:-1]))
            first = np.empty(len(own), np.int64)
            first[order] = order[np.flatnonzero(np.append(True, group[1:] != group[:-1]))[group]]
            later = np.array([d > doc[f] and windows[i] == windows[f] for i, (d, f) in enumerate(zip(doc.tolist(), first.tolist(), strict=True))], bool)
            out += gone_spans(doc[later], x["name"][row][later], start[later], lambda d: parts + place_of(d))
            sent = np.flatnonzero(~later)
            spread = (mix(own.view(np.uint64)) % np.uint64(parts)).astype(np.int64)[sent]
            none = np.zeros(len(sent), np.int64)
            out += packs(DOUBT, spread, doc[sent], x["name"][row][sent], {"a": own[sent], "start": start[sent], "more": none, "shift": none}, [windows[i] for i in sent])
        return pa.Table.from_pylist(out, PACK)

    def decide(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket >= parts:  # for a place, as it is
            return table.set_column(0, "bucket", pa.array([bucket - parts] * table.num_rows, pa.int32()))
        x = unpack(table.column("packed"))
        length = x["more"] + SPAN
        origin = np.cumsum(length) - length
        order = np.argsort(x["a"], kind="stable")
        out: list[dict] = []
        # Whole anchors at a time, about 2**14 contexts.
        anchor = np.cumsum(np.append(False, x["a"][order][1:] != x["a"][order][:-1]))
        heads = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        load = (heads >> 14)[anchor]
        for part in np.split(order, np.flatnonzero(np.diff(load)) + 1):
            size = length[part]
            local = np.cumsum(size) - size
            data = np.append(x["data"][np.repeat(origin[part] - local, size) + np.arange(int(size.sum()))], np.zeros(SPAN, np.uint8))
            key = x["a"][part]
            group = np.cumsum(np.append(False, key[1:] != key[:-1]))
            # How far any other context agrees to the right of the anchor, and to its left; only windows within both can agree.
            shift, middle = x["shift"][part], local + x["shift"][part]
            prefix = prefix_hashes(data)
            right = extensions(prefix, data, middle, group)
            back = data[::-1].copy()
            left = extensions(prefix_hashes(np.append(back, np.zeros(SPAN, np.uint8))), np.append(back, np.zeros(SPAN, np.uint8)), len(data) - middle, group)
            low = np.maximum(shift - left, 0)
            high = np.minimum(x["more"][part], shift + right - SPAN)
            times = np.maximum(high - low + 1, 0)
            row = np.repeat(np.arange(len(part)), times)
            step = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + low[row]
            if len(row) < 2:
                continue
            by, group = groups(step - shift[row], key[row])
            at, row, step = (local[row] + step)[by], row[by], step[by]
            sorted_, near = sort_suffixes(prefix, data, at, group)
            cls = classes(data, at, sorted_, near)
            doc = x["doc"][part][row[sorted_]]
            gone = np.flatnonzero(doc > least_of(cls, doc))
            which, start = row[sorted_[gone]], step[sorted_[gone]] + x["start"][part][row[sorted_[gone]]]
            out += gone_spans(x["doc"][part][which], x["name"][part][which], start, place_of)
        return pa.Table.from_pylist(out, PACK)

    def finish(texts: pa.Table, spans: pa.Table) -> pa.Table:
        """Verifies digests, removes the spans and sums up each text."""
        data, offsets, ids, null = named(texts)
        names = np.concatenate([text_names(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in passes(offsets)]) if texts.num_rows else np.zeros(0, np.int64)
        where = places_of(ids, names, null)
        x = unpack(of_kind(spans, DIGEST))
        begin = offsets[[where[p] for p in zip(x["doc"].tolist(), x["name"].tolist(), strict=True)]] + x["start"] if len(x["doc"]) else x["doc"]
        for i, (at, n) in enumerate(zip(begin.tolist(), x["more"].tolist(), strict=True)):
            if digest(data[at : at + n]) != x["data"][16 * i : 16 * i + 16].tobytes():
                raise RuntimeError("contexts with equal hashes differ")
        cut: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        x = [unpack(of_kind(spans, k)) for k in (GOES, CLAIMED)]
        x = {k: np.concatenate([y[k] for y in x]) for k in ("doc", "name", "start", "more")}
        if len(x["doc"]):
            order = np.lexsort((x["name"], x["doc"]))
            d, n = x["doc"][order], x["name"][order]
            for part in np.split(order, np.flatnonzero((d[1:] != d[:-1]) | (n[1:] != n[:-1])) + 1):
                cut[(int(x["doc"][part[0]]), int(x["name"][part[0]]))] = merged(x["start"][part], x["start"][part] + x["more"][part] + SPAN)
        removed, count, sha = [], [], []
        for i in range(len(ids)):
            raw = data[offsets[i] : offsets[i + 1]]
            start, end = cut.get((int(ids[i]), int(names[i])), (raw[:0], raw[:0])) if not null[i] else (raw[:0], raw[:0])
            removed.append(int((end.astype(np.int64) - start).sum()))
            count.append(len(start))
            kept, at = hashlib.sha256(), 0
            for s, e in zip(start.tolist(), end.tolist(), strict=True):
                kept.update(raw[at:s])
                at = e
            kept.update(raw[at:])
            sha.append(kept.hexdigest())
        size = np.diff(offsets)
        return pa.table(
            {
                "doc_id": texts.column("doc_id"),
                "n_bytes": pa.array(size, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "n_spans": pa.array(count, pa.int64()),
                "kept_sha256": pa.array(sha, pa.string()),
            }
        )

    stored = written(rows.mapInArrow(find, PACK_SQL).groupBy("bucket").applyInArrow(thrifty(judge), PACK_SQL), "spans")
    spans = stored.withColumnRenamed("bucket", "place")
    # The place of a document is computed in Python; this one only has to agree with itself.
    lookup = rows.mapInArrow(lambda batches: _placed(batches, place_of), "place int, doc_id long, text binary")
    texts = lookup.groupBy("place")
    asked = spans.where(F.col("kind").isin(DOUBT, CLAIMED))
    contexts = texts.cogroup(asked.groupBy("place")).applyInArrow(_both(thrifty(fetch)), PACK_SQL)
    more = contexts.groupBy("bucket").applyInArrow(thrifty(decide), PACK_SQL).withColumnRenamed("bucket", "place")
    known = spans.where(F.col("kind").isin(GOES, CLAIMED)).unionByName(more)
    return settled(texts.cogroup(known.groupBy("place")).applyInArrow(_both(thrifty(finish)), RESULT), "kept", stored)


def digest(data: np.ndarray) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def places_of(ids: np.ndarray, names: np.ndarray, null: np.ndarray) -> dict[tuple[int, int], int]:
    """First row of each text, by doc_id and text hash."""
    out: dict[tuple[int, int], int] = {}
    for i in np.flatnonzero(~null):
        out.setdefault((int(ids[i]), int(names[i])), int(i))
    return out


def _placed(batches: Iterator[pa.RecordBatch], place_of) -> Iterator[pa.RecordBatch]:
    count = 0
    for batch in batches:
        # Rows without doc_id are asked for nothing, so they are dealt by where they stand.
        ids, here = batch.column("doc_id"), np.arange(count, count + batch.num_rows)
        place = place_of(np.where(np.array(ids.is_null()), here, np.array(ids.fill_null(0))))
        count += batch.num_rows
        pack = zstandard.ZstdCompressor(level=1)
        texts = pa.array([pack.compress(x.encode()) for x in batch.column("text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), batch.column("doc_id"), texts], names=["place", "doc_id", "text"])


def opened(texts: pa.Table) -> pa.Table:
    """The table with its texts as they were; they travel compressed."""
    unpack_ = zstandard.ZstdDecompressor()
    raw = [unpack_.decompress(x) for x in texts.column("text").to_pylist()]
    ends = np.cumsum([0, *map(len, raw)])
    text = pa.Array.from_buffers(pa.large_string(), len(raw), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(b"".join(raw))])
    return texts.set_column(texts.schema.get_field_index("text"), "text", text)


def _both(f):
    """f with the packed table's first column named as in PACK."""

    def run(texts: pa.Table, spans: pa.Table) -> pa.Table:
        if spans.num_rows:
            spans = spans.rename_columns(["bucket" if c == "place" else c for c in spans.column_names])
        return f(opened(texts), spans)

    return run
