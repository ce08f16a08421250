"""Operator 13: byte-pair encoding and decoding with a public tokenizer's file.

A word's symbols are a doubly linked list (arrays of the symbol, of the one before and of the one behind). A heap
holds the rank and place of each neighbouring pair that can merge; the least is taken, skipped if its place no longer
holds a pair of that rank (a stale entry), else merged, and the pairs to its left and right are pushed. A word of n
symbols takes O(n log n). Decoding looks identifiers up in the vocabulary and concatenates.

Words come from the file's own normal form and pattern. Where every character of a text is one of Unicode 3.2 that
this module and the library's components treat alike (each character is compared once per worker), they are made
here; other texts' words come from the library's components. The library never merges anything.

Texts stay where they are read: no shuffle. A worker holds the vocabulary, two memos of at most MEMO short words
each and one piece of a batch (PIECE characters, or one longer text).
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: Words in each of a worker's two memos, and their longest; characters of text encoded, and ids decoded, at once.
MEMO, MEMO_CHARS, PIECE = 1 << 18, 48, 1 << 20

# The normal form and the pattern of word_bpe_49k.json, for which words are made here.
PLAIN_FORM = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PLAIN_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PLAIN_WORDS = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": PLAIN_PATTERN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


#: What Unicode calls white space; Python's `\\s` has four control characters more.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it is visible Latin-1, else the next from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return [chr(b) if b in set(seen) else chr(256 + hidden.index(b)) for b in range(256)]


def in_class(kind: str) -> str:
    """The characters of one letter or number category of the basic plane, as ranges for a pattern."""
    member = np.array([unicodedata.category(chr(c))[0] == kind for c in range(1 << 16)] + [False])
    edges = np.flatnonzero(np.diff(np.concatenate([[False], member])))
    return "".join(f"\\u{a:04x}-\\u{z - 1:04x}" for a, z in edges.reshape(-1, 2).tolist())


class Words(dict):
    """Ids of short words. When the memo is full it becomes the old one, from which words that are still used return."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.old.get(word) or tuple(self.encode(word))
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Bpe:
    """A tokenizer file's vocabulary and merges. Raises on what is not supported: dropout, unknown and continuing
    symbols, byte fall-back, added tokens that strip, and decoders other than none and the bytes'."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        asked = {k: model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "fuse_unk", "ignore_merges")}
        decoder = (file.get("decoder") or {}).get("type")
        if model["type"] != "BPE" or any(asked.values()) or decoder not in (None, "ByteLevel"):
            raise ValueError(f"not supported: {asked}, decoder {decoder}")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in file["added_tokens"]):
            raise ValueError("added tokens that are words, strip, or are looked for in the normal form aren't supported")
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab = {**model["vocab"], **{t["content"]: t["id"] for t in file["added_tokens"]}}
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        strings: list[str | None] = [None] * (max(self.vocab.values()) + 1)
        for s, i in self.vocab.items():
            strings[i] = s
        self.strings = pa.array(strings, pa.string())
        self.between = " " if decoder is None else ""
        self.as_bytes = decoder == "ByteLevel"
        self.pairs: dict[int, int] = {}
        self.made: list[int] = []
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.pairs.setdefault(self.vocab[a] << 20 | self.vocab[b], len(self.made))
            self.made.append(self.vocab[a + b])
        chars = byte_characters()
        self.first = [self.vocab[c] for c in chars]
        self.last = [self.vocab[c + self.suffix] for c in chars]
        self.byte_of = {c: b for b, c in enumerate(chars)}
        library = Tokenizer.from_file(path)
        self.form, self.split = library.normalizer, library.pre_tokenizer
        self.plain = file["normalizer"] == PLAIN_FORM and file["pre_tokenizer"] == PLAIN_WORDS
        letters, numbers = in_class("L"), in_class("N")
        self.pattern = re.compile(PLAIN_PATTERN.replace("\\p{L}", letters).replace("\\p{N}", numbers).replace("\\s", SPACES))
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.alike: dict[str, bool] = {chr(c): True for c in range(128)}
        self.plain_words, self.shown_words = Words(lambda w: self.merged(w.encode())), Words(lambda w: self.merged(bytes(self.byte_of[c] for c in w)))

    def merged(self, word: bytes) -> list[int]:
        """Ids of a word that is not empty."""
        n = len(word)
        sym = [self.first[b] for b in word[:-1]] + [self.last[word[-1]]]
        if n == 1:
            return sym
        pairs, made = self.pairs, self.made
        before, behind = list(range(-1, n - 1)), [*range(1, n), -1]
        # An entry is rank << 40 | place, so that equal ranks go from left to right.
        heap = [rank << 40 | i for i in range(n - 1) if (rank := pairs.get(sym[i] << 20 | sym[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            rank, i = entry >> 40, entry & 0xFFFFFFFFFF
            j = behind[i]
            if sym[i] < 0 or j < 0 or pairs.get(sym[i] << 20 | sym[j]) != rank:
                continue  # stale
            sym[i], sym[j] = made[rank], -1
            k = behind[i] = behind[j]
            if k >= 0:
                before[k] = i
                if (r := pairs.get(sym[i] << 20 | sym[k])) is not None:
                    heapq.heappush(heap, r << 40 | i)
            h = before[i]
            if h >= 0 and (r := pairs.get(sym[h] << 20 | sym[i])) is not None:
                heapq.heappush(heap, r << 40 | h)
        return [s for s in sym if s >= 0]

    def _plain(self, text: str) -> str:
        # White space is in no word, so it needs no normal form. Sigma is the one letter whose small form depends on
        # its neighbours.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _alike(self, c: str) -> bool:
        probe = f"a{c}b"
        own = self.pattern.findall(self._plain(probe))
        theirs = [bytes(self.byte_of[x] for x in w).decode() for w, _ in self.split.pre_tokenize_str(self.form.normalize_str(probe))]
        self.alike[c] = c < "\U00010000" and unicodedata.ucd_3_2_0.category(c) != "Cn" and own == theirs
        return self.alike[c]

    def ids(self, text: str) -> list[int]:
        """Ids of a text, as the library's encode(text, add_special_tokens=False) gives them."""
        if not text:
            return []
        out: list[int] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.added:
                out.append(self.added[part])
            elif self.plain and (part.isascii() or all(self.alike[c] if c in self.alike else self._alike(c) for c in set(part))):
                out += chain.from_iterable(map(self.plain_words.__getitem__, self.pattern.findall(self._plain(part))))
            elif part:
                form = self.form.normalize_str(part) if self.form else part
                out += chain.from_iterable(self.shown_words[w] for w, _ in self.split.pre_tokenize_str(form))
        return out

    def texts(self, ids: pa.ListArray) -> pa.Array:
        """The texts of lists of ids, as the library's decode(ids, skip_special_tokens=False) gives them."""
        shown = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.strings.take(ids.values)), self.between)
        if not self.as_bytes:
            return shown
        return pa.array([b"".join(bytes([self.byte_of[c]]) if c in self.byte_of else c.encode() for c in x).decode(errors="replace") for x in shown.to_pylist()], pa.string())


@functools.lru_cache(2)
def tokenizer(path: str) -> Bpe:
    """One per worker and file."""
    return Bpe(path)


def pieces(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of rows of at most `most` together, or of one row."""
    out, start, held = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and held + n > most:
            out.append((start, i))
            start, held = i, 0
        held += n
    return [*out, (start, len(sizes))] if len(sizes) else out


def _with(batch: pa.RecordBatch, values: list[pa.Array], names: Iterable[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns[:-1], *values], [*batch.schema.names[:-1], *names])


def encoded(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the text's ids in its place (array<int>). A null text, like an empty one, has no ids; a column whose
    name clashes with `ids` is an error. Rows keep their number; an empty table stays empty."""
    if ids in docs.columns and ids != text:
        raise ValueError(f"docs has a column {ids} already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for start, end in pieces(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False), PIECE):
                lists = [np.array(bpe.ids(t or ""), np.int32) for t in texts[start:end].to_pylist()]
                offsets = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists)))
                yield _with(batch.slice(start, end - start), [found], [ids])

    kept = [c for c in docs.columns if c != text]
    rows = docs.select(*kept, F.col(text).cast("string").alias(text))
    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], StructField(ids, ArrayType(IntegerType()))]))


def decoded(rows: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """rows with `text` beside the ids. Null ids give an empty text; an id that the vocabulary lacks is an error."""
    if text in rows.columns:
        raise ValueError(f"rows has a column {text} already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            for start, end in pieces(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), PIECE):
                part = lists.slice(start, end - start)
                plain = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *pc.fill_null(pc.list_value_length(part), 0).to_pylist()]).astype(np.int32)), part.flatten().cast(pa.int32()))
                yield _with(batch.slice(start, end - start), [part, bpe.texts(plain)], [ids, text])

    kept = [c for c in rows.columns if c != ids]
    asked = rows.select(*kept, ids)
    return asked.mapInArrow(run, StructType([*asked.schema.fields, StructField(text, StringType())]))


def digests(rows: DataFrame, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """rows with n_tokens, ids_sha256 and decoded_sha256 in place of the ids and the text."""
    shown = F.array_join(F.transform(ids, lambda i: i.cast("string")), " ")
    return rows.withColumns({"n_tokens": F.size(ids).cast("long"), "ids_sha256": F.sha2(shown, 256), "decoded_sha256": F.sha2(text, 256)}).drop(ids, text)
