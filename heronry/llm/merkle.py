"""Operator 12: Merkle manifest of a dataset, by Pregel-style RDD supersteps.

Rows are leaves of a binary tree per group; the groups' roots, in the groups' order, are leaves of one more tree.
A vertex is a block of up to 2 ** BITS consecutive nodes of a level. Going up, nodes message the vertex above them; a
vertex that has all its children hashes its BITS levels and sends the one digest left to its own parent. Going down,
each vertex is sent the siblings that lie above it, adds those within, and sends them to the vertices below; at the
leaves the whole path is folded with the claimed digest and compared with the root. A tree of n leaves takes
log(n) / BITS rounds each way. A group is spread over as many blocks as it needs, so a group may hold most rows.

The leaves are a table in the shared folder; all rounds hang on it and on shuffle files, which Spark makes again if an
executor is lost. The driver sees, of each range partition, its rows and its first and last group, and no more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import written

#: Levels that one vertex hashes; nodes in a task.
BITS, TASK_NODES = 10, 1 << 16
SCHEMA = "key long, leaf string, subroot string, root string, sides string, siblings array<string>, folded_root string"


def encoded(*fields: Column) -> Column:
    """The fields behind one another: `-` for null, else the length in UTF-8 bytes, a colon and the value."""
    text = [f.cast("string") for f in fields]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text])


def digest(*parts: bytes) -> bytes:
    """SHA-256 of digests as hexadecimal text, behind one another."""
    return hashlib.sha256("".join([p.hex() for p in parts]).encode()).digest()


def depth(n: int) -> int:
    """Levels above n nodes."""
    return max(n - 1, 0).bit_length()


def levels(nodes: list[bytes], height: int) -> list[list[bytes]]:
    """The nodes and `height` levels above them."""
    out = [nodes]
    for _ in range(height):
        low = out[-1]
        out.append([digest(*low[i : i + 2]) for i in range(0, len(low), 2)])
    return out


def siblings(tree: list[list[bytes]], i: int) -> tuple[str, bytes]:
    """(sides, siblings) of node i from the bottom up: at each level `L`, `R`, or `-` where it is alone."""
    sides, found = [], []
    for row in tree[:-1]:
        j = i ^ 1
        if j < len(row):
            sides.append("L" if j < i else "R")
            found.append(row[j])
        else:
            sides.append("-")
        i >>= 1
    return "".join(sides), b"".join(found)


def folded(claim: bytes, sides: str, found: bytes) -> bytes:
    """The root that a claimed leaf and its siblings give."""
    at = 0
    for side in sides:
        if side == "-":
            claim = digest(claim)
            continue
        other = found[at : at + 32]
        at += 32
        claim = digest(other, claim) if side == "L" else digest(claim, other)
    return claim


class Node(NamedTuple):
    """A node of group `tree`: its digest, the leaves of the group, and what belongs to it (a leaf: key and claim; a
    group's root in the upper tree: the group's number of leaves)."""

    digest: bytes
    n: int
    extra: tuple


def _place(key: tuple) -> int:
    """Where a vertex lives; all its nodes and messages go there."""
    return (key[0] * 0x9E3779B1 + key[1] * 0x85EBCA6B) & 0x7FFFFFFF


def _vertices(nodes: Iterator[tuple[tuple[int, int, int], Node]], at: int, bits: int) -> Iterator[tuple[int, int, list[Node], list[list[bytes]]]]:
    """(tree, block, nodes, levels) of the vertices whose nodes stand `at` levels above the leaves."""
    for (tree, block), found in groupby(nodes, lambda kv: kv[0][:2]):
        own = [node for _, node in found]
        n = own[0].n
        width = -(-n // (1 << at))
        if len(own) != min(1 << bits, width - (block << bits)):
            raise RuntimeError(f"vertex {(tree, at, block)} has {len(own)} children of {min(1 << bits, width - (block << bits))}")
        yield tree, block, own, levels([x.digest for x in own], min(bits, depth(n) - at))


def _up(at: int, bits: int):
    def run(nodes: Iterator) -> Iterator:
        for tree, block, own, tree_levels in _vertices(nodes, at, bits):
            n = own[0].n
            yield depth(n) <= at + bits, ((tree, *_split(block, bits)), Node(tree_levels[-1][0], n, ()))

    return run


def _down(at: int, bits: int):
    """Path messages come first in a partition, then the vertices' nodes. Yields ((tree, block of the level below), path)
    or, at the leaves, result rows."""

    def run(items: Iterator) -> Iterator:
        above: dict[tuple[int, int], tuple] = {}

        def nodes() -> Iterator:
            for key, value in items:
                if isinstance(value, Node):
                    yield key, value
                else:
                    above[key[:2]] = value

        for tree, block, own, inner in _vertices(nodes(), at, bits):
            subroot, root, sides, found = above.pop((tree, block))
            for i, node in enumerate(own):
                s, f = siblings(inner, i)
                path = (subroot, root, s + sides, f + found)
                if at:
                    yield (tree, (block << bits) + i, -1), path
                else:
                    yield node, path

    return run


def _split(place: int, bits: int) -> tuple[int, int]:
    """The vertex of a node's place in its level, and the place in the vertex."""
    return place >> bits, place & ((1 << bits) - 1)


def _below(paths: RDD, nodes: RDD, at: int, bits: int) -> RDD:
    """The vertices' next superstep on the way down. Both sides are dealt alike, so the nodes aren't sent again."""
    return paths.partitionBy(nodes.getNumPartitions(), _place).union(nodes).mapPartitions(_down(at, bits))


def _row(node: Node, path: tuple) -> tuple:
    subroot, root, sides, found = path
    key, claim = node.extra
    hexed = [found[i : i + 32].hex() for i in range(0, len(found), 32)]
    return key, node.digest.hex(), subroot.hex(), root.hex(), sides, hexed, folded(claim or node.digest, sides, found).hex()


def _runs(rows: Iterator) -> Iterator[tuple[int, object, int, object, int, int]]:
    """Of a range partition: (rows, first group, its rows, last group, its rows, groups)."""
    total = groups = first_rows = last_rows = 0
    first = last = None
    for group, found in groupby(rows, lambda r: r[0]):
        last, last_rows = group, sum(1 for _ in found)
        if not groups:
            first, first_rows = last, last_rows
        total, groups = total + last_rows, groups + 1
    yield total, first, first_rows, last, last_rows, groups


class Start(NamedTuple):
    """Of a range partition: numbers of its first and last group, the place in the first, and the leaves of both."""

    group: int
    final: int
    place: int
    first: int
    last: int


def starts(runs: list[tuple]) -> tuple[dict[int, Start], list[int], int]:
    """Where each partition starts, the leaves of the groups that start or end a partition, and the number of groups."""
    at: dict[int, tuple[int, int, int]] = {}
    sizes: dict[int, int] = {}
    group, place, before = -1, 0, None
    for part, (total, first, first_rows, last, last_rows, groups) in enumerate(runs):
        if not total:
            continue
        if before is None or before[0] != first:
            group, place = group + 1, 0
        own = group
        sizes[own] = sizes.get(own, 0) + first_rows
        at[part] = (own, place, own + groups - 1)
        if groups > 1:
            group, place = own + groups - 1, last_rows
            sizes[group] = last_rows
        else:
            place += first_rows
        before = (last,)
    return {p: Start(g, z, i, sizes[g], sizes[z]) for p, (g, i, z) in at.items()}, list(sizes.values()), group + 1


def _placed(start: dict[int, Start], bits: int):
    def run(part: int, rows: Iterator) -> Iterator[tuple[tuple[int, int, int], Node]]:
        runs = groupby(rows, lambda r: r[0])
        held = next(runs, None)
        if held is None:
            return
        s = start[part]
        group, place, found, total = s.group, s.place, held[1], s.first
        while True:
            for _, key, leaf, claim in found:
                yield (group, *_split(place, bits)), Node(bytes(leaf), total, (key, claim and bytes(claim)))
                place += 1
            if (held := next(runs, None)) is None:
                return
            # Any but the first: a whole group, or the start of one that the next partition continues.
            found = list(held[1])
            group, place = group + 1, 0
            total = s.last if group == s.final else len(found)

    return run


def proofs(leaves: DataFrame, bits: int = BITS, task_nodes: int = TASK_NODES) -> DataFrame:
    """leaves (group string, key long, leaf, claim: hexadecimal SHA-256 digests) -> SCHEMA, a row each: the digests of
    the group's and of the whole tree's root, the siblings on the way up with the side that each stands on (`-`: alone),
    and the root that the claim gives with them. Within a group leaves stand by key, null first, then by leaf; the
    groups stand by their bytes, null first and a group of its own. Repeated rows are leaves each. A null claim is the
    leaf. An empty table gives no rows."""
    spark = leaves.sparkSession
    rows = leaves.select("group", "key", F.unhex("leaf").alias("leaf"), F.when(F.col("claim") != F.col("leaf"), F.unhex("claim")).alias("claim"))
    rows = written(rows.withColumn("uid", F.monotonically_increasing_id()), "leaves")
    count = rows.count()
    if not count:
        return spark.createDataFrame([], SCHEMA)

    def tasks(nodes: int) -> int:
        return max(1, -(-nodes // task_nodes))

    # The last key deals even rows that are alike to several ranges.
    order = [F.col("group").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("leaf"), F.col("uid")]
    ranged = rows.repartitionByRange(tasks(count), *order).sortWithinPartitions(*order).select("group", "key", "leaf", "claim").rdd
    start, sizes, trees = starts(ranged.mapPartitions(_runs).collect())
    # A group within one partition has no more leaves than a partition; only those that lie across need be asked.
    largest = max([*sizes, ranged.mapPartitions(_largest).max()])

    def climbed(messages: RDD, count: int, leaves: int) -> tuple[list[RDD], RDD]:
        """The nodes at their vertices for each superstep, and the roots of all trees."""
        laid, roots = [], []
        for at in range(0, max(1, depth(leaves)), bits):
            laid.append(messages.repartitionAndSortWithinPartitions(tasks(count >> at), _place))
            sent = laid[-1].mapPartitions(_up(at, bits))
            roots.append(sent.filter(lambda m: m[0]).map(lambda m: m[1]))
            messages = sent.filter(lambda m: not m[0]).map(lambda m: m[1])
        return laid, spark.sparkContext.union(roots)

    lower, roots = climbed(ranged.mapPartitionsWithIndex(_placed(start, bits)), count, largest)
    # The groups' roots are the leaves of the upper tree.
    upper, root = climbed(roots.map(lambda m: ((-1, *_split(m[0][0], bits)), Node(m[1].digest, trees, (m[0][0], m[1].n)))), trees, trees)
    paths = root.map(lambda m: ((-1, 0, -1), (b"", m[1].digest, "", b"")))
    for step in reversed(range(len(upper))):
        paths = _below(paths, upper[step], step * bits, bits)
    # A group's path goes to its topmost vertex, which took part in the superstep that its size says.
    tops = paths.map(lambda m: (m[0].extra[1], ((m[0].extra[0], 0, -1), (m[0].digest, *m[1][1:]))))
    for step in reversed(range(len(lower))):
        own = tops.filter(lambda m, s=step: max(0, depth(m[0]) - 1) // bits == s).map(lambda m: m[1])
        paths = _below(paths.union(own) if step + 1 < len(lower) else own, lower[step], step * bits, bits)
    return spark.createDataFrame(paths.map(lambda m: _row(*m)), SCHEMA, verifySchema=False)


def _largest(rows: Iterator) -> Iterator[int]:
    yield max((sum(1 for _ in found) for _, found in groupby(rows, lambda r: r[0])), default=0)


def document_leaves(docs: DataFrame, tamper: Column | None = None, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), counted: str = "n_chars") -> DataFrame:
    """(group, key, leaf, claim) of documents: the leaf hashes `fields`; where `tamper` holds, the claim hashes them with
    one more in `counted` (a null stays null). Other columns aren't looked at."""
    leaf = F.sha2(encoded(*[F.col(c) for c in fields]), 256)
    more = [(F.col(c).cast("decimal(20,0)") + 1).cast("string") if c == counted else F.col(c) for c in fields]
    claim = F.when(tamper, F.sha2(encoded(*more), 256)) if tamper is not None else F.lit(None).cast("string")
    return docs.select(F.col("lang").alias("group"), F.col("doc_id").cast("long").alias("key"), leaf.alias("leaf"), claim.alias("claim"))
