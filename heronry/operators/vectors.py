"""An exact cluster index for search by cosine.

Unit vectors belong to the nearest of some centres and lie in blocks of about BLOCK_ROWS, sorted by their angle to the
centre. Angles are a metric, so of a question at angle t to a centre, no vector of a block that lies between the
angles `near` and `far` has a smaller angle than t - far or near - t. A search reads the clusters around the question
until they hold k vectors, takes the k-th score as its bound, and then reads those blocks that can still reach it:
blocks are left out by their bounds alone, before their vectors are sent anywhere. Results are those of a full scan.

Centres are at most CENTRES vectors of the table: all that the driver holds, whatever the table's size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.operators.retrieval import ranked
from heronry.session import forgotten, written

CENTRES, BLOCK_ROWS, QUERY_ROWS = 4096, 512, 256
#: Ranks go by scores of six decimals, so what could round to the bound is read too.
SLACK = 1.1e-6

BLOCKS = "block long, cluster int, near double, far double, n int, ids binary, matrix binary"
PROBES = "query long, unit binary, cluster int, angle double, bound double"


class VectorIndex(NamedTuple):
    """centres: a row each; clusters: (vectors, farthest angle) of each; blocks: BLOCKS, a written table."""

    centres: np.ndarray
    sizes: np.ndarray
    reach: np.ndarray
    blocks: DataFrame

    def dropped(self) -> None:
        """Deletes the table; nothing may read the index any more."""
        forgotten(self.blocks)


def units(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(id, unit array<double>). Vectors that are null, empty, zero, or hold a component that is null or not finite, and
    rows without a key, are left out."""
    x = F.transform(F.col(column), lambda c: c.cast("double"))
    rows = vectors.select(F.col(key).cast("long").alias("id"), x.alias("x")).where("id is not null and size(x) > 0")
    rows = rows.where(~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))).where("norm > 0")
    return rows.select("id", F.transform("x", lambda v: v / F.col("norm")).alias("unit"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim))
    for row, v in zip(out, column, strict=True):
        v = v.values.to_numpy()
        if len(v) > dim:
            raise ValueError(f"a vector of {len(v)} components where the index has {dim}")
        row[: len(v)] = v
    return out


def angles(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ centres.T, -1, 1))


def _assigned(centres: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                m = _matrix(part.column("unit"), centres.shape[1])
                angle = angles(m, centres)
                best = angle.argmin(1)
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": part.column("id"),
                        "cluster": pa.array(best, pa.int32()),
                        "angle": angle[np.arange(len(best)), best],
                        "unit": pa.array([r.tobytes() for r in m], pa.binary()),
                    }
                )

    return run


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by cluster and angle; a block ends with its cluster or at BLOCK_ROWS."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    held: list[tuple[int, int, float, bytes]] = []

    def block() -> pa.RecordBatch:
        nonlocal number, held
        number += 1
        out = pa.RecordBatch.from_pydict(
            {
                "block": pa.array([number], pa.int64()),
                "cluster": pa.array([held[0][1]], pa.int32()),
                "near": [held[0][2]],
                "far": [held[-1][2]],
                "n": pa.array([len(held)], pa.int32()),
                "ids": pa.array([np.array([r[0] for r in held], np.int64).tobytes()], pa.binary()),
                "matrix": pa.array([b"".join(r[3] for r in held)], pa.binary()),
            }
        )
        held = []
        return out

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("id", "cluster", "angle", "unit")), strict=True):
            if held and (row[1] != held[0][1] or len(held) >= BLOCK_ROWS):
                yield block()
            held.append(row)
    if held:
        yield block()


def clustered(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", centres: int = CENTRES) -> VectorIndex:
    """The index of vectors. Shorter vectors are padded with zeros. The centres are those of the table's vectors whose
    ids hash lowest, the square root of their number but at most `centres`; they steer what is read, not what is found."""
    rows = units(vectors, key, column)
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("unit")).alias("d")).first()
    count, dim = size["n"], size["d"] or 1
    wanted = min(centres, max(1, math.isqrt(count)))
    picked = [r["unit"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()]
    middle = np.zeros((max(1, len(picked)), dim))
    for row, v in zip(middle, picked, strict=False):
        row[: len(v)] = v
    middle = np.unique(middle, axis=0)
    dealt = rows.mapInArrow(_assigned(middle), "id long, cluster int, angle double, unit binary")
    order = ["cluster", "angle", "id"]
    dealt = dealt.repartitionByRange(max(1, -(-count // (BLOCK_ROWS * 64))), *order).sortWithinPartitions(*order)
    blocks = written(dealt.mapInArrow(_blocked, BLOCKS), "clusters")
    sizes, reach = np.zeros(len(middle), np.int64), np.zeros(len(middle))
    for r in blocks.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("far").alias("far")).collect():  # a row per centre
        sizes[r["cluster"]], reach[r["cluster"]] = r["n"], r["far"]
    return VectorIndex(middle, sizes, reach, blocks)


def _probes(index: VectorIndex, k: int) -> Callable:
    """The clusters that a question reads: with a null bound the nearest ones that hold k vectors, else all in reach."""
    centres, sizes, reach = index.centres, index.sizes, index.reach

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                m = _matrix(part.column("unit"), centres.shape[1])
                angle = angles(m, centres)
                bound = part.column("bound").to_numpy(zero_copy_only=False)
                least = np.cos(np.maximum(0, angle - reach[None, :]))
                hit = (least >= bound[:, None] - SLACK) & (sizes > 0)
                for i in np.flatnonzero(np.isnan(bound)):
                    near = np.argsort(angle[i], kind="stable")
                    enough = np.searchsorted(np.cumsum(sizes[near]), k) + 1
                    hit[i] = False
                    hit[i, near[:enough]] = True
                q, c = np.nonzero(hit)
                raw = [r.tobytes() for r in m]
                yield pa.RecordBatch.from_pydict(
                    {
                        "query": part.column("id").take(pa.array(q)),
                        "unit": pa.array([raw[i] for i in q], pa.binary()),
                        "cluster": pa.array(c, pa.int32()),
                        "angle": angle[q, c],
                        "bound": np.where(np.isnan(bound[q]), -2.0, bound[q]),
                    }
                )

    return run


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            ids = np.frombuffer(row["ids"], np.int64)
            m = np.frombuffer(row["matrix"]).reshape(len(ids), -1)
            q = np.frombuffer(b"".join(x["unit"] for x in row["asked"])).reshape(len(row["asked"]), -1)
            score = q @ m.T
            r, c = np.nonzero(score >= np.array([x["bound"] for x in row["asked"]])[:, None] - SLACK)
            yield pa.RecordBatch.from_pydict({"query": pa.array(np.array([x["query"] for x in row["asked"]], np.int64)[r]), "id": ids[c], "score": score[r, c]})


def wanted(index: VectorIndex, asked: DataFrame, k: int) -> DataFrame:
    """(block, query, unit, bound): the blocks that questions (id, unit, bound) read."""
    probes = asked.mapInArrow(_probes(index, k), PROBES)
    gap = F.greatest(F.lit(0.0), F.col("angle") - F.col("far"), F.col("near") - F.col("angle"))
    pairs = probes.join(index.blocks.select("block", "cluster", "near", "far"), "cluster")
    return pairs.where(F.cos(gap) >= F.col("bound") - SLACK).select("block", "query", "unit", "bound")


def _answers(index: VectorIndex, pairs: DataFrame, bundles: int) -> DataFrame:
    """(query, id, score) of the pairs' blocks. A block is sent once for some QUERY_ROWS questions."""
    asked = pairs.groupBy("block", F.pmod(F.xxhash64("query"), F.lit(bundles)).alias("bundle")).agg(F.collect_list(F.struct("query", "unit", "bound")).alias("asked"))
    return asked.join(index.blocks.select("block", "ids", "matrix"), "block").select("asked", "ids", "matrix").mapInArrow(_scanned, "query long, id long, score double")


def bounded(index: VectorIndex, queries: DataFrame, k: int, query: str, column: str) -> tuple[DataFrame, int]:
    """(id, unit, bound) of the questions, and their number: the bound is the k-th score in the clusters around, null
    where there are fewer vectors."""
    asked = written(units(queries, query, column), "asked")
    bundles = max(1, -(-asked.count() // QUERY_ROWS))
    first = _answers(index, wanted(index, asked.withColumn("bound", F.lit(None).cast("double")), k), bundles)
    kth = ranked(first, "query", "score", "id", k).where(F.col("rank") == k).select(F.col("query").alias("id"), F.col("score").alias("bound"))
    return asked.join(kth.distinct(), "id", "left").withColumn("bound", F.coalesce("bound", F.lit(-2.0))), bundles


def search(index: VectorIndex, queries: DataFrame, k: int, key: str = "vec_id", query: str = "query_id", column: str = "embedding") -> DataFrame:
    """queries (query, embedding) -> (query, key, score, rank): the k nearest by cosine, to six decimals, ties to the
    smaller key; all, if there are fewer. Questions that `units` leaves out have no rows. k is at least 1."""
    asked, bundles = bounded(index, queries, k, query, column)
    found = _answers(index, wanted(index, asked, k), bundles)
    out = found.select(F.col("query").alias(query), F.col("id").alias(key), "score")
    return ranked(out, query, "score", key, k)
