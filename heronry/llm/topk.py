"""Operator 2: exact top-k by inner product, norm-bucketed retrieval.

Candidates are range-partitioned by length, longest first, into buckets. A first pass over the longest
bucket gives each query a lower bound of its k-th score. From it each bucket has a local cosine threshold;
pairs of query block and bucket in which no product can reach the bound are not formed at all. Inside a
bucket a query prunes by length (a prefix of the bucket, as it is sorted by length) where the threshold is
low, or by coordinates (the feasible range of its largest coordinates) where it is high. What is left is
verified by integer products, so scores and ties are exact: in floats where those hold them, else in whole
numbers of any size. A score among the best that a long can't hold is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import settled, written

BUCKET_ROWS, QUERY_ROWS = 8192, 4096
#: Local cosine threshold from which coordinates prune better than lengths; coordinates looked at.
COSINE, FOCUS = 0.75, 3


def quantised(vectors: DataFrame, key: str, column: str, scale: int, *kept: str) -> DataFrame:
    """(id, kept, v, norm): floor(scale * x) of every component, a whole number as double; rows with a null or non-finite
    component, or a null or empty vector or id, take no part."""
    x = F.transform(F.col(column), lambda c: c.cast("double"))
    rows = vectors.select(F.col(key).cast("long").alias("id"), *kept, x.alias("x")).where("id is not null and x is not null and size(x) > 0")
    rows = rows.where(~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))))
    # rint(y) is y's floor or the number above it; F.floor would end at the largest long.
    rows = rows.select("id", *kept, F.transform("x", lambda c: F.rint(c * F.lit(scale)) - F.when(F.rint(c * F.lit(scale)) > c * F.lit(scale), 1.0).otherwise(0.0)).alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)))


PACKED = "block long, top double, rows int, dim int, ids binary, matrix binary"


def _packer(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, count = TaskContext.get().partitionId(), 0
        held: list[tuple[float, int, list]] = []

        def block(rows: list) -> pa.RecordBatch:
            nonlocal count
            dim = max(len(v) for _, _, v in rows)
            matrix = np.zeros((len(rows), dim))
            for i, (_, _, v) in enumerate(rows):
                matrix[i, : len(v)] = v
            small = np.abs(matrix).max(initial=0) < 1 << 15
            count += 1
            return pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([(part << 20) + count - 1], pa.int64()),
                    "top": [float(rows[0][0])],
                    "rows": pa.array([len(rows)], pa.int32()),
                    "dim": pa.array([dim], pa.int32()),
                    "ids": pa.array([np.array([i for _, i, _ in rows], np.int64).tobytes()], pa.binary()),
                    "matrix": pa.array([matrix.astype(np.int16 if small else np.float64).tobytes()], pa.binary()),
                }
            )

        for batch in batches:
            held += list(zip(batch.column("norm").to_pylist(), batch.column("id").to_pylist(), batch.column("v").to_pylist(), strict=True))
            while len(held) >= size:  # rows come longest first
                yield block(held[:size])
                held = held[size:]
        if held:
            yield block(held)

    return run


def packed(rows: DataFrame, size: int, count: int) -> DataFrame:
    """Blocks of up to `size` vectors, by length from the longest on; a row is a block."""
    parts = max(1, -(-count // size))
    dealt = rows.repartitionByRange(parts, F.col("norm").desc(), F.col("id")).sortWithinPartitions(F.col("norm").desc(), "id")
    return dealt.select("norm", "id", "v").mapInArrow(_packer(size), PACKED)


def unpacked(ids: bytes, matrix: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(ids) // 8
    kind = np.int16 if len(matrix) == 2 * n * dim else np.float64
    return np.frombuffer(ids, np.int64), np.frombuffer(matrix, kind).reshape(n, dim).astype(np.float64)


def products(rows: np.ndarray, query: np.ndarray, exact: bool) -> np.ndarray:
    """Integer products; exact says that floats hold them, sums on the way included."""
    if exact:
        return (rows @ query).astype(np.int64)
    own = np.array([int(x) for x in query], object)
    return np.array([sum(int(a) * b for a, b in zip(row, own, strict=True)) for row in rows], object)


def bucket_search(q: np.ndarray, own: int, bound: float, ids: np.ndarray, real: np.ndarray, exact: bool, norm: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the bucket's best k for one query among those that can reach the bound."""
    length = float(np.sqrt((q**2).sum()))
    upto = len(ids)
    pick = None
    if np.isfinite(bound) and length > 0 and bound > 0:
        slack = 1 - 1e-9
        upto = int(np.searchsorted(-norm, -(bound / length) * slack, "right"))
        if not upto:
            return ids[:0], ids[:0]
        cosine = bound / (length * norm[0])
        if COSINE <= cosine <= 1:
            unit = q / length
            keep = np.ones(upto, bool)
            for f in np.argsort(-np.abs(unit), kind="stable")[:FOCUS]:
                # Each row has a threshold by its own length; the range of the coordinate follows from it.
                local = np.minimum(bound * slack / (length * norm[:upto]), 1.0)
                width = np.sqrt(np.maximum(0, (1 - local**2) * (1 - unit[f] ** 2))) + 1e-9
                c = real[:upto, f] / norm[:upto]
                # Above this range the coordinate is nearer to the query's still, which can only help if the query's is large.
                low, high = unit[f] * local - width, unit[f] * local + width
                high = np.where(unit[f] >= local, 1.0, high)
                low = np.where(-unit[f] >= local, -1.0, low)
                keep &= (c >= low - 1e-9) & (c <= high + 1e-9)
            pick = np.flatnonzero(keep)
    rows = real[:upto] if pick is None else real[pick]
    found = ids[:upto] if pick is None else ids[pick]
    if not len(found):
        return ids[:0], ids[:0]
    score = products(rows, q, exact)
    good = (found != own) & (score >= bound).astype(bool) if np.isfinite(bound) else found != own
    found, score = found[good], score[good]
    if len(found) > k and exact:
        least = np.partition(score, len(score) - k)[len(score) - k]
        good = score >= least
        found, score = found[good], score[good]
    best = np.lexsort((found, -score))[:k] if exact else np.array(sorted(range(len(found)), key=lambda i: (-score[i], found[i]))[:k], np.int64)
    found, score = found[best], score[best]
    if not exact and any(abs(x) >= 1 << 63 for x in score):
        raise ValueError(f"the score of query {own} with vector {found[np.argmax(np.abs(score))]} exceeds a long")
    return found, score.astype(np.int64)


FOUND = "query_id long, vec_id long, score long"
BOUNDS = "qblock long, bounds binary, least double"


def _search(k: int, bounds_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                qids, queries = unpacked(row["qids"], row["qmatrix"], row["qdim"])
                ids, m = unpacked(row["ids"], row["matrix"], row["dim"])
                dim = max(row["qdim"], row["dim"])
                queries = np.pad(queries, ((0, 0), (0, dim - queries.shape[1])))
                m = np.pad(m, ((0, 0), (0, dim - m.shape[1])))
                norm = np.sqrt((m**2).sum(1))
                exact = float(np.abs(m).max(initial=0)) * float(np.abs(queries).max(initial=0)) * dim < 2.0**53
                bounds = np.frombuffer(row["bounds"], np.float64) if row["bounds"] is not None else np.full(len(qids), -np.inf)
                found = [bucket_search(q, int(own), b, ids, m, exact, np.maximum(norm, 1e-300), k) for q, own, b in zip(queries, qids, bounds, strict=True)]
                if bounds_only:
                    kth = np.array([s[k - 1] if len(s) >= k else -np.inf for _, s in found], np.float64)
                    kth = np.where(np.abs(kth) < 2.0**53, kth, np.nextafter(kth, -np.inf))  # it was rounded
                    yield pa.RecordBatch.from_pydict({"qblock": pa.array([row["qblock"]], pa.int64()), "bounds": pa.array([kth.tobytes()], pa.binary()), "least": [float(kth.min())]})
                else:
                    yield pa.RecordBatch.from_pydict(
                        {
                            "query_id": np.repeat(qids, [len(i) for i, _ in found]),
                            "vec_id": np.concatenate([i for i, _ in found]).astype(np.int64),
                            "score": np.concatenate([s for _, s in found]).astype(np.int64),
                        }
                    )

    return run


def level(length: Column) -> Column:
    """Sixteen levels to a doubling of the length; null for zero."""
    return F.when(length > 0, F.floor(F.log2(length) * 16)).cast("int")


def top_k(vectors: DataFrame, every: int, k: int = 20, scale: int = 64, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Queries are the rows whose id is divisible by `every`, candidates all rows with another id ->
    (query_id, rank int, vec_id, score), k rows per query or as many as there are; ties go to the smaller id.

    Vectors of unequal length are padded with zeros. An empty table gives an empty result; rows that repeat
    an id are candidates each, but not for that id's query, which is the least of their vectors."""
    rows = written(quantised(vectors, key, column, scale), "vectors")
    count = rows.count()
    candidates = written(packed(rows, BUCKET_ROWS, count).withColumn("level", level(F.col("top"))), "buckets")
    asked = rows.where(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min(F.struct("v", "norm")).alias("x")).select("id", "x.v", "x.norm")
    queries = packed(asked, QUERY_ROWS, count // every + 1)
    queries = written(queries.select(F.col("block").alias("qblock"), F.col("top").alias("qtop"), F.col("ids").alias("qids"), F.col("matrix").alias("qmatrix"), F.col("dim").alias("qdim")), "queries")
    longest = candidates.orderBy(F.col("top").desc(), "block").limit(1).select("ids", "matrix", "dim")
    first = queries.crossJoin(F.broadcast(longest)).withColumn("bounds", F.lit(None).cast("binary"))  # one bucket of BUCKET_ROWS
    bounds = written(first.mapInArrow(_search(k, True), BOUNDS), "bounds")
    asked_blocks = queries.join(bounds, "qblock")
    # Blocks of queries meet buckets by levels of length, from the least that can reach the bound to the highest;
    # then the vectors of the pairs left.
    ends = candidates.agg(F.count("*").alias("n"), F.min("level").alias("low"), F.max("level").alias("high")).first()
    # Buckets of zero vectors are one level under the shortest.
    low, high = (ends["low"] or 0) - 1, -1 if ends["high"] is None else ends["high"]
    if not ends["n"]:
        return first.mapInArrow(_search(k, False), FOUND).select("query_id", F.lit(0).alias("rank"), "vec_id", "score")
    reach = F.when((F.col("least") > 0) & (F.col("qtop") > 0), level(F.col("least") / F.col("qtop")) - 1)
    lowest = F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce(reach, F.lit(low))))
    wanted = asked_blocks.select("qblock", "qtop", "least", F.explode(F.sequence(lowest, F.lit(high))).alias("level"))
    pairs = wanted.join(candidates.select("block", "top", F.coalesce("level", F.lit(low)).alias("level")), "level")
    pairs = pairs.where(F.col("qtop") * F.col("top") * (1 + 1e-9) >= F.col("least")).select("qblock", "block")
    work = pairs.join(asked_blocks, "qblock").join(candidates.select("block", "ids", "matrix", "dim"), "block")
    found = work.repartition(F.col("qblock"), F.col("block")).mapInArrow(_search(k, False), FOUND)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    out = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return settled(out, "best", rows, candidates, queries, bounds)
