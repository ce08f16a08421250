"""Operator 11: hard negatives by an orthogonal PCA rotation.

All vectors are turned by the eigenvectors of their directions' second moments, taken over the whole table, so that
leading components hold most of a product. Of a block of anchors and a block of candidates the products of the leading
components are accumulated step by step; Cauchy-Schwarz on the norms of what is left, and a slack for the rounding of
the rotation and the sums, bounds the rest. A pair that can't reach what is asked is discarded at that step; what
survives all steps is verified by integer products of the vectors as they were, so scores and ties are exact.

Two searches use it: an anchor's positives (highest scores of its own label), then for each positive the highest scores
of other labels between two shares of the positive's score. Blocks of anchors meet blocks of candidates on a grid. Each
of its tasks has a block of anchors and reads some files of candidates where they lie, so blocks are neither copied for
the grid nor sent through the driver, and what a task has found so far is asked of its next block. A block is a row, so
no task works on more than two of them, whatever labels or copies the vectors have.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import settled, written
from .topk import products, quantised, unpacked

BLOCK_ROWS, ANCHOR_ROWS = 8192, 4096
#: Anchors and candidates whose products are held at once; share of a tile's pairs from which all are verified at once.
TILE_ANCHORS, TILE_ROWS, DENSE = 256, 2048, 0.05
#: Shares of the components after which pairs are looked at again.
STEPS = (0.125, 0.25, 0.5)
#: Rounding of a rotated product, as a share of the product of lengths: some thousand times what doubles can lose.
SLACK = 1e-10
LARGEST = np.iinfo(np.int64).max
#: Tasks of a grid, or four for each core if that is more: the driver holds some KB, and a shuffle the best rows, of each.
GRID_TASKS = 1024

PACKED = "block int, rows int, dim int, ids binary, labels binary, matrix binary"
POSITIVES = "ablock int, anchor_id long, vec_id long, score long"
NEGATIVES = "anchor_id long, nth int, positive_id long, positive_score long, negative_id long, negative_score long"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block per partition; its vectors stand by label and id."""
    from pyspark import TaskContext

    ids, labels, vectors = [], [], []
    for batch in batches:
        ids += batch.column("id").to_pylist()
        labels += batch.column("label").to_pylist()
        vectors += [np.array(v) for v in batch.column("v").to_pylist()]
    if not ids:
        return
    order = np.lexsort((ids, labels))
    matrix = np.zeros((len(ids), max(map(len, vectors))))
    for i, k in enumerate(order):
        matrix[i, : len(vectors[k])] = vectors[k]
    small = np.abs(matrix).max(initial=0) < 1 << 15
    yield pa.RecordBatch.from_pydict(
        {
            "block": pa.array([TaskContext.get().partitionId()], pa.int32()),
            "rows": pa.array([len(ids)], pa.int32()),
            "dim": pa.array([matrix.shape[1]], pa.int32()),
            "ids": pa.array([np.array(ids, np.int64)[order].tobytes()], pa.binary()),
            "labels": pa.array([np.array(labels, np.int64)[order].tobytes()], pa.binary()),
            "matrix": pa.array([matrix.astype(np.int16 if small else np.float64).tobytes()], pa.binary()),
        }
    )


def packed(rows: DataFrame, size: int, count: int) -> DataFrame:
    """rows (id, label, v) in blocks of about `size`, dealt evenly whatever their values."""
    return rows.select("id", "label", "v").repartition(max(1, -(-count // size))).mapInArrow(_pack, PACKED)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the products of two components over the directions of a task's vectors, those that aren't zero."""
    total: np.ndarray | None = None
    for batch in batches:
        for row in batch.to_pylist():
            _, m = unpacked(row["ids"], row["matrix"], row["dim"])
            top = np.abs(m).max(1, keepdims=True)
            m = m / np.where(top > 0, top, 1)
            m = m / np.maximum(np.sqrt((m**2).sum(1, keepdims=True)), 1e-300)
            own = m.T @ m
            if total is not None:
                d = max(len(own), len(total))
                own = np.pad(own, (0, d - len(own))) + np.pad(total, (0, d - len(total)))
            total = own
    if total is not None:
        i, j = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "s": total.ravel()})


def rotation(blocks: DataFrame) -> np.ndarray:
    """The orthogonal matrix of leading directions: d * d numbers, whatever the number of vectors."""
    sums = blocks.mapInArrow(_moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    d = int(sums["i"].max()) + 1
    moments = np.zeros((d, d))
    moments[sums["i"], sums["j"]] = sums["s"]
    values, vectors = np.linalg.eigh((moments + moments.T) / 2)
    return vectors[:, np.argsort(-values)]


class Side:
    """Vectors as they were and rotated, with the norms of what is left behind each step."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, real: np.ndarray, turn: np.ndarray, cuts: list[int]):
        self.ids, self.labels, self.real = ids, labels, np.pad(real, ((0, 0), (0, len(turn) - real.shape[1])))
        self.turned = self.real @ turn
        self.norm = np.sqrt((self.real**2).sum(1))
        self.rest = [np.sqrt((self.turned[:, c:] ** 2).sum(1)) for c in cuts]


def survivors(a: Side, c: Side, rows: slice, cols: slice, cuts: list[int], want: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray], masks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(anchor, candidate) places of the tile's pairs that can still be asked for, and their products if all were formed.
    want(anchors, candidates, low, high) says which pairs can have a score between low and high; low and high are tables
    with an anchor a row, or the pairs' own."""
    qs, cs = np.arange(rows.start, rows.stop), np.arange(cols.start, cols.stop)
    slack = SLACK * np.outer(a.norm[rows], c.norm[cols])
    part = a.turned[rows, : cuts[0]] @ c.turned[cols, : cuts[0]].T
    rest = np.outer(a.rest[0][rows], c.rest[0][cols]) + slack
    alive = want(qs[:, None], cs[None, :], part - rest, part + rest)
    if masks is not None:
        alive &= masks
    if alive.mean() > DENSE:
        i, j = np.nonzero(alive)
        return i + rows.start, j + cols.start, None
    i, j = np.nonzero(alive)
    part, slack = part[i, j], slack[i, j]
    i, j = i + rows.start, j + cols.start
    for step in range(1, len(cuts)):
        if not len(i):
            break
        at = slice(cuts[step - 1], cuts[step])
        part = part + np.einsum("nd,nd->n", a.turned[i, at], c.turned[j, at])
        rest = a.rest[step][i] * c.rest[step][j] + slack
        good = want(i, j, part - rest, part + rest)
        i, j, part, slack = i[good], j[good], part[good], slack[good]
    return i, j, part


def verified(a: Side, c: Side, i: np.ndarray, j: np.ndarray, exact: bool, rows: slice, cols: slice, whole: bool) -> np.ndarray:
    """Integer products of pairs; of many in a tile by one product of the tile's vectors."""
    if not len(i):
        return np.zeros(0, np.int64)
    if not exact:
        score = np.array([products(c.real[y][None], a.real[x], False)[0] for x, y in zip(i, j, strict=True)], object)
        if any(abs(s) >= 1 << 63 for s in score):
            raise ValueError("a score that may be among those returned exceeds a long")
        return score.astype(np.int64)
    if whole:
        return (a.real[rows] @ c.real[cols].T)[i - rows.start, j - cols.start].astype(np.int64)
    return np.einsum("nd,nd->n", a.real[i], c.real[j]).astype(np.int64)


class Best:
    """The k highest scores of each place, ties to the smaller id, and the score that the next must reach."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        self.score, self.id = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64)
        self.filled = np.zeros(n, np.int64)
        self.need = np.full(n, -LARGEST) if floor is None else floor.copy()

    def add(self, place: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        # A tie with the last of k counts by its id.
        last, full = self.k - 1, self.filled[place] == self.k
        good = ~full | (score > self.score[place, last]) | ((score == self.score[place, last]) & (ids < self.id[place, last]))
        place, score, ids = place[good], score[good], ids[good]
        if not len(place):
            return
        touched = np.unique(place)
        old = np.arange(self.k)[None, :] < self.filled[touched][:, None]
        place = np.concatenate([np.repeat(touched, self.filled[touched]), place])
        score = np.concatenate([self.score[touched][old], score])
        ids = np.concatenate([self.id[touched][old], ids])
        order = np.lexsort((ids, -score, place))
        place, score, ids = place[order], score[order], ids[order]
        first = np.searchsorted(place, touched)
        rank = np.arange(len(place)) - np.repeat(first, np.diff(np.append(first, len(place))))
        good = rank < self.k
        place, rank = place[good], rank[good]
        self.score[place, rank], self.id[place, rank] = score[good], ids[good]
        self.filled[touched] = np.bincount(place, minlength=len(self.filled))[touched]
        full = touched[self.filled[touched] == self.k]
        self.need[full] = np.maximum(self.need[full], self.score[full, self.k - 1])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, id, score)."""
        held = np.arange(self.k)[None, :] < self.filled[:, None]
        return np.nonzero(held)[0], self.id[held], self.score[held]


def tiles(rows: int, cols: int) -> Iterator[tuple[slice, slice]]:
    for r in range(0, rows, TILE_ANCHORS):
        for c in range(0, cols, TILE_ROWS):
            yield slice(r, min(rows, r + TILE_ANCHORS)), slice(c, min(cols, c + TILE_ROWS))


def _sides(row: dict, turn: np.ndarray, cuts: list[int]) -> tuple[Side, Side, bool]:
    aids, am = unpacked(row["aids"], row["amatrix"], row["adim"])
    cids, cm = unpacked(row["ids"], row["matrix"], row["dim"])
    exact = float(np.abs(am).max(initial=0)) * float(np.abs(cm).max(initial=0)) * len(turn) < 2.0**53
    return Side(aids, np.frombuffer(row["alabels"], np.int64), am, turn, cuts), Side(cids, np.frombuffer(row["labels"], np.int64), cm, turn, cuts), exact


def find_positives(a: Side, c: Side, exact: bool, best: Best, cuts: list[int]) -> None:
    """Adds the cell's to the best of each anchor's own label."""

    def want(i: np.ndarray, j: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return high >= best.need[i]

    for label in np.intersect1d(a.labels, c.labels):
        # Both sides stand by label, so those of one label are a slice.
        a0, a1 = np.searchsorted(a.labels, [label, label + 1])
        c0, c1 = np.searchsorted(c.labels, [label, label + 1])
        for r, s in tiles(a1 - a0, c1 - c0):
            rows, cols = slice(r.start + a0, r.stop + a0), slice(s.start + c0, s.stop + c0)
            i, j, part = survivors(a, c, rows, cols, cuts, want)
            keep = a.ids[i] != c.ids[j]
            i, j = i[keep], j[keep]
            score = verified(a, c, i, j, exact, rows, cols, part is None)
            good = score >= best.need[i]
            best.add(i[good], score[good], c.ids[j[good]])


def find_negatives(a: Side, c: Side, exact: bool, most: np.ndarray, best: Best, cuts: list[int]) -> None:
    """Adds the cell's to the best of other labels in each band, whose places are those of the flattened table of bands.
    most is a table with an anchor a row and a positive a column; what a band has at least is the floor that best began
    with, above most for a band that isn't there."""
    p = most.shape[1]

    def want(i: np.ndarray, j: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        need, good = best.need.reshape(-1, p), np.zeros(low.shape, bool)
        for b in range(p):
            good |= (high >= need[i, b]) & (low <= most[i, b])
        return good

    for rows, cols in tiles(len(a.ids), len(c.ids)):
        other = a.labels[rows][:, None] != c.labels[cols][None, :]
        i, j, part = survivors(a, c, rows, cols, cuts, want, other)
        score = verified(a, c, i, j, exact, rows, cols, part is None)
        for b in range(p):
            good = (score >= best.need.reshape(-1, p)[i, b]) & (score <= most[i, b])
            best.add(i[good] * p + b, score[good], c.ids[j[good]])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _positives(turn: np.ndarray, k: int, cuts: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, Best]] = {}
        for row in _cells(batches):
            a, c, exact = _sides(row, turn, cuts)
            _, best = held.setdefault(row["ablock"], (a.ids, Best(len(a.ids), k)))
            find_positives(a, c, exact, best, cuts)
        for block, (ids, best) in held.items():
            place, found, score = best.rows()
            yield pa.RecordBatch.from_pydict({"ablock": np.full(len(place), block, np.int32), "anchor_id": ids[place], "vec_id": found, "score": score})

    return run


def bands(scores: list[list[int]], low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(least, most): the whole numbers s with low * positive <= 100 * s <= high * positive; least is above most where
    there are none."""
    p = max([1, *map(len, scores)])
    least, most = np.full((len(scores), p), LARGEST), np.full((len(scores), p), -LARGEST)
    for i, row in enumerate(scores):
        for b, s in enumerate(row):
            x, y = -(-low * s // 100), high * s // 100
            if x <= y:
                least[i, b], most[i, b] = x, y
    return least, most


def _negatives(turn: np.ndarray, low: int, high: int, k: int, cuts: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, list, np.ndarray, Best]] = {}
        for row in _cells(batches):
            a, c, exact = _sides(row, turn, cuts)
            if row["ablock"] not in held:
                positives = {x["anchor_id"]: x["own"] for x in row["positives"]}
                of = [positives.get(i, []) for i in a.ids.tolist()]
                least, most = bands([[x["score"] for x in own] for own in of], low, high)
                held[row["ablock"]] = a.ids, of, most, Best(least.size, k, least.ravel())
            _, _, most, best = held[row["ablock"]]
            find_negatives(a, c, exact, most, best, cuts)
        for ids, of, most, best in held.values():
            place, found, score = best.rows()
            p = most.shape[1]
            own = [of[x // p][x % p] for x in place.tolist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "anchor_id": ids[place // p],
                    "nth": pa.array(place % p, pa.int32()),
                    "positive_id": pa.array([x["vec_id"] for x in own], pa.int64()),
                    "positive_score": pa.array([x["score"] for x in own], pa.int64()),
                    "negative_id": found,
                    "negative_score": score,
                }
            )

    return run


def on_grid(anchors: DataFrame, candidates: DataFrame, ablocks: int) -> DataFrame:
    """Each block of anchors beside each block of candidates: a row per cell. A task holds a block of anchors and streams
    some files of candidates; the hint keeps Spark from broadcasting either side, whatever sizes it reckons with."""
    tasks = max(GRID_TASKS, 4 * candidates.sparkSession.sparkContext.defaultParallelism)
    a = anchors.repartitionByRange(ablocks, "ablock")
    c = candidates.select("dim", "ids", "labels", "matrix").coalesce(-(-tasks // ablocks))
    return c.crossJoin(a.hint("shuffle_replicate_nl"))


def hard_negatives(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, key: str = "vec_id", column: str = "embedding", label: Column | str = "label") -> DataFrame:
    """Anchors are the rows whose id is divisible by `every` -> (anchor_id, positive_id, rank int, negative_id,
    positive_score, negative_score). An anchor's positives are its `positives` best other ids of its label; a
    positive's negatives the `negatives` best of other labels with low * positive <= 100 * negative <= high * positive.
    Ties go to the smaller id. A positive without such negatives has no row.

    Rows with a null id or label, a null or empty vector, or a null or non-finite component take no part. Vectors of
    unequal length are padded with zeros; of rows that repeat an anchor's id the least vector asks, and none of them is its
    candidate; other repeated ids are candidates, and positives, each. An empty table gives no rows. A score beyond a long is an error."""
    spark = vectors.sparkSession
    labelled = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).alias("x"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"))
    rows = written(quantised(labelled.where("label is not null"), "id", "x", scale, "label"), "vectors")
    count = rows.count()
    asked = rows.where(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min(F.struct("v", "label")).alias("x")).select("id", "x.v", "x.label")
    anchors = written(packed(asked, ANCHOR_ROWS, asked.count()), "anchors")
    anchors = anchors.select(F.col("block").alias("ablock"), F.col("dim").alias("adim"), F.col("ids").alias("aids"), F.col("labels").alias("alabels"), F.col("matrix").alias("amatrix"))
    candidates = written(packed(rows, BLOCK_ROWS, count), "candidates")
    ends = anchors.agg(F.max("ablock")).first()[0]
    if ends is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    turn = rotation(candidates)
    cuts = sorted({max(1, round(len(turn) * s)) for s in STEPS} | {len(turn)})

    cells = on_grid(anchors, candidates, ends + 1)
    best = Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "vec_id")
    found = cells.mapInArrow(_positives(turn, positives, cuts), POSITIVES)
    found = written(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= positives), "positives")

    # An anchor's few positives go with its block of anchors.
    own = found.groupBy("ablock", "anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("own"))
    own = own.groupBy("ablock").agg(F.collect_list(F.struct("anchor_id", "own")).alias("positives"))
    cells = on_grid(anchors.join(own.hint("merge"), "ablock"), candidates, ends + 1)
    best = Window.partitionBy("anchor_id", "nth").orderBy(F.col("negative_score").desc(), "negative_id")
    out = cells.mapInArrow(_negatives(turn, low, high, negatives, cuts), NEGATIVES).withColumn("rank", F.row_number().over(best))
    out = out.where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return settled(out, "negatives", rows, candidates, found)
