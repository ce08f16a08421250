"""Hash trees over the rows of groups, kept as a table and compared from the root down.

A row belongs to a leaf by the hash of its key. A leaf's digest is a pair of sums over its rows' hashes, modulo 2 ** 64
each, so rows that change are taken off and put in without the others; a node's digest is that of its children,
and a root's fingerprint that of its nodes. Two trees are compared a level at a time, below differing nodes only, and
of the rows only those of differing leaves are looked at. The sums tell accidents, not forgeries: for those there is
events.fingerprint."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronry.session import written

#: Children of the root, and of each of them.
ROOTS, LEAVES = 64, 64
SUM = "decimal(38,0)"


def leaf_of(key: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(17), key), F.lit(ROOTS * LEAVES)).cast("int")


def _hash(seed: int, columns: list[str]) -> Column:
    # Nulls are marked, as a hash of columns skips them.
    return F.xxhash64(F.lit(seed), *[x for c in columns for x in (F.col(c).isNull(), F.col(c))])


def leaves(rows: DataFrame, key: str, columns: list[str], groups: list[str]) -> DataFrame:
    """(groups, leaf, n, a, b): the leaves of rows; columns are those that count, the key's among them or not."""
    own = [key, *[c for c in columns if c != key]]
    hashed = rows.select(*groups, leaf_of(key).alias("leaf"), _hash(1, own).cast(SUM).alias("x"), _hash(2, own).cast(SUM).alias("y"))
    whole = lambda c: F.pmod(F.sum(c), F.lit(str(2**64)).cast(SUM)).cast(SUM)
    return hashed.groupBy(*groups, "leaf").agg(F.count("*").alias("n"), whole("x").alias("a"), whole("y").alias("b"))


def updated(tree: DataFrame, gone: DataFrame, come: DataFrame, key: str, columns: list[str], groups: list[str]) -> DataFrame:
    """The leaves of a table after rows have gone and others have come (a changed row does both): only those rows are
    hashed."""
    old = leaves(gone, key, columns, groups).select(*groups, "leaf", (-F.col("n")).alias("n"), (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))
    every = tree.select(*groups, "leaf", "n", "a", "b").unionByName(old).unionByName(leaves(come, key, columns, groups))
    whole = lambda c: F.pmod(F.sum(c), F.lit(str(2**64)).cast(SUM)).cast(SUM)
    return every.groupBy(*groups, "leaf").agg(F.sum("n").alias("n"), whole("a").alias("a"), whole("b").alias("b")).where("n <> 0 or a <> 0 or b <> 0")


def _above(nodes: DataFrame, groups: list[str], node: Column) -> DataFrame:
    """(groups, node, digest): nodes (groups, child, digest) by what is above them; at most 64 children each."""
    lists = nodes.groupBy(*groups, node.alias("node")).agg(F.array_sort(F.collect_list(F.struct("child", "digest"))).alias("l"))
    return lists.select(*groups, "node", F.sha2(F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["child"].cast("string"), x["digest"])), ","), 256).alias("digest"))


def nodes(tree: DataFrame, groups: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(roots, inner nodes, leaves) of a tree, each (groups, node, digest)."""
    low = tree.select(*groups, F.col("leaf").alias("node"), F.concat_ws("|", *[F.col(c).cast("string") for c in ("n", "a", "b")]).alias("digest"))
    inner = _above(low.withColumnRenamed("node", "child"), groups, F.expr(f"child div {LEAVES}").cast("int"))
    root = _above(inner.withColumnRenamed("node", "child"), groups, F.lit(0))
    return root, inner, low


def fingerprints(tree: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, fingerprint)."""
    return nodes(tree, groups)[0].select(*groups, F.col("digest").alias("fingerprint"))


def _differing(a: DataFrame, b: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, node) whose digests differ, or that only one side has."""
    keys = [*groups, "node"]
    other = b.select(*[F.col(c).alias(f"__{c}") for c in keys], F.col("digest").alias("__digest"))
    both = a.join(other, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]), "full").where(~F.col("digest").eqNullSafe(F.col("__digest")))
    return both.select(*[F.when(F.col("digest").isNull(), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in keys])


def _under(level: DataFrame, parents: DataFrame, groups: list[str], parent: Column) -> DataFrame:
    keys = parents.select(*[F.col(c).alias(f"__{c}") for c in groups], F.col("node").alias("__node"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in groups], parent == F.col("__node"))
    return level.join(keys, same, "left_semi")


def differing_leaves(a: DataFrame, b: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, leaf) in which the trees differ: roots first, then what is below those that do."""
    (ra, ia, la), (rb, ib, lb) = nodes(a, groups), nodes(b, groups)
    root = _differing(ra, rb, groups)
    inner = _differing(*[_under(x, root, groups, F.lit(0)) for x in (ia, ib)], groups)
    down = F.expr(f"node div {LEAVES}").cast("int")
    return _differing(*[_under(x, inner, groups, down) for x in (la, lb)], groups).withColumnRenamed("node", "leaf")


def registered(rows: DataFrame, key: str) -> DataFrame:
    """rows as a stored table with their leaf, in a folder for each node above."""
    dealt = rows.withColumn("leaf", leaf_of(key)).withColumn("branch", F.expr(f"leaf div {LEAVES}").cast("int"))
    return written(dealt.repartition("branch").sortWithinPartitions("leaf"), "registered", ["branch"])


def drift(stored: DataFrame, now: DataFrame, tree: DataFrame, key: str, columns: list[str], groups: list[str]) -> DataFrame:
    """(groups, key, drift): rows of `now` that stored lacks (missing), that only it has (unexpected), or that differ
    (changed). stored is what `registered` wrote, tree the leaves of it; keys are unique in a group. Only the folders of
    differing leaves are read, and rows of these leaves: their numbers, at most 4096, go to the driver."""
    sums = written(leaves(now, key, columns, groups), "leaves")  # a level at a time is read of both
    bad = differing_leaves(written(tree, "leaves"), sums, groups)
    numbers = [r["leaf"] for r in bad.select("leaf").distinct().collect()]
    inside = F.col("branch").isin(sorted({n // LEAVES for n in numbers})) & F.col("leaf").isin(numbers)
    was = stored.where(inside).select(*groups, key, F.struct(*columns).alias("was"))
    new = now.where(leaf_of(key).isin(numbers)).select(*[F.col(c).alias(f"__{c}") for c in [*groups, key]], F.struct(*columns).alias("now"))
    both = was.join(new, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in [*groups, key]]), "full").where(~F.col("was").eqNullSafe(F.col("now")))
    found = F.when(F.col("was").isNull(), "missing").when(F.col("now").isNull(), "unexpected").otherwise("changed")
    return both.select(*[F.when(F.col("was").isNull(), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in [*groups, key]], found.alias("drift"))
