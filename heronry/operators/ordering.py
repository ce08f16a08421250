"""Rows by their place in an order, without a task that sees them all.

Rows are dealt to ranges of the order, groups side by side, and written, a folder per range; a range knows how many
rows of each group it has, so a place in a group is a row of one range. Rows that tie with many others are dealt by a
number of their own as well, so no value has to fit in a task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heronry.session import forgotten, written

#: The number of a row holds its range above so many bits, and its place in the range.
BITS = 33


class Ordered(NamedTuple):
    """rows: the columns, `__at` (number of the row, which grows in order) and `__range`; runs: (by, __range, first, n,
    before): of each group's rows in a range the first number, how many they are, and how many of the group are in earlier
    ranges. A table of ranges and groups, not of rows."""

    rows: DataFrame
    runs: DataFrame
    by: list[str]

    def dropped(self) -> None:
        forgotten(self.rows)

    def counts(self) -> DataFrame:
        """(by, n) of each group."""
        return self.runs.groupBy(*self.by).agg(F.sum("n").alias("n"))

    def at(self, wanted: DataFrame, place: str) -> DataFrame:
        """wanted (by, place, ..) with the columns of the row at that place of the group, counted from 0. Only rows that
        are wanted are sent on."""
        runs = self.runs.select("__range", *[F.col(c).alias(f"__{c}") for c in [*self.by, "first", "n", "before"]])
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in self.by], F.lit(True))
        found = wanted.join(runs, same & (F.col(place) >= F.col("__before")) & (F.col(place) < F.col("__before") + F.col("__n")))
        found = found.withColumn("__at", F.col("__first") + F.col(place) - F.col("__before")).drop(*[f"__{c}" for c in [*self.by, "first", "n", "before"]])
        return found.join(self.rows.drop(*self.by), ["__range", "__at"]).drop("__range", "__at")

    def page(self, offset: int, limit: int) -> DataFrame:
        """Rows of one group from a place on, with `cursor`, by which the next page goes on. Only the ranges that hold them
        are read."""
        ends = (F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset)
        parts = [(r["__range"], r["first"] + max(0, offset - r["before"]), r["first"] + min(r["n"], offset + limit - r["before"])) for r in self.runs.where(ends).collect()]
        return self._read(parts)

    def after(self, cursor: int, limit: int) -> DataFrame:
        """The rows that follow a page's last cursor."""
        here = self.runs.where((F.col("first") <= cursor) & (F.col("first") + F.col("n") > cursor)).first()
        return self.page(here["before"] + cursor - here["first"] + 1, limit) if here else self._read([])

    def _read(self, parts: list[tuple[int, int, int]]) -> DataFrame:
        inside = [(F.col("__range") == p) & (F.col("__at") >= a) & (F.col("__at") < z) for p, a, z in parts]
        found = self.rows.where(reduce(lambda a, b: a | b, inside, F.lit(False)))
        return found.orderBy("__at").withColumnRenamed("__at", "cursor").drop("__range")


def ordered(rows: DataFrame, order: Sequence[Column], by: Sequence[str] = ()) -> Ordered:
    """rows in an order, within the groups of `by`, written to the shared folder. Null groups are a group; an empty table has
    no ranges. With no `by` the rows are one group."""
    keys = [F.col(c) for c in by] + list(order) + [F.col("__tie")]
    dealt = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie")
    dealt = dealt.withColumn("__at", F.monotonically_increasing_id()).withColumn("__range", F.shiftright("__at", BITS).cast("int"))
    table = written(dealt, "ordered", ["__range"])
    runs = table.groupBy(*by, "__range").agg(F.min("__at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    return Ordered(table, runs.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), list(by))
