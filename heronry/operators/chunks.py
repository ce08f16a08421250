"""Chunkers over text columns, as plans where the rules allow it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType
from pyspark.sql.window import Window

MOST_TOKENS = 1024


def paragraphs(docs: DataFrame, key: str, text: str, blank: str = "^\\s*$") -> DataFrame:
    """(key, paragraph, start_line, end_line, content): runs of lines that don't match `blank`."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("i", "line"))
    order = Window.partitionBy(key).orderBy("i")
    lines = lines.withColumn("gap", F.sum(F.col("line").rlike(blank).cast("int")).over(order))
    rows = lines.where(~F.col("line").rlike(blank)).groupBy(key, "gap").agg(
        (F.min("i") + 1).alias("start_line"), (F.max("i") + 1).alias("end_line"), F.array_sort(F.collect_list(F.struct("i", "line"))).alias("l")
    )
    number = F.row_number().over(Window.partitionBy(key).orderBy("start_line"))
    return rows.select(key, number.alias("paragraph"), "start_line", "end_line", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("content"))


def sentences(text: Column) -> Column:
    """Sentences by Latin and ideographic end marks, with their marks."""
    marked = F.regexp_replace(text, "([.!?])\\s+|([。！？；])", "$1$2\u0000")
    return F.filter(F.split(marked, "\u0000"), lambda s: F.trim(s) != "")


def cuts_of(sizes: np.ndarray, most: int) -> list[int]:
    """Where packs of items start: a pack takes what fits into `most`, but one item at least. The next start is found by
    binary search in the running sums."""
    ends, out, at = np.cumsum(sizes), [], 0
    while at < len(sizes):
        out.append(at)
        at = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
    return out


@F.pandas_udf(ArrayType(StringType()))
def greedy_packs(items: pd.Series, sizes: pd.Series, most: pd.Series, between: pd.Series) -> pd.Series:
    """Texts packed by cuts_of, each pack joined."""

    def packs(said: np.ndarray, size: np.ndarray, m: int, by: str) -> list[str]:
        cuts = [*cuts_of(np.asarray(size, np.int64), m), len(said)]
        return [by.join(said[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]

    return pd.Series([packs(*x) for x in zip(items, sizes, most, between, strict=True)])


def packed_sentences(text: Column, most: int = MOST_TOKENS) -> Column:
    """Sentences joined as long as they have up to `most` words; a longer one stands alone. A null text has none. A text
    takes time in proportion to its length."""
    said = F.coalesce(sentences(text), F.array().cast("array<string>"))
    return greedy_packs(said, F.transform(said, lambda s: F.size(F.split(F.trim(s), "\\s+"))), F.lit(most), F.lit(" "))


def row_windows(rows: DataFrame, sheet: str, order: str, line: Column, header: str, size: int = 50) -> DataFrame:
    """(sheet, window, n, content): windows of `size` rows of each sheet, under the header."""
    n = F.row_number().over(Window.partitionBy(sheet).orderBy(order))
    cut = rows.select(sheet, F.col(order).alias("__o"), line.alias("__l"), F.floor((n - 1) / size).cast("long").alias("window"))
    g = cut.groupBy(sheet, "window").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("__o", "__l"))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["__l"]), "\n")
    return g.select(sheet, "window", "n", F.concat(F.lit(header + "\n"), body).alias("content"))


def parents(chunks: DataFrame, doc: str, path: str, parent: str, key: str) -> DataFrame:
    """Adds parent_id: the last chunk of the document with the parent's path; not itself."""
    by_path = chunks.where(F.col(path) != "").groupBy(doc, F.col(path).alias("__p")).agg(F.max(key).alias("parent_id"))
    out = chunks.join(by_path, [F.col(parent) == F.col("__p"), chunks[doc] == by_path[doc]], "left").drop(by_path[doc]).drop("__p")
    return out.withColumn("parent_id", F.when(F.col("parent_id") != F.col(key), F.col("parent_id")))
