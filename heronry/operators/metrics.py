"""Operational counts, distributions, percentiles and retrieval quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heronry.operators.ordering import ordered

EDGES = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)


def in_window(ts: str, start: str, end: str) -> Column:
    """Half-open."""
    return (F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < F.lit(end).cast("timestamp_ntz"))


def percentiles(rows: DataFrame, by: list[str], value: str, points: dict[str, float], half_even: bool = False) -> DataFrame:
    """Exact, linearly interpolated; rounded half to even if asked. A group without values has nulls. The two values that a
    point lies between are read by their places, so no group's values are gathered."""
    place = ordered(rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("__v")), [F.col("__v")], by)
    names = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, p in points.items()])
    asked = place.counts().select(*by, "n", F.explode(names).alias("x"))
    asked = asked.select(*by, F.col("x.name").alias("name"), ((F.col("n") - 1) * F.col("x.p")).alias("exact"))
    ends = F.array_distinct(F.array(F.floor("exact"), F.ceil("exact")))
    found = place.at(asked.select(*by, "name", "exact", F.explode(ends).alias("place")), "place")
    share = F.col("exact") - F.floor("exact")
    low, high = F.min("__v").cast("double"), F.max("__v").cast("double")
    lines = found.groupBy(*by, "name", "exact").agg(low.alias("low"), high.alias("high")).select(*by, "name", (F.col("low") + (F.col("high") - F.col("low")) * share).alias("x"))
    whole = rows.select(*by, F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("x")).distinct()  # groups of nulls only
    out = lines.unionByName(whole).groupBy(*by).agg(*[F.max(F.when(F.col("name") == n, F.col("x"))).alias(n) for n in points])
    return out.withColumns({n: F.bround(n, 0).cast("long") for n in points}) if half_even else out


def upper_median(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Element n div 2 of each group in order, nulls first."""
    place = ordered(rows.select(*by, F.col(value).alias("p50")), [F.col("p50").asc_nulls_first()], by)
    return place.at(place.counts().select(*by, "n", F.expr("n div 2").alias("place")), "place").select(*by, "p50", "n")


def bucket(value: Column) -> Column:
    """Histogram bucket by comparison: half-open, below the first edge in the first, from the last inner edge
    on in the last."""
    out = F.when(value < EDGES[1], 0)
    for i in range(2, len(EDGES) - 1):
        out = out.when(value < EDGES[i], i - 1)
    return out.otherwise(len(EDGES) - 2)


def vocabulary_counts(rows: DataFrame, columns: dict[str, tuple[str, ...]]) -> DataFrame:
    """(field, value, n): counts over closed vocabularies, what isn't in one as 'other'. One pass: a sum per
    value, then one row per value."""
    sums, names = [], []
    for c, values in columns.items():
        for v in values:
            sums.append(F.count_if(F.col(c) == v).alias(f"{c}|{v}"))
            names.append((c, v))
        sums.append(F.count_if(~F.col(c).isin(*values) | F.col(c).isNull()).alias(f"{c}|other"))
        names.append((c, "other"))
    one = rows.agg(*sums)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.lit(v).alias("value"), F.col(f"`{c}|{v}`").alias("n")) for c, v in names]))
    return one.select(cells.alias("x")).select("x.*")


def quality(truth: DataFrame, ranked: DataFrame, k: int, query: str = "item_id", key: str = "doc_id") -> DataFrame:
    """Per query of truth (query, key; a null key for none expected): recall@k, reciprocal rank over the whole
    list, nDCG@k with repeated hits counted again. Nothing expected counts as recall 1."""
    expected = truth.where(F.col(key).isNotNull()).distinct()
    hits = ranked.join(expected, [query, key], "left_semi")
    got = hits.groupBy(query).agg(
        F.countDistinct(F.when(F.col("rank") <= k, F.col(key))).alias("found"),
        F.min("rank").alias("first"),
        F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1))).alias("dcg"),
    )
    base = truth.groupBy(query).agg(F.countDistinct(key).alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    rows = base.join(got, query, "left")
    return rows.select(
        query,
        F.when(F.col("n") == 0, 1.0).otherwise(F.coalesce("found", F.lit(0)) / F.col("n")).alias("recall"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.when(F.col("n") == 0, 1.0).otherwise(F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"),
    )


def relative_change(new: Column, old: Column) -> Column:
    """In percent; 0 for a base of 0."""
    return F.when(old == 0, 0.0).otherwise((new - old) / old * 100)
