"""Term statistics per scope and source, kept as a table that sums up.

A row (scope, source, term, docs, tokens) counts the documents of a source in a scope that have the term, and its
occurrences; with a null term, all documents and all kept tokens. Rows of sources add up to those of their scopes,
so a scope's statistics follow from the table without its texts. On disk a source is a folder: one that comes again
replaces its folder, one that goes is a folder less, and no other text or row is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.operators.retrieval import best_of, bm25_weight, exploded, idf, term_counts, token_rows
from heronry.session import removed, written
from heronry.sources.sinks import upsert

COLUMNS = ["scope", "source", "term", "docs", "tokens"]


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs (scope, source, text) -> COLUMNS. A null text has no tokens but is a document; null scopes and sources are
    groups of their own."""
    t = term_counts(docs, ["scope", "source"], text)
    # A document's distinct terms, and null for itself, each with its occurrences.
    whole = F.array(F.struct(F.lit(None).cast("string").alias("terms"), F.col("dl").alias("tfs")))
    rows = t.select("scope", "source", F.explode(F.concat(F.arrays_zip("terms", "tfs"), whole)).alias("x"))
    return rows.groupBy("scope", "source", F.col("x.terms").alias("term")).agg(F.count("*").alias("docs"), F.sum("x.tfs").alias("tokens"))


def summed(stats: DataFrame, by: str) -> DataFrame:
    """(by, term, docs, tokens): the statistics of each scope or source."""
    return stats.groupBy(by, "term").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


def weighed(stats: DataFrame, by: str) -> DataFrame:
    """(by, term, df, n, avgdl, idf) of each scope or source."""
    rows = summed(stats, by)
    # A row per scope or source; a null one meets itself.
    sizes = rows.where("term is null").select(F.col(by).alias("__by"), F.col("docs").alias("n"), (F.col("tokens") / F.greatest("docs", F.lit(1))).alias("avgdl"))
    out = rows.where("term is not null").join(sizes, F.col(by).eqNullSafe(F.col("__by"))).drop("__by")
    return out.select(by, "term", F.col("docs").alias("df"), "n", "avgdl", idf(F.col("n"), F.col("docs")).alias("idf"))


def merged(stats: DataFrame, fresh: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """stats with the sources of fresh (COLUMNS) in place of what they had, and without those of gone (source)."""
    out = fresh.select("source").distinct()
    out = out.unionByName(gone.select("source").distinct()).distinct() if gone is not None else out
    out = out.withColumnRenamed("source", "__source")
    return stats.join(out, F.col("source").eqNullSafe(F.col("__source")), "left_anti").select(*COLUMNS).unionByName(fresh.select(*COLUMNS))


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The statistics under path."""
    return spark.read.schema("scope string, term string, docs long, tokens long, source string").parquet(path).select(*COLUMNS)


def arrived(docs: DataFrame, path: str) -> None:
    """Counts the documents of one or more whole sources, and puts them in place of what these sources had."""
    upsert(counted(docs).repartition("source"), path, ["source"])


def departed(spark: SparkSession, path: str, sources: list[str]) -> None:
    """Takes sources off."""
    for source in sources:
        removed(spark, f"{path}/source={source}")


def scoped_search(docs: DataFrame, stats: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", query: str = "item_id", text: str = "text") -> DataFrame:
    """queries (query, text, scope) over docs (key, text, scope, source) -> (query, key, score, rank). A document's terms
    weigh by the statistics of its source, a question's by those of its scope; only documents of that scope are found.
    A question's term that its scope lacks counts nothing."""
    source, scope = weighed(stats, "source"), weighed(stats, "scope")
    # A scope's terms are told apart from another's by its name.
    named = F.concat_ws("\x00", "scope", "term")
    asked = token_rows(queries.select(query, "text"), query, "text").where("term is not null").join(queries.select(query, "scope"), query)
    asked = asked.join(scope, ["scope", "term"])
    asked = written(asked.select(query, "scope", "term", bm25_weight(F.col("tf"), F.col("dl"), F.col("n"), F.col("avgdl"), F.col("df")).alias("own")), "scoped")
    rows = exploded(term_counts(docs, [key, "scope", "source"], text), key, "scope", "source", "dl")
    rows = rows.join(asked.select("scope", "term").distinct(), ["scope", "term"], "left_semi").join(source, ["source", "term"])
    weight = bm25_weight(F.col("tf"), F.col("dl"), F.col("n"), F.col("avgdl"), F.col("df"))
    rows = rows.groupBy(F.col(key).alias("key")).agg(F.collect_list(F.struct(named.alias("term"), weight.alias("weight"))).alias("x"))
    rows = rows.select("key", F.col("x.term").alias("terms"), F.col("x.weight").alias("weights"))
    return best_of(rows, asked.select(query, named.alias("term"), "own"), k, key, query)
