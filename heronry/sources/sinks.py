"""Writers: partitioned tables, revisions behind a pointer, rendered file trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.operators.events import fingerprint
from heronry.session import forgotten, written


def upsert(rows: DataFrame, path: str, partitions: list[str]) -> None:
    """Replaces the partitions that rows touch and no others; writing the same rows again changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def appended(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def one_dimension(vectors: DataFrame, column: str = "embedding") -> int:
    """The dimension of all vectors; an error if there are several."""
    found = [x[0] for x in vectors.select(F.size(column)).distinct().limit(2).collect()]
    if len(found) > 1:
        raise ValueError(f"vectors of different dimensions: {sorted(found)}")
    return found[0] if found else 0


def published(rows: DataFrame, base: str, revision: int, columns: list[str]) -> str:
    """Writes a revision, reads it back, compares its fingerprint with that of rows as they were written, and only then adds
    it to the pointer table. rows are evaluated once: both come from what was staged."""
    spark = rows.sparkSession
    path = f"{base}/revision={revision}"
    staged = written(rows, "staged")
    staged.write.mode("overwrite").parquet(path)
    one = F.lit("all").alias("g")
    a, b = (fingerprint(df.select("*", one), columns, ["g"]).first() for df in (staged, spark.read.parquet(path)))
    forgotten(staged)
    if a != b:
        raise RuntimeError("what was written differs from what was to be written")
    digest = a["fingerprint"] if a else ""
    spark.createDataFrame([(revision, digest)], "revision long, fingerprint string").coalesce(1).write.mode("append").parquet(f"{base}/pointer")
    return path


def manifest(spark: SparkSession, projections: dict[str, DataFrame]) -> DataFrame:
    """Writes each projection once, reads it back, and lists (name, n, matches_replay): whether the rows on disk are those
    that the projection gives when it is made again."""
    out = []
    for name, rows in projections.items():
        stored = written(rows, f"projection-{name}")
        state = [F.count("*").alias("n"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).alias("h")]
        a, b = stored.agg(*state).first(), rows.agg(*state).first()
        out.append((name, a["n"], a == b))
    return spark.createDataFrame(out, "name string, n long, matches_replay boolean")


def current(spark: SparkSession, base: str) -> DataFrame:
    """The newest revision that the pointer table names."""
    latest = spark.read.parquet(f"{base}/pointer").agg(F.max("revision")).first()[0]
    return spark.read.parquet(f"{base}/revision={latest}")


def file_tree(entries: DataFrame) -> DataFrame:
    """(path, text, sha256) of the rendered tree: a file per entry by scope and kind, an index per scope with
    month headings, and a digest."""
    month = F.coalesce(F.date_format("observed_at", "yyyy-MM"), F.lit("undated"))
    e = entries.withColumn("month", month).withColumn("branch", F.concat_ws("/", F.col("scope_id").cast("string"), "kind"))
    name = F.concat(F.col("branch"), F.lit("/"), F.col("memory_id").cast("string"), F.lit(".md"))
    name = F.when(F.col("retention_stage") == "archived", F.concat(F.lit("archives/"), name)).otherwise(name)
    head = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("id: "), F.col("memory_id").cast("string")), F.concat(F.lit("status: "), F.col("status")), F.lit("---"), F.lit(""))
    files = e.select(name.alias("path"), F.concat(head, F.col("content"), F.lit("\n")).alias("text"))
    line = F.struct("month", "memory_id", F.concat(F.lit("- "), name).alias("l"))
    lists = e.groupBy("scope_id", "month").agg(F.array_sort(F.collect_list(line)).alias("l"))
    part = F.concat(F.lit("## "), F.col("month"), F.lit("\n"), F.array_join(F.transform("l", lambda x: x["l"]), "\n"))
    index = lists.groupBy("scope_id").agg(F.array_sort(F.collect_list(F.struct("month", part.alias("p")))).alias("l"))
    index = index.select(F.concat(F.col("scope_id").cast("string"), F.lit("/INDEX.md")).alias("path"), F.concat(F.array_join(F.transform("l", lambda x: x["p"]), "\n"), F.lit("\n")).alias("text"))
    digest = e.groupBy("branch").agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.concat_ws(": ", "branch", F.col("n").cast("string")))).alias("l"))
    digest = digest.select(F.lit("DIGEST.md").alias("path"), F.concat(F.array_join("l", "\n"), F.lit("\n")).alias("text"))
    return files.unionByName(index).unionByName(digest).withColumn("sha256", F.sha2("text", 256))


def drop_tables(tables: dict[str, DataFrame], gone: DataFrame, on: dict[str, str]) -> dict[str, DataFrame]:
    """Each table without the rows whose column on[name] is in gone (id)."""
    return {name: df.join(gone.select(F.col("id").alias(on[name])).distinct(), on[name], "left_anti") for name, df in tables.items()}
