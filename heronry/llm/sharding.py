"""Operator 10: sharding over fixed virtual slots.

Records are hashed into a fixed number of virtual slots, bytes and rows are summed per slot, and a
versioned slot-to-shard map is made from those sums and edited when the shards are to be rebalanced or
their number changes. Only the map is ever held in one place: it has as many rows as there are slots,
whatever the number of records, and so it is safe to broadcast.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .runtime import forgotten_at_exit, shared_dir

SLOTS = 4096
#: Bytes that each record costs beside its text.
RECORD_BYTES = 8

MAP = T.StructType(
    [
        T.StructField("version", T.IntegerType(), False),
        T.StructField("vslot", T.IntegerType(), False),
        T.StructField("shard", T.IntegerType(), False),
        T.StructField("first", T.LongType(), False),
        T.StructField("rows", T.LongType(), False),
        T.StructField("bytes", T.LongType(), False),
    ]
)


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """docs -> (doc_id, size, text_crc32, vslot), a row for each row. A null text has 0 bytes and the
    checksum of the empty string; a record without doc_id is placed by its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.md5(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.concat(F.lit("text:"), F.md5(text.cast("binary")))).cast("binary"))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(RECORD_BYTES)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        (F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % slots).cast("int").alias("vslot"),
    )


def slot_sums(records: DataFrame) -> DataFrame:
    """(vslot, rows, bytes): at most one row per virtual slot."""
    return records.groupBy("vslot").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


def _with_first(version: int, placed: list[tuple[int, int, int, int]]) -> list[tuple]:
    """Adds to (vslot, shard, rows, bytes) the first position of each slot in its shard."""
    out, at = [], {}
    for vslot, shard, rows, size in sorted(placed):
        out.append((version, vslot, shard, at.get(shard, 0), rows, size))
        at[shard] = at.get(shard, 0) + rows
    return out


def new_map(sums: list[tuple[int, int, int]], shards: int, version: int = 1) -> list[tuple]:
    """(vslot, rows, bytes) of each slot -> rows of MAP: the largest slots first, each to the shard with
    the fewest bytes so far; ties go to the smaller number."""
    heap = [(0, s) for s in range(shards)]
    placed = []
    for vslot, rows, size in sorted(sums, key=lambda x: (-x[2], x[0])):
        load, shard = heapq.heappop(heap)
        placed.append((vslot, shard, rows, size))
        heapq.heappush(heap, (load + size, shard))
    return _with_first(version, placed)


def rebalanced(old: list[tuple], sums: list[tuple[int, int, int]], shards: int, slack: float = 0.02) -> list[tuple]:
    """The next version of a map for new sums or another number of shards. Slots stay where they are,
    unless their shard is gone or has more than the mean and slack: then it gives up slots, the largest
    first, until it is down to the mean; they go to the shard with the fewest bytes."""
    version = max((x[0] for x in old), default=0) + 1
    where = {x[1]: x[2] for x in old}
    size_of = {v: (rows, size) for v, rows, size in sums}
    load = dict.fromkeys(range(shards), 0)
    held: dict[int, list[int]] = {s: [] for s in range(shards)}
    loose = []
    for v, (_, size) in size_of.items():
        if where.get(v, -1) in load:
            load[where[v]] += size
            held[where[v]].append(v)
        else:
            loose.append(v)
    most = sum(load.values()) + sum(size_of[v][1] for v in loose)
    mean = most / shards
    for s in range(shards):
        over = load[s] > mean * (1 + slack)
        for v in sorted(held[s], key=lambda v: (-size_of[v][1], v)):
            if over and load[s] > mean and load[s] - size_of[v][1] >= mean * (1 - slack):
                load[s] -= size_of[v][1]
                held[s].remove(v)
                loose.append(v)
    for v in sorted(loose, key=lambda v: (-size_of[v][1], v)):
        s = min(load, key=lambda s: (load[s], s))
        load[s] += size_of[v][1]
        held[s].append(v)
    return _with_first(version, [(v, s, *size_of[v]) for s, vs in held.items() for v in vs])


def map_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, MAP)


def store_map(spark: SparkSession, rows: list[tuple], path: str) -> None:
    """Adds a version of the map to the table at path; a version that is there is replaced."""
    for version in {x[0] for x in rows}:
        one = map_table(spark, [x for x in rows if x[0] == version]).drop("version")
        one.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> list[tuple]:
    """A stored version of the map, the latest if none is named."""
    table = spark.read.schema(MAP).parquet(path)
    latest = version if version is not None else table.agg(F.max("version")).first()[0]
    return [tuple(x) for x in table.where(F.col("version") == latest).select(*MAP.names).orderBy("vslot").collect()]


def placed(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Records with their shard and their position in it. Positions have no gaps: each slot's records
    are numbered inside the slot, from the slot's first position on. The map has SLOTS rows at most."""
    inside = Window.partitionBy("vslot").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size")
    joined = records.withColumn("inside", F.row_number().over(inside)).join(F.broadcast(slot_map.select("vslot", "shard", "first")), "vslot")
    return joined.withColumn("slot", (F.col("first") + F.col("inside") - 1).cast("long")).drop("first", "inside")


def shard(docs: DataFrame, shards: int = 24, slots: int = SLOTS) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot).

    Law `bytes`: a slot has a share of the records that is small beside a shard's, and slots are dealt by
    their bytes. Equal texts with different doc_ids are in different slots, so that a large group of
    copies doesn't fill one shard. An empty table gives an empty table; repeated rows are placed each."""
    spark, records = docs.sparkSession, sized(docs, slots)
    sums = [(x["vslot"], x["rows"], x["bytes"]) for x in slot_sums(records).collect()]  # a row per virtual slot
    path = f"{shared_dir(spark)}/shard-map-{uuid.uuid4().hex}"
    forgotten_at_exit(spark, path)
    store_map(spark, new_map(sums, shards), path)
    out = placed(records, map_table(spark, load_map(spark, path)) if sums else map_table(spark, []))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")
