"""Operator 3: mixing sources to target weights (native: DataFrame and SQL functions only).

Each source's records are put in an order that depends on the seed alone; its words are then one line, cut
into blocks of a fixed number of words. The blocks are permuted, anew for each pass over the line, and a
source's target is its exact quota of the permuted blocks (the last of them may be partial). A splitting tree
over the output shards deals the quotas: at each node a random subset of the node's blocks of the size of
the left half's share goes left, so that the numbers by source are a multivariate hypergeometric draw and
every quota is split exactly. A shard then draws, of each source, as many of the permuted blocks as the tree
gave it, next to those of the shard before: blocks are disjoint. In a shard the pieces of records are
shuffled: each has a place, a random number that depends on the seed.

Tables of one row per source or block are the only ones in a single task: at most BLOCKS blocks a pass, and
one per source. Sources are taken to be few (up to BROADCAST_SOURCES their plans are broadcast).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import settled, written

WEIGHTS = (3, 1, 2)
#: Rows that one bucket of a permuted line has in the mean.
BUCKET_ROWS, LEAST_BUCKETS = 20_000, 128
#: Blocks into which the whole mix is cut; where records stay whole, a block has that many mean records at least.
BLOCKS, RECORDS = 4096, 16
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    """Number of runs of bytes other than space and 0x09-0x0D; null has none."""
    flat = F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "))
    single = F.when(flat.contains("  "), F.regexp_replace(flat, " +", " ")).otherwise(flat)
    blanks = F.octet_length(single) - F.octet_length(F.replace(single, F.lit(" "), F.lit("")))
    return F.when(F.octet_length(flat) == 0, F.lit(0)).otherwise(blanks + 1).cast("long")


def row_key() -> Column:
    """Tells the rows of docs apart by doc_id, text and source; never null."""
    doc, source = F.col("doc_id").cast("long").cast("string"), F.concat(F.lit("="), F.col("source").cast("string"))
    return F.concat_ws(":", *[F.coalesce(x, F.lit("~")) for x in (doc, F.md5(F.col("text").cast("string").cast("binary")), source)])


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) -> with target. The total is share of all sizes, dealt by weight, no source
    over most of its size. A source is full if its limit is at most its weight times the common level;
    in the order of limit over weight the full ones come first, so sums over that order give the level."""
    ranked = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    by = Window.orderBy((F.col("limit") / F.col("weight")), "place")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = (
        ranked.withColumn("total", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("full_before", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    )
    ranked = ranked.withColumn("level", (F.col("total") - F.col("full_before")) / F.col("weight_left"))
    # The level at the first source that isn't full holds for it and for all after it.
    here = F.struct((F.col("limit") / F.col("weight")).alias("ratio"), "place", "level")
    open_level = F.min(F.when(F.col("limit") > F.col("weight") * F.col("level"), here)).over(whole)["level"]
    target = F.least("limit", F.coalesce(F.col("weight") * open_level, F.col("limit")))
    return ranked.select(*sizes.columns, target.alias("target"))


def name(*parts: Column | str | int) -> Column:
    """Sixteen random bytes in hex that depend on the parts alone."""
    return F.md5(F.concat_ws(":", *[F.lit(str(x)) if isinstance(x, int) else F.col(x).cast("string") if isinstance(x, str) else x for x in parts]))


#: Words that a chunk of a shard of mixed texts has at most, about; chunks of a shard at least.
CHUNK_WORDS, LEAST_CHUNKS = 1 << 21, 8


def unit(*parts: Column | str | int) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.conv(F.substring(name(*parts), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_name() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("~"))


def block_plan(aims: DataFrame, seed: int) -> DataFrame:
    """aims (source, source_size, quota, block, ...) -> with blocks in a row each: (pass, i, take, pos). The
    blocks of a pass are permuted; passes follow one another; take is what the quota takes of a block from its
    start, pos its place among those that are taken."""
    passes = F.greatest(F.lit(1), F.ceil(F.col("quota") / F.greatest(F.col("source_size"), F.lit(1)))).cast("int")
    number = F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.col("block"))).cast("long")
    rows = aims.withColumn("passes", passes).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), number - 1)))
    rows = rows.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    words = F.least(F.col("block"), F.col("source_size") - F.col("i") * F.col("block"))
    rows = rows.withColumn("words", words).withColumn("key", name(seed, F.lit("block"), source_name(), "pass", "i"))
    line = Window.partitionBy("source").orderBy("pass", "key", "i")
    rows = rows.withColumn("before", F.coalesce(F.sum("words").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    take = F.greatest(F.lit(0), F.least(F.col("words"), F.col("quota") - F.col("before"))).cast("long")
    return rows.withColumn("take", take).withColumn("pos", F.row_number().over(line) - 1).drop("key", "before", "words")


def split_quotas(blocks: DataFrame, shards: int, seed: int) -> DataFrame:
    """blocks (source, pos, take, ...) -> with lo: the splitting tree over shards [lo, hi). Of a node's N blocks
    its left half gets N * half / span, rounded at random; which ones is a uniform draw without return, so
    the numbers by source are a multivariate hypergeometric draw. Blocks of which nothing is taken take no part (lo null)."""
    real = F.col("take") > 0
    rows = blocks.withColumn("lo", F.when(real, F.lit(0))).withColumn("hi", F.when(real, F.lit(shards)))
    width = shards
    while width > 1:
        node = Window.partitionBy("lo", "hi")
        span, half = F.col("hi") - F.col("lo"), F.floor((F.col("hi") - F.col("lo")) / 2).cast("int")
        rows = rows.withColumn("total", F.count("*").over(node)).withColumn("drawn", F.row_number().over(node.orderBy(name(seed, "lo", "hi", source_name(), "pos"), "source", "pos")))
        left = F.col("drawn") <= F.floor(F.col("total") * half / span + unit(seed, "lo", "hi"))
        lo, hi = F.when((span > 1) & ~left, F.col("lo") + half).otherwise(F.col("lo")), F.when((span > 1) & left, F.col("lo") + half).otherwise(F.col("hi"))
        rows = rows.select(*[c for c in rows.columns if c not in ("lo", "hi", "total", "drawn")], lo.alias("lo"), hi.alias("hi"))
        width = -(-width // 2)
    return rows.drop("hi")


def permuted(rows: DataFrame, seed: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """rows (source, doc_id, size, row) with `offset`, the words before each in its source's order. The order
    is that of a hash; it is cut into buckets by the hash's leading bits, so that no task sorts more than a
    bucket of a source: sums of the buckets before, then sums inside the bucket. Rows without doc_id are placed
    by their key, and rows that repeat a doc_id are put in order by it."""
    buckets = max(LEAST_BUCKETS, rows.count() // bucket_rows)
    key = name(seed, F.coalesce(F.col("doc_id").cast("string"), F.col("row")))
    lead = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    keyed = rows.withColumn("key", key).withColumn("bucket", F.floor(lead * F.lit(buckets) / F.lit(1 << 32)).cast("long"))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "row", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return joined.withColumn("offset", (F.col("start") + F.col("within")).cast("long")).drop("s", "b", "start", "within", "bucket", "key")


def mix(docs: DataFrame, shards: int = 16, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, whole: bool = False) -> DataFrame:
    """docs (doc_id, text, source, ...) -> (doc_id, row, source, size, source_size, target, taken, pieces), a row
    for each row; row is its row_key. Pieces are (shard, pass, start, words, place): which words of the record
    go where, by pass; the rows of a shard in the order of place are shuffled.

    With whole, a record goes entire with the block that has its first word, as often as passes take that
    word; else a block's edge may cut a record, and a source's taken words are its target, rounded.
    A null or blank text has size 0 and takes nothing. Null is a source of its own, the last. A source
    without words has target 0. Repeated rows are records each. Reruns agree, whatever the partitions."""
    size = word_count(F.col("text").cast("string"))
    # Texts are read once; sums, order and pieces need ids and sizes only. Without whole, only rows without doc_id need their key.
    row = row_key() if whole else F.when(F.col("doc_id").isNull(), row_key())
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), row.alias("row"), F.col("source").cast("string").alias("source"), size.alias("size")), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("records")).coalesce(1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    least = F.ceil(F.lit(RECORDS) * F.sum("source_size").over(every) / F.sum("records").over(every)) if whole else F.lit(1)
    aims = targets(sizes.withColumn("least", least), weights, share, most).withColumn("quota", F.floor(F.col("target") + 0.5).cast("long"))
    aims = aims.withColumn("block", F.greatest(F.lit(1), F.col("least"), F.ceil(F.sum("quota").over(every) / F.lit(BLOCKS))).cast("long"))
    dealt = split_quotas(block_plan(aims, seed), shards, seed)
    # A source's permuted blocks in order beside the shards that its quota was dealt to, in order.
    plan = dealt.groupBy(F.col("source").alias("of"), "source_size", "target", "block", "passes").agg(
        F.sort_array(F.collect_list(F.struct("pos", "i", "pass", "take"))).alias("blocks"), F.sort_array(F.collect_list("lo")).alias("dealt")
    )
    pairs = F.zip_with("blocks", "dealt", lambda x, s: F.struct(x["i"].alias("i"), x["pass"].alias("pass"), s.alias("shard"), x["take"].alias("take")))
    stored = written(plan.select("of", "source_size", "target", "block", "passes", F.sort_array(pairs).alias("plan")), "plan")
    plan = F.broadcast(stored) if stored.count() <= BROADCAST_SOURCES else stored  # BLOCKS blocks a pass, and one per source
    line = permuted(rows, seed).join(plan, F.col("source").eqNullSafe(F.col("of"))).drop("of")

    def piece(e: Column) -> Column:
        x = F.col("plan")[e.cast("int")]
        begin = x["i"] * F.col("block")
        start = F.greatest(F.col("offset"), begin)
        words = F.least(F.col("offset") + F.col("size"), begin + x["take"]) - start
        if whole:
            words = F.when(F.col("offset") < begin + x["take"], F.col("size")).otherwise(F.lit(0))
            start = F.col("offset")
        place = unit(seed, F.lit("place"), x["shard"].cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.col("row")), x["pass"].cast("string"), x["i"].cast("string"))
        return F.struct(x["shard"].alias("shard"), x["pass"].alias("pass"), (start - F.col("offset")).alias("start"), words.cast("long").alias("words"), place.alias("place"))

    first = F.floor(F.col("offset") / F.col("block"))
    last = first if whole else F.floor((F.col("offset") + F.col("size") - 1) / F.col("block"))
    entries = F.sequence(first * F.col("passes"), last * F.col("passes") + F.col("passes") - 1)
    nothing = F.expr("cast(array() as array<struct<shard:int,pass:int,start:bigint,words:bigint,place:double>>)")
    pieces = F.when(F.col("size") > 0, F.sort_array(F.filter(F.transform(entries, piece), lambda x: x["words"] > 0))).otherwise(nothing)
    out = line.withColumn("pieces", pieces).withColumn("taken", F.aggregate("pieces", F.lit(0).cast("long"), lambda a, x: a + x["words"]))
    return settled(out.select("doc_id", "row", "source", "size", "source_size", "target", "taken", "pieces"), "mix", rows, stored)


def mixed_texts(docs: DataFrame, taken: DataFrame, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """One row of docs per pass that the mix takes of it, in mix(whole=True); columns of docs, dealt by shard and
    shuffled in it. A shard is sorted in as many chunks as its words ask for, so a task's share doesn't grow. Rows meet the mix by their row_key. The passes of rows that share one differ by one at
    most, so their sum is dealt out evenly, to shards at random."""
    sums = taken.agg(F.sum("taken").alias("words"), F.max(F.array_max(F.transform("pieces", lambda x: x["shard"]))).alias("last")).first()
    chunks = max(LEAST_CHUNKS, -(-(sums["words"] or 0) // (((sums["last"] or 0) + 1) * chunk_words)))
    times = taken.groupBy(F.col("row").alias("__of")).agg(F.count("*").alias("__rows"), F.sum(F.size("pieces")).alias("__times"), F.max("pieces").alias("__pieces")).where("__times > 0")
    joined = docs.withColumn("__row", row_key()).join(times, F.col("__row") == F.col("__of"))
    # All rows of a window are alike, so it needs no order but that of the join.
    joined = joined.withColumn("__nth", F.row_number().over(Window.partitionBy("__row").orderBy("__row")))
    own = F.expr("__times div __rows + if(__nth <= __times % __rows, 1, 0)")
    rows = joined.withColumn("__own", own).where("__own > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__own"))))
    mine = F.col("__pieces")[(F.col("__copy") - 1).cast("int") % F.size("__pieces")]
    place = F.when(F.col("__rows") == 1, mine["place"]).otherwise(unit(F.lit("copy"), "__row", "__nth", "__copy"))
    rows = rows.withColumn("__shard", mine["shard"]).withColumn("__place", place).withColumn("__chunk", F.floor(place * chunks))
    return rows.repartition("__shard", "__chunk").sortWithinPartitions("__shard", "__place").select(*docs.columns)
