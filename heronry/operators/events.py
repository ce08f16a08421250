"""Event log folds, temporal visibility, recall and budgets.

The log is (event_id, kind, aggregate_id, scope_id, ts, ...), ordered by event_id. Folds are set-based:
windows per aggregate instead of a loop over events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STAGES = {"active": "compressed", "compressed": "archived", "archived": "tombstone"}


def days_between(a: Column | str, b: Column | str) -> Column:
    """b - a in days; works on timestamps without zone."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.timestamp_diff("MICROSECOND", a, b) / F.lit(8.64e10)


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def replay(log: DataFrame, upto: int | None = None, archived: DataFrame | None = None) -> DataFrame:
    """The log up to an event, without archived events (event_id)."""
    out = log.where(F.col("event_id") <= upto) if upto is not None else log
    return out.join(archived, "event_id", "left_anti") if archived is not None else out


def reduced_entries(log: DataFrame) -> DataFrame:
    """Entries of a log without rollbacks: asserts and revisions create an entry each; a revision closes the
    entry created before it in its aggregate; a retract retires the one created last before it."""
    order = Window.partitionBy("aggregate_id").orderBy("event_id")
    made = log.where("kind in ('assert', 'revise', 'retract')")
    current = F.last(F.when(F.col("kind") != "retract", F.col("event_id")), ignorenulls=True)
    made = made.withColumn("target", current.over(order.rowsBetween(Window.unboundedPreceding, -1)))
    created = made.where("kind <> 'retract'").withColumn("next_kind", F.lead("kind").over(order)).withColumn("next_id", F.lead("event_id").over(order)).withColumn("next_ts", F.lead("ts").over(order))
    gone = made.where("kind = 'retract' and target is not null").groupBy(F.col("target").alias("event_id")).agg(F.max("ts").alias("gone_at"))
    rows = created.join(gone, "event_id", "left")
    revised = F.col("next_kind") == "revise"
    return rows.select(
        F.col("event_id").alias("memory_id"), "aggregate_id", "scope_id",
        F.when(F.col("gone_at").isNotNull(), "retired").when(revised, "superseded").otherwise("active").alias("status"),
        F.when(F.col("gone_at").isNotNull(), "tombstone").otherwise("active").alias("retention_stage"),
        F.col("ts").alias("valid_from"),
        F.coalesce("gone_at", F.when(revised, F.col("next_ts"))).alias("valid_to"),
        F.when(revised, F.col("next_id")).alias("superseded_by"),
        F.when(F.col("kind") == "revise", F.col("target")).alias("supersedes"),
    )


def salience(log: DataFrame, beta: float = 0.05) -> DataFrame:
    """Per aggregate s = max(0, s - beta * days + 1) over its accesses: the running sum of the steps less its
    running minimum, where that is under 0."""
    order = Window.partitionBy("aggregate_id").orderBy("event_id")
    rows = log.where("kind = 'access'").withColumn("age", F.coalesce(days_between(F.lag("ts").over(order), F.col("ts")), F.lit(0.0)))
    rows = rows.withColumn("c", F.sum(1 - beta * F.col("age")).over(order))
    rows = rows.withColumn("s", F.col("c") - F.least(F.lit(0.0), F.min("c").over(order)))
    return rows.groupBy("aggregate_id").agg(F.max_by("s", "event_id").alias("salience"), F.count("*").alias("access_count"), F.max("ts").alias("last_access_at"))


def signal(s: Column, last: Column, now: Column, beta: float) -> Column:
    return F.greatest(F.lit(0.0), s - beta * days_between(last, now)) if beta > 0 else F.lit(0.0)


def rolled_back(log: DataFrame, point: int, at: Column) -> DataFrame:
    """Entries after a rollback to an event: the state then; what came later is retired."""
    now, then = reduced_entries(log), reduced_entries(replay(log, point))
    now = now.select("memory_id", F.col("status").alias("now_status"))
    both = now.join(then.select("memory_id", "status", "retention_stage", "valid_to"), "memory_id", "full")
    kept = F.col("status").isNotNull()
    return both.select(
        "memory_id", F.coalesce("status", F.lit("retired")).alias("status"), F.coalesce("retention_stage", F.lit("tombstone")).alias("retention_stage"),
        F.when(kept, F.col("valid_to")).otherwise(at).alias("valid_to"),
    )


def visible(now: Column, point: Column | None = None, include_superseded: bool = False) -> Column:
    """Whether an entry can be recalled. An archived one only by a past point; the validity interval is
    half-open and holds for active entries and always at a point; expiry is exclusive."""
    at = point if point is not None else now
    ok = F.col("status").isin("active", "superseded") if include_superseded else F.col("status") == "active"
    if point is None:
        ok &= F.coalesce(F.col("retention_stage") != "archived", F.lit(True))
    inside = (F.col("valid_from").isNull() | (at >= F.col("valid_from"))) & (F.col("valid_to").isNull() | (at < F.col("valid_to")))
    checked = inside if point is not None else inside | (F.col("status") != "active")
    return ok & checked & (F.col("expires_at").isNull() | (at < F.col("expires_at")))


def attachable(now: Column) -> Column:
    return (
        (F.col("status") == "active") & (F.col("retention_stage") == "active") & F.col("valid_to").isNull() & F.col("observed_at").isNotNull()
        & (F.col("expires_at").isNull() | (F.col("expires_at") > now))
    )


def anchored() -> Column:
    """A hard entry needs evidence."""
    return (F.col("provenance") != "hard") | (F.size(F.coalesce("evidence_refs", F.array().cast("array<string>"))) > 0)


def stable_package() -> Column:
    return (
        (F.col("status") == "active") & (F.col("retention_stage") != "archived") & F.col("valid_to").isNull() & F.col("expires_at").isNull()
        & (F.col("valid_from").isNull() | (F.col("valid_from") <= F.col("observed_at")))
    )


def in_working_set(snapshot: Column) -> Column:
    return attachable(snapshot) & anchored() & (F.col("valid_from").isNull() | (F.col("valid_from") <= F.col("observed_at")))


def packed(lengths: Column, budget: int | Column) -> Column:
    """Which items of an ordered array of lengths fit a budget, one after another; one that doesn't is skipped
    and later ones are still tried. -> array<boolean>"""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("take"))

    def step(a: Column, n: Column) -> Column:
        fits = a["used"] + n <= budget
        return F.struct((a["used"] + F.when(fits, n).otherwise(0)).cast("long").alias("used"), F.concat(a["take"], F.array(fits)).alias("take"))

    return F.aggregate(F.transform(lengths, lambda n: n.cast("long")), start, step)["take"]


def budget_packed(rows: DataFrame, by: str, order: list[Column], length: str, budget: int, most: int, keep: list[str]) -> DataFrame:
    """The first `most` rows of each group in order, with `picked` by the budget. Groups are cut to `most` rows
    before they are gathered."""
    rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__r") <= most)
    item = F.struct(F.col("__r"), F.col(length).alias("__n"), *keep)
    lists = rows.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("__l"))
    lists = lists.withColumn("__t", packed(F.transform("__l", lambda x: x["__n"]), budget))
    one = lists.select(by, F.explode(F.arrays_zip("__l", "__t")).alias("x"))
    return one.select(by, F.col("x.__l.__r").alias("pos"), *[F.col(f"x.__l.{c}").alias(c) for c in keep], F.col("x.__t").alias("picked"))


def quota_packed(rows: DataFrame, by: str, key: str, size: str, quota: int) -> DataFrame:
    """All rows, with `picked` by the quota in the order of key, which is unique in a group; a size is a whole
    number, 0 or more. What is used never falls, so once a size doesn't fit no later row of that size does: of each
    size only the first quota / size rows can fit, and only those are gathered, however large the group."""
    n, place = F.col(size), F.row_number().over(Window.partitionBy(by, size).orderBy(key))
    able = rows.where((n > 0) & (n <= quota)).select(by, key, size).withColumn("__r", place).where(F.col("__r") <= quota).where(F.col("__r") * n <= quota)
    lists = able.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), n.alias("n")))).alias("l"))
    lists = lists.select(F.col(by).alias("__by"), F.explode(F.arrays_zip("l", packed(F.transform("l", lambda x: x["n"]), quota).alias("t"))).alias("x"))
    taken = lists.where("x.t").select("__by", F.col("x.l.k").alias("__key"), F.lit(True).alias("__taken"))
    out = rows.join(taken, F.col(by).eqNullSafe(F.col("__by")) & F.col(key).eqNullSafe(F.col("__key")), "left")
    return out.withColumn("picked", F.coalesce("__taken", n == 0)).drop("__by", "__key", "__taken")


def newest(rows: DataFrame, by: list[str], key: str) -> DataFrame:
    """The row with the highest key of each group; a key is unique in its group."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), key).alias("__x")).select(*by, *[F.col(f"__x.{c}").alias(c) for c in rest])


def fingerprint(rows: DataFrame, columns: list[str], groups: list[str]) -> DataFrame:
    """SHA-256 of each group's sorted row hashes, as a tree: rows are hashed and summed up in buckets by the hash's first
    four digits, those by the first two, then these are hashed; no list has more than 65536ths of a group, or 256 sums."""
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]), 256)
    part = rows.select(*groups, row.alias("h")).groupBy(*groups, F.substring("h", 1, 4).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    summed = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ""), 256)
    part = part.groupBy(*groups, F.substring("b", 1, 2).alias("a")).agg(summed.alias("h")).withColumnRenamed("a", "b")
    return part.groupBy(*groups).agg(summed.alias("fingerprint"))
