"""Rules around a search: checked plans, hardened question sets, answers within a size, merged answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HOPS, HOP = (1, 3), 2
#: What locates evidence and must not stand on a memory.
LOCATING = ("source_position", "source_version", "relevance_score")


def valid_signals(signals: Column, vocabulary: Column) -> Column:
    """Those of dense and sparse, and graph if the domain has relations; dense if none is left."""
    allowed = F.filter(signals, lambda s: s.isin("dense", "sparse") | ((s == "graph") & (F.size(vocabulary) > 0)))
    return F.when(F.size(allowed) > 0, allowed).otherwise(F.array(F.lit("dense")))


def valid_directions(directions: Column, signals: Column, vocabulary: Column) -> Column:
    """The plan's relations if the domain has them all; the domain's if one is unknown, or if none is named and the
    graph is asked; none in a domain without relations."""
    named = F.coalesce(F.size(directions), F.lit(0)) > 0
    known = F.forall(directions, lambda d: F.array_contains(vocabulary, d))
    nothing = F.array().cast("array<string>")
    return F.when(F.size(vocabulary) == 0, nothing).when(named, F.when(known, directions).otherwise(vocabulary)).when(F.array_contains(signals, "graph"), vocabulary).otherwise(nothing)


def valid_hop(hop: Column) -> Column:
    """A whole number of the band, else the default."""
    n = hop.try_cast("int")
    return F.when(n.between(*HOPS), n).otherwise(F.lit(HOP))


def checked_plan(plan: DataFrame, question: str = "question") -> DataFrame:
    """plan (plan_id, pos or null, question, query, signals, directions, hop, vocabulary) -> sub-questions numbered
    from 1 with what is valid; a plan without any is its question over dense."""
    signals = valid_signals(F.coalesce("signals", F.array(F.lit("dense"))), F.col("vocabulary"))
    rows = plan.withColumn("__s", F.when(F.col("pos").isNull(), F.array(F.lit("dense"))).otherwise(signals))
    rows = rows.withColumn("__d", F.when(F.col("pos").isNull(), F.col("vocabulary")).otherwise(valid_directions(F.col("directions"), F.col("__s"), F.col("vocabulary"))))
    number = F.row_number().over(Window.partitionBy("plan_id").orderBy("pos"))
    hop = F.when(F.array_contains("__s", "graph"), valid_hop(F.col("hop")))
    return rows.select("plan_id", F.col(question), "vocabulary", number.alias("sub_problem_id"), F.coalesce("query", question).alias("query"), F.col("__s").alias("signals"), F.col("__d").alias("directions"), hop.alias("hop"))


def hardened(subs: DataFrame, question: str = "question") -> DataFrame:
    """(plan_id, question, sub_problem_id, query, signals, ...) -> with the question among them: a single sub-question
    becomes it; of several it is the first, over dense and sparse, and the others follow."""
    several = F.count("*").over(Window.partitionBy("plan_id")) > 1
    rows = subs.withColumn("__m", several)
    own = rows.withColumn("query", F.when(F.col("__m"), F.col("query")).otherwise(F.col(question)))
    own = own.withColumn("sub_problem_id", F.when(F.col("__m"), F.col("sub_problem_id") + 1).otherwise(F.lit(1)))
    first = rows.where("__m and sub_problem_id = 1")
    first = first.withColumns({"query": F.col(question), "signals": F.array(F.lit("dense"), F.lit("sparse")), "directions": F.array().cast("array<string>"), "hop": F.lit(None).cast("int")})
    return own.unionByName(first).drop("__m")


def graph_params(signals: Column, directions: Column, vocabulary: Column) -> Column:
    """struct(use_graph, relation_types): all relations of the domain where the plan names none or an unknown one."""
    use = F.array_contains(signals, "graph")
    named = F.coalesce(F.size(directions), F.lit(0)) > 0
    known = F.forall(directions, lambda d: F.array_contains(vocabulary, d))
    return F.struct(use.alias("use_graph"), F.when(use, F.when(named & known, directions).otherwise(vocabulary)).alias("relation_types"))


def outcome(lists: dict[str, DataFrame], questions: DataFrame, requested: int, round_: Column, most: int, query: str = "item_id", key: str = "doc_id") -> DataFrame:
    """What a recall has come to, for each of the questions: lists are the hits (query, key) of each path after its guards ->
    (query, returned, failed_paths, missing, status, again). A path without a hit has failed; the status is no_evidence
    without any hit, partial if a path has failed, else complete; missing is how many of the requested there aren't, and
    another round is due with something missing and rounds left."""
    hits = reduce(DataFrame.unionByName, [df.select(query, key, F.lit(name).alias("path")) for name, df in lists.items()])
    found = hits.groupBy(query).agg(F.countDistinct(key).alias("n"), F.collect_set("path").alias("paths"))  # as many paths as lists
    rows = questions.join(found, query, "left").withColumn("returned", F.least(F.coalesce("n", F.lit(0)), F.lit(requested)))
    failed = F.array_except(F.array(*[F.lit(name) for name in lists]), F.coalesce("paths", F.array().cast("array<string>")))
    status = F.when(F.col("returned") == 0, "no_evidence").when(F.size("failed_paths") > 0, "partial").otherwise("complete")
    rows = rows.withColumn("failed_paths", failed).withColumn("missing", requested - F.col("returned"))
    return rows.withColumns({"status": status, "again": (F.col("missing") > 0) & (round_ < most)}).select(query, "returned", "failed_paths", "missing", "status", "again")


def digits(n: Column) -> Column:
    return F.length(n.cast("string"))


def with_own_size(size: Column) -> Column:
    """The length of a text that has its own length in it, written out: the least n with n = size + digits of n."""
    for_one = [size + k for k in range(1, 12)]
    return F.coalesce(*[F.when(digits(n) == F.lit(k), n) for k, n in enumerate(for_one, 1)])


def size_budget(rows: DataFrame, by: str, order: list[Column], item: str, budget: int, most: int = 50) -> DataFrame:
    """The first `most` rows of each group in order, with `kept`: items go from the tail until the answer
    {"completion_status":..,"counts":{"characters":..,"returned":..,"truncated_by_budget":..},"memories":[..]}
    has at most `budget` characters. Adds characters and completion_status of the answer."""
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("pos") <= most)
    upto, whole = Window.partitionBy(by).orderBy("pos"), Window.partitionBy(by)
    rows = rows.withColumn("__all", F.count("*").over(whole)).withColumn("__sum", F.sum(F.length(item)).over(upto))
    frame = len('{"completion_status":"","counts":{"characters":,"returned":,"truncated_by_budget":},"memories":[]}')

    def characters(n: Column, used: Column) -> Column:
        status = F.when(n == F.col("__all"), F.when(n > 0, len("complete")).otherwise(len("no_evidence"))).otherwise(len("partial"))
        return with_own_size((F.lit(frame) + status + digits(n) + digits(F.col("__all") - n) + used + F.greatest(n - 1, F.lit(0))).cast("long"))

    rows = rows.withColumn("__c", characters(F.col("pos"), F.col("__sum")))
    kept = F.coalesce(F.max(F.when(F.col("__c") <= budget, F.col("pos"))).over(whole), F.lit(0))
    rows = rows.withColumn("__k", kept).withColumn("kept", F.col("pos") <= F.col("__k"))
    size = F.coalesce(F.max(F.when(F.col("pos") == F.col("__k"), F.col("__c"))).over(whole), characters(F.lit(0), F.lit(0)))
    status = F.when(F.col("__k") == F.col("__all"), "complete").otherwise("partial")
    return rows.withColumns({"characters": size, "completion_status": status}).drop("__all", "__sum", "__c", "__k")


def without_locating(item: Column, keys: tuple[str, ...] = LOCATING) -> Column:
    """A memory's JSON members without those that locate evidence."""
    members = F.from_json(item, "map<string,string>")
    return F.map_filter(members, lambda k, _: ~k.isin(*keys))
