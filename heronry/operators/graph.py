"""Edges, bounded expansion, chains, levels and components."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heronry.session import forgotten, settled, written

HARD, SOFT, DECAY = 1.0, 0.3, 0.5
#: Rows that a partition is dealt.
PART_ROWS = 1 << 19


def directed(hard: DataFrame, soft: DataFrame, inverse: dict[str, str]) -> DataFrame:
    """(src, dst, relation, is_hard): hard edges and active soft ones, each way; a reversed edge has the
    inverse relation, its own if it has none."""
    rows = hard.select("src", "dst", "relation", F.lit(True).alias("is_hard")).unionByName(
        soft.where("state = 'active'").select("src", "dst", "relation", F.lit(False).alias("is_hard"))
    )
    names = F.create_map(*[F.lit(x) for pair in inverse.items() for x in pair])
    back = rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.coalesce(names[F.col("relation")], "relation").alias("relation"), "is_hard")
    out = rows.withColumn("direction", F.lit("out"))
    return out.unionByName(back.withColumn("direction", F.lit("in")))


def parts_of(table: DataFrame) -> int:
    """How many partitions a table's rows are dealt to where a task's memory is to stay the same on larger tables."""
    return max(1, -(-table.count() // PART_ROWS))


def deduped(edges: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """One edge per key. With `parts`, edges are dealt to so many partitions by their whole key, so that no node gathers its
    edges and a task has a share that the table's size doesn't change."""
    return (edges.repartition(parts, *keys) if parts else edges).dropDuplicates(keys)


def expanded(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Every path of up to `hops` edges from seeds (node) -> (node, start, hop, weight). A path doesn't come back
    to a node that it left. The weight goes by the last edge: 1 or 0.3 for hard or soft, halved per hop.
    One join per hop, on the frontier's nodes."""
    weight = F.when(F.col("is_hard"), HARD).otherwise(SOFT)
    e = edges.select(F.col("src").alias("__s"), F.col("dst").alias("__d"), "is_hard")
    now = e.join(seeds.select(F.col("node").alias("__s")), "__s").select(F.col("__d").alias("node"), F.col("__s").alias("start"), F.lit(1).alias("hop"), weight.alias("weight"), F.array("__s").alias("seen"))
    found = [now]
    for h in range(2, hops + 1):
        step = now.join(e, F.col("node") == F.col("__s")).where(~F.array_contains("seen", F.col("__d")))
        now = step.select(F.col("__d").alias("node"), "start", F.lit(h).alias("hop"), (weight * DECAY ** (h - 1)).alias("weight"), F.concat("seen", F.array("__s")).alias("seen"))
        found.append(now)
    return reduce(DataFrame.unionByName, found).drop("seen")


def best_paths(paths: DataFrame) -> DataFrame:
    """One path per node: the heaviest, then the shortest, then the smallest start."""
    best = F.min_by(F.struct("start", "hop", "weight"), F.struct((-F.col("weight")).alias("w"), "hop", "start"))
    return paths.groupBy("node").agg(best.alias("b")).select("node", "b.*")


def undominated(states: DataFrame, more: int) -> DataFrame:
    """Of states (node, trail: start and the nodes after it) those that a path of up to `more` further nodes may need: of a
    node the least trail, and for each of its nodes the least trail that avoids it, `more` times over. A further node that
    blocks one trail leaves another, so the best end is found whatever is avoided. Least trails are aggregates, so no
    node's trails are gathered."""
    kept = states.groupBy("node").agg(F.min("trail").alias("trail"))
    found = kept.withColumn("avoid", F.array().cast("array<bigint>"))
    for _ in range(more):
        asked = found.select("node", F.explode("trail").alias("x"), "avoid").select("node", F.array_sort(F.array_union("avoid", F.array("x"))).alias("avoid")).distinct()
        found = states.join(asked, "node").where(~F.arrays_overlap("trail", "avoid")).groupBy("node", "avoid").agg(F.min("trail").alias("trail"))
        kept = kept.unionByName(found.select("node", "trail"))
    return kept.distinct()


def best_reached(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """best_paths(expanded(edges, seeds, hops)) without listing the paths: between hops a node keeps the few trails that
    another hop may need (three of one or two hops, for three hops), so a hop's rows are at most some times the edges,
    where all paths grow by the degree at each hop."""
    weight = F.when(F.col("is_hard"), HARD).otherwise(SOFT)
    e = edges.select(F.col("src").cast("long").alias("__s"), F.col("dst").cast("long").alias("__d"), "is_hard")
    states, steps = seeds.select(F.col("node").cast("long").alias("node"), F.array().cast("array<bigint>").alias("trail")).distinct(), []
    for h in range(1, hops + 1):
        step = states.join(e, F.col("node") == F.col("__s")).where(~F.array_contains("trail", F.col("__d")))
        step = step.select(F.col("__d").alias("node"), F.concat("trail", F.array("__s")).alias("trail"), (weight * DECAY ** (h - 1)).alias("weight"), F.lit(h).alias("hop"))
        steps.append(written(step, "hop") if h < hops else step)
        if h < hops:
            # A path may end in a loop but needn't go on from it: without the loop it comes as far, and sooner.
            states = undominated(steps[-1].where(~F.array_contains("trail", F.col("node"))).select("node", "trail").distinct(), hops - h)
    ends = [x.groupBy("node", "weight", "hop").agg(F.min(F.col("trail")[0]).alias("start")) for x in steps]
    return settled(best_paths(reduce(DataFrame.unionByName, ends)), "paths", *steps[:-1])


def reached(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, depth) over edges (src, dst) from seeds (node), each node at its least depth; a cut per level."""
    fronts = [written(seeds.select("node", F.lit(0).alias("depth")).distinct(), "front")]
    for d in range(1, depth + 1):
        step = fronts[-1].join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        seen = reduce(DataFrame.unionByName, fronts)
        fronts.append(written(step.join(seen, "node", "left_anti").select("node", F.lit(d).alias("depth")), "front"))
        if fronts[-1].isEmpty():
            break
    return settled(reduce(DataFrame.unionByName, fronts), "reached", *fronts)


def capped_expansion(links: DataFrame, seeds: DataFrame, hops: int, nodes: int) -> DataFrame:
    """(node, hop): breadth-first over links (src, dst), at most `nodes` new ones in all, taken by hop and id."""
    found = reached(links, seeds, hops).where("depth > 0")
    return found.orderBy("depth", "node").limit(nodes).select("node", F.col("depth").alias("hop"))


def chain_depth(links: DataFrame, rounds: int = 5) -> DataFrame:
    """links (node, parent or null) -> (node, depth, root, too_deep): path doubling, so that 2 ** rounds
    steps take `rounds` joins. Cycles and longer chains are too deep."""
    up = links.select("node", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"), F.coalesce("parent", "node").alias("root"))
    for _ in range(rounds):
        above = up.select(F.col("node").alias("__n"), F.col("up").alias("__u"), F.col("depth").alias("__d"), F.col("root").alias("__r"))
        up = up.join(above, F.col("up") == F.col("__n"), "left").select(
            "node", F.col("__u").alias("up"), (F.col("depth") + F.coalesce("__d", F.lit(0))).alias("depth"), F.coalesce("__r", "root").alias("root")
        )
    return up.select("node", "depth", "root", F.col("up").isNotNull().alias("too_deep"))


def _anchored(unary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """unary (node, need, w), a need each -> (node, anchor, w): the first node up the chain of needs that has not one need
    itself, and the sum of weights up to it; by pointer doubling. Chains without such a node go round: their nodes come
    second. Both read one written table."""
    up = written(unary.select("node", F.col("need").alias("anchor"), "w", F.lit(False).alias("done")), "chains")
    size, reach = up.count(), 1
    moving = size
    while moving and reach <= 2 * size:
        above = up.select(F.col("node").alias("anchor"), F.col("anchor").alias("__a"), F.col("w").alias("__w"))
        now = up.join(above, "anchor", "left")
        now = now.select("node", F.coalesce("__a", "anchor").alias("anchor"), (F.col("w") + F.coalesce("__w", F.lit(0))).alias("w"), F.col("__a").isNull().alias("done"))
        up = settled(now, "chains", up)
        moving, reach = up.where("not done").count(), 2 * reach
    return up.where("done").select("node", "anchor", "w"), up.where("not done").select("node")


def levels(nodes: DataFrame, needs: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(node, level) for nodes with needs (node, need): 0 without needs, else one over the highest need.
    Nodes on a cycle, or behind one, have a null level; so has a node with a need that isn't there.

    A round takes off the nodes whose needs are all known. At first, and when that takes off few, it contracts nodes with
    one need before, if they are a quarter of what is left: by pointer doubling they hang on the first node above that has none or several, at the sum of the
    weights between, so a chain takes the logarithm of its length; who needs one of them needs that node instead, with the
    weight added, and of two ways to one node the heavier counts. A graph without chains takes a round per level, at most
    `rounds`."""
    left = written(needs.select("node", "need").distinct().withColumn("w", F.lit(1).cast("long")), "needs")
    known = written(nodes.select("node").distinct().join(left, "node", "left_anti").select("node", F.lit(0).cast("long").alias("level")), "levels")
    done, hung, tables = [known], [], [left, known]
    count, slow = left.count(), True
    for _ in range(rounds):
        if not count:
            break
        rest, before = left, count
        single = left.groupBy("node").agg(F.count("*").alias("n"), F.first("need").alias("need"), F.first("w").alias("w"))
        many = slow and single.agg(F.count_if(F.col("n") == 1) * 4 >= F.count("*")).first()[0]
        if many:
            single = single.where("n = 1")
            chains, around = (written(x, "chains") for x in _anchored(single))
            tables += [chains, around]
            hung.append(chains)
            anchors = chains.select(F.col("node").alias("need"), "anchor", F.col("w").alias("__w"))
            # Nodes that go round are no longer asked for, but still needed, so who needs them is never known.
            rest = left.join(chains.select("node").unionByName(around), "node", "left_anti").join(anchors, "need", "left")
            rest = rest.select("node", F.coalesce("anchor", "need").alias("need"), (F.col("w") + F.coalesce("__w", F.lit(0))).alias("w"))
            rest = written(rest.groupBy("node", "need").agg(F.max("w").alias("w")), "needs")
            tables.append(rest)
        met = rest.join(reduce(DataFrame.unionByName, done).withColumnRenamed("node", "need"), "need", "left")
        ready = met.groupBy("node").agg(F.max(F.col("level") + F.col("w")).alias("level"), F.count("*").alias("n"), F.count("level").alias("k")).where("n = k").select("node", "level")
        ready = written(ready, "levels")
        left = written(rest.join(ready, "node", "left_anti"), "needs")
        tables += [ready, left]
        done.append(ready)
        if len(done) > 16:
            done = [written(reduce(DataFrame.unionByName, done), "levels")]
            tables += done
        count = left.count()
        if ready.isEmpty():  # nothing more can be known
            break
        slow = before - count < before // 8 + 1
    else:
        raise RuntimeError(f"needs over {rounds} rounds")
    found = reduce(DataFrame.unionByName, done)
    for chains in reversed(hung):  # what was contracted last hangs on what is known
        above = found.select(F.col("node").alias("anchor"), F.col("level").alias("__l"))
        found = found.unionByName(chains.join(above, "anchor").select("node", (F.col("__l") + F.col("w")).alias("level")))
    out = nodes.select("node").join(found.select("node", F.col("level").cast("int").alias("level")), "node", "left")
    return settled(out, "levels", *tables)


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) of edges (u, v): each round a node takes the least label around it, then the label's
    own label, so that chains shorten by half."""
    both = written(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), "edges")
    label = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("c")), "labels")
    table = label
    for _ in range(rounds):
        near = both.join(label, F.col("v") == F.col("node")).groupBy(F.col("u").alias("node")).agg(F.min("c").alias("n"))
        now = label.join(near, "node").select("node", F.least("c", "n").alias("c"), F.col("c").alias("was"))
        jump = now.select(F.col("node").alias("c"), F.col("c").alias("j"))
        before, now = table, written(now.join(jump, "c", "left").select("node", F.least("c", F.coalesce("j", "c")).alias("c"), "was"), "labels")
        forgotten(before)
        table, label = now, now.select("node", "c")
        if now.where("c <> was").isEmpty():
            return settled(label.withColumnRenamed("c", "component"), "components", both, now)
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def superseded(relations: DataFrame, key: list[str]) -> DataFrame:
    """Soft relations with `superseded_by`: the strictly most confident one of each key closes the others."""
    w = Window.partitionBy(*key)
    top = F.max(F.struct("confidence", (-F.col("id")).alias("i"))).over(w)
    return relations.withColumn("__t", top).withColumn("superseded_by", F.when(F.col("confidence") < F.col("__t")["confidence"], -F.col("__t")["i"])).drop("__t")


def lifecycle(confidence: Column, evidence: Column) -> Column:
    return F.when((confidence >= 0.6) & (F.size(evidence) > 0), "active").otherwise("candidate")


#: Extractors of hard relations in the order in which they are asked: name, format of the files, relation and its inverse.
EXTRACTORS = (("java_calls", "java", {"calls": "called_by"}), ("ddl_keys", "ddl", {"references": "referenced_by"}), ("cross_references", "markdown", {"references": "referenced_by"}))


def inverse_pairs(extractors: tuple = EXTRACTORS) -> dict[str, str]:
    """The inverse of each declared relation; an error if names are odd, or a relation has two inverses."""
    out: dict[str, str] = {}
    for name, form, pairs in extractors:
        if not form or not pairs:
            raise ValueError(f"{name}: a format and at least one pair of relations are needed")
        for key, value in pairs.items():
            for relation in (key, value):
                if not re.fullmatch(r"[a-z][a-z0-9_:]{0,63}", relation):
                    raise ValueError(f"{name}: {relation!r} is no name of a relation")
            if pairs.get(value, key) != key:
                raise ValueError(f"{name}: {key} and {value} aren't each other's inverse")
            for one, other in ((key, value), (value, key)):
                if out.setdefault(one, other) != other:
                    raise ValueError(f"{name}: {one} has the inverses {out[one]} and {other}")
    return out


def discovered(files: DataFrame, vocabularies: DataFrame, extractors: tuple = EXTRACTORS) -> DataFrame:
    """files (.., domain, format), vocabularies (domain, relations array<string>) -> a row per file and extractor of its
    format that has a relation of the domain's vocabulary, with its place."""
    inverse_pairs(extractors)
    rows = [(i, name, form, list(pairs)) for i, (name, form, pairs) in enumerate(extractors)]
    table = files.sparkSession.createDataFrame(rows, "place int, extractor string, format string, keys array<string>")
    joined = files.join(vocabularies, "domain").join(F.broadcast(table), "format")  # as many rows as extractors
    return joined.where(F.arrays_overlap("keys", "relations")).drop("keys", "relations")


def rebuilt(edges: DataFrame, fresh: DataFrame, scopes: DataFrame) -> DataFrame:
    """edges with those of the scopes (scope_id) replaced by fresh ones; fresh edges of other scopes don't count."""
    return edges.join(scopes, "scope_id", "left_anti").unionByName(fresh.join(scopes, "scope_id", "left_semi").select(*edges.columns))


def trace(paths: DataFrame, question: Column, at: Column) -> DataFrame:
    """Best paths (node, start, hop, weight) as rows of an append-only trace, with an identifier of each."""
    name = F.concat_ws("|", question.cast("string"), F.col("start").cast("string"), F.col("node").cast("string"), F.col("hop").cast("string"))
    return paths.select(F.sha2(name, 256).alias("trace_id"), question.alias("question_id"), "start", "node", "hop", "weight", at.alias("created_at"))


def call_edges(methods: DataFrame, calls: DataFrame) -> DataFrame:
    """methods (path, name, chunk), calls (path, caller chunk, name) -> calls and called_by edges between the chunks of a
    file; of methods with one name the first is meant, and a method that calls itself has no edge."""
    first = methods.groupBy("path", "name").agg(F.min("chunk").alias("dst"))
    found = calls.select("path", F.col("caller").alias("src"), "name").join(first, ["path", "name"]).where("src <> dst").select("path", "src", "dst").distinct()
    back = found.select("path", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("called_by").alias("relation"))
    return found.withColumn("relation", F.lit("calls")).unionByName(back)
