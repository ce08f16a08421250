"""The six calls of the service as plain functions over DataFrames, and the bounded search loop.

Tables: chunks (doc_id, text, scope, source_id, version_id, status), entries as in heronry.operators.events.
Every read names its scopes; without one it is refused."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronry.functions import text as tx
from heronry.operators import events as ev
from heronry.operators import graph as gr
from heronry.operators import retrieval as rt
from heronry.operators import vectors as vx

TOP_K, MOST_ROUNDS, SNAPSHOT_EVENTS, SNAPSHOT_HOURS = 20, 3, 10_000, 24
WEIGHTS = {"dense": 1.0, "recency": 0.5, "kind": 0.3, "salience": 0.2}


class MissingScope(ValueError):
    """A read over everything was asked for."""


def scoped(rows: DataFrame, column: str, scopes: Sequence) -> DataFrame:
    if not scopes:
        raise MissingScope("name at least one scope")
    return rows.where(F.col(column).isin(*scopes))


def search_knowledge(
    chunks: DataFrame, questions: DataFrame, scopes: Sequence, top_k: int = 5, per_source: int = 5, vectors: DataFrame | None = None, question_vectors: DataFrame | None = None,
    edges: DataFrame | None = None, hops: int = 1, scorer: Callable[[DataFrame], Column] | None = None, prefilter: bool = False,
) -> DataFrame:
    """questions (item_id, text) -> (item_id, doc_id, score, rank, source_id, scope, excerpt, truncated).

    Sparse recall, with vectors (doc_id, embedding) dense recall too, with edges (src, dst, is_hard) the graph
    around their hits as the third list; fusion, an optional scorer over the first twenty, then published
    chunks only, at most per_source of a source, and top_k (1 to 20). Recall takes twice top_k; guards come
    after it unless prefilter is set, so a result may be short."""
    k = min(TOP_K, max(1, top_k))
    pool = scoped(chunks, "scope", scopes)
    live = pool.where("status = 'published'")
    base = live if prefilter else pool
    lists = {"sparse": rt.bm25_search(rt.indexed(base.select("doc_id", "text")), questions, 2 * k).select("item_id", "doc_id", "rank")}
    if vectors is not None and question_vectors is not None:
        own = vectors.join(base.select("doc_id"), "doc_id", "left_semi")
        lists["dense"] = vx.search(vx.clustered(own, "doc_id"), question_vectors, 2 * k, "doc_id", "item_id").select("item_id", "doc_id", "rank")
    if edges is not None:
        seeds = rt.unioned(lists.values()).select("item_id", "doc_id").distinct()
        paths = gr.best_reached(edges, seeds.select(F.col("doc_id").alias("node")), min(3, max(1, hops)))
        near = paths.join(seeds.select("item_id", F.col("doc_id").alias("start")), "start").select("item_id", F.col("node").alias("doc_id"), F.col("weight").alias("score"))
        lists["graph"] = rt.ranked(near.groupBy("item_id", "doc_id").agg(F.max("score").alias("score")), "item_id", "score", "doc_id", TOP_K).select("item_id", "doc_id", "rank")
    hits = rt.fused(lists, "item_id", "doc_id").where(F.col("final_rank") <= max(TOP_K, 2 * k))
    facts = live.select("doc_id", "source_id", "scope", "text")
    hits = hits.join(facts, "doc_id").join(questions.select("item_id", F.col("text").alias("question")), "item_id")
    score = scorer(hits) if scorer else F.least(F.lit(1.0), F.col("fused_score") * rt.RRF_SCALE)
    hits = rt.ranked(hits.withColumn("score", score), "item_id", "score", "final_rank")
    hits = rt.per_source_cap(hits, "item_id", "source_id", "rank", per_source).drop("rank")
    hits = rt.ranked(hits, "item_id", "score", "final_rank", k)
    return hits.select("item_id", "doc_id", "score", "rank", "source_id", "scope", F.substring("text", 1, 500).alias("excerpt"), (F.length("text") > 500).alias("truncated"))


def completion(hits: DataFrame, questions: DataFrame, failed: Sequence[str] = ()) -> DataFrame:
    """(item_id, status): complete with any hit, partial if a path failed, no_evidence without one."""
    n = questions.select("item_id").join(hits.groupBy("item_id").agg(F.count("*").alias("n")), "item_id", "left")
    return n.select("item_id", F.when(F.col("n").isNull(), "no_evidence").when(F.lit(bool(failed)), "partial").otherwise("complete").alias("status"))


def get_evidence(chunks: DataFrame, asked: DataFrame, scopes: Sequence) -> DataFrame:
    """asked (doc_id) -> (doc_id, state, excerpt): not_found, scope_mismatch, unavailable or available."""
    if not scopes:
        raise MissingScope("name at least one scope")
    rows = asked.select("doc_id").join(chunks.select("doc_id", "scope", "status", "text"), "doc_id", "left")
    state = F.when(F.col("status").isNull(), "not_found").when(~F.col("scope").isin(*scopes), "scope_mismatch").when(F.col("status") != "published", "unavailable").otherwise("available")
    return rows.select("doc_id", state.alias("state"), F.when(state == "available", F.substring("text", 1, 500)).alias("excerpt"))


def list_knowledge_domains(scopes: DataFrame, profiles: DataFrame) -> DataFrame:
    """scopes (scope_id, domain_key, status), profiles (domain_key, name) -> scopes with their profile, if any."""
    return scopes.where("status = 'active'").join(profiles, "domain_key", "left")


def record_memory(entries: DataFrame, submissions: DataFrame, quota: int = 5000) -> DataFrame:
    """submissions (event_id, scope_id, kind, provenance, content, evidence_refs) against entries (memory_id,
    scope_id, kind, provenance, content_hash, status) -> one row each with cleaned content, status, outcome
    (created, existing, conflict, invalid, quota) and the entry it meets. The first of equal submissions wins."""
    clean = submissions.withColumn("content", tx.redacted(F.col("content")))
    risk = tx.injection(F.col("content"))["risk"]
    authority = F.col("content").rlike(tx.AUTHORITY)
    clean = clean.withColumn("status", F.when((risk == "high") | authority, "quarantined").otherwise("active")).withColumn("content_hash", F.sha2("content", 256))
    refs = F.size(F.coalesce("evidence_refs", F.array().cast("array<string>")))
    bad = (
        F.col("scope_id").isNull() | ~F.col("kind").isin("episodic", "semantic", "procedural") | ~F.col("provenance").isin("hard", "soft", "distilled")
        | ~F.length("content").between(1, 4000) | ((F.col("provenance") == "hard") & (refs == 0))
    )
    same = entries.groupBy("scope_id", "content_hash").agg(F.min_by(F.struct("memory_id", "kind", "provenance"), "memory_id").alias("old"))
    first = clean.where(~bad).groupBy("scope_id", "content_hash").agg(F.min_by(F.struct(F.col("event_id").alias("memory_id"), "kind", "provenance"), "event_id").alias("own"))
    used = entries.where("status = 'active'").groupBy("scope_id").agg(F.count("*").alias("used"))
    rows = clean.join(same, ["scope_id", "content_hash"], "left").join(first, ["scope_id", "content_hash"], "left").join(used, "scope_id", "left")
    meets = F.coalesce("old", F.when(F.col("own.memory_id") != F.col("event_id"), F.col("own")))
    equal = (meets["kind"] == F.col("kind")) & (meets["provenance"] == F.col("provenance"))
    outcome = F.when(bad, "invalid").when(meets.isNotNull(), F.when(equal, "existing").otherwise("conflict")).when(F.coalesce("used", F.lit(0)) >= quota, "quota").otherwise("created")
    return rows.select("event_id", "scope_id", "content", "status", outcome.alias("outcome"), F.when(~bad, meets["memory_id"]).alias("existing_id"))


def recall_memory(
    entries: DataFrame, scopes: Sequence, now: Column, similarity: DataFrame | None = None, ids: Sequence[int] = (), kind: str | None = None, session: str | None = None,
    as_of: Column | None = None, window: tuple[Column, Column] | None = None, delivered: DataFrame | None = None, limit: int = 10, budget: int = 6000, include_superseded: bool = False,
) -> DataFrame:
    """(scope_id, memory_id, pos, excerpt, score): by ids, by similarity (memory_id, sim) fused with recency, kind and
    salience, or by time; visible entries only, without what the session was delivered, cut by limit (1 to 50)
    and by a character budget that skips what doesn't fit."""
    limit = min(50, max(1, limit))
    rows = scoped(entries, "scope_id", scopes).where(ev.visible(now, as_of, include_superseded))
    for column, value in (("kind", kind), ("session_id", session)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if window is not None:
        rows = rows.where(F.col("observed_at").between(*window))
    if delivered is not None:
        rows = rows.join(delivered.select("memory_id").distinct(), "memory_id", "left_anti")
    newest = [F.col("observed_at").desc(), F.col("memory_id").desc()]
    if ids:
        place = F.array_position(F.array(*[F.lit(i) for i in dict.fromkeys(ids)]), F.col("memory_id"))
        rows, order = rows.where(F.col("memory_id").isin(*ids)).withColumn("score", F.lit(None).cast("double")), [place]
    elif similarity is not None:
        rows = rows.join(similarity, "memory_id")
        prefer = F.when(F.col("kind") == "procedural", 0).when(F.col("kind") == "semantic", 1).otherwise(2)
        orders = {"dense": [F.col("sim").desc(), F.col("memory_id")], "recency": newest, "kind": [prefer, F.col("memory_id")], "salience": [F.col("salience").desc(), F.col("memory_id")]}
        from pyspark.sql.window import Window

        lists = {n: (rows.where("salience > 0") if n == "salience" else rows).select("scope_id", "memory_id", F.row_number().over(Window.partitionBy("scope_id").orderBy(*o)).alias("rank")) for n, o in orders.items()}
        score = rt.fused(lists, "scope_id", "memory_id", WEIGHTS, text_ties=False).select("memory_id", F.col("fused_score").alias("score"))
        rows, order = rows.join(score, "memory_id"), [F.round("score", 9).desc(), F.col("memory_id")]
    else:
        rows, order = rows.withColumn("score", F.lit(None).cast("double")), newest
    rows = rows.withColumn("excerpt", F.substring("content", 1, 300)).withColumn("chars", F.length("excerpt"))
    out = ev.budget_packed(rows, "scope_id", order, "chars", budget, limit, ["memory_id", "excerpt", "score"])
    return out.where("picked").select("scope_id", "memory_id", "pos", "excerpt", "score")


def start_work(entries: DataFrame, scopes: Sequence, digest_budget: int = 2000, excerpt: int = 200) -> DataFrame:
    """Digest of the stable entries of each scope within the budget, newest first."""
    rows = scoped(entries, "scope_id", scopes).where(ev.stable_package() & ev.anchored())
    rows = rows.withColumn("excerpt", F.substring("content", 1, excerpt)).withColumn("chars", F.length("excerpt"))
    out = ev.budget_packed(rows, "scope_id", [F.col("observed_at").desc(), F.col("memory_id").desc()], "chars", digest_budget, 50, ["memory_id", "excerpt"])
    return out.where("picked").select("scope_id", "memory_id", "pos", "excerpt")


def search_rounds(
    search: Callable[[DataFrame], DataFrame], question: DataFrame, plan: Callable[[DataFrame, int], DataFrame], gap: Callable[[DataFrame], bool], rounds: int = MOST_ROUNDS
) -> DataFrame:
    """The bounded loop: plan sub-questions (item_id, text), search them in one job, merge with the rounds before,
    and go on while gap() finds something missing. The question itself is always among the first ones."""
    found = None
    for i in range(min(MOST_ROUNDS, max(1, rounds))):
        asked = plan(question, i)
        asked = question.select("item_id", "text").unionByName(asked.select("item_id", "text")).dropDuplicates(["text"]) if not i else asked
        hits = search(asked).select(
            F.lit(i).alias("round"), F.col("rank").alias("pos"), F.col("doc_id").cast("string").alias("evidence_id"), "score", F.lit(None).cast("double").alias("dense_score"),
            F.lit(None).cast("double").alias("sparse_score"), F.col("item_id").cast("string").alias("sub_problem_id"), F.lit("fused").alias("retriever"),
        )
        found = hits if found is None else found.unionByName(hits)
        merged = rt.merged_rounds(found)
        if not gap(merged):
            break
    return merged


def snapshot_due(log: DataFrame, covered_event: int, covered_at: Column, now: Column) -> bool:
    """Whether enough events or hours have passed since the last snapshot."""
    fresh = log.where(F.col("event_id") > covered_event).agg(F.count("*").alias("n"), F.first(F.timestamp_diff("HOUR", covered_at, now)).alias("h")).first()
    return fresh["n"] >= SNAPSHOT_EVENTS or (fresh["n"] > 0 and (fresh["h"] or 0) >= SNAPSHOT_HOURS)
