"""Queries over sparse and dense search, fusion, guards and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heronry.functions import text as tx
from heronry.operators import retrieval as rt
from heronry.operators import termstats as ts
from heronry.operators import vectors as vx
from heronry.plans.base import CHUNKS, VERSIONS, Tables, query, sql_bm25, sql_tokens
from heronry.session import written

BM25 = sql_bm25()
Q_TOKENS = f"""qtf AS (SELECT item_id, len(t) AS qdl, term, count(*) AS qtf FROM (SELECT item_id, t, unnest(t) AS term FROM (SELECT item_id, {sql_tokens()} AS t FROM benchmark)) GROUP BY ALL)"""
WEIGHTED = """hits AS (
  SELECT item_id, doc_id, sum(weight * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * qtf * 2.2::DOUBLE / (qtf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * qdl / avgdl))) AS score
  FROM post JOIN qtf USING (term) JOIN df USING (term), size GROUP BY ALL)"""
RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id)::INTEGER AS rank FROM hits)"
SPARSE = f"{BM25}, {Q_TOKENS}, {WEIGHTED}, {RANKED}"


def sparse(t: Tables, k: int = 10):
    return rt.bm25_search(t.index, t.benchmark, k)


@query(f"SELECT doc_id, unnest({sql_tokens()}) AS term FROM documents")
def tokenize(t: Tables):
    """#104 tokens of every document."""
    return t.documents.select("doc_id", F.explode(tx.tokens(F.col("text"))).alias("term"))


@query(f"SELECT DISTINCT term, ('0x' || substr(sha256(term), 1, 8))::BIGINT AS term_id FROM (SELECT unnest({sql_tokens()}) AS term FROM documents)")
def term_id(t: Tables):
    """#105 identifiers of all terms."""
    terms = t.documents.select(F.explode(tx.tokens(F.col("text"))).alias("term")).distinct()
    return terms.select("term", tx.term_id(F.col("term")).alias("term_id"))


@query(f"WITH {BM25} SELECT term, df, round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM df, size")
def bm25_stats(t: Tables):
    """#81, #106 document frequencies and IDF."""
    return rt.bm25_stats(t.index).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {BM25} SELECT doc_id, term, round(weight, 6) AS weight FROM post WHERE weight > 0")
def bm25_encode(t: Tables):
    """#107 weighted postings."""
    return rt.bm25_encode(t.index).select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query(f"WITH {SPARSE} SELECT item_id, doc_id, round(score, 5) AS score, rank FROM ranked WHERE rank <= 10")
def bm25_topk(t: Tables):
    """#67, #108 top 10 by weighted query and document vectors."""
    return sparse(t).select("item_id", "doc_id", F.round("score", 5).alias("score"), "rank")


@query(f"WITH {BM25}, {Q_TOKENS}, hits AS (SELECT item_id, doc_id, sum(weight) AS score FROM post JOIN qtf USING (term) GROUP BY ALL), {RANKED} SELECT item_id, doc_id, round(score, 5) AS score, rank FROM ranked WHERE rank <= 10")
def bm25_topk_binary(t: Tables):
    """#108 with binary query weights."""
    return rt.bm25_search(t.index, t.benchmark, 10, "binary").select("item_id", "doc_id", F.round("score", 5).alias("score"), "rank")


def _stats_sql(by: str) -> str:
    return f"""WITH {CHUNKS}, tok AS (SELECT {by}, doc_id, {sql_tokens()} AS t FROM chunks), n AS (SELECT {by}, count(*) AS n, avg(len(t)) AS avgdl FROM tok GROUP BY 1),
df AS (SELECT {by}, term, count(DISTINCT doc_id) AS df FROM (SELECT {by}, doc_id, unnest(t) AS term FROM tok) GROUP BY ALL)
SELECT {by}, term, df, n, round(avgdl, 6) AS avgdl, round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM df JOIN n USING ({by})"""


def _weighed(t: Tables, by: str):
    return ts.weighed(written(ts.counted(t.chunks), "counts"), by).select(by, "term", "df", "n", F.round("avgdl", 6).alias("avgdl"), F.round("idf", 6).alias("idf"))


@query(_stats_sql("scope"))
def idf_by_scope(t: Tables):
    """#81 document frequencies and IDF of each scope."""
    return _weighed(t, "scope")


@query(_stats_sql("source"))
def idf_by_source(t: Tables):
    """#81 document frequencies and IDF of each uploaded source."""
    return _weighed(t, "source")


@query(
    f"""WITH {CHUNKS}, tok AS (SELECT doc_id, scope, source, {sql_tokens()} AS t FROM chunks),
tf AS (SELECT doc_id, scope, source, len(t) AS dl, term, count(*) AS tf FROM (SELECT *, unnest(t) AS term FROM tok) GROUP BY ALL),
so AS (SELECT source, count(*) AS n, avg(len(t)) AS avgdl FROM tok GROUP BY 1), sod AS (SELECT source, term, count(*) AS df FROM tf GROUP BY ALL),
sc AS (SELECT scope, count(*) AS n, avg(len(t)) AS avgdl FROM tok GROUP BY 1), scd AS (SELECT scope, term, count(*) AS df FROM tf GROUP BY ALL),
w AS (SELECT doc_id, scope, term, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS weight
  FROM tf JOIN sod USING (source, term) JOIN so USING (source)),
q AS (SELECT item_id, ['de', 'en', 'es', 'fr'][item_id % 4 + 1] AS scope, {sql_tokens()} AS t FROM benchmark),
qt AS (SELECT item_id, scope, len(t) AS dl, term, count(*) AS tf FROM (SELECT *, unnest(t) AS term FROM q) GROUP BY ALL),
qw AS (SELECT item_id, scope, term, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS own
  FROM qt JOIN scd USING (scope, term) JOIN sc USING (scope)),
hits AS (SELECT item_id, doc_id, sum(weight * own) AS score FROM w JOIN qw USING (scope, term) GROUP BY ALL), {RANKED}
SELECT item_id, doc_id, round(score, 5) AS score, rank FROM ranked WHERE rank <= 10"""
)
def bm25_scoped(t: Tables):
    """#67, #81, #108 top 10 in the question's scope: documents weigh by their source's statistics, questions by the scope's."""
    scope = F.element_at(F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")]), (F.col("item_id") % 4 + 1).cast("int"))
    out = ts.scoped_search(t.chunks, written(ts.counted(t.chunks), "counts"), t.benchmark.withColumn("scope", scope), 10)
    return out.select("item_id", "doc_id", F.round("score", 5).alias("score"), "rank")


DENSE = """dense AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0),
dranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, vec_id)::INTEGER AS rank FROM dense)"""


def dense(t: Tables, k: int = 10):
    queries = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vx.search(t.vector_index, queries, k)


@query(f"WITH {DENSE} SELECT query_id, vec_id, round(score, 5) AS score, rank FROM dranked WHERE rank <= 10")
def dense_topk(t: Tables):
    """#66, #109 cosine top 10 of each query vector."""
    return dense(t).select("query_id", "vec_id", F.round("score", 5).alias("score"), "rank")


@query("SELECT min(len(embedding))::BIGINT AS dim, count(DISTINCT len(embedding))::BIGINT AS dims, count(DISTINCT len(embedding)) = 1 AS uniform FROM embeddings")
def dim_check(t: Tables):
    """#8 one dimension for all vectors."""
    d = F.size("embedding").cast("long")
    return t.embeddings.agg(F.min(d).alias("dim"), F.countDistinct(d).alias("dims"), (F.countDistinct(d) == 1).alias("uniform"))


# Both recalls of the same question: a benchmark item i asks with vector (i * 7) % 50 * 10 over documents by id.
HYBRID = f"""{SPARSE}, dhits AS (
  SELECT b.item_id, v.vec_id AS doc_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score
  FROM benchmark b JOIN embeddings q ON q.vec_id = (b.item_id * 7) % 50, embeddings v),
dr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id)::INTEGER AS rank FROM dhits QUALIFY rank <= 10),
sr AS (SELECT * FROM ranked WHERE rank <= 10)"""


def hybrid_lists(t: Tables, k: int = 10):
    probe = t.benchmark.select("item_id", ((F.col("item_id") * 7) % 50).alias("vec_id"))
    queries = t.embeddings.join(probe, "vec_id").select(F.col("item_id"), "embedding")
    return {"dense": vx.search(t.vector_index, queries, k, "doc_id", "item_id"), "sparse": sparse(t, k)}


@query(f"WITH {HYBRID} SELECT 'dense' AS path, item_id, doc_id, rank FROM dr UNION ALL SELECT 'sparse', item_id, doc_id, rank FROM sr")
def hybrid_recall(t: Tables):
    """#110 dense and sparse recall of the same questions."""
    return rt.unioned(df.select(F.lit(n).alias("path"), "item_id", "doc_id", "rank") for n, df in hybrid_lists(t).items())


FUSED = f"""{HYBRID}, f AS (
  SELECT item_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS fused_score, min(CASE WHEN p = 'd' THEN rank END) AS dense_rank, min(CASE WHEN p = 's' THEN rank END) AS sparse_rank
  FROM (SELECT 'd' AS p, item_id, doc_id, rank FROM dr UNION ALL SELECT 's', item_id, doc_id, rank FROM sr) GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(fused_score, 9) DESC, dense_rank ASC NULLS LAST, sparse_rank ASC NULLS LAST, doc_id::VARCHAR)::INTEGER AS final_rank FROM f)"""


def fused(t: Tables):
    return rt.fused(hybrid_lists(t), "item_id", "doc_id")


@query(f"WITH {FUSED} SELECT item_id, doc_id, round(fused_score, 9) AS fused_score, dense_rank, sparse_rank, final_rank FROM fr")
def rrf_fuse(t: Tables):
    """#60, #91, #111 reciprocal rank fusion."""
    return fused(t).withColumn("fused_score", F.round("fused_score", 9))


@query(
    f"""WITH {HYBRID}, f AS (SELECT item_id, doc_id, sum(w / (60 + rank)) AS fused_score FROM (
  SELECT 1.0::DOUBLE AS w, item_id, doc_id, rank FROM dr UNION ALL SELECT 0.5::DOUBLE, item_id, doc_id, rank FROM sr) GROUP BY ALL)
SELECT item_id, doc_id, round(fused_score, 9) AS fused_score, row_number() OVER (PARTITION BY item_id ORDER BY round(fused_score, 9) DESC, doc_id::VARCHAR)::INTEGER AS final_rank FROM f"""
)
def rrf_weighted(t: Tables):
    """#112 weighted fusion, ties by the key as text."""
    out = rt.fused(hybrid_lists(t), "item_id", "doc_id", {"dense": 1.0, "sparse": 0.5})
    return out.select("item_id", "doc_id", F.round("fused_score", 9).alias("fused_score"), "final_rank")


@query(
    f"""WITH {SPARSE}, {CHUNKS} SELECT item_id, doc_id, rank, source_id FROM (
  SELECT item_id, ranked.doc_id, rank, source_id, row_number() OVER (PARTITION BY item_id, source_id ORDER BY rank) AS n FROM ranked JOIN chunks USING (doc_id) WHERE rank <= 40) WHERE n <= 1"""
)
def per_source_cap(t: Tables):
    """#89 at most one hit per source, in rank order."""
    hits = sparse(t, 40).select("item_id", "doc_id", "rank").join(t.chunks.select("doc_id", "source_id"), "doc_id")
    return rt.per_source_cap(hits, "item_id", "source_id", "rank", 1).select("item_id", "doc_id", "rank", "source_id")


@query(f"WITH {SPARSE} SELECT item_id, doc_id, rank FROM ranked WHERE rank <= least(20, greatest(1, (item_id % 30)::INTEGER))")
def topk_clamped(t: Tables):
    """#90 requested depth clamped to 1..20 after an over-fetch of 40."""
    k = F.least(F.lit(20), F.greatest(F.lit(1), F.col("item_id") % 30))
    return sparse(t, 40).where(F.col("rank") <= k).select("item_id", "doc_id", "rank")


@query(f"WITH {VERSIONS} SELECT doc_id, version_id, source_id FROM chunks WHERE version_id IN (SELECT version_id FROM versions WHERE status = 'published')")
def published_scan(t: Tables):
    """#9 chunks of published versions: status is a folder of the chunks' table, so other versions' chunks aren't read."""
    return t.chunk_layout.rows.where("status = 'published'").select("doc_id", "version_id", "source_id")


@query(f"WITH {SPARSE}, {CHUNKS} SELECT item_id, doc_id, rank FROM ranked WHERE rank <= 40 AND doc_id IN (SELECT doc_id FROM chunks WHERE status = 'published')")
def published_semi(t: Tables):
    """#43, #65 hits of published versions only, after the over-fetch."""
    return rt.semi(sparse(t, 40).select("item_id", "doc_id", "rank"), t.chunks.where("status = 'published'").select("doc_id"), "doc_id").select("item_id", "doc_id", "rank")


@query(
    f"""WITH {SPARSE}, {VERSIONS} SELECT item_id, r.doc_id, rank, v.status, c.scope, substr(c.text, 1, 200) AS excerpt
FROM ranked r LEFT JOIN chunks c USING (doc_id) LEFT JOIN versions v ON v.version_id = c.version_id WHERE rank <= 10"""
)
def enrich_hits(t: Tables):
    """#56 hits with chunk, version and scope facts; the rank is kept."""
    facts = t.chunks.select("doc_id", "version_id", "scope", F.substring("text", 1, 200).alias("excerpt"))
    versions = t.versions.select("version_id", "status")
    return sparse(t).join(facts, "doc_id", "left").join(versions, "version_id", "left").select("item_id", "doc_id", "rank", "status", "scope", "excerpt")


RERANK = f"""{FUSED}, rr AS (
  SELECT item_id, doc_id, len(list_intersect(list_distinct({sql_tokens('b.text')}), list_distinct({sql_tokens('d.text')}))) / greatest(len(list_distinct({sql_tokens('b.text')})), 1)::DOUBLE AS rerank_score,
    fused_score, final_rank FROM fr JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id) WHERE final_rank <= 20)"""


def reranked(t: Tables):
    hits = fused(t).where("final_rank <= 20")
    hits = hits.join(t.benchmark.select("item_id", F.col("text").alias("__q")), "item_id").join(t.documents.select("doc_id", F.col("text").alias("__d")), "doc_id")
    return hits.withColumn("rerank_score", rt.overlap_rerank(hits, "__q", "__d"))


@query(
    f"""WITH {RERANK} SELECT item_id, doc_id, round(rerank_score, 6) AS rerank_score,
  row_number() OVER (PARTITION BY item_id ORDER BY round(rerank_score, 6) DESC, round(fused_score, 9) DESC, doc_id::VARCHAR)::INTEGER AS rank FROM rr"""
)
def rerank_lexical(t: Tables):
    """#115 budget of 20, pluggable scorer; here the share of query tokens found."""
    order = Window.partitionBy("item_id").orderBy(F.round("rerank_score", 6).desc(), F.round("fused_score", 9).desc(), F.col("doc_id").cast("string"))
    out = reranked(t).withColumn("rank", F.row_number().over(order))
    return out.select("item_id", "doc_id", F.round("rerank_score", 6).alias("rerank_score"), "rank")


@query(
    f"""WITH {RERANK} SELECT item_id, doc_id, round(greatest(0, least(1, coalesce(CASE WHEN doc_id % 3 = 0 THEN rerank_score END,
  CASE WHEN doc_id % 3 = 1 AND fused_score > 0 THEN least(1.0::DOUBLE, fused_score * 15) END, 0.25::DOUBLE))), 6) AS score FROM rr"""
)
def final_score(t: Tables):
    """#116 first available score, clamped."""
    rerank = F.when(F.col("doc_id") % 3 == 0, F.col("rerank_score"))
    fused_part = F.when(F.col("doc_id") % 3 == 1, F.col("fused_score"))
    score = rt.final_score(rerank, fused_part, F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(0.25))
    return reranked(t).select("item_id", "doc_id", F.round(score, 6).alias("score"))


ROUNDS = f"""{SPARSE}, cand AS (
  SELECT item_id % 8 AS question, item_id % 3 AS round, item_id * 100 + rank AS pos, doc_id::VARCHAR AS evidence_id, round(score / 1000, 3) AS score, CASE WHEN doc_id % 2 = 0 THEN round(score, 3) END AS dense_score,
    CASE WHEN doc_id % 3 = 0 THEN round(score, 3) END AS sparse_score, 'p' || (item_id % 4) AS sub_problem_id, ['dense', 'sparse', 'graph'][item_id % 3 + 1] AS retriever
  FROM ranked WHERE rank <= 10)"""


def candidates(t: Tables):
    s = sparse(t)
    pick = F.element_at(F.array(F.lit("dense"), F.lit("sparse"), F.lit("graph")), (F.col("item_id") % 3 + 1).cast("int"))
    return s.select(
        (F.col("item_id") % 8).alias("question"), (F.col("item_id") % 3).alias("round"), (F.col("item_id") * 100 + F.col("rank")).alias("pos"), F.col("doc_id").cast("string").alias("evidence_id"),
        F.round(F.col("score") / 1000, 3).alias("score"), F.when(F.col("doc_id") % 2 == 0, F.round("score", 3)).alias("dense_score"),
        F.when(F.col("doc_id") % 3 == 0, F.round("score", 3)).alias("sparse_score"), F.concat(F.lit("p"), F.col("item_id") % 4).alias("sub_problem_id"), pick.alias("retriever"),
    )


@query(
    f"""WITH {ROUNDS}, m AS (
  SELECT question, evidence_id, arg_max({{'s': score, 'd': dense_score, 'p': sparse_score}}, {{'a': score, 'b': -round, 'c': -pos}}) AS b,
    list_sort(list(DISTINCT sub_problem_id)) AS subs, list_sort(list(DISTINCT retriever)) AS rets FROM cand GROUP BY question, evidence_id)
SELECT question, evidence_id, b.s AS score, b.d AS dense_score, b.p AS sparse_score, array_to_string(subs, ',') AS sub_problem_ids, array_to_string(rets, ',') AS retrievers,
  row_number() OVER (PARTITION BY question ORDER BY b.s DESC, b.d DESC NULLS LAST, b.p DESC NULLS LAST, evidence_id)::INTEGER AS final_rank FROM m"""
)
def merge_rounds(t: Tables):
    """#83, #117 candidates of several rounds as one list for each question."""
    out = rt.merged_rounds(candidates(t), ["question"])
    return out.withColumns({c: F.concat_ws(",", c) for c in ("sub_problem_ids", "retrievers")})


@query(
    f"""WITH {ROUNDS}, x AS (SELECT question, pos AS ledger_id, evidence_id, score, row_number() OVER (PARTITION BY question, evidence_id ORDER BY score DESC, pos) > 1 AS dup FROM cand)
SELECT question, ledger_id, evidence_id, score, CASE WHEN dup THEN 'deduped' WHEN row_number() OVER (PARTITION BY question, dup ORDER BY score DESC, ledger_id) <= 20 THEN 'selected' ELSE 'truncated' END AS decision FROM x"""
)
def context_select(t: Tables):
    """#174 selected, truncated and deduped candidates."""
    return rt.selection(candidates(t).select("question", F.col("pos").alias("ledger_id"), "evidence_id", "score"), 20, ["question"])


@query(
    f"""WITH {ROUNDS}, r AS (SELECT evidence_id::BIGINT AS doc_id, max(score) AS score FROM cand GROUP BY ALL ORDER BY score DESC, doc_id LIMIT 15),
p AS (SELECT DISTINCT doc_id - doc_id % 10 AS parent_id FROM r), pp AS (SELECT parent_id, max(r.score) - 0.01::DOUBLE AS score FROM p JOIN r ON r.doc_id - r.doc_id % 10 = parent_id WHERE parent_id NOT IN (SELECT doc_id FROM r) GROUP BY ALL ORDER BY score DESC, parent_id LIMIT 5)
SELECT doc_id, round(score, 6) AS score, 'hit' AS origin FROM r UNION ALL SELECT parent_id, round(score, 6), 'parent' FROM pp"""
)
def parent_supplement(t: Tables):
    """#175 parents of hits, a hundredth below their best child, in what capacity is left."""
    hits = candidates(t).groupBy(F.col("evidence_id").cast("long").alias("doc_id")).agg(F.max("score").alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(15)
    up = hits.select((F.col("doc_id") - F.col("doc_id") % 10).alias("parent_id"), "score").join(hits.select(F.col("doc_id").alias("parent_id")), "parent_id", "left_anti")
    up = up.groupBy("parent_id").agg((F.max("score") - 0.01).alias("score")).orderBy(F.col("score").desc(), "parent_id").limit(5)
    rows = hits.select("doc_id", F.round("score", 6).alias("score"), F.lit("hit").alias("origin"))
    return rows.unionByName(up.select(F.col("parent_id").alias("doc_id"), F.round("score", 6).alias("score"), F.lit("parent").alias("origin")))


@query(
    f"""WITH {SPARSE} SELECT item_id % 8 AS question, doc_id, max(round(score, 4)) AS score, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS sub_ids FROM ranked WHERE rank <= 10 GROUP BY ALL"""
)
def multi_query_recall(t: Tables):
    """#172 all sub-queries of a question in one job, merged."""
    g = sparse(t).groupBy((F.col("item_id") % 8).alias("question"), "doc_id")
    return g.agg(F.max(F.round("score", 4)).alias("score"), F.concat_ws(",", F.transform(F.array_sort(F.collect_set("item_id")), lambda x: x.cast("string"))).alias("sub_ids"))


@query(
    f"""WITH {CHUNKS}, asked AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'de' ELSE 'en' END AS scope FROM (SELECT doc_id FROM chunks UNION ALL SELECT -1 - doc_id FROM chunks WHERE doc_id < 100))
SELECT a.doc_id, CASE WHEN c.doc_id IS NULL THEN 'not_found' WHEN c.scope <> a.scope THEN 'scope_mismatch' WHEN c.status <> 'published' THEN 'unavailable' ELSE 'available' END AS state,
  CASE WHEN c.scope = a.scope AND c.status = 'published' THEN substr(c.text, 1, 500) END AS excerpt, p.doc_id AS parent_id
FROM asked a LEFT JOIN chunks c USING (doc_id) LEFT JOIN chunks p ON p.doc_id = c.doc_id - c.doc_id % 10 AND p.doc_id <> c.doc_id"""
)
def get_evidence(t: Tables):
    """#57, #119 evidence by id: availability, scope and parent."""
    ids = t.documents.select("doc_id")
    asked = ids.unionByName(ids.where("doc_id < 100").select((-1 - F.col("doc_id")).alias("doc_id")))  # and some that aren't there
    asked = asked.withColumn("wanted", F.when(F.col("doc_id") % 4 == 0, "de").otherwise("en"))
    c = t.chunks.select("doc_id", "scope", "status", "text", (F.col("doc_id") - F.col("doc_id") % 10).alias("up"), F.lit(True).alias("there"))
    parents = t.chunks.select(F.col("doc_id").alias("parent_id"))
    rows = asked.join(c, "doc_id", "left").join(parents, (F.col("up") == F.col("parent_id")) & (F.col("up") != F.col("doc_id")), "left")
    state = F.when(F.col("there").isNull(), "not_found").when(F.col("scope") != F.col("wanted"), "scope_mismatch").when(F.col("status") != "published", "unavailable").otherwise("available")
    rows = rows.withColumn("state", state)
    return rows.select("doc_id", "state", F.when(F.col("state") == "available", F.substring("text", 1, 500)).alias("excerpt"), "parent_id")


@query(
    f"""WITH {CHUNKS} SELECT doc_id, substr(text, 1, 500) AS excerpt_500, substr(text, 1, 160) AS excerpt_160, length(text) > 500 AS truncated, length(text)::BIGINT AS content_length FROM chunks"""
)
def excerpt(t: Tables):
    """#51, #186 excerpts, truncation flag and full length."""
    return t.chunks.select(
        "doc_id", F.substring("text", 1, 500).alias("excerpt_500"), F.substring("text", 1, 160).alias("excerpt_160"), (F.length("text") > 500).alias("truncated"), F.length("text").cast("long").alias("content_length")
    )
