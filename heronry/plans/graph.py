"""Queries over the graph, scopes, consolidation rules and retrieval quality."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heronry.functions import text as tx
from heronry.operators import events as ev
from heronry.operators import graph as gr
from heronry.operators import hashtree as ht
from heronry.operators import metrics as mt
from heronry.operators import retrieval as rt
from heronry.plans.base import CHUNKS, ENTRIES, LOG, NOW, VERSIONS, Tables, query
from heronry.plans.events import FULL, sql_pack
from heronry.plans.retrieval import HYBRID, SPARSE, hybrid_lists, sparse
from heronry.session import written

TS = f"TIMESTAMP '{NOW}'"
NATION, CUSTOMER, SUPPLIER, ORDER = 100, 10**12, 2 * 10**12, 3 * 10**12
INVERSE = {"part_of": "has_part", "has_part": "part_of", "belongs_to": "owns", "owns": "belongs_to"}
EDGES = f"""hard AS (
  SELECT n_nationkey::BIGINT + {NATION} AS src, n_regionkey::BIGINT AS dst, 'part_of' AS relation FROM nation
  UNION ALL SELECT c_custkey + {CUSTOMER}, c_nationkey + {NATION}, 'part_of' FROM customer
  UNION ALL SELECT o_orderkey + {ORDER}, o_custkey + {CUSTOMER}, 'belongs_to' FROM orders),
soft AS (SELECT s_suppkey + {SUPPLIER} AS src, s_nationkey::BIGINT + {NATION} AS dst, 'inferred' AS relation FROM supplier WHERE s_acctbal >= 0),
rows_ AS (SELECT *, TRUE AS is_hard FROM hard UNION ALL SELECT *, FALSE FROM soft),
edges AS (SELECT src, dst, relation, is_hard, 'out' AS direction FROM rows_ UNION ALL
  SELECT dst, src, CASE relation WHEN 'part_of' THEN 'has_part' WHEN 'belongs_to' THEN 'owns' ELSE relation END, is_hard, 'in' FROM rows_)"""
PATHS = f"""{EDGES}, paths(node, start, hop, weight, seen) AS (
  SELECT dst, src, 1, CASE WHEN is_hard THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END, [src] FROM edges WHERE src < 5
  UNION ALL SELECT e.dst, p.start, p.hop + 1, CASE WHEN e.is_hard THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END * power(0.5::DOUBLE, p.hop), list_append(p.seen, e.src)
  FROM paths p JOIN edges e ON e.src = p.node WHERE p.hop < 3 AND NOT list_contains(p.seen, e.dst)),
best AS (SELECT node, start, hop, weight FROM paths QUALIFY row_number() OVER (PARTITION BY node ORDER BY weight DESC, hop, start) = 1)"""


def edges(t: Tables):
    id_ = lambda c, base: (F.col(c).cast("long") + F.lit(base).cast("long"))
    hard = rt.unioned(
        [
            t.nation.select(id_("n_nationkey", NATION).alias("src"), id_("n_regionkey", 0).alias("dst"), F.lit("part_of").alias("relation")),
            t.customer.select(id_("c_custkey", CUSTOMER).alias("src"), id_("c_nationkey", NATION).alias("dst"), F.lit("part_of").alias("relation")),
            t.orders.select(id_("o_orderkey", ORDER).alias("src"), id_("o_custkey", CUSTOMER).alias("dst"), F.lit("belongs_to").alias("relation")),
        ]
    )
    state = F.when(F.col("s_acctbal") >= 0, "active").otherwise("candidate")
    soft = t.supplier.select(id_("s_suppkey", SUPPLIER).alias("src"), id_("s_nationkey", NATION).alias("dst"), F.lit("inferred").alias("relation"), state.alias("state"))
    return gr.directed(hard, soft, INVERSE)


def seeds(t: Tables):
    return t.region.select(F.col("r_regionkey").cast("long").alias("node"))


@query(f"WITH {EDGES} SELECT src, dst, relation, is_hard, direction FROM edges")
def directed_edges(t: Tables):
    """#99, #122 hard and active soft edges, each way."""
    return edges(t)


@query(f"WITH RECURSIVE {PATHS} SELECT node, start, hop, weight FROM best")
def graph_best_path(t: Tables):
    """#61, #88 best path to every node within three hops of the regions."""
    return gr.best_reached(edges(t), seeds(t), 3)


@query(f"WITH RECURSIVE {PATHS} SELECT node, start, hop, weight FROM best ORDER BY weight DESC, hop, node LIMIT 20")
def graph_expand(t: Tables):
    """#121 expansion with a budget of 20 nodes."""
    return gr.best_reached(edges(t), seeds(t), 3).orderBy(F.col("weight").desc(), "hop", "node").limit(20)


# A third list for fusion: documents next to a hit in the order of ids, as a graph.
GRAPHED = f"""{HYBRID}, sd AS (SELECT DISTINCT item_id, doc_id FROM dr UNION SELECT DISTINCT item_id, doc_id FROM sr),
gh AS (SELECT item_id, d.doc_id, max(CASE WHEN d.doc_id = s.doc_id + 1 THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END) AS w FROM sd s JOIN documents d ON d.doc_id IN (s.doc_id + 1, s.doc_id - 1) GROUP BY ALL),
gl AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY w DESC, doc_id)::INTEGER AS rank FROM gh QUALIFY rank <= 20)"""


@query(
    f"""WITH {GRAPHED}, f AS (SELECT item_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS fused_score, min(CASE WHEN p = 'd' THEN rank END) AS dr_, min(CASE WHEN p = 's' THEN rank END) AS sr_, min(CASE WHEN p = 'g' THEN rank END) AS graph_rank
FROM (SELECT 'd' AS p, item_id, doc_id, rank FROM dr UNION ALL SELECT 's', item_id, doc_id, rank FROM sr UNION ALL SELECT 'g', item_id, doc_id, rank FROM gl) GROUP BY ALL)
SELECT item_id, doc_id, round(fused_score, 9) AS fused_score, graph_rank, row_number() OVER (PARTITION BY item_id ORDER BY round(fused_score, 9) DESC, dr_ NULLS LAST, sr_ NULLS LAST, graph_rank NULLS LAST, doc_id::VARCHAR)::INTEGER AS final_rank FROM f"""
)
def graph_recall(t: Tables):
    """#123, #124 graph hits of the dense and sparse hits as the third list."""
    lists = hybrid_lists(t)
    start = lists["dense"].select("item_id", "doc_id").unionByName(lists["sparse"].select("item_id", "doc_id")).distinct()
    near = start.select("item_id", F.explode(F.array(F.struct((F.col("doc_id") + 1).alias("d"), F.lit(1.0).alias("w")), F.struct((F.col("doc_id") - 1).alias("d"), F.lit(0.3).alias("w")))).alias("x"))
    near = near.select("item_id", F.col("x.d").alias("doc_id"), "x.w").join(t.documents.select("doc_id"), "doc_id", "left_semi").groupBy("item_id", "doc_id").agg(F.max("w").alias("score"))
    out = rt.fused(lists | {"graph": rt.ranked(near, "item_id", "score", "doc_id", 20)}, "item_id", "doc_id")
    return out.select("item_id", "doc_id", F.round("fused_score", 9).alias("fused_score"), "graph_rank", "final_rank")


@query("SELECT DISTINCT l_partkey AS src, l_suppkey AS dst, l_returnflag AS relation, l_linestatus AS direction FROM lineitem")
def edge_dedup(t: Tables):
    """#100 one edge per key."""
    e = t.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("relation"), F.col("l_linestatus").alias("direction"))
    return gr.deduped(e, ["src", "dst", "relation", "direction"], gr.parts_of(t.lineitem))


@query("SELECT DISTINCT l_partkey AS src, l_suppkey AS dst, l_returnflag AS relation FROM lineitem WHERE l_returnflag IN ('R', 'A') AND regexp_full_match(lower(l_returnflag), '[a-z][a-z0-9_]{0,62}') AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def edge_write_valid(t: Tables):
    """#125 edges with a declared relation whose target isn't blocked."""
    words = t.rows("relation string", ("R",), ("A",))
    e = t.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("relation"))
    e = e.where(F.lower("relation").rlike("^[a-z][a-z0-9_]{0,62}$")).join(F.broadcast(words), "relation", "left_semi")  # else a relation is a task
    parts = gr.parts_of(t.lineitem)
    e = gr.deduped(e, ["src", "dst", "relation"], parts).repartition(parts, "dst")
    return e.join(t.supplier.where("s_acctbal < 0").select(F.col("s_suppkey").alias("dst")), "dst", "left_anti").select("src", "dst", "relation")


REL = "rel AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS src, l_suppkey AS dst, round(l_discount * 10, 3) AS confidence, CASE WHEN l_linenumber % 3 = 0 THEN [] ELSE [l_orderkey] END AS evidence FROM lineitem)"


def relations(t: Tables):
    ev_ = F.when(F.col("l_linenumber") % 3 == 0, F.array().cast("array<bigint>")).otherwise(F.array("l_orderkey"))
    return t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.round(F.col("l_discount") * 10, 3).alias("confidence"), ev_.alias("evidence"))


@query(f"WITH {REL} SELECT id, confidence, CASE WHEN confidence >= 0.6 AND len(evidence) > 0 THEN 'active' ELSE 'candidate' END AS state FROM rel")
def soft_lifecycle(t: Tables):
    """#131 active from 0.6 on, with evidence."""
    return relations(t).select("id", "confidence", gr.lifecycle(F.col("confidence"), F.col("evidence")).alias("state"))


@query(f"WITH {REL}, top AS (SELECT src, dst, max(confidence) AS c, arg_min(id, {{'a': -confidence, 'b': id}}) AS i FROM rel GROUP BY ALL) SELECT id, confidence, CASE WHEN confidence < c THEN i END AS superseded_by FROM rel JOIN top USING (src, dst)")
def soft_supersede(t: Tables):
    """#132 the strictly most confident relation closes the others."""
    return gr.superseded(relations(t), ["src", "dst"]).select("id", "confidence", "superseded_by")


@query(f"WITH RECURSIVE {FULL}, ch(node, depth, root) AS (SELECT memory_id, 0, memory_id FROM red WHERE supersedes IS NULL UNION ALL SELECT r.memory_id, depth + 1, root FROM ch JOIN red r ON r.supersedes = ch.node WHERE depth < 32) SELECT node, depth, root, FALSE AS too_deep FROM ch")
def supersede_chain(t: Tables):
    """#148, #219 depth and root of every revision chain."""
    return gr.chain_depth(ev.reduced_entries(t.log).select(F.col("memory_id").alias("node"), F.col("supersedes").alias("parent")))


LINKS = f"{FULL}, top AS (SELECT scope_id, max(memory_id) AS node FROM red WHERE supersedes IS NOT NULL GROUP BY 1), links AS (SELECT memory_id AS src, supersedes AS dst FROM red WHERE supersedes IS NOT NULL)"


@query(f"WITH RECURSIVE {LINKS}, b(node, depth) AS (SELECT node, 0 FROM top UNION SELECT dst, depth + 1 FROM b JOIN links ON src = node WHERE depth < 2), f AS (SELECT node, min(depth) AS hop FROM b GROUP BY 1) SELECT node, hop FROM f WHERE hop > 0 ORDER BY hop, node LIMIT 8")
def link_expand(t: Tables):
    """#153 two hops along links, eight nodes."""
    red = ev.reduced_entries(t.log).where("supersedes is not null")
    top = red.groupBy("scope_id").agg(F.max("memory_id").alias("node")).select("node")
    return gr.capped_expansion(red.select(F.col("memory_id").alias("src"), F.col("supersedes").alias("dst")), top, 2, 8)


@query(f"WITH RECURSIVE {EDGES}, b(node, depth) AS (SELECT r_regionkey::BIGINT, 0 FROM region UNION SELECT e.dst, depth + 1 FROM b JOIN edges e ON e.src = b.node AND e.direction = 'in' AND e.is_hard WHERE depth < 2) SELECT node, min(depth) AS depth FROM b GROUP BY 1 ORDER BY depth, node LIMIT 128")
def propagate(t: Tables):
    """#162 dependants by depth, at most 128 of them visited."""
    back = edges(t).where("direction = 'in' and is_hard").select("src", "dst")
    return gr.reached(back, seeds(t), 2).orderBy("depth", "node").limit(128)


NEEDS = "needs AS (SELECT p_partkey AS node, p_partkey // 3 AS need FROM part WHERE p_partkey > 0 UNION SELECT p_partkey, p_partkey // 5 FROM part WHERE p_partkey > 0)"


@query(f"WITH RECURSIVE {NEEDS}, d(node, level) AS (SELECT 0::BIGINT, 0 UNION SELECT n.node, level + 1 FROM d JOIN needs n ON n.need = d.node) SELECT p_partkey AS node, max(level) AS level FROM part LEFT JOIN d ON d.node = p_partkey GROUP BY 1")
def topo_levels(t: Tables):
    """#163 levels of proposals by what they need."""
    p = t.part.select(F.col("p_partkey").alias("node"))
    needs = p.where("node > 0").select("node", F.explode(F.array(F.expr("node div 3"), F.expr("node div 5"))).alias("need")).distinct()
    return gr.levels(p, needs)


SAME = "pre AS (SELECT min(doc_id) AS u, substr(text, 1, 60) AS p FROM documents GROUP BY 2), post AS (SELECT min(doc_id) AS u, right(text, 60) AS p FROM documents GROUP BY 2), e AS (SELECT u, doc_id AS v FROM documents JOIN pre ON p = substr(text, 1, 60) UNION SELECT u, doc_id FROM documents JOIN post ON p = right(text, 60))"


@query(f"WITH RECURSIVE {SAME}, b AS (SELECT u, v FROM e WHERE u <> v UNION SELECT v, u FROM e WHERE u <> v), r(node, seen) AS (SELECT DISTINCT u, u FROM b UNION SELECT node, b.v FROM r JOIN b ON b.u = r.seen) SELECT node, min(seen) AS component FROM r GROUP BY 1")
def components(t: Tables):
    """#164 documents connected by equal beginnings or equal ends."""
    d = t.documents
    stars = [d.select("doc_id", key.alias("p")) for key in (F.substring("text", 1, 60), F.right("text", F.lit(60)))]
    e = [s.join(s.groupBy("p").agg(F.min("doc_id").alias("u")), "p").select("u", F.col("doc_id").alias("v")) for s in stars]
    return gr.components(rt.unioned(e))


@query("""WITH RECURSIVE g AS (SELECT c_nationkey AS scope_id, c_custkey AS id, 1 + c_custkey % 7 AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS pos FROM customer),
fold(g, pos, used, picked) AS (
  SELECT DISTINCT scope_id, 0::BIGINT, 0::BIGINT, FALSE FROM g
  UNION ALL SELECT f.g, f.pos + 1, CASE WHEN f.used + r.n <= 60 THEN f.used + r.n ELSE f.used END, f.used + r.n <= 60 FROM fold f JOIN g r ON r.scope_id = f.g AND r.pos = f.pos + 1)
SELECT g.scope_id, g.id, CASE WHEN f.picked THEN 'accept' ELSE 'QUOTA_EXCEEDED' END AS outcome FROM g JOIN fold f ON f.g = g.scope_id AND f.pos = g.pos""")
def group_quota(t: Tables):
    """#165 groups in order against a quota; one that doesn't fit is rejected, later ones may fit."""
    rows = t.customer.select(F.col("c_nationkey").alias("scope_id"), F.col("c_custkey").alias("id"), (1 + F.col("c_custkey") % 7).alias("creates"))
    out = ev.quota_packed(rows, "scope_id", "id", "creates", 60)
    return out.select("scope_id", "id", F.when(F.col("picked"), "accept").otherwise("QUOTA_EXCEEDED").alias("outcome"))


# Scopes.
@query("SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'fr')")
def scope_filter(t: Tables):
    """#42 any of the scopes."""
    return t.documents.where(F.col("lang").isin("de", "fr")).select("doc_id", "lang")


@query("SELECT c_custkey, c_name FROM customer WHERE lower(c_name) = 'customer#000000007' OR c_name ILIKE '%0042%' OR c_custkey = 99")
def fuzzy_ref(t: Tables):
    """#44 equal name, part of it, or number."""
    return t.customer.where((F.lower("c_name") == "customer#000000007") | F.col("c_name").ilike("%0042%") | (F.col("c_custkey") == 99)).select("c_custkey", "c_name")


REFS = "refs(ref) AS (VALUES ('3'), ('nation_4'), ('region:ASIA'), ('NATION_1'), ('nowhere'), ('segment:BUILDING'))"
SCOPES = "scopes AS (SELECT n_nationkey::BIGINT AS scope_id, lower(n_name) AS slug, 'nation' AS type, n_name AS name FROM nation UNION ALL SELECT 1000 + r_regionkey, lower(r_name), 'region', r_name FROM region)"


@query(
    f"""WITH {REFS}, {SCOPES}, c AS (SELECT ref, s.scope_id, CASE WHEN ref = s.scope_id::VARCHAR THEN 1 WHEN lower(ref) = slug THEN 2 ELSE 3 END AS step FROM refs JOIN scopes s ON ref = s.scope_id::VARCHAR OR lower(ref) = slug OR ref = s.type || ':' || s.name),
b AS (SELECT ref, scope_id, count(*) OVER (PARTITION BY ref, step) AS n, step, min(step) OVER (PARTITION BY ref) AS m FROM c)
SELECT r.ref, CASE WHEN b.n = 1 THEN b.scope_id END AS scope_id, CASE WHEN b.ref IS NULL THEN 'none' WHEN b.n > 1 THEN 'ambiguous' ELSE 'resolved' END AS state FROM refs r LEFT JOIN (SELECT DISTINCT ref, CASE WHEN n = 1 THEN scope_id END AS scope_id, n FROM b WHERE step = m) b ON b.ref = r.ref"""
)
def scope_resolve(t: Tables):
    """#45, #101 number, then slug, then type:name; several are ambiguous."""
    refs = t.rows("ref string", ("3",), ("nation_4",), ("region:ASIA",), ("NATION_1",), ("nowhere",), ("segment:BUILDING",))
    s = t.nation.select(F.col("n_nationkey").cast("long").alias("scope_id"), F.lower("n_name").alias("slug"), F.concat(F.lit("nation:"), "n_name").alias("full"))
    s = s.unionByName(t.region.select((F.col("r_regionkey") + 1000).cast("long").alias("scope_id"), F.lower("r_name").alias("slug"), F.concat(F.lit("region:"), "r_name").alias("full")))
    keys = s.select("scope_id", F.explode(F.array(F.struct(F.lit(1).alias("step"), F.col("scope_id").cast("string").alias("key")), F.struct(F.lit(2).alias("step"), F.col("slug").alias("key")), F.struct(F.lit(3).alias("step"), F.col("full").alias("key")))).alias("k")).select("scope_id", "k.*")
    asked = refs.select("ref", F.explode(F.array(F.struct(F.lit(1).alias("step"), F.col("ref").alias("key")), F.struct(F.lit(2).alias("step"), F.lower("ref").alias("key")), F.struct(F.lit(3).alias("step"), F.col("ref").alias("key")))).alias("k")).select("ref", "k.*")
    hits = asked.join(keys, ["step", "key"]).groupBy("ref", "step").agg(F.count("*").alias("n"), F.min("scope_id").alias("scope_id"))
    first = hits.groupBy("ref").agg(F.min_by(F.struct("n", "scope_id"), "step").alias("b"))
    out = refs.join(first, "ref", "left")
    return out.select("ref", F.when(F.col("b.n") == 1, F.col("b.scope_id")).alias("scope_id"), F.when(F.col("b").isNull(), "none").when(F.col("b.n") > 1, "ambiguous").otherwise("resolved").alias("state"))


BINDINGS = "bind(id, path, priority) AS (VALUES (1, '/fr', 1), (2, '/fr/8', 1), (3, '/en', 5), (4, '/en', 5), (5, '/de', 1), (6, '/de', 2))"
PATHS_ = "pages_ AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM pages)"


@query(
    f"""WITH {BINDINGS}, {PATHS_}, c AS (SELECT page_id, id, rank() OVER (PARTITION BY page_id ORDER BY length(b.path) DESC, priority DESC) AS r FROM pages_ p JOIN bind b ON p.path = b.path OR starts_with(p.path, b.path || '/'))
SELECT page_id, CASE WHEN count(*) = 1 THEN min(id) END AS binding_id, count(*) > 1 AS ambiguous FROM c WHERE r = 1 GROUP BY 1"""
)
def longest_prefix(t: Tables):
    """#46 longest bound path, then priority; ties are ambiguous. Pages meet bindings by their own prefixes."""
    bind = t.rows("id int, bound string, priority int", (1, "/fr", 1), (2, "/fr/8", 1), (3, "/en", 5), (4, "/en", 5), (5, "/de", 1), (6, "/de", 2))
    parts = F.split(F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1), "/")
    prefix = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    hits = t.pages.select("page_id", F.explode(F.array_distinct(prefix)).alias("bound")).join(bind, "bound")
    best = hits.withColumn("r", F.rank().over(Window.partitionBy("page_id").orderBy(F.length("bound").desc(), F.col("priority").desc()))).where("r = 1")
    return best.groupBy("page_id").agg(F.when(F.count("*") == 1, F.min("id")).alias("binding_id"), (F.count("*") > 1).alias("ambiguous"))


@query(f"WITH {VERSIONS} SELECT source_id, EXISTS (SELECT 1 FROM chunks c WHERE c.source_id = s.source_id AND c.status = 'published') AS lexical_ready, EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s.source_id AND l_quantity > 49) AS graph_ready FROM (SELECT DISTINCT source_id FROM chunks) s")
def exists_probe(t: Tables):
    """#52 readiness of every source."""
    ready = t.chunks.where("status = 'published'").select("source_id").distinct().withColumn("l", F.lit(True))
    graph = t.lineitem.where("l_quantity > 49").select(F.col("l_suppkey").alias("source_id")).distinct().withColumn("g", F.lit(True))
    rows = t.chunks.select("source_id").distinct().join(ready, "source_id", "left").join(graph, "source_id", "left")
    return rows.select("source_id", F.coalesce("l", F.lit(False)).alias("lexical_ready"), F.coalesce("g", F.lit(False)).alias("graph_ready"))


@query("SELECT p_partkey, NOT (p_size % 2 = 0) OR (p_size % 3 = 0 AND p_size % 5 <> 0) AS valid FROM part")
def capability_gate(t: Tables):
    """#53 graph readiness needs dense and lexical readiness."""
    graph, dense, lexical = F.col("p_size") % 2 == 0, F.col("p_size") % 3 == 0, F.col("p_size") % 5 != 0
    return t.part.select("p_partkey", (~graph | (dense & lexical)).alias("valid"))


TRIPLES = "triples AS (SELECT n_nationkey AS scope_id, coalesce(c.p, 0) AS project_id, v AS version_id FROM nation LEFT JOIN (SELECT c_nationkey, min(c_custkey) AS p FROM customer WHERE c_acctbal > 9000 GROUP BY 1) c ON c_nationkey = n_nationkey, (VALUES (1), (2)) t(v))"


def triples(t: Tables):
    projects = t.customer.where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("scope_id")).agg(F.min("c_custkey").alias("p"))
    rows = t.nation.select(F.col("n_nationkey").alias("scope_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("version_id")).join(projects, "scope_id", "left")
    return rows.select("scope_id", F.coalesce("p", F.lit(0)).cast("long").alias("project_id"), "version_id")


@query(f"WITH {TRIPLES} SELECT scope_id, project_id::BIGINT AS project_id, version_id FROM triples")
def scope_triples(t: Tables):
    """#211 scopes, projects and versions; no project is 0."""
    return triples(t)


@query(f"WITH {TRIPLES} SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM triples x WHERE x.scope_id = c.c_nationkey AND x.project_id = c.c_custkey AND x.version_id = 1)")
def triple_semi(t: Tables):
    """#54 rows whose scope, project and version are allowed together."""
    return t.customer.select("c_custkey", F.col("c_nationkey").alias("scope_id"), F.col("c_custkey").alias("project_id"), F.lit(1).alias("version_id")).join(triples(t), ["scope_id", "project_id", "version_id"], "left_semi").select("c_custkey")


@query("SELECT n_regionkey AS domain, CASE WHEN count(DISTINCT c_mktsegment) = 1 THEN min(c_mktsegment) END AS override, count(DISTINCT c_mktsegment)::BIGINT AS keys FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT -1, CASE WHEN count(DISTINCT r_name) FILTER (WHERE r_regionkey = 1) = 1 THEN 'AMERICA' END, 1::BIGINT FROM region")
def single_or_null(t: Tables):
    """#212 an override only where there is exactly one."""
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("domain"), F.col("c_mktsegment").alias("key"))
    rows = rows.unionByName(t.region.where("r_regionkey = 1").select(F.lit(-1).alias("domain"), F.col("r_name").alias("key")))
    n = F.countDistinct("key")
    return rows.groupBy("domain").agg(F.when(n == 1, F.min("key")).alias("override"), n.alias("keys"))


@query("SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON r_regionkey = n_regionkey AND r_name <> 'ASIA'")
def domain_listing(t: Tables):
    """#58 scopes with their domain, if it is listed."""
    return t.nation.join(t.region.where("r_name <> 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "n_name", "r_name")


# Sources, chunks and versions.
@query(f"WITH {VERSIONS} SELECT c.doc_id, c.version_id, v.status, c.source, sha256(c.text) AS content_hash FROM chunks c JOIN versions v ON v.version_id = c.version_id")
def evidence_facts(t: Tables):
    """#55 chunk, version and source of all evidence."""
    return t.chunks.select("doc_id", "version_id", "source", F.sha2("text", 256).alias("content_hash")).join(t.versions.select("version_id", "status"), "version_id").select("doc_id", "version_id", "status", "source", "content_hash")


@query(f"WITH {CHUNKS} SELECT doc_id, doc_id - doc_id % 10 AS parent_id, substr(p, 1, 100) AS parent_excerpt FROM (SELECT c.doc_id, p.text AS p FROM chunks c LEFT JOIN chunks p ON p.doc_id = c.doc_id - c.doc_id % 10)")
def parent_context(t: Tables):
    """#57 parent of each chunk."""
    c = t.chunks.select("doc_id", (F.col("doc_id") - F.col("doc_id") % 10).alias("parent_id"))
    p = t.chunks.select(F.col("doc_id").alias("parent_id"), F.substring("text", 1, 100).alias("parent_excerpt"))
    return c.join(p, "parent_id", "left").select("doc_id", "parent_id", "parent_excerpt")


@query("WITH l AS (SELECT doc_id, sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS last, length(x) AS n, i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)), r AS (SELECT doc_id, (length(text) * 0.5)::BIGINT AS pos FROM documents) SELECT r.doc_id, r.pos, min(l.i)::BIGINT AS line FROM r JOIN l ON l.doc_id = r.doc_id AND r.pos BETWEEN l.last - l.n - 1 AND l.last GROUP BY ALL")
def line_range_join(t: Tables):
    """#62 the line whose range holds a place; the first if two do."""
    lines = F.split("text", "\n")
    d = t.documents.select("doc_id", F.posexplode(lines).alias("i", "x"), F.round(F.length("text") * 0.5, 0).cast("long").alias("pos"))
    last = F.sum(F.length("x") + 1).over(Window.partitionBy("doc_id").orderBy("i"))
    rows = d.withColumn("last", last).where(F.col("pos").between(F.col("last") - F.length("x") - 1, F.col("last")))
    return rows.groupBy("doc_id", "pos").agg((F.min("i") + 1).cast("long").alias("line"))


@query("SELECT i.item_id, min(d.doc_id) AS doc_id FROM (SELECT item_id, substr(text, 1, 12) AS p FROM benchmark) i JOIN documents d ON substr(d.text, 1, 12) = i.p OR starts_with(d.text, i.p) GROUP BY 1")
def prefix_join(t: Tables):
    """#63 first document that begins as the item does; an equi-join on the prefix."""
    i = t.benchmark.select("item_id", F.substring("text", 1, 12).alias("p"))
    d = t.documents.select("doc_id", F.substring("text", 1, 12).alias("p"))
    return i.join(d, "p").groupBy("item_id").agg(F.min("doc_id").alias("doc_id"))


@query(f"WITH {ENTRIES} SELECT memory_id FROM entries WHERE substr(evidence_refs[1], 4)::BIGINT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def anchor_semi(t: Tables):
    """#65 entries whose anchor is allowed."""
    allowed = t.documents.where("lang = 'en'").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("ref"))
    return t.entries.where("evidence_refs is not null").select("memory_id", F.col("evidence_refs")[0].alias("ref")).join(allowed, "ref", "left_semi").select("memory_id")


@query("WITH k AS (SELECT doc_id, lang, sha256(replace(text, chr(13) || chr(10), chr(10))) AS h FROM documents) SELECT doc_id, min(doc_id) OVER (PARTITION BY lang, h) AS keeper, count(*) OVER (PARTITION BY lang, h)::BIGINT AS n FROM k")
def exact_dedup(t: Tables):
    """#68, #161, #192 equal content and metadata; the smallest id stays. Aggregated before the join, so a large
    group isn't one task's."""
    k = t.documents.select("doc_id", "lang", F.sha2(F.regexp_replace("text", "\r\n", "\n"), 256).alias("h"))
    g = k.groupBy("lang", "h").agg(F.min("doc_id").alias("keeper"), F.count("*").alias("n"))
    return k.join(g, ["lang", "h"]).select("doc_id", "keeper", "n")


@query("SELECT doc_id, sha256(text) AS sha, octet_length(encode(text))::BIGINT AS size_bytes, octet_length(encode(text)) BETWEEN 1 AND 20971520 AS admitted FROM documents")
def content_hash(t: Tables):
    """#6, #189 hash, size and admission of every source."""
    n = F.octet_length("text").cast("long")
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha"), n.alias("size_bytes"), n.between(1, 20971520).alias("admitted"))


@query("SELECT doc_id FROM documents WHERE source NOT IN ('src3', 'src7')")
def delete_by_source(t: Tables):
    """#7 what is left after sources are deleted."""
    return t.documents.join(t.rows("source string", ("src3",), ("src7",)), "source", "left_anti").select("doc_id")


@query(f"WITH {VERSIONS}, gone AS (SELECT version_id FROM versions WHERE status = 'superseded') SELECT 'chunks' AS kind, count(*)::BIGINT AS n FROM chunks WHERE version_id NOT IN (SELECT version_id FROM gone) UNION ALL SELECT 'vectors', count(*)::BIGINT FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM chunks WHERE version_id IN (SELECT version_id FROM gone)) UNION ALL SELECT 'versions', count(*)::BIGINT FROM versions WHERE status <> 'superseded'")
def purge_cascade(t: Tables):
    """#16 rows left of each kind after a purge of superseded versions."""
    gone = t.versions.where("status = 'superseded'").select("version_id")
    dead = t.chunks.join(gone, "version_id", "left_semi").select(F.col("doc_id").alias("vec_id"))
    left = {"chunks": t.chunks.join(gone, "version_id", "left_anti"), "vectors": t.embeddings.join(dead, "vec_id", "left_anti"), "versions": t.versions.join(gone, "version_id", "left_anti")}
    return rt.unioned(df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in left.items())


@query(f"WITH x AS (SELECT event_id, user_id, ts FROM events WHERE ts + INTERVAL 7 DAY < {TS}), p AS (SELECT DISTINCT user_id FROM x) SELECT 'runs' AS kind, count(*)::BIGINT AS purged FROM x UNION ALL SELECT 'sessions', count(*)::BIGINT FROM p WHERE user_id NOT IN (SELECT user_id FROM events WHERE ts + INTERVAL 7 DAY >= {TS})")
def ttl_purge(t: Tables):
    """#168 audit rows past their time, then sessions that have no rows left."""
    old = F.expr("ts + interval 7 days") < ev.moment(NOW)
    gone, left = t.events.where(old), t.events.where(~old)
    sessions = gone.select("user_id").distinct().join(left.select("user_id"), "user_id", "left_anti")
    return rt.unioned(df.agg(F.count("*").alias("purged")).select(F.lit(k).alias("kind"), "purged") for k, df in (("runs", gone), ("sessions", sessions)))


@query(f"""WITH {CHUNKS}, e AS (SELECT scope, sha256(concat_ws('|', doc_id::VARCHAR, sha256(text))) AS h FROM chunks WHERE status = 'published'),
q AS (SELECT scope, substr(h, 1, 4) AS b, sha256(string_agg(h, '' ORDER BY h)) AS h FROM e GROUP BY ALL), p AS (SELECT scope, substr(b, 1, 2) AS b, sha256(string_agg(h, '' ORDER BY b)) AS h FROM q GROUP BY scope, substr(b, 1, 2)),
f AS (SELECT scope, sha256(string_agg(h, '' ORDER BY b)) AS snapshot FROM p GROUP BY 1) SELECT scope, n, snapshot FROM f JOIN (SELECT scope, count(*)::BIGINT AS n FROM e GROUP BY 1) USING (scope)""")
def evidence_snapshot_hash(t: Tables):
    """#213 hash of each scope's published evidence."""
    rows = t.chunks.where("status = 'published'").select("scope", "doc_id", F.sha2("text", 256).alias("content"))
    return ev.fingerprint(rows, ["doc_id", "content"], ["scope"]).withColumnRenamed("fingerprint", "snapshot").join(rows.groupBy("scope").agg(F.count("*").alias("n")), "scope").select("scope", "n", "snapshot")


@query("SELECT d.doc_id, CASE WHEN f.doc_id = d.doc_id THEN 'created' WHEN f.source = d.source THEN 'existing' ELSE 'conflict' END AS outcome, CASE WHEN f.doc_id <> d.doc_id THEN f.doc_id END AS existing_id FROM documents d JOIN (SELECT lang, sha256(text) AS h, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY ALL) f ON f.lang = d.lang AND f.h = sha256(d.text)")
def write_outcome(t: Tables):
    """#146 first write creates; the same again is the existing one, with other metadata a conflict."""
    d = t.documents.select("doc_id", "lang", "source", F.sha2("text", 256).alias("h"))
    first = d.groupBy("lang", "h").agg(F.min("doc_id").alias("first_id"), F.min_by("source", "doc_id").alias("first_source"))
    same = F.col("first_id") == F.col("doc_id")
    outcome = F.when(same, "created").when(F.col("first_source") == F.col("source"), "existing").otherwise("conflict")
    return d.join(first, ["lang", "h"]).select("doc_id", outcome.alias("outcome"), F.when(~same, F.col("first_id")).alias("existing_id"))


# Entries against each other.
@query(f"WITH {ENTRIES}, h AS (SELECT scope_id, session_id, evidence_refs[1] AS ref, max(memory_id) AS hard_id FROM entries WHERE provenance = 'hard' AND status = 'active' AND evidence_refs IS NOT NULL GROUP BY ALL) SELECT h.hard_id, e.memory_id AS corrected_id FROM entries e JOIN h ON h.scope_id = e.scope_id AND h.session_id = e.session_id AND h.ref = e.evidence_refs[1] WHERE e.provenance <> 'hard' AND e.status = 'active' AND e.memory_id < h.hard_id")
def correction_pairs(t: Tables):
    """#161 newest hard entry of an anchor corrects older soft ones."""
    rows = t.entries.where("status = 'active' and evidence_refs is not null").select("memory_id", "scope_id", "session_id", "provenance", F.col("evidence_refs")[0].alias("ref"))
    hard = rows.where("provenance = 'hard'").groupBy("scope_id", "session_id", "ref").agg(F.max("memory_id").alias("hard_id"))
    return rows.where("provenance <> 'hard'").join(hard, ["scope_id", "session_id", "ref"]).where("memory_id < hard_id").select("hard_id", F.col("memory_id").alias("corrected_id"))


PENDING = f"{ENTRIES}, el AS (SELECT * FROM entries WHERE kind = 'episodic' AND status = 'active' AND (expires_at IS NULL OR expires_at > {TS}) AND (valid_to IS NULL OR valid_to > {TS}) AND observed_at < {TS} AND memory_id NOT IN (SELECT event_id FROM events WHERE event_type = 'signup' AND value > 100))"


def pending(t: Tables):
    now = ev.moment(NOW)
    consumed = t.events.where("event_type = 'signup' and value > 100").select(F.col("event_id").alias("memory_id"))
    rows = t.entries.where((F.col("kind") == "episodic") & (F.col("status") == "active") & (F.col("observed_at") < now))
    rows = rows.where((F.col("expires_at").isNull() | (F.col("expires_at") > now)) & (F.col("valid_to").isNull() | (F.col("valid_to") > now)))
    return rows.join(consumed, "memory_id", "left_anti")


@query(f"WITH {PENDING} SELECT scope_id, count(*)::BIGINT AS n FROM el GROUP BY 1")
def pending_count(t: Tables):
    """#160 eligible and unconsumed."""
    return pending(t).groupBy("scope_id").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {PENDING}, w AS (SELECT scope_id, memory_id, length(content) AS n, row_number() OVER (PARTITION BY scope_id ORDER BY observed_at, memory_id)::INTEGER AS pos FROM el QUALIFY pos <= 32), {sql_pack('w', 'scope_id', 900, 32)} SELECT w.scope_id, w.memory_id, w.pos FROM w JOIN fold f ON f.g = w.scope_id AND f.pos = w.pos WHERE f.picked")
def window_select(t: Tables):
    """#159 a batch in order of time within the budget."""
    rows = pending(t).withColumn("chars", F.length("content"))
    return ev.budget_packed(rows, "scope_id", [F.col("observed_at"), F.col("memory_id")], "chars", 900, 32, ["memory_id"]).where("picked").select("scope_id", "memory_id", "pos")


ELIG = "CASE WHEN status <> 'active' OR kind <> 'semantic' OR provenance = 'hard' OR salience < 0.5 OR evidence_refs IS NULL THEN 'CANDIDATE_NOT_ELIGIBLE' WHEN f.status_ IS NULL OR f.status_ <> 'published' THEN 'EVIDENCE_UNAVAILABLE' WHEN f.source_id % 5 + 1 <> scope_id THEN 'SCOPE_MISMATCH' ELSE 'ELIGIBLE' END"


@query(f"WITH {ENTRIES}, {CHUNKS} SELECT memory_id, {ELIG} AS reason FROM entries e LEFT JOIN (SELECT doc_id, status AS status_, source_id FROM chunks) f ON 'doc' || f.doc_id = e.evidence_refs[1]")
def candidate_eligible(t: Tables):
    """#166, #217 candidates against current facts; the first reason counts."""
    facts = t.chunks.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("ref"), F.col("status").alias("fact_status"), "source_id")
    rows = t.entries.withColumn("ref", F.element_at("evidence_refs", 1)).join(facts, "ref", "left")
    bad = (F.col("status") != "active") | (F.col("kind") != "semantic") | (F.col("provenance") == "hard") | (F.col("salience") < 0.5) | F.col("evidence_refs").isNull()
    reason = F.when(bad, "CANDIDATE_NOT_ELIGIBLE").when(F.col("fact_status").isNull() | (F.col("fact_status") != "published"), "EVIDENCE_UNAVAILABLE")
    return rows.select("memory_id", reason.when(F.col("source_id") % 5 + 1 != F.col("scope_id"), "SCOPE_MISMATCH").otherwise("ELIGIBLE").alias("reason"))


@query(f"WITH {ENTRIES} SELECT memory_id, CASE WHEN provenance = 'hard' AND status = 'active' AND memory_id % 2 = 0 THEN 'HARD_MEMORY_PROTECTED' WHEN status <> 'active' THEN 'TARGET_NOT_ACTIVE' WHEN salience < 0.2 THEN 'CONFIDENCE_LOW' ELSE 'accept' END AS decision FROM entries")
def adjudicate_rules(t: Tables):
    """#167 guard of hard entries, then state, then confidence."""
    hard = (F.col("provenance") == "hard") & (F.col("status") == "active") & (F.col("memory_id") % 2 == 0)
    return t.entries.select("memory_id", F.when(hard, "HARD_MEMORY_PROTECTED").when(F.col("status") != "active", "TARGET_NOT_ACTIVE").when(F.col("salience") < 0.2, "CONFIDENCE_LOW").otherwise("accept").alias("decision"))


@query(f"WITH {ENTRIES} SELECT memory_id, CASE WHEN kind NOT IN ('episodic', 'semantic') THEN 'KIND' WHEN length(content) > 60 THEN 'TOO_LONG' WHEN provenance = 'hard' AND evidence_refs IS NULL THEN 'EVIDENCE_REQUIRED' ELSE 'OK' END AS code FROM entries")
def validate_rows(t: Tables):
    """#147 first failed check of each submission."""
    code = F.when(~F.col("kind").isin("episodic", "semantic"), "KIND").when(F.length("content") > 60, "TOO_LONG").when((F.col("provenance") == "hard") & F.col("evidence_refs").isNull(), "EVIDENCE_REQUIRED").otherwise("OK")
    return t.entries.select("memory_id", code.alias("code"))


@query(f"WITH {ENTRIES}, {CHUNKS} SELECT memory_id FROM entries WHERE evidence_refs IS NOT NULL AND evidence_refs[1] NOT IN (SELECT 'doc' || doc_id FROM chunks WHERE status = 'superseded')")
def support_revalidate(t: Tables):
    """#154 entries whose support isn't stale."""
    stale = t.chunks.where("status = 'superseded'").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("ref"))
    return t.entries.where("evidence_refs is not null").select("memory_id", F.col("evidence_refs")[0].alias("ref")).join(stale, "ref", "left_anti").select("memory_id")


@query("WITH h AS (SELECT l_orderkey, min(l_returnflag) AS f FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), s AS (SELECT l_orderkey, max(l_discount) AS c FROM lineitem GROUP BY 1) SELECT o_orderkey, CASE WHEN h.f IS NOT NULL THEN 'hard' WHEN s.c >= 0.06 THEN 'soft' ELSE 'none' END AS relation FROM orders LEFT JOIN h ON h.l_orderkey = o_orderkey LEFT JOIN s ON s.l_orderkey = o_orderkey")
def annotate_relation(t: Tables):
    """#120 a hard relation wins over a soft one."""
    l = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_returnflag") == "R").alias("h"), F.max("l_discount").alias("c"))
    rel = F.when(F.col("h") > 0, "hard").when(F.col("c") >= 0.06, "soft").otherwise("none")
    return t.orders.select("o_orderkey").join(l, "o_orderkey", "left").select("o_orderkey", rel.alias("relation"))


# Maintenance.
@query("SELECT i::BIGINT AS id FROM range(0, 1024) r(i) WHERE i NOT IN (SELECT user_id FROM events) ORDER BY 1 LIMIT 10")
def gap_ids(t: Tables):
    """#206 lowest free numbers."""
    return t.spark.range(1024).join(t.events.select(F.col("user_id").alias("id")).distinct(), "id", "left_anti").orderBy("id").limit(10)


@query(f"WITH {ENTRIES} SELECT memory_id, CASE WHEN status = 'active' AND expires_at < {TS} THEN 'expired' ELSE status END AS status FROM entries")
def expire_rows(t: Tables):
    """#207 active rows past their time."""
    return t.entries.select("memory_id", F.when((F.col("status") == "active") & (F.col("expires_at") < ev.moment(NOW)), "expired").otherwise(F.col("status")).alias("status"))


@query(f"WITH {LOG} SELECT DISTINCT scope_id FROM (SELECT 2 AS scope_id UNION ALL SELECT 77 UNION ALL SELECT scope_id FROM log WHERE scope_id IN (SELECT n_nationkey FROM nation))")
def reconcile_candidates(t: Tables):
    """#208 registered, dirty and active scopes."""
    active = t.log.select("scope_id").distinct().join(t.nation.select(F.col("n_nationkey").cast("long").alias("scope_id")), "scope_id", "left_semi")
    return t.rows("scope_id long", (2,), (77,)).unionByName(active).distinct()


@query(f"WITH {FULL}, reg AS (SELECT memory_id, status FROM red WHERE memory_id % 7 <> 0 UNION ALL SELECT -1, 'active'), now AS (SELECT memory_id, CASE WHEN memory_id % 5 = 0 THEN 'changed' ELSE status END AS status FROM red) SELECT coalesce(r.memory_id, n.memory_id) AS memory_id, CASE WHEN r.memory_id IS NULL THEN 'missing' WHEN n.memory_id IS NULL THEN 'unexpected' ELSE 'changed' END AS drift FROM reg r FULL JOIN now n USING (memory_id) WHERE r.status IS DISTINCT FROM n.status")
def projection_drift(t: Tables):
    """#209 registered rows against recomputed ones, by their hash trees: rows of equal leaves aren't looked at."""
    red = written(ev.reduced_entries(t.log).select("memory_id", "status"), "entries")
    stored = ht.registered(red.where("memory_id % 7 <> 0").unionByName(t.rows("memory_id long, status string", (-1, "active"))), "memory_id")
    now = red.withColumn("status", F.when(F.col("memory_id") % 5 == 0, "changed").otherwise(F.col("status")))
    return ht.drift(stored, now, ht.leaves(stored, "memory_id", ["status"], []), "memory_id", ["status"], [])


@query("SELECT vec_id, len(list_filter(list_zip(embedding, list_transform(embedding, lambda x: x::DOUBLE + CASE WHEN vec_id % 3 = 0 THEN 1e-3 ELSE 1e-8 END)), lambda z: abs(z[1]::DOUBLE - z[2]) > greatest(1e-6, 1e-5 * greatest(abs(z[1]::DOUBLE), abs(z[2]))))) = 0 AS close FROM embeddings")
def vector_isclose(t: Tables):
    """#210 element-wise equality within tolerances."""
    shift = F.when(F.col("vec_id") % 3 == 0, 1e-3).otherwise(1e-8)
    other = F.transform("embedding", lambda x: x.cast("double") + shift)
    near = F.zip_with("embedding", other, lambda a, b: F.abs(a.cast("double") - b) <= F.greatest(F.lit(1e-6), 1e-5 * F.greatest(F.abs(a.cast("double")), F.abs(b))))
    return t.embeddings.select("vec_id", F.forall(near, lambda x: x).alias("close"))


@query("SELECT conv_id, count(*)::BIGINT AS proposed, count(*) FILTER (WHERE role = 'assistant')::BIGINT AS accepted, count(*) FILTER (WHERE role = 'system')::BIGINT AS rejected, greatest(0, count(*) FILTER (WHERE role = 'user') - count(*) FILTER (WHERE role = 'assistant'))::BIGINT AS unprocessed FROM conversations GROUP BY 1")
def nested_counts(t: Tables):
    """#218 counts of a run from its nested array."""
    a = t.conversations.groupBy("conv_id").agg(F.collect_list("role").alias("roles"))
    n = lambda r: F.size(F.filter("roles", lambda x: x == r)).cast("long")
    return a.select("conv_id", F.size("roles").cast("long").alias("proposed"), n("assistant").alias("accepted"), n("system").alias("rejected"), F.greatest(F.lit(0), n("user") - n("assistant")).cast("long").alias("unprocessed"))


# Retrieval quality: good documents are expected of the item with their number modulo 40.
TRUTH = "truth AS (SELECT doc_id % 40 AS item_id, doc_id FROM labels WHERE quality = 1 AND toxic = 0)"
IR = """got AS (SELECT r.item_id, count(DISTINCT CASE WHEN rank <= 10 THEN r.doc_id END) AS found, min(rank) AS first, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) END) AS dcg FROM {ranked} r JOIN (SELECT DISTINCT * FROM truth) t ON t.item_id = r.item_id AND t.doc_id = r.doc_id GROUP BY 1),
base AS (SELECT item_id, count(DISTINCT doc_id) AS n FROM truth GROUP BY 1),
ir AS (SELECT b.item_id, coalesce(found, 0) / n::DOUBLE AS recall, coalesce(1 / first::DOUBLE, 0) AS mrr, coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))) AS ndcg FROM base b LEFT JOIN got USING (item_id))"""
ALL_RANKED = "rk AS (SELECT item_id, doc_id, rank FROM ranked WHERE rank <= 50)"


def truth(t: Tables):
    return t.labels.where("quality = 1 and toxic = 0").select((F.col("doc_id") % 40).alias("item_id"), "doc_id")


def quality(t: Tables):
    return mt.quality(truth(t), sparse(t, 50).select("item_id", "doc_id", "rank"), 10)


ROUNDED = "round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg"
IR_ALL = f"WITH {SPARSE}, {ALL_RANKED}, {TRUTH}, {IR.format(ranked='rk')}"


@query(f"{IR_ALL} SELECT item_id, {ROUNDED} FROM ir")
def ir_metrics(t: Tables):
    """#177, #178, #179 recall, reciprocal rank and nDCG per question."""
    return quality(t).select("item_id", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")])


@query(f"{IR_ALL} SELECT item_id % 4 AS format, count(*)::BIGINT AS n, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, round(min(mrr), 6) AS mrr_min, round(max(mrr), 6) AS mrr_max FROM ir GROUP BY 1")
def ir_metrics_by_group(t: Tables):
    """#82, #220 macro averages per format."""
    g = quality(t).groupBy((F.col("item_id") % 4).alias("format"))
    return g.agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("recall", "mrr", "ndcg")], F.round(F.min("mrr"), 6).alias("mrr_min"), F.round(F.max("mrr"), 6).alias("mrr_max"))


@query(
    f"""WITH {SPARSE}, {ALL_RANKED}, {TRUTH}, al AS (SELECT item_id, doc_id % 500 AS alias, min(rank) AS rank FROM rk GROUP BY ALL), tr AS (SELECT DISTINCT item_id, doc_id % 500 AS alias FROM truth)
SELECT b.item_id, max(CASE WHEN a.rank <= 10 THEN 1 ELSE 0 END) AS hit, round(count(CASE WHEN a.rank <= 10 THEN 1 END) / 10.0::DOUBLE, 6) AS precision FROM tr b LEFT JOIN al a ON a.item_id = b.item_id AND a.alias = b.alias GROUP BY 1"""
)
def ir_metrics_binary(t: Tables):
    """#180 hit rate and precision; of repeated aliases the first counts."""
    alias = (F.col("doc_id") % 500).alias("alias")
    ranked = sparse(t, 50).select("item_id", alias, "rank").groupBy("item_id", "alias").agg(F.min("rank").alias("rank"))
    rows = truth(t).select("item_id", alias).distinct().join(ranked, ["item_id", "alias"], "left")
    good = F.coalesce(F.col("rank") <= 10, F.lit(False))
    return rows.groupBy("item_id").agg(F.max(good.cast("int")).alias("hit"), F.round(F.count_if(good) / 10.0, 6).alias("precision"))


BINARY = f"""bhits AS (SELECT item_id, doc_id, sum(weight) AS score FROM post JOIN qtf USING (term) GROUP BY ALL),
branked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id)::INTEGER AS rank FROM bhits),
bk AS (SELECT item_id, doc_id, rank FROM branked WHERE rank <= 50),
bgot AS (SELECT r.item_id, count(DISTINCT CASE WHEN rank <= 10 THEN r.doc_id END) AS found, min(rank) AS first, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) END) AS dcg FROM bk r JOIN (SELECT DISTINCT * FROM truth) t ON t.item_id = r.item_id AND t.doc_id = r.doc_id GROUP BY 1),
bir AS (SELECT b.item_id, coalesce(found, 0) / n::DOUBLE AS recall, coalesce(1 / first::DOUBLE, 0) AS mrr, coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))) AS ndcg FROM base b LEFT JOIN bgot USING (item_id))"""


def binary_quality(t: Tables):
    """The second arm: the same questions with weights of one for their terms."""
    return mt.quality(truth(t), rt.bm25_search(t.index, t.benchmark, 50, "binary").select("item_id", "doc_id", "rank"), 10)


@query(f"{IR_ALL}, {BINARY} SELECT item_id, CASE WHEN ir.mrr = 0 THEN bir.mrr = 0 ELSE abs(bir.mrr - ir.mrr) / ir.mrr <= 0.01 END AS reproducible FROM ir JOIN bir USING (item_id)")
def repro_check(t: Tables):
    """#181 a second run within one per cent of the first: weighted terms against binary ones."""
    rows = quality(t).select("item_id", "mrr").join(binary_quality(t).select("item_id", F.col("mrr").alias("again")), "item_id")
    same = F.when(F.col("mrr") == 0, F.col("again") == 0).otherwise(F.abs(F.col("again") - F.col("mrr")) / F.col("mrr") <= 0.01)
    return rows.select("item_id", same.alias("reproducible"))


@query(
    f"""WITH {HYBRID}, fz AS (SELECT item_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS s FROM (SELECT item_id, doc_id, rank FROM dr UNION ALL SELECT item_id, doc_id, rank FROM sr) GROUP BY ALL),
fk AS (SELECT item_id, doc_id, min(rank) AS rank FROM (SELECT item_id, doc_id, rank FROM sr) GROUP BY ALL), {TRUTH}, a AS (SELECT t.item_id, min(r.rank) AS first_a FROM truth t LEFT JOIN sr r ON r.item_id = t.item_id AND r.doc_id = t.doc_id GROUP BY 1),
b AS (SELECT t.item_id, min(r.rank) AS first_b FROM truth t LEFT JOIN dr r ON r.item_id = t.item_id AND r.doc_id = t.doc_id GROUP BY 1) SELECT item_id, first_a AS sparse_rank, first_b AS dense_rank FROM a JOIN b USING (item_id)"""
)
def arm_compare(t: Tables):
    """#223 rank of the first hit in two arms; null without one."""
    lists, base = hybrid_lists(t), truth(t)

    def first(name):
        return base.join(lists[name].select("item_id", "doc_id", "rank"), ["item_id", "doc_id"], "left").groupBy("item_id").agg(F.min("rank").alias(f"{name}_rank"))

    return first("sparse").join(first("dense"), "item_id")


@query(f"""{IR_ALL}, {BINARY}, m AS (SELECT (SELECT avg(recall) FROM ir) AS r, (SELECT avg(mrr) FROM ir) AS m, (SELECT avg(ndcg) FROM ir) AS n, (SELECT avg(recall) FROM bir) AS br, (SELECT avg(mrr) FROM bir) AS bm, (SELECT avg(ndcg) FROM bir) AS bn)
SELECT br >= r - 1e-9 AS recall_ok, bm >= m * 0.99 AS mrr_ok, bn >= n * 0.99 AS ndcg_ok, round((bm - m) / m * 100, 6) AS mrr_change FROM m""")
def non_inferiority(t: Tables):
    """#221 a second arm against the first: recall not lower, the others within one per cent."""
    one, two = (df.agg(*[F.avg(c).alias(f"{p}{c}") for c in ("recall", "mrr", "ndcg")]) for p, df in (("a_", quality(t)), ("b_", binary_quality(t))))
    m = one.crossJoin(F.broadcast(two))  # one row each
    ok = [(F.col("b_recall") >= F.col("a_recall") - 1e-9).alias("recall_ok"), *[(F.col(f"b_{c}") >= F.col(f"a_{c}") * 0.99).alias(f"{c}_ok") for c in ("mrr", "ndcg")]]
    return m.select(*ok, F.round(mt.relative_change(F.col("b_mrr"), F.col("a_mrr")), 6).alias("mrr_change"))


@query("WITH h AS (SELECT item_id, split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) AS heading FROM benchmark) SELECT item_id, min(doc_id) AS doc_id FROM h JOIN documents d ON contains(d.text, h.heading) GROUP BY 1")
def anchor_match(t: Tables):
    """#222 first document that holds the heading: texts are read once for all headings, by an automaton."""
    h = t.benchmark.select("item_id", F.substring_index("text", " ", 2).alias("heading"))
    return rt.containing(t.documents, h, "doc_id", "text", "item_id", "heading").groupBy("item_id").agg(F.min("doc_id").alias("doc_id"))


@query("SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:]+)', 1)) || '/' || regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1), '^/+|/+$', '', 'g') AS remote FROM pages WHERE NOT contains(url, '?') AND NOT contains(url, '#') AND length(regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1), '^/+|/+$', '', 'g')) > 0")
def url_norm(t: Tables):
    """#41, #204 normal form of addresses; those with a query or fragment have none."""
    return t.pages.select("page_id", tx.remote_form(F.col("url")).alias("remote")).where("remote is not null")
