"""Queries over the event log, entries, visibility, recall and runtime metrics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heronry.operators import events as ev
from heronry.operators import metrics as mt
from heronry.operators import retrieval as rt
from heronry.streaming import entries as en
from heronry.operators.ordering import ordered
from heronry.plans.base import ENTRIES, LOG, NOW, Tables, query
from heronry.session import new_folder

T0, T1 = "2024-01-05 00:00:00", "2024-01-15 00:00:00"
TS = f"TIMESTAMP '{NOW}'"


@query(f"WITH {LOG} SELECT event_id, kind, aggregate_id FROM log WHERE event_id <= 5000 AND scope_id IN (1, 3)")
def log_replay_prefix(t: Tables):
    """#10 bounded replay of two scopes, which are folders of the log."""
    return ev.replay(t.log_layout.rows, 5000).where("scope_id in (1, 3)").select("event_id", "kind", "aggregate_id")


@query(f"WITH {LOG} SELECT event_id, kind FROM log WHERE NOT (kind = 'access' AND ts < TIMESTAMP '{T0}')")
def log_minus_archived(t: Tables):
    """#11 replay without archived events: both lie in buckets of event_id, so nothing is sent."""
    return ev.replay(t.log_layout.rows, archived=t.archived_layout.rows).select("event_id", "kind")


@query("SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events")
def json_props_unnest(t: Tables):
    """#12, #203 JSON objects as rows."""
    return t.events.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))


@query("SELECT event_id, user_id, ts FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 100")
def list_recent(t: Tables):
    """#13 newest first."""
    return t.events.where("event_type = 'error'").orderBy(F.col("ts").desc(), "event_id").select("event_id", "user_id", "ts").limit(100)


@query(
    f"""SELECT event_id, event_type AS tool, CASE WHEN event_type = 'error' THEN 'error' ELSE 'complete' END AS completion_status, round_even(value * 10, 0)::BIGINT AS duration_ms,
  CASE WHEN user_id % 2 = 0 THEN props END AS trace, ts + INTERVAL 7 DAY AS expires_at FROM events"""
)
def audit_row(t: Tables):
    """#14 audit rows with expiry; the body only where tracing is on."""
    return t.events.select(
        "event_id", F.col("event_type").alias("tool"), F.when(F.col("event_type") == "error", "error").otherwise("complete").alias("completion_status"),
        F.bround(F.col("value") * 10, 0).cast("long").alias("duration_ms"), F.when(F.col("user_id") % 2 == 0, F.col("props")).alias("trace"), F.expr("ts + interval 7 days").alias("expires_at"),
    )


VIS = """status IN ({st}) {ret} AND {iv} AND (expires_at IS NULL OR {at} < expires_at)"""
IVAL = "(valid_from IS NULL OR {at} >= valid_from) AND (valid_to IS NULL OR {at} < valid_to)"
AS_OF = "TIMESTAMP '2024-01-12 06:00:00'"


@query(
    f"""WITH {ENTRIES} SELECT memory_id, {VIS.format(st="'active'", ret="AND retention_stage <> 'archived'", iv=IVAL.format(at=TS), at=TS)} AS now_visible,
  {VIS.format(st="'active', 'superseded'", ret="AND retention_stage <> 'archived'", iv="(status <> 'active' OR (" + IVAL.format(at=TS) + "))", at=TS)} AS chain_visible,
  {VIS.format(st="'active'", ret='', iv=IVAL.format(at=AS_OF), at=AS_OF)} AS past_visible FROM entries"""
)
def visible_as_of(t: Tables):
    """#47 visibility now, along chains, and at a past point."""
    now, past = ev.moment(NOW), ev.moment("2024-01-12 06:00:00")
    return t.entries.select("memory_id", ev.visible(now).alias("now_visible"), ev.visible(now, include_superseded=True).alias("chain_visible"), ev.visible(now, past).alias("past_visible"))


ATT = f"status = 'active' AND retention_stage = 'active' AND valid_to IS NULL AND (expires_at IS NULL OR expires_at > {TS})"
ANCH = "(provenance <> 'hard' OR len(coalesce(evidence_refs, [])) > 0)"
STABLE = "status = 'active' AND retention_stage <> 'archived' AND valid_to IS NULL AND expires_at IS NULL"


@query(f"WITH {ENTRIES} SELECT memory_id, {ATT} AS attachable, {ANCH} AS anchored, {STABLE} AS stable, {ATT} AND {ANCH} AS working FROM entries")
def visible_attachment(t: Tables):
    """#48 the four other predicates."""
    now = ev.moment(NOW)
    return t.entries.select("memory_id", ev.attachable(now).alias("attachable"), ev.anchored().alias("anchored"), ev.stable_package().alias("stable"), ev.in_working_set(now).alias("working"))


BROWSE = "scope_id = 2 AND kind = 'episodic' AND status = 'active' AND provenance IN ('soft', 'hard') AND salience >= 0.3"


@query(f"WITH {ENTRIES} SELECT memory_id, scope_id, salience, count(*) OVER ()::BIGINT AS total FROM entries WHERE {BROWSE}")
def browse_filter(t: Tables):
    """#49 six filters with the total."""
    rows = t.entries.where(BROWSE).select("memory_id", "scope_id", "salience")
    return rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))  # one row


@query(f"WITH {ENTRIES} SELECT memory_id FROM entries WHERE observed_at BETWEEN TIMESTAMP '{T0}' AND TIMESTAMP '{T1}'")
def time_window(t: Tables):
    """#50 both bounds inclusive."""
    return t.entries.where(F.col("observed_at").between(ev.moment(T0), ev.moment(T1))).select("memory_id")


@query(f"WITH {ENTRIES} SELECT memory_id, observed_at, count(*) OVER ()::BIGINT AS total FROM entries WHERE status = 'active' ORDER BY observed_at DESC, memory_id DESC LIMIT 20 OFFSET 40")
def paginate(t: Tables):
    """#95 a page with the total: the rows are written in order once, and a page reads the range that holds it."""
    rows = ordered(t.entries.where("status = 'active'").select("memory_id", "observed_at"), [F.col("observed_at").desc(), F.col("memory_id").desc()])
    total = rows.counts().first()
    return rows.page(40, 20).select("memory_id", "observed_at", F.lit(total["n"] if total else 0).cast("long").alias("total"))


DELIVERED = f"""runs AS (SELECT 's' || (conv_id % 50) AS session_id, conv_id * 10 + turn AS returned, {TS} - (conv_id % 14) * INTERVAL 1 DAY AS created_at FROM conversations),
cut AS (SELECT {TS} - min(ttl) * INTERVAL 1 SECOND AS at FROM (VALUES (604800), (432000)) v(ttl)),
delivered AS (SELECT DISTINCT r.session_id, r.returned AS memory_id FROM runs r, cut WHERE r.created_at > cut.at)"""


def delivered(t: Tables):
    runs = t.conversations.select(
        F.concat(F.lit("s"), F.col("conv_id") % 50).alias("session_id"), F.array(F.col("conv_id") * 10 + F.col("turn")).alias("returned_ids"),
        F.expr(f"timestamp_ntz'{NOW}' - make_dt_interval(cast(conv_id % 14 as int))").alias("created_at"),
    )
    ttl = t.rows("ttl long", (604800,), (432000,)).agg(F.min("ttl").alias("ttl"))
    recent = runs.crossJoin(F.broadcast(ttl)).where(F.col("created_at") > F.expr(f"timestamp_ntz'{NOW}' - make_dt_interval(0, 0, 0, ttl)"))  # one row
    return recent.select("session_id", F.explode("returned_ids").alias("memory_id")).distinct()


@query(f"WITH {ENTRIES}, {DELIVERED} SELECT memory_id, session_id FROM entries e WHERE NOT EXISTS (SELECT 1 FROM delivered d WHERE d.session_id = e.session_id AND d.memory_id = e.memory_id)")
def delivered_dedup(t: Tables):
    """#64, #152 entries that their session hasn't had within the shortest window."""
    return t.entries.select("memory_id", "session_id").join(delivered(t), ["session_id", "memory_id"], "left_anti").select("memory_id", "session_id")


@query(
    f"""WITH {ENTRIES}, {DELIVERED}, v AS (SELECT * FROM entries WHERE status = 'active') SELECT v.scope_id, count(*) FILTER (WHERE d.memory_id IS NOT NULL)::BIGINT AS dropped,
  count(*) FILTER (WHERE d.memory_id IS NULL)::BIGINT AS kept FROM v LEFT JOIN delivered d USING (session_id, memory_id) GROUP BY 1"""
)
def set_ops(t: Tables):
    """#102 eligible in common with delivered, and without it."""
    rows = t.entries.where("status = 'active'").join(delivered(t).withColumn("d", F.lit(1)), ["session_id", "memory_id"], "left")
    return rows.groupBy("scope_id").agg(F.count("d").alias("dropped"), F.count_if(F.col("d").isNull()).alias("kept"))


# Runtime metrics over events: tool = type, mode by user, duration from value.
RUNS = "runs AS (SELECT *, CASE WHEN user_id % 3 = 0 THEN 'writer' ELSE 'reader' END AS mode FROM events)"


def runs(t: Tables):
    return t.events.withColumn("mode", F.when(F.col("user_id") % 3 == 0, "writer").otherwise("reader"))


@query(f"WITH {RUNS} SELECT mode, event_type AS tool, count(*)::BIGINT AS n FROM runs WHERE ts >= TIMESTAMP '{T0}' AND ts < TIMESTAMP '{T1}' GROUP BY ALL")
def metric_requests(t: Tables):
    """#69 requests by mode and tool in a half-open window."""
    return runs(t).where(mt.in_window("ts", T0, T1)).groupBy("mode", F.col("event_type").alias("tool")).agg(F.count("*").alias("n"))


@query(f"WITH {RUNS} SELECT mode, CASE WHEN event_type = 'error' THEN 'error' ELSE 'complete' END AS status, count(*)::BIGINT AS n FROM runs GROUP BY ALL")
def metric_status(t: Tables):
    """#70 status by mode."""
    return runs(t).groupBy("mode", F.when(F.col("event_type") == "error", "error").otherwise("complete").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT event_type AS tool, round_even(quantile_cont(value, 0.5), 0)::BIGINT AS p50, round_even(quantile_cont(value, 0.95), 0)::BIGINT AS p95 FROM events GROUP BY 1")
def metric_latency(t: Tables):
    """#71, #199 exact percentiles by tool."""
    return mt.percentiles(t.events.withColumnRenamed("event_type", "tool"), ["tool"], "value", {"p50": 0.5, "p95": 0.95}, True)


@query(
    """WITH x AS (SELECT CASE json_extract_string(props, '$.k')::INTEGER % 3 WHEN 0 THEN 'dense_ms' WHEN 1 THEN 'graph_ms' ELSE 'graph_ms' END AS path, value FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY value) AS i, count(*) OVER (PARTITION BY path) AS n FROM x) SELECT path, value AS p50, n::BIGINT AS n FROM r WHERE i = n // 2 + 1"""
)
def metric_subpath(t: Tables):
    """#72 upper medians of timings kept as a JSON map; two names of one path count together."""
    k = F.get_json_object("props", "$.k").cast("int") % 3
    timings = F.create_map(F.when(k == 0, "dense_ms").when(k == 1, "graph_recall_ms").otherwise("graph_expansion_ms"), F.col("value"))
    rows = t.events.select(F.explode(timings).alias("name", "value"))
    path = F.when(F.col("name").isin("graph_recall_ms", "graph_expansion_ms"), "graph_ms").otherwise(F.col("name"))
    return mt.upper_median(rows.select(path.alias("path"), "value"), ["path"], "value")


@query("SELECT coalesce(sum(json_extract_string(props, '$.k')::INTEGER), 0)::BIGINT AS tokens, coalesce(sum(json_extract_string(props, '$.missing')::INTEGER), 0)::BIGINT AS missing, count(*)::BIGINT AS calls FROM events")
def metric_usage(t: Tables):
    """#73 sums over JSON counters."""
    field = lambda k: F.coalesce(F.sum(F.get_json_object("props", f"$.{k}").cast("int")), F.lit(0))
    return t.events.agg(field("k").alias("tokens"), field("missing").alias("missing"), F.count("*").alias("calls"))


@query(f"SELECT coalesce(sum(json_extract_string(props, '$.k')::INTEGER), 0)::BIGINT AS purged, count(*)::BIGINT AS runs FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '{T0}'")
def metric_purge(t: Tables):
    """#74 purge sums."""
    return t.events.where((F.col("event_type") == "error") & (F.col("ts") >= ev.moment(T0))).agg(F.coalesce(F.sum(F.get_json_object("props", "$.k").cast("int")), F.lit(0)).alias("purged"), F.count("*").alias("runs"))


@query("SELECT s_suppkey AS instance_id, s_nationkey % 2 = 0 AS live, EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_returnflag = 'R' AND l.l_quantity > 49) AS holder FROM supplier s")
def metric_instances(t: Tables):
    """#75 instances with a flag whether they hold a lease."""
    leases = t.lineitem.where("l_returnflag = 'R' and l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey")).distinct().withColumn("h", F.lit(True))
    return t.supplier.join(leases, "s_suppkey", "left").select(F.col("s_suppkey").alias("instance_id"), (F.col("s_nationkey") % 2 == 0).alias("live"), F.coalesce("h", F.lit(False)).alias("holder"))


@query("SELECT s_suppkey, n_name, count(*)::BIGINT AS signals FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0 GROUP BY ALL")
def live_instances(t: Tables):
    """#59 signals of live instances."""
    live = t.supplier.where("s_acctbal > 0").join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    counts = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("signals"))
    return live.join(counts, "s_suppkey")


VOCAB = {"kind": ("episodic", "semantic"), "status": ("active", "superseded", "retired", "quarantined"), "provenance": ("hard", "soft", "distilled")}


@query(
    f"WITH {ENTRIES} "
    + " UNION ALL ".join(
        " UNION ALL ".join(f"SELECT '{c}' AS field, '{v}' AS value, count(*) FILTER (WHERE {c} = '{v}')::BIGINT AS n FROM entries" for v in vs)
        + f" UNION ALL SELECT '{c}', 'other', count(*) FILTER (WHERE {c} IS NULL OR {c} NOT IN ({', '.join(repr(v) for v in vs)}))::BIGINT FROM entries"
        for c, vs in VOCAB.items()
    )
)
def vocab_distribution(t: Tables):
    """#76 counts over closed vocabularies."""
    return mt.vocabulary_counts(t.entries, VOCAB)


@query(f"WITH {ENTRIES} SELECT scope_id, quantile_cont(salience, 0.5) AS p50, quantile_cont(salience, 0.9) AS p90, quantile_cont(salience, 0.95) AS p95 FROM entries GROUP BY 1")
def salience_quantiles(t: Tables):
    """#77 interpolated quantiles."""
    return mt.percentiles(t.entries, ["scope_id"], "salience", {"p50": 0.5, "p90": 0.9, "p95": 0.95})


@query(f"WITH {ENTRIES} SELECT CASE WHEN salience < 0.2 THEN 0 WHEN salience < 0.4 THEN 1 WHEN salience < 0.6 THEN 2 WHEN salience < 0.8 THEN 3 ELSE 4 END AS bucket, count(*)::BIGINT AS n FROM entries GROUP BY 1")
def salience_histogram(t: Tables):
    """#78 histogram by comparison with the edges."""
    return t.entries.groupBy(mt.bucket(F.col("salience")).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"WITH {LOG} SELECT count(DISTINCT aggregate_id)::BIGINT AS runs, count(*) FILTER (WHERE kind = 'retract')::BIGINT AS rollbacks FROM log")
def distinct_runs(t: Tables):
    """#79 distinct runs and rollbacks."""
    return t.log.agg(F.countDistinct("aggregate_id").alias("runs"), F.count_if(F.col("kind") == "retract").alias("rollbacks"))


@query(f"WITH {LOG} SELECT scope_id, max(event_id) AS high_water, max(k) + 1 AS next_version FROM log GROUP BY 1")
def high_water(t: Tables):
    """#80 high-water mark and next version per scope."""
    return t.log.groupBy("scope_id").agg(F.max("event_id").alias("high_water"), (F.max("k") + 1).alias("next_version"))


@query(f"WITH {ENTRIES} SELECT scope_id, count(*) FILTER (WHERE status = 'active')::BIGINT AS used, count(*) FILTER (WHERE status = 'active') >= 500 AS full FROM entries GROUP BY 1")
def quota_check(t: Tables):
    """#84 entries that count for the quota."""
    n = F.count_if(F.col("status") == "active")
    return t.entries.groupBy("scope_id").agg(n.alias("used"), (n >= 500).alias("full"))


@query(
    f"""WITH {ENTRIES}, h AS (SELECT scope_id, sha256(concat_ws('|', memory_id::VARCHAR, coalesce(kind, '~'), coalesce(status, '~'))) AS h FROM entries),
q AS (SELECT scope_id, substr(h, 1, 4) AS b, sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY ALL),
p AS (SELECT scope_id, substr(b, 1, 2) AS b, sha256(string_agg(h, '' ORDER BY b)) AS h FROM q GROUP BY scope_id, substr(b, 1, 2)) SELECT scope_id, sha256(string_agg(h, '' ORDER BY b)) AS fingerprint FROM p GROUP BY 1"""
)
def state_fingerprint(t: Tables):
    """#85 order-free fingerprint of each scope's state."""
    return ev.fingerprint(t.entries, ["memory_id", "kind", "status"], ["scope_id"])


@query("SELECT DISTINCT word FROM (SELECT unnest(['references', 'referenced_by', 'calls']) AS word UNION ALL SELECT event_type FROM events)")
def vocab_union(t: Tables):
    """#86 declared words and the keys that occur."""
    declared = t.rows("word string", ("references",), ("referenced_by",), ("calls",))
    found = t.events.select(F.explode(F.map_keys(F.create_map(F.col("event_type"), F.lit(1)))).alias("word"))
    return declared.unionByName(found).distinct()


@query(f"WITH {LOG} SELECT aggregate_id, event_id, kind, ts FROM log QUALIFY row_number() OVER (PARTITION BY aggregate_id ORDER BY event_id DESC) = 1")
def latest_per_key(t: Tables):
    """#87 last observation of each run: a maximum, combined before the shuffle."""
    return ev.newest(t.log.select("aggregate_id", "event_id", "kind", "ts"), ["aggregate_id"], "event_id")


@query("SELECT o_custkey AS scope_id, max(o_orderkey) AS version_id, arg_max(o_orderstatus, o_orderkey) AS status FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def latest_version(t: Tables):
    """#92 newest eligible version per scope."""
    rows = t.orders.where("o_orderstatus <> 'P'").groupBy(F.col("o_custkey").alias("scope_id"))
    return rows.agg(F.max("o_orderkey").alias("version_id"), F.max_by("o_orderstatus", "o_orderkey").alias("status"))


SESSION = "max_session AS (SELECT scope_id, arg_max(session_id, {'a': observed_at, 'b': session_id}) AS session_id FROM entries WHERE kind = 'episodic' AND " + ATT + " AND " + ANCH + " GROUP BY 1)"


@query(f"WITH {ENTRIES}, {SESSION} SELECT scope_id, session_id FROM max_session")
def recent_session(t: Tables):
    """#94 session of the newest visible episodic entry."""
    return recent(t)


def recent(t: Tables):
    rows = t.entries.where(ev.in_working_set(ev.moment(NOW)) & (F.col("kind") == "episodic"))
    return rows.groupBy("scope_id").agg(F.max_by("session_id", F.struct("observed_at", "session_id")).alias("session_id"))


WORKING = f"""{ENTRIES}, {SESSION}, w AS (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY observed_at DESC, memory_id DESC) AS o FROM entries WHERE {ATT} AND {ANCH}),
open_items AS (SELECT scope_id, memory_id, row_number() OVER (PARTITION BY scope_id ORDER BY o) AS n FROM w WHERE kind = 'episodic'),
recent AS (SELECT w.scope_id, memory_id, o FROM w JOIN max_session m ON m.scope_id = w.scope_id AND m.session_id = w.session_id WHERE kind = 'episodic'),
r2 AS (SELECT r.*, x.n IS NOT NULL AS dup FROM recent r LEFT JOIN (SELECT * FROM open_items WHERE n <= 5) x USING (scope_id, memory_id)),
proc AS (SELECT scope_id, memory_id, row_number() OVER (PARTITION BY scope_id ORDER BY o) AS n FROM w WHERE kind = 'procedural')"""


@query(
    f"""WITH {WORKING} SELECT 'open_items' AS bucket, scope_id, memory_id, CASE WHEN n <= 5 THEN 'selected' ELSE 'truncated' END AS decision FROM open_items
UNION ALL SELECT 'recent_activity', scope_id, memory_id, CASE WHEN dup THEN 'deduped' WHEN row_number() OVER (PARTITION BY scope_id, dup ORDER BY o) <= 5 THEN 'selected' ELSE 'truncated' END FROM r2
UNION ALL SELECT 'procedural', scope_id, memory_id, CASE WHEN n <= 5 THEN 'selected' ELSE 'truncated' END FROM proc"""
)
def working_set(t: Tables):
    """#96, #156 three buckets, an entry in the first that takes it."""
    rows = t.entries.where(ev.in_working_set(ev.moment(NOW)))
    order = [F.col("observed_at").desc(), F.col("memory_id").desc()]

    def decided(df, by):
        n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        return df.withColumn("n", n)

    first = decided(rows.where("kind = 'episodic'"), ["scope_id"])
    taken = first.where("n <= 5").select("scope_id", "memory_id", F.lit(True).alias("dup"))
    now = rows.where("kind = 'episodic'").join(recent(t), ["scope_id", "session_id"], "left_semi").join(taken, ["scope_id", "memory_id"], "left").withColumn("dup", F.coalesce("dup", F.lit(False)))
    now = decided(now, ["scope_id", "dup"])
    third = decided(rows.where("kind = 'procedural'"), ["scope_id"])
    plain = F.when(F.col("n") <= 5, "selected").otherwise("truncated")
    parts = [("open_items", first, plain), ("recent_activity", now, F.when(F.col("dup"), "deduped").otherwise(plain)), ("procedural", third, plain)]
    return rt.unioned(df.select(F.lit(name).alias("bucket"), "scope_id", "memory_id", d.alias("decision")) for name, df, d in parts)


# Recall: dense similarity stands on salience, access times on the event log.
RANKS = f"""{ENTRIES}, vis AS (SELECT *, value / 500 AS sim FROM entries WHERE {VIS.format(st="'active'", ret="AND retention_stage <> 'archived'", iv=IVAL.format(at=TS), at=TS)}),
ranks AS (
  SELECT 'dense' AS path, 1.0::DOUBLE AS w, scope_id, memory_id, row_number() OVER (PARTITION BY scope_id ORDER BY sim DESC, memory_id) AS rank FROM vis
  UNION ALL SELECT 'recency', 0.5::DOUBLE, scope_id, memory_id, row_number() OVER (PARTITION BY scope_id ORDER BY observed_at DESC, memory_id DESC) FROM vis
  UNION ALL SELECT 'kind', 0.3::DOUBLE, scope_id, memory_id, row_number() OVER (PARTITION BY scope_id ORDER BY CASE kind WHEN 'procedural' THEN 0 WHEN 'semantic' THEN 1 ELSE 2 END, memory_id) FROM vis
  UNION ALL SELECT 'salience', 0.2::DOUBLE, scope_id, memory_id, row_number() OVER (PARTITION BY scope_id ORDER BY salience DESC, memory_id) FROM vis WHERE salience > 0)"""
RECALLED = f"""{RANKS}, fused AS (SELECT scope_id, memory_id, sum(w / (60 + rank)) AS score FROM ranks GROUP BY ALL),
ordered AS (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY round(score, 9) DESC, memory_id)::INTEGER AS pos FROM fused)"""
WEIGHTS = {"dense": 1.0, "recency": 0.5, "kind": 0.3, "salience": 0.2}


def rank_paths(t: Tables):
    v = t.entries.where(ev.visible(ev.moment(NOW))).withColumn("sim", F.col("value") / 500)
    kind = F.when(F.col("kind") == "procedural", 0).when(F.col("kind") == "semantic", 1).otherwise(2)
    orders = {"dense": [F.col("sim").desc(), F.col("memory_id")], "recency": [F.col("observed_at").desc(), F.col("memory_id").desc()], "kind": [kind, F.col("memory_id")], "salience": [F.col("salience").desc(), F.col("memory_id")]}
    out = {}
    for name, order in orders.items():
        rows = v.where("salience > 0") if name == "salience" else v
        out[name] = rows.select("scope_id", "memory_id", F.row_number().over(Window.partitionBy("scope_id").orderBy(*order)).alias("rank"))
    return out


@query(f"WITH {RANKS} SELECT path, scope_id, memory_id, rank::INTEGER AS rank FROM ranks")
def memory_rank_paths(t: Tables):
    """#93 the four rank lists."""
    return rt.unioned(df.select(F.lit(n).alias("path"), "scope_id", "memory_id", "rank") for n, df in rank_paths(t).items())


def recalled(t: Tables):
    out = rt.fused(rank_paths(t), "scope_id", "memory_id", WEIGHTS, text_ties=False)
    return out.select("scope_id", "memory_id", F.col("fused_score").alias("score"), F.col("final_rank").alias("pos"))


@query(f"WITH {RECALLED} SELECT scope_id, memory_id, round(score, 9) AS score, pos FROM ordered WHERE pos <= 50")
def memory_recall(t: Tables):
    """#113, #151 hybrid recall of each scope."""
    return recalled(t).where("pos <= 50").select("scope_id", "memory_id", F.round("score", 9).alias("score"), "pos")


@query(f"WITH {ENTRIES} SELECT scope_id, memory_id, observed_at, row_number() OVER (PARTITION BY scope_id ORDER BY observed_at DESC, memory_id DESC)::INTEGER AS pos FROM entries WHERE {VIS.format(st=chr(39)+'active'+chr(39), ret='', iv=IVAL.format(at=AS_OF), at=AS_OF)} QUALIFY pos <= 50")
def memory_timeline(t: Tables):
    """#151 timeline at a past point."""
    rows = t.entries.where(ev.visible(ev.moment(NOW), ev.moment("2024-01-12 06:00:00")))
    pos = F.row_number().over(Window.partitionBy("scope_id").orderBy(F.col("observed_at").desc(), F.col("memory_id").desc()))
    return rows.select("scope_id", "memory_id", "observed_at", pos.alias("pos")).where("pos <= 50")


def sql_pack(rows: str, by: str, budget: int, most: int) -> str:
    """Recursive fold over (by, pos, n, ...): what fits is taken, what doesn't is skipped."""
    return f"""fold(g, pos, used, picked) AS (
  SELECT DISTINCT {by}, 0::BIGINT, 0::BIGINT, FALSE FROM {rows}
  UNION ALL SELECT f.g, f.pos + 1, CASE WHEN f.used + r.n <= {budget} THEN f.used + r.n ELSE f.used END, f.used + r.n <= {budget} FROM fold f JOIN {rows} r ON r.{by} = f.g AND r.pos = f.pos + 1 WHERE f.pos < {most})"""


@query(f"WITH RECURSIVE {RECALLED}, items AS (SELECT o.scope_id, o.memory_id, o.pos, length(e.content) AS n FROM ordered o JOIN entries e USING (memory_id) WHERE o.pos <= 50), {sql_pack('items', 'scope_id', 600, 50)} SELECT i.scope_id, i.memory_id, i.pos, f.picked FROM items i JOIN fold f ON f.g = i.scope_id AND f.pos = i.pos")
def budget_pack(t: Tables):
    """#97 character budget that skips what doesn't fit."""
    rows = recalled(t).where("pos <= 50").join(t.entries.select("memory_id", F.length("content").alias("chars")), "memory_id")
    out = ev.budget_packed(rows, "scope_id", [F.col("pos")], "chars", 600, 50, ["memory_id"])
    return out.select("scope_id", "memory_id", "pos", "picked")


ATTACH = f"""{ENTRIES}, a AS (SELECT *, value / 500 AS sim FROM entries WHERE {ATT} AND {ANCH} AND value / 500 >= 0.5),
top AS (SELECT scope_id, memory_id, round(sim, 6) AS sim, length(content) AS n, row_number() OVER (PARTITION BY scope_id ORDER BY sim DESC, memory_id)::INTEGER AS pos FROM a QUALIFY pos <= 3)"""


@query(f"WITH RECURSIVE {ATTACH}, {sql_pack('top', 'scope_id', 150, 3)} SELECT t.scope_id, t.memory_id, t.sim, t.pos FROM top t JOIN fold f ON f.g = t.scope_id AND f.pos = t.pos WHERE f.picked")
def attachment_select(t: Tables):
    """#157 conservative threshold, top 3, budget."""
    rows = t.entries.where(ev.attachable(ev.moment(NOW)) & ev.anchored()).withColumn("sim", F.col("value") / 500).where("sim >= 0.5").withColumn("chars", F.length("content"))
    rows = rows.withColumn("sim6", F.round("sim", 6))
    out = ev.budget_packed(rows, "scope_id", [F.col("sim").desc(), F.col("memory_id")], "chars", 150, 3, ["memory_id", "sim6"])
    return out.where("picked").select("scope_id", "memory_id", F.col("sim6").alias("sim"), "pos")


PACKAGE = f"""{ENTRIES}, st AS (SELECT scope_id, memory_id, length(content) AS n, row_number() OVER (PARTITION BY scope_id ORDER BY observed_at DESC, memory_id DESC)::INTEGER AS pos FROM entries WHERE {STABLE} QUALIFY pos <= 40)"""


@query(f"WITH RECURSIVE {PACKAGE}, {sql_pack('st', 'scope_id', 800, 40)} SELECT s.scope_id, s.memory_id, s.pos FROM st s JOIN fold f ON f.g = s.scope_id AND f.pos = s.pos WHERE f.picked")
def work_package(t: Tables):
    """#155 digest of stable entries within the budget."""
    rows = t.entries.where(ev.stable_package()).withColumn("chars", F.length("content"))
    out = ev.budget_packed(rows, "scope_id", [F.col("observed_at").desc(), F.col("memory_id").desc()], "chars", 800, 40, ["memory_id"])
    return out.where("picked").select("scope_id", "memory_id", "pos")


# Folds of the log.
REDUCED = f"""{LOG}, made AS (
  SELECT *, last_value(CASE WHEN kind <> 'retract' THEN event_id END IGNORE NULLS) OVER (PARTITION BY aggregate_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS target
  FROM log WHERE kind IN ('assert', 'revise', 'retract') {{upto}}),
cr AS (SELECT *, lead(kind) OVER w AS next_kind, lead(event_id) OVER w AS next_id, lead(ts) OVER w AS next_ts FROM made WHERE kind <> 'retract' WINDOW w AS (PARTITION BY aggregate_id ORDER BY event_id)),
gone AS (SELECT target AS event_id, max(ts) AS gone_at FROM made WHERE kind = 'retract' AND target IS NOT NULL GROUP BY 1),
red AS (
  SELECT event_id AS memory_id, aggregate_id, scope_id, CASE WHEN gone_at IS NOT NULL THEN 'retired' WHEN next_kind = 'revise' THEN 'superseded' ELSE 'active' END AS status,
    CASE WHEN gone_at IS NOT NULL THEN 'tombstone' ELSE 'active' END AS retention_stage, ts AS valid_from, coalesce(gone_at, CASE WHEN next_kind = 'revise' THEN next_ts END) AS valid_to,
    CASE WHEN next_kind = 'revise' THEN next_id END AS superseded_by, CASE WHEN kind = 'revise' THEN target END AS supersedes FROM cr LEFT JOIN gone USING (event_id))"""
FULL, UPTO = REDUCED.replace("{upto}", ""), REDUCED.replace("{upto}", "AND event_id <= 6000")


@query(f"WITH {FULL} SELECT * FROM red")
def reduce_entries(t: Tables):
    """#134, #135 entries of the whole log."""
    return ev.reduced_entries(t.log)


@query(f"WITH {FULL} SELECT * FROM red")
def reduce_entries_stream(t: Tables):
    """#134, #143 the same entries, as a stream of the log leaves them: state holds one entry of each aggregate."""
    path = new_folder(t.spark, "entries")
    en.kept(en.entry_changes(t.log_stream), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return en.entries(t.spark, f"{path}/out")


@query(
    f"""WITH {UPTO}, now AS (SELECT event_id AS memory_id FROM log WHERE kind IN ('assert', 'revise')) SELECT n.memory_id, coalesce(status, 'retired') AS status, coalesce(retention_stage, 'tombstone') AS retention_stage,
  CASE WHEN status IS NOT NULL THEN valid_to ELSE {TS} END AS valid_to FROM now n LEFT JOIN red USING (memory_id)"""
)
def rollback_state(t: Tables):
    """#138 state after a rollback."""
    return ev.rolled_back(t.log, 6000, ev.moment(NOW))


@query(
    f"""WITH {FULL}, then_ AS (SELECT memory_id, status FROM ({"WITH " + UPTO + " SELECT memory_id, status FROM red"})) SELECT coalesce(r.memory_id, t.memory_id) AS memory_id, t.status AS before, r.status AS after
FROM red r FULL JOIN then_ t USING (memory_id) WHERE r.status IS DISTINCT FROM t.status"""
)
def state_diff(t: Tables):
    """#103, #149 entries whose state two points of the log disagree on."""
    now = ev.reduced_entries(t.log).select("memory_id", F.col("status").alias("after"))
    then = ev.reduced_entries(ev.replay(t.log, 6000)).select("memory_id", F.col("status").alias("before"))
    return now.join(then, "memory_id", "full").where(~F.col("after").eqNullSafe(F.col("before"))).select("memory_id", "before", "after")


SAL = f"""{LOG}, acc AS (SELECT *, coalesce(date_diff('microsecond', lag(ts) OVER w, ts), 0) / 8.64e10::DOUBLE AS age FROM log WHERE kind = 'access' WINDOW w AS (PARTITION BY aggregate_id ORDER BY event_id)),
c AS (SELECT *, sum(1 - 0.05::DOUBLE * age) OVER (PARTITION BY aggregate_id ORDER BY event_id) AS c FROM acc),
s AS (SELECT *, c - least(0, min(c) OVER (PARTITION BY aggregate_id ORDER BY event_id)) AS s FROM c),
sal AS (SELECT aggregate_id, arg_max(s, event_id) AS salience, count(*)::BIGINT AS access_count, max(ts) AS last_access_at FROM s GROUP BY 1)"""


@query(f"WITH {SAL} SELECT aggregate_id, round(salience, 6) AS salience, access_count, last_access_at FROM sal")
def salience_fold(t: Tables):
    """#136 salience by the running minimum."""
    return ev.salience(t.log).withColumn("salience", F.round("salience", 6))


@query(f"WITH {SAL} SELECT aggregate_id, round(greatest(0, salience - 0.05::DOUBLE * date_diff('microsecond', last_access_at, TIMESTAMP '2024-02-10 00:00:00') / 8.64e10::DOUBLE), 6) AS signal FROM sal")
def salience_signal(t: Tables):
    """#137, #194 salience as read later."""
    rows = ev.salience(t.log)
    return rows.select("aggregate_id", F.round(ev.signal(F.col("salience"), F.col("last_access_at"), ev.moment("2024-02-10 00:00:00"), 0.05), 6).alias("signal"))


@query(f"WITH {LOG} SELECT scope_id, max(event_id) AS event_id FROM log WHERE ts <= {TS} GROUP BY 1")
def event_at_time(t: Tables):
    """#139 last event at a time."""
    return t.log.where(F.col("ts") <= ev.moment(NOW)).groupBy("scope_id").agg(F.max("event_id").alias("event_id"))


LIVE = "status NOT IN ('retired', 'quarantined') AND retention_stage <> 'archived'"


@query(f"WITH {ENTRIES}, {FULL}, live AS (SELECT * FROM entries WHERE {LIVE}) SELECT memory_id, 'evidence' AS relation, unnest(evidence_refs) AS target FROM live WHERE evidence_refs IS NOT NULL UNION ALL SELECT memory_id, 'supersedes', supersedes::VARCHAR FROM live JOIN red USING (memory_id) WHERE supersedes IS NOT NULL")
def projection_links(t: Tables):
    """#140 evidence and supersede links of live entries."""
    live = t.entries.where(LIVE)
    evidence = live.select("memory_id", F.lit("evidence").alias("relation"), F.explode("evidence_refs").alias("target"))
    chain = ev.reduced_entries(t.log).where("supersedes is not null").select("memory_id", F.lit("supersedes").alias("relation"), F.col("supersedes").cast("string").alias("target"))
    return evidence.unionByName(chain.join(live.select("memory_id"), "memory_id", "left_semi"))


@query(f"WITH {ENTRIES} SELECT scope_id || '/' || kind AS branch, count(*)::BIGINT AS n, max(memory_id) AS newest FROM entries WHERE {LIVE} GROUP BY 1")
def projection_summary(t: Tables):
    """#140 summary by scope and kind."""
    return t.entries.where(LIVE).groupBy(F.concat_ws("/", F.col("scope_id").cast("string"), "kind").alias("branch")).agg(F.count("*").alias("n"), F.max("memory_id").alias("newest"))


@query(f"WITH {LOG}, g AS (SELECT aggregate_id, k, count(*) AS n FROM log GROUP BY ALL) SELECT event_id, log.aggregate_id, log.k FROM log JOIN g USING (aggregate_id, k) WHERE n = k % 3 + 1")
def complete_groups(t: Tables):
    """#141 events of groups that have all their members."""
    whole = t.log.groupBy("aggregate_id", "k").agg(F.count("*").alias("n")).where("n = k % 3 + 1").select("aggregate_id", "k")
    return t.log.join(whole, ["aggregate_id", "k"], "left_semi").select("event_id", "aggregate_id", "k")


@query(f"WITH {ENTRIES} SELECT memory_id, retention_stage, CASE retention_stage WHEN 'active' THEN 'compressed' WHEN 'compressed' THEN 'archived' ELSE 'tombstone' END AS next_stage FROM entries WHERE status = 'active' AND expires_at <= {TS}")
def ttl_due(t: Tables):
    """#142, #216 expired entries advance one stage."""
    step = F.create_map(*[F.lit(x) for pair in ev.STAGES.items() for x in pair])
    return t.entries.where((F.col("status") == "active") & (F.col("expires_at") <= ev.moment(NOW))).select("memory_id", "retention_stage", step[F.col("retention_stage")].alias("next_stage"))


@query(f"WITH {LOG} SELECT aggregate_id, count(*)::BIGINT AS n, sum(k)::BIGINT AS total, TRUE AS equal FROM log GROUP BY 1")
def incremental_equals_full(t: Tables):
    """#143 prefix state plus delta against the full replay."""
    agg = lambda df: df.groupBy("aggregate_id").agg(F.count("*").alias("n"), F.sum("k").alias("total"))
    parts = agg(ev.replay(t.log, 6000)).unionByName(agg(t.log.where("event_id > 6000"))).groupBy("aggregate_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    full = agg(t.log).select("aggregate_id", F.col("n").alias("fn"), F.col("total").alias("ft"))
    return parts.join(full, "aggregate_id", "full").select("aggregate_id", "n", "total", (F.col("n").eqNullSafe(F.col("fn")) & F.col("total").eqNullSafe(F.col("ft"))).alias("equal"))


@query(f"WITH {LOG} SELECT event_id, kind FROM log WHERE ((kind = 'access' AND ts < {TS} - INTERVAL 10 DAY) OR (kind = 'assert' AND event_id <= 4000)) AND event_id NOT IN (SELECT max(event_id) FROM log GROUP BY aggregate_id)")
def archive_eligible(t: Tables):
    """#145, #215 old accesses and covered asserts that nothing protects."""
    old = F.expr(f"timestamp_ntz'{NOW}' - interval 10 days")
    rows = t.log_layout.rows.where(((F.col("kind") == "access") & (F.col("ts") < old)) | ((F.col("kind") == "assert") & (F.col("event_id") <= 4000)))
    protected = t.log.groupBy("aggregate_id").agg(F.max("event_id").alias("event_id")).select("event_id")
    return rows.join(protected, "event_id", "left_anti").select("event_id", "kind")


@query("SELECT event_id, strftime(ts, '%Y-%m') AS month, CASE WHEN user_id % 10 = 0 THEN 'undated' ELSE strftime(ts, '%Y-%m') END AS bucket FROM events")
def month_buckets(t: Tables):
    """#196 month buckets; what has no time is 'undated'."""
    month = F.date_format("ts", "yyyy-MM")
    return t.events.select("event_id", month.alias("month"), F.coalesce(F.when(F.col("user_id") % 10 != 0, month), F.lit("undated")).alias("bucket"))


@query(f"WITH {LOG} SELECT event_id, aggregate_id FROM log WHERE NOT (kind = 'revise' AND k % 2 = 0) AND kind <> 'retract'")
def ordinary_events(t: Tables):
    """#214 without second-version consolidations and control events."""
    return t.log.where("not (kind = 'revise' and k % 2 = 0) and kind <> 'retract'").select("event_id", "aggregate_id")
