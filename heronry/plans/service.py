"""Queries over identifiers and guards, plans and answers, extractors, and parsers of files made from the tables' rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heronry.functions import values as vl
from heronry.operators import events as ev
from heronry.operators import graph as gr
from heronry.operators import planning as pl
from heronry.plans.base import CHUNKS, ENTRIES, LOG, NOW, Tables, query
from heronry.plans.graph import PATHS
from heronry.plans.graph import edges as graph_edges
from heronry.plans.graph import seeds as graph_seeds
from heronry.plans.retrieval import HYBRID, hybrid_lists
from heronry.sources import parsers, sinks

TS = f"TIMESTAMP '{NOW}'"


# Identifiers, instants, guards.
SQL_UUID = "sha1(unhex('6BA7B8119DAD11D180B400C04FD430C8') || encode('memory/v1/' || scope_id || '/7/' || memory_id))"


@query(f"WITH {ENTRIES}, h AS (SELECT memory_id, {SQL_UUID} AS h FROM entries) SELECT memory_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h")
def point_ids(t: Tables):
    """#190 name-based identifiers of revisions of memories."""
    name = F.concat_ws("/", F.lit("memory/v1"), F.col("scope_id").cast("string"), F.lit("7"), F.col("memory_id").cast("string"))
    return t.entries.select("memory_id", vl.uuid5(name).alias("point_id"))


@query("""WITH e AS (SELECT event_id, date_trunc('second', ts) AS ts, event_id % 5 AS m FROM events)
SELECT event_id, CASE m WHEN 0 THEN epoch(ts) WHEN 1 THEN epoch(ts) - 7200 WHEN 3 THEN epoch(ts) + 19800 END::BIGINT AS seconds,
  CASE m WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%SZ') WHEN 3 THEN strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%SZ') END AS iso FROM e""")
def iso_instants(t: Tables):
    """#193 ISO-8601 with a zone; without one, or not a time at all, there is no instant."""
    zone = F.element_at(F.array(*[F.lit(x) for x in ("Z", "+02:00", "", "-05:30", "x")]), (F.col("event_id") % 5 + 1).cast("int"))
    at = vl.instant(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zone))
    return t.events.select("event_id", F.unix_seconds(at).alias("seconds"), F.concat(F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("iso"))


@query("SELECT event_id, (2 * length(event_type) + length(props) + length('x\"' || event_type || chr(10) || 'é'))::BIGINT AS characters FROM events")
def string_leaf_sizes(t: Tables):
    """#187 characters of all strings in a nested document."""
    deep = F.struct(F.col("user_id").alias("n"), F.concat(F.lit('x"'), F.col("event_type"), F.lit("\né")).alias("s"), F.lit(True).alias("b"))
    document = F.to_json(F.struct(F.col("event_type").alias("a"), F.array("event_type", "props").alias("key: \"b"), deep.alias("c")))
    return t.events.select("event_id", vl.string_leaves(document).alias("characters"))


NUMBERS = ('{"memory_id": 12}', '{"memory_id": true}', '{"memory_id": 1.5}', '{"memory_id": "7"}', "{}", '{"memory_id": null}', "no json", '{"memory_id": -3}')
SQL_NUMBER = "CASE event_id % 8 WHEN 0 THEN 12 WHEN 7 THEN -3 END::BIGINT"


@query(f"SELECT event_id, {SQL_NUMBER} AS memory_id, CASE WHEN event_id % 3 <> 0 THEN value END AS value FROM events")
def number_guards(t: Tables):
    """#200 whole numbers that aren't booleans, and finite ones."""
    document = F.element_at(F.array(*[F.lit(x) for x in NUMBERS]), (F.col("event_id") % 8 + 1).cast("int"))
    odd = F.when(F.col("event_id") % 6 == 0, float("nan")).when(F.col("event_id") % 3 == 0, float("-inf")).otherwise(F.col("value"))
    return t.events.select("event_id", vl.whole_number(document, "$.memory_id").alias("memory_id"), vl.finite(odd).alias("value"))


@query("SELECT doc_id, length(trim(lower(text))) AS n, len(regexp_extract_all(text, '[A-Z][a-z]+')) AS names, regexp_matches(text, '[0-9]{2,}') AS numbers, md5(regexp_replace(text, '[aeiou]+', '-', 'g')) AS vowels, len(string_split_regex(text, '[.!?]')) AS parts, regexp_full_match(lang, '[a-z]{2}') AS code FROM documents")
def scalar_patterns(t: Tables):
    """#182, #183 trimmed lower case, and a pattern's places, presence, replacement, parts and full match."""
    x = F.col("text")
    return t.documents.select(
        "doc_id", F.length(F.trim(F.lower(x))).cast("long").alias("n"), F.size(F.regexp_extract_all(x, F.lit("([A-Z][a-z]+)"), 1)).cast("long").alias("names"), x.rlike("[0-9]{2,}").alias("numbers"),
        F.md5(F.regexp_replace(x, "[aeiou]+", "-").cast("binary")).alias("vowels"), F.size(F.split(x, "[.!?]")).cast("long").alias("parts"), F.col("lang").rlike("^[a-z]{2}$").alias("code"),
    )


@query(f"SELECT event_id, ts + to_days((user_id % 30)::INTEGER) AS later, ts - to_seconds(user_id % 86400) AS earlier, ts + to_days((user_id % 30)::INTEGER) <= {TS} AS due FROM events")
def moved_instants(t: Tables):
    """#195 instants moved by days and by seconds, against a stated now."""
    later = F.expr("ts + make_dt_interval(cast(user_id % 30 as int), 0, 0, 0)")
    return t.events.select("event_id", later.alias("later"), F.expr("ts - make_dt_interval(0, 0, 0, user_id % 86400)").alias("earlier"), (later <= ev.moment(NOW)).alias("due"))


# Plans and answers.
PLANS = """plans AS (
  SELECT item_id AS plan_id, 'q' || item_id AS question, CASE WHEN item_id % 4 > 0 THEN i END AS pos, CASE WHEN item_id % 4 > 0 THEN 'q' || item_id || '-' || i END AS query,
    (item_id + i) % 5 AS s, (item_id + i) % 3 AS d, (item_id * i) % 5 AS h, item_id % 3 = 0 AS bare
  FROM (SELECT item_id, unnest(range(1, greatest(1, item_id % 4) + 1)) AS i FROM benchmark)),
checked AS (
  SELECT *, coalesce(pos, 1) AS id, CASE WHEN pos IS NULL THEN 'dense' WHEN s = 0 THEN 'dense' WHEN s = 1 THEN CASE WHEN bare THEN 'sparse' ELSE 'graph,sparse' END WHEN s = 3 THEN CASE WHEN bare THEN 'dense' ELSE 'graph' END ELSE 'dense' END AS signals FROM plans),
full_ AS (
  SELECT plan_id, question, id, coalesce(query, question) AS query, signals, bare, contains(signals, 'graph') AS graph,
    CASE WHEN bare THEN '' WHEN pos IS NULL THEN 'calls,part_of' WHEN d = 1 THEN 'calls' WHEN d = 2 THEN 'calls,part_of' WHEN contains(signals, 'graph') THEN 'calls,part_of' ELSE '' END AS directions,
    CASE WHEN contains(signals, 'graph') THEN CASE h WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 2 END END AS hop, count(*) OVER (PARTITION BY plan_id) > 1 AS many FROM checked)"""


def plans(t: Tables) -> DataFrame:
    def pick(i, *values):
        return F.element_at(F.array(*values), (i + 1).cast("int"))

    words = lambda *x: F.array(*[F.lit(w) for w in x]).cast("array<string>")
    n, i = F.col("item_id"), F.col("i")
    rows = t.benchmark.select("item_id", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), (n % 4).cast("int")))).alias("i"))
    some = n % 4 > 0
    none = F.lit(None).cast("array<string>")
    return rows.select(
        n.alias("plan_id"), F.concat(F.lit("q"), n.cast("string")).alias("question"), F.when(some, i).alias("pos"),
        F.when(some, F.concat(F.lit("q"), n.cast("string"), F.lit("-"), i.cast("string"))).alias("query"),
        pick((n + i) % 5, words("dense"), words("graph", "sparse"), words("nope"), words("graph"), none).alias("signals"),
        pick((n + i) % 3, none, words("calls"), words("calls", "bad")).alias("directions"),
        pick((n * i) % 5, *[F.lit(x) for x in ("1", "3", "7", "x", None)]).alias("hop"), F.when(n % 3 == 0, words()).otherwise(words("calls", "part_of")).alias("vocabulary"),
    )


def shown_plan(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.concat_ws(",", c) for c in ("signals", "directions")}).select("plan_id", "sub_problem_id", "query", "signals", "directions", "hop")


@query(f"WITH {PLANS} SELECT plan_id, id::INTEGER AS sub_problem_id, query, signals, directions, hop::INTEGER AS hop FROM full_")
def plan_checked(t: Tables):
    """#169 a planner's output with what is valid, or its fallback."""
    return shown_plan(pl.checked_plan(plans(t)))


@query(f"""WITH {PLANS} SELECT plan_id, CASE WHEN many THEN id + 1 ELSE 1 END::INTEGER AS sub_problem_id, CASE WHEN many THEN query ELSE question END AS query, signals, directions, hop::INTEGER AS hop FROM full_
UNION ALL SELECT DISTINCT plan_id, 1, question, 'dense,sparse', '', NULL FROM full_ WHERE many""")
def plan_hardened(t: Tables):
    """#170 the question itself is always among its sub-questions."""
    return shown_plan(pl.hardened(pl.checked_plan(plans(t))))


@query(f"WITH {PLANS} SELECT plan_id, id::INTEGER AS sub_problem_id, graph AS use_graph, CASE WHEN graph THEN directions END AS relation_types FROM full_")
def plan_graph_params(t: Tables):
    """#171 whether the graph is asked, and for which relations."""
    x = pl.graph_params(F.col("signals"), F.col("directions"), F.col("vocabulary"))
    rows = pl.checked_plan(plans(t)).select("plan_id", "sub_problem_id", x.alias("x")).select("plan_id", "sub_problem_id", "x.*")
    return rows.withColumn("relation_types", F.when(F.col("relation_types").isNotNull(), F.concat_ws(",", "relation_types")))


ITEMS = f"""{ENTRIES}, it AS (SELECT scope_id, memory_id, to_json({{'content': content, 'memory_id': memory_id}})::VARCHAR AS item, row_number() OVER (PARTITION BY scope_id ORDER BY observed_at DESC, memory_id DESC) AS pos FROM entries QUALIFY pos <= 30),
al AS (SELECT scope_id, count(*) AS total, list(item ORDER BY pos) AS items FROM it GROUP BY 1),
pre AS (SELECT scope_id, total, n, '{{"completion_status":"' || CASE WHEN n = total THEN 'complete' ELSE 'partial' END || '","counts":{{"characters":' AS a,
  ',"returned":' || n || ',"truncated_by_budget":' || (total - n) || '}},"memories":[' || array_to_string(items[1:n], ',') || ']}}' AS b FROM (SELECT *, unnest(range(0, total + 1)) AS n FROM al)),
sz AS (SELECT scope_id, total, n, list_min(list_filter(list_transform(range(1, 8), lambda d: length(a) + length(b) + d), lambda c: length(a || c || b) = c)) AS c FROM pre),
best AS (SELECT scope_id, max(n) AS n FROM sz WHERE c <= 1500 OR n = 0 GROUP BY 1)"""


@query(f"WITH {ITEMS} SELECT it.scope_id, it.memory_id, it.pos::INTEGER AS pos, it.pos <= best.n AS kept, sz.c::BIGINT AS characters, CASE WHEN sz.n = sz.total THEN 'complete' ELSE 'partial' END AS completion_status FROM it JOIN best USING (scope_id) JOIN sz ON sz.scope_id = it.scope_id AND sz.n = best.n")
def size_budget(t: Tables):
    """#98 items go from the tail until the answer, with its own size written in it, fits."""
    rows = t.entries.withColumn("item", F.to_json(F.struct("content", "memory_id")))
    out = pl.size_budget(rows, "scope_id", [F.col("observed_at").desc(), F.col("memory_id").desc()], "item", 1500, 30)
    return out.select("scope_id", "memory_id", "pos", "kept", "characters", "completion_status")


@query("""SELECT user_id % 50 AS session, to_json({'completion_status': 'complete', 'related_memories': list('content=' || event_type || ';memory_id=' || event_id ORDER BY event_id)})::VARCHAR AS answer
FROM events WHERE event_id % 8 IN (0, 7) GROUP BY 1""")
def merged_answer(t: Tables):
    """#158 memories joined to an answer: only items with a whole memory_id, without what locates evidence; absent
    parts are left out, in a fixed order."""
    number = F.when(F.col("event_id") % 8 == 1, "true").when(F.col("event_id") % 8 == 2, '"x"').when(F.col("event_id") % 8 == 3, "1.5").when(F.col("event_id") % 8 < 7, F.when(F.col("event_id") % 8 == 0, F.col("event_id").cast("string")).otherwise("null")).otherwise(F.col("event_id").cast("string"))
    item = F.concat(F.lit('{"memory_id":'), number, F.lit(',"content":"'), F.col("event_type"), F.lit('","source_position":"p1","relevance_score":0.5}'))
    rows = t.events.select((F.col("user_id") % 50).alias("session"), "event_id", item.alias("item")).where(vl.whole_number(F.col("item"), "$.memory_id").isNotNull())
    clean = pl.without_locating(F.col("item"))
    text = F.array_join(F.transform(F.array_sort(F.map_entries(clean)), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";")
    lists = rows.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("event_id", text.alias("x")))).alias("l"))
    answer = F.struct(F.lit("complete").alias("completion_status"), F.lit(None).cast("string").alias("evidence"), F.transform("l", lambda x: x["x"]).alias("related_memories"), F.lit(None).cast("string").alias("gaps"))
    return lists.select("session", F.to_json(answer).alias("answer"))


@query(f"WITH {LOG}, n AS (SELECT scope_id, count(*) FILTER (WHERE event_id > 5000) AS fresh, max(ts) FILTER (WHERE event_id <= 5000) AS covered FROM log GROUP BY 1) SELECT scope_id, fresh, fresh >= 10000 OR (fresh > 0 AND covered <= {TS} - INTERVAL 24 HOUR) AS due FROM n")
def snapshot_due(t: Tables):
    """#144 a snapshot is due after 10 000 fresh events, or a day if there is any."""
    g = t.log.groupBy("scope_id").agg(F.count_if(F.col("event_id") > 5000).alias("fresh"), F.max(F.when(F.col("event_id") <= 5000, F.col("ts"))).alias("covered"))
    due = (F.col("fresh") >= 10_000) | ((F.col("fresh") > 0) & (F.col("covered") <= F.expr(f"timestamp_ntz'{NOW}' - interval 24 hours")))
    return g.select("scope_id", "fresh", due.alias("due"))


@query("SELECT conv_id, CASE WHEN count(*) FILTER (WHERE role = 'assistant') = 0 THEN 'no_evidence' WHEN count(*) FILTER (WHERE role = 'system') > 0 THEN 'partial' ELSE 'complete' END AS status, count(*) FILTER (WHERE role = 'assistant') = 0 AND max(turn) < 3 AS again FROM conversations GROUP BY 1")
def loop_decision(t: Tables):
    """#118, #173 completion by hits and failed paths; another round only with a gap and rounds left."""
    g = t.conversations.groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("hits"), F.count_if(F.col("role") == "system").alias("failed"), F.max("turn").alias("rounds"))
    status = F.when(F.col("hits") == 0, "no_evidence").when(F.col("failed") > 0, "partial").otherwise("complete")
    return g.select("conv_id", status.alias("status"), ((F.col("hits") == 0) & (F.col("rounds") < 3)).alias("again"))


@query(
    f"""WITH {HYBRID}, {CHUNKS}, q AS (SELECT item_id, ['de', 'en', 'es', 'fr'][item_id % 4 + 1] AS scope, item_id % 5 AS round FROM benchmark),
h AS (SELECT 'dense' AS path, item_id, doc_id FROM dr UNION ALL SELECT 'sparse', item_id, doc_id FROM sr),
g AS (SELECT h.* FROM h JOIN q USING (item_id) JOIN chunks c ON c.doc_id = h.doc_id AND c.scope = q.scope AND c.status = 'published'),
n AS (SELECT item_id, count(DISTINCT doc_id) AS n, list(DISTINCT path) AS paths FROM g GROUP BY 1),
o AS (SELECT item_id, round, least(coalesce(n, 0), 3)::INTEGER AS returned, list_filter(['dense', 'sparse'], lambda p: NOT list_contains(coalesce(paths, []), p)) AS failed FROM q LEFT JOIN n USING (item_id))
SELECT item_id, returned, array_to_string(failed, ',') AS failed_paths, 3 - returned AS missing, CASE WHEN returned = 0 THEN 'no_evidence' WHEN len(failed) > 0 THEN 'partial' ELSE 'complete' END AS status,
  returned < 3 AND round < 3 AS again FROM o"""
)
def recall_outcome(t: Tables):
    """#118, #173 completion, failed paths, gap and another round, from what the recalls of a question found in its scope."""
    scope = F.element_at(F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")]), (F.col("item_id") % 4 + 1).cast("int"))
    asked = t.benchmark.select("item_id", scope.alias("scope"))
    live = t.chunks.where("status = 'published'").select("doc_id", "scope")
    lists = {name: df.select("item_id", "doc_id").join(asked, "item_id").join(live, ["doc_id", "scope"], "left_semi") for name, df in hybrid_lists(t).items()}
    out = pl.outcome(lists, t.benchmark.select("item_id", (F.col("item_id") % 5).alias("round")), 3, F.col("round"), 3)
    return out.withColumns({"failed_paths": F.array_join("failed_paths", ","), "returned": F.col("returned").cast("int"), "missing": F.col("missing").cast("int")})


# Extractors, edges by scope, traces.
VOCABULARIES = (("en", ("calls", "references")), ("de", ("references",)), ("fr", ()), ("es", ("part_of",)))


@query("""WITH f AS (SELECT doc_id, lang AS domain, ['java', 'ddl', 'markdown', 'csv'][doc_id % 4 + 1] AS format FROM documents),
x(place, extractor, format, relation) AS (VALUES (0, 'java_calls', 'java', 'calls'), (1, 'ddl_keys', 'ddl', 'references'), (2, 'cross_references', 'markdown', 'references')),
v(domain, relation) AS (VALUES ('en', 'calls'), ('en', 'references'), ('de', 'references'), ('es', 'part_of')) SELECT doc_id, extractor, place FROM f JOIN x USING (format) JOIN v USING (domain, relation)""")
def extractor_registry(t: Tables):
    """#127 extractors by format and the domain's relations."""
    form = F.element_at(F.array(*[F.lit(x) for x in ("java", "ddl", "markdown", "csv")]), (F.col("doc_id") % 4 + 1).cast("int"))
    files = t.documents.select("doc_id", F.col("lang").alias("domain"), form.alias("format"))
    words = t.rows("domain string, relations array<string>", *[(d, list(r)) for d, r in VOCABULARIES])
    return gr.discovered(files, words).select("doc_id", "extractor", "place")


@query("SELECT c_nationkey AS scope_id, c_custkey AS src, c_nationkey + 1000 AS dst FROM customer WHERE c_nationkey NOT IN (3, 7) UNION ALL SELECT c_nationkey, c_custkey, c_custkey // 2 FROM customer WHERE c_nationkey IN (3, 7) AND c_custkey % 2 = 0")
def scope_rebuild(t: Tables):
    """#126 the edges of two scopes made anew, all others as they were."""
    c = t.customer.select(F.col("c_nationkey").cast("long").alias("scope_id"), F.col("c_custkey").cast("long").alias("src"))
    old = c.withColumn("dst", F.col("scope_id") + 1000)
    fresh = c.where("src % 2 = 0").withColumn("dst", F.expr("src div 2"))
    return gr.rebuilt(old, fresh, t.rows("scope_id long", (3,), (7,)))


@query(f"WITH RECURSIVE {PATHS} SELECT sha256('1|' || start || '|' || node || '|' || hop) AS trace_id, start, node, hop, weight, {TS} AS created_at FROM best")
def expansion_trace(t: Tables):
    """#133 the best paths of an expansion as rows of its trace."""
    paths = gr.best_reached(graph_edges(t), graph_seeds(t), 3)
    return gr.trace(paths, F.lit(1), ev.moment(NOW)).drop("question_id")


@query(f"""WITH {ENTRIES}, e AS (SELECT DISTINCT scope_id FROM entries) SELECT name, CASE name WHEN 'dense' THEN (SELECT count(*) FROM entries) WHEN 'by_kind' THEN (SELECT count(*) FROM (SELECT DISTINCT scope_id, kind FROM entries))
  WHEN 'salience' THEN (SELECT count(*) FROM entries WHERE salience > 0) WHEN 'links' THEN (SELECT count(*) FROM entries WHERE evidence_refs IS NOT NULL) WHEN 'timeline' THEN (SELECT count(*) FROM (SELECT DISTINCT scope_id, strftime(observed_at, '%Y-%m') FROM entries))
  ELSE (SELECT count(*) FROM e) END AS n, TRUE AS matches_replay FROM (SELECT unnest(['dense', 'by_kind', 'salience', 'links', 'timeline', 'summary']) AS name)""")
def projection_manifest(t: Tables):
    """#150 six projections written as a revision, read back, held against their replay, and listed in a manifest."""
    e = t.entries
    month = F.date_format("observed_at", "yyyy-MM")
    found = {
        "dense": e.select("memory_id", "scope_id", "content"), "by_kind": e.groupBy("scope_id", "kind").agg(F.count("*").alias("n")), "salience": e.where("salience > 0").select("memory_id", "salience"),
        "links": e.select("memory_id", F.explode("evidence_refs").alias("ref")), "timeline": e.groupBy("scope_id", month.alias("month")).agg(F.count("*").alias("n")), "summary": e.groupBy("scope_id").agg(F.max("memory_id").alias("last")),
    }
    return sinks.manifest(t.spark, found)


# Files made from rows.
def files(rows: DataFrame, key: str, order: str, fmt: str, head: str, line: F.Column, foot: str = "") -> DataFrame:
    """A text file per key: head, a line for each row in order, foot; {} stands for the key."""
    g = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, line.alias("l")))).alias("l"))
    fill = lambda x: F.replace(F.lit(x), F.lit("{}"), F.col(key).cast("string"))
    return g.select(F.col(key).cast("string").alias("path"), F.lit(fmt).alias("format"), F.concat(fill(head), F.array_join(F.transform("l", lambda x: x["l"]), ""), fill(foot)).alias("content"))


def binary_files(rows: DataFrame, build: Callable[[list], bytes], fmt: str) -> DataFrame:
    """rows (path, lines array<string>) -> files whose bytes build makes of the lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "format": fmt, "content": [build(list(x)) for x in batch["lines"]]})

    return rows.select("path", "lines").mapInPandas(run, "path string, format string, content binary")


def zip_of(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def nation_files(t: Tables, fmt: str, head: str, line: F.Column, foot: str = "") -> DataFrame:
    return parsers.parsed(files(t.nation, "n_regionkey", "n_nationkey", fmt, head, line, foot))


def text(*parts) -> F.Column:
    """Literals and columns behind one another; KEY stands for the nation's number."""
    return F.concat(*[(F.col("n_nationkey") if p is KEY else p).cast("string") if p is KEY or not isinstance(p, str) else F.lit(p) for p in parts])


KEY = "n_nationkey"
NATIONS = "n AS (SELECT n_regionkey AS r, n_nationkey AS k, n_name AS name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i, count(*) OVER (PARTITION BY n_regionkey) AS m, lag(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS before FROM nation)"
PLACE = ("path", "position", "parent", "kind", "start_line", "end_line")
JAVA = ('// no { here\nclass Region{} {\n  String mark = "}";\n', lambda: text("  void nation_", KEY, "(int x) { nation_", F.coalesce(F.lag(KEY).over(Window.partitionBy("n_regionkey").orderBy(KEY)), F.col(KEY)), "(1); none(x); }\n"), "}\n")


def java_files(t: Tables, fmt: str) -> DataFrame:
    rows = t.nation.withColumn("line", JAVA[1]())
    return parsers.parsed(files(rows, "n_regionkey", "n_nationkey", fmt, JAVA[0], F.col("line"), JAVA[2]))


@query(f"""WITH {NATIONS} SELECT r::VARCHAR AS path, 'Region' || r AS position, '' AS parent, 'class' AS kind, 2 AS start_line, (4 + max(i))::INTEGER AS end_line FROM n GROUP BY r
UNION ALL SELECT DISTINCT r::VARCHAR, 'Region' || r || '#mark', 'Region' || r, 'field', 3, 3 FROM n UNION ALL SELECT r::VARCHAR, 'Region' || r || '#nation_' || k, 'Region' || r, 'method', (3 + i)::INTEGER, (3 + i)::INTEGER FROM n""")
def java_symbols(t: Tables):
    """#28 types, fields and methods; braces in comments and strings don't count."""
    return java_files(t, "java").select(*PLACE)


@query(f"WITH {NATIONS} SELECT r::VARCHAR AS path, 'Region' || r || '#nation_' || k AS src, 'Region' || r || '#nation_' || before AS dst, 'calls' AS relation FROM n WHERE before IS NOT NULL UNION ALL SELECT r::VARCHAR, 'Region' || r || '#nation_' || before, 'Region' || r || '#nation_' || k, 'called_by' FROM n WHERE before IS NOT NULL")
def java_call_graph(t: Tables):
    """#128 calls between methods of a file, each way."""
    rows = java_files(t, "java_calls")
    methods = rows.where("kind = 'method'").select("path", F.col("content").alias("name"), F.col("position").alias("chunk"))
    return gr.call_edges(methods, rows.where("kind = 'call'").select("path", F.col("parent").alias("caller"), F.col("position").alias("name")))


@query(f"WITH {NATIONS} SELECT r::VARCHAR AS path, 'Set' AS position, '' AS parent, 'type' AS kind, 3 AS start_line, 5 AS end_line FROM n GROUP BY r UNION ALL SELECT r::VARCHAR, 'Set.Nation' || k, 'Set', 'method', (3 + 3 * i)::INTEGER, (5 + 3 * i)::INTEGER FROM n")
def go_symbols(t: Tables):
    """#28 types and methods of Go sources."""
    line = text("func (s *Set) Nation", KEY, '(x int) string {\n\treturn "}" // }\n}\n')
    return nation_files(t, "go", "package region{}\n\ntype Set struct {\n\tn int // {\n}\n", line).select(*PLACE)


@query(f"WITH {NATIONS} SELECT r::VARCHAR AS path, 'Region' || r AS position, '' AS parent, 'class' AS kind, 1 AS start_line, (1 + 2 * max(i))::INTEGER AS end_line FROM n GROUP BY r UNION ALL SELECT r::VARCHAR, 'Region' || r || '.nation_' || k, 'Region' || r, 'method', (2 * i)::INTEGER, (1 + 2 * i)::INTEGER FROM n")
def python_symbols(t: Tables):
    """#29 classes and methods of Python sources."""
    return nation_files(t, "python", "class Region{}:\n", text("    def nation_", KEY, "(self):\n        return '", F.col("n_name"), "'\n")).select(*PLACE)


@query(f"""WITH {NATIONS} SELECT r::VARCHAR AS path, 'N' || k AS position, '' AS parent, 'schema' AS kind FROM n UNION ALL SELECT r::VARCHAR, 'POST /n/' || k, 'N' || k, 'endpoint' FROM n""")
def openapi_parts(t: Tables):
    """#31 schemas and endpoints; an endpoint's parent is what its body refers to."""
    order = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    n = t.nation.withColumn("sep", F.when(F.row_number().over(order) > 1, ",").otherwise(""))
    one = n.groupBy("n_regionkey").agg(
        F.array_join(F.array_sort(F.collect_list(text('"N', KEY, '":{"type":"object"}'))), ",").alias("s"),
        F.array_join(F.array_sort(F.collect_list(text('"/n/', KEY, '":{"post":{"responses":{"$ref":"#/x/Other"},"requestBody":{"$ref":"#/components/schemas/N', KEY, '"}}}'))), ",").alias("p"),
    )
    content = text('{"openapi":"3.0.0","components":{"schemas":{', F.col("s"), '}},"paths":{', F.col("p"), "}}")
    found = one.select(F.col("n_regionkey").cast("string").alias("path"), parsers.format_of(F.lit("a.json"), content).alias("format"), content.alias("content"))
    return parsers.parsed(found).select("path", "position", "parent", "kind")


@query(f"WITH {NATIONS} SELECT r::VARCHAR AS path, '/region/nation[' || i || ']' AS position, '/region' AS parent, name || ' ' || k AS content FROM n UNION ALL SELECT r::VARCHAR, '/region/nation[' || i || ']/name[1]', '/region/nation[' || i || ']', name FROM n UNION ALL SELECT r::VARCHAR, '/region/nation[' || i || ']/key[1]', '/region/nation[' || i || ']', k::VARCHAR FROM n")
def xml_elements(t: Tables):
    """#24 every element under the root by its path."""
    line = text("<nation><name>", F.col("n_name"), "</name> <key>", KEY, "</key></nation>\n")
    return nation_files(t, "xml", '<?xml version="1.0"?>\n<region id="{}">\n', line, "</region>").select("path", "position", "parent", "content")


@query("SELECT conv_id || '-' || turn AS path, 'msg:Turn ' || turn AS position, 'From: ' || role || '@example.org' || chr(10) || 'To: all@example.org' || chr(10) || 'Subject: Turn ' || turn || chr(10) || chr(10) || 'It has ' || length(text) || ' characters.' || chr(10) AS content FROM conversations")
def mail_parts(t: Tables):
    """#25 mails by their subject, with the headers that matter and the plain body."""
    body = text("From: ", F.col("role"), "@example.org\nTo: all@example.org\nX-Other: y\nSubject: Turn ", F.col("turn"), "\n\nIt has ", F.length("text"), " characters.\n")
    mails = t.conversations.select(text(F.col("conv_id"), "-", F.col("turn")).alias("path"), F.lit("eml").alias("format"), body.alias("content"))
    return parsers.parsed(mails).select("path", "position", "content")


def sheet_bytes(lines: list) -> bytes:
    rows = "".join(f'<row r="{i}"><c r="A{i}" t="s"><v>{i - 1}</v></c><c r="C{i}"><v>{i}</v></c></row>' for i in range(1, len(lines) + 1))
    shared = "".join(f"<si><t>{x}</t></si>" for x in lines)
    return zip_of({"xl/workbook.xml": '<workbook><sheets><sheet name="Nations"/></sheets></workbook>', "xl/sharedStrings.xml": f"<sst>{shared}</sst>", "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{rows}</sheetData></worksheet>"})


def nation_lines(t: Tables) -> DataFrame:
    g = t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("l"))
    return g.select(F.col("n_regionkey").cast("string").alias("path"), F.transform("l", lambda x: x["n_name"]).alias("lines"))


@query(f"WITH {NATIONS} SELECT r::VARCHAR AS path, 'sheet:Nations' AS position, 'table' AS kind, 1 AS start_line, max(i)::INTEGER AS end_line, string_agg('| ' || name || ' |  | ' || i || ' |', chr(10) ORDER BY i) AS content FROM n GROUP BY r")
def sheet_tables(t: Tables):
    """#25 a table per sheet of a workbook."""
    return parsers.parsed(binary_files(nation_lines(t), sheet_bytes, "xlsx")).select("path", "position", "kind", "start_line", "end_line", "content")


def word_bytes(lines: list) -> bytes:
    p = lambda x, style="": f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>' if style else ''}<w:r><w:t>{x}</w:t></w:r></w:p>"
    cells = "".join(f"<w:tr><w:tc>{p(x)}</w:tc><w:tc>{p(len(x))}</w:tc></w:tr>" for x in lines)
    body = p("Region", "Heading1") + p("Names", "Heading2") + "".join(p(x, "ListBullet") for x in lines) + p("Said once.") + f"<w:tbl>{cells}</w:tbl>"
    return zip_of({"word/document.xml": f'<w:document xmlns:w="urn:w"><w:body>{body}</w:body></w:document>'})


@query(f"""WITH {NATIONS}, g AS (SELECT r::VARCHAR AS path, max(i)::INTEGER AS m, string_agg(name, chr(10) ORDER BY i) AS names, string_agg('| ' || name || ' | ' || length(name) || ' |', chr(10) ORDER BY i) AS cells FROM n GROUP BY r)
SELECT path, '# Region' AS position, '' AS parent, 'heading' AS kind, 1 AS start_line, 1 AS end_line, '# Region' AS content FROM g UNION ALL SELECT path, '# Region > ## Names', '# Region', 'heading', 2, 2, '## Names' FROM g
UNION ALL SELECT path, '# Region > ## Names', '# Region', 'list', 3, 2 + m, names FROM g UNION ALL SELECT path, '# Region > ## Names', '# Region', 'paragraph', 3 + m, 3 + m, 'Said once.' FROM g
UNION ALL SELECT path, '# Region > ## Names', '# Region', 'table', 4 + m, 3 + 2 * m, cells FROM g""")
def word_blocks(t: Tables):
    """#5, #26 headings, lists, lines and tables of Word files."""
    return parsers.parsed(binary_files(nation_lines(t), word_bytes, "word")).select(*PLACE, "content")


def pdf_bytes(lines: list) -> bytes:
    """A page in two columns: a numbered heading, and a line for each name in each column; its stream is deflated."""
    import zlib

    shown = ["BT /F1 10 Tf"]
    for x, mark in ((50, "1 Left"), (330, "2 Right")):
        shown.append(f"1 0 0 1 {x} 740 Tm ({mark} part) Tj")
        shown += [f"1 0 0 1 {x} {720 - 20 * i} Tm [({name[:3]}) -20 ({name[3:]} \\({i}\\))] TJ" for i, name in enumerate(lines)]
    stream = zlib.compress("\n".join([*shown, "ET"]).encode())
    parts = [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 612 792] >>",
        b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>",
        b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(stream) + stream + b"\nendstream", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
    ]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, x) for i, x in enumerate(parts, 1)) + b"trailer << /Root 1 0 R >>\n%%EOF"


@query(f"""WITH {NATIONS}, g AS (SELECT r::VARCHAR AS path, max(i)::INTEGER AS m, string_agg(substr(name, 1, 3) || ' ' || substr(name, 4) || ' (' || (i - 1) || ')', chr(10) ORDER BY i) AS body FROM n GROUP BY r),
c(title, side) AS (VALUES ('1 Left part', 0), ('2 Right part', 1))
SELECT path, 'page:1 §' || title AS position, 'page:1' AS parent, 'heading' AS kind, 1000 + side * (m + 1) AS start_line, 1000 + side * (m + 1) AS end_line, title AS content FROM g, c
UNION ALL SELECT path, 'page:1 §' || title, 'page:1', 'paragraph', 1001 + side * (m + 1), 1001 + m + side * (m + 1), body FROM g, c""")
def pdf_blocks(t: Tables):
    """#5, #27 headings and paragraphs of a page, its columns one after the other."""
    return parsers.parsed(binary_files(nation_lines(t), pdf_bytes, "pdf")).select(*PLACE, "content")


@query("SELECT doc_id, md5(text || chr(65533) || '.') AS text_md5 FROM documents")
def file_texts(t: Tables):
    """#2 text of files; bytes that aren't UTF-8 become marks."""
    raw = F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF")), F.lit(".").cast("binary"))
    found = parsers.texts(t.documents.select(F.col("doc_id").cast("string").alias("path"), F.lit("txt").alias("format"), raw.alias("content")))
    return found.select(F.col("path").cast("long").alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


DDL = ("CREATE TABLE region_{} (id INT PRIMARY KEY, note VARCHAR(9) DEFAULT 'a;b');\n", lambda: text("CREATE TABLE nation_", KEY, " (id INT, up INT, CONSTRAINT fk_", KEY, " FOREIGN KEY (up) REFERENCES region_", F.col("n_regionkey"), " (id)); -- one; more\n"), "INSERT INTO region_{} VALUES (1);\n")


@query(f"""WITH {NATIONS}, c(name, kind) AS (VALUES ('id', 'column'), ('up', 'column'), ('fk', 'constraint')), rc(name) AS (VALUES ('id'), ('note'))
SELECT DISTINCT r::VARCHAR AS path, 'region_' || r AS position, '' AS parent, 'table' AS kind, 1 AS start_line FROM n UNION ALL SELECT DISTINCT r::VARCHAR, 'region_' || r || '.' || rc.name, 'region_' || r, 'column', 1 FROM n, rc
UNION ALL SELECT r::VARCHAR, 'nation_' || k, '', 'table', (1 + i)::INTEGER FROM n UNION ALL SELECT r::VARCHAR, 'nation_' || k || '.' || CASE c.name WHEN 'fk' THEN 'fk_' || k ELSE c.name END, 'nation_' || k, c.kind, (1 + i)::INTEGER FROM n, c""")
def ddl_objects(t: Tables):
    """#30 tables, columns and constraints; semicolons in strings and comments end nothing."""
    return nation_files(t, "ddl", DDL[0], DDL[1](), DDL[2]).select("path", "position", "parent", "kind", "start_line")


@query(f"WITH {NATIONS} SELECT r::VARCHAR AS path, 'nation_' || k AS src, 'region_' || r AS dst, 'fk_' || k AS name, 'references' AS relation FROM n UNION ALL SELECT r::VARCHAR, 'region_' || r, 'nation_' || k, 'fk_' || k, 'referenced_by' FROM n")
def ddl_fk_edges(t: Tables):
    """#129 foreign keys of schemas, each way."""
    found = nation_files(t, "ddl_keys", DDL[0], DDL[1](), DDL[2])
    forth = found.select("path", F.col("parent").alias("src"), F.col("position").alias("dst"), F.col("content").alias("name"), F.lit("references").alias("relation"))
    back = forth.select("path", F.col("dst").alias("src"), F.col("src").alias("dst"), "name", F.lit("referenced_by").alias("relation"))
    return forth.unionByName(back)
