"""Registry of queries, and the entities that queries and oracles both derive from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.functions.text import STOP_WORDS
from heronry.operators import layout as ly
from heronry.operators import retrieval as rt
from heronry.operators import vectors as vx
from heronry.session import listing, qualified

#: Indexes and layouts of an application by folder and kind, with the listing of the table's files when they were made.
_INDEXES: dict[tuple[str, str, str], tuple[tuple, rt.Index | vx.VectorIndex | ly.Layout]] = {}
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Callable], Query]:
    """Registers f(T) as a query over Tables, with its oracle."""

    def add(f: Callable) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        key = name or f.__name__
        assert key not in QUERIES, key
        QUERIES[key] = run
        if sql:
            ORACLES[key] = sql
        return run

    return add


class Tables:
    """The driver's tables by name, and entities derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def rows(self, schema: str, *rows: tuple) -> DataFrame:
        return self.spark.createDataFrame(list(rows), schema)

    @property
    def chunks(self) -> DataFrame:
        """documents as chunks: source number, version of the source, scope (language), status of the version."""
        d = self.documents
        number = F.substring("source", 4, 10).cast("long")
        d = d.select("doc_id", "text", "source", F.col("lang").alias("scope"), "n_chars", number.alias("source_id"), (number * 10 + F.col("doc_id") % 3 + 1).alias("version_id"))
        status = F.when(F.col("version_id") % 10 == 3, F.when(F.col("source_id") % 5 == 0, "draft").otherwise("published")).otherwise("superseded")
        return d.withColumn("status", status)

    def _indexed(self, kind: str, name: str, make: Callable[[DataFrame], rt.Index | vx.VectorIndex | ly.Layout]):
        """The stored index or layout of a table: made once per session, and again after the table's files have changed."""
        key, now = (self.spark.sparkContext.applicationId, self.dir, kind), listing(self.spark, f"{self.dir}/{name}.parquet")
        if key not in _INDEXES or _INDEXES[key][0] != now:
            if key in _INDEXES:
                _INDEXES.pop(key)[1].dropped()
            _INDEXES[key] = (now, make(getattr(self, name)))
        return _INDEXES[key][1]

    @property
    def index(self) -> rt.Index:
        """The inverted index of documents."""
        return self._indexed("terms", "documents", lambda d: rt.indexed(d, stored=True))

    @property
    def chunk_layout(self) -> ly.Layout:
        """Chunks in folders by status of their version and by scope."""
        return self._indexed("chunks", "documents", lambda _: ly.laid_out(self.chunks, "doc_id", ("status", "scope")))

    @property
    def vector_index(self) -> vx.VectorIndex:
        """The cluster index of embeddings."""
        return self._indexed("vectors", "embeddings", vx.clustered)

    @property
    def versions(self) -> DataFrame:
        return self.chunks.select("version_id", "source_id", "status").distinct()

    @property
    def log(self) -> DataFrame:
        """events as a memory event log."""
        return as_log(self.events)

    @property
    def log_layout(self) -> ly.Layout:
        """The log in folders by scope and buckets by event."""
        return self._indexed("log", "events", lambda e: ly.laid_out(as_log(e), "event_id", ("scope_id",)))

    @property
    def archived_layout(self) -> ly.Layout:
        """Events that are archived: accesses before the time that #11 asks for."""
        old = F.col("ts") < F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")
        return self._indexed("archived", "events", lambda e: ly.laid_out(as_log(e).where((F.col("kind") == "access") & old).select("event_id"), "event_id"))

    @property
    def log_stream(self) -> DataFrame:
        """The same log as a stream of the table's files. A stream's path is a folder, so a table of one file is looked for in
        its own."""
        path, rows = f"{self.dir}/events.parquet", self.spark.readStream.schema(self.events.schema)
        if [f for f, _, _ in listing(self.spark, path)] == [qualified(self.spark, path)]:
            return as_log(rows.option("pathGlobFilter", "events.parquet").parquet(self.dir))
        return as_log(rows.parquet(path))

    @property
    def entries(self) -> DataFrame:
        """Memory entries: the events that create one, with fields of the temporal model."""
        e = self.events.where("event_type in ('signup', 'purchase')")
        i = F.col("event_id")
        pick = lambda *names: F.element_at(F.array(*[F.lit(n) for n in names]), (i % len(names) + 1).cast("int"))
        k = F.get_json_object("props", "$.k").cast("int")
        return e.select(
            i.alias("memory_id"),
            (F.col("user_id") % 5 + 1).alias("scope_id"),
            pick("episodic", "semantic", "procedural").alias("kind"),
            pick("hard", "soft", "distilled", "soft").alias("provenance"),
            F.when(i % 11 == 0, "retired").when(i % 11 == 1, "quarantined").when(i % 11 == 2, "superseded").otherwise("active").alias("status"),
            F.when(i % 13 == 0, "compressed").when(i % 13 == 1, "archived").otherwise("active").alias("retention_stage"),
            F.col("ts").alias("valid_from"),
            F.when(i % 4 == 0, F.expr("ts + interval 3 days")).alias("valid_to"),
            F.col("ts").alias("observed_at"),
            F.when(i % 6 == 0, F.expr("ts + interval 7 days")).alias("expires_at"),
            F.concat(F.lit("s"), (F.col("user_id") % 50).cast("string")).alias("session_id"),
            (F.pmod(k, F.lit(101)) / 100.0).alias("salience"),
            F.col("value"),
            F.concat(F.lit("memory "), F.repeat(F.concat(F.col("event_type"), F.lit(" ")), (i % 7 + 1).cast("int")), F.col("props")).alias("content"),
            F.when(i % 9 != 0, F.array(F.concat(F.lit("doc"), (i % 100).cast("string")))).alias("evidence_refs"),
        )


def as_log(events: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "assert").when(F.col("event_type") == "purchase", "revise").when(F.col("event_type") == "error", "retract").otherwise("access")
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select("event_id", F.col("user_id").alias("aggregate_id"), (F.col("user_id") % 5 + 1).alias("scope_id"), kind.alias("kind"), "ts", "value", k.alias("k"))


#: CTEs that oracles share: the same entities in DuckDB's SQL.
CHUNKS = """chunks AS (
  SELECT doc_id, text, source, lang AS scope, n_chars, sid AS source_id, sid * 10 + doc_id % 3 + 1 AS version_id,
    CASE WHEN doc_id % 3 = 2 THEN CASE WHEN sid % 5 = 0 THEN 'draft' ELSE 'published' END ELSE 'superseded' END AS status
  FROM (SELECT *, substr(source, 4)::BIGINT AS sid FROM documents))"""
VERSIONS = CHUNKS + ", versions AS (SELECT DISTINCT version_id, source_id, status FROM chunks)"
LOG = """log AS (
  SELECT event_id, user_id AS aggregate_id, user_id % 5 + 1 AS scope_id,
    CASE event_type WHEN 'signup' THEN 'assert' WHEN 'purchase' THEN 'revise' WHEN 'error' THEN 'retract' ELSE 'access' END AS kind,
    ts, value, json_extract_string(props, '$.k')::INTEGER AS k FROM events)"""
ENTRIES = """entries AS (
  SELECT event_id AS memory_id, user_id % 5 + 1 AS scope_id, ['episodic', 'semantic', 'procedural'][event_id % 3 + 1] AS kind,
    ['hard', 'soft', 'distilled', 'soft'][event_id % 4 + 1] AS provenance,
    CASE event_id % 11 WHEN 0 THEN 'retired' WHEN 1 THEN 'quarantined' WHEN 2 THEN 'superseded' ELSE 'active' END AS status,
    CASE event_id % 13 WHEN 0 THEN 'compressed' WHEN 1 THEN 'archived' ELSE 'active' END AS retention_stage,
    ts AS valid_from, CASE WHEN event_id % 4 = 0 THEN ts + INTERVAL 3 DAY END AS valid_to, ts AS observed_at,
    CASE WHEN event_id % 6 = 0 THEN ts + INTERVAL 7 DAY END AS expires_at, 's' || (user_id % 50) AS session_id,
    (json_extract_string(props, '$.k')::INTEGER % 101) / 100.0::DOUBLE AS salience, value,
    'memory ' || repeat(event_type || ' ', (event_id % 7 + 1)::BIGINT) || props AS content,
    CASE WHEN event_id % 9 <> 0 THEN ['doc' || (event_id % 100)] END AS evidence_refs
  FROM events WHERE event_type IN ('signup', 'purchase'))"""
_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def sql_tokens(text: str = "text") -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '[a-z0-9_]+'), lambda x: x NOT IN ({_STOPS}))"


def sql_bm25(docs: str = "documents", key: str = "doc_id") -> str:
    """CTEs tok, size, tf, df, post (key, term, weight)."""
    return f"""tok AS (SELECT {key}, {sql_tokens()} AS t FROM {docs}),
size AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS avgdl FROM tok),
tf AS (SELECT {key}, len(t) AS dl, term, count(*) AS tf FROM (SELECT {key}, t, unnest(t) AS term FROM tok) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
post AS (SELECT {key}, term, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS weight
  FROM tf JOIN df USING (term), size)"""


NOW = "2024-01-20 00:00:00"
