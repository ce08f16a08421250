"""The queries of this subpackage and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, lmscore, merkle, suffix_dedup
from .classifier import held_out, trained
from .classifier import scored as quality_scored
from .decontamination import contamination
from .hard_negatives import hard_negatives
from .htmltext import extracted
from .mixing import mix
from .ngram_join import jaccard_components
from .preferences import paired
from .runtime import table
from .sharding import shard
from .topk import top_k


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, 3-word shingles, links at Jaccard 90/100."""
    return jaccard_components(table(spark, sf_dir, "documents"), 3, 90, 100)


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 20 by integer inner product for the vectors whose id is divisible by 20, against all others."""
    return top_k(table(spark, sf_dir, "embeddings"), 20, 20, 64)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document, the shards that they go to, and their places in the shards' shuffle."""
    out = mix(table(spark, sf_dir, "documents"))
    place = lambda x: (x["place"] * 2.0**52).cast("long")  # noqa: E731  a whole number of 52 bits
    shards = F.concat_ws(";", F.transform("pieces", lambda x: F.concat_ws(":", *[c.cast("string") for c in (x["shard"], x["pass"], x["start"], x["words"], place(x))])))
    return out.select("doc_id", "size", "source_size", "target", "taken", shards.alias("pieces"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extracted(table(spark, sf_dir, "pages"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = trained(docs, table(spark, sf_dir, "labels"))
    return quality_scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, with the items and the fewest edits."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and masked completions of each pair of conversations."""
    out = paired(table(spark, sf_dir, "conversations"))
    spans = {c: F.concat_ws(",", F.transform(c, lambda x: F.concat(x["begin"].cast("string"), F.lit("-"), x["finish"].cast("string")))) for c in ("chosen_mask", "rejected_mask")}
    return out.withColumns(spans)


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the 50-byte strings that start in earlier ones."""
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff score of every document by counts over all documents."""
    return lmscore.scored(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 23 over virtual slots, by bytes."""
    return shard(table(spark, sf_dir, "documents"))


def op11_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the anchors whose id is divisible by 50; every seventh id has the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), label=label)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document; of each seventh the claim is tampered with."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)
    out = merkle.proofs(merkle.document_leaves(docs, tampered))
    proof = F.sha2(F.array_join("siblings", ""), 256)
    return out.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by word_bpe_49k.json, and the text that they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    ids = bpe.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return bpe.digests(bpe.decoded(ids, path))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_exact_top_k, op3_source_mixing, op4_html_extraction, op5_quality_classifier, op6_benchmark_decontamination,
        op7_preference_formatting, op8_suffix_array_dedup, op9_lm_scoring, op10_sharding,
        op11_hard_negative_mining, op12_merkle_manifest, op13_bpe_encoding, pipeline,
    )
}

#: A level of the splitting tree over 16 shards.
_LEVEL = """n{now} AS (
  SELECT source, name, pos, CASE WHEN drawn <= share THEN lo ELSE lo + (hi - lo) // 2 END AS lo, CASE WHEN drawn <= share THEN lo + (hi - lo) // 2 ELSE hi END AS hi FROM (
    SELECT *, row_number() OVER (PARTITION BY lo, hi ORDER BY md5('17:' || lo || ':' || hi || ':' || name || ':' || pos), source, pos) AS drawn,
      floor(count(*) OVER (PARTITION BY lo, hi) * ((hi - lo) // 2) / (hi - lo)::DOUBLE + ('0x' || substr(md5('17:' || lo || ':' || hi), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE) AS share FROM n{was})),
"""

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
sized AS (SELECT doc_id, s, len(s)::BIGINT AS n FROM sets),
flat AS (SELECT doc_id, n, unnest(s) AS g FROM sized),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id AND a.n * 100 >= b.n * 90 AND b.n * 100 >= a.n * 90
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
edges AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach(doc_id, seen) AS (SELECT doc_id, doc_id FROM sized UNION SELECT r.doc_id, e.y FROM reach r JOIN edges e ON e.x = r.seen)
SELECT s.doc_id, s.n AS n_shingles, min(r.seen) AS component_id FROM sized s JOIN reach r USING (doc_id) GROUP BY s.doc_id, s.n
""",
    "op2_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op3_source_mixing": """
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 2.0::DOUBLE * source_size AS most, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight FROM s),
fill(source, source_size, most, weight, target, step) AS (
  SELECT source, source_size, most, weight, 0::DOUBLE, 0 FROM w
  UNION ALL
  SELECT source, source_size, most, weight,
    CASE WHEN step > 0 AND target >= most THEN most ELSE
      (sum(source_size) OVER () * 1.5::DOUBLE - sum(CASE WHEN step > 0 AND target >= most THEN most ELSE 0 END) OVER ())
        * weight / sum(CASE WHEN step > 0 AND target >= most THEN 0 ELSE weight END) OVER () END, step + 1
  FROM fill WHERE step < 60),
t AS (
  SELECT source, source_size, least(target, most) AS target, floor(least(target, most) + 0.5)::BIGINT AS quota, coalesce('=' || source, '~') AS name,
    greatest(1, ceil(sum(floor(least(target, most) + 0.5)::BIGINT) OVER () / 4096.0))::BIGINT AS block FROM fill WHERE step = 60),
i AS (SELECT *, unnest(range(0, greatest(1, ceil(source_size / block::DOUBLE))::BIGINT)) AS i FROM t),
p AS (SELECT *, least(block, source_size - i * block) AS words, unnest(range(0, greatest(1, ceil(quota / greatest(source_size, 1)::DOUBLE))::BIGINT)) AS pass FROM i),
k AS (SELECT *, md5('17:block:' || name || ':' || pass || ':' || i) AS key FROM p),
o AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY pass, key, i) - 1 AS pos,
    coalesce(sum(words) OVER (PARTITION BY source ORDER BY pass, key, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM k),
b AS (SELECT source, name, i, pass, pos, block, least(words, quota - before) AS take FROM o WHERE least(words, quota - before) > 0),
n0 AS (SELECT source, name, pos, 0 AS lo, 16 AS hi FROM b),
"""
    + "".join(_LEVEL.format(now=i + 1, was=i) for i in range(4))
    + """h AS (SELECT source, lo AS shard, row_number() OVER (PARTITION BY source ORDER BY lo) - 1 AS pos FROM n4),
q AS (SELECT b.*, h.shard FROM b JOIN h ON h.source IS NOT DISTINCT FROM b.source AND h.pos = b.pos),
l AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('17:' || d.doc_id), d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (
  SELECT l.doc_id, q.shard, q.pass, greatest(l.at, q.i * q.block) - l.at AS start, least(l.at + l.size, q.i * q.block + q.take) - greatest(l.at, q.i * q.block) AS words,
    ('0x' || substr(md5('17:place:' || q.shard || ':' || l.doc_id || ':' || q.pass || ':' || q.i), 1, 13))::BIGINT AS place
  FROM l JOIN q ON q.source IS NOT DISTINCT FROM l.source AND l.at < q.i * q.block + q.take AND l.at + l.size > q.i * q.block),
y AS (SELECT doc_id, sum(words)::BIGINT AS taken, string_agg(shard || ':' || pass || ':' || start || ':' || words || ':' || place, ';' ORDER BY shard, pass, start) AS pieces FROM x GROUP BY doc_id)
SELECT l.doc_id, l.size, l.source_size, l.target, coalesce(y.taken, 0) AS taken, coalesce(y.pieces, '') AS pieces FROM l LEFT JOIN y USING (doc_id)
""",
    "op7_preference_formatting": """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn, role, text) AS turns FROM t GROUP BY conv_id),
p AS (SELECT a.conv_id // 2 AS pair_id, a.conv_id AS chosen_id, b.conv_id AS rejected_id, a.turns AS c, b.turns AS r FROM c a JOIN c b ON b.conv_id = a.conv_id + 1 WHERE a.conv_id % 2 = 0),
n AS (
  SELECT *, least(len(c) - 1, len(r) - 1, coalesce(list_min(list_filter(range(0, greatest(len(c), len(r))::BIGINT), lambda i: c[i + 1] IS DISTINCT FROM r[i + 1])), len(c)))::INTEGER AS k FROM p),
x AS (
  SELECT pair_id, chosen_id, rejected_id, k AS prompt_turns,
    list_transform(c, lambda z: '<|' || z.role || '|>' || chr(10) || z.text || '<|end|>' || chr(10)) AS cs,
    list_transform(r, lambda z: '<|' || z.role || '|>' || chr(10) || z.text || '<|end|>' || chr(10)) AS rs, c, r, k FROM n)
SELECT pair_id, chosen_id, rejected_id, prompt_turns,
  array_to_string(cs[1:k], '') AS prompt, array_to_string(cs[k + 1:], '') AS chosen, array_to_string(rs[k + 1:], '') AS rejected,
  array_to_string(list_transform(list_filter(range(k + 1, len(cs) + 1), lambda i: c[i].role = 'assistant'),
    lambda i: (length(array_to_string(cs[k + 1:i - 1], '')) + length(c[i].role) + 5) || '-' || length(array_to_string(cs[k + 1:i], ''))), ',') AS chosen_mask,
  array_to_string(list_transform(list_filter(range(k + 1, len(rs) + 1), lambda i: r[i].role = 'assistant'),
    lambda i: (length(array_to_string(rs[k + 1:i - 1], '')) + length(r[i].role) + 5) || '-' || length(array_to_string(rs[k + 1:i], ''))), ',') AS rejected_mask
FROM x
""",
    "op8_suffix_array_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
o AS (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49, 200)) AS o FROM d),
y AS (SELECT doc_id, o, substr(x, 2 * o + 1, 498) AS y FROM o),
g AS (SELECT doc_id, o, y, unnest(range(0, least(200, length(y) // 2 - 49))) AS j FROM y),
m AS (SELECT doc_id, o + j AS i, min(doc_id) OVER (PARTITION BY substr(y, 2 * j + 1, 100)) AS first FROM g),
r AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END AS new FROM m WHERE first < doc_id),
k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM r),
s AS (SELECT doc_id, min(i) AS b, max(i) + 50 AS e FROM k GROUP BY doc_id, run),
p AS (SELECT doc_id, e AS b, lead(b) OVER (PARTITION BY doc_id ORDER BY b) AS e FROM (SELECT doc_id, b, e FROM s UNION ALL SELECT doc_id, -1, 0 FROM d)),
t AS (SELECT p.doc_id, string_agg(substr(x, (2 * p.b + 1)::BIGINT, (2 * (coalesce(p.e, length(x) // 2) - p.b))::BIGINT), '' ORDER BY p.b) AS kept FROM p JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id),
c AS (SELECT doc_id, sum(e - b)::BIGINT AS removed, count(*) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, length(x) // 2 AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN t ON t.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
""",
    "op9_lm_scoring": """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS w, unnest([NULL] || w[1:len(w) - 1]) AS v, unnest(([NULL, NULL] || w)[1:len(w)]) AS u FROM w WHERE len(w) > 0),
c1 AS (SELECT w, count(*) AS c FROM t GROUP BY w),
c2 AS (SELECT v, w, count(*) AS c, sum(count(*)) OVER (PARTITION BY v) AS h FROM t WHERE v IS NOT NULL GROUP BY v, w),
c3 AS (SELECT u, v, w, count(*) AS c, sum(count(*)) OVER (PARTITION BY u, v) AS h FROM t WHERE u IS NOT NULL GROUP BY u, v, w),
s AS (
  SELECT t.doc_id, CASE WHEN c3.c > 1 THEN log10((c3.c - 1) / (c3.h - 1))
    ELSE CASE WHEN t.u IS NULL THEN 0 ELSE log10(0.4::DOUBLE) END + CASE WHEN c2.c > 1 THEN log10((c2.c - 1) / (c2.h - 1))
    ELSE CASE WHEN t.v IS NULL THEN 0 ELSE log10(0.4::DOUBLE) END + log10(c1.c / (SELECT count(*) FROM t)) END END AS x
  FROM t JOIN c1 ON c1.w = t.w LEFT JOIN c2 ON c2.v = t.v AND c2.w = t.w LEFT JOIN c3 ON c3.u = t.u AND c3.v = t.v AND c3.w = t.w),
a AS (SELECT doc_id, count(*) AS n, sum(x) AS x FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(a.n, 0)::BIGINT AS n_words, round(coalesce(a.x, 0), 6) AS log_score, round(a.x / a.n, 6) AS mean_score FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN a USING (doc_id)
""",
    "op10_sharding": """
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
d AS (
  SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 8 AS size, hex(encode(coalesce(text, ''))) AS x,
    (('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 4096)::INTEGER AS vslot FROM documents),
k AS (
  SELECT doc_id, size, vslot, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(x, '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS text_crc32 FROM d, crc),
v AS (SELECT vslot, count(*) AS n, sum(size)::BIGINT AS bytes FROM d GROUP BY vslot),
o AS (SELECT *, row_number() OVER (ORDER BY bytes DESC, vslot) AS step FROM v),
p(step, vslot, shard, loads) AS (
  SELECT 0::BIGINT, -1, -1::BIGINT, list_transform(range(24), lambda i: 0::BIGINT)
  UNION ALL
  SELECT o.step, o.vslot, list_position(loads, list_min(loads)) - 1,
    list_transform(loads, lambda z, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN z + o.bytes ELSE z END)
  FROM p JOIN o ON o.step = p.step + 1),
m AS (SELECT p.vslot, p.shard::INTEGER AS shard, sum(v.n) OVER (PARTITION BY p.shard ORDER BY p.vslot) - v.n AS first FROM p JOIN v ON v.vslot = p.vslot)
SELECT k.doc_id, k.size, k.text_crc32, 'bytes' AS law, m.shard, (m.first + row_number() OVER (PARTITION BY k.vslot ORDER BY k.doc_id, k.text_crc32, k.size) - 1)::BIGINT AS slot,
  NULL::INTEGER AS grown_shard, k.vslot FROM k JOIN m ON m.vslot = k.vslot
""",
    "op11_hard_negative_mining": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_sum(list_transform(list_zip(a.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a, v c WHERE a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id),
s AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT s.*, p.vec_id AS negative_id, p.score AS negative_score, row_number() OVER (PARTITION BY s.anchor_id, s.positive_id ORDER BY p.score DESC, p.vec_id)::INTEGER AS rank
  FROM s JOIN p ON p.anchor_id = s.anchor_id AND NOT p.same AND 50 * s.positive_score <= 100 * p.score AND 100 * p.score <= 95 * s.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
""",
    "op12_merkle_manifest": """
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
x AS (
  SELECT doc_id, lang, n_chars, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % 7 = 0 AS tampered
  FROM documents, crc),
l AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen((n_chars + tampered::BIGINT)::VARCHAR) || ':' || (n_chars + tampered::BIGINT), '-') || tail) AS claim FROM x),
i AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l),
up(lang, level, a) AS (
  SELECT lang, 0, list(leaf ORDER BY i) FROM i GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range(1, len(a) + 1, 2), lambda j: sha256(a[j] || coalesce(a[j + 1], ''))) FROM up WHERE len(a) > 1),
g AS (SELECT lang, a[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM up WHERE len(a) = 1),
top(level, a) AS (
  SELECT 0, list(subroot ORDER BY i) FROM g
  UNION ALL
  SELECT level + 1, list_transform(range(1, len(a) + 1, 2), lambda j: sha256(a[j] || coalesce(a[j + 1], ''))) FROM top WHERE len(a) > 1),
s AS (
  SELECT i.lang, i.i, list(CASE WHEN (i.i >> level) % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(a[xor(i.i >> level, 1) + 1], '') ORDER BY level) AS s
  FROM i JOIN up ON up.lang IS NOT DISTINCT FROM i.lang AND len(a) > 1 GROUP BY i.lang, i.i),
z AS (SELECT g.lang, list(CASE WHEN (g.i >> level) % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(a[xor(g.i >> level, 1) + 1], '') ORDER BY level) AS s FROM g JOIN top ON len(a) > 1 GROUP BY g.lang),
p AS (
  SELECT i.doc_id, i.leaf, i.claim, g.subroot, list_concat(coalesce(s.s, []), coalesce(z.s, [])) AS s FROM i JOIN g ON g.lang IS NOT DISTINCT FROM i.lang
  LEFT JOIN s ON s.lang IS NOT DISTINCT FROM i.lang AND s.i = i.i LEFT JOIN z ON z.lang IS NOT DISTINCT FROM i.lang),
f AS (
  SELECT *, (SELECT a[1] FROM top WHERE len(a) = 1) AS root, sha256(array_to_string(list_transform(s, lambda x: x[2:]), '')) AS proof_sha256,
    list_reduce(list_prepend(claim, s), lambda c, x: sha256(CASE WHEN x[1] = 'L' THEN x[2:] || c ELSE c || x[2:] END)) AS folded_root FROM p)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM f
""",
}
