"""The subpackage's registered queries: thin contracts over the operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvane.llm import ann, chat, decontaminate, exact_dedup, html_text, importance, langid, mixing, negatives, packing, quality, simhash, toxicity
from tallyvane.llm._common import fold
from tallyvane.llm.labelled import labelled_rows

#: Token shares of the mixing query: domains are the labelled classes of quality and toxicity.
MIX_WEIGHTS = {"q1t0": 0.90, "q1t1": 0.02, "q0t0": 0.07, "q0t1": 0.01}


def labelled_domain() -> Column:
    """q<quality>t<toxic>; null if either label is missing."""
    return F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = fold("doc_id", 5, 0)
    model = toxicity.fit_toxicity(docs, labelled_rows(docs, labels, ~held_out, ["toxic"], distinct=True))
    return toxicity.score_toxicity(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(_table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql("SELECT -7L AS conv_id, t AS turn, r AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.turn_digests(chat.format_conversations(rows))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _table(spark, sf_dir, "documents"), fold("doc_id", 5, 0)
    profiles = langid.learn_profiles(docs.where(~held_out))
    return langid.identify_languages(docs, profiles).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = fold("doc_id", 4, 2)
    model = quality.fit_quality(labelled_rows(docs, labels, ~held_out, ["quality"]))
    return quality.score_quality(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted")
    )


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    known = labelled_rows(docs, labels, F.lit(True), ["quality", "toxic"], bound=20_000)
    return mixing.mix(docs, known.select("text", labelled_domain().alias("domain")), MIX_WEIGHTS)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance_resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings"))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("items", ","), 256)
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def queries() -> dict:
    found = [
        op1_toxicity, op2_exact_dedup, op3_best_fit_packing, op4_simhash, op5_chat_format, op6_language_id, op7_html_text, op8_quality, op9_nearest, op10_mixing, op11_importance,
        op12_negatives, op13_decontaminate,
    ]
    return {f.__name__: f for f in found}


OP2_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, d.text_sha256 FROM d JOIN g ON d.text_sha256 = g.text_sha256
"""

OP5_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
k AS (
  SELECT *, len(regexp_extract_all(text, '\[/?INST\]|</?s>|<</?SYS>>|<</?ROLE>>|<<TEXT>>')) AS controls,
         length(text) - length(replace(text, chr(92), '')) AS slashes,
         regexp_matches(text, '\\[012]') AS marked,
         CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE 25 + length(role) END AS around FROM c),
g AS (SELECT conv_id, max(CASE WHEN controls > 0 OR marked THEN 1 ELSE 0 END) AS lvl FROM k GROUP BY conv_id)
SELECT k.conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(around + length(text) + lvl * (controls + slashes)) AS BIGINT) AS formatted_chars
FROM k JOIN g ON k.conv_id = g.conv_id GROUP BY k.conv_id
"""


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP11_SQL = f"""
WITH RECURSIVE remainder AS (
  SELECT i, i AS v, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM remainder WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM remainder WHERE k = 8),
d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS ws FROM documents),
dw AS MATERIALIZED (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM d) GROUP BY ALL),
bw AS MATERIALIZED (SELECT w, count(*) AS n FROM (SELECT unnest({_WORDS}) AS w FROM benchmark) GROUP BY w),
vocabulary AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
bytes AS (SELECT w, list_transform(range(1, length(h) // 2 + 1), lambda k: CAST((instr('0123456789ABCDEF', h[2 * k - 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * k]) - 1 AS BIGINT)) AS b FROM vocabulary),
hashed AS MATERIALIZED (SELECT w, xor(list_reduce(b, lambda s, x: xor(s >> 8, t[(xor(s, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM bytes, tab),
s AS (SELECT bucket, CAST(sum(n) AS DOUBLE) AS n FROM dw JOIN hashed ON dw.w = hashed.w GROUP BY bucket),
t AS (SELECT bucket, CAST(sum(n) AS DOUBLE) AS n FROM bw JOIN hashed ON bw.w = hashed.w GROUP BY bucket),
gain AS (
  SELECT b.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1) * ((SELECT sum(n) FROM s) + 10000) / ((coalesce(s.n, 0) + 1) * ((SELECT sum(n) FROM t) + 10000)))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT bucket FROM hashed) b LEFT JOIN s ON s.bucket = b.bucket LEFT JOIN t ON t.bucket = b.bucket),
summed AS (SELECT doc_id, sum(dw.n * gain) AS g FROM dw JOIN hashed ON dw.w = hashed.w JOIN gain ON gain.bucket = hashed.bucket GROUP BY doc_id),
weighed AS (
  SELECT d.doc_id, len(ws) AS n_features, CAST(CASE WHEN len(ws) = 0 THEN 0 ELSE (g - ((g % len(ws)) + len(ws)) % len(ws)) // len(ws) END AS BIGINT) AS weight,
         CAST(concat('0x', substr(sha256(concat('2024:', d.doc_id)), 1, 8)) AS BIGINT) AS h FROM d LEFT JOIN summed ON d.doc_id = summed.doc_id),
scored AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM weighed),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20)
SELECT scored.doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM ranked) THEN rank END AS rank FROM scored LEFT JOIN ranked ON scored.doc_id = ranked.doc_id
"""

OP12_SQL = """
WITH p AS MATERIALIZED (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
pairs AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM p a JOIN p b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positive AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT o.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY o.anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positive o JOIN pairs n ON o.anchor_id = n.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY o.anchor_id, positive_id ORDER BY score DESC, other) <= 5
"""

OP13_SQL = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
windows AS MATERIALIZED (
  SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[k : k + least(len(ws), 10) - 1], ' ') AS w FROM (SELECT *, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS k FROM b WHERE len(ws) > 0)),
d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS ws FROM documents),
places AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM windows) WHERE len(ws) >= n),
hits AS MATERIALIZED (SELECT doc_id, k, windows.n, item FROM (SELECT doc_id, k, n, array_to_string(ws[k : k + n - 1], ' ') AS w FROM places) p JOIN windows ON p.n = windows.n AND p.w = windows.w),
covered AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS x FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id LEFT JOIN named ON d.doc_id = named.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op5_chat_format": OP5_SQL, "op11_importance": OP11_SQL, "op12_negatives": OP12_SQL, "op13_decontaminate": OP13_SQL}
