"""The query of each operator, with production parameters and over whole tables, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, chat, exact_dedup, langid, licenses, mixing, secrets, simhash, topk, toxicity
from tessella.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.identify(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "text", "copies_of_doc", "copy", "mix_key")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_chat(rows.unionByName(planted)), in_order=True)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs.where(~langid.held_out()), labels.where(~langid.held_out()).select("doc_id", "toxic"))
    return toxicity.score(docs, model).select("doc_id", langid.held_out().alias("held_out"), "score", "predicted")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.fit(docs))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language_id, op2_mix_sources, op3_chat_format, op4_bpe, op5_secrets, op6_toxicity, op7_simhash, op8_top_k, op9_licenses, op10_exact_dedup)
}


def _mix_sql() -> str:
    weights = {**mixing.WEIGHTS, mixing.REST: mixing.REST_WEIGHT}
    named = ", ".join(f"('{s}', CAST({w!r} AS DOUBLE))" for s, w in weights.items())
    return f"""
    WITH RECURSIVE target(class, weight) AS (VALUES {named}),
    docs AS (SELECT row_number() OVER () AS row, doc_id, source, text, coalesce(target.class, '{mixing.REST}') AS class,
             coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, '')) AS key FROM documents LEFT JOIN target ON target.class = source),
    counts AS (SELECT class, count(*) AS n FROM docs GROUP BY class),
    whole AS (SELECT count(*) AS goal FROM documents),
    share AS (SELECT sum(weight) AS total FROM target JOIN counts USING (class)),
    rate AS (SELECT class, weight / total * goal / n AS lam, CAST(ceil(weight / total * goal / n / {mixing.CHUNK}) AS BIGINT) AS chunks
             FROM target JOIN counts USING (class), whole, share),
    cdf(class, k, term, total) AS (
      SELECT class, 0, exp(-lam / chunks), exp(-lam / chunks) FROM rate
      UNION ALL
      SELECT c.class, c.k + 1, c.term * (lam / chunks / (c.k + 1)), c.total + c.term * (lam / chunks / (c.k + 1))
      FROM cdf c JOIN rate USING (class) WHERE c.k < {mixing.TERMS - 1}),
    drawn AS (
      SELECT row, doc_id, source, text, key, class, CAST('0x' || substr(md5('{mixing.SEED}:' || g.c || ':' || key), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
      FROM docs JOIN rate USING (class), range(1, 1000) g(c) WHERE g.c <= chunks),
    counted AS (
      SELECT any_value(d.doc_id) AS doc_id, any_value(d.source) AS source, any_value(d.text) AS text, any_value(d.key) AS key, CAST(count(c.k) AS INTEGER) AS copies_of_doc
      FROM drawn d JOIN cdf c ON c.class = d.class AND c.total <= d.u GROUP BY d.row)
    SELECT doc_id, source, text, copies_of_doc, CAST(g.c AS INTEGER) AS copy,
           CAST('0x' || substr(md5('{mixing.SEED}:order:' || g.c || ':' || key), 1, 15) AS BIGINT) AS mix_key
    FROM counted, range(1, 100000) g(c) WHERE g.c <= copies_of_doc"""


def _chat_sql() -> str:
    body, role = "coalesce(text, '')", "coalesce(role, '')"
    escaped = body
    for control, code in chat.CODES.items():
        escaped = f"replace({escaped}, '{control}', '{chat.ESC}{code}')"
        role = f"replace({role}, '{control}', '{chat.ESC}{code}')"
    role = f"replace({role}, chr(10), '{chat.ESC}n')"
    marks = len(chat.OPEN) + 1 + len(chat.CLOSE) + 1
    return f"""
    WITH said AS (
      SELECT conv_id, coalesce(role, '') AS role, {body} AS text, row_number() OVER (ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place FROM (
        SELECT conv_id, turn, role, text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'))
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
      CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
      CAST(sum(length({role}) + length({escaped}) + {marks}) AS BIGINT) AS formatted_chars
    FROM said GROUP BY conv_id"""


TOP_K_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256.0) AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.row <> q.row AND len(c.e) = len(q.e))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""

EXACT_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size,
  row_number() OVER w = 1 AS kept, sha AS text_sha256
FROM d WINDOW w AS (PARTITION BY sha ORDER BY n DESC, doc_id)"""

ORACLE_SQL = {"op2_mix_sources": _mix_sql(), "op3_chat_format": _chat_sql(), "op8_top_k": TOP_K_SQL, "op10_exact_dedup": EXACT_SQL}
