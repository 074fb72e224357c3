"""Queries over the text tables: one thin query an operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terracause.llm.fingerprint import documents_report

    return documents_report(table(spark, sf_dir, "documents"))


def _tokenizer(name: str) -> str:
    import public_tokenizers

    from terracause.llm.vocab import read_tokenizer

    return read_tokenizer(public_tokenizers.path(name))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terracause.llm.tokenfile import documents_report

    return documents_report(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), end_id=2, vocabulary=50_257)


def op3_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terracause.llm.wordbpe import documents_report

    return documents_report(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


#: Tools that the calls below name, but for ``unlisted``.
TOOLS = {
    "search": {"text": ("string", True), "words": ("integer", False)},
    "translate": {"text": ("string", True), "words": ("integer", True)},
    "summarise": {"text": ("string", True), "words": ("integer", False)},
}


def calls_and_results(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every user turn as a tool call that depends on the user turn before, every assistant turn as the result of the turn before."""
    name = lambda back: F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn") - back)
    k, n = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4)), F.length("text")
    calls = turns.where("role = 'user'").select(
        "conv_id",
        "turn",
        name(0).alias("call_id"),
        name(2).alias("parent_id"),
        F.when(k == 0, "search").when(k == 1, "translate").when(k == 2, "summarise").otherwise("unlisted").alias("tool"),
        F.when(k == 0, F.to_json(F.struct("text", n.alias("words")))).when(k == 2, F.to_json(F.struct("text", n.cast("string").alias("words")))).otherwise(F.to_json(F.struct("text"))).alias("arguments"),
    )
    return calls, turns.where("role = 'assistant'").select("conv_id", "turn", name(1).alias("call_id"), F.col("text").alias("content"))


def other_turns(turns: DataFrame) -> DataFrame:
    """The turns of every other role, or of none: plain messages."""
    taken = F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False))
    return turns.where(~taken).select("conv_id", "turn", "role", F.col("text").alias("content"))


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terracause.llm.toolcalls import chat

    turns = table(spark, sf_dir, "conversations")
    return chat(*calls_and_results(turns), other_turns(turns), TOOLS)


OP4_SQL = """
WITH RECURSIVE calls AS (
  SELECT conv_id, turn, text, 'c' || conv_id || '-' || turn AS call_id, (conv_id + turn) % 4 AS k FROM conversations WHERE role = 'user'),
levels AS (
  SELECT conv_id, turn, 0 AS level FROM calls c WHERE NOT EXISTS (SELECT 1 FROM calls p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2)
  UNION ALL
  SELECT c.conv_id, c.turn, level + 1 FROM calls c JOIN levels l ON l.conv_id = c.conv_id AND l.turn = c.turn - 2),
results AS (SELECT conv_id, turn, text, 'c' || conv_id || '-' || (turn - 1) AS call_id FROM conversations WHERE role = 'assistant'),
answers AS (SELECT call_id, count(*) AS n FROM results GROUP BY call_id)
SELECT c.conv_id, c.turn, 0 AS kind, c.call_id, CAST(l.level AS BIGINT) AS level, coalesce(a.n, 0) AS answers, k = 0 AS valid,
       CASE k WHEN 0 THEN '' WHEN 1 THEN 'words: missing' WHEN 2 THEN 'words: not integer' ELSE 'unknown tool' END AS problems,
       '{"arguments":{"text":' || CAST(to_json(text) AS VARCHAR) || CASE k WHEN 0 THEN ',"words":' || length(text) WHEN 2 THEN ',"words":"' || length(text) || '"' ELSE '' END
       || '},"call_id":"' || c.call_id || '","name":"' || CASE k WHEN 0 THEN 'search' WHEN 1 THEN 'translate' WHEN 2 THEN 'summarise' ELSE 'unlisted' END || '","role":"assistant"}' AS json
FROM calls c JOIN levels l USING (conv_id, turn) LEFT JOIN answers a USING (call_id)
UNION ALL
SELECT r.conv_id, r.turn, 1, r.call_id, CAST(l.level AS BIGINT), CASE WHEN c.call_id IS NULL THEN 0 ELSE 1 END, c.call_id IS NOT NULL, CASE WHEN c.call_id IS NULL THEN 'no call' ELSE '' END,
       '{"call_id":"' || r.call_id || '","content":' || CAST(to_json(r.text) AS VARCHAR) || ',"role":"tool"}'
FROM results r LEFT JOIN calls c USING (call_id) LEFT JOIN levels l ON l.conv_id = c.conv_id AND l.turn = c.turn
UNION ALL
SELECT conv_id, turn, 2, NULL, NULL, 0, role IS NOT NULL, CASE WHEN role IS NULL THEN 'no role' ELSE '' END, '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}'
FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')
"""


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terracause.llm.vectortree import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terracause.llm.quality import documents_report

    return documents_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terracause.llm.language import documents_report

    return documents_report(table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terracause.llm.ngramjoin import near_groups

    return near_groups(table(spark, sf_dir, "documents"))


#: Production weights: units of each source in the mix.
MIX_UNITS = {f"src{i}": 1 + i % 4 for i in range(20)}
MIX_BLOCK = 16


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terracause.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents").select("doc_id", "source"), MIX_UNITS, MIX_BLOCK)


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terracause.llm.licences import scan

    return scan(table(spark, sf_dir, "documents"))


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terracause.llm.pivotindex import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terracause.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terracause.llm.spelling import variants

    return variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = [op1_fingerprints, op2_token_files, op3_word_bpe, op4_tool_calls, op5_neighbours, op6_quality, op7_ngram_join, op8_mixing, op9_licences, op10_language, op11_exact_top_k, op12_whitening, op13_spelling_variants]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from terracause.llm import licences, mixing, pivotindex

    return {"op4_tool_calls": OP4_SQL, "op8_mixing": mixing.oracle(MIX_UNITS, MIX_BLOCK), "op9_licences": licences.oracle(), "op11_exact_top_k": pivotindex.ORACLE}
