"""Corpus pipeline: raw documents to token ids, in five stages.

Each stage takes what the one before kept, written as Parquet, and gives documents with
the same columns; the last one gives the encoded documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracause.llm import language, mixing, ngramjoin, quality, wordbpe
from terracause.llm.queries import MIX_BLOCK, MIX_UNITS, _tokenizer, table
from terracause.llm.shared import cut, fresh, new_path

#: Documents scored below this are rejected.
QUALITY_THRESHOLD = 0.3
#: Documents whose best language has a smaller pooled probability, or that have no letters, are rejected.
LANGUAGE_THRESHOLD = 0.4


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: learnt from the labels of these documents; rejected ones go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    name = fresh(docs, "_score")
    return quality.score(docs, model, out=name).where(F.col(name) >= QUALITY_THRESHOLD).drop(name)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a language, or far from all, go."""
    name, sure = fresh(docs, "_lang"), fresh(docs, "_sure")
    said = language.identify(docs, language.fit(docs), name, sure)
    return said.where((F.col(name) != language.UNDETERMINED) & (F.col(sure) >= LANGUAGE_THRESHOLD)).drop(name, sure)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group the row with the smallest id stays.

    Rows are told apart by a number of their own, so one id may stand on several texts:
    exactly one row of each group stays, one with an id where the group has one. Rows
    without shingles are in no group; of those only repeats of both id and text go.
    """
    row = fresh(docs, "_row")
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = ngramjoin.near_groups(rows.select(F.col(row).alias("doc_id"), "text"))
    named = rows.select(F.col(row).alias("_row"), "doc_id", F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), "text").cast("binary")).alias("_text"))
    alone = (F.col("n_shingles") == 0) & F.col("doc_id").isNotNull()
    of = groups.withColumnRenamed("doc_id", "_row").join(named, "_row").select("_row", "doc_id", F.when(~alone, F.col("component_id")).alias("_group"), F.when(alone, F.col("_text")).alias("_text"))
    least = of.groupBy("_group", "_text").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("c"))
    return rows.join(least.select(F.col("c._row").alias(row)), row, "left_semi").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: all documents, in the order of the mix."""
    names = tuple(fresh(docs, f"_{n}") for n in mixing.NAMES)
    return mixing.mix(docs, MIX_UNITS, MIX_BLOCK, names).orderBy(names[2]).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding and decoding of every document, with its source and place in the mix: block, position, slot and on_target.

    A Parquet folder keeps no order over files, so the schedule is worked out over the
    documents as read. It goes by the contents of whole rows, as in the stage before, so every
    row gets the place that it had there, also one of many without an id or with the same;
    rows are told apart by a number of their own.
    """
    rows = cut(docs.select("doc_id", "source", "text", mixing.content_of(docs).alias("_content")).withColumn("_row", F.monotonically_increasing_id()), "encode")
    placed = mixing.mix(rows.select("doc_id", "source", "_content", "_row"), MIX_UNITS, MIX_BLOCK, content="_content")
    coded = wordbpe.documents_report(rows.select(F.col("_row").alias("doc_id"), "text"), _tokenizer("word_bpe_49k.json")).withColumnRenamed("doc_id", "_row")
    both = coded.join(placed, "_row")
    return both.select(F.col("doc_id").cast("long").alias("doc_id"), *[c for c in coded.columns if c != "_row"], "source", "block", "position", "slot", "on_target")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("language ID", keep_language),
    ("n-gram Jaccard join", keep_one_of_each),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: Two stages are learnt models, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"pipeline-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
