"""Corpus cleaning as a chain of stages, each written as Parquet and reread as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqspark.llm.common import documents, small_side, store
from dqspark.llm.decontaminate import phrase_matches
from dqspark.llm.jaccard_join import spare_copies
from dqspark.llm.language_id import UNKNOWN, identify
from dqspark.llm.line_dedup import line_dedup as dedup_lines
from dqspark.llm.packing import pack_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Share of the way from chance to certainty under which a prediction counts as none, whatever the number of languages.
#: Short clean texts reach it; signs that no language was learned from do not.
MIN_MARGIN = 0.15


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of no language by MIN_MARGIN more than chance, go. Nulls count as without letters."""
    judged = identify(docs.select(*COLUMNS))
    return judged.filter((F.col("_lid.lang_pred") != UNKNOWN) & (F.col("_lid.margin") >= MIN_MARGIN)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shared long lines stay in one document; the texts of the others lose them, and n_chars follows."""
    return (
        dedup_lines(docs.select(*COLUMNS))
        .withColumn("text", F.when(F.col("text").isNotNull(), F.col("_ld_text")))
        .withColumn("n_chars", F.char_length("text").cast("bigint"))
        .select(*COLUMNS)
    )


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a similarity of 0.8 on five-word shingles the smallest id stays; null ids all stay.

    Rows that repeat an id are judged by (doc_id, text): each group keeps one row, and a repeated (doc_id, text) stays once.
    """
    found = spare_copies(docs.select("doc_id", "text"))
    keyed = docs.select(*COLUMNS, F.xxhash64(F.col("text").cast("string")).alias("_hash"))
    id_, hash_ = F.col("doc_id").cast("bigint"), F.col("_hash")

    def named(spare):
        return (id_ == F.col("gone_id")) & (hash_ == F.col("gone_hash")), small_side(spare)

    spare = found.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), "gone")
    on, names = named(store(spare.drop("gone"), "near-copies"))
    once, repeats = named(store(spare.filter("not gone").drop("gone"), "repeated-rows"))
    first = keyed.join(repeats, once, "left_semi").groupBy("doc_id", "_hash").agg(F.min(F.struct(*COLUMNS)).alias("row"))
    return keyed.join(names, on, "left_anti").select(*COLUMNS).unionByName(first.select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    matched = phrase_matches(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return matched.filter(F.coalesce(F.size("_dc_hits"), F.lit(0)) <= 0).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, packed into sequences of 2048."""
    return pack_documents(docs.select("doc_id", "text"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

# Language identification is a trained model, which SQL cannot express; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
