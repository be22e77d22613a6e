"""Exact dedup: 128-bit content hash, byte comparison inside groups, one stable row stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqspark.llm.common import documents, text_or_empty

WHITE = "[\\x20\\x09-\\x0D]+"

# One number ranks the rows of a group: more code points first, then the smaller id; a null id comes last.
_SHIFT = f"cast('{2**65}' as decimal(20,0))"
_TOP = f"cast('{2**63}' as decimal(20,0))"


def _rank() -> Column:
    place = f"coalesce({_TOP} - cast(doc_id as decimal(19,0)), 0)"
    return F.expr(f"cast(cast(char_length(text) as decimal(10,0)) * {_SHIFT} + {place} as decimal(38,0))")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of documents(doc_id, text).

    Texts are equal when identical without white space. The grouping key holds the 128-bit hash and the bytes
    themselves: the hash orders and partitions, the bytes are compared, so two texts with one hash stay apart. Equal
    texts fold into one row per task before the shuffle, so a text that fills a third of the table is no hot group.
    Rows find their group again by both digests (384 bits), without their text.

    Null text counts as empty, and all empty texts are one group. A null id can only stay if every id of its group is
    null. Of repeated rows with the same id and text exactly one is kept. Empty tables give empty results; columns
    other than doc_id and text are ignored, whatever their names.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    body = F.regexp_replace("text", WHITE, "")

    groups = (
        rows.select(body.alias("body"), _rank().alias("rank"))
        .select(F.md5("body").alias("hash"), "body", "rank")
        .groupBy("hash", "body")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max("rank").alias("best"))
        .select("hash", F.sha2("body", 256).alias("digest"), "group_size", "best")
    )
    keys = rows.select("doc_id", body.alias("body"), _rank().alias("rank")).select(
        "doc_id", F.md5("body").alias("hash"), F.sha2("body", 256).alias("digest"), "rank"
    )
    place = F.expr(f"best - cast(best div {_SHIFT} as decimal(10,0)) * {_SHIFT}")
    # Repeats of one row are numbered before the join, which then is free to split the rows of a large group.
    numbered = keys.withColumn("copy", F.row_number().over(Window.partitionBy("hash", "digest", "rank").orderBy("doc_id")))
    return (
        numbered.join(groups, ["hash", "digest"])
        .select(
            "doc_id",
            F.when(place > 0, (F.expr(_TOP) - place).cast("bigint")).alias("keep_id"),
            "group_size",
            ((F.col("rank") == F.col("best")) & (F.col("copy") == 1)).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )
    )


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup(documents(spark, sf_dir))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS b FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY b) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(b) AS text_sha256
FROM d
WINDOW w AS (PARTITION BY b ORDER BY length(t) DESC, doc_id NULLS LAST)
"""
