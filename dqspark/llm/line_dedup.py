"""Line dedup: range-partitioned line hashes, first occurrences streamed, run-length keep bitmaps per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqspark.llm.common import SPACES, ascii_lower, documents, small_side, store, text_or_empty

MIN_CHARS = 40
MIN_DOCS = 5


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_refs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """key (128-bit), doc_id, text_hash, n_lines, pos of every line whose stripped form has min_chars or more."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    lines = rows.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), lines_of(F.col("text")).alias("lines")
    ).select("doc_id", "text_hash", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    return (
        lines.filter(F.char_length("line") >= min_chars)
        .withColumn("line", F.btrim("line", F.lit(SPACES)))
        .filter(F.char_length("line") >= min_chars)
        .select(F.unhex(F.md5(ascii_lower(F.col("line")))).alias("key"), "doc_id", "text_hash", "n_lines", "pos")
    )


def _runs(drops: Column, n_lines: Column) -> Column:
    """Alternating lengths of kept and dropped stretches, beginning with a kept one (length 0 is possible)."""
    edges = F.filter(
        F.transform(drops, lambda p, i: F.struct(p.alias("at"), F.get(drops, i - 1).alias("before"))),
        lambda e: e["before"].isNull() | (e["before"] < e["at"] - 1),
    )
    ends = F.filter(
        F.transform(drops, lambda p, i: F.struct((p + 1).alias("at"), F.get(drops, i + 1).alias("after"))),
        lambda e: e["after"].isNull() | (e["after"] > e["at"]),
    )
    bounds = F.flatten(F.zip_with(edges, ends, lambda a, b: F.array(a["at"], b["at"])))
    cuts = F.concat(F.array(F.lit(0)), bounds, F.array(n_lines))
    return F.transform(F.slice(cuts, 2, F.size(cuts) - 1), lambda x, i: x - F.get(cuts, i))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text_hash, n_lines, n_dropped, keep_runs of the documents that lose lines; the others keep all.

    A line is its stripped text in lower case (A-Z). Lines of min_chars code points or more that at least min_docs
    documents hold stay only in the largest doc_id holding them. keep_runs is the run-length form of the keep bitmap.

    Line hashes are range-partitioned by (hash, document), so one hash in a third of all documents spreads over many
    tasks, and a sorted stream gives each document's first occurrence. Those fold per task into (documents, largest id).
    """
    refs = store(line_refs(docs, min_chars), "line-refs")
    per_doc = Window.partitionBy("key", "doc_id").orderBy("pos")
    firsts = (
        refs.select("key", "doc_id", "pos")
        .repartitionByRange("key", "doc_id")
        .sortWithinPartitions("key", "doc_id", "pos")
        .withColumn("nth", F.row_number().over(per_doc))
        .filter("nth = 1")
    )
    # Stored, so that the join may split the lines of a frequent hash, or broadcast a list proven small.
    shared = store(
        firsts.groupBy("key")
        .agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("keeper"))
        .filter(F.col("docs") >= min_docs)
        .select("key", "keeper"),
        "shared-lines",
    )
    return (
        refs.join(small_side(shared), "key")
        .filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id", "text_hash", "n_lines")
        .agg(F.sort_array(F.collect_set("pos")).alias("drops"))
        .select(
            "doc_id", "text_hash", "n_lines", F.size("drops").alias("n_dropped"), _runs(F.col("drops"), F.col("n_lines")).alias("keep_runs")
        )
    )


def kept_text(text: Column, keep_runs: Column) -> Column:
    keep = F.flatten(F.transform(keep_runs, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    chosen = F.transform(
        F.filter(F.arrays_zip(lines_of(text).alias("line"), keep.alias("keep")), lambda x: x["keep"]), lambda x: x["line"]
    )
    return F.when(keep_runs.isNull(), text).otherwise(F.array_join(chosen, "\n"))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Every column of docs plus n_lines, n_dropped and kept_text (as _ld_n_lines, _ld_n_dropped, _ld_text).

    Null and empty texts are one empty line. A null doc_id counts as one document below all others. Rows that repeat a
    doc_id count as one document; each keeps its own lines. Empty tables give empty results; further columns pass
    through unread, unless they are named like the three new ones.
    """
    found = store(keep_bitmaps(docs, min_chars, min_docs), "keep-bitmaps")
    marks = small_side(found.select(F.struct("doc_id", "text_hash").alias("_ld_key"), F.struct("n_dropped", "keep_runs").alias("_ld")))
    text = text_or_empty()
    keyed = docs.withColumn("_ld_key", F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash")))
    joined = keyed.join(marks, keyed["_ld_key"].eqNullSafe(marks["_ld_key"]), "left").drop("_ld_key")
    return joined.withColumns(
        {
            "_ld_n_lines": F.size(lines_of(text)),
            "_ld_n_dropped": F.coalesce(F.col("_ld.n_dropped"), F.lit(0)),
            "_ld_text": kept_text(text, F.col("_ld.keep_runs")),
        }
    ).drop("_ld")


def op7_line_dedup(spark, sf_dir):
    return line_dedup(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id",
        F.col("_ld_n_lines").cast("bigint").alias("n_lines"),
        F.col("_ld_n_dropped").cast("bigint").alias("n_dropped"),
        F.sha2("_ld_text", 256).alias("kept_sha256"),
    )


SQL = r"""
WITH lines AS (
  SELECT rid, doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT rid, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
        FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), shared AS (
  SELECT k, max(doc_id) AS keeper FROM (SELECT DISTINCT k, doc_id FROM lines WHERE length(k) >= 40)
  GROUP BY k HAVING count(*) >= 5
), marked AS (
  SELECT l.*, s.k IS NOT NULL AND l.doc_id IS DISTINCT FROM s.keeper AS dropped FROM lines l LEFT JOIN shared s ON l.k = s.k
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY rid
"""
