"""Benchmark decontamination: positional inverted index of the corpus, intersected from the rarest benchmark terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.llm.common import ascii_lower, documents, small_side, store, text_or_empty

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WINDOW = 10
ANCHORS = 3
#: Words that a near phrase may stand from their places, and words of it that may be missing.
SLOP = 3
MISSING = 1
#: Words of a text that are looked through at a time.
CHUNK = 1000


def words_of(text: Column) -> Column:
    """Words of ASCII letters, digits and all other characters, A-Z lower-cased; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def windows_of(benchmark: DataFrame, length: int = WINDOW) -> DataFrame:
    """window_id, words, items: distinct windows of `length` words; a shorter item is one window, one without words none."""
    n = F.size("words")
    starts = F.when(n >= length, F.sequence(F.lit(0), n - length)).when(n > 0, F.array(F.lit(0)))
    return (
        benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words"))
        .select("item", "words", F.explode(starts).alias("at"))
        .select("item", F.slice("words", F.col("at") + 1, length).alias("words"))
        .groupBy("words")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
        .select(F.md5(F.array_join("words", " ")).alias("window_id"), "words", "items")
    )


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_hash"), text.alias("text"))


def _terms_in(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (doc_id, text_hash, pos, term and the columns of `terms`) of the listed terms only."""
    each = _rows(docs).select("doc_id", "text_hash", F.posexplode(words_of(F.col("text"))).alias("pos", "term"))
    return each.join(terms, "term")


def anchor_terms(docs: DataFrame, windows: DataFrame, anchors: int = ANCHORS, whole: bool = True) -> DataFrame:
    """term, uses array<struct<window_id, offset, bit, all_bits>>: the rarest terms of each window by corpus count.

    With `whole`, a window with a term that the corpus does not hold cannot occur and has no anchors.
    """
    vocabulary = store(windows.select(F.explode("words").alias("term")).distinct(), "terms")
    counts = _terms_in(docs, small_side(vocabulary)).groupBy("term").count()
    placed = windows.select("window_id", F.posexplode("words").alias("offset", "term")).groupBy("window_id", "term").agg(
        F.min("offset").alias("offset")
    )
    ranked = (
        placed.join(counts, "term", "left")
        .groupBy("window_id")
        .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "term", "offset"))).alias("terms"))
        .select("window_id", F.slice("terms", 1, anchors).alias("terms"))
    )
    if whole:
        ranked = ranked.filter(F.col("terms")[0]["n"] > 0)
    use = ranked.select("window_id", F.size("terms").alias("n"), F.posexplode("terms").alias("nth", "t")).select(
        F.col("t.term").alias("term"),
        F.struct(
            "window_id",
            F.col("t.offset").alias("offset"),
            F.expr("shiftleft(1, nth)").alias("bit"),
            F.expr("shiftleft(1, n) - 1").alias("all_bits"),
        ).alias("use"),
    )
    return use.groupBy("term").agg(F.collect_list("use").alias("uses"))


def candidate_places(docs: DataFrame, windows: DataFrame, anchors: int = ANCHORS) -> DataFrame:
    """(doc_id, text_hash, window_id, start) where the posting lists of all anchors of a window meet at one start.

    The stored index holds the postings of anchor terms. The rarest term of each window proposes places; the next rarer
    ones are looked up at their offset from each place, so the longer lists are never repeated per window.
    """
    uses = store(anchor_terms(docs, windows, anchors), "anchors")
    ranks = uses.select("term", F.aggregate("uses", F.lit(0), lambda bits, u: bits.bitwiseOR(u["bit"])).alias("ranks"))
    postings = store(
        _terms_in(docs, small_side(ranks)).select("term", "doc_id", "text_hash", "pos", "ranks"), "postings"
    )
    use = store(uses.select("term", F.explode("uses").alias("use")).select("term", "use.*"), "uses")
    places = (
        postings.filter(F.col("ranks").bitwiseAND(1) > 0)
        .join(small_side(use.filter("bit = 1")), "term")
        .select("doc_id", "text_hash", "window_id", "all_bits", (F.col("pos") - F.col("offset")).alias("start"))
        .filter("start >= 0")
    )
    for nth in range(1, anchors):
        bit = 1 << nth
        step = use.filter(F.col("bit") == bit).select("window_id", F.col("term").alias("next"), F.col("offset").alias("ahead"))
        more = F.col("all_bits").bitwiseAND(bit) > 0
        index = postings.filter(F.col("ranks").bitwiseAND(bit) > 0).select(
            F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), F.col("term").alias("w"), F.col("pos").alias("p")
        )
        looked_up = (
            places.filter(more)
            .join(small_side(step), "window_id")
            .withColumn("there", F.col("start") + F.col("ahead"))
            .join(
                index,
                F.col("doc_id").eqNullSafe(F.col("d"))
                & (F.col("text_hash") == F.col("t"))
                & (F.col("next") == F.col("w"))
                & (F.col("there") == F.col("p")),
                "left_semi",
            )
            .select(*places.columns)
        )
        places = store(looked_up.union(places.filter(~more)), f"places-{nth}")
    return places.select("doc_id", "text_hash", "window_id", "start").distinct()


def phrase_matches(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW, anchors: int = ANCHORS) -> DataFrame:
    """Every column of docs plus _dc_n_words and _dc_hits array<struct<start, words, items>> (verified occurrences).

    Null text has no words, so no hit; an item without words has no window; items may repeat. A null item_id marks hits
    but cannot be named. Rows with the same doc_id and text get the same hits. Empty tables on either side give no hits.
    Only the benchmark, a stated query set, is broadcast, and only under a checked size; otherwise joins shuffle by term.
    """
    windows = store(windows_of(benchmark, length), "windows")
    places = candidate_places(docs, windows, anchors)
    found = store(
        places.join(small_side(windows), "window_id")
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_list(F.struct("start", "words", "items")).alias("places")),
        "places",
    )
    marks = small_side(found.select(F.struct("doc_id", "text_hash").alias("_dc_key"), F.col("places").alias("_dc_places")))
    key = F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_hash"))
    keyed = docs.withColumn("_dc_key", key)
    joined = keyed.join(marks, keyed["_dc_key"].eqNullSafe(marks["_dc_key"]), "left").drop("_dc_key")
    words = words_of(F.col("text").cast("string"))
    same = F.filter(
        F.col("_dc_places"), lambda p: F.slice(F.col("_dc_words"), p["start"] + 1, F.size(p["words"])) == p["words"]
    )
    return (
        joined.withColumn("_dc_words", words)
        .withColumns(
            {
                "_dc_n_words": F.size("_dc_words").cast("bigint"),
                "_dc_hits": F.when(F.col("_dc_places").isNotNull(), same),
            }
        )
        .drop("_dc_words", "_dc_places")
    )


def near_places(
    docs: DataFrame, windows: DataFrame, length: int = WINDOW, slop: int = SLOP, missing: int = MISSING
) -> DataFrame:
    """(doc_id, text_hash, window_id, starts): the starts around each place where two anchors of a window stand as near
    to each other as they can in a near phrase.

    Of the `missing` + 2 rarest distinct terms of a window at least two are left in any near phrase, so each near phrase
    is proposed. Both terms are in one text, so the words around each term are looked through in place and only pairs
    that meet are shuffled. Texts go in chunks of CHUNK words with the words around them.
    """
    uses = store(anchor_terms(docs, windows, missing + 2, whole=False), "near-anchors")
    use = uses.select("term", F.explode("uses").alias("u")).select("term", "u.window_id", "u.offset")
    other = use.select(F.col("window_id").alias("w"), F.col("term").alias("other"), F.col("offset").alias("o"))
    pairs = store(
        use.join(other, (F.col("window_id") == F.col("w")) & (F.col("offset") < F.col("o")))
        .groupBy("term", "other")
        .agg(F.collect_list(F.struct("window_id", "offset")).alias("uses"))
        .groupBy("term")
        .agg(F.collect_list(F.struct("other", "uses")).alias("partners")),
        "near-pairs",
    )
    before, after = 2 * slop - 1, length - 1 + 2 * slop
    rows = _rows(docs).select("doc_id", "text_hash", words_of(F.col("text")).alias("words")).filter(F.size("words") > 1)
    chunk = F.explode(
        F.transform(
            F.sequence(F.lit(0), F.size("words") - 1, F.lit(CHUNK)),
            lambda c: F.struct(
                c.alias("from"),
                F.least(F.size("words") - c, F.lit(CHUNK)).alias("own"),
                F.least(c, F.lit(before)).alias("lead"),
                F.slice("words", F.greatest(c - before, F.lit(0)) + 1, F.lit(CHUNK + before + after)).alias("words"),
            ),
        )
    )
    place = F.explode(
        F.transform(
            F.sequence(F.col("c.lead"), F.col("c.lead") + F.col("c.own") - 1),
            lambda i: F.struct(
                (F.col("c.from") - F.col("c.lead") + i).alias("pos"),
                F.get("c.words", i).alias("term"),
                F.slice("c.words", F.greatest(i - before, F.lit(0)) + 1, F.lit(before + after + 1)).alias("around"),
            ),
        )
    )
    meets = (
        rows.select("doc_id", "text_hash", chunk.alias("c"))
        .select("doc_id", "text_hash", place.alias("p"))
        .select("doc_id", "text_hash", "p.*")
        .join(small_side(pairs), "term")
        .withColumn("partners", F.filter("partners", lambda t: F.array_contains("around", t["other"])))
        .filter(F.size("partners") > 0)
        .select("doc_id", "text_hash", "pos", F.explode(F.flatten(F.transform("partners", lambda t: t["uses"]))).alias("u"))
    )
    around = F.flatten(F.transform("at", lambda s: F.sequence(s - slop, s + slop)))
    return (
        meets.groupBy("doc_id", "text_hash", "u.window_id")
        .agg(F.collect_set(F.col("pos") - F.col("u.offset")).alias("at"))
        .select("doc_id", "text_hash", "window_id", F.array_distinct(around).alias("starts"))
    )


def proximity_matches(
    docs: DataFrame, benchmark: DataFrame, length: int = WINDOW, slop: int = SLOP, missing: int = MISSING
) -> DataFrame:
    """Every column of docs plus _dc_near array<struct<start, missing, words, items>>: one entry per window of the
    benchmark that stands in the text nearly.

    A window of `length` words stands nearly at a start when all its words but `missing` stand within `slop` words of
    their places counted from there; all its words are compared. So up to `missing` words replaced or dropped and up to
    2 * slop words inserted in it are found, and small changes of order. `start` is that with the fewest words missing,
    then the smallest; it may lie up to `slop` words before the text. Items shorter than `length` and windows of fewer than
    `missing` + 2 distinct words are found exactly only (`phrase_matches`), as too little of them would be left.

    Null and empty texts and empty tables have no entries. Items may repeat; a null item_id gives an entry that names
    nobody. Rows with the same doc_id and text get the same entries; a null doc_id is an id like any other.
    """
    found = windows_of(benchmark, length)
    enough = (F.size("words") == length) & (F.size(F.array_distinct("words")) >= missing + 2)
    windows = store(found.filter(enough), "near-windows")
    places = store(
        near_places(docs, windows, length, slop, missing)
        .join(small_side(windows), "window_id")
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_list(F.struct("words", "items", "starts")).alias("places")),
        "near-places",
    )
    marks = small_side(places.select(F.struct("doc_id", "text_hash").alias("_dc_key"), F.col("places").alias("_dc_places")))
    key = F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_hash"))
    keyed = docs.withColumn("_dc_key", key)
    joined = keyed.join(marks, keyed["_dc_key"].eqNullSafe(marks["_dc_key"]), "left").drop("_dc_key")

    def absent(words: Column, start: Column) -> Column:
        """Words of the window that do not stand within the slop of their places."""

        def gone(word: Column, offset: Column) -> Column:
            low = F.greatest(start + offset - slop, F.lit(0))
            span = F.greatest(start + offset + slop - low + 1, F.lit(0))
            return ~F.array_contains(F.slice("_dc_words", low + 1, span), word)

        return F.size(F.filter(words, gone))

    def best(p: Column) -> Column:
        at = F.array_min(F.transform(p["starts"], lambda s: F.struct(absent(p["words"], s).alias("missing"), s.alias("start"))))
        return F.struct(at["start"].alias("start"), at["missing"].alias("missing"), p["words"].alias("words"), p["items"].alias("items"))

    near = F.filter(F.transform("_dc_places", best), lambda p: p["missing"] <= missing)
    return (
        joined.withColumn("_dc_words", F.when(F.col("_dc_places").isNotNull(), words_of(F.col("text").cast("string"))))
        .withColumn("_dc_near", F.coalesce(near, F.array().cast(_NEAR)))
        .drop("_dc_words", "_dc_places")
    )


_NEAR = "array<struct<start: int, missing: int, words: array<string>, items: array<string>>>"


def hit_words(hits: Column) -> Column:
    """Number of word positions inside any occurrence."""
    covered = F.array_distinct(
        F.flatten(F.transform(hits, lambda h: F.sequence(h["start"], h["start"] + F.size(h["words"]) - 1)))
    )
    return F.coalesce(F.size(F.when(hits.isNotNull() & (F.size(hits) > 0), covered).otherwise(F.array().cast("array<int>"))), F.lit(0))


def op6_decontaminate(spark, sf_dir):
    matched = phrase_matches(
        documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("_dc_hits", lambda h: h["items"]))))
    listed = matched.withColumn("items", F.coalesce(items, F.array().cast("array<string>"))).withColumn(
        "n_hit", hit_words(F.col("_dc_hits")).cast("bigint")
    )
    return listed.select(
        "doc_id",
        F.col("_dc_n_words").alias("n_words"),
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_near_phrases(spark, sf_dir):
    """Per document the benchmark windows that stand in it nearly, exact ones included, and their items."""
    found = proximity_matches(
        documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("_dc_near", lambda n: n["items"]))))
    return found.withColumn("items", items).select(
        "doc_id",
        F.size("_dc_near").cast("bigint").alias("n_windows"),
        F.size(F.filter("_dc_near", lambda n: n["missing"] > 0)).cast("bigint").alias("n_incomplete"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
    )


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, w, least(10, len(w)) AS n FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark)
  WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)
), places AS (
  SELECT rid, l.n, i, array_to_string(w[i:i + l.n - 1], ' ') AS phrase
  FROM (SELECT rid, w, l.n, unnest(range(1, len(w) - l.n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) l WHERE len(w) >= l.n) l
), hits AS (
  SELECT p.rid, p.i, p.n, win.item_id FROM places p JOIN win ON p.phrase = win.phrase AND p.n = win.n
), covered AS (
  SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS j FROM hits) GROUP BY rid
), named AS (
  SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS listed
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS s FROM hits WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)
"""
