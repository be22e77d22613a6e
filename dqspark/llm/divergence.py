"""Source divergence audit: how far each source's wording lies from its language's other sources, exact and over all terms.

Pairs of sources are compared over a whole vocabulary, most of which each source lacks. A frequent-pattern tree of term rows
makes that cheap: a term's row lists its sources in a fixed order with their probabilities, equal rows are one row with a
multiplicity, and rows with a common beginning share a path. A pair's sum starts from "both lack every term"; each class of
counts corrects it for one source that has the term, and each node of the tree, with each of its ancestors, once for both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dqspark.llm.common import ascii_lower, documents, store, text_or_empty

# Fixed values of the measure.
UNIT = 1_000_000_000
PRIOR = 2
MIN_DOCS = 10
TOP_TERMS = 10

NOT_TERM = "[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Path entries of one tree; a task builds as many trees as its rows need, one after the other.
TREE_ITEMS = 200_000
#: Parts that the sources of a language are dealt to where each meets all others.
SALTS = 32


def _p(count: str, total: str) -> str:
    """Smoothed share in units; decimal, as a count times UNIT may pass 64 bits."""
    return f"1 + ((cast({count} as decimal(20,0)) + {PRIOR}) * {UNIT}) div nullif({total} + {PRIOR} * v, 0)"


def _f(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})"


def kept_terms(docs: DataFrame, min_docs: int) -> DataFrame:
    """lang, source, term, n, n_lang of the terms in at least min_docs rows of their language."""
    words = F.array_remove(F.split(ascii_lower(text_or_empty()), NOT_TERM), "")
    # One pass gives occurrences (the words) and documents (the distinct words behind them).
    each = docs.select(text_or_empty("lang").alias("lang"), text_or_empty("source").alias("source"), words.alias("words")).select(
        "lang", "source", F.size("words").alias("size"), F.posexplode(F.concat("words", F.array_distinct("words"))).alias("at", "term")
    )
    counts = each.groupBy("lang", "source", "term").agg(
        F.count_if(F.col("at") < F.col("size")).alias("n"), F.count_if(F.col("at") >= F.col("size")).alias("docs")
    )
    # A window holds a row per source of one term.
    of_term = Window.partitionBy("lang", "term")
    summed = counts.withColumns({"n_lang": F.sum("n").over(of_term), "docs_lang": F.sum("docs").over(of_term)})
    return store(summed.filter(F.col("docs_lang") >= min_docs).drop("docs", "docs_lang"), "kept-terms")


def groups_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, place, n_all, n_lang_all, v, p0: one row per occurring group; sources with more terms come first."""
    occurring = docs.select(text_or_empty("lang").alias("lang"), text_or_empty("source").alias("source")).distinct()
    by_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_all"), F.count(F.lit(1)).alias("terms"))
    by_lang = (
        kept.groupBy("lang", "term")
        .agg(F.max("n_lang").alias("n"))
        .groupBy("lang")
        .agg(F.sum("n").alias("n_lang_all"), F.count(F.lit(1)).alias("v"))
    )
    full = occurring.join(by_source, ["lang", "source"], "left").join(by_lang, "lang", "left").na.fill(0)
    order = Window.partitionBy("lang").orderBy(F.desc("terms"), "source")
    return store(
        full.select("lang", "source", F.row_number().over(order).alias("place"), "n_all", "n_lang_all", "v", F.expr(_p("0", "n_all")).alias("p0")),
        "groups",
    )


class Tree:
    """Nodes of sorted rows as arrays: a node per distinct beginning, its multiplicity, and its parent (-1 at the top)."""

    def __init__(self, lang: np.ndarray, lengths: np.ndarray, times: np.ndarray, place: np.ndarray, p: np.ndarray, p0: np.ndarray):
        row = np.repeat(np.arange(len(lengths)), lengths)
        begin = np.cumsum(lengths) - lengths
        depth = np.arange(len(place)) - begin[row]
        # Entries that repeat the row before at the same depth, up to the first that does not.
        above = begin[row - 1] + depth
        known = (row > 0) & (depth < lengths[row - 1]) & (lang[row] == lang[row - 1])
        above[~known] = 0
        same = known & (place == place[above]) & (p == p[above])
        shared = np.minimum.reduceat(np.where(same, lengths[row], depth), begin)
        fresh = depth >= shared[row]
        # At each depth an entry belongs to the last fresh one.
        order = np.argsort(depth, kind="stable")
        last = np.maximum.accumulate(np.where(fresh[order], np.arange(len(order)), 0))
        node = np.empty(len(order), np.int64)
        node[order] = np.cumsum(fresh[order])[last] - 1
        starts = np.flatnonzero(fresh[order])
        self.times = np.add.reduceat(times[row][order], starts)
        first = order[starts]
        self.lang, self.place, self.p, self.p0 = lang[row][first], place[first], p[first], p0[first]
        self.parent = np.where(depth[first] > 0, node[first - 1], -1)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """lang, place of the ancestor, place of the node, correction: each node with each ancestor, one level at a time."""

        def f(a, b):
            return (a - b) * (a - b) // (a + b)

        at, up = np.arange(len(self.parent)), self.parent
        while True:
            at, up = at[up >= 0], up[up >= 0]
            if not len(at):
                return
            p, p0, q, q0 = self.p[at], self.p0[at], self.p[up], self.p0[up]
            yield self.lang[at], self.place[up], self.place[at], self.times[at] * (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0))
            up = self.parent[up]


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    lang, a, b, value = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((b, a, lang))
    lang, a, b, value = lang[order], a[order], b[order], value[order]
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(lang) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)]))
    return lang[starts], a[starts], b[starts], np.add.reduceat(value, starts)


def _slices(batch: pa.RecordBatch, items: int) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(batch.column("path").value_lengths().to_numpy(zero_copy_only=False))
    begin = 0
    while begin < batch.num_rows:
        held = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, held + items, side="right")))
        yield batch.slice(begin, stop - begin)
        begin = stop


def shared_terms(items: DataFrame) -> DataFrame:
    """lang, a, b, value: corrections for terms that both sources have, a before b, from trees over distinct rows."""
    paths = (
        items.groupBy("lang", "term")
        .agg(F.sort_array(F.collect_list(F.struct("place", "p", "p0"))).alias("path"))
        .groupBy("lang", "path")
        .agg(F.count(F.lit(1)).alias("times"))
        .filter(F.size("path") > 1)
    )
    # Rows in order of their paths: those with a common beginning meet in one task, whatever their number.
    ordered = store(paths, "term-rows").repartitionByRange("lang", "path").sortWithinPartitions("lang", "path")

    def run(batches):
        for batch in batches:
            for part in _slices(batch, TREE_ITEMS):
                langs = part.column("lang").dictionary_encode()
                path = part.column("path")
                entry = path.flatten()
                tree = Tree(
                    langs.indices.to_numpy().astype(np.int64),
                    path.value_lengths().to_numpy().astype(np.int64),
                    part.column("times").to_numpy(),
                    *(entry.field(c).to_numpy().astype(np.int64) for c in ("place", "p", "p0")),
                )
                found, held = [], 0
                for level in tree.pairs():
                    found.append(level)
                    held += len(level[0])
                    if held > 10 * TREE_ITEMS:
                        found = [_summed(found)]
                        held = len(found[0][0])
                if found:
                    lang, a, b, value = _summed(found)
                    yield pa.RecordBatch.from_arrays(
                        [langs.dictionary.take(pa.array(lang)), pa.array(a), pa.array(b), pa.array(value)], ["lang", "a", "b", "value"]
                    )

    return ordered.mapInArrow(run, "lang string, a bigint, b bigint, value bigint")


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank for documents(text, lang, source).

    Part `pair` has every other source of the language by falling divergence; part `term` the `top` terms that the source
    uses more than its language does. All values are whole numbers and exact. Null text, lang and source count as ''.
    Groups without terms and languages without kept terms take part (a divergence of 0 without kept terms); a language
    with one source has no pairs. Ties rank by item. Rows count as documents of their own, repeated or not. An empty table
    gives no rows; further columns are ignored, whatever their names.
    """
    docs = docs.select("text", "lang", "source")
    kept = kept_terms(docs, min_docs)
    groups = groups_of(docs, kept)
    items = store(
        kept.join(groups, ["lang", "source"]).select(
            "lang", "source", "term", "place", F.expr(_p("n", "n_all")).alias("p"), "p0", F.expr(_p("n_lang", "n_lang_all")).alias("q")
        ),
        "items",
    )
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = (
        items.filter("p > q")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_f("p", "q")).alias("value"))
        .withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= top)
    )

    # Every source meets all others of its language, as the result needs them; salts keep a language from being one key.
    others = groups.select(
        "lang", F.col("place").alias("b"), F.col("source").alias("item"), F.col("p0").alias("q0"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    )
    salted = lambda df, *by: df.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).join(others, ["lang", "salt"]).filter("place <> b")
    base = salted(groups, "source").select(
        "lang", F.col("place").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"), F.expr(f"coalesce(v * ({_f('p0', 'q0')}), 0)").alias("value"), "source", "item"
    )
    classes = items.groupBy("lang", "place", "p", "p0").agg(F.count(F.lit(1)).alias("times"))
    single = (
        salted(classes, "place", "p")
        .groupBy("lang", F.col("place").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))
        .agg(F.sum(F.expr(f"times * ({_f('p', 'q0')} - {_f('p0', 'q0')})")).alias("value"))
    )
    one_way = single.unionByName(shared_terms(items).groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    both_ways = one_way.select("lang", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("ab"), "value")
    corrections = both_ways.select("lang", "ab.a", "ab.b", "value", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("item"))
    pairs = (
        base.unionByName(corrections)
        .groupBy("lang", "a", "b")
        .agg(F.max("source").alias("source"), F.max("item").alias("item"), F.sum("value").alias("value"))
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))
    )
    return pairs.unionByName(terms)


def op11_source_divergence(spark, sf_dir):
    return source_divergence(documents(spark, sf_dir))


SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS i,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), t AS (
  SELECT lang, source, i, unnest(w) AS term FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT i) AS docs FROM t GROUP BY lang, source, term
), k AS (
  SELECT lang, term, sum(n)::BIGINT AS n FROM c GROUP BY lang, term HAVING sum(docs) >= 10
), v AS (
  SELECT lang, count(*) AS v, sum(n)::BIGINT AS n FROM k GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), cell AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n, v.v, v.n AS lang_all
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), s AS (
  SELECT lang, source, sum(n)::BIGINT AS n_all FROM cell GROUP BY lang, source
), p AS (
  SELECT cell.lang, cell.source, cell.term, cell.n,
         1 + (1000000000 * (cell.n + 2)) // (s.n_all + 2 * cell.v) AS p,
         1 + (1000000000 * (cell.lang_n + 2)) // (cell.lang_all + 2 * cell.v) AS q
  FROM cell JOIN s ON s.lang = cell.lang AND s.source = cell.source
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT lang, source, part, item, value::BIGINT AS value,
         row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM parts
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""
