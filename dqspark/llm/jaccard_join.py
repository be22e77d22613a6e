"""N-gram Jaccard join on a count-vector R-tree.

Shingle hashes fall into groups; a set becomes the point of its group counts. Two sets with similarity of at least t differ
in at most r = (a + b) (1 - t) / (1 + t) shingles. The tree's upper levels use that: per size class the groups are more
than r, so similar sets have the same content in at least one of them, and a node of the tree is (class, group, content).
A node's sets all meet its first one (the star of that set); deeper down, the members of a star lie in an R-tree of count
vectors with bounding boxes, where the sum of coordinate minima bounds the overlap of a query with a box, then with a
point, coarsely and finely. Surviving pairs are verified on the sets themselves. Nothing is sampled and no list is cut.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dqspark.llm.common import discard, documents, pieces, small_side, store
from dqspark.llm.similar_sets import connected, led, ragged, stars, tiled

SHINGLE = 5
SIMILAR = (80, 100)
CHUNK_BYTES = 1_000_000
#: Members of a task of a star's tree, and bytes of their count vectors, whichever ends a tile first.
TILE = 4096
TILE_BYTES = 4_000_000
LEAF = 32
#: Shingles of one side of a task that counts links; larger components are cut into tiles.
LINK_SHINGLES = 400_000

_U = np.uint64
_MIX1, _MIX2, _MIX3 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(v: np.ndarray) -> np.ndarray:
    """Spread every input bit over the word."""
    v = (v ^ (v >> _U(30))) * _MIX1
    v = (v ^ (v >> _U(27))) * _MIX2
    return v ^ (v >> _U(31))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _MIX3)


_BASE = _U(0xD6E8FEB86659FD93)
_BASE_INVERSE = _U(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


@lru_cache(maxsize=2)
def _powers(n: int, inverse: bool) -> np.ndarray:
    out = np.full(n, _BASE_INVERSE if inverse else _BASE)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text the index of its first word (one more entry at the end)."""
    joined = np.frombuffer(b"".join(t.translate(_LOWER) + b"\n" for t in texts), np.uint8)
    space = _SPACE[joined]
    inside = ~space
    begins = np.flatnonzero(inside & np.concatenate([[True], space[:-1]]))
    ends = np.flatnonzero(space & np.concatenate([[False], inside[:-1]]))
    # Powers for the next size of buffer, so that few lengths are cached.
    size = max(1 << 16, 1 << int(len(joined)).bit_length())
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum(_byte_values()[joined] * _powers(size, False)[: len(joined)], dtype=np.uint64, out=sums[1:])
    hashes = mix((sums[ends] - sums[begins]) * _powers(size, True)[begins] + (ends - begins).astype(np.uint64))
    edges = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.searchsorted(begins, edges)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than k are one shingle, no words none."""
    words, first = word_hashes(texts)
    n = max(0, len(words) - k + 1)
    rolled = np.full(n, _U(k * 0x9E3779B97F4A7C15 % 2**64))
    for j in range(k):
        rolled = (rolled ^ words[j : j + n]) * _MIX1
        rolled ^= rolled >> _U(29)
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            v = np.full(1, _U((b - a) * 0x9E3779B97F4A7C15 % 2**64))
            for i in range(a, b):
                v = (v ^ words[i : i + 1]) * _MIX1
                v ^= v >> _U(29)
            out.append(mix(v))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Geometry:
    """Size classes and group numbers for a similarity of num / den."""

    def __init__(self, similar: tuple[int, int]):
        self.num, self.den = similar
        if not 0 < self.num <= self.den:
            raise ValueError("the similarity is above 0 and at most 1")
        self.bounds = [1]
        while self.bounds[-1] < 2**40:
            # A set similar to one of class c is in class c or c - 1.
            self.bounds.append(self.bounds[-1] * self.den // self.num + 1)

    def size_class(self, n: int) -> int:
        return bisect_right(self.bounds, n) - 1

    def groups(self, c: int) -> tuple[int, int]:
        """Groups of class c and how many of them a set may leave empty before it counts as sparse."""
        largest = self.bounds[c + 1] - 1
        r = 2 * largest * (self.den - self.num) // (self.den + self.num)
        spare = 1 + r // 12
        # At least 1 + spare groups agree; if one of the sets has no more than spare empty ones, one that agrees has content.
        return (r + 1 + spare if r else 0), spare

    def needed(self, a, b):
        """Least overlap of similar sets of a and b shingles."""
        return -(-(a + b) * self.num // (self.num + self.den))

    def addresses(self, v: np.ndarray) -> np.ndarray:
        """Nodes of the upper levels that a set lies in: for its size class and the next one.

        Two sparse sets might agree in empty groups alone. They meet by single shingles instead: of those in hash order the
        first n - ceil(t n) + 1 of similar sets have one in common.
        """
        spread, out, sparse = mix(v ^ _MIX3), [], False
        own = self.size_class(len(v))
        for c in (own, own + 1):
            m, spare = self.groups(c)
            if not m:
                continue  # only equal sets are similar
            g = (((spread >> _U(32)) * _U(m)) >> _U(32)).astype(np.int64)
            counts = np.bincount(g, minlength=m)
            content = np.zeros(m, np.uint64)
            np.add.at(content, g, v)
            used = np.flatnonzero(counts)
            sparse = sparse or m - len(used) > spare
            tag = _U(c * 0x9E3779B97F4A7C15 % 2**64) + used.astype(np.uint64) * _MIX2 + counts[used].astype(np.uint64)
            out.append(mix(mix(content[used]) + tag))
        if sparse:
            first = len(v) + len(v) * self.num // -self.den + 1
            out.append(mix(v[:first] + _MIX2))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def coordinates(n: int) -> int:
    """Groups of a count vector: two or more for each shingle, a power of two so that vectors fold onto shorter ones."""
    return 1 << min(12, max(4, (2 * max(n, 1)).bit_length()))


def count_vector(v: np.ndarray) -> np.ndarray:
    """In the narrowest type that holds the counts; its width follows from the number of bytes."""
    size = coordinates(len(v))
    counts = np.bincount((mix(v ^ _MIX1) >> _U(64 - size.bit_length() + 1)).astype(np.int64), minlength=size)
    return counts.astype(np.min_scalar_type(int(counts.max())).newbyteorder("<"))


def read_vector(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(packed, f"<u{len(packed) // coordinates(n)}")


def fold(vector: np.ndarray, size: int) -> np.ndarray:
    return vector.reshape(size, -1).sum(axis=1, dtype=np.int32)


# ------------------------------------------------------------------------------------------------ sketches of all documents

SKETCH = "doc_id bigint, n bigint, set_key binary, vector binary, addresses array<bigint>, held array<bigint>, leads array<bigint>, place bigint, text_hash bigint"


def chunks(texts: list[str]):
    begin = held = 0
    data = []
    for i, t in enumerate(texts):
        raw = t.encode()
        if data and held + len(raw) > CHUNK_BYTES:
            yield begin, data
            begin, held, data = i, 0, []
        data.append(raw)
        held += len(raw)
    if data:
        yield begin, data


def set_key(v: np.ndarray) -> bytes:
    """128 bits of the set, independent of order."""
    return mix(np.array([v.sum(dtype=np.uint64), mix(v + _MIX2).sum(dtype=np.uint64)]) + _U(len(v))).astype("<u8").tobytes()


def sketch(docs: DataFrame, k: int, similar: tuple[int, int]) -> DataFrame:
    """Per document: set size and key, count vector, and the tree nodes (addresses) that it lies in.

    `place` is the document's name, unique whatever the ids. Within a piece of a batch only the first set at an address is
    sent on; the others hold the address beside that lead. So a node that a third of all documents share reaches the
    shuffle once per piece. Sets seen before in the piece send nothing.
    """

    def run(batches):
        geometry = Geometry(similar)
        place = TaskContext.get().partitionId() << 40
        for batch in pieces(batches):
            seen: set[bytes] = set()
            rows, addresses, owners = [], [], []
            ids = batch.column("doc_id").to_pylist()
            for begin, raws in chunks(batch.column("text").to_pylist()):
                for i, v in enumerate(shingle_sets(raws, k), begin):
                    key = set_key(v)
                    rows.append((ids[i], len(v), key, count_vector(v).tobytes() if len(v) else b"", place))
                    place += 1
                    if len(v) and key not in seen:
                        seen.add(key)
                        found = geometry.addresses(v)
                        addresses.append(found)
                        owners.append(np.full(len(found), len(rows) - 1))
            if not rows:
                continue
            ids_, n, keys, vector, places = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids_, pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(vector, pa.binary()),
                    *led(addresses, owners, places),
                    pa.array(places, pa.int64()),
                    batch.column("text_hash"),
                ],
                ["doc_id", "n", "set_key", "vector", "addresses", "held", "leads", "place", "text_hash"],
            )

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), F.xxhash64(text).alias("text_hash"))
    return rows.mapInArrow(run, SKETCH)


# ------------------------------------------------------------------------------------------------------- the lower levels


class Tree:
    """R-tree over count vectors, packed by size and the first coordinates; leaves and their parents have bounding boxes.

    Boxes and points are coarse, about two shingles a coordinate; what they leave meets the finest coordinates.
    """

    def __init__(self, n: np.ndarray, vectors: list[np.ndarray], geometry: Geometry):
        self.geometry = geometry
        # All vectors folded to the shortest: the bound holds for any grouping, and sizes differ little.
        fine = min(map(len, vectors))
        self.width = max(16, fine // 4)
        # Most counts fit a byte; wider ones widen all of them.
        self.fine = np.stack([v if len(v) == fine else fold(v, fine) for v in vectors])
        points = self.fine.reshape(len(vectors), self.width, -1).sum(axis=2, dtype=np.int32)
        points = points.astype(np.min_scalar_type(int(points.max(initial=0))))
        self.order = np.lexsort((points[:, 1], points[:, 0], n))
        self.n, self.points, self.fine = n[self.order], points[self.order], self.fine[self.order]
        self.levels = [self._boxes(self.points, self.n)]
        while len(self.levels[-1][0]) > LEAF:
            self.levels.append(self._boxes(*self.levels[-1]))

    def _boxes(self, points: np.ndarray, least: np.ndarray):
        """Upper corners and least sizes; lower corners do not enter the bound."""
        cuts = np.arange(0, len(points), LEAF)
        return np.maximum.reduceat(points, cuts, axis=0), np.minimum.reduceat(least, cuts)

    def search(self, n: int, vector: np.ndarray) -> np.ndarray:
        """Positions (as given) of the members that may be similar to the query."""
        q = fold(vector, self.width) if len(vector) >= self.width else None
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            upper, least = self.levels[depth]
            at = at[self._may(n, q, upper[at], least[at])]
            at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
            at = at[at < (len(self.levels[depth - 1][0]) if depth else len(self.points))]
        at = at[self._may(n, q, self.points[at], self.n[at])]
        if len(vector) >= self.fine.shape[1]:
            at = at[self._may(n, fold(vector, self.fine.shape[1]), self.fine[at], self.n[at])]
        return self.order[at]

    def _may(self, n: int, q: np.ndarray | None, upper: np.ndarray, least: np.ndarray) -> np.ndarray:
        needed = self.geometry.needed(n, least)
        if q is None:
            return np.minimum(n, upper.sum(axis=1, dtype=np.int64)) >= needed
        # No minimum exceeds the query's count, so the narrower type holds it.
        narrow = np.minimum(upper, np.minimum(q, np.iinfo(upper.dtype).max).astype(upper.dtype))
        return narrow.sum(axis=1, dtype=np.int32) >= needed


def near_hubs(pairs: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """a, b: the rows of pairs(star, place, n, vector, other_n, other_vector) that may be similar. A hub is the root that
    each member meets as a point, pair by pair, without gathering a star."""

    def run(batches):
        geometry = Geometry(similar)
        for batch in batches:
            n, hub_n = batch.column("n").to_pylist(), batch.column("other_n").to_pylist()
            vectors, hub_vectors = batch.column("vector").to_pylist(), batch.column("other_vector").to_pylist()
            may = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                v, h = read_vector(vectors[i], n[i]), read_vector(hub_vectors[i], hub_n[i])
                width = min(len(v), len(h))
                may[i] = np.minimum(fold(v, width), fold(h, width)).sum() >= geometry.needed(n[i], hub_n[i])
            kept = batch.filter(pa.array(may))
            a, b = kept.column("star").to_numpy(), kept.column("place").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return pairs.mapInArrow(run, "a bigint, b bigint")


def tree_search(members: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """a, b: places of queries and members of one star that may be similar; see similar_sets.tiled for the members.

    Pairs within one `part` are known to be connected and left out. A star of any size is cut into tiles of about TILE
    members and TILE queries or TILE_BYTES; every pair of tiles is a task of its own.
    """

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        geometry = Geometry(similar)
        vectors = lambda t: [read_vector(x, n) for x, n in zip(t.column("vector").to_pylist(), t.column("n").to_pylist())]
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if left.num_rows and right.num_rows:
            tree = Tree(right.column("n").to_numpy(), vectors(right), geometry)
            places, parts = right.column("place").to_numpy(), right.column("part").to_numpy()
            for place, n, part, v in zip(
                left.column("place").to_pylist(), left.column("n").to_pylist(), left.column("part").to_pylist(), vectors(left)
            ):
                found = tree.search(n, v)
                found = places[found[parts[found] != part]]
                a.append(np.full(len(found), place))
                b.append(found)
        return pa.table({"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b))})

    return tiled(members, run, ["place", "n", "vector", "part"], TILE, TILE_BYTES)


def sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """set_key, shingles of the documents whose ids are wanted(low)."""

    def run(batches):
        for batch in pieces(batches):
            for _, raws in chunks(batch.column("text").to_pylist()):
                found = shingle_sets(raws, k)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([set_key(v) for v in found], pa.binary()),
                        ragged(
                            np.concatenate(found).view(np.int64), np.repeat(np.arange(len(found)), [len(v) for v in found]), len(found)
                        ),
                    ],
                    ["set_key", "shingles"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = small_side(wanted)
    chosen = rows.join(ids, rows["doc_id"].eqNullSafe(ids["low"]), "left_semi").select("text")
    return chosen.mapInArrow(run, "set_key binary, shingles array<bigint>")


def star_sets(docs: DataFrame, meets: DataFrame, distinct: DataFrame, sketches: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(place, shingles) and (place, n, vector) of the sets in stars, one row each."""
    in_stars = store(meets.select("place").union(meets.select("star")).distinct(), "in-stars")
    met = store(distinct.join(in_stars, "place").select("place", "set_key", "low"), "met-sets")
    found = sets_of(docs, store(met.select("low").distinct(), "wanted"), k)
    # Rows that repeat an id give a set more than once; a set has one key and one place.
    shingles = found.join(small_side(met.select("set_key", "place")), "set_key").dropDuplicates(["set_key"])
    rows = sketches.select("place", "n", "vector")
    points = rows.join(small_side(in_stars), "place", "left_semi")
    return store(shingles.select("place", "shingles"), "sets"), store(points, "points")


# ------------------------------------------------------------------------------------------------------------ the join


def jaccard_components(docs: DataFrame, k: int = SHINGLE, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of documents(doc_id, text).

    A set is the distinct k-word shingles of the whole text, A-Z lower-cased; shorter texts are one shingle. Documents
    link when den * intersection >= num * union; component_id is the smallest doc_id reachable. Null, empty and wordless
    texts have no shingles, link with nothing and are their own component. Rows that repeat an id are documents of their
    own; a component of null ids alone has a null id. An empty table gives no rows; further columns are ignored.

    Equal sets fold to one before all else. Each set meets its first hub, then the hubs that this leaves unconnected with
    it, and only what still is apart searches a star's tree, so a large group of near copies costs about one comparison
    per member.
    """
    sketches, classes, _ = _classes(docs, k, similar)
    return _named(sketches, classes)


def jaccard_links(docs: DataFrame, k: int = SHINGLE, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """The columns of jaccard_components and n_links, the number of other rows that a row links with, copies included.

    Links lie within components, so all pairs of a component's sets are compared exactly. The cost of a component grows
    with the square of its sets, as its links do; tiles of it are tasks of their own and pass on counts, not pairs.
    """
    sketches, classes, sets = _classes(docs, k, similar)
    copies = sketches.filter("n > 0").groupBy("set_key").agg(F.count(F.lit(1)).alias("copies"))
    counted = store(classes.join(copies, "set_key").select("set_key", "n", "place", "low", "label", "copies"), "counted-sets")
    beside = link_counts(counted.select("label", "place", "n", "copies"), sets, similar)
    by_set = counted.join(beside, "place", "left").select("set_key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    named = _named(sketches, counted, "set_key").join(by_set, "set_key", "left")
    return named.select("doc_id", "n_shingles", "component_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"))


def spare_copies(docs: DataFrame, k: int = SHINGLE, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """doc_id, text_hash, gone, of the rows that are not the one to keep of their component, and of those that repeat.

    Of each component the smallest doc_id stays; where it stands on several texts of the component, the least hash does.
    Rows with gone = false are to stay once but repeat in the table. Rows of null ids are not named.
    """
    sketches, classes, _ = _classes(docs, k, similar)
    texts = sketches.filter("doc_id is not null").groupBy("doc_id", "text_hash").agg(F.first("set_key").alias("set_key"), F.count(F.lit(1)).alias("rows"))
    found = store(texts.join(classes.select("set_key", "label"), "set_key", "left").select("doc_id", "text_hash", "rows", "label"), "labelled-texts")
    kept = found.filter("label is not null").groupBy("label").agg(F.min(F.struct("doc_id", "text_hash")).alias("kept"))
    gone = F.coalesce(F.struct("doc_id", "text_hash") != F.col("kept"), F.lit(False))
    judged = found.join(kept, "label", "left").select("doc_id", "text_hash", gone.alias("gone"), "rows")
    return store(judged.filter("gone or rows > 1").select("doc_id", "text_hash", "gone"), "spare-copies")


def link_counts(members: DataFrame, sets: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """place, links: copies of the other sets that each of members(label, place, n, copies) is similar to.

    Each pair of a label meets in one task: small labels share a task with others, a large one is a square of tiles.
    """
    labels = members.groupBy("label").agg(F.sum("n").alias("mass"), F.count(F.lit(1)).alias("sets")).filter("sets > 1")
    sized = store(labels.select("label", "mass", F.ceil(F.col("mass") / LINK_SHINGLES).cast("int").alias("tiles")), "link-tiles")
    small = sized.filter("tiles = 1").agg(F.coalesce(F.sum("mass"), F.lit(0))).first()[0]
    shared = F.pmod(F.xxhash64("label"), F.lit(1 + int(small) // LINK_SHINGLES))
    large = F.col("tiles") > 1
    dealt = (
        members.join(sized, "label")
        .select("place", "copies", large.alias("large"), F.when(large, F.col("label")).otherwise(shared).alias("block"), "tiles")
        .withColumn("tile", F.pmod(F.xxhash64("place"), F.col("tiles")).cast("int"))
        .join(sets, "place")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("large", "block", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "place", "copies", "shingles")
    )

    def run(key, rows):
        geometry = Geometry(similar)
        i, j = key[2].as_py(), key[3].as_py()
        tile, place, copies = (rows.column(c).to_numpy() for c in ("tile", "place", "copies"))
        lists = rows.column("shingles").combine_chunks()
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        n = lists.value_lengths().to_numpy().astype(np.int64)
        values, ends = lists.flatten().to_numpy(), np.cumsum(n)
        links = np.zeros(len(n), np.int64)
        left, right = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        # The right side's shingles in order, each with the set that holds it.
        held = np.repeat(tile == j, n)
        posted, owner = values[held], np.repeat(np.arange(len(right)), n[right])
        order = np.argsort(posted, kind="stable")
        posted, owner = posted[order], owner[order]
        for q in left.tolist() if len(right) else []:
            v = values[ends[q] - n[q] : ends[q]]
            begin = np.searchsorted(posted, v, side="left")
            many = np.searchsorted(posted, v, side="right") - begin
            at = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())
            both = np.bincount(owner[at], minlength=len(right))
            near = right[both >= geometry.needed(n[q], n[right])]
            near = near[near != q]
            links[q] += copies[near].sum()
            if i != j:
                links[near] += copies[q]
        return pa.table({"place": pa.array(place, pa.int64()), "links": pa.array(links, pa.int64())})

    found = dealt.groupBy("large", "block", "i", "j").applyInArrow(run, "place bigint, links bigint")
    return found.groupBy("place").agg(F.sum("links").alias("links"))


def _classes(docs: DataFrame, k: int, similar: tuple[int, int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents' sketches, the distinct sets with the label of their component, and the shingles of sets in stars."""
    located = store(sketch(docs, k, similar), "sketches")
    sketches = store(located.drop("addresses", "held", "leads"), "sets-of-documents")
    distinct = store(
        sketches.filter("n > 0").groupBy("set_key", "n").agg(F.min("place").alias("place"), F.min("doc_id").alias("low")), "distinct-sets"
    )
    names = sketches.filter("n > 0").select(F.col("place").alias("node"), "set_key").join(distinct.select("set_key", "place"), "set_key")
    meets = stars(located, store(names.select("node", "place"), "names"))
    discard(located)

    sets, points = star_sets(docs, meets, distinct, sketches, k)
    labels = connected(meets, points, sets, similar, lambda pairs: near_hubs(pairs, similar), lambda members: tree_search(members, similar))
    classes = distinct.join(labels.withColumnRenamed("id", "place"), "place", "left").withColumn("label", F.coalesce("label", "place"))
    return sketches, classes, sets


def _named(sketches: DataFrame, classes: DataFrame, *more: str) -> DataFrame:
    smallest = classes.groupBy("label").agg(F.min("low").alias("component_id"))
    by_set = classes.join(smallest, "label").select("set_key", "component_id")
    return sketches.select("doc_id", "n", "set_key").join(by_set, "set_key", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        *more,
    )


def op5_jaccard_join(spark, sf_dir):
    return jaccard_components(documents(spark, sf_dir), k=4, similar=(85, 100))


def op5_jaccard_links(spark, sf_dir):
    return jaccard_links(documents(spark, sf_dir), k=4, similar=(85, 100))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT p.a, p.b
  FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
  WHERE 100 * common >= 85 * (na.n + nb.n - common)
), reached AS (
  SELECT doc_id, doc_id AS other FROM d
  UNION
  SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) c USING (doc_id)
"""

LINKS_SQL = SQL.replace("c.component_id\nFROM", "c.component_id, coalesce(l.n_links, 0)::BIGINT AS n_links\nFROM").replace(
    "LEFT JOIN n USING (doc_id)", "LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a) l USING (doc_id)"
)
