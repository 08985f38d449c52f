"""N-gram Jaccard join: count vectors in an R-tree bound the overlap, exact sets decide.

A document's set holds the hashes of its distinct WORDS-word shingles.  Shingles are hashed into groups, so many
that one holds PER_GROUP shingles or fewer; a document is the point of its group counts.  Points of two sizes are compared
in the groups of the smaller, which the larger's add up to.  For two points the sum of the coordinates' minima bounds the overlap of
the sets from above, and for a box of points the minima with the box's greatest counts do; an R-tree over the points
visits only boxes that can still reach the overlap that the similarity asks for.  Pairs that survive are
verified on the whole sets: 100 * intersection >= 80 * union.

Which points meet in a tree is decided by the content of groups, too.  The groups of a size class are so fine
(2 to 5 shingles each) that sets with a similarity of 0.8 or more have each group wholly in common
with a probability of 0.32 or more; N_KEYS groups of each document become block keys.  A pair at
the threshold misses all of them with a probability below 3e-7, a closer pair far less often; equal sets never.  With
`exact=True` the keys are a set's 20 per cent of least shingles in the order of a hash, of which a pair at the threshold shares one for
certain; there are more of them in long texts, and a passage in common is a block of all that have it.

1. Equal sets are folded to one node, by the hash of the set, before anything else.
2. Blocks: the points of the nodes that share a key are one R-tree join.  A block gives back a spanning forest of the
   pairs that the bound lets through, so a block of m nodes costs m - 1 rows at most.  Most chance meetings, such as a passage in
   common, end here, where only points travel.  In a block of more than BLOCK_CAP nodes each node's set is first verified against those of
   PILOTS nodes of the block, and linked nodes are folded; then only nodes outside the block's largest fold are joined with all others,
   in pairs of chunks.  So a block of near copies costs a few verifications a node; one of many unlike nodes costs pairs of chunks.
3. The forest's components are clusters: every pair that could be linked lies within one.  A cluster of up to CAP nodes
   is one exact R-tree join over its sets; each set travels once.
4. In a larger cluster every node's PARTNERS best pairs of the forest are verified first, and linked nodes become one component.
   Then the nodes outside the largest component are joined with all others, in chunks of CAP, within the cluster, or within
   its blocks where it has more than UNIT_CAP nodes.  Pairs inside a component aren't looked at, as they can't change the
   result.  So a group of a third of all rows costs a few verifications a row, and no task holds more than two chunks.
5. Components of the links give each document the smallest doc_id that it reaches.

Words are runs of other bytes than space and 0x09-0x0D; A-Z are lower-cased.  Defined cases: null and empty texts, and texts
without words, have an empty set and link with nothing; fewer than WORDS words are one shingle; a null
doc_id takes part, but is no component's name; rows that share a doc_id are judged each by its own text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tidewell.llm.common import field, pieces, read, unused, with_columns, written
from tidewell.llm.components import components

WORDS = 5
SIMILARITY = 80  # per cent
N_KEYS = 40
#: Shingles of a group, and the least and greatest number of coordinates of a point, powers of two.
PER_GROUP = 8
GROUPS, MAX_GROUPS = 32, 4096
LEAF = 16
CAP = 512
#: Nodes of a block that are one join of points; a larger block is cut into chunks of half of it, which meet in pairs.
BLOCK_CAP = 4_096
#: Nodes of a large block that all its nodes are verified against.
PILOTS = 4
#: Nodes of a cluster up to which its strays are joined with the whole cluster; in a larger one they are joined by block.
UNIT_CAP = 20_480
PARTNERS = 3
#: Nodes up to which the list of clustered nodes is broadcast to the second pass over the texts; a longer one is joined by shuffle.
MAX_BROADCAST = 2_000_000
CACHE_ENTRIES = 100_000
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31, _S32 = np.uint64(30), np.uint64(27), np.uint64(31), np.uint64(32)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = (h ^ (h >> _S30)) * _M2
    h = (h ^ (h >> _S27)) * _M3
    return h ^ (h >> _S31)


def _salt(i: int) -> np.uint64:
    return np.uint64(i * int(_M1) % (1 << 64))


class Shingler:
    """Shingle sets of texts; the hashes of words are cached, and the cache is emptied when it is full."""

    def __init__(self, words: int = WORDS, cache_entries: int = CACHE_ENTRIES):
        self.words, self.cache_entries = words, cache_entries
        self.cache: dict[bytes, int] = {}

    def set_of(self, text: str | None) -> np.ndarray:
        """The sorted distinct shingle hashes of a whole text."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        cache = self.cache
        if len(cache) + len(words) > self.cache_entries:
            cache.clear()
        for word in set(words).difference(cache):
            cache[word] = xxhash.xxh64_intdigest(word)
        hashes = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        k = min(self.words, len(words))
        n = len(words) - k + 1
        out = np.full(n, k, np.uint64)
        for i in range(k):
            out = mix(out * _M1 + hashes[i : i + n])
        return np.unique(out)


def size_class(n: int) -> int:
    """Classes grow by the square root of 2."""
    return int(np.floor(2 * np.log2(n) + 1e-9))


def groups_of_class(c: int) -> int:
    return max(3, int(2 ** (c / 2) / 3.2))


def block_keys(shingles: np.ndarray, n_keys: int = N_KEYS) -> np.ndarray:
    """Block keys (int64): hashes of the content of groups, for the size class and that of sets of 0.8 times the size.

    Sets of up to 3 shingles reach the similarity only if they are equal, and have no keys.
    """
    n = len(shingles)
    if n < 4:
        return np.zeros(0, np.int64)
    out = []
    for c in sorted({size_class(n), size_class(max(4, -(-n * SIMILARITY // 100)))}):
        k = groups_of_class(c)
        for seed in range(-(-n_keys // k)):
            spread = mix(shingles + _salt(seed * 2 + 1))
            group = ((spread >> _S32) * np.uint64(k)) >> _S32
            used = np.flatnonzero(group < np.uint64(min(k, n_keys - seed * k)))
            group, spread = group[used], spread[used]
            order = np.argsort(group, kind="stable")
            group, spread = group[order], mix(spread[order])
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
            if len(first):
                content = np.add.reduceat(spread, first)
                out.append(mix(content ^ mix(group[first] + _salt(c * 4096 + seed))))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def exact_keys(shingles: np.ndarray) -> np.ndarray:
    """Block keys (int64) of which two sets that reach the similarity share one: the least n - ceil(0.8 n) + 1 shingles by a hash."""
    n = len(shingles)
    if not n:
        return np.zeros(0, np.int64)
    return np.sort(mix(shingles + _salt(7)))[: n - -(-n * SIMILARITY // 100) + 1].view(np.int64)


def groups_of(n: int) -> int:
    """Coordinates of the point of n shingles."""
    return min(MAX_GROUPS, max(GROUPS, 1 << (max(1, -(-n // PER_GROUP)) - 1).bit_length()))


def count_vector(shingles: np.ndarray, groups: int | None = None) -> np.ndarray:
    groups = groups or groups_of(len(shingles))
    return np.bincount(((mix(shingles) >> _S32) * np.uint64(groups) >> _S32).astype(np.int64), minlength=groups)


def point_bytes(shingles: np.ndarray) -> bytes:
    """The point, behind the width of its numbers."""
    point = count_vector(shingles)
    width = 1 if point.max(initial=0) < 1 << 8 else 2 if point.max() < 1 << 16 else 4
    return bytes([width]) + point.astype(f"<u{width}").tobytes()


def points_of(raw: list[bytes]) -> np.ndarray:
    """Points as rows, all in the groups of the smallest: neighbouring groups of a larger point are added up."""
    points = [np.frombuffer(r, f"<u{r[0]}", offset=1) for r in raw]
    groups = min(map(len, points))
    return np.array([p.reshape(groups, -1).sum(axis=1, dtype=np.int32) for p in points])


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= SIMILARITY * (len(a) + len(b) - common)


class CountTree:
    """A bulk-loaded R-tree over count vectors: leaves of LEAF points, boxes of greatest counts and of sizes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.sizes = points, points.sum(axis=1)
        self.leaves: list[np.ndarray] = []
        self._split(np.arange(len(points)), leaf)
        self.levels = []  # from the leaves up: (greatest counts, least size, greatest size, children)
        tops = np.array([points[m].max(axis=0) for m in self.leaves])
        low, high = np.array([self.sizes[m].min() for m in self.leaves]), np.array([self.sizes[m].max() for m in self.leaves])
        self.levels.append((tops, low, high, None))
        while len(tops) > leaf:
            parts = [np.arange(i, min(i + leaf, len(tops))) for i in range(0, len(tops), leaf)]
            tops, low, high = np.array([tops[p].max(axis=0) for p in parts]), np.array([low[p].min() for p in parts]), np.array([high[p].max() for p in parts])
            self.levels.append((tops, low, high, parts))

    def _split(self, members: np.ndarray, leaf: int) -> None:
        if len(members) <= leaf:
            self.leaves.append(members)
            return
        spread = self.points[members]
        axis = int(np.argmax(spread.max(axis=0) - spread.min(axis=0)))
        order = members[np.argsort(spread[:, axis], kind="stable")]
        half = -(-len(order) // (2 * leaf)) * leaf
        half = half if half < len(order) else len(order) // 2
        self._split(order[:half], leaf)
        self._split(order[half:], leaf)

    def reach(self, point: np.ndarray) -> np.ndarray:
        """Points whose sum of minima with this one allows the similarity."""
        size = int(point.sum())
        at = np.arange(len(self.levels[-1][0]))
        for tops, low, high, parts in reversed(self.levels):
            fits = self._fits(np.minimum(tops[at], point).sum(axis=1), size, low[at], high[at])
            at = at[fits]
            if not len(at):
                return at
            if parts is not None:
                at = np.concatenate([parts[i] for i in at])
        members = np.concatenate([self.leaves[i] for i in at])
        return members[self._fits(np.minimum(self.points[members], point).sum(axis=1), size, self.sizes[members], self.sizes[members])]

    @staticmethod
    def _fits(bound: np.ndarray, size: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        # common >= s (a + b - common) asks for common >= s (a + b) / (1 + s), and for sizes within s of each other.
        return ((100 + SIMILARITY) * bound >= SIMILARITY * (size + low)) & (100 * high >= SIMILARITY * size) & (SIMILARITY * low <= 100 * size)


def tree_join(sets: list[np.ndarray], known: list[int], asks: list[bool] | None = None) -> list[tuple[int, int]]:
    """Links that join components: pairs of places in sets.

    known: the component that each is in already.  asks: which of them are compared with the others (all, if
    None); two that don't ask aren't compared.  Pairs within a component, known or found, are passed over.
    """
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    leaders: dict[int, int] = {}
    for i, c in enumerate(known):
        root[i] = leaders.setdefault(c, i)
    groups = min((groups_of(len(s)) for s in sets), default=GROUPS)
    points = np.array([count_vector(s, groups) for s in sets])
    tree, out = CountTree(points), []
    for i in range(len(sets)):
        if asks is not None and not asks[i]:
            continue
        for j in tree.reach(points[i]).tolist():
            if j != i and (j > i or asks is not None and not asks[j]) and (a := find(i)) != (b := find(j)) and linked(sets[i], sets[j]):
                root[max(a, b)] = min(a, b)
                out.append((i, j))
    return out


def survivors_forest(points: np.ndarray, folds: list[int] | None = None, asks: list[bool] | None = None) -> list[tuple[int, int, float]]:
    """A spanning forest (i, j, bound similarity) of the pairs that the bound lets through, each link the best of its node.

    A node takes one pair to every component that it reaches among the nodes before it.  folds: nodes of one fold are a component from the
    start.  asks: which nodes are compared with all others; two that don't ask aren't compared.
    """
    n, sizes = len(points), points.sum(axis=1)
    tree = CountTree(points) if n > LEAF else None

    def reach(i: int) -> np.ndarray:
        if tree is not None:
            return tree.reach(points[i])
        return np.flatnonzero(CountTree._fits(np.minimum(points, points[i]).sum(axis=1), int(sizes[i]), sizes, sizes))

    label = np.arange(n) if folds is None else np.unique(folds, return_inverse=True)[1]
    asked, out = np.ones(n, bool) if asks is None else np.array(asks, bool), []
    for i in range(n):
        if not asked[i]:
            continue
        near = reach(i)
        near = near[((near < i) | ~asked[near]) & (label[near] != label[i])]
        if not len(near):
            continue
        common = np.minimum(points[near], points[i]).sum(axis=1)
        ratio = common / (sizes[near] + sizes[i] - common)
        order = np.lexsort((near, -ratio))
        names, first = np.unique(label[near][order], return_index=True)
        out += [(i, int(near[order[f]]), float(ratio[order[f]])) for f in first]
        label[np.isin(label, [*names.tolist(), label[i]])] = names[0]
    return out


def fingerprints(docs: DataFrame, n_keys: int = N_KEYS, exact: bool = False) -> DataFrame:
    """(doc_id, text_hash, n_shingles, node, point, keys): node is the hash of the whole set, null for an empty one."""
    held: list[Shingler] = []

    def run(batch: pa.RecordBatch) -> dict:
        shingler = held[0] if held else held.append(Shingler()) or held[0]
        sizes, nodes, points, keys = [], [], [], []
        for text in batch.column(batch.schema.get_field_index("text")):
            shingles = shingler.set_of(text.as_py())
            sizes.append(len(shingles))
            nodes.append(node_of(shingles))
            points.append(point_bytes(shingles))
            keys.append(exact_keys(shingles) if exact else block_keys(shingles, n_keys))
        return {"n_shingles": sizes, "node": nodes, "point": points, "keys": pa.array(keys, pa.list_(pa.int64()))}

    made = [field("n_shingles", "long"), field("node", "long"), field("point", "binary"), field("keys", "array<long>")]
    return with_columns(docs.select("doc_id", "text", text_hash()), made, run).drop("text")


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")


def node_of(shingles: np.ndarray) -> int | None:
    if not len(shingles):
        return None
    h = xxhash.xxh3_64_intdigest(shingles.tobytes())
    return h - (1 << 64) if h >> 63 else h


def jaccard_components(docs: DataFrame, *, n_keys: int = N_KEYS, exact: bool = False, cap: int = CAP, block_cap: int = BLOCK_CAP, unit_cap: int = UNIT_CAP) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id) for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    prints = written(spark, fingerprints(docs, n_keys, exact), "prints")
    nodes = prints.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep"))
    roots = _roots(spark, docs, prints, cap, block_cap, unit_cap)
    names = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = names.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = names.join(least, "root").select("node", "component_id")
    out = prints.select("doc_id", "text_hash", "n_shingles", "node").join(named, "node", "left")
    return out.select("doc_id", "text_hash", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _roots(spark: SparkSession, docs: DataFrame, prints: DataFrame, cap: int, block_cap: int, unit_cap: int) -> DataFrame:
    """(node, root) of the nodes that are linked to another."""
    firsts = prints.where("size(keys) > 0").groupBy("node").agg(F.first("keys").alias("keys"))  # equal sets have equal keys
    keyed = written(spark, firsts.select("node", F.explode("keys").alias("key")), "keyed")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = written(spark, keyed.join(shared, "key"), "met")
    points = prints.select("node", "point").join(met.select("node").distinct(), "node").groupBy("node").agg(F.min("point").alias("point"))
    crowded = met.where(F.col("n") > block_cap)
    any_crowded = not crowded.isEmpty()
    points = written(spark, points, "points") if any_crowded else points
    edges = _forest(met.where(F.col("n") <= block_cap).join(points, "node"))
    if any_crowded:
        edges = edges.unionByName(_crowded_forest(spark, docs, prints, crowded, points, block_cap))
    forest = written(spark, edges.groupBy("a", "b").agg(F.max("bound").alias("bound")), "forest")
    clusters = components(spark, forest)
    sizes = clusters.groupBy("root").agg(F.count("*").alias("size"))
    clustered = written(spark, clusters.join(sizes, "root").select("node", F.col("root").alias("cluster"), "size"), "clusters")
    sets = written(spark, _sets(docs, prints, clustered), "sets")
    small = _local(sets.where(F.col("size") <= cap).select("node", "cluster", "set"))
    if sets.where(F.col("size") > cap).isEmpty():
        return components(spark, small)
    large = _large(spark, sets.where(F.col("size") > cap), met, forest, cap, unit_cap)
    return components(spark, small.unionByName(large))


def _forest(blocks: DataFrame) -> DataFrame:
    """(a, b, bound) of every block (key, node, point)."""
    tasks = blocks.select(F.col("key").alias("task"), "node", "point", F.col("node").alias("fold"), F.lit(True).alias("asks"))
    return _forest_of(tasks)


def _forest_of(tasks: DataFrame) -> DataFrame:
    """(a, b, bound) of every task (task, node, point, fold, asks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, float]] = []
        for _, rows in _runs(batches):
            if len(rows) > 1:
                found = survivors_forest(points_of([r[1] for r in rows]), [r[2] for r in rows], [r[3] for r in rows])
                out += [(rows[i][0], rows[j][0], bound) for i, j, bound in found]
            if len(out) > 4096:
                yield _weighted(out)
                out = []
        if out:
            yield _weighted(out)

    ordered = tasks.select("task", "node", "point", "fold", "asks").repartition("task").sortWithinPartitions("task", "node")
    return ordered.mapInArrow(run, T.StructType([*LINKS.fields, field("bound", "double")]))


def _crowded_forest(spark: SparkSession, docs: DataFrame, prints: DataFrame, crowded: DataFrame, points: DataFrame, block_cap: int) -> DataFrame:
    """(a, b, bound) of blocks (key, node) of more than block_cap nodes: verified links with the pilots, and the forest of the others."""
    picks = [F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("h"), "node")).alias(f"p{i}") for i in range(PILOTS)]
    pilots = crowded.groupBy("key").agg(*picks).select("key", F.explode(F.array_distinct(F.array(*[F.col(f"p{i}.node") for i in range(PILOTS)]))).alias("pilot"))
    pairs = crowded.select("key", "node").join(pilots, "key").where("node <> pilot").select(F.least("node", "pilot").alias("a"), F.greatest("node", "pilot").alias("b")).distinct()
    pairs = written(spark, pairs, "pairs")
    members = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = written(spark, _sets(docs, prints, members.select("node", F.lit(0).cast("long").alias("cluster"), F.lit(0).cast("long").alias("size"))), "sets").select("node", "set")
    links = written(spark, _verified(pairs, sets), "links")
    folds = written(spark, members.join(components(spark, links), "node", "left").select("node", F.coalesce("root", "node").alias("comp")), "folds")
    tasks = _minor_tasks(crowded.select(F.col("key").alias("unit"), "node").join(folds, "node"), block_cap // 2)
    rest = _forest_of(tasks.join(points, "node").select("task", "node", "point", F.col("comp").alias("fold"), "asks"))
    return rest.unionByName(links.select("a", "b", F.lit(1.0).alias("bound")))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets (node, set) reach the similarity."""
    shipped = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            b, a, set_a, set_b = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("b", "a", "set_a", "set_b"))
            yield _links([(x, y) for x, y, s, t in zip(a, b, set_a, set_b, strict=True) if linked(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64))])

    return shipped.mapInArrow(verify, LINKS)


def _minor_tasks(units: DataFrame, cap: int) -> DataFrame:
    """(task, node, comp, asks) that bring the nodes outside the largest component of each unit (unit, node, comp) together with all
    others, in chunks of cap; nodes of the largest component don't ask, and units of one component have no task."""
    parts = units.groupBy("unit", "comp").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("unit").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("k")).where("k > 1")
    mixed = mixed.select("unit", F.col("top.comp").alias("major"), F.ceil(F.col("top.n") / cap).cast("int").alias("n_major"), F.ceil((F.col("n") - F.col("top.n")) / cap).cast("int").alias("n_minor"))
    rows = units.join(mixed, "unit").withColumn("asks", F.col("comp") != F.col("major"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("node"), F.when(F.col("asks"), F.col("n_minor")).otherwise(F.col("n_major"))).cast("int"))
    # A task is (unit, minor chunk, kind of the other chunk, other chunk); minor chunks also meet each other.
    tasks = F.when(F.col("asks"), F.expr(
        "concat(transform(sequence(0, n_major - 1), j -> struct(chunk AS i, 0 AS kind, j AS j)),"
        " transform(sequence(0, n_minor - 1), j -> struct(least(chunk, j) AS i, 1 AS kind, greatest(chunk, j) AS j)))"
    )).otherwise(F.expr("transform(sequence(0, n_minor - 1), i -> struct(i AS i, 0 AS kind, chunk AS j))"))
    spread = rows.select("node", "comp", "asks", "unit", F.explode(tasks).alias("t"))
    return spread.select("node", "comp", "asks", F.xxhash64("unit", "t.i", "t.kind", "t.j").alias("task"))


def _weighted(rows: list[tuple[int, int, float]]) -> pa.RecordBatch:
    columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b", "bound"])


def _sets(docs: DataFrame, prints: DataFrame, clustered: DataFrame) -> DataFrame:
    """(node, cluster, size, set) of the clustered nodes, from a second pass over the texts: one document for each node."""
    one = F.min(F.struct(F.col("doc_id").alias("rep_id"), F.col("text_hash").alias("rep_hash"))).alias("rep")
    reps = prints.select("doc_id", "text_hash", "node").join(clustered, "node").groupBy("node", "cluster", "size").agg(one).select("node", "cluster", "size", "rep.*")
    bounded = F.broadcast(reps) if reps.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else reps
    wanted = docs.select("doc_id", "text", text_hash()).join(bounded, F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("text_hash") == F.col("rep_hash")))
    held: list[Shingler] = []

    def run(batch: pa.RecordBatch) -> dict:
        shingler = held[0] if held else held.append(Shingler()) or held[0]
        made = [shingler.set_of(t.as_py()) for t in batch.column(batch.schema.get_field_index("text"))]
        return {"set": [s.tobytes() for s in made], "own": [node_of(s) for s in made]}

    made = with_columns(wanted, [field("set", "binary"), field("own", "long")], run)
    return made.where("own = node").select("node", "cluster", "size", "set").dropDuplicates(["node"])


LINKS = T.StructType([field("a", "long"), field("b", "long")])


def _local(sets: DataFrame) -> DataFrame:
    """Links (a, b) of small clusters (node, cluster, set): sorted partitions, a cluster at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _runs(batches):
            nodes, members = [r[0] for r in rows], [np.frombuffer(r[1], np.uint64) for r in rows]
            found = tree_join(members, list(range(len(nodes))))
            if found:
                yield _links([(nodes[i], nodes[j]) for i, j in found])

    return sets.select("cluster", "node", "set").repartition("cluster").sortWithinPartitions("cluster", "node").mapInArrow(run, LINKS)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Consecutive rows with one value in the first column."""
    held, last = [], None
    for batch in batches:
        for first, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if first != last and held:
                yield last, held
                held = []
            last = first
            held.append(tuple(rest))
    if held:
        yield last, held


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])


def _large(spark: SparkSession, sets: DataFrame, met: DataFrame, forest: DataFrame, cap: int, unit_cap: int) -> DataFrame:
    """Links (a, b) that give the components of large clusters; sets: (node, cluster, size, set)."""
    nodes = written(spark, sets.select("node", "cluster", "size"), "large")
    sets = sets.select("node", "set")
    both = forest.unionByName(forest.select(F.col("b").alias("a"), F.col("a").alias("b"), "bound")).join(nodes.select(F.col("node").alias("a")), "a", "left_semi")
    best = F.row_number().over(W.partitionBy("a").orderBy(F.desc("bound"), "b"))
    pairs = both.withColumn("k", best).where(F.col("k") <= PARTNERS).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    stars = written(spark, _verified(pairs, sets), "stars")
    comps = written(spark, nodes.join(components(spark, stars), "node", "left").select("node", "cluster", "size", F.coalesce("root", "node").alias("comp")), "comps")

    whole = comps.where(F.col("size") <= unit_cap).select(F.col("cluster").alias("unit"), "node", "comp")
    by_key = met.select(F.col("key").alias("unit"), "node").join(comps.where(F.col("size") > unit_cap).select("node", "comp"), "node")
    units = whole.unionByName(by_key.select("unit", "node", "comp"))
    keyed = _minor_tasks(units, cap)
    shipped = keyed.join(sets, "node").select("task", "node", "comp", "asks", "set").repartition("task").sortWithinPartitions("task", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, members in _runs(batches):
            found = tree_join([np.frombuffer(m[3], np.uint64) for m in members], [m[1] for m in members], [m[2] for m in members])
            if found:
                yield _links([(members[i][0], members[j][0]) for i, j in found])

    return stars.unionByName(shipped.mapInArrow(run, LINKS))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each group of near duplicates: the smallest (doc_id, text hash); empty sets all stay."""
    found = written(docs.sparkSession, jaccard_components(docs, **options), "components")
    grouped = found.where("n_shingles > 0")
    first = grouped.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first"))
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    # A group without any id has a null name; its rows that share no text are told apart by the text.
    named = grouped.where("component_id IS NOT NULL").join(first.where("component_id IS NOT NULL"), "component_id")
    gone = named.where(~same).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    bounded = F.broadcast(gone) if gone.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else gone
    mark, lost_id, lost_hash = (unused(docs, n) for n in ("own", "lost_id", "lost_hash"))
    own = docs.withColumn(mark, text_hash())
    bounded = bounded.select(F.col("_id").alias(lost_id), F.col("_hash").alias(lost_hash))
    kept = own.join(bounded, F.col("doc_id").eqNullSafe(F.col(lost_id)) & (F.col(mark) == F.col(lost_hash)), "left_anti")
    repeated = grouped.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1")
    if not repeated.isEmpty():  # equal rows: only then is a shuffle of the texts needed
        kept = kept.dropDuplicates(["doc_id", mark])
    return kept.drop(mark)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents")).drop("text_hash")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * common >= 80 * (na.n + nb.n - common)),
reach AS (SELECT DISTINCT a AS doc_id, a AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.least, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, min(other) AS least FROM reach GROUP BY doc_id) c ON c.doc_id = d.doc_id
"""

QUERIES = {"op8_ngram_jaccard_join": op8_ngram_jaccard_join}
ORACLES = {"op8_ngram_jaccard_join": ORACLE}
