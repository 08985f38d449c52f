"""Line dedup by a log-template tree of fixed depth.

Lines are cut into words at any Unicode white space, as str.split() does; words with a digit are variable fields.  A line's path in the tree is its
word count and its LEVELS leading words (variable ones as `<*>`).  Lines below one path
form a leaf; there a line joins the first template that agrees with it in a share SIMILARITY of
its positions, where two variable fields agree, and in fixed words in a share LEAST_FIXED, so that rows of numbers aren't
taken for one another.  Positions that differ become open and agree with nothing, so a template keeps those shares.  A template that occurs in two documents or more recurs: its
lines are dropped, but for the first (smallest doc_id, then place), so that no text leaves the corpus altogether
(`keep_first=False` drops that one too).  Lines of fewer than MIN_WORDS words are never dropped.

Distributed form: one pass over the texts writes a row for each line (hash, path, the line itself), and all later steps read
columns of that table.  Equal lines are folded to fixed-width counts before the first shuffle, so a line
that is in a third of all documents is one row of its leaf.  Words are needed only of the lines of leaves with
two distinct lines or more; those are parsed leaf by leaf in sorted partitions, line by line, so that a task holds templates and no lines.
A line and the founding line of its template share a block of positions (`blocks_of`), so a leaf of more than MAX_LEAF
distinct lines is split into the components of lines that share blocks: what could meet in the whole leaf meets
there, in the same order, and the drops are the same at any MAX_LEAF.  Lines are told apart by two 64-bit hashes.
A template's first document is known from the distinct lines; which of its places there comes first is found
document by document, so nothing is ever grouped by template but the distinct lines.  Drops travel as
(doc_id, text hash, places) and meet the documents in one join.

Defined cases: null and empty texts have no lines and stay as they are; rows that are equal in doc_id and text are one
document and keep the same lines; rows that share a doc_id but not a text are one document when lines are counted, and each keeps its
own first place; all rows with a null doc_id count as one document, the last; a document that loses all its lines keeps an empty text.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import field, pieces, read, unused, written
from tidewell.llm.components import components

LEVELS = 3
SIMILARITY = 0.8
#: Share of a line's words that must be fixed words of its template.
LEAST_FIXED = 0.5
MIN_WORDS = 5
#: Distinct lines above which a leaf is split for parallelism; it has no bearing on the result.
MAX_LEAF = 2_000
#: Rows up to which a counted table is broadcast; a larger one is joined by shuffle.
MAX_BROADCAST = 500_000
#: Bytes of drops (two keys, a row's overhead and its places) up to which they are broadcast to the texts; beyond, the texts are shuffled once.
MAX_DROP_BYTES = 32 << 20
#: Rows of an Arrow batch that a pass over the texts gives out.
BATCH_ROWS = 16_384
_DIGIT = re.compile(r"\d")
VARIABLE = "<*>"


def blocks_of(n_words: int, similarity: float) -> list[tuple[int, int]]:
    """The positions behind the path, cut into one block more than the positions in which a line may differ from its template.

    So a line agrees with the founding line of its template in one whole block at least.
    """
    parts, start = n_words - math.ceil(similarity * n_words) + 1, min(LEVELS, n_words)
    return list(pairwise(start + (n_words - start) * i // parts for i in range(parts + 1)))


class Leaf:
    """The templates of a leaf, in the order in which lines found them; its memory grows with the templates, not with the lines."""

    def __init__(self, n_words: int, similarity: float = SIMILARITY):
        self.need, self.fixed, self.blocks = similarity * n_words, LEAST_FIXED * n_words, blocks_of(n_words, similarity)
        self.templates: list[list[str | None]] = []  # None: an open position
        self.founded: dict[tuple, list[int]] = {}  # a block's words: the templates whose founding line has them there

    def add(self, words: list[str]) -> int:
        """The number of the first template that agrees with the line, or of the one that it founds."""
        keys = [(begin, *words[begin:end]) for begin, end in self.blocks]
        for k in sorted({k for key in keys for k in self.founded.get(key, ())}):
            both = [a if a == b else None for a, b in zip(self.templates[k], words, strict=True)]
            same = len(both) - both.count(None)
            if same >= self.need and same - both.count(VARIABLE) >= self.fixed:
                self.templates[k] = both
                return k
        for key in keys:
            self.founded.setdefault(key, []).append(len(self.templates))
        self.templates.append(list(words))
        return len(self.templates) - 1


def parse_leaf(lines: list[list[str]], similarity: float = SIMILARITY) -> list[int]:
    """The template number of each line of a leaf; lines: lists of as many words each, in a fixed order."""
    leaf = Leaf(len(lines[0]) if lines else 0, similarity)
    return [leaf.add(words) for words in lines]


def _words_of(line: str) -> list[str]:
    return [VARIABLE if _DIGIT.search(w) else w for w in line.split()]


def occurrences(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, doc_hash, place, line_hash, leaf, line) of every line that may be dropped; leaf: a hash of the line's path in the tree."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("doc_hash"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, masked = xxhash.xxh64_intdigest, lambda w: VARIABLE if _DIGIT.search(w) else w
        for batch in pieces(batches):
            at, places, hashes, leaves, lines = [], [], [], [], []
            for i, text in enumerate(batch.column(2)):
                for place, line in enumerate(text.as_py().split("\n")):
                    words = line.split()
                    if len(words) < min_words:
                        continue
                    at.append(i)
                    places.append(place)
                    hashes.append(digest(line.encode("utf-8", "surrogatepass"), 42))
                    leaves.append(digest("\n".join([str(len(words)), *map(masked, words[:LEVELS])]).encode("utf-8", "surrogatepass")))
                    lines.append(line)
                    if len(at) >= BATCH_ROWS:
                        yield _line_rows(batch, at, places, hashes, leaves, lines)
                        at, places, hashes, leaves, lines = [], [], [], [], []
            if at:
                yield _line_rows(batch, at, places, hashes, leaves, lines)

    made = [field("doc_hash", "long"), field("place", "int"), field("line_hash", "long"), field("leaf", "long"), field("line", "string")]
    return rows.mapInArrow(run, T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), *made]))


def _line_rows(batch: pa.RecordBatch, at: list[int], places: list[int], hashes: list[int], leaves: list[int], lines: list[str]) -> pa.RecordBatch:
    docs = pa.array(at, pa.int64())
    numbers = [pa.array(np.array(h, np.uint64).view(np.int64)) for h in (hashes, leaves)]
    columns = [batch.column(0).take(docs), batch.column(1).take(docs), pa.array(places, pa.int32()), *numbers, pa.array(lines, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "doc_hash", "place", "line_hash", "leaf", "line"])


def distinct_lines(lines: DataFrame) -> DataFrame:
    """(line_hash, leaf, low, high, no_id, times): fixed-width state only, so that lines fold in a hash table before the shuffle."""
    return lines.groupBy("line_hash", "leaf").agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max(F.col("doc_id").isNull().cast("int")).alias("no_id"), F.count("*").alias("times")
    )


def small_enough(df: DataFrame, most: int) -> DataFrame:
    """df, to be broadcast if a count shows that it has at most so many rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def block_edges(crowd: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): line hashes that share a block of words; a line and the template that it joins are never in different components of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, keys = [], []
            for line_hash, leaf, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = _words_of(line)
                for begin, end in blocks_of(len(words), similarity):
                    nodes.append(line_hash)
                    keys.append(int.from_bytes(hashlib.blake2b("\n".join([f"{leaf} {begin}", *words[begin:end]]).encode(), digest_size=8).digest(), "big", signed=True))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(keys, pa.int64())], names=["b", "key"])

    keys = crowd.select("line_hash", "leaf", "line").mapInArrow(run, T.StructType([field(n, "long") for n in ("b", "key")]))
    keys = written(crowd.sparkSession, keys, "blocks")
    shared = keys.groupBy("key").agg(F.min("b").alias("a"), F.max("b").alias("z")).where("a <> z").select("key", "a")
    return keys.join(shared, "key").select("a", "b")


def templates_of(crowd: DataFrame, similarity: float = SIMILARITY, max_leaf: int = MAX_LEAF) -> DataFrame:
    """(line_hash, leaf, template) of the lines (line_hash, leaf, line) of leaves with several; template: the hash of the line that founded it."""
    over = crowd.groupBy("leaf").agg(F.count("*").alias("size")).where(F.col("size") > max_leaf).select("leaf")
    done = crowd.withColumn("own", F.col("leaf"))
    if not over.isEmpty():
        over = small_enough(over, MAX_BROADCAST)
        large = crowd.join(over, "leaf", "left_semi")
        roots = components(crowd.sparkSession, block_edges(large, similarity)).select(F.col("node").alias("line_hash"), "root")
        parts = large.join(roots, "line_hash", "left").withColumn("own", F.coalesce("root", "line_hash")).drop("root")
        done = done.join(over, "leaf", "left_anti").unionByName(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leaf, founders = None, None, []
        for batch in batches:
            templates = []
            for own, line_hash, line in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                words = _words_of(line)
                if own != at:
                    at, leaf, founders = own, Leaf(len(words), similarity), []
                k = leaf.add(words)
                if k == len(founders):
                    founders.append(line_hash)
                templates.append(founders[k])
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(templates, pa.int64())], names=["line_hash", "leaf", "template"])

    ordered = done.select("own", "line_hash", "leaf", "line").repartition("own").sortWithinPartitions("own", "line_hash")
    return ordered.mapInArrow(run, T.StructType([field(n, "long") for n in ("line_hash", "leaf", "template")]))


def recurring(docs: DataFrame, *, similarity: float = SIMILARITY, min_words: int = MIN_WORDS, keep_first: bool = True, max_leaf: int = MAX_LEAF) -> DataFrame:
    """(doc_id, doc_hash, places): the line numbers that each document loses."""
    spark = docs.sparkSession
    lines = written(spark, occurrences(docs, min_words), "lines", "zstd")
    distinct = written(spark, distinct_lines(lines), "distinct")
    crowded = distinct.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1").select("leaf")
    crowd = lines.join(small_enough(crowded, MAX_BROADCAST), "leaf", "left_semi").select("line_hash", "leaf", "line").dropDuplicates(["line_hash", "leaf"])
    parsed = written(spark, templates_of(written(spark, crowd, "crowd"), similarity, max_leaf), "templates")
    known = distinct.join(parsed, ["line_hash", "leaf"], "left").withColumn("template", F.coalesce("template", "line_hash"))
    ids = [F.min("low").alias("first"), F.max("high").alias("last"), F.max("no_id").alias("any_null")]
    again = known.groupBy("template").agg(*ids).where("first <> last OR (any_null = 1 AND first IS NOT NULL)").select("template", "first")
    gone = written(spark, known.select("line_hash", "leaf", "template").join(again, "template"), "gone")
    places = lines.select("doc_id", "doc_hash", "place", "line_hash", "leaf").join(small_enough(gone, MAX_BROADCAST), ["line_hash", "leaf"])
    # One shuffle, by document: the templates of a document, then the document.
    owned = places.select("doc_id", "doc_hash", "place", "template", F.col("doc_id").eqNullSafe(F.col("first")).alias("is_first")).repartition("doc_id", "doc_hash")
    found = owned.groupBy("doc_id", "doc_hash", "template").agg(F.min("place").alias("least"), F.collect_set("place").alias("places"), F.max("is_first").alias("is_first"))
    lost = F.when(F.col("is_first"), F.array_remove("places", F.col("least"))).otherwise(F.col("places")) if keep_first else F.col("places")
    folded = found.groupBy("doc_id", "doc_hash").agg(F.sort_array(F.flatten(F.collect_list(lost))).alias("places"))
    return folded.where(F.size("places") > 0)


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """docs with the recurring lines cut out of text, and n_dropped; other columns stay (n_dropped is replaced)."""
    lost = written(docs.sparkSession, recurring(docs.select("doc_id", "text"), **options), "drops")
    size = lost.agg(F.count("*").alias("rows"), F.sum(F.size("places")).alias("places")).first()
    own, dropped, places = (unused(docs, n) for n in ("own", "dropped", "places"))
    lost = lost.select(F.col("doc_id").alias(dropped), F.col("doc_hash").alias(own), F.col("places").alias(places))
    lost = F.broadcast(lost) if 48 * size["rows"] + 4 * (size["places"] or 0) <= MAX_DROP_BYTES else lost
    kept = docs.drop("n_dropped")
    joined = kept.join(lost, F.col("doc_id").eqNullSafe(F.col(dropped)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(own)), "left")
    lines = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(places, i))
    text = F.when(F.col(places).isNull(), F.col("text")).otherwise(F.array_join(lines, "\n"))
    n = F.when(F.col(places).isNull(), F.lit(0)).otherwise(F.size(places)).cast("long")
    return joined.withColumn("n_dropped", n).withColumn("text", text).drop(dropped, own, places)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_dropped", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), "text")


QUERIES = {"op6_line_dedup": op6_line_dedup}
ORACLES: dict[str, str] = {}
