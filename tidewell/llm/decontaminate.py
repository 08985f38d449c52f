"""Benchmark decontamination by spaced-seed hashing (DataFrame functions only).

Texts are lower-cased and cut into words (runs of letters, marks and digits).  Each of the fixed MASKS lists the positions of a
span that count; the others are ignored, so a window still matches where words at ignored
positions were substituted.  Masked hashes of all benchmark windows are joined with those of all training
windows.  Each hit fixes an alignment (document, item, diagonal); the document's words along
the whole item are compared with it, and the best-scoring segment around the hit (1 for an equal word, -2 for
another) must have MIN_EQUAL equal words, or all words of a shorter item, and a share of MIN_SHARE equal ones.

The documents' windows are generated, hashed and probed inside one stage: only hits leave
it.  The benchmark's places (hash, item, position) are broadcast while they are at most MAX_BROADCAST_ROWS
(counted first); a larger benchmark is joined by shuffle, for which a window is three numbers: a document's words are
joined again to its distinct alignments only.  A hash that many items share is a row for each place, never a list, so
that a skewed one can be split.  A passage in very many documents gives rows in
proportion to its occurrences, in the partition of each document: nothing is grouped by passage.
Items with the same words are compared once and named by the smallest item_id; `n_items` says how many there are.

Defined cases: null and empty texts give no words and no hit; an item of fewer words than the
shortest span is matched as a whole by a contiguous window of its length; items without words never match;
rows with the same doc_id are reported together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import read, unused, written

#: Fixed spaced seeds, each of weight 6; a 0 ignores the word at its position.
MASKS = ["11011011", "1101000111", "110010101001"]
MIN_EQUAL = 10
MIN_SHARE = 0.75
MAX_BROADCAST_ROWS = 400_000
#: Documents to drop up to which their keys are broadcast; more are joined by shuffle.
MAX_DROPS = 2_000_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def positions(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def masked_windows(rows: DataFrame, keep: list[str], hashes: str, masks: list[str]) -> DataFrame:
    """keep columns, at (window start) and key (hash of mask number and the words that count), for every window of every mask."""
    shortest = min(map(len, masks))
    starts = rows.where(F.size(hashes) >= shortest).select(*keep, hashes, F.explode(F.sequence(F.lit(0), F.size(hashes) - shortest)).alias("at"))
    keys = []
    for number, mask in enumerate(masks):
        picked = [F.get(hashes, F.col("at") + p) for p in positions(mask)]
        key = F.xxhash64(F.lit(number), *picked)
        keys.append(key if len(mask) == shortest else F.when(F.col("at") + len(mask) <= F.size(hashes), key))
    wide = starts.select(*keep, hashes, "at", *[k.alias(f"_k{i}") for i, k in enumerate(keys)])
    return wide.select(*keep, hashes, "at", F.explode(F.array(*[f"_k{i}" for i in range(len(masks))])).alias("key")).where("key IS NOT NULL")


def benchmark_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct items: item_id (smallest), n_items, item (word hashes)."""
    hashed = benchmark.select(F.col(id_col).alias("item_id"), F.transform(words(F.col(text_col)), lambda w: F.xxhash64(w)).alias("item"))
    return hashed.where(F.size("item") > 0).groupBy("item").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n_items"))


def overlaps(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", masks: list[str] | None = None, min_equal: int = MIN_EQUAL, min_share: float = MIN_SHARE, max_broadcast: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """(id, item_id, n_items, doc_at, item_at, length, equal): verified overlaps, the best of each document and item."""
    masks = masks or MASKS
    items = benchmark_items(benchmark)
    short = [r["n"] for r in items.select(F.size("item").alias("n")).where(F.col("n") < min(map(len, masks))).distinct().collect()]  # lengths, fewer than a mask's
    hashed = docs.select(F.col(id_col).alias("_id"), F.xxhash64(id_col, text_col).alias("_row"), F.transform(words(F.col(text_col)), lambda w: F.xxhash64(w)).alias("_h"))
    found = None
    for group in [masks, *[["1" * n] for n in sorted(short)]]:
        own = items if group is masks else items.where(F.size("item") == len(group[0]))
        found = _hits(hashed, own, group, max_broadcast) if found is None else found.unionByName(_hits(hashed, own, group, max_broadcast))
    scored = found.select("_id", "item_id", "n_items", "diagonal", "item", _segment(min_equal, min_share).alias("s")).where("s.equal >= least(size(item), %d) AND s.equal >= %s * s.length" % (min_equal, min_share))
    best = scored.groupBy("_id", "item_id").agg(F.max(F.struct(F.col("s.equal").alias("equal"), (-F.col("s.length")).alias("neg"), (-F.col("s.start")).alias("start"), (-F.col("diagonal")).alias("diagonal"), "n_items")).alias("b"))
    return best.select(
        F.col("_id").alias(id_col), "item_id", "b.n_items", (-F.col("b.diagonal") - F.col("b.start")).cast("long").alias("doc_at"), (-F.col("b.start")).cast("long").alias("item_at"),
        (-F.col("b.neg")).cast("long").alias("length"), F.col("b.equal").cast("long").alias("equal"),
    )


def _hits(hashed: DataFrame, items: DataFrame, masks: list[str], max_broadcast: int) -> DataFrame:
    """(_id, item_id, n_items, item, diagonal, window): the alignments of all hits; window holds the document's words along the item."""
    seeds = masked_windows(items, ["item_id"], "item", masks).select("key", "item_id", F.col("at").alias("item_at"), F.size("item").alias("n")).distinct()
    diagonal = (F.col("at") - F.col("item_at")).alias("diagonal")
    small = seeds.limit(max_broadcast + 1).count() <= max_broadcast
    if small:
        aligned = masked_windows(hashed, ["_id"], "_h", masks).join(F.broadcast(seeds), "key").select("_id", "_h", "item_id", "n", diagonal)
    else:
        hits = masked_windows(hashed, ["_row"], "_h", masks).select("_row", "at", "key").join(seeds, "key")
        aligned = hits.select("_row", "item_id", "n", diagonal).distinct().join(hashed, "_row")
    begin = F.greatest("diagonal", F.lit(0))
    window = F.slice("_h", begin + 1, F.greatest(F.least(F.size("_h"), F.col("diagonal") + F.col("n")) - begin, F.lit(0)))
    once = aligned.select("_id", "item_id", "diagonal", window.alias("window")).dropDuplicates(["_id", "item_id", "diagonal", "window"])
    return once.join(F.broadcast(items) if small else items, "item_id")


def _segment(min_equal: int, min_share: float) -> Column:
    """The best-scoring run of the comparison along the item: struct(start, length, equal)."""
    base = F.greatest(-F.col("diagonal"), F.lit(0))
    equal = F.transform("window", lambda w, i: w == F.get("item", i + base))
    zero = F.struct(*[F.lit(0).alias(n) for n in ("i", "score", "start", "hit", "best", "b_start", "b_len", "b_hit")])

    def step(s: Column, same: Column) -> Column:
        fresh = s["score"] <= 0
        score = F.when(fresh, F.lit(0)).otherwise(s["score"]) + F.when(same, 1).otherwise(-2)
        start = F.when(fresh, s["i"]).otherwise(s["start"])
        hit = F.when(fresh, F.lit(0)).otherwise(s["hit"]) + same.cast("int")
        better = score > s["best"]
        pick = lambda a, b: F.when(better, a).otherwise(b)
        return F.struct(
            (s["i"] + 1).alias("i"), score.alias("score"), start.alias("start"), hit.alias("hit"), pick(score, s["best"]).alias("best"),
            pick(start, s["b_start"]).alias("b_start"), pick(s["i"] + 1 - start, s["b_len"]).alias("b_len"), pick(hit, s["b_hit"]).alias("b_hit"),
        )

    return F.aggregate(equal, zero, step, lambda s: F.struct((s["b_start"] + base).alias("start"), s["b_len"].alias("length"), s["b_hit"].alias("equal")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a verified overlap; each row is judged by its own id and text."""
    row = unused(docs, "row")
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    leaks = written(docs.sparkSession, overlaps(keyed.select(row, "text"), benchmark, id_col=row, **options).select(row).distinct(), "leaks")  # counted and joined
    bounded = F.broadcast(leaks) if leaks.limit(MAX_DROPS + 1).count() <= MAX_DROPS else leaks
    return keyed.join(bounded, row, "left_anti").drop(row)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {"op3_benchmark_decontamination": op3_benchmark_decontamination}
ORACLES: dict[str, str] = {}
