"""Ranked search over cards: postings, BM25, all-terms pass, any-prefix pass, tag pass; search by vector.

Words are lower-cased, without accents, runs of letters, marks and digits; a run of ideographs, kana or Hangul gives its signs and its
pairs of neighbours, so that a word inside an unspaced sentence is found.  A query is a small list of term groups on the driver; of
a group's alternatives one must match with all its tokens.

Postings come from one pass over the cards, counted in the row: no token is shuffled.  `SearchIndex` keeps them as a stored table by
hash of the token, where a card's postings are replaced with the card; a query reads the buckets of its exact tokens, and for prefixes the
token column of all.  Without a stored index the same pass gives only the postings that a query can match.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewell.functions.columns import cosine, visible
from tidewell.store import VersionedTable, cut

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
FIELDS = ("headline", "share", "private")
PRIORITY_ALL, PRIORITY_ANY, PRIORITY_TAG = 0, 1, 2
MOST_TERMS = 12
#: The token of the row that holds a card's length.
CARD = ""
_WIDE = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}"
_RUN = regex.compile(rf"[{_WIDE}]+|[[\p{{L}}\p{{M}}\p{{N}}]--[{_WIDE}]]+", regex.V1)
_IS_WIDE, _MARKS, _WORD, _PLAIN = regex.compile(rf"[{_WIDE}]"), regex.compile(r"\p{Mn}+"), regex.compile(r"[\p{L}\p{M}\p{N}]+"), re.compile(r"[a-z0-9]+")
POSTINGS = "card_id string, room string, shared boolean, length int, field string, token string, tf int"


def fold(text: str) -> str:
    """Lower-cased, without accents."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", _MARKS.sub("", unicodedata.normalize("NFD", text.lower())))


def words_of(text: str | None) -> list[str]:
    """The index side's tokens, in order."""
    folded = fold(text or "")
    if folded.isascii():
        return _PLAIN.findall(folded)
    if not _IS_WIDE.search(folded):
        return _WORD.findall(folded)
    out: list[str] = []
    for run in _RUN.findall(folded):
        if _IS_WIDE.match(run):
            out += list(run) + [run[i : i + 2] for i in range(len(run) - 1)]
        else:
            out.append(run)
    return out


def terms(query: str, most: int = MOST_TERMS) -> list[list[str]]:
    """The term groups of a query: the tokens that a card must all have for each of its distinct runs.

    A run of wide signs asks for its sign, or for the pairs that cover it, so that `ABCD` is also found in `AB x CD`.  More than `most` runs are refused.
    """
    out: dict[str, list[str]] = {}
    for run in _RUN.findall(fold(query)):
        if not _IS_WIDE.match(run) or len(run) == 1:
            out[run] = [run]
        else:
            out[run] = list(dict.fromkeys([run[i : i + 2] for i in range(0, len(run) - 1, 2)] + [run[-2:]]))
    if len(out) > most:
        raise ValueError(f"a query has {most} terms at most")
    return list(out.values())


def flat(groups: list[list[str]]) -> list[str]:
    return list(dict.fromkeys(w for group in groups for w in group))


def postings(cards: DataFrame, wanted: Callable[[str], bool] | None = None) -> DataFrame:
    """(card_id, room, shared, length, field, token, tf): length counts the card's tokens over all fields; one row a card has the token CARD.

    wanted: which tokens are given out at all; lengths count every token.
    """
    rows = cards.select(F.col("card_id").cast("string"), F.col("room").cast("string"), F.coalesce(visible("", room="room"), F.lit(False)).alias("shared"), *FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for card, room, shared, *texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = [words_of(text) for text in texts]
                length = sum(map(len, words))
                if wanted is not None:
                    words = [[w for w in found if wanted(w)] for found in words]
                made = [("", CARD, 0)] + [(name, token, tf) for name, found in zip(FIELDS, words, strict=True) for token, tf in Counter(found).items()]
                for name, token, tf in made:
                    for column, value in zip(out, (card, room, shared, length, name, token, tf), strict=True):
                        column.append(value)
            kinds = [pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[n.split()[0] for n in POSTINGS.split(", ")])

    return rows.mapInArrow(run, POSTINGS)


def matching(cards: DataFrame, groups: list[list[str]]) -> DataFrame:
    """The postings that a query's tokens or prefixes can match, written once: all passes of a search read them."""
    prefixes = tuple(flat(groups))
    return cut(postings(cards, lambda token: token.startswith(prefixes)), "postings")


class SearchIndex:
    """Postings as a stored table, in buckets by token; cards are added and replaced by id."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.table, self.buckets = VersionedTable(spark, path), buckets

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(self.buckets)).cast("int"))

    def replace(self, cards: DataFrame) -> None:
        """Puts cards in, in place of those with the same ids."""
        self._write(postings(cards), cards.select("card_id"))

    def remove(self, ids: DataFrame) -> None:
        self._write(None, ids.select("card_id"))

    def _write(self, fresh: DataFrame | None, ids: DataFrame) -> None:
        old = self.table.read()
        kept = None if old is None else old.drop("bucket").join(ids, "card_id", "left_anti")
        rows = kept if fresh is None else fresh if kept is None else kept.unionByName(fresh)
        if rows is not None:
            version = self.table.stage(self._placed(rows).repartition("bucket").sortWithinPartitions("token"), partition_by=["bucket"])
            self.table.swap(version)

    def read(self, groups: list[list[str]], prefix: bool = True) -> DataFrame:
        """The postings that a query can match; without prefixes only its tokens' buckets are read."""
        rows, tokens = self.table.read(), [CARD, *flat(groups)]
        if not prefix:
            places = F.array(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(self.buckets)).cast("int") for t in tokens])
            wanted = [r for r in rows.sparkSession.range(1).select(places.alias("b")).first()["b"]]
            return rows.where(F.col("bucket").isin(wanted) & F.col("token").isin(tokens)).drop("bucket")
        return rows.where(reduce(lambda a, b: a | b, [F.col("token").startswith(t) for t in tokens[1:]], F.col("token") == CARD)).drop("bucket")


def bm25(index: DataFrame, totals: DataFrame, groups: list[list[str]], fields: list[str], allowed: Column, *, every: bool, prefix: bool) -> DataFrame:
    """(card_id, score): higher is better.  every: all groups must match.  totals: one row (n_cards, avg_length).

    A group's frequency is the least of its tokens'; with prefix every token is a group and counts all tokens that it begins.
    """
    asked = [[w] for w in flat(groups)] if prefix else groups
    tokens = flat(asked)
    wanted = reduce(lambda a, b: a | b, [F.col("token").startswith(w) for w in tokens]) if prefix else F.col("token").isin(tokens)
    hits = index.where(F.col("field").isin(fields)).where(wanted)
    test = (lambda w: F.col("token").startswith(w)) if prefix else (lambda w: F.col("token") == w)
    summed = [F.sum(F.when(test(w), F.col("tf")).otherwise(0)).alias(f"t{i}") for i, w in enumerate(tokens)]
    per_card = hits.withColumn("allowed", allowed).groupBy("card_id").agg(F.max("length").alias("length"), F.max("allowed").alias("allowed"), *summed)
    least = [F.least(*[F.col(f"t{tokens.index(w)}") for w in group]) if len(group) > 1 else F.col(f"t{tokens.index(group[0])}") for group in asked]
    found = per_card.select("card_id", "length", "allowed", *[c.alias(f"f{i}") for i, c in enumerate(least)])
    df = found.agg(*[F.sum((F.col(f"f{i}") > 0).cast("long")).alias(f"d{i}") for i in range(len(asked))])  # one row
    scored = found.where("allowed").crossJoin(F.broadcast(df)).crossJoin(F.broadcast(totals))  # rows of the query's hits with one row

    def part(i: int) -> Column:
        f, d = F.col(f"f{i}"), F.col(f"d{i}")
        idf = F.greatest(F.log((F.col("n_cards") - d + 0.5) / (d + 0.5)), F.lit(LEAST_IDF))
        return F.when(f > 0, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))).otherwise(0.0)

    n_found = sum(((F.col(f"f{i}") > 0).cast("int") for i in range(len(asked))), F.lit(0))
    score = sum((part(i) for i in range(len(asked))), F.lit(0.0))
    kept = scored.where(n_found == len(asked)) if every else scored.where(n_found > 0)
    return kept.select("card_id", F.round(score, 6).alias("score"))


def totals_of(index: DataFrame) -> DataFrame:
    return index.where(F.col("token") == CARD).agg(F.count("*").alias("n_cards"), F.avg("length").alias("avg_length"))


def text_search(index: DataFrame, groups: list[list[str]], viewer: str | None, *, every: bool, prefix: bool) -> DataFrame:
    """Both routes, the better score of a card: headline and share of visible cards, private of the viewer's own room."""
    totals = totals_of(index)
    own = F.lit(True) if viewer is None else F.col("room") == viewer
    seen = F.lit(True) if viewer is None else own | F.col("shared")
    a = bm25(index, totals, groups, ["headline", "share"], seen, every=every, prefix=prefix)
    b = bm25(index, totals, groups, ["private"], own, every=every, prefix=prefix)
    return a.unionByName(b).groupBy("card_id").agg(F.max("score").alias("score"))


def fts_snippet(text: str | None, prefixes: list[str], most: int = 8) -> str:
    """`most` words from the one in front of the first that matches, matches in 【】, cut ends as …; empty without a match."""
    words = (text or "").split()
    hit = [any(t.startswith(tuple(prefixes)) for t in words_of(w)) for w in words] if prefixes else []
    if not any(hit):
        return ""
    start = max(0, min(hit.index(True) - 1, len(words) - most))
    shown = [f"【{w}】" if h else w for w, h in zip(words, hit, strict=True)][start : start + most]
    return ("…" if start else "") + " ".join(shown) + ("…" if start + most < len(words) else "")


def reasons(found: DataFrame, cards: DataFrame, groups: list[list[str]], viewer: str | None) -> DataFrame:
    """found (a page of hits: card_id, priority, why) with why of text hits: where the words stand, unless the headline shows it."""
    prefixes = flat(groups)

    def why_of(headline, share, private):
        for text in (headline, share, private):
            if snippet := fts_snippet(text, prefixes):
                bare = snippet.replace("【", "").replace("】", "").strip("…")
                return "" if bare in " ".join((headline or "").split()) else snippet
        return ""

    own = F.col("private") if viewer is None else F.when(F.col("room") == viewer, F.col("private"))
    why = F.udf(why_of, "string", useArrow=True)
    told = found.join(cards.select("card_id", "room", *FIELDS), "card_id").withColumn("_why", why("headline", "share", own))
    return told.withColumn("why", F.when(F.col("priority") == PRIORITY_TAG, F.col("why")).otherwise(F.col("_why"))).select(*found.columns)


def tag_match(cards: DataFrame, card_tags: DataFrame, words: list[str], viewer: str | None) -> DataFrame:
    """(card_id, card_ts, why) of visible cards with a tag that holds one of the texts (two characters or more)."""
    wanted = [w for w in words if len(w) >= 2]
    if not wanted:
        return cards.where("false").select("card_id", "card_ts", F.lit("").alias("why"))
    hit = reduce(lambda a, b: a | b, [F.contains(F.lower("tag"), F.lit(w)) for w in wanted])
    tags = card_tags.where(hit).groupBy("card_id").agg(F.array_join(F.sort_array(F.collect_set("tag")), "、").alias("why"))
    return cards.where(visible(viewer)).join(tags, "card_id").select("card_id", "card_ts", "why")


def search(cards: DataFrame, index: DataFrame | None, card_tags: DataFrame, query: str, viewer: str | None, limit: int = 20, explain: bool = False) -> DataFrame:
    """(card_id, priority, score, why): cards with all terms, then with any term as a prefix, then by tag; each card once, at its first.

    index: postings, or None to take them from the cards.  explain: text hits get the words around their match as why.
    """
    groups = terms(query)
    none = cards.select("card_id", F.lit(0).alias("priority"), F.lit(0.0).alias("score"), F.lit("").alias("why")).limit(0)
    if not groups:
        return none
    index = matching(cards, groups) if index is None else index
    every = text_search(index, groups, viewer, every=True, prefix=False).select("card_id", F.lit(PRIORITY_ALL).alias("priority"), "score", F.lit("").alias("why"))
    some = text_search(index, groups, viewer, every=False, prefix=True).select("card_id", F.lit(PRIORITY_ANY).alias("priority"), "score", F.lit("").alias("why"))
    age = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("card_ts")) / 1e6  # newest first
    tags = tag_match(cards, card_tags, list(dict.fromkeys([query.strip().lower(), *flat(groups)])), viewer).select("card_id", F.lit(PRIORITY_TAG).alias("priority"), age.alias("score"), F.concat(F.lit("tag: "), "why").alias("why"))
    best = every.unionByName(some).unionByName(tags).groupBy("card_id").agg(F.min_by(F.struct("priority", "score", "why"), F.struct("priority", -F.col("score"))).alias("b"))
    found = best.select("card_id", "b.*").orderBy("priority", F.desc("score"), "card_id").limit(limit)
    return reasons(found, cards, groups, viewer).orderBy("priority", F.desc("score"), "card_id") if explain else found


def snippet(text: Column, words: list[str], width: int = 140, lead: int = 46) -> Column:
    """White space folded, a window that begins lead characters before the first term, with ellipses."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    found = F.array(*[F.nullif(F.instr(F.lower(flat), w), F.lit(0)) for w in words])
    start = F.greatest(F.coalesce(F.array_min(found), F.lit(1)) - 1 - lead, F.lit(0))
    body = F.substring(flat, start + 1, F.lit(width))
    return F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(start + width < F.length(flat), "…").otherwise(""))


def semantic_search(cards: DataFrame, vectors: DataFrame, query_vector: list[float], viewer: str | None, limit: int = 20) -> DataFrame:
    """(card_id, score): cosine with the whole card's vector in the viewer's own room, with the share's elsewhere; cards without a vector are left out."""
    vector = F.col("full_vec") if viewer is None else F.when(F.col("room") == viewer, F.col("full_vec")).otherwise(F.col("share_vec"))
    asked = F.array(*[F.lit(float(x)) for x in query_vector])
    rows = cards.where(visible(viewer)).select("card_id", "room").join(vectors.select("card_id", "full_vec", "share_vec"), "card_id")
    return rows.select("card_id", F.round(cosine(vector, asked), 6).alias("score")).orderBy(F.desc("score"), "card_id").limit(limit)


def history_terms(query: str, most: int = MOST_TERMS, longest: int = 200) -> list[str]:
    """The distinct words of a history query, case folded; an empty, too long or too wordy query is refused."""
    if not query.strip() or len(query.strip()) > longest:
        raise ValueError(f"a query is a text of 1 to {longest} characters")
    words = list(dict.fromkeys(w.casefold() for w in query.split()))
    if len(words) > most:
        raise ValueError(f"a query has {most} terms at most")
    return words


def history_search(nodes: DataFrame, roots: DataFrame, latest: DataFrame, words: list[str], limit: int = 20, offset: int = 0) -> DataFrame:
    """(context, n_hits, snippet_node, observed_at, rank): contexts whose component has all words.

    nodes: node_id, occurred_at, text.  roots: node_id, root.  latest: observations, one a context.
    """
    found = F.filter(F.array(*[F.when(F.instr(F.lower("text"), w) > 0, F.lit(i)) for i, w in enumerate(words)]), lambda x: x.isNotNull())
    hits = nodes.withColumn("found", found).where(F.size("found") > 0).join(roots, "node_id")
    per_root = hits.groupBy("root").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("found")))).alias("n_terms"), F.count("*").alias("n_hits"),
        F.min_by("node_id", F.struct(-F.size("found"), -F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("occurred_at")), "node_id")).alias("snippet_node"),
    ).where(F.col("n_terms") == len(words))
    contexts = latest.join(roots, "node_id").join(per_root, "root")
    order = W.orderBy(F.desc("observed_at"), F.desc("observation_id"))
    ranked = contexts.orderBy(F.desc("observed_at"), F.desc("observation_id")).offset(offset).limit(limit)
    return ranked.select("context", "n_hits", "snippet_node", "observed_at", (F.row_number().over(order) + offset).alias("rank"))
