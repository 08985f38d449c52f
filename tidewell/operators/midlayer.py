"""Cluster hierarchy, activity over time, nightly snapshots, duplicates, long-term constants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewell.functions.columns import blank, strip, visible
from tidewell.operators.components import components

MICROS_PER_DAY = 86_400_000_000


def _days(later: Column, earlier: Column) -> Column:
    """Whole days between two times."""
    return F.floor(F.timestamp_diff("MICROSECOND", earlier, later) / MICROS_PER_DAY)


def leaf_clusters(clusters: DataFrame) -> DataFrame:
    return clusters.join(clusters.select(F.col("parent").alias("cluster_id")), "cluster_id", "left_anti")


def communities(closure: DataFrame, members: DataFrame, cards: DataFrame) -> DataFrame:
    """(cluster_id, size, first_at, last_at) over a cluster and all below it; closure: cluster_id, member."""
    rows = closure.join(members.select(F.col("cluster_id").alias("member"), "card_id"), "member").join(cards.select("card_id", "card_ts"), "card_id")
    return rows.groupBy("cluster_id").agg(F.countDistinct("card_id").alias("size"), F.min("card_ts").alias("first_at"), F.max("card_ts").alias("last_at"))


def heat_top(closure: DataFrame, members: DataFrame, cards: DataFrame, viewer: str | None, now: str) -> DataFrame:
    """(cluster_id, n_cards, n_24h, last_at) of what the viewer sees; clusters without visible cards vanish."""
    moment = F.lit(now).cast("timestamp_ntz")
    seen = cards.where(visible(viewer)).select("card_id", "card_ts")
    rows = closure.join(members.select(F.col("cluster_id").alias("member"), "card_id"), "member").join(seen, "card_id").select("cluster_id", "card_id", "card_ts").distinct()
    day = (F.col("card_ts") > moment - F.expr("INTERVAL 24 HOURS")) & (F.col("card_ts") <= moment)
    return rows.groupBy("cluster_id").agg(F.count("*").alias("n_cards"), F.sum(day.cast("long")).alias("n_24h"), F.max("card_ts").alias("last_at"))


def read_heat(access: DataFrame, since: str | None = None) -> DataFrame:
    """(card_id, n_reads, viewers): searches that opened a card, and who did, as a map from viewer to count."""
    rows = access.where("source = 'search'")
    rows = rows if since is None else rows.where(F.col("read_at") >= F.lit(since).cast("timestamp_ntz"))
    counts = rows.groupBy("card_id", "viewer").agg(F.count("*").alias("n"))
    return counts.groupBy("card_id").agg(F.sum("n").alias("n_reads"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("viewer", "n")))).alias("viewers"))


def tempo(members: DataFrame, cards: DataFrame, key: str, window_days: int = 7) -> DataFrame:
    """A row for each key: total, recent, span_days, spread, heat, cov, stability.

    heat: the share of recent cards against the share that an even flow would give.  cov: deviation over mean of weekly counts, zero
    weeks between the first and the last included; 999 for a span of no days.
    """
    rows = members.select("card_id", key).distinct().join(cards.select("card_id", "card_ts"), "card_id").where("card_ts IS NOT NULL")
    ends = rows.agg(F.min("card_ts").alias("first_of_all"), F.max("card_ts").alias("last_of_all"))
    total_days = F.greatest(_days(F.col("last_of_all"), F.col("first_of_all")), F.lit(1))
    dated = rows.crossJoin(F.broadcast(ends)).withColumn("total_days", total_days).withColumn("week", F.floor(F.timestamp_diff("MICROSECOND", F.col("first_of_all"), F.col("card_ts")) / (7 * MICROS_PER_DAY)))
    recent = F.col("card_ts") > F.col("last_of_all") - F.expr(f"INTERVAL {int(window_days)} DAYS")
    weekly = dated.groupBy(key, "week").agg(F.count("*").alias("n"), F.sum(recent.cast("long")).alias("recent"), F.min("card_ts").alias("lo"), F.max("card_ts").alias("hi"), F.max("total_days").alias("total_days"))
    # Zero weeks add nothing to the sums, so mean and deviation come from the sums and the number of weeks.
    folded = weekly.groupBy(key).agg(
        F.sum("n").alias("total"), F.sum("recent").alias("recent"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("total_days").alias("total_days"),
        (F.max("week") - F.min("week") + 1).alias("weeks"), F.sum(F.col("n") * F.col("n")).alias("squares"),
    )
    mean = F.col("total") / F.col("weeks")
    cov = F.sqrt(F.greatest(F.col("squares") / F.col("weeks") - mean * mean, F.lit(0.0))) / mean
    full = folded.withColumn("span_days", _days(F.col("hi"), F.col("lo"))).withColumn("spread", F.col("span_days") / F.col("total_days")).withColumn("cov", F.when(F.col("spread") == 0, F.lit(999.0)).otherwise(cov))
    expected = F.least(F.lit(float(window_days)) / F.col("total_days"), F.lit(1.0))
    heat = F.col("recent") / F.col("total") / expected
    stability = F.when(F.col("total") >= 4, F.col("spread") / (1 + F.col("cov")) * F.log(F.col("total") + 1))
    six = lambda x: F.round(x, 6)
    return full.select(key, F.col("total").cast("long"), F.col("recent").cast("long"), F.col("span_days").cast("long"), six(F.col("spread")).alias("spread"), six(heat).alias("heat"), six(F.col("cov")).alias("cov"), six(stability).alias("stability"))


def drift(rows: DataFrame) -> DataFrame:
    """rows of tempo with class: heating, cooling, steady or null."""
    heat, spread = F.col("heat"), F.col("spread")
    kind = F.when((heat > 2) & (F.col("recent") >= 2), "heating").when((heat < 0.3) & (F.col("total") >= 8) & (spread > 0.3), "cooling").when((heat >= 0.6) & (heat <= 1.5) & (F.col("total") >= 6) & (spread > 0.5), "steady")
    return rows.withColumn("class", kind)


def tempo_recent(roots: DataFrame, leaves: DataFrame, top: int = 4) -> DataFrame:
    """(root, root_heat, leaf, leaf_recent, k): the hottest leaves with recent cards below each root; leaves: root, leaf, recent, heat."""
    rank = F.row_number().over(W.partitionBy("root").orderBy(F.desc("recent"), "leaf"))
    kept = leaves.where("recent > 0").withColumn("k", rank).where(F.col("k") <= top)
    return kept.join(roots.select("root", F.col("heat").alias("root_heat")), "root").select("root", "root_heat", "leaf", F.col("recent").alias("leaf_recent"), "k")


def overlap(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_id, new_id, common, share): share is the part of the old leaf in the new one; leaves: cluster_id, card_id."""
    size = old.groupBy(F.col("cluster_id").alias("old_id")).agg(F.count("*").alias("old_size"))
    pairs = old.select(F.col("cluster_id").alias("old_id"), "card_id").join(new.select(F.col("cluster_id").alias("new_id"), "card_id"), "card_id").groupBy("old_id", "new_id").agg(F.count("*").alias("common"))
    return pairs.join(size, "old_id").select("old_id", "new_id", "common", F.round(F.col("common") / F.col("old_size"), 6).alias("share"))


def homes(overlaps: DataFrame, least: float = 0.5) -> DataFrame:
    """(old_id, new_id): where half of an old leaf or more went; of equals the smallest name."""
    best = overlaps.groupBy("old_id").agg(F.min_by(F.struct("new_id", "share"), F.struct(-F.col("share"), "new_id")).alias("b"))
    return best.where(F.col("b.share") >= least).select("old_id", "b.new_id")


def tree_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(event, cluster_id, n): new, continued (n cards more) and merged leaves of the new night, split leaves of the old one."""
    found = overlap(old, new)
    home = homes(found).groupBy(F.col("new_id").alias("cluster_id")).agg(F.count("*").alias("n_homes"), F.min("old_id").alias("old_id"))
    sizes = new.groupBy("cluster_id").agg(F.count("*").alias("size"))
    kept = found.select("old_id", F.col("new_id").alias("cluster_id"), "common")
    rows = sizes.join(home, "cluster_id", "left").join(kept, ["cluster_id", "old_id"], "left")
    event = F.when(F.col("n_homes").isNull(), "new").when(F.col("n_homes") == 1, "continued").otherwise("merged")
    n = F.when(F.col("n_homes").isNull(), F.col("size")).when(F.col("n_homes") == 1, F.col("size") - F.col("common")).otherwise(F.col("n_homes"))
    split = found.where("share >= 0.3").groupBy(F.col("old_id").alias("cluster_id")).agg(F.count("*").alias("n")).where("n >= 2").select(F.lit("split").alias("event"), "cluster_id", "n")
    return rows.select(event.alias("event"), "cluster_id", n.cast("long").alias("n")).unionByName(split)


def reshuffled(old: DataFrame, new: DataFrame) -> DataFrame:
    """(n_cards, n_moved): cards of both nights, and those that are not in their old leaf's home."""
    home = homes(overlap(old, new))
    both = old.select(F.col("cluster_id").alias("old_id"), "card_id").join(new.select(F.col("cluster_id").alias("now_id"), "card_id"), "card_id").join(home, "old_id", "left")
    moved = F.col("new_id").isNull() | (F.col("new_id") != F.col("now_id"))
    return both.agg(F.count("*").alias("n_cards"), F.coalesce(F.sum(moved.cast("long")), F.lit(0)).cast("long").alias("n_moved"))


def lineage(overlaps: DataFrame) -> DataFrame:
    """(new_id, note): where a new leaf comes from: its sources of 0.3 or more, else the greatest one; a merge shows two."""
    w = W.partitionBy("new_id").orderBy(F.desc("share"), "old_id")
    ranked = overlaps.withColumn("k", F.row_number().over(w)).where((F.col("share") >= 0.3) | (F.col("k") == 1))
    grouped = ranked.groupBy("new_id").agg(F.array_sort(F.collect_list(F.struct("k", "old_id"))).alias("s"))
    return grouped.select("new_id", F.when(F.size("s") == 1, F.concat(F.lit("continues "), F.col("s")[0]["old_id"])).otherwise(F.concat(F.lit("merges "), F.col("s")[0]["old_id"], F.lit(" + "), F.col("s")[1]["old_id"])).alias("note"))


def prune_nights(nights: DataFrame, keep: int) -> DataFrame:
    """Nights beyond the newest `keep`; nights: night."""
    distinct = nights.select("night").distinct()
    return distinct.join(distinct.orderBy(F.desc("night")).limit(keep), "night", "left_anti")


def fresh_cards(cards: DataFrame, members: DataFrame, viewer: str | None, baseline: str | None, timezone: str = "UTC") -> DataFrame:
    """(cluster_id, n_fresh, newest): visible cards from the local midnight after the baseline night on; without a baseline all are fresh."""
    rows = cards.where(visible(viewer))
    if baseline is not None:
        cutoff = F.convert_timezone(F.lit(timezone), F.lit("UTC"), F.date_add(F.lit(baseline).cast("date"), 1).cast("timestamp_ntz"))
        rows = rows.where(F.col("card_ts") >= cutoff)
    return rows.join(members, "card_id").groupBy("cluster_id").agg(F.count("*").alias("n_fresh"), F.max("card_ts").alias("newest"))


def duplicate_pairs(signatures: DataFrame, containment: float = 0.85) -> DataFrame:
    """(a, b, common, jaccard, containment), a < b: cards whose source ids are the same or nearly contained; signatures: card_id, source_uuid.

    Pairs meet through an inverted index on the source id.  Cards with equal sets are folded to one before that, so a
    group of copies costs a row each and not a pair each; `b` of the fold is its smallest card.
    """
    sets = signatures.groupBy("card_id").agg(F.array_sort(F.collect_set("source_uuid")).alias("ids"))
    keyed = sets.select("card_id", F.size("ids").alias("n"), F.md5(F.array_join("ids", "|").cast("binary")).alias("fold"), "ids")
    same = keyed.groupBy("fold").agg(F.min("card_id").alias("first"), F.min("n").alias("n"))
    equal = keyed.join(same.select("fold", "first"), "fold").where("card_id <> first").select(F.col("first").alias("a"), F.col("card_id").alias("b"), F.col("n").cast("long").alias("common"), F.lit(1.0).alias("jaccard"), F.lit(1.0).alias("containment"))
    reps = keyed.join(same.select(F.col("first").alias("card_id")), "card_id", "left_semi").select("card_id", "n", F.explode("ids").alias("id"))
    pairs = reps.select("id", F.col("card_id").alias("a"), F.col("n").alias("na")).join(reps.select("id", F.col("card_id").alias("b"), F.col("n").alias("nb")), "id").where("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("common"))
    scored = pairs.select("a", "b", "common", F.round(F.col("common") / (F.col("na") + F.col("nb") - F.col("common")), 6).alias("jaccard"), F.round(F.col("common") / F.least("na", "nb"), 6).alias("containment"))
    return equal.unionByName(scored.where(F.col("containment") >= containment))


def duplicate_groups(pairs: DataFrame, cards: DataFrame) -> DataFrame:
    """(component, card_id, k): groups of duplicates; k orders the newest first."""
    found = components(pairs.select("a", "b"))
    rows = found.select(F.col("node").alias("card_id"), "component").join(cards.select("card_id", "card_ts"), "card_id")
    return rows.withColumn("k", F.row_number().over(W.partitionBy("component").orderBy(F.desc("card_ts"), "card_id"))).drop("card_ts")


def apply_constants(constants: DataFrame, ops: DataFrame, room: str) -> DataFrame:
    """constants (constant_id, room, shared, content, active) after a room's ops (seq, op, constant_id, content, shared) in order of seq.

    add: of content that isn't blank, under its id or one made of room, seq and content.  update: of the room's own constants; the last given
    content and the last given flag hold, null means not given.  retire: of the room's own.  Nobody changes another room's constant, shared or not.
    """
    changes = ops.where("op IN ('update', 'retire')").groupBy("constant_id").agg(
        F.max((F.col("op") == "retire").cast("int")).alias("_retire"),
        *[F.max_by(F.when(F.col("op") == "update", F.col(c)), F.when((F.col("op") == "update") & F.col(c).isNotNull(), F.col("seq"))).alias(f"_{c}") for c in ("content", "shared")],
    )
    own = F.col("room") == room
    joined = constants.join(changes, "constant_id", "left")
    old = joined.select(
        "constant_id", "room", F.when(own, F.coalesce("_shared", "shared")).otherwise(F.col("shared")).alias("shared"), F.when(own, F.coalesce(strip(F.col("_content")), "content")).otherwise(F.col("content")).alias("content"),
        F.when(own & (F.col("_retire") == 1), False).otherwise(F.col("active")).alias("active"),
    )
    made = F.concat(F.lit("k_"), F.substring(F.sha2(F.concat_ws("|", F.lit(room), F.col("seq").cast("string"), "content").cast("binary"), 256), 1, 8))
    added = ops.where("op = 'add'").where(~blank(F.col("content"))).select(F.coalesce("constant_id", made).alias("constant_id"), F.lit(room).alias("room"), F.coalesce("shared", F.lit(False)).alias("shared"), strip(F.col("content")).alias("content"), F.lit(True).alias("active"))
    return old.unionByName(added)


def active_constants(constants: DataFrame, room: str) -> DataFrame:
    """What a room is shown: the active constants that are shared, and its own."""
    return constants.where(F.col("active") & (F.col("shared") | (F.col("room") == room)))


def trim_paragraphs(texts: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """(key, text): leading paragraphs while their characters stay within most; the first one stays always."""
    parts = texts.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("i", "p"))
    running = F.sum(F.length("p")).over(W.partitionBy(key).orderBy("i"))
    kept = parts.withColumn("r", running).where((F.col("r") <= most) | (F.col("i") == 0))
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "p"))), lambda x: x["p"]), "\n").alias(text))


def mainline(clusters: DataFrame, closure: DataFrame, members: DataFrame, cards: DataFrame, now: str, bright_days: int = 6, least: int = 4) -> DataFrame:
    """(root, cluster_id, k, n_cards, born, last_day, bright, head, tail, near): the arc of each child of a root with `least` cards or more.

    A child's cards are those of all members, secondary ones included, of the child and all below it.  The children of a root go by the day
    of their first card, then by name; each is headed by its first headline that no sibling before it is headed by, or by its first one.  near: the last
    headline but one of a bright child (last card at most bright_days before now's day) of three cards or more, if it differs from the last.
    clusters: cluster_id, parent.  closure: cluster_id, member.

    A child before the k-th has used k - 1 heads at most, so k headlines of a child are all that the sequential rule needs; it is
    folded over the children of a root, a row each.
    """
    kids = clusters.join(clusters.where("parent IS NULL").select(F.col("cluster_id").alias("parent")), "parent").select(F.col("parent").alias("root"), "cluster_id")
    placed = kids.join(closure, "cluster_id").join(members.select(F.col("cluster_id").alias("member"), "card_id"), "member")
    rows = placed.join(cards.where("card_ts IS NOT NULL").select("card_id", "card_ts", "headline"), "card_id").select("root", "cluster_id", "card_id", "card_ts", "headline")
    down = W.partitionBy("root", "cluster_id").orderBy(F.desc("card_ts"), F.desc("card_id"))
    ends = rows.withColumn("_d", F.row_number().over(down)).groupBy("root", "cluster_id").agg(
        F.count("*").alias("n_cards"), F.to_date(F.min("card_ts")).alias("born"), F.to_date(F.max("card_ts")).alias("last_day"),
        F.max(F.when(F.col("_d") == 1, F.col("headline"))).alias("tail"), F.max(F.when(F.col("_d") == 2, F.col("headline"))).alias("second"),
    ).where(F.col("n_cards") >= least)
    ranked = ends.withColumn("k", F.row_number().over(W.partitionBy("root").orderBy("born", "cluster_id")))
    first = rows.groupBy("root", "cluster_id", "headline").agg(F.min(F.struct("card_ts", "card_id")).alias("at"))
    order = W.partitionBy("root", "cluster_id").orderBy("at")
    heads = first.withColumn("_p", F.row_number().over(order)).join(ranked.select("root", "cluster_id", "k"), ["root", "cluster_id"]).where("_p <= k")
    heads = heads.groupBy("root", "cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_p", "headline"))), lambda x: x["headline"]).alias("heads"))
    folded = ranked.join(heads, ["root", "cluster_id"]).groupBy("root").agg(F.sort_array(F.collect_list(F.struct("k", "cluster_id", "heads"))).alias("kids"))
    start = F.array().cast("array<string>")

    def step(used, kid):
        free = F.filter(kid["heads"], lambda h: ~F.array_contains(used, h))
        return F.concat(used, F.array(F.coalesce(F.get(free, F.lit(0)), kid["heads"][0])))

    dealt = folded.select("root", "kids", F.aggregate("kids", start, step).alias("used"))
    named = dealt.select("root", F.explode(F.arrays_zip(F.transform("kids", lambda x: x["cluster_id"]).alias("cluster_id"), F.col("used").alias("head"))).alias("x")).select("root", "x.*")
    bright = F.date_diff(F.to_date(F.lit(now)), "last_day") <= bright_days
    near = F.when(bright & (F.col("n_cards") >= 3) & ~F.col("second").eqNullSafe(F.col("tail")), F.col("second"))
    return ranked.join(named, ["root", "cluster_id"]).select("root", "cluster_id", "k", "n_cards", "born", "last_day", bright.alias("bright"), "head", "tail", near.alias("near"))
