"""Registered queries: hierarchy, tempo, snapshots, duplicates, constants."""

from pyspark.sql import functions as F

from tidewell.operators import browse, tree
from tidewell.operators import midlayer as m
from tidewell.plans.q_browse import SEEN, SPAN
from tidewell.plans.registry import NOW, VIEWER, query

CLOSURE = {"closure_t": "SELECT cluster_id, cluster_id AS member FROM clusters UNION ALL SELECT parent, cluster_id FROM clusters WHERE parent IS NOT NULL"}


@query("SELECT * FROM closure_t", **CLOSURE)
def subtree(c):
    return tree.subtree(c.clusters)


@query("SELECT cluster_id, parent, level FROM clusters x WHERE NOT EXISTS (SELECT 1 FROM clusters y WHERE y.parent = x.cluster_id)")
def leaf_clusters(c):
    return m.leaf_clusters(c.clusters)


@query("SELECT t.cluster_id, count(DISTINCT c.card_id) AS size, min(card_ts) AS first_at, max(card_ts) AS last_at FROM closure_t t JOIN members m ON m.cluster_id = t.member JOIN cards c ON c.card_id = m.card_id GROUP BY t.cluster_id", **CLOSURE)
def communities(c):
    return m.communities(tree.subtree(c.clusters), c.members, c.cards)


MOMENT = "2024-01-02 12:00:00"


@query(
    f"""SELECT t.cluster_id, count(*) AS n_cards, CAST(sum(CASE WHEN card_ts > TIMESTAMP '{MOMENT}' - INTERVAL 24 HOUR AND card_ts <= TIMESTAMP '{MOMENT}' THEN 1 ELSE 0 END) AS BIGINT) AS n_24h, max(card_ts) AS last_at
    FROM closure_t t JOIN members m ON m.cluster_id = t.member JOIN cards c ON c.card_id = m.card_id WHERE {SEEN} GROUP BY t.cluster_id""",
    **CLOSURE,
)
def heat_top(c):
    return m.heat_top(tree.subtree(c.clusters), c.members, c.cards, VIEWER, MOMENT)


@query("SELECT card_id, CAST(sum(n) AS BIGINT) AS n_reads, string_agg(viewer || '=' || n, ',' ORDER BY viewer) AS viewers FROM (SELECT card_id, viewer, count(*) AS n FROM access WHERE source = 'search' GROUP BY ALL) GROUP BY card_id")
def read_heat(c):
    heat = m.read_heat(c.access)
    return heat.select("card_id", "n_reads", F.array_join(F.transform(F.map_entries("viewers"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("viewers"))


def tempo_sql(key: str) -> str:
    return f"""SELECT {key} AS k, CAST(total AS BIGINT) AS total, CAST(recent AS BIGINT) AS recent, span_days, round(spread, 6) AS spread, round(recent / total / least(7.0 / total_days, 1.0), 6) AS heat, round(cov, 6) AS cov,
      round(CASE WHEN total >= 4 THEN spread / (1 + cov) * ln(total + 1) END, 6) AS stability FROM (
      SELECT *, span_days / total_days AS spread, CASE WHEN span_days = 0 THEN 999.0 ELSE sqrt(greatest(squares / weeks - (total / weeks) * (total / weeks), 0)) / (total / weeks) END AS cov FROM (
        SELECT {key}, sum(n) AS total, sum(recent) AS recent, CAST((epoch_us(max(hi)) - epoch_us(min(lo))) // 86400000000 AS BIGINT) AS span_days, max(total_days) AS total_days, max(week) - min(week) + 1 AS weeks, CAST(sum(n * n) AS DOUBLE) AS squares FROM (
          SELECT {key}, week, count(*) AS n, sum(CASE WHEN card_ts > last_all - INTERVAL 7 DAY THEN 1 ELSE 0 END) AS recent, min(card_ts) AS lo, max(card_ts) AS hi, max(total_days) AS total_days FROM (
            SELECT *, (epoch_us(card_ts) - epoch_us(first_all)) // 604800000000 AS week, greatest((epoch_us(last_all) - epoch_us(first_all)) // 86400000000, 1) AS total_days
            FROM dated_t, (SELECT min(card_ts) AS first_all, max(card_ts) AS last_all FROM dated_t)) GROUP BY {key}, week) GROUP BY {key}))"""


TEMPO = {"dated_t": "SELECT m.card_id, m.cluster_id, split_part(m.cluster_id, '.', 1) AS root, card_ts FROM members m JOIN cards c ON c.card_id = m.card_id", "leaf_t": tempo_sql("cluster_id"), "root_t": tempo_sql("root")}
CLASS = """CASE WHEN heat > 2 AND recent >= 2 THEN 'heating' WHEN heat < 0.3 AND total >= 8 AND spread > 0.3 THEN 'cooling' WHEN heat >= 0.6 AND heat <= 1.5 AND total >= 6 AND spread > 0.5 THEN 'steady' END"""


def rooted(c):
    return c.members.withColumn("root", F.split_part("cluster_id", F.lit("."), F.lit(1)))


@query("SELECT k AS cluster_id, total, recent, span_days, spread, heat, cov FROM leaf_t", **TEMPO)
def tempo_leaf(c):
    return m.tempo(c.members, c.cards, "cluster_id").drop("stability")


@query("SELECT k AS root, total, recent, span_days, spread, heat, cov FROM root_t", **TEMPO)
def tempo_root(c):
    return m.tempo(rooted(c), c.cards, "root").drop("stability")


@query("SELECT k AS cluster_id, stability FROM leaf_t WHERE stability IS NOT NULL", **TEMPO)
def tempo_background(c):
    return m.tempo(c.members, c.cards, "cluster_id").where("stability IS NOT NULL").select("cluster_id", "stability")


@query(f"SELECT k AS cluster_id, {CLASS} AS class FROM leaf_t", **TEMPO)
def tempo_drift(c):
    return m.drift(m.tempo(c.members, c.cards, "cluster_id")).select("cluster_id", "class")


@query("SELECT r.k AS root, r.heat AS root_heat, l.leaf, l.recent AS leaf_recent, l.n AS k FROM (SELECT k AS leaf, split_part(k, '.', 1) AS root, recent, CAST(row_number() OVER (PARTITION BY split_part(k, '.', 1) ORDER BY recent DESC, k) AS INTEGER) AS n FROM leaf_t WHERE recent > 0) l JOIN root_t r ON r.k = l.root WHERE l.n <= 4", **TEMPO)
def tempo_recent(c):
    leaves = m.tempo(c.members, c.cards, "cluster_id").select(F.col("cluster_id").alias("leaf"), F.split_part("cluster_id", F.lit("."), F.lit(1)).alias("root"), "recent", "heat")
    return m.tempo_recent(m.tempo(rooted(c), c.cards, "root"), leaves)


SNAP = {
    "old_t": "SELECT cluster_id, card_id FROM snapshots WHERE night = 'n1'",
    "new_t": "SELECT cluster_id, card_id FROM snapshots WHERE night = 'n2'",
    "overlap_t": "SELECT o.cluster_id AS old_id, n.cluster_id AS new_id, count(*) AS common, round(count(*) / max(s.size), 6) AS share FROM old_t o JOIN new_t n ON n.card_id = o.card_id JOIN (SELECT cluster_id, count(*) AS size FROM old_t GROUP BY cluster_id) s ON s.cluster_id = o.cluster_id GROUP BY ALL",
    "homes_t": "SELECT old_id, new_id FROM (SELECT *, row_number() OVER (PARTITION BY old_id ORDER BY share DESC, new_id) AS k FROM overlap_t) WHERE k = 1 AND share >= 0.5",
}


def nights(c):
    return [c.snapshots.where(F.col("night") == n).select("cluster_id", "card_id") for n in ("n1", "n2")]


@query("SELECT * FROM overlap_t", **SNAP)
def snapshot_overlap(c):
    return m.overlap(*nights(c))


@query(
    """SELECT CASE WHEN h.n IS NULL THEN 'new' WHEN h.n = 1 THEN 'continued' ELSE 'merged' END AS event, s.cluster_id, CASE WHEN h.n IS NULL THEN s.size WHEN h.n = 1 THEN s.size - o.common ELSE h.n END AS n
    FROM (SELECT cluster_id, count(*) AS size FROM new_t GROUP BY cluster_id) s LEFT JOIN (SELECT new_id, count(*) AS n, min(old_id) AS old_id FROM homes_t GROUP BY new_id) h ON h.new_id = s.cluster_id LEFT JOIN overlap_t o ON o.old_id = h.old_id AND o.new_id = s.cluster_id
    UNION ALL SELECT 'split', old_id, count(*) FROM overlap_t WHERE share >= 0.3 GROUP BY old_id HAVING count(*) >= 2""",
    **SNAP,
)
def tree_diff(c):
    return m.tree_diff(*nights(c))


@query("SELECT count(*) AS n_cards, CAST(sum(CASE WHEN h.new_id IS NULL OR h.new_id <> n.cluster_id THEN 1 ELSE 0 END) AS BIGINT) AS n_moved FROM old_t o JOIN new_t n ON n.card_id = o.card_id LEFT JOIN homes_t h ON h.old_id = o.cluster_id", **SNAP)
def reshuffle(c):
    return m.reshuffled(*nights(c))


@query(
    """SELECT new_id, CASE WHEN count(*) = 1 THEN 'continues ' || min(CASE WHEN j = 1 THEN old_id END) ELSE 'merges ' || min(CASE WHEN j = 1 THEN old_id END) || ' + ' || min(CASE WHEN j = 2 THEN old_id END) END AS note FROM (
      SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY k) AS j FROM (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY share DESC, old_id) AS k FROM overlap_t) WHERE share >= 0.3 OR k = 1) GROUP BY new_id""",
    **SNAP,
)
def lineage(c):
    return m.lineage(m.overlap(*nights(c)))


@query("SELECT DISTINCT CAST(ts AS DATE) AS night FROM events WHERE CAST(ts AS DATE) NOT IN (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events ORDER BY d DESC LIMIT 14)")
def prune_nights(c):
    return m.prune_nights(c.table("events").select(F.to_date("ts").alias("night")), 14)


@query(f"SELECT m.cluster_id, count(*) AS n_fresh, max(card_ts) AS newest FROM cards c JOIN members m ON m.card_id = c.card_id WHERE {SEEN} AND card_ts >= TIMESTAMP '2024-01-01 16:00:00' GROUP BY m.cluster_id")
def fresh_cards(c):
    return m.fresh_cards(c.cards, c.members, VIEWER, "2024-01-01", "Asia/Shanghai")


DUPS = {
    "sig_t": f"SELECT card_id, list(source_uuid ORDER BY source_uuid) AS ids FROM (SELECT DISTINCT card_id, source_uuid FROM ({SPAN})) GROUP BY card_id",
    "first_t": "SELECT ids, min(card_id) AS first FROM sig_t GROUP BY ids",
    "pairs_t": """SELECT f.first AS a, s.card_id AS b, CAST(len(s.ids) AS BIGINT) AS common, 1.0 AS jaccard, 1.0 AS containment FROM sig_t s JOIN first_t f ON f.ids = s.ids WHERE s.card_id <> f.first
      UNION ALL SELECT a, b, common, round(common / (na + nb - common), 6), round(common / least(na, nb), 6) FROM (
        SELECT x.first AS a, y.first AS b, CAST(len(list_intersect(x.ids, y.ids)) AS BIGINT) AS common, len(x.ids) AS na, len(y.ids) AS nb FROM first_t x JOIN first_t y ON x.first < y.first) WHERE common > 0 AND round(common / least(na, nb), 6) >= 0.85""",
    "both_t": "SELECT a, b FROM pairs_t UNION SELECT b, a FROM pairs_t",
    "reach_t": "RECURSIVE SELECT DISTINCT a AS card_id, a AS member FROM both_t UNION SELECT r.card_id, e.b FROM reach_t r JOIN both_t e ON e.a = r.member",
}


def signatures(c):
    return browse.card_spans(c.cards, c.turns).select("card_id", "source_uuid")


@query("SELECT a, b, common, CAST(jaccard AS DOUBLE) AS jaccard, CAST(containment AS DOUBLE) AS containment FROM pairs_t", **DUPS)
def dup_pairs(c):
    return m.duplicate_pairs(signatures(c))


@query("SELECT component, r.card_id, CAST(row_number() OVER (PARTITION BY component ORDER BY card_ts DESC, r.card_id) AS INTEGER) AS k FROM (SELECT card_id, min(member) AS component FROM reach_t GROUP BY card_id) r JOIN cards c ON c.card_id = r.card_id", **DUPS)
def dup_groups(c):
    return m.duplicate_groups(m.duplicate_pairs(signatures(c)), c.cards)


CONSTANTS = {
    "kept_t": f"""SELECT CAST(vec_id AS VARCHAR) AS constant_id, room, CASE WHEN mine AND vec_id % 4 = 2 THEN vec_id % 8 = 2 ELSE label % 2 = 0 END AS shared,
      CASE WHEN mine AND vec_id % 4 = 0 THEN 'a last ' || vec_id ELSE 'old ' || vec_id END AS content, NOT (mine AND vec_id % 4 = 1) AS active
    FROM (SELECT *, CASE WHEN label % 3 = 0 THEN '{VIEWER}' ELSE 'src' || (label + 10) END AS room, label % 3 = 0 AS mine FROM embeddings)
    UNION ALL SELECT 'new' || vec_id, '{VIEWER}', label % 2 = 1, 'added ' || vec_id, true FROM embeddings WHERE vec_id % 5 <> 0"""
}


def constants(c):
    """Constants of two kinds of rooms, and ops on all of them: two updates of one constant, retirements, a change of the flag alone, additions of which every fifth is blank."""
    e, v = c.table("embeddings"), F.col("vec_id").cast("string")
    old = e.select(v.alias("constant_id"), F.when(F.col("label") % 3 == 0, F.lit(VIEWER)).otherwise(F.concat(F.lit("src"), (F.col("label") + 10).cast("string"))).alias("room"), (F.col("label") % 2 == 0).alias("shared"), F.concat(F.lit("old "), v).alias("content"), F.lit(True).alias("active"))
    none, flag = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    op = lambda rows, seq, kind, name, content, shared: rows.select((F.col("vec_id") * 4 + seq).alias("seq"), F.lit(kind).alias("op"), name.alias("constant_id"), content.alias("content"), shared.alias("shared"))
    ops = op(e.where("vec_id % 4 = 0"), 1, "update", v, F.concat(F.lit(" a last "), v, F.lit(" ")), flag).unionByName(op(e.where("vec_id % 4 = 0"), 0, "update", v, F.concat(F.lit("z first "), v), flag))
    ops = ops.unionByName(op(e.where("vec_id % 4 = 1"), 0, "retire", v, none, flag)).unionByName(op(e.where("vec_id % 4 = 2"), 0, "update", v, none, F.col("vec_id") % 8 == 2))
    return old, ops.unionByName(op(e, 2, "add", F.concat(F.lit("new"), v), F.when(F.col("vec_id") % 5 == 0, " \n").otherwise(F.concat(F.lit("added "), v)), F.col("label") % 2 == 1))


@query("SELECT * FROM kept_t", **CONSTANTS)
def apply_constants(c):
    return m.apply_constants(*constants(c), VIEWER)


@query(f"SELECT constant_id, content FROM kept_t WHERE active AND (shared OR room = '{VIEWER}')", **CONSTANTS)
def active_constants(c):
    return m.active_constants(m.apply_constants(*constants(c), VIEWER), VIEWER).select("constant_id", "content")


@query("SELECT doc_id, string_agg(p, chr(10) ORDER BY i) AS text FROM (SELECT *, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)) WHERE r <= 700 OR i = 1 GROUP BY doc_id")
def trim_digest(c):
    return m.trim_paragraphs(c.table("documents"), "doc_id", "text", 700)


MAINLINE = CLOSURE | {
    "every_t": "SELECT card_id, cluster_id FROM members UNION ALL SELECT 'd#' || vec_id, 'L' || ((label + 3) % 10 % 3) || '.' || ((label + 3) % 10) FROM embeddings WHERE vec_id % 3 = 0 AND vec_id IN (SELECT doc_id FROM documents)",
    "kid_rows_t": "SELECT x.parent AS root, x.cluster_id, c.card_id, card_ts, headline FROM clusters x JOIN clusters r ON r.cluster_id = x.parent AND r.parent IS NULL JOIN closure_t t ON t.cluster_id = x.cluster_id JOIN every_t m ON m.cluster_id = t.member JOIN cards c ON c.card_id = m.card_id",
    "kids_t": """SELECT *, row_number() OVER (PARTITION BY root ORDER BY born, cluster_id) AS k FROM (SELECT root, cluster_id, count(*) AS n_cards, CAST(min(card_ts) AS DATE) AS born, CAST(max(card_ts) AS DATE) AS last_day,
      list(headline ORDER BY card_ts, card_id) AS heads FROM kid_rows_t GROUP BY root, cluster_id HAVING count(*) >= 4)""",
    "fold_t": """RECURSIVE SELECT root, k, heads[1] AS head, [heads[1]] AS used FROM kids_t WHERE k = 1
      UNION ALL SELECT n.root, n.k, coalesce(list_filter(n.heads, lambda h: NOT list_contains(f.used, h))[1], n.heads[1]), list_append(f.used, coalesce(list_filter(n.heads, lambda h: NOT list_contains(f.used, h))[1], n.heads[1]))
      FROM fold_t f JOIN kids_t n ON n.root = f.root AND n.k = f.k + 1""",
}
MAINLINE_SQL = f"""SELECT x.root, x.cluster_id, CAST(x.k AS INTEGER) AS k, n_cards, born, last_day, bright, head, heads[-1] AS tail, CASE WHEN bright AND heads[-2] <> heads[-1] THEN heads[-2] END AS near
  FROM (SELECT *, DATE '{NOW[:10]}' - last_day <= 6 AS bright FROM kids_t) x JOIN fold_t f ON f.root = x.root AND f.k = x.k"""


def all_members(c):
    """Primary members, and every third card also in another leaf, of its own root or of another."""
    other = (F.col("label") + 3) % 10
    e = c.table("embeddings").where("vec_id % 3 = 0").join(c.table("documents").select(F.col("doc_id").alias("vec_id")), "vec_id")
    return c.members.unionByName(e.select(F.concat(F.lit("d#"), F.col("vec_id").cast("string")).alias("card_id"), F.concat(F.lit("L"), (other % 3).cast("string"), F.lit("."), other.cast("string")).alias("cluster_id")))


@query(MAINLINE_SQL, **MAINLINE)
def mainline_paths(c):
    return m.mainline(c.clusters, tree.subtree(c.clusters), all_members(c), c.cards, NOW)
