"""Registered queries: history pages, nightly snapshots and their report, orders and names of trees."""

from pyspark.sql import functions as F

from tidewell.operators import history as h
from tidewell.operators import snapshot, tree
from tidewell.plans.q_browse import SEEN
from tidewell.plans.q_mid import CLOSURE
from tidewell.plans.q_search import ANC, LATEST, ROOTS
from tidewell.plans.registry import VIEWER, query
from tidewell.store import shared_dir

ROOM = "src4"


@query(f"SELECT observation_id, context, observed_at FROM latest_t WHERE room = '{ROOM}' AND source = 'chat' AND kind = 'cursor'", **LATEST)
def history_filtered(c):
    return tree.latest_observation(h.filtered(c.observations, room=ROOM, source="chat", kind="cursor")).select("observation_id", "context", "observed_at")


@query(
    f"""SELECT o.observation_id, coalesce(p.path, '') AS path FROM latest_t o LEFT JOIN (SELECT tip, string_agg(node_id, '|' ORDER BY distance DESC) AS path FROM anc GROUP BY tip) p ON p.tip = o.node_id AND o.kind = 'cursor'
    WHERE room = '{ROOM}'""",
    **LATEST, **ANC,
)
def history_paths(c):
    seen = tree.latest_observation(h.filtered(c.observations, room=ROOM))
    return h.cursor_paths(c.forest, seen).select("observation_id", F.array_join("path", "|").alias("path"))


@query(f"SELECT n.node_id, w.root, n.role FROM nodes n JOIN walk w ON w.node_id = n.node_id WHERE w.root IN (SELECT w2.root FROM latest_t o JOIN walk w2 ON w2.node_id = o.node_id WHERE o.room = '{ROOM}')", **LATEST, **ROOTS)
def history_nodes(c):
    roots = tree.node_root(c.forest).select("node_id", "root")
    return h.component_nodes(c.forest, roots, tree.latest_observation(h.filtered(c.observations, room=ROOM))).select("node_id", "root", "role")


@query(f"SELECT session_id, card_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY doc_id DESC) - 1 AS BIGINT) AS pos FROM cards WHERE {SEEN}")
def visible_order(c):
    """Ids in an order of their own (newest id first in each session); those that the viewer doesn't see go."""
    from tidewell.functions.columns import visible

    return h.visible_in_order(c.cards.select("session_id", "card_id", (-F.col("doc_id")).alias("pos")), c.cards.where(visible(VIEWER)))


@query("SELECT w.node_id, CAST(row_number() OVER (ORDER BY w.depth, n.occurred_at, w.node_id) - 1 AS BIGINT) AS pos FROM walk w JOIN nodes n ON n.node_id = w.node_id", **ROOTS)
def topological_order(c):
    return tree.topological(c.forest)


SIZES = CLOSURE | {"sizes_t": "SELECT t.cluster_id, count(DISTINCT m.card_id) AS size FROM closure_t t JOIN members m ON m.cluster_id = t.member GROUP BY t.cluster_id"}


def sizes(c):
    closure = tree.subtree(c.clusters)
    return closure.join(c.members.select(F.col("cluster_id").alias("member"), "card_id"), "member").groupBy("cluster_id").agg(F.countDistinct("card_id").alias("size"))


@query(
    """SELECT n.cluster_id, n.name, p.name AS parent_name FROM (SELECT x.cluster_id, x.parent, 'c' || lpad(CAST(row_number() OVER (ORDER BY coalesce(r.size, s.size) DESC, coalesce(x.parent, x.cluster_id), x.parent IS NOT NULL, s.size DESC, x.cluster_id) AS VARCHAR), 4, '0') AS name
      FROM clusters x JOIN sizes_t s ON s.cluster_id = x.cluster_id LEFT JOIN sizes_t r ON r.cluster_id = x.parent) n
    LEFT JOIN (SELECT x.cluster_id, 'c' || lpad(CAST(row_number() OVER (ORDER BY coalesce(r.size, s.size) DESC, coalesce(x.parent, x.cluster_id), x.parent IS NOT NULL, s.size DESC, x.cluster_id) AS VARCHAR), 4, '0') AS name
      FROM clusters x JOIN sizes_t s ON s.cluster_id = x.cluster_id LEFT JOIN sizes_t r ON r.cluster_id = x.parent) p ON p.cluster_id = n.parent""",
    **SIZES,
)
def cluster_names(c):
    return tree.numbered_clusters(c.clusters, sizes(c))


@query("SELECT x.parent, x.cluster_id, s.size, CAST(row_number() OVER (PARTITION BY x.parent ORDER BY s.size DESC, x.cluster_id) AS INTEGER) AS k FROM clusters x JOIN sizes_t s ON s.cluster_id = x.cluster_id", **SIZES)
def cluster_children(c):
    return tree.children(c.clusters, sizes(c))


#: Two nights of trees of two levels: cards lie in leaves, leaves below a root that depends on the night.
NIGHTS = {
    "night_members_t": "SELECT CASE night WHEN 'n1' THEN '2024-01-01' ELSE '2024-01-02' END AS night, cluster_id, card_id FROM snapshots WHERE card_id IN (SELECT card_id FROM cards)",
    "night_clusters_t": "SELECT DISTINCT night, cluster_id, 'P' || (CAST(substr(cluster_id, 2) AS INTEGER) % CASE night WHEN '2024-01-01' THEN 2 ELSE 3 END) AS parent FROM night_members_t UNION ALL SELECT DISTINCT night, 'P' || (CAST(substr(cluster_id, 2) AS INTEGER) % CASE night WHEN '2024-01-01' THEN 2 ELSE 3 END), NULL FROM night_members_t",
}


def night_tables(c):
    night = F.when(F.col("night") == "n1", "2024-01-01").otherwise("2024-01-02")
    members = c.snapshots.join(c.cards.select("card_id"), "card_id", "left_semi").select(night.alias("night"), "cluster_id", "card_id")
    above = F.concat(F.lit("P"), (F.substring("cluster_id", 2, 9).cast("int") % F.when(F.col("night") == "2024-01-01", 2).otherwise(3)).cast("string"))
    leaves = members.select("night", "cluster_id").distinct().withColumn("parent", above)
    return leaves.unionByName(leaves.select("night", F.col("parent").alias("cluster_id"), F.lit(None).cast("string").alias("parent")).distinct()), members


@query("SELECT night, cluster_id, cluster_id AS member FROM night_clusters_t UNION ALL SELECT night, parent, cluster_id FROM night_clusters_t WHERE parent IS NOT NULL", **NIGHTS)
def snapshot_subtree(c):
    return snapshot.subtree(night_tables(c)[0])


@query("SELECT night, count(DISTINCT cluster_id) AS n_clusters, count(*) AS n_members FROM night_members_t WHERE night = '2024-01-02' GROUP BY night UNION ALL SELECT '2024-01-03', count(DISTINCT cluster_id), count(*) FROM night_members_t WHERE night = '2024-01-01'", **NIGHTS)
def snapshot_nights(c):
    """Three nights written, the second one twice, two kept."""
    import uuid

    path = f"{shared_dir(c.spark)}/tidewell/{uuid.uuid4().hex}/nights"
    clusters, members = night_tables(c)
    for night, of in (("2024-01-01", "2024-01-01"), ("2024-01-02", "2024-01-01"), ("2024-01-02", "2024-01-02"), ("2024-01-03", "2024-01-01")):
        pick = lambda df, of=of: df.where(F.col("night") == of).drop("night")
        snapshot.write(c.spark, path, night, pick(clusters), pick(members), keep=2)
    return snapshot.read(c.spark, path)[1].groupBy("night").agg(F.countDistinct("cluster_id").alias("n_clusters"), F.count("*").alias("n_members"))


REPORT = NIGHTS | {
    "seen_t": f"SELECT card_id, card_ts FROM cards WHERE {SEEN}",
    "new_t": "SELECT cluster_id, card_id FROM night_members_t WHERE night = '2024-01-02'",
    "old_t": "SELECT cluster_id, card_id FROM night_members_t WHERE night = '2024-01-01'",
    "overlap_t": "SELECT o.cluster_id AS old_id, n.cluster_id AS new_id, count(*) AS common, round(count(*) / max(s.size), 6) AS share FROM old_t o JOIN new_t n ON n.card_id = o.card_id JOIN (SELECT cluster_id, count(*) AS size FROM old_t GROUP BY cluster_id) s ON s.cluster_id = o.cluster_id GROUP BY ALL",
    "homes_t": "SELECT old_id, new_id FROM (SELECT *, row_number() OVER (PARTITION BY old_id ORDER BY share DESC, new_id) AS k FROM overlap_t) WHERE k = 1 AND share >= 0.5",
    "note_t": """SELECT new_id, CASE WHEN count(*) = 1 THEN 'continues ' || min(CASE WHEN j = 1 THEN old_id END) ELSE 'merges ' || min(CASE WHEN j = 1 THEN old_id END) || ' + ' || min(CASE WHEN j = 2 THEN old_id END) END AS note FROM (
      SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY k) AS j FROM (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY share DESC, old_id) AS k FROM overlap_t) WHERE share >= 0.3 OR k = 1) GROUP BY new_id""",
    "fresh_t": "SELECT n.cluster_id, count(*) AS n_fresh FROM new_t n JOIN seen_t s ON s.card_id = n.card_id WHERE card_ts >= TIMESTAMP '2024-01-02 00:00:00' GROUP BY n.cluster_id",
    "reads_t": "SELECT a.card_id, viewer, count(*) AS n FROM access a JOIN seen_t s ON s.card_id = a.card_id WHERE source = 'search' AND read_at >= TIMESTAMP '2024-01-02 00:00:00' GROUP BY ALL",
}


@query(
    """SELECT 'community' AS section, row_number() OVER (ORDER BY n_cards DESC, key) AS place, key, n_cards, n_new, note FROM (
      SELECT x.parent AS key, count(DISTINCT s.card_id) AS n_cards, CAST(count(DISTINCT s.card_id) FILTER (card_ts > TIMESTAMP '2024-01-02 06:00:00') AS BIGINT) AS n_new, strftime(max(card_ts), '%Y-%m-%d') AS note
      FROM night_clusters_t x JOIN new_t n ON n.cluster_id = x.cluster_id JOIN seen_t s ON s.card_id = n.card_id WHERE x.night = '2024-01-02' AND x.parent IS NOT NULL GROUP BY x.parent)
    UNION ALL SELECT 'fresh', row_number() OVER (ORDER BY f.n_fresh DESC, f.cluster_id), f.cluster_id, a.n, f.n_fresh, coalesce(t.note, 'new') FROM fresh_t f JOIN (SELECT cluster_id, count(*) AS n FROM new_t n JOIN seen_t s ON s.card_id = n.card_id GROUP BY cluster_id) a ON a.cluster_id = f.cluster_id LEFT JOIN note_t t ON t.new_id = f.cluster_id
    UNION ALL SELECT 'read', row_number() OVER (ORDER BY n DESC, card_id), card_id, CAST(n AS BIGINT), 0, note FROM (SELECT card_id, sum(n) AS n, string_agg(viewer || 'x' || n, ', ' ORDER BY viewer) AS note FROM reads_t GROUP BY card_id ORDER BY n DESC, card_id LIMIT 8)
    UNION ALL SELECT 'reshuffled', 1, 'cards', count(*), CAST(coalesce(sum(CASE WHEN h.new_id IS NULL OR h.new_id <> n.cluster_id THEN 1 ELSE 0 END), 0) AS BIGINT), '' FROM old_t o JOIN new_t n ON n.card_id = o.card_id LEFT JOIN homes_t h ON h.old_id = o.cluster_id WHERE n.cluster_id NOT IN (SELECT cluster_id FROM fresh_t)""",
    **REPORT,
)
def tree_report(c):
    clusters, members = night_tables(c)
    return snapshot.report(clusters, members, c.cards, c.access, VIEWER, "2024-01-02", "2024-01-03 06:00:00")


@query("SELECT max(CAST(ts AS DATE)) AS night FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-15'")
def previous_night(c):
    return snapshot.previous_night(c.table("events").select(F.to_date("ts").alias("night")), "2024-01-15")


@query("SELECT session_id, kind, k FROM (SELECT key AS session_id, kind, CAST(row_number() OVER (ORDER BY last_at DESC, key) AS INTEGER) AS k FROM (SELECT session_id AS key, CASE WHEN session_id % 4 = 0 THEN 'branch' ELSE 'session' END AS kind, max(ts) AS last_at FROM turns GROUP BY session_id))")
def eligible_sessions(c):
    """Linear sessions and tree branches (every fourth), most active last first."""
    from tidewell.operators import cards as k

    last = c.turns.groupBy(F.col("session_id").alias("key")).agg(F.max("ts").alias("last_at"))
    return k.eligible_sessions(last, last.where("key % 4 = 0")).select(F.col("key").alias("session_id"), "kind", "k")
