"""Registered queries: entities, co-occurrence, vectors, graph."""

from pyspark.sql import functions as F

from tidewell.functions.columns import cosine
from tidewell.operators import components, index
from tidewell.plans.registry import query
from tidewell.store import cut

ENTITIES = {
    "entities_t": "SELECT DISTINCT card_id, entity FROM card_tags JOIN tag_map USING (tag)",
    "known_t": "SELECT tag FROM tag_map WHERE entity IN (SELECT entity FROM tag_map GROUP BY entity HAVING count(*) >= 2)",
    "idf_t": "SELECT entity, df, ln(n / df) AS idf FROM (SELECT entity, count(*) AS df FROM entities_t GROUP BY entity), (SELECT count(*) AS n FROM cards) WHERE df <= 0.25 * n AND lower(entity) NOT IN ('therea', 'thatth')",
    "cooc_t": "SELECT a.card_id AS a, b.card_id AS b, count(*) AS n_shared, sum(idf) AS weight FROM entities_t a JOIN entities_t b ON a.entity = b.entity AND a.card_id < b.card_id JOIN idf_t i ON i.entity = a.entity WHERE idf > 0 GROUP BY ALL",
}
STOP = {"therea", "thatth"}


def entities(c):
    return index.card_entities(c.card_tags, c.tag_map)


def idf(c):
    return index.entity_idf(entities(c), c.cards.agg(F.count("*").alias("n")), STOP)


@query("SELECT tag, count(DISTINCT card_id) AS df FROM card_tags WHERE tag NOT IN (SELECT tag FROM known_t) GROUP BY tag HAVING count(DISTINCT card_id) >= 2", **ENTITIES)
def unresolved_tags(c):
    many = c.tag_map.groupBy("entity").agg(F.count("*").alias("n")).where("n >= 2")
    return index.unresolved_tags(c.card_tags, c.tag_map.join(many, "entity", "left_semi"))


@query("SELECT entity, count(*) AS df FROM entities_t GROUP BY entity", **ENTITIES)
def entity_df(c):
    return entities(c).groupBy("entity").agg(F.count("*").alias("df"))


@query("SELECT entity, df, round(idf, 6) AS idf FROM idf_t", **ENTITIES)
def entity_idf(c):
    return idf(c).withColumn("idf", F.round("idf", 6))


@query("SELECT a, b, n_shared FROM cooc_t", **ENTITIES)
def cooc_pairs(c):
    return index.cooccurrence(entities(c), idf(c)).select("a", "b", "n_shared")


@query("SELECT a, b, round(weight, 6) AS weight FROM cooc_t", **ENTITIES)
def cooc_weight(c):
    return index.cooccurrence(entities(c), idf(c)).select("a", "b", F.round("weight", 6).alias("weight"))


PAIRS = {
    "tdf_t": "SELECT tag, count(DISTINCT card_id) AS df FROM card_tags GROUP BY tag",
    "tpairs_t": """SELECT p.*, a.df AS df_a, b.df AS df_b, n, round(log2(n_ab * CAST(n AS DOUBLE) / (a.df * b.df)), 6) AS pmi FROM (
      SELECT x.tag AS a, y.tag AS b, count(*) AS n_ab FROM card_tags x JOIN card_tags y ON x.card_id = y.card_id AND x.tag < y.tag GROUP BY ALL) p
      JOIN tdf_t a ON a.tag = p.a JOIN tdf_t b ON b.tag = p.b, (SELECT count(DISTINCT card_id) AS n FROM card_tags)""",
}


@query("SELECT a, b, n_ab, df_a, df_b, n, pmi FROM tpairs_t", **PAIRS)
def tag_pairs(c):
    return index.tag_pairs(c.card_tags)


@query(
    """SELECT x.a, y.b, round(dot / (x2.norm * y2.norm), 6) AS similarity FROM (
      SELECT l.tag AS a, r.tag AS b, sum(l.pmi * r.pmi) AS dot FROM profile_t l JOIN profile_t r ON l.feature = r.feature AND l.tag < r.tag GROUP BY ALL) d
    JOIN (SELECT DISTINCT tag AS a FROM profile_t) x ON x.a = d.a JOIN (SELECT DISTINCT tag AS b FROM profile_t) y ON y.b = d.b JOIN norms_t x2 ON x2.tag = d.a JOIN norms_t y2 ON y2.tag = d.b
    WHERE round(dot / (x2.norm * y2.norm), 6) >= 0.6""",
    profile_t="SELECT a AS tag, b AS feature, pmi FROM tpairs_t WHERE pmi > 0 AND df_a >= 2 AND df_b >= 2 UNION ALL SELECT b, a, pmi FROM tpairs_t WHERE pmi > 0 AND df_a >= 2 AND df_b >= 2",
    norms_t="SELECT tag, sqrt(sum(pmi * pmi)) AS norm FROM profile_t GROUP BY tag",
    **PAIRS,
)
def tag_similarity(c):
    return index.tag_similarity(index.tag_pairs(c.card_tags))


VEC = {
    "parts_t": "SELECT vec_id, unnest(range(1, 65)) AS i, unnest(embedding) AS x FROM embeddings",
    "mean_t": "SELECT list(m ORDER BY i) AS mean FROM (SELECT i, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT v.vec_id, p.i, p.x FROM vectors v JOIN parts_t p ON p.vec_id = v.vec_id) GROUP BY i)",
    "moved_t": "SELECT card_id, list_transform(range(1, 65), lambda i: full_vec[i] - mean[i]) AS v FROM vectors, mean_t",
    "unit_t": "SELECT card_id, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS v FROM moved_t",
    "cos_t": "SELECT a.card_id AS a, b.card_id AS b, round(list_dot_product(a.v, b.v), 6) AS cos FROM unit_t a JOIN unit_t b ON a.card_id <> b.card_id",
    "knn_t": "SELECT a, b, cos FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cos DESC, b) AS k FROM cos_t) WHERE k <= 12",
    "cand_t": "SELECT a, b, max(cos) AS cos, max(cooc) AS cooc FROM (SELECT least(a, b) AS a, greatest(a, b) AS b, cos, 0.0 AS cooc FROM knn_t UNION ALL SELECT c.a, c.b, x.cos, c.weight FROM cooc_t c JOIN cos_t x ON x.a = c.a AND x.b = c.b) GROUP BY a, b",
    "graph_t": """SELECT * FROM (SELECT a, b, cos, round(cooc, 6) AS cooc, round(0.5 * CASE WHEN hi > lo THEN (cos - lo) / (hi - lo) ELSE 0 END + 0.5 * CASE WHEN top > 0 THEN cooc / top ELSE 0 END, 6) AS weight
      FROM cand_t, (SELECT min(cos) AS lo, max(cos) AS hi, max(cooc) AS top FROM cand_t)) WHERE weight > 0""",
    "ends_t": "SELECT a AS card_id, b AS other FROM graph_t UNION ALL SELECT b, a FROM graph_t",
}
GRAPH = ENTITIES | VEC


def centered(c):
    return index.centered(c.vectors.select("card_id", F.col("full_vec").alias("vector")))


def met(c, leaves=None):
    """The card graph where its pairs meet."""
    vectors = cut(c.vectors.select("card_id", F.col("full_vec").alias("vector")), "vectors")
    return index.CardGraph(entities(c), idf(c), vectors, index.mean_vector(vectors).first()["mean"], leaves)


def graph(c):
    return met(c).edges()


@query("SELECT card_id, round(v[1], 5) AS first, round(v[64], 5) AS last FROM unit_t", **VEC)
def center_embeddings(c):
    return centered(c).select("card_id", F.round(F.col("vector")[0], 5).alias("first"), F.round(F.col("vector")[63], 5).alias("last"))


@query("""SELECT v.card_id, round(list_dot_product(CAST(full_vec AS DOUBLE[]), CAST(share_vec AS DOUBLE[])) / (sqrt(list_dot_product(CAST(full_vec AS DOUBLE[]), CAST(full_vec AS DOUBLE[]))) * sqrt(list_dot_product(CAST(share_vec AS DOUBLE[]), CAST(share_vec AS DOUBLE[])))), 6) AS cos FROM vectors v""")
def cosine_pairs(c):
    return c.vectors.select("card_id", F.round(cosine(F.col("full_vec"), F.col("share_vec")), 6).alias("cos"))


@query("SELECT a, b, cos FROM knn_t", **VEC)
def knn_graph(c):
    return index.knn(centered(c), 12)


@query("SELECT * FROM graph_t", **GRAPH)
def card_graph(c):
    return graph(c)


@query("SELECT count(*) AS n_edges, round(min(weight), 6) AS lo, round(max(weight), 6) AS hi, round(avg(weight), 5) AS mean FROM graph_t", **GRAPH)
def edge_weights(c):
    return met(c).weights().withColumn("mean", F.round("mean", 5))


@query(
    """SELECT (SELECT count(*) FROM unit_t) AS n_nodes, (SELECT count(*) FROM unit_t WHERE card_id NOT IN (SELECT card_id FROM ends_t)) AS n_isolated, (SELECT max(d) FROM (SELECT count(*) AS d FROM ends_t GROUP BY card_id)) AS max_degree,
      (SELECT count(*) FROM graph_t) AS n_edges, (SELECT round(median(weight), 6) FROM graph_t) AS median_weight, (SELECT count(DISTINCT least_id) FROM (SELECT card_id, min(member) AS least_id FROM reach_t GROUP BY card_id)) AS n_components""",
    reach_t="RECURSIVE SELECT card_id, card_id AS member FROM unit_t UNION SELECT r.card_id, e.other FROM reach_t r JOIN ends_t e ON e.card_id = r.member",
    **GRAPH,
)
def graph_stats(c):
    return index.graph_stats(cut(graph(c).select("a", "b", "weight"), "graph"), c.vectors.select("card_id"))


@query(
    """SELECT card_id, cluster_id, share FROM (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY share DESC, cluster_id) AS k FROM (
      SELECT s.card_id, s.cluster_id, s.share FROM (SELECT e.card_id, m.cluster_id, round(count(*) / sum(count(*)) OVER (PARTITION BY e.card_id), 6) AS share FROM ends_t e JOIN members m ON m.card_id = e.other GROUP BY e.card_id, m.cluster_id) s
      JOIN members o ON o.card_id = s.card_id WHERE o.cluster_id <> s.cluster_id)) WHERE k <= 2 AND share >= 0.15""",
    **GRAPH,
)
def secondary_membership(c):
    return index.secondary_leaves(met(c, c.members).leaf_counts(), c.members)


@query(
    """SELECT m.cluster_id, coalesce(label, '(no entities)') AS label FROM (SELECT DISTINCT cluster_id FROM members) m LEFT JOIN (
      SELECT cluster_id, string_agg(entity || '(' || n || ')', ' ' ORDER BY k) AS label FROM (
        SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, entity) AS k FROM (SELECT cluster_id, entity, count(*) AS n FROM members JOIN entities_t USING (card_id) WHERE entity NOT IN ('therea', 'thatth') GROUP BY ALL)) WHERE k <= 4 GROUP BY cluster_id) l
    ON l.cluster_id = m.cluster_id""",
    **ENTITIES,
)
def cluster_labels(c):
    return index.cluster_labels(c.members, entities(c), STOP)


@query(
    """SELECT name, entity, cos FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY cos DESC, entity) AS k FROM (
      SELECT v.card_id AS name, 'label' || e.label AS entity, round(list_dot_product(CAST(v.full_vec AS DOUBLE[]), e.m) / (sqrt(list_dot_product(CAST(v.full_vec AS DOUBLE[]), CAST(v.full_vec AS DOUBLE[]))) * sqrt(list_dot_product(e.m, e.m))), 6) AS cos
      FROM vectors v, (SELECT label, list(m ORDER BY i) AS m FROM (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(full_vec) AS x FROM vectors) GROUP BY label, i) GROUP BY label) e)) WHERE k <= 5 AND cos >= 0.2"""
)
def entity_candidates(c):
    parts = c.vectors.select("label", F.posexplode("full_vec").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    entity = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("vector")).select(F.concat(F.lit("label"), F.col("label").cast("string")).alias("entity"), "vector")
    return index.candidates(c.vectors.select(F.col("card_id").alias("name"), F.col("full_vec").alias("vector")), entity, 5, 0.2)


@query(r"SELECT tag FROM (SELECT tag, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS tag FROM documents) GROUP BY tag) WHERE df = 1 AND regexp_matches(tag, '[!?;:]')")
def junk_tags(c):
    words = c.table("documents").select(F.col("doc_id").alias("card_id"), F.explode(F.split("text", r"\s+")).alias("tag"))
    return index.junk_tags(words, "[!?;:]")


@query("SELECT card_id FROM cards WHERE regexp_matches(share, '\\S') AND card_id NOT IN (SELECT card_id FROM vectors)")
def missing_share_vectors(c):
    from tidewell.functions.columns import blank

    return c.cards.where(~blank(F.col("share"))).join(c.vectors, "card_id", "left_anti").select("card_id")


@query(
    "SELECT DISTINCT CAST(f.file AS VARCHAR) AS file FROM reach_t r JOIN fs_t f ON f.file = r.member WHERE r.file IN (SELECT file FROM fs_t WHERE session_id % 13 = 0)",
    fs_t="SELECT conv_id AS file, session_id FROM (SELECT conv_id // 4 AS conv_id, conv_id AS session_id FROM conversations UNION SELECT conv_id // 4, conv_id + 1 FROM conversations WHERE conv_id % 8 = 3)",
    reach_t="RECURSIVE SELECT DISTINCT file, file AS member FROM fs_t UNION SELECT r.file, g.file FROM reach_t r JOIN fs_t f ON f.file = r.member JOIN fs_t g ON g.session_id = f.session_id",
)
def incremental_select(c):
    """Files of four sessions each, every second one sharing a session with the next; changed are those of every 13th session."""
    conv = c.table("conversations").select("conv_id").distinct()
    files = conv.select(F.floor(F.col("conv_id") / 4).alias("file"), F.col("conv_id").alias("session")).unionByName(conv.where("conv_id % 8 = 3").select(F.floor(F.col("conv_id") / 4).alias("file"), (F.col("conv_id") + 1).alias("session"))).distinct()
    return components.touched_files(files, files.where("session % 13 = 0").select("file").distinct()).select("file")
