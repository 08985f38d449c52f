"""Registered queries: ranked search, vector search, conversation history."""

from pyspark.sql import functions as F

from tidewell.operators import search as s
from tidewell.operators import tree
from tidewell.plans.q_browse import SEEN
from tidewell.plans.registry import VIEWER, query

TEXT = "thrend thonea"
GROUPS = s.terms(TEXT)
WORDS = s.flat(GROUPS)
TAG_WORDS = ["ingon", "enver"]
HISTORY = ["thing", "tion the"]
FIELDS_SQL = " UNION ALL ".join(
    rf"SELECT card_id, room, regexp_matches(share, '\S') AS shared, '{f}' AS field, unnest(regexp_extract_all(lower(strip_accents({f})), '[\p{{L}}\p{{M}}\p{{N}}]+')) AS token FROM cards" for f in s.FIELDS
)
INDEX = {
    "postings_t": f"SELECT card_id, room, shared, field, token, count(*) AS tf FROM ({FIELDS_SQL}) GROUP BY ALL",
    "lengths_t": "SELECT card_id, sum(tf) AS length FROM postings_t GROUP BY card_id",
    "totals_t": "SELECT count(*) AS n, avg(length) AS avgl FROM lengths_t",
    "terms_t": "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{w}')" for i, w in enumerate(WORDS)) + ") v(i, word)",
}


def score_sql(fields: str, allowed: str, every: bool, prefix: bool) -> str:
    match = "starts_with(p.token, t.word)" if prefix else "p.token = t.word"
    having = f"HAVING count(*) = {len(WORDS)}" if every else ""
    return f"""SELECT card_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / avgl))), 6) AS score FROM (
      SELECT *, count(*) OVER (PARTITION BY i) AS df FROM (
        SELECT p.card_id, t.i, sum(tf) AS f, max(length) AS length, bool_or({allowed}) AS allowed FROM postings_t p JOIN lengths_t l ON l.card_id = p.card_id JOIN terms_t t ON {match}
        WHERE field IN ({fields}) GROUP BY p.card_id, t.i)), totals_t WHERE allowed GROUP BY card_id {having}"""


def both_sql(every: bool, prefix: bool) -> str:
    own = f"room = '{VIEWER}'"
    a, b = score_sql("'headline', 'share'", f"({own} OR shared)", every, prefix), score_sql("'private'", own, every, prefix)
    return f"SELECT card_id, max(score) AS score FROM ({a} UNION ALL {b}) GROUP BY card_id"


TAGGED = f"SELECT c.card_id, card_ts, string_agg(DISTINCT tag, '、' ORDER BY tag) AS why FROM cards c JOIN card_tags t ON t.card_id = c.card_id WHERE {SEEN} AND ({' OR '.join(f"contains(lower(tag), '{w}')" for w in [TEXT, *WORDS])}) GROUP BY ALL"


@query("SELECT card_id, field, token, tf FROM postings_t", **INDEX)
def postings(c):
    return s.postings(c.cards).where("tf > 0").select("card_id", "field", "token", F.col("tf").cast("long").alias("tf"))


@query(score_sql("'headline', 'share', 'private'", "true", False, False), **INDEX)
def bm25(c):
    index = s.matching(c.cards, GROUPS)
    return s.bm25(index, s.totals_of(index), GROUPS, list(s.FIELDS), F.lit(True), every=False, prefix=False)


@query(score_sql("'private'", f"room = '{VIEWER}'", False, True), **INDEX)
def search_private(c):
    index = s.matching(c.cards, GROUPS)
    return s.bm25(index, s.totals_of(index), GROUPS, ["private"], F.col("room") == VIEWER, every=False, prefix=True)


WIDE = {
    "wide_t": """SELECT 'd#' || doc_id AS card_id, 'Caf\u00e9 na\u00efve_' || (doc_id % 7) || ' x' AS headline, '\u6211\u4eec' || repeat('\u751f\u65e5', CAST(1 + doc_id % 3 AS INTEGER)) || CASE WHEN doc_id % 2 = 0 THEN '\u7684' ELSE '' END || repeat('\u793c\u7269', CAST(doc_id % 4 AS INTEGER)) AS share FROM documents""",
    "wide_f": """SELECT card_id, CASE WHEN contains(share, '\u793c\u7269') THEN least((length(share) - length(replace(share, '\u751f\u65e5', ''))) / 2, (length(share) - length(replace(share, '\u793c\u7269', ''))) / 2) ELSE 0 END AS f, 2 * length(share) - 1 + 4 AS length FROM wide_t""",
}


@query(
    """SELECT card_id, round(greatest(ln((n - df1 + 0.5) / (df1 + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / a)) + greatest(ln((n - n + 0.5) / (n + 0.5)), 1e-6) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * length / a)), 6) AS score
    FROM wide_f, (SELECT count(*) AS n, count(*) FILTER (f > 0) AS df1, avg(length) AS a FROM wide_f) WHERE f > 0""",
    **WIDE,
)
def search_wide(c):
    """Words inside unspaced text, with something between their parts, and words with accents, asked without."""
    d = F.col("doc_id")
    gift = F.concat(F.lit("\u6211\u4eec"), F.repeat(F.lit("\u751f\u65e5"), (d % 3 + 1).cast("int")), F.when(d % 2 == 0, "\u7684").otherwise(""), F.repeat(F.lit("\u793c\u7269"), (d % 4).cast("int")))
    rows = c.table("documents").select(F.concat(F.lit("d#"), d.cast("string")).alias("card_id"), F.concat(F.lit("Caf\u00e9 na\u00efve_"), (d % 7).cast("string"), F.lit(" x")).alias("headline"), gift.alias("share"), F.lit("").alias("private"), F.lit("r").alias("room"))
    groups = s.terms("\u751f\u65e5\u793c\u7269 CAFE")
    index = s.matching(rows, groups)
    return s.bm25(index, s.totals_of(index), groups, ["headline", "share"], F.lit(True), every=True, prefix=False)


@query(TAGGED.replace(WORDS[0], TAG_WORDS[0]).replace(WORDS[1], TAG_WORDS[1]))
def tag_match(c):
    return s.tag_match(c.cards, c.card_tags, TAG_WORDS, VIEWER)


@query(
    f"""SELECT card_id, priority, score, why FROM (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY priority, score DESC) AS k FROM (
      SELECT card_id, 0 AS priority, score, '' AS why FROM ({both_sql(True, False)}) UNION ALL SELECT card_id, 1, score, '' FROM ({both_sql(False, True)})
      UNION ALL SELECT card_id, 2, epoch_us(card_ts) / 1e6, 'tag: ' || why FROM tagged_t)) WHERE k = 1 ORDER BY priority, score DESC, card_id LIMIT 100""",
    tagged_t=TAGGED,
    **INDEX,
)
def search(c):
    return s.search(c.cards, None, c.card_tags, TEXT, VIEWER, 100)


@query(
    f"""SELECT card_id, round(CASE WHEN na * nb > 0 THEN d / (na * nb) ELSE 0 END, 6) AS score FROM (
      SELECT card_id, list_sum(list_transform(range(1, 65), lambda i: CAST(v[i] AS DOUBLE) * ((i - 1) % 7 - 3))) AS d, sqrt(list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE) * x))) AS na,
        sqrt(list_sum(list_transform(range(1, 65), lambda i: power((i - 1) % 7 - 3, 2.0)))) AS nb
      FROM (SELECT c.card_id, CASE WHEN room = '{VIEWER}' THEN full_vec ELSE share_vec END AS v FROM cards c JOIN vectors v ON v.card_id = c.card_id WHERE {SEEN}))
    ORDER BY 2 DESC, 1 LIMIT 50"""
)
def semantic_search(c):
    return s.semantic_search(c.cards, c.vectors, [i % 7 - 3 for i in range(64)], VIEWER, 50)


ROOTS = {"walk": "RECURSIVE SELECT node_id, node_id AS root, 0 AS depth FROM nodes WHERE parent_id IS NULL UNION ALL SELECT n.node_id, w.root, w.depth + 1 FROM nodes n JOIN walk w ON n.parent_id = w.node_id"}
LATEST = {"latest_t": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY room, source, context, kind, CASE WHEN kind = 'archive-root' THEN node_id END ORDER BY observed_at DESC, observation_id DESC) AS k FROM observations) WHERE k = 1"}
CATALOG = LATEST | {"catalog_t": "SELECT * FROM (SELECT * EXCLUDE (k), row_number() OVER (PARTITION BY room, source, context ORDER BY observed_at DESC, CASE WHEN kind = 'cursor' THEN 0 ELSE 1 END, observation_id DESC) AS k2 FROM latest_t) WHERE k2 = 1"}


@query("SELECT room, source, context, kind, node_id, observed_at, observation_id FROM latest_t", **LATEST)
def latest_observation(c):
    return tree.latest_observation(c.observations)


@query("SELECT room, source, context, kind, node_id, observed_at, observation_id FROM catalog_t", **CATALOG)
def history_catalog(c):
    return tree.catalog(c.observations)


@query("SELECT context, kind, observed_at FROM catalog_t ORDER BY observed_at DESC, observation_id DESC LIMIT 20 OFFSET 20", **CATALOG)
def history_page(c):
    from tidewell.operators.browse import page

    return page(tree.catalog(c.observations), [F.desc("observed_at"), F.desc("observation_id")], 20, 20)[0].select("context", "kind", "observed_at")


@query(
    """SELECT c.context, h.n_hits, h.snippet_node, c.observed_at, CAST(row_number() OVER (ORDER BY c.observed_at DESC, c.observation_id DESC) AS INTEGER) AS rank
    FROM catalog_t c JOIN walk w ON w.node_id = c.node_id JOIN (
      SELECT root, count(*) AS n_hits, (list(node_id ORDER BY a + b DESC, occurred_at DESC, node_id))[1] AS snippet_node FROM (
        SELECT n.node_id, occurred_at, root, CAST(contains(lower(text), 'thing') AS INT) AS a, CAST(contains(lower(text), 'tion the') AS INT) AS b FROM nodes n JOIN walk w ON w.node_id = n.node_id)
      WHERE a + b > 0 GROUP BY root HAVING max(a) + max(b) = 2) h ON h.root = w.root ORDER BY c.observed_at DESC, c.observation_id DESC LIMIT 20""",
    **CATALOG, **ROOTS,
)
def history_search(c):
    roots = tree.node_root(c.forest).select("node_id", "root")
    return s.history_search(c.forest, roots, tree.catalog(c.observations), HISTORY)


@query("SELECT node_id, root, CAST(depth AS BIGINT) AS depth, false AS cyclic FROM walk", **ROOTS)
def node_root(c):
    return tree.node_root(c.forest)


@query("SELECT root, count(*) AS n_nodes, max(depth) AS max_depth, min(occurred_at) AS first_at FROM walk JOIN nodes USING (node_id) GROUP BY root", **ROOTS)
def component_nodes(c):
    found = tree.node_root(c.forest).join(c.nodes.select("node_id", "occurred_at"), "node_id")
    return found.groupBy("root").agg(F.count("*").alias("n_nodes"), F.max("depth").cast("int").alias("max_depth"), F.min("occurred_at").alias("first_at"))


@query("SELECT doc_id, doc_id % 10 < 3 AS cyclic FROM documents")
def cycle_check(c):
    """Chains of every tenth document; three of the ten end in a cycle."""
    d = F.col("doc_id")
    parent = F.when(d >= 10, d - 10).when(d < 3, (d + 1) % 3)
    return tree.node_root(c.table("documents").select(d.alias("node_id"), parent.alias("parent_id"))).select(F.col("node_id").alias("doc_id"), "cyclic")


ANC = {"anc": "RECURSIVE SELECT node_id AS tip, node_id, 0 AS distance FROM nodes UNION ALL SELECT a.tip, n.parent_id, distance + 1 FROM anc a JOIN nodes n ON n.node_id = a.node_id WHERE n.parent_id IS NOT NULL"}


@query(
    r"""SELECT o.node_id AS tip, count(*) AS path_length, arg_max(text, distance) FILTER (WHERE role = 'user' AND regexp_matches(text, '\S')) AS first_user_text
    FROM (SELECT DISTINCT node_id FROM observations WHERE kind = 'cursor') o JOIN anc a ON a.tip = o.node_id JOIN nodes n ON n.node_id = a.node_id GROUP BY o.node_id""",
    **ANC,
)
def path_summary(c):
    tips = c.observations.where("kind = 'cursor'").select(F.col("node_id").alias("tip")).distinct()
    return tree.path_summary(c.forest, tips)


@query("SELECT node_id, parent_id FROM (SELECT source_uuid AS node_id, lag('message:' || turn || ':' || conv_id) OVER (PARTITION BY conv_id ORDER BY turn) AS parent_id FROM said) WHERE parent_id IS NOT NULL")
def missing_parents(c):
    """Parents under ids of another form: every one of them is missing."""
    from pyspark.sql.window import Window as W

    strange = F.lag(F.concat(F.lit("message:"), F.col("turn").cast("string"), F.lit(":"), F.col("conv_id").cast("string"))).over(W.partitionBy("conv_id").orderBy("turn"))
    return tree.missing_parents(c.said.select(F.col("source_uuid").alias("node_id"), strange.alias("parent_id")))


BRANCH = {
    "inherit_t": "SELECT *, CASE WHEN row_number() OVER (PARTITION BY parent_id ORDER BY occurred_at, node_id) = 1 THEN parent_id END AS inherits FROM nodes",
    "branch_t": "RECURSIVE SELECT node_id, node_id AS branch FROM inherit_t WHERE inherits IS NULL UNION ALL SELECT i.node_id, b.branch FROM inherit_t i JOIN branch_t b ON i.inherits = b.node_id",
}


@query("SELECT node_id, branch FROM branch_t", **BRANCH)
def branches(c):
    return tree.branches(c.forest)


BRANCH_TURNS = BRANCH | ROOTS | ANC | {
    "tips_t": "SELECT branch, arg_max(b.node_id, depth) AS tip FROM branch_t b JOIN walk w ON w.node_id = b.node_id GROUP BY branch",
    "path_t": "SELECT t.branch, w.depth AS pos, a.node_id, n.role, o.branch <> t.branch AS is_context FROM tips_t t JOIN anc a ON a.tip = t.tip JOIN walk w ON w.node_id = a.node_id JOIN nodes n ON n.node_id = a.node_id JOIN branch_t o ON o.node_id = a.node_id",
    "grouped_t": "SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY branch ORDER BY pos) AS g FROM path_t",
    "done_t": "SELECT *, max(CASE WHEN role = 'user' THEN pos END) OVER (PARTITION BY branch, g) AS u, max(CAST(role = 'assistant' AS INT)) OVER (PARTITION BY branch, g) AS a FROM grouped_t WHERE g > 0",
    "kept_t": "SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY branch ORDER BY pos) AS round FROM done_t WHERE a = 1 AND pos >= u",
    "branch_turns_t": "SELECT branch, node_id, CAST(round AS BIGINT) AS round, CAST(row_number() OVER (PARTITION BY branch, round ORDER BY pos) AS INTEGER) AS message_seq, is_context FROM kept_t",
}


@query("SELECT * FROM branch_turns_t", **BRANCH_TURNS)
def branch_turns(c):
    return tree.branch_turns(tree.branch_paths(c.forest, tree.branches(c.forest)))


@query("SELECT branch, pos, node_id, is_context FROM done_t WHERE a = 1 AND pos >= u", **BRANCH_TURNS)
def eligible_turns(c):
    from tidewell.operators.rounds import completed_rounds

    paths = tree.branch_paths(c.forest, tree.branches(c.forest))
    return completed_rounds(paths, "branch").select("branch", F.col("pos").cast("int").alias("pos"), "node_id", "is_context")
