"""Registered queries: forks, coverage, sessions with something new."""

from pyspark.sql import functions as F

from tidewell.functions.labels import room_of_path
from tidewell.operators import browse, cards, forks, tree
from tidewell.plans.q_browse import SPAN
from tidewell.plans.q_search import BRANCH_TURNS
from tidewell.plans.registry import VIEWER, query

#: Turns that a card of the viewer's room covers.
SHARED = SPAN + f" WHERE c.room = '{VIEWER}'"
FORKS = {
    "pairs_t": "SELECT a.session_id AS parent, b.session_id AS child, count(*) AS shared, max(a.round) AS parent_round, max(b.round) AS child_round FROM turns a JOIN turns b ON a.source_uuid = b.source_uuid AND a.session_id < b.session_id GROUP BY ALL HAVING count(*) >= 2",
    "sizes_t": "SELECT session_id, count(*) AS n FROM turns GROUP BY session_id",
    "forks_t": """SELECT child, parent, shared, parent_round, child_round, child_round + 1 AS delta_start, round(shared / c.n, 6) AS ratio FROM (
      SELECT p.*, row_number() OVER (PARTITION BY child ORDER BY shared DESC, s.n DESC, parent DESC) AS k FROM pairs_t p JOIN sizes_t s ON s.session_id = p.parent) JOIN sizes_t c ON c.session_id = child WHERE k = 1""",
    "delta_t": "SELECT child, count(*) AS delta_turns, count(DISTINCT round) AS delta_rounds FROM forks_t JOIN turns ON session_id = child AND round > child_round GROUP BY child",
}


@query("SELECT parent, child, shared, parent_round, child_round FROM pairs_t", **FORKS)
def fork_pairs(c):
    return forks.fork_pairs(c.turns)


@query("SELECT * FROM forks_t", **FORKS)
def session_forks(c):
    return forks.session_forks(c.turns)


@query("SELECT * FROM delta_t", **FORKS)
def fork_delta(c):
    return forks.fork_delta(c.turns, forks.session_forks(c.turns))


@query(
    """SELECT s.session_id, s.max_round, coalesce(k.last_end, f.child_round, 0) AS covered, CASE WHEN f.child IS NOT NULL THEN coalesce(d.delta_rounds, 0) ELSE s.n_rounds END AS effective_rounds
    FROM (SELECT session_id, max(round) AS max_round, count(DISTINCT round) AS n_rounds FROM turns GROUP BY session_id) s
    LEFT JOIN (SELECT session_id, max(turn_end) AS last_end FROM cards GROUP BY session_id) k ON k.session_id = s.session_id
    LEFT JOIN forks_t f ON f.child = s.session_id LEFT JOIN delta_t d ON d.child = s.session_id
    WHERE s.max_round > coalesce(k.last_end, f.child_round, 0) AND (k.last_end IS NOT NULL OR CASE WHEN f.child IS NOT NULL THEN coalesce(d.delta_rounds, 0) ELSE s.n_rounds END >= 2)
      AND NOT (k.last_end IS NULL AND EXISTS (SELECT 1 FROM forks_t x JOIN cards y ON y.session_id = x.child WHERE x.parent = s.session_id AND y.turn_start <= x.child_round))""",
    **FORKS,
)
def sessions_needing_update(c):
    return forks.sessions_needing_update(c.turns, c.cards, forks.session_forks(c.turns))


@query(f"SELECT owner, count(*) AS n_uncovered FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM ({SHARED}) x WHERE x.source_uuid = n.node_id) GROUP BY owner")
def uncovered_nodes(c):
    return forks.uncovered_nodes(c.nodes, browse.card_spans(c.cards.where(F.col("room") == VIEWER), c.turns))


@query(
    f"""SELECT branch, count(DISTINCT round) AS own_rounds, CAST(sum(CASE WHEN h.source_uuid IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS own_uncovered
    FROM branch_turns_t b LEFT JOIN (SELECT DISTINCT source_uuid FROM ({SHARED})) h ON h.source_uuid = b.node_id WHERE NOT is_context GROUP BY branch HAVING sum(CASE WHEN h.source_uuid IS NULL THEN 1 ELSE 0 END) > 0""",
    **BRANCH_TURNS,
)
def branch_coverage(c):
    turns = tree.branch_turns(tree.branch_paths(c.forest, tree.branches(c.forest)))
    return forks.branch_coverage(turns, browse.card_spans(c.cards.where(F.col("room") == VIEWER), c.turns).select("source_uuid"))


@query("SELECT card_id, session_id FROM cards WHERE session_id NOT IN (SELECT session_id FROM turns)")
def orphan_gc(c):
    """Cards whose session has no turns: what a sweep after deletions removes."""
    return c.cards.join(c.turns.select("session_id").distinct(), "session_id", "left_anti").select("card_id", "session_id")


#: The file of a turn: sessions move between the logs of four rooms, one of which no rule knows.
VOTE = {
    "logged_t": "SELECT session_id, CASE (session_id + round // 2) % 4 WHEN 0 THEN 'attic' WHEN 1 THEN 'cellar' WHEN 2 THEN 'attic' END AS room FROM turns",
    "vote_t": "SELECT session_id, room FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, room DESC) AS k FROM (SELECT session_id, room, count(*) AS n FROM logged_t WHERE room IS NOT NULL GROUP BY ALL)) WHERE k = 1",
}


def votes(c):
    file = F.concat(F.lit("/logs/"), ((F.col("session_id") + F.floor(F.col("round") / 2)) % 4).cast("string"), F.lit("/a.jsonl"))
    rules = {"/logs/": "street", "/logs/0": "attic", "/logs/1": "cellar", "/logs/2": "attic"}
    room = F.nullif(room_of_path(file, rules), F.lit("street"))
    return cards.room_vote(c.turns.select("session_id", room.alias("room")))


@query("SELECT * FROM vote_t", **VOTE)
def room_vote(c):
    """The room of the files that most of a session's turns come from."""
    return votes(c)
