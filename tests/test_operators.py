"""Semantics that the oracles don't reach: small fixtures, edge cases, properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import columns as c
from tidewell.operators import browse, cards, components, index, leiden, midlayer, rounds, tree, violations
from tidewell.sources import envelopes, journal


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def turn(s, u, role, major, minor=0, text="x"):
    return (s, u, role, text, None, major, minor)


TURN = "session_id long, source_uuid string, role string, text string, ts timestamp_ntz, major int, minor int"


def test_rounds_fold_leading_assistants_and_duplicates(spark):
    data = [turn(1, "a", "assistant", 1), turn(1, "b", "assistant", 2), turn(1, "c", "user", 3), turn(1, "d", "assistant", 4), turn(1, "c", "user", 9), turn(1, "e", "user", 5)]
    got = rows(rounds.assign_rounds(spark.createDataFrame(data, TURN)).select("source_uuid", "round", "message_seq"))
    assert got == [("a", 1, 1), ("b", 1, 2), ("c", 2, 1), ("d", 2, 2), ("e", 3, 1)]


def test_rounds_dont_depend_on_input_order(spark):
    data = [turn(s, f"{s}-{i}", "user" if i % 3 == 0 else "assistant", i) for s in range(3) for i in range(9)]
    one = rows(rounds.assign_rounds(spark.createDataFrame(data, TURN)).drop("ts"))
    assert one == rows(rounds.assign_rounds(spark.createDataFrame(data[::-1], TURN).repartition(5)).drop("ts"))


def test_visibility(spark):
    cards_ = spark.createDataFrame([("a", "r1", "", "p"), ("b", "r2", " \t", "p"), ("c", "r2", "s", "p"), ("d", "r2", None, "p")], "card_id string, room string, share string, private string")
    assert rows(browse.masked_view(cards_, "r1").select("card_id", "private")) == [("a", "p"), ("c", "")]
    assert browse.visible_cards(cards_, None).count() == 4


def test_completed_rounds(spark):
    path = spark.createDataFrame([("x", 0, "assistant"), ("x", 1, "user"), ("x", 2, "user"), ("x", 3, "assistant"), ("x", 4, "assistant"), ("x", 5, "user")], "branch string, pos long, role string")
    assert [r["pos"] for r in rounds.completed_rounds(path).orderBy("pos").collect()] == [2, 3, 4]


def test_deep_chain_and_cycle(spark):
    chain = [(i, i - 1 if i else None) for i in range(300)] + [(1000, 1001), (1001, 1000)]
    found = {r["node_id"]: r for r in tree.node_root(spark.createDataFrame(chain, "node_id long, parent_id long")).collect()}
    assert found[299]["root"] == 0 and found[299]["depth"] == 299 and not found[299]["cyclic"]
    assert found[1000]["cyclic"] and found[1001]["cyclic"] and found[1000]["root"] is None


def test_branches_and_context(spark):
    nodes = spark.createDataFrame([("r", None, 1, "user"), ("l", "r", 2, "assistant"), ("q", "r", 3, "assistant"), ("m", "l", 4, "user")], "node_id string, parent_id string, occurred_at long, role string")
    of = tree.branches(nodes)
    assert rows(of) == [("l", "r"), ("m", "r"), ("q", "q"), ("r", "r")]
    turns = tree.branch_turns(tree.branch_paths(nodes, of))
    assert rows(turns.select("branch", "node_id", "is_context")) == [("q", "q", False), ("q", "r", True), ("r", "l", False), ("r", "r", False)]


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, 500 + i) for i in range(1, 50)]
    found = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {found[i] for i in range(101)} == {0} and {found[500 + i] for i in range(50)} == {500}


def test_spanning_keeps_components_with_few_edges(spark):
    pairs = [(i, j) for i in range(60) for j in range(i)] + [(100, 101), (101, 102), (100, 102), (7, 7)]
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(3)
    few = components.spanning(edges)
    assert few.count() <= 3 * 61 and rows(components.components(few)) == rows(components.components(edges))


def test_touched_files(spark):
    files = spark.createDataFrame([("f1", "s1"), ("f2", "s1"), ("f2", "s2"), ("f3", "s2"), ("f4", "s9")], "file string, session string")
    got = components.touched_files(files, spark.createDataFrame([("f1",)], "file string"))
    assert rows(got) == [("f1",), ("f2",), ("f3",)]


def test_windows_around_a_card(spark):
    cards_ = spark.createDataFrame([(1, f"c{i}", i, "r", "s") for i in range(5)], "session_id long, card_id string, turn_start int, room string, share string").withColumn("card_ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    placed = browse.ordered_siblings(cards_, None)
    around = {}
    for r in browse.around(placed, 3).collect():
        around.setdefault(r["anchor"], set()).add(r["idx"])
    assert around["c0"] == {0, 1, 2} and around["c2"] == {1, 2, 3} and around["c4"] == {2, 3, 4}
    with pytest.raises(ValueError):
        browse.before(placed, 0)


def test_page_bounds(spark):
    df = spark.range(5)
    first, more = browse.page(df, [F.col("id")], 3)
    assert [r["id"] for r in first.collect()] == [0, 1, 2] and more
    last, more = browse.page(df, [F.col("id")], 3, 3)
    assert [r["id"] for r in last.collect()] == [3, 4] and not more
    with pytest.raises(ValueError):
        browse.page(df, [F.col("id")], 0)


def test_cosine_of_a_zero_vector(spark):
    got = spark.range(1).select(c.cosine(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(2.0))).alias("x")).first()["x"]
    assert got == 0


def test_knn_blocks_agree(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(90, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(f"c{i:03d}", x.tolist()) for i, x in enumerate(v)], "card_id string, vector array<double>")
    one, many = rows(index.knn(df, 4)), rows(index.knn(df, 4, block=20))
    assert one == many and len(one) == 360
    s = v @ v.T
    np.fill_diagonal(s, -9)
    assert {b for a, b, _ in one if a == "c000"} == {f"c{j:03d}" for j in np.argsort(-s[0])[:4]}


def test_pairs_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    tags = sorted({(f"c{i:02d}", f"e{j}") for i, j in zip(rng.integers(0, 60, 300).tolist(), rng.integers(0, 25, 300).tolist(), strict=True)})
    entities = spark.createDataFrame(tags, "card_id string, entity string")
    idf = spark.createDataFrame([(f"e{j}", 5, 0.5 + j) for j in range(24)] + [("e24", 60, 0.0)], "entity string, df long, idf double")
    want: dict = {}
    for x, e in tags:
        for y, f in tags:
            if x < y and e == f and e != "e24":
                n, w = want.get((x, y), (0, 0.0))
                want[x, y] = (n + 1, w + 0.5 + int(e[1:]))
    monkeypatch.setattr(index, "LEAST_TILE", 40)
    monkeypatch.setattr(index, "CHUNK", 30)
    found = index.cooccurrence(entities, idf)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert rows(found) == sorted((a, b, n, w) for (a, b), (n, w) in want.items())
    assert "MapInArrow" in plan and "Aggregate" not in plan and "Join" not in plan  # postings meet by blocks, pairs are never shuffled


def test_constant_cosine_gives_no_embedding_weight(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [1.0, 0.0])], "card_id string, vector array<double>")
    cooc = spark.createDataFrame([("a", "b", 1, 2.0)], "a string, b string, n_shared long, weight double")
    assert rows(index.card_graph(df, cooc, 2).select("a", "b", "weight")) == [("a", "b", 0.5)]


def test_graph_with_cosines_from_blocks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(40, 6))
    v = np.repeat(v / np.linalg.norm(v, axis=1, keepdims=True), 2, axis=0)  # each twice: ties
    df = spark.createDataFrame([(f"c{i:02d}", x.tolist()) for i, x in enumerate(v)], "card_id string, vector array<double>")
    entities = spark.createDataFrame([(f"c{i:02d}", f"e{i % 9}") for i in range(90)], "card_id string, entity string")  # ten cards have no vector
    idf = spark.createDataFrame([(f"e{j}", 10, 1.0 + j) for j in range(9)], "entity string, df long, idf double")
    joined = rows(index.card_graph(df, index.cooccurrence(entities, idf).drop("cos"), 3))
    monkeypatch.setattr(index, "LEAST_TILE", 40)
    assert rows(index.card_graph(df, index.cooccurrence(entities, idf, df), 3)) == joined
    nearest = rows(index.knn(df, 3, block=30))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")  # most rows come after each has its k
    assert rows(index.knn(df, 3, block=30)) == nearest
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    s = np.round(v @ v.T, 6)
    np.fill_diagonal(s, -9)
    assert [(int(a[1:]), int(b[1:])) for a, b, _ in nearest] == sorted((i, int(j)) for i in range(80) for j in np.lexsort((np.arange(80), -s[i]))[:3])


def test_rarest_ranks_before_the_shuffle(spark):
    rng = np.random.default_rng(3)
    pairs = sorted({(d, f"t{int(30 * x**3):02d}") for d in range(40) for x in rng.random(12)})
    count: dict = {}
    for _, t in pairs:
        count[t] = count.get(t, 0) + 1
    want = sorted((d, t) for d in range(40) for _, t in sorted((count[t], t) for e, t in pairs if e == d and count[t] > 1)[:3])
    df = spark.createDataFrame(pairs, "d int, t string")
    for common in (1, 5, 100):  # other values than these meet their counts by shuffle
        found = index.rarest(df, "d", "t", 3, common)
        assert rows(found) == want
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("WindowGroupLimit") == 2 and "BroadcastHashJoin" in plan  # also before the exchange


def _few_cards(spark):
    rng = np.random.default_rng(9)
    raw = rng.normal(size=(60, 5)).astype(np.float32)
    raw[30:33] = raw[0]  # copies: ties
    cards_ = spark.createDataFrame([(f"c{i:02d}", x.tolist()) for i, x in enumerate(raw)], "card_id string, vector array<float>")
    entities = spark.createDataFrame(sorted({(f"c{i:02d}", f"e{j}") for i, j in zip(rng.integers(0, 70, 150).tolist(), rng.integers(0, 30, 150).tolist(), strict=True)}), "card_id string, entity string")
    idf = spark.createDataFrame([(f"e{j}", 5, 0.5 + j) for j in range(29)] + [("e29", 60, 0.0)], "entity string, df long, idf double")
    return cards_, entities, idf


def test_graph_where_pairs_meet(spark, monkeypatch):
    raw, entities, idf = _few_cards(spark)
    unit = index.centered(raw)
    want = rows(index.card_graph(unit, index.cooccurrence(entities, idf), 4))
    monkeypatch.setattr(index, "LEAST_TILE", 20)
    monkeypatch.setattr(index, "CHUNK", 15)
    graph = index.CardGraph(entities, idf, raw, index.mean_vector(raw).first()["mean"], k=4)
    assert rows(graph.edges()) == want and rows(index.CardGraph(entities, idf, unit, k=4).edges()) == want
    weights = [r[4] for r in want]
    got = graph.weights().first()
    assert (got["n_edges"], got["lo"], got["hi"], round(got["mean"], 9)) == (len(want), min(weights), max(weights), round(sum(weights) / len(want), 9))
    plan = graph.edges()._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan  # no pair is joined, grouped or stored
    assert index.CardGraph(entities, idf, raw.limit(0)).weights().first()["n_edges"] == 0


def test_leaves_are_counted_where_pairs_meet(spark, monkeypatch):
    raw, entities, idf = _few_cards(spark)
    leaves = spark.createDataFrame([(f"c{i:02d}", f"L{i % 7}") for i in range(55)], "card_id string, cluster_id string")  # five cards have none
    mean = index.mean_vector(raw).first()["mean"]
    want = rows(index.secondary_membership(index.CardGraph(entities, idf, raw, mean).edges(), leaves))
    monkeypatch.setattr(index, "LEAST_TILE", 20)
    for most in (index.MOST_COUNTS, 1):
        monkeypatch.setattr(index, "MOST_COUNTS", most)
        counts = index.CardGraph(entities, idf, raw, mean, leaves).leaf_counts()
        assert want and rows(index.secondary_leaves(counts, leaves)) == want


def test_a_large_graph_is_stored_once(spark, monkeypatch):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0)], "a string, b string, weight double")
    labels: list = []
    monkeypatch.setattr(leiden, "cut", lambda df, label="step": labels.append(label) or df)
    leiden._moves(edges, 1)
    assert "both" not in labels  # the two directions are read, not stored


def test_secondary_at_the_threshold(spark):
    edges = spark.createDataFrame([("x", f"o{i}") for i in range(17)] + [("x", f"p{i}") for i in range(3)], "a string, b string")
    members = spark.createDataFrame([("x", "A")] + [(f"o{i}", "A") for i in range(17)] + [(f"p{i}", "B") for i in range(3)], "card_id string, cluster_id string")
    got = [r for r in rows(index.secondary_membership(edges, members)) if r[0] == "x"]
    assert got == [("x", "B", 0.15)]


def test_tempo_of_a_single_card(spark):
    cards_ = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-01"), ("c", "2024-02-01")], "card_id string, t string").select("card_id", F.col("t").cast("timestamp_ntz").alias("card_ts"))
    members = spark.createDataFrame([("a", "L"), ("b", "M"), ("c", "M")], "card_id string, cluster_id string")
    got = {r["cluster_id"]: r for r in midlayer.tempo(members, cards_, "cluster_id").collect()}
    assert got["L"]["cov"] == 999 and got["L"]["span_days"] == 0 and got["M"]["span_days"] == 31


def test_snapshot_events(spark):
    kind = "cluster_id string, card_id string"
    old = spark.createDataFrame([("A", "1"), ("A", "2"), ("B", "3"), ("C", "4"), ("D", "5"), ("D", "6"), ("D", "7")], kind)
    new = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "9"), ("m", "3"), ("m", "4"), ("x", "5"), ("y", "6"), ("z", "7"), ("n", "10")], kind)
    got = set(rows(midlayer.tree_diff(old, new)))
    assert {("continued", "a", 1), ("merged", "m", 2), ("new", "n", 1), ("split", "D", 3)} <= got


def test_duplicates_at_the_containment_threshold(spark):
    data = [("a", str(i)) for i in range(20)] + [("b", str(i)) for i in range(17)] + [("c", str(i)) for i in range(4, 24)] + [("d", str(i)) for i in range(20)] + [("e", str(i)) for i in [*range(3, 20), 90, 91, 92]]
    got = {(r["a"], r["b"]): r["containment"] for r in midlayer.duplicate_pairs(spark.createDataFrame(data, "card_id string, source_uuid string")).collect()}
    assert got[("a", "d")] == 1 and got[("a", "b")] == 1 and got[("a", "e")] == 0.85 and ("a", "c") not in got


def test_parse_cards_keeps_empty_fields(spark):
    text = "noise\nturns:1-3\nheadline: H\nshare:\nprivate: p1\np2\ntags: A/b、a\nturns: 3-5\nheadline:\nshare: s\nprivate:\ntags:\n"
    got = spark.createDataFrame([(text,)], "t string").select(cards.parse_cards(F.col("t")).alias("x")).first()["x"]
    assert [tuple(x)[:5] for x in got] == [(1, 3, "H", "", "p1\np2"), (3, 5, "", "s", "")]
    assert got[0]["tags"] == ["a", "b"] and got[1]["tags"] == []


def test_freeze_and_refeed():
    def two(rounds_, texts):
        middle = rounds_[len(rounds_) // 2]
        return [(rounds_[0], middle, "x"), (middle, rounds_[-1], "y")]

    got = cards.freeze_refeed(list(range(1, 41)), ["t"] * 40, two)
    assert got[0][0] == 1 and got[-1][1] == 40
    assert all(a[1] == b[0] for a, b in zip(got, got[1:], strict=False))
    assert cards.freeze_refeed([1, 2], ["t", "t"], two) == [(1, 2, "x"), (2, 2, "y")]
    with pytest.raises(ValueError):
        cards.freeze_refeed([1], ["t"], lambda r, t: [])


def test_large_graphs_are_split_by_all_tasks(spark):
    rng = np.random.default_rng(9)
    n, groups = 600, 12
    a, b = rng.integers(0, n, 14_000), rng.integers(0, n, 14_000)
    keep = (a < b) & ((a % groups == b % groups) | (rng.random(len(a)) < 0.05))
    pairs = sorted(set(zip(a[keep].tolist(), b[keep].tolist(), strict=True)))
    a, b = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    edges = spark.createDataFrame([(f"{x:04d}", f"{y:04d}", 1.0) for x, y in pairs], "a string, b string, weight double")
    for most in (100, 10_000):
        found = {r["node"]: r["part"] for r in leiden.coarsened(edges, most).collect()}
        names = sorted({int(x) for x in found})
        part = np.array([found[f"{x:04d}"] for x in names])
        place = {x: i for i, x in enumerate(names)}
        u, v = np.array([place[x] for x in a]), np.array([place[x] for x in b])
        local = leiden.partition(len(names), u, v, np.ones(len(u)))
        score = lambda p, u=u, v=v, k=len(names): leiden.modularity(k, u, v, np.ones(len(u)), p)
        assert score(part) > 0.85 * score(local) and set(part) == set(range(part.max() + 1))
    paths = {r["card_id"]: r["path"] for r in leiden.hierarchy(edges, spark.createDataFrame([(f"{x:04d}",) for x in range(n)], "card_id string"), max_local=500).collect()}
    assert len(paths) == n and len({p.split(".")[1] for p in paths.values() if "." in p}) >= 8


def test_moves_send_counted_parts_to_the_edges(spark, monkeypatch):
    pairs = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "xyz" for i in range(8) for j in range(i)] + [("x0", "y0", 1.0), ("y1", "z0", 1.0)]
    edges = spark.createDataFrame(pairs, "a string, b string, weight double")
    few = rows(leiden._moves(edges, 4))
    monkeypatch.setattr(leiden, "MAX_HELD", 3)  # with more nodes the same joins shuffle
    assert rows(leiden._moves(edges, 4)) == few and len(few) == 24


def test_leiden_finds_planted_parts():
    rng = np.random.default_rng(1)
    label = np.arange(80) // 20
    pairs = [(i, j) for i in range(80) for j in range(i) if rng.random() < (0.6 if label[i] == label[j] else 0.02)]
    a, b = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    part = leiden.partition(80, a, b, np.ones(len(a)))
    assert len({(x, y) for x, y in zip(part, label, strict=True)}) == 4
    assert (part == leiden.partition(80, a, b, np.ones(len(a)))).all()
    assert leiden.modularity(80, a, b, np.ones(len(a)), part) > 0.5


def test_small_graphs_stay_whole(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0)], "a string, b string, weight double")
    got = dict(leiden.hierarchy(edges, spark.createDataFrame([("a",), ("b",), ("c",), ("z",)], "card_id string")).collect())
    assert got["a"] == got["b"] == got["c"] and got["z"] == "z"


def test_violations(spark):
    nodes = spark.createDataFrame([("a", None, "message", "user", "x"), ("b", "zz", "message", None, "x"), ("c", "a", "tool", "user", None), ("a", None, "odd", None, None)], "node_id string, parent_id string, kind string, role string, text string")
    assert rows(violations.duplicates(nodes, "node_id")) == [("duplicate", "a")]
    assert rows(violations.missing_parent(nodes)) == [("missing parent", "b")]
    assert rows(violations.bad_shape(nodes)) == [("shape", "a"), ("shape", "b"), ("shape", "c")]
    with pytest.raises(ValueError, match="missing parent: b"):
        violations.require_none(violations.missing_parent(nodes))


def test_clean_user_text(spark):
    cases = {"<system-reminder>x\ny</system-reminder>hello ": "hello", "<command-name>/a</command-name><command-args>one</command-args>": "", "<command-name>/a</command-name><command-args>two words</command-args>": "two words", None: ""}
    for raw, want in cases.items():
        assert spark.createDataFrame([(raw,)], "t string").select(c.clean_user_text(F.col("t"))).first()[0] == want


def test_journal_files(spark, tmp_path):
    lines = [
        '{"uuid":"1","sessionId":"s","timestamp":"2024-01-01T00:00:00Z","message":{"role":"user","content":"hi"}}', "{broken",
        '{"uuid":"2","parentUuid":"1","sessionId":"s","timestamp":"2024-01-01T00:00:01Z","message":{"role":"assistant","content":[{"type":"text","text":"yo"},{"type":"image"}]}}',
        '{"uuid":"3","parentUuid":"2","sessionId":"s","timestamp":"2024-01-01T00:00:02Z","toolUseResult":{"a":1},"message":{"role":"user","content":"tool"}}',
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    parsed = journal.parse_lines(journal.read_lines(spark, str(tmp_path)))
    assert rows(journal.messages(parsed).select("uuid", "text")) == [("1", "hi"), ("2", "yo")]
    assert rows(parsed.where("NOT bad").select("uuid", journal.node_kind())) == [("1", "message"), ("2", "message"), ("3", "tool")]
    with pytest.raises(Exception, match="no JSON object"):
        journal.tree_from_journal(parsed, "r")[0].collect()


def test_strict_envelope(spark):
    body = '{"format":"normalized-v2","source":"a","source_route":"%s","messages":[{"native_session_id":"s","native_message_id":"m%d","role":"user","text":"t","occurred_at":"2024-01-01T00:00:00+01:00","source_sequence":1}]}'
    files = spark.createDataFrame([("p", body % ("x", 1))], "path string, value string")
    got = envelopes.normalized_messages(files, {"x": "room"}).first()
    assert got["room"] == "room" and got["occurred_at"] == "2023-12-31T23:00:00.000000Z" and got["session_id"].startswith("session:")
    with pytest.raises(Exception, match="unknown route"):
        envelopes.normalized_messages(files, {"y": "room"}).collect()


def test_transcript(spark):
    files = spark.createDataFrame([("p.txt", "01L\nhello\nthere\n01C\nhi\n02L\nbye")], "path string, value string")
    got = [tuple(r) for r in envelopes.transcript_messages(files).select("round", "role", "text").collect()]
    assert got == [(1, "user", "hello\nthere"), (1, "assistant", "hi"), (2, "user", "bye")]
    assert files.select(envelopes.family()).first()[0] == "transcript"


def test_versioned_table(spark, tmp_path):
    from tidewell.store import VersionedTable

    table = VersionedTable(spark, f"file://{tmp_path}/t")
    assert table.read() is None
    frame = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    table.upsert(frame((1, "a"), (2, "b")), ["k"])
    table.upsert(frame((2, "z"), (3, "c")), ["k"], keep="first")
    assert rows(table.read()) == [(1, "a"), (2, "b"), (3, "c")]
    table.stage(frame((9, "lost")))  # a crash before the swap
    assert rows(table.read()) == [(1, "a"), (2, "b"), (3, "c")]
    table.upsert(frame((1, "new")), ["k"], keep="last")
    assert rows(table.read()) == [(1, "new"), (2, "b"), (3, "c")]
    assert table.vacuum() >= 2 and table.read().count() == 3


def test_rewired_graphs_keep_their_degrees():
    rng = np.random.default_rng(4)
    pairs = np.array([(i, j) for i in range(60) for j in range(i) if rng.random() < (0.5 if i % 3 == j % 3 else 0.05)])
    a, b = pairs[:, 1], pairs[:, 0]  # as in a card graph the lesser name comes first
    x, y = leiden._swapped(60, a, b, 0)
    assert (np.bincount(np.r_[x, y], minlength=60) == np.bincount(np.r_[a, b], minlength=60)).all() and (x != y).all()
    assert len({(min(p), max(p)) for p in zip(x.tolist(), y.tolist(), strict=True)}) == len(a)  # no pair twice
    assert (np.bincount(x, minlength=60) != np.bincount(a, minlength=60)).any()  # an edge has no direction
    alone = [leiden.rewired(60, a, b, np.ones(len(a)), i) for i in range(20)]
    beside = leiden.nulls(60, a, b, np.ones(len(a)), 0, 20)
    assert abs(np.mean(alone) - np.mean(beside)) < 0.02
    assert leiden.beaten(leiden.modularity(60, a, b, np.ones(len(a)), np.arange(60) % 3), beside)


def test_a_verdict_before_the_last_rewired_graph_is_the_verdict_of_all():
    rng = np.random.default_rng(8)
    early = 0
    for _ in range(200):
        values = rng.normal(0.3, 0.02, 20).tolist()
        q = float(rng.uniform(0.2, 0.45))
        last = leiden.beaten(q, values)
        assert last == (q > np.mean(values) + 2 * np.std(values))
        for n in (5, 10, 15):
            got = leiden.beaten(q, values[:n])
            early += got is not None
            assert got is None or got == last
    assert early > 50


@pytest.mark.parametrize("most", [40, 10_000])
def test_numbered_cards_are_split_as_joined_ones(spark, monkeypatch, most):
    pairs = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "wxyz" for i in range(9) for j in range(i)] + [("w0", "x0", 0.5), ("x1", "y0", 0.5), ("y1", "z0", 0.5), ("p", "q", 1.0)]
    edges = spark.createDataFrame([(min(a, b), max(a, b), w) for a, b, w in pairs], "a string, b string, weight double")
    nodes = spark.createDataFrame([(x,) for x in sorted({p for e in pairs for p in e[:2]} | {"lone"})], "card_id string")

    def groups(found):
        by: dict = {}
        for card, path in found.collect():
            by.setdefault(path, set()).add(card)
        return by

    held = groups(leiden.hierarchy(edges, nodes, most))
    assert held["lone"] == {"lone"} and held["p"] == {"p", "q"} and sum(map(len, held.values())) == nodes.count()
    assert {frozenset(x) for x in held.values()} >= {frozenset(f"{g}{i}" for i in range(9)) for g in "wxyz"}
    monkeypatch.setattr(leiden, "MAX_HELD", 3)
    assert {frozenset(x) for x in groups(leiden.hierarchy(edges, nodes, 10_000)).values()} == {frozenset(x) for x in held.values()}
