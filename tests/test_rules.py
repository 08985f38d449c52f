"""Rules that stop a load, and modules that hand things out."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidewell import models, publish, schema
from tidewell.operators import cards, history, snapshot, tree
from tidewell.plans.corpus import Corpus
from tidewell.sources import envelopes, journal
from tidewell.store import Texts, VersionedTable


def parsed(spark, *rows):
    lines = [("/j/" + r.pop("path", "a"), i, json.dumps(r)) for i, r in enumerate(rows)]
    return journal.parse_lines(spark.createDataFrame(lines, "path string, line_no int, value string"))


def row(uuid, parent=None, second=0, kind="user", text="hi", **more):
    message = {"message": {"role": kind, "content": text}} if kind in ("user", "assistant") else {}
    return {"uuid": uuid, "parentUuid": parent, "sessionId": "s", "timestamp": f"2024-01-01T00:00:{second:02d}Z", "type": kind} | message | more


def tree_of(spark, *rows):
    return {r["native_id"]: r for r in journal.tree_from_journal(parsed(spark, *rows), "r")[0].collect()}


def test_retries_become_a_chain_and_forks_stay(spark):
    error = lambda u, s, parent="u1": row(u, parent, s, "system", subtype="api_error")
    got = tree_of(
        spark, row("u1"), error("e2", 2), error("e1", 1), row("a1", "u1", 5, "assistant", "yo"), row("u2", "u1", 6), row("h", "e1", 7, "system", subtype="stop_hook_summary"),
        row("c", None, 8, "system", subtype="compact_boundary", logicalParentUuid="a1"), row("u3", "c", 9),
    )
    assert {k: r["parent"] for k, r in got.items()} == {"u1": None, "e1": "u1", "e2": "e1", "a1": "e2", "u2": "u1", "h": "a1", "c": "a1", "u3": "c"}
    late = tree_of(spark, row("u1"), error("e1", 9), row("a1", "u1", 5, "assistant", "yo"))
    assert late["a1"]["parent"] == "u1" and late["e1"]["parent"] == "u1"
    two = tree_of(spark, row("u1"), error("e1", 1), row("a1", "u1", 5, "assistant", "x"), row("a2", "u1", 6, "assistant", "y"))
    assert {two[k]["parent"] for k in ("e1", "a1", "a2")} == {"u1"}


@pytest.mark.parametrize(
    ("rows", "problem"),
    [
        ([row("u"), row("u", text="other", path="b")], "conflicting content: u"),
        ([row("a"), row("b"), row("u", "a"), row("u", "b", path="b")], "ambiguous parents: u"),
        ([row("u", "gone")], "missing parent: u"),
        ([row("u1"), row("e", "u1", 1, "system", subtype="api_error"), row("a", "u1", 5, "assistant", "x")] + [row(h, "e", 6, "system", subtype="stop_hook_summary") for h in "hk"], "ambiguous stop hooks"),
        ([row("x"), row("y")] + [row("c", None, 1, "system", subtype="compact_boundary", logicalParentUuid=p, path=f) for p, f in (("x", "a"), ("y", "b"))], "conflicting parents: c"),
    ],
)
def test_conflicts_stop_the_load(spark, rows, problem):
    with pytest.raises(Exception, match=problem):
        tree_of(spark, *rows)


def test_copies_and_compactions(spark):
    got = tree_of(spark, row("a"), row("k", "a", 1, isCompactSummary=True), row("u", "a", 2), row("u", "k", 2, path="b"))
    assert got["u"]["parent"] == "a" and got["k"]["kind"] == "checkpoint" and got["u"]["kind"] == "message"
    failed = tree_of(spark, row("a"), {"type": "phone-error", "uuid": "p", "parentUuid": "a", "sessionId": "s", "timestamp": "2024-01-01T00:00:01Z"})
    assert (failed["a"]["kind"], failed["a"]["source_type"], failed["a"]["text"]) == ("event", "user:failed-attempt", None)
    with pytest.raises(Exception, match="no JSON object"):
        lines = spark.createDataFrame([("/j/a", 0, "{broken")], "path string, line_no int, value string")
        journal.tree_from_journal(journal.parse_lines(lines), "r")[0].collect()


def envelope(spark, *messages, **more):
    base = {"native_session_id": "s", "role": "user", "text": "x", "occurred_at": "2024-01-01T00:00:00Z"}
    value = json.dumps({"format": "normalized-v2", "source": "chat", "source_route": "front", "messages": [base | m for m in messages]} | more)
    return envelopes.normalized_messages(spark.createDataFrame([("/e/a.json", value)], "path string, value string"), {"front": "hall"})


def test_envelopes_are_strict(spark):
    one = {"native_message_id": "1", "source_sequence": 0}
    assert envelope(spark, one, {"native_message_id": "2", "source_sequence": 1}).count() == 2
    for bad, problem in (
        ([one, one | {"source_sequence": 1}], "message twice"), ([one, {"native_message_id": "2", "source_sequence": 0}], "sequence twice"), ([one | {"source_sequence": -1}], "bad sequence"),
        ([one | {"native_message_id": " "}], "no identity"), ([one | {"role": "tool"}], "no identity"),
    ):
        with pytest.raises(Exception, match=problem):
            envelope(spark, *bad).collect()
    with pytest.raises(Exception, match="unknown format"):
        envelopes.tree_nodes(spark.createDataFrame([("/t/a.json", '{"format": "else", "source": "x", "room": "r", "nodes": [], "observations": []}')], "path string, value string"))[0].collect()


def export(spark, *snaps):
    files = [(f"/x/{i}.json", json.dumps([{"uuid": "c", "updated_at": at, "chat_messages": [{"uuid": u, "sender": "human", "created_at": "2024-01-01T00:00:00Z", "text": t} for u, t in said]}])) for i, (at, said) in enumerate(snaps)]
    return envelopes.export_messages(spark.createDataFrame(files, "path string, value string"))


def test_archives_that_lose_or_differ_stop(spark):
    assert envelopes.archive_tree(export(spark, ("1", [("a", "x")]), ("2", [("a", "x"), ("b", "y")])), "r").count() == 2
    for snaps in ([("1", [("a", "x"), ("b", "y")]), ("2", [("a", "x")])], [("1", [("a", "x")]), ("1", [("a", "z")])]):
        with pytest.raises(Exception, match="omits earlier nodes|ambiguous snapshots"):
            envelopes.archive_tree(export(spark, *snaps), "r").collect()


def test_the_latest_snapshot_may_have_lost_all_messages(spark):
    chat = lambda at, *said: json.dumps([{"uuid": "c", "updated_at": at, "chat_messages": [{"uuid": u, "sender": sender, "created_at": "2024-01-01T00:00:00Z", "text": "x"} for u, sender in said]}])
    files = spark.createDataFrame([("/x/0.json", chat("1", ("s", "system"), ("a", "human"))), ("/x/1.json", chat("2", ("s", "system")))], "path string, value string")
    said, snaps = envelopes.export_messages(files), envelopes.export_snapshots(files)
    assert [r["path"] for r in envelopes.snapshot_select(said, snaps).collect()] == ["/x/1.json"]
    assert [tuple(r) for r in envelopes.snapshot_problems(said, snaps).collect()] == [("c", "omits earlier nodes")]
    with pytest.raises(Exception, match="omits earlier nodes"):
        envelopes.archive_tree(said, "r", snaps=snaps).collect()


def test_models_are_asked_again(spark, tmp_path):
    answers, slept = [RuntimeError("down"), "", "\x1b[1mfine\x1b[0m\x07"], []

    def model(_):
        found = answers.pop(0)
        if isinstance(found, Exception):
            raise found
        return found

    ask = models.Retrying(model, sleep=slept.append)
    assert ask("q") == "fine" and slept == [30, 60] and [a["status"][:2] for a in ask.attempts] == ["Ru", "ok", "ok"]
    handed = models.Retrying(lambda _: 1 / 0, artifact=lambda: "done", sleep=slept.append)
    assert handed("q") == "done" and len(handed.attempts) == 1
    with pytest.raises(ZeroDivisionError):
        models.Retrying(lambda _: 1 / 0, sleep=slept.append)("q")
    for run in ("r1", "r2"):
        models.record(spark, f"file://{tmp_path}/calls", run, "q", ask.attempts, datetime.datetime(2024, 1, 1), {"b": 1, "a": 2})
    calls = spark.read.parquet(f"file://{tmp_path}/calls")
    assert calls.count() == 6 and {r["parsed"] for r in calls.where("attempt = 3").collect()} == {'{"a": 2, "b": 1}'}


def test_vectors_are_made_once(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c")], "id long, text string")
    cache = models.embed(models.missing(models.with_cached(texts.where("id = 1"), spark.createDataFrame([], "cache_key string, vector array<float>"), "api", "m")), lambda: lambda t: [[1.0] for _ in t])
    found = models.with_cached(texts, cache, "api", "m")
    assert {r["id"]: r["vector"] for r in found.collect()} == {1: [1.0], 2: None, 3: None, 4: None}
    assert sorted(r["text"] for r in models.missing(found).collect()) == ["b", "c"]


def test_files_of_a_room(spark, tmp_path):
    at = f"file://{tmp_path}/rooms"
    rows = [{"content": "x", "shared": True}, {"content": "y", "shared": False}]
    publish.publish(spark, at, "attic", {"constants.md": publish.constants_text(rows, "attic"), "digest.md": publish.digest_text("2024-01-01", " body ")})
    publish.publish(spark, at, "attic", {"digest.md": publish.digest_text("2024-01-02", "new")})
    folder = Texts(spark, f"{at}/attic")
    assert folder.get("digest.md") == "# digest of 2024-01-02\n\nnew\n" and "## shared\n- x\n\n## attic\n- y" in folder.get("constants.md") and len(folder.names()) == 2
    with pytest.raises(ValueError, match="blank"):
        publish.publish(spark, at, "attic", {"digest.md": " "})


def test_dump_and_bundle(spark, tmp_path):
    c = Corpus(spark, SF)
    publish.dump_json(c.turns, f"file://{tmp_path}/dump", 1)
    lines = [json.loads(r["value"]) for r in spark.read.text(f"file://{tmp_path}/dump").collect()]
    last = {r["session_id"]: r["m"] for r in c.turns.groupBy("session_id").agg(F.max("round").alias("m")).collect()}
    assert lines and all(x["round"] == last[x["session_id"]] for x in lines)
    publish.write_bundle({"cards": c.cards.select("card_id")}, f"file://{tmp_path}/bundle")
    assert spark.read.parquet(f"file://{tmp_path}/bundle/cards").count() == c.cards.count()


def test_versions_backups_and_migrations(spark, tmp_path):
    at = f"file://{tmp_path}/tables"
    VersionedTable(spark, f"{at}/cards").write(spark.createDataFrame([("1", "first\nmore", ""), ("2", "", "own")], "card_id string, share string, private string"))
    VersionedTable(spark, f"{at}/turns").write(spark.createDataFrame([("1", "2024-01-01T00:00:00Z"), ("2", "never")], "source_uuid string, ts string"))
    with pytest.raises(ValueError, match="version 1"):
        schema.require_version(spark, at)
    assert schema.migrate(spark, at, ["cards", "turns"]) == 2 and schema.migrate(spark, at, ["cards", "turns"]) == 0
    schema.require_version(spark, at)
    table = VersionedTable(spark, f"{at}/cards")
    assert {r["card_id"]: r["headline"] for r in table.read().collect()} == {"1": "first", "2": "own"}
    assert [r["ts"] is None for r in VersionedTable(spark, f"{at}/turns").read().orderBy("source_uuid").collect()] == [False, True]
    for i in range(4):
        table.write(spark.range(i + 1))
    assert table.vacuum(keep=3) == 3 and len(table.versions()) == 3 and table.read().count() == 4
    table.restore(table.versions()[1])
    assert table.read().count() == 3
    with pytest.raises(ValueError):
        table.restore("v-none")


def test_repairs_are_refused_under_cards(spark):
    turns = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "session_id long, source_uuid string, round long")
    failed = spark.createDataFrame([("b",)], "user_uuid string")
    card = lambda a, b: spark.createDataFrame([(1, "c", a, b)], "session_id long, card_id string, turn_start int, turn_end int")
    assert schema.repair_attempts(failed, turns, card(1, 1), apply=True).count() == 1 and schema.repair_attempts(failed, turns, card(1, 1)).count() == 2
    with pytest.raises(ValueError, match="covers b"):
        schema.repair_attempts(failed, turns, card(1, 2), apply=True)
    rows = spark.createDataFrame([("x",), ("y",)], "card_id string")
    only = lambda *ids: spark.createDataFrame([(i,) for i in ids], "card_id string")
    assert cards.apply_decisions(rows, only("x"), only("y"), apply=True).count() == 1 and cards.apply_decisions(rows, only("x"), only("y")).count() == 2
    for keep, drop in ((only("x"), only("x")), (only("x"), only("z"))):
        with pytest.raises(ValueError):
            cards.apply_decisions(rows, keep, drop)


def test_sessions_are_isolated():
    def work(session):
        if session == 2:
            raise RuntimeError("no")

    assert cards.run_sessions([1, 2, 3, 4], work, 3) == ([1, 3], {2: "RuntimeError: no"})


def test_projections_never_change(spark):
    node = lambda text: spark.createDataFrame([("n", "user", text, None)], "node_id string, role string, text string, occurred_at timestamp_ntz")
    stored = spark.createDataFrame([("n", "user", "x", None)], "source_uuid string, role string, text string, ts timestamp_ntz")
    names = {"user": "Ann", "assistant": "Bot"}
    assert cards.project_messages(node("x"), stored, names).count() == 0 and cards.project_messages(node("x"), stored.limit(0), names).first()["speaker"] == "Ann"
    with pytest.raises(Exception, match="projection conflict: n"):
        cards.project_messages(node("y"), stored, names).collect()


def test_history_document(spark):
    c = Corpus(spark, SF)
    roots = tree.node_root(c.forest).select("node_id", "root")
    page = history.render(c.forest, roots, c.observations, "src4", "chat", "ctx4")
    ids = {n["node_id"]: n["parent_id"] if "parent_id" in n else None for n in page["nodes"]}
    assert page["format"] == "history-v1" and page["roots"] and all(r in ids and ids[r] is None for r in page["roots"])
    for seen in page["observations"]:
        path = seen["path"]
        assert (seen["kind"] == "cursor") == bool(path)
        if path:
            assert path[-1] == seen["node_id"] and path[0] in page["roots"] and all(ids[b] == a for a, b in zip(path, path[1:], strict=False))
    with pytest.raises(ValueError, match="more than"):
        history.render(c.forest, roots, c.observations, "src4", most=1)


def test_report_as_text():
    rows = [{"section": "fresh", "place": 1, "key": "L1", "n_cards": 3, "n_new": 2, "note": "new"}, {"section": "community", "place": 1, "key": "C1", "n_cards": 9, "n_new": 2, "note": "2024-01-02"}]
    text = snapshot.render(rows, "2024-01-02", "2024-01-01")
    assert text.index("C1  9  +2") < text.index("L1  3  +2  new") and "against 2024-01-01" in text


def test_files_are_found_oldest_first(spark, tmp_path):
    import os

    for i, name in enumerate(("b.json", "a.json", "c.txt")):
        (tmp_path / name).write_text("x" * (i + 1))
        os.utime(tmp_path / name, (1_700_000_000 + i, 1_700_000_000 + i))
    got = envelopes.discover(spark, str(tmp_path), "*.json").collect()
    assert [(r["path"].rsplit("/", 1)[1], r["bytes"]) for r in got] == [("b.json", 1), ("a.json", 2)]


def test_cards_stream_through_windows(spark):
    """The streamed form against the list form, with whole texts and several sessions a partition."""
    rng = __import__("random").Random(3)
    rows = [(s, r, m, f"s{s} r{r} m{m}\nsecond line") for s in range(7) for r in range(1, 2 + s * 9) for m in range(1, rng.randint(2, 4))]
    seen = []

    def summarize(rounds, texts):
        assert all(t.startswith("s") and t.endswith("second line") for t in texts)
        return [(rounds[0], rounds[len(rounds) // 2], texts[0].split("\n")[0]), (rounds[len(rounds) // 2], rounds[-1], f"{len(rounds)} {texts[-1].count('second')}")]

    frame = spark.createDataFrame(rows, "session_id long, round long, message_seq long, text string").repartition(3)
    got = sorted(map(tuple, cards.generate(frame, 5, 3, summarize).collect()))
    for s in range(7):
        texts = {}
        for session, number, _, text in rows:
            if session == s:
                texts.setdefault(number, []).append(text)
        made = cards.freeze_refeed(sorted(texts), ["\n".join(texts[n]) for n in sorted(texts)], summarize, 5, 3)
        seen += [(s, i, *card) for i, card in enumerate(made, 1)]
    assert got == sorted(seen) and len(got) > 20
