"""Streams, state and the tools."""

import io
import json

from pyspark.sql import functions as F

from tests.conftest import SF
from tidewell.plans.corpus import Corpus
from tidewell.streaming import events, ingest
from tidewell.tools import Tools


def line(uuid, session, role, text, second):
    return json.dumps({"uuid": uuid, "sessionId": session, "timestamp": f"2024-01-01T00:00:{second:02d}Z", "message": {"role": role, "content": text}})


def test_watch_counts_real_changes(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    store = ingest.TurnStore(spark, f"file://{tmp_path}/store")
    run = lambda: ingest.watch(spark, str(folder), store, str(tmp_path / "check")).awaitTermination()
    (folder / "a.jsonl").write_text(line("1", "s", "user", "hi", 1) + "\n" + line("2", "s", "assistant", "yo", 2))
    run()
    assert store.revision() == 2
    run()  # nothing new
    assert store.revision() == 2
    (folder / "b.jsonl").write_text(line("1", "s", "user", "hi", 1) + "\n" + line("2", "s", "assistant", "yo", 2) + "\n" + line("3", "s", "user", "more", 3))
    run()  # a replay of two and one more
    assert store.revision() == 3
    assert [r["round"] for r in store.turns().orderBy("ord").collect()] == [1, 1, 2]
    (folder / "a.jsonl").unlink()
    listing = store.candidates().where("file LIKE '%b.jsonl'").select("file")
    assert store.reconcile(lambda rows: ingest.vanished(rows, listing)) == 3  # the other file has all rows
    assert store.candidates().count() == 3 and store.turns().count() == 3 and store.vacuum() >= 1 and store.turns().count() == 3
    assert store.reconcile(lambda rows: rows.limit(0)) == 6 and store.turns() is None


def test_a_crash_before_the_swap_changes_nothing(spark, tmp_path, monkeypatch):
    store = ingest.TurnStore(spark, f"file://{tmp_path}/store", 4)
    row = lambda session, uuid, role, minor: (session, uuid, role, "text " + uuid, 1, minor)
    kind = "session_id long, source_uuid string, role string, text string, major int, minor int"
    frame = lambda *rows: spark.createDataFrame(rows, kind).withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    assert store.add(frame(*[row(s, f"{s}-{i}", "user", i) for s in range(6) for i in range(2)])) == 12
    before = sorted(map(tuple, store.turns().collect()), key=str)
    put = type(store._files).put
    monkeypatch.setattr(type(store._files), "put", lambda *_: (_ for _ in ()).throw(OSError("crash")))
    late = frame(row(0, "0-2", "user", -1), row(0, "0-0", "user", 0))
    try:
        store.add(late)
    except OSError:
        pass
    assert store.revision() == 12 and sorted(map(tuple, store.turns().collect()), key=str) == before
    monkeypatch.setattr(type(store._files), "put", put)
    assert store.add(late) == 15  # one new turn, and two whose place moved
    assert store.add(late) == 15
    assert [r["source_uuid"] for r in store.turns().where("session_id = 0").orderBy("ord").collect()] == ["0-2", "0-0", "0-1"]
    assert store.vacuum() >= 1 and store.turns().count() == 13


def test_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k long, v string")
    new = spark.createDataFrame([(1, "a"), (2, None), (3, "z"), (4, "d")], "k long, v string")
    assert tuple(ingest.changes(old, new, ["k"], ["v"]).first()) == (1, 1, 0)
    assert tuple(ingest.changes(new, old, ["k"], ["v"]).first()) == (0, 1, 1)


def test_tail_state_survives_a_restart(spark, tmp_path):
    folder, out = tmp_path / "turns", []

    def run():
        stream = spark.readStream.schema("session_id long, round long").parquet(str(folder))
        query = events.tails(stream, 4).writeStream.outputMode("update").foreachBatch(lambda df, _: out.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "c"))
        query.trigger(availableNow=True).start().awaitTermination()

    spark.createDataFrame([(1, r) for r in range(1, 4)], "session_id long, round long").write.parquet(str(folder))
    run()
    spark.createDataFrame([(1, r) for r in range(4, 8)], "session_id long, round long").write.mode("append").parquet(str(folder))
    run()
    assert out == [(1, 0, 1, 3), (1, 4, 5, 7)]


def test_windows_agree_with_a_batch(spark, tmp_path):
    source = spark.read.parquet(f"{SF}/events.parquet")
    source.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "e"))
    query = events.windowed(stream, "1 day").writeStream.outputMode("complete").format("memory").queryName("windows_test").trigger(availableNow=True).start()
    query.awaitTermination()
    count = lambda df: {(r["start"], r["event_type"]): r["n"] for r in df.collect()}
    assert count(spark.table("windows_test")) == count(events.windowed(source, "1 day"))
    assert events.sessions(source).agg(F.sum("n")).first()[0] == source.count()


def test_tools(spark):
    c = Corpus(spark, SF)
    tools = Tools(c.cards, c.turns, c.card_tags, c.access, "src3")
    asked = ['{"id": 1, "method": "recent", "params": {"limit": 3}}', '{"id": 2, "method": "recent", "params": {"limit": 0}}', "{", '{"id": 3, "method": "nothing"}', '{"id": 4, "method": "card", "params": {"ids": ["d#3", "d#4"], "turns": true}}']
    sink = io.StringIO()
    tools.serve(io.StringIO("\n".join(asked)), sink)
    got = [json.loads(x) for x in sink.getvalue().splitlines()]
    assert len(got[0]["result"]) == 3 and got[1]["error"]["code"] == -32602 and got[2]["error"]["code"] == -32700 and got[3]["error"]["code"] == -32601
    cards = {r["card_id"]: r for r in got[4]["result"]}
    assert cards["d#4"]["private"] == "" and cards["d#4"]["turns"] == [] and "d#3" in cards
    ask = lambda method, **params: tools.answer({"id": 1, "method": method, "params": params})
    assert ask("recent", limit=2, bad=1, worse=2)["error"]["message"] == "unknown arguments: bad, worse"
    found = ask("recent", limit=3, expand=2)["result"]
    assert ["card" in r for r in found] == [True, True, False] and found[0]["card"]["card_id"] == found[0]["card_id"]
    assert ask("search", query=" ".join(f"w{i}" for i in range(13)))["error"]["code"] == -32602 and ask("search", query="...")["result"] == []
    headline = c.cards.where("share <> ''").orderBy("card_id").first()
    hits = ask("search", query=headline["share"].split()[5], limit=3, expand=1)["result"]
    assert hits and all(("【" in h["why"]) or h["why"] == "" for h in hits) and "card" in hits[0]
    draw = lambda seed: [r["card_id"] for r in ask("wander", limit=5, seed=seed)["result"]]
    assert draw(1) == draw(1) and len({tuple(draw(s)) for s in range(4)}) > 1


def test_command_line(spark, capsys, tmp_path):
    from tidewell import cli

    assert cli.run([SF, "list"]) == 0 and "session_forks" in capsys.readouterr().out
    assert cli.run([SF, "--viewer", "src3", "recent", "--limit", "2"]) == 0
    assert len(json.loads(capsys.readouterr().out)) == 2
    assert cli.run([SF, "recent", "--limit", "1", "--expand", "1"]) == 0 and "card" in json.loads(capsys.readouterr().out)[0]
    at = f"file://{tmp_path}"
    assert cli.run([SF, "dump", f"{at}/dump", "--tail", "1"]) == 0 and cli.run([SF, "--viewer", "src3", "bundle", f"{at}/bundle"]) == 0 and cli.run([SF, "bundle", f"{at}/b"]) == 2
    assert cli.run([SF, "reindex", f"{at}/index", "--buckets", "4"]) == 0 and cli.run([SF, "search", "thrend", "--index", f"{at}/index", "--limit", "2"]) == 0
    capsys.readouterr()
    assert cli.run([SF, "history", "src4", "--context", "ctx4"]) == 0 and json.loads(capsys.readouterr().out)["format"] == "history-v1"
    assert cli.run([SF, "history-search", "thing", "--limit", "2"]) == 0 and cli.run([SF, "gate", "--rounds", "2"]) == 0 and cli.run([SF, "history", "src4", "--most", "1"]) == 2
    assert cli.run([SF, "recent", "--limit", "1000"]) == 2 and cli.run([SF, "query", "nothing"]) == 2


def test_a_stored_index_answers_like_the_cards(spark, tmp_path):
    from tidewell.operators import search

    c = Corpus(spark, SF)
    cards = c.cards.select("card_id", "room", "headline", "share", "private", "card_ts").cache()
    index = search.SearchIndex(spark, f"file://{tmp_path}/index", 4)
    some, rest = cards.where("doc_id % 2 = 0") if "doc_id" in cards.columns else cards.where("substring(card_id, 3, 9) % 2 = 0"), cards.where("substring(card_id, 3, 9) % 2 = 1")
    index.replace(some.withColumn("share", F.lit("old words zzz")))
    index.replace(rest)
    index.replace(some)  # in place of what these cards were
    index.replace(spark.createDataFrame([("gone", "src3", "thrend", "", "")], "card_id string, room string, headline string, share string, private string"))
    index.remove(spark.createDataFrame([("gone",)], "card_id string"))
    query = "thrend thonea"
    groups = search.terms(query)
    want = [tuple(r) for r in search.search(cards, None, c.card_tags, query, "src3", 50).collect()]
    assert [tuple(r) for r in search.search(cards, index.read(groups), c.card_tags, query, "src3", 50).collect()] == want
    exact = [search.bm25(i, search.totals_of(i), groups, list(search.FIELDS), F.lit(True), every=False, prefix=False).orderBy("card_id").collect() for i in (index.read(groups, prefix=False), search.matching(cards, groups))]
    assert exact[0] == exact[1] and index.read([["zzz"]]).where("token = 'zzz'").isEmpty()


def test_words_and_terms():
    import pytest

    from tidewell.operators import search

    assert search.words_of("Caf\u00e9_Na\u00efve 12") == ["cafe", "naive", "12"]
    assert search.words_of("\u4f60\u597d\u5417ab") == ["\u4f60", "\u597d", "\u5417", "\u4f60\u597d", "\u597d\u5417", "ab"]
    assert search.terms("\u4f60\u597d\u5417 !! A a") == [["\u4f60\u597d", "\u597d\u5417"], ["a"]]
    assert search.fts_snippet("one two three four five six seven eight nine ten", ["nin"]) == "…three four five six seven eight 【nine】 ten"
    with pytest.raises(ValueError):
        search.terms(" ".join(f"t{i}" for i in range(13)))
    with pytest.raises(ValueError):
        search.history_terms(" ")
    assert search.history_terms("A a \u00c9") == ["a", "\u00e9"]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    from tidewell.sources import journal

    folder = tmp_path / "in" / "deep"
    folder.mkdir(parents=True)
    want = set()
    for name, n in (("a.jsonl", 900), ("b.jsonl", 1), ("c.jsonl", 300)):
        lines = [f"{name} {i}" + "x" * (i % 50) if i % 7 else "" for i in range(n)]
        (folder / name).write_bytes(("\r\n" if name == "c.jsonl" else "\n").join(lines).encode())
        want |= {(name, i, line) for i, line in enumerate(lines) if line}
    (folder / "d.txt").write_text("no")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = {(r["path"].rsplit("/", 1)[1], r["line_no"], r["value"]) for r in journal.read_lines(spark, str(tmp_path / "in")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == want


def test_poller_and_lock(spark, tmp_path):
    import pytest

    at, now, done = f"file://{tmp_path}/state", [5], []
    poller = ingest.Poller(spark, at, "cards", lambda: now[0], lambda a, b: done.append((a, b)))
    assert not poller.poll() and not poller.poll()
    now[0] = 7
    assert poller.poll() and not poller.poll()
    now[0] = 3  # the store was replaced
    assert not poller.poll()
    now[0] = 4
    failing = ingest.Poller(spark, at, "cards", lambda: now[0], lambda a, b: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        failing.poll()
    assert poller.poll() and done == [(5, 7), (3, 4)]
    with ingest.WriterLock(spark, at), pytest.raises(TimeoutError):
        ingest.WriterLock(spark, at, 2, 0.01).__enter__()
    with ingest.WriterLock(spark, at, 1):
        pass
