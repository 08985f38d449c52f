import pytest
from pyspark.sql import functions as F

from tidewell.functions import labels
from tidewell.operators import checks


def test_judge_is_complete_or_fails():
    asked = [("Ann", ["ann ", "bob"]), ("cat", ["dog"])]
    assert checks.judge_batch(asked, checks.exact_names(asked)) == {"Ann": "ann ", "cat": None}
    for bad in ([{"tag": "Ann", "entity": None}], [{"tag": "x"}], [{"tag": "Ann", "entity": "zed"}], [{"tag": "Ann"}, {"tag": "Ann"}]):
        with pytest.raises(ValueError):
            checks.judge_batch(asked, bad)


def test_submission_and_summary():
    good = {"digest": "text", "constants": [{"op": "add", "content": "x", "shared": True}, {"op": "retire", "constant_id": "1"}]}
    assert checks.submission(good, {"1"}, 10) == []
    bad = {"digest": "a" * 100, "other": 1, "constants": [{"op": "update", "constant_id": "9", "content": " "}, {"op": "drop"}]}
    assert len(checks.submission(bad, {"1"}, 10)) == 4
    assert checks.submission({"digest": "a" * 44, "constants": [{"op": "update", "constant_id": "1", "shared": False}], "constants_md": "x"}, {"1"}, 10) == []
    worse = {"digest": "a" * 45, "constants": [{"op": "update", "constant_id": "1"}, {"op": "retire"}, {"op": "add", "content": " "}], "constants_md": " "}
    assert len(checks.submission(worse, None, 10)) == 5
    assert checks.summary({"summary": "x" * 700}) == [] and checks.summary({"summary": "x" * 701}) and checks.summary([]) == ["summary is a text"]
    assert checks.policy(None) is False
    with pytest.raises(ValueError):
        checks.policy("yes")


def test_json_in_text():
    assert checks.extract_json('so:\n```json\n{"a": [1]}\n```\nbye') == {"a": [1]}
    assert checks.extract_json("x [1, {}] y") == [1, {}]
    with pytest.raises(ValueError):
        checks.extract_json("none")


def test_reports_round_trip():
    rows = [{"component": "a", "card_id": "a", "k": 2}, {"component": "a", "card_id": "b", "k": 1}, {"component": "c", "card_id": "c", "k": 1}]
    assert checks.review(checks.duplicate_report(rows)) == ({"b", "c"}, {"a"})
    assert checks.review("# group x\nDROP a\nDROP b") == (set(), set())
    with pytest.raises(ValueError):
        checks.review("# group x\nKEEP a\nDROP a")
    assert checks.ledger([{"day": 1, "room": "r", "headline": "h"}]) == "## 1\n- [r] h" and "Nothing" in checks.ledger([])


def test_globs(spark):
    df = spark.createDataFrame([("a/b.txt",), ("a.c",), ("axc",), ("b1",), ("bz",)], "p string")
    hit = lambda *g: sorted(r["p"] for r in df.where(labels.matches_glob(F.col("p"), list(g))).collect())
    assert hit("a*") == ["a.c", "a/b.txt", "axc"] and hit("a.c") == ["a.c"] and hit("b[0-9]") == ["b1"] and hit("b[!0-9]", "a?c") == ["a.c", "axc", "bz"] and hit() == []
