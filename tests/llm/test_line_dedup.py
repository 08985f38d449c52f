"""op6 against a plain greedy parse, at any size of a leaf."""

import collections

import pytest
import xxhash

from tests.conftest import SF
from tidewell.llm import line_dedup


def brute_templates(lines):
    """The greedy rule without any index: every line is compared with every template before it."""
    templates, out = [], []
    for words in lines:
        for k, template in enumerate(templates):
            agree = [a for a, b in zip(template, words, strict=True) if a == b]
            if len(agree) >= line_dedup.SIMILARITY * len(words) and sum(a != line_dedup.VARIABLE for a in agree) >= len(words) / 2:
                templates[k] = [a if a == b else None for a, b in zip(template, words, strict=True)]
                break
        else:
            k = len(templates)
            templates.append(list(words))
        out.append(k)
    return out


def brute_texts(docs):
    where, leaves, drop = collections.defaultdict(list), collections.defaultdict(set), set()
    for d, t in docs:
        for i, line in enumerate(t.split("\n")):
            words = line_dedup._words_of(line)
            if len(words) >= line_dedup.MIN_WORDS:
                where[line].append((d, i))
                leaves[len(words), tuple(words[: line_dedup.LEVELS])].add(line)
    signed = lambda x: (h := xxhash.xxh64_intdigest(x.encode(), 42)) - (1 << 64 if h >> 63 else 0)
    for lines in leaves.values():
        ordered, groups = sorted(lines, key=signed), collections.defaultdict(list)
        for number, line in zip(brute_templates([line_dedup._words_of(x) for x in ordered]), ordered, strict=True):
            groups[number] += where[line]
        for places in groups.values():
            if len({d for d, _ in places}) > 1:
                drop |= set(places) - {min(places)}
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in drop) for d, t in docs}


def name(i):
    return "".join("abcdefghij"[int(c)] for c in str(i))


@pytest.mark.parametrize("max_leaf", [1, 8, 2_000])
def test_drops_do_not_depend_on_the_size_of_a_leaf(spark, max_leaf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(300).collect()]
    docs += [(10**6 + i, f"posted in the {name(i)} section by our staff writer today\nsix words with {name(i)} in it\nwe said {name(i % 7)} {name(i % 3)} {name(i % 2)} {name(i % 5)} to all of them") for i in range(60)]
    want = brute_texts(docs)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), max_leaf=max_leaf).collect()}
    assert got == want
    assert sum("staff writer" in t for t in got.values()) == 1


def test_lines_with_several_numbers_recur(spark):
    data = [(i, f"Page {i} of 17{i} from {2020 + i}\nPosted 2024-05-0{i} 12:3{i} by user{i} here\n{i} {i + 1} {i + 2} {i + 3} {i + 4} {i + 5}\nNorth 1{i} 2{i} 3{i} 4{i}") for i in range(1, 6)]
    got = {r["doc_id"]: r["text"].split("\n") for r in line_dedup.dedup_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got[1] == data[0][1].split("\n")
    assert all(got[i] == data[i - 1][1].split("\n")[2:] for i in range(2, 6))


def test_one_rule_of_white_space(spark):
    spaces = [c for c in map(chr, range(0x110000)) if c.isspace() and c != "\n"]
    lines = ["see the terms of use", "see the terms of use today", "see the terms of use\r", "\tsee the terms of use", "see\u00a0the terms of use", "four words are few\r", "\u0663 the terms of use"]
    lines += [f"{c}see{c}{c}the terms of use{c}" for c in spaces] + [f"a{c}b" for c in spaces] + ["", " ", "x" * 9_000]
    docs = [(i, line) for i, line in enumerate(lines)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"] for r in line_dedup.occurrences(frame).collect()} == {i for i, line in docs if len(line.split()) >= line_dedup.MIN_WORDS}
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame).collect()}
    assert got == brute_texts(docs)
    assert got[0] == lines[0] and got[1] == lines[1] and got[2] == got[3] == got[4] == "" and got[5] == lines[5]
