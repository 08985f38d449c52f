"""The training-corpus operators against brute force, round trips and held-out labels."""

import collections
import hashlib
import io
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import SF, TABLES
from tests.test_oracles import plain
from tidewell.llm import chat, components, decontaminate, html_text, line_dedup, media, ngram_join, packing, quality, queries, sharding, url_filters


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "one"), (5, "same words in five six seven"), (6, "same words in five six seven"), (None, "no id here at all now"), (None, None), (7, "é" * 5), (8, "long " * 40_000)]


def odd(spark):
    return spark.createDataFrame([(d, t, "en", "s", 1) for d, t in ODD], DOC)


def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, duck, name):
    frame = queries.QUERIES[name](spark, SF)
    found = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(frame.columns)
    want = sorted([plain(r[names.index(c)]) for c in sorted(names)] for r in found.fetchall())
    assert want == sorted([plain(r[c]) for c in sorted(names)] for r in frame.collect())


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    """The queries' tables with nulls, empty and long texts, repeated rows and clashing columns."""
    at = tmp_path_factory.mktemp("odd")
    odd(spark).withColumn("score", F.lit("clash")).withColumn("keys", F.lit(1)).write.parquet(f"file://{at}/documents.parquet")
    spark.createDataFrame([(4, 1, 0), (5, 0, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"file://{at}/labels.parquet")
    spark.createDataFrame([(0, None), (1, ""), (2, "same words in five six seven"), (2, "x y")], "item_id long, text string").write.parquet(f"file://{at}/benchmark.parquet")
    pages = [(1, None, None), (2, "", ""), (3, "no scheme", "<p>"), (4, "HTTP://A.NET:80", "<p>x</p>"), (4, "HTTP://A.NET:80", "<p>x</p>"), (None, "://EXAMPLE.net/en/?q", "<a" + "b" * 100_000)]
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit(1)).write.parquet(f"file://{at}/pages.parquet")
    turns = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", None), (1, None, None, "n"), (None, 1, "user", "<|im_end|>"), (2, 0, "system", "only"), (1, 700, "bob", "late")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("body", F.lit(2)).write.parquet(f"file://{at}/conversations.parquet")
    return f"file://{at}"


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("empty")
    for name in ("documents", "labels", "benchmark", "pages", "conversations"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).coalesce(1).write.parquet(f"file://{at}/{name}.parquet")
    return f"file://{at}"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_rows_and_empty_tables(spark, odd_dir, empty_dir, name):
    assert queries.QUERIES[name](spark, empty_dir).count() == 0
    got = queries.QUERIES[name](spark, odd_dir)
    n = got.count()
    if name.split("_")[0] in ("op2", "op4", "op6", "op7", "op8"):
        assert n == len(ODD)
    if name.startswith(("op1_", "op10")):
        assert n == 6


# op1
def brute_rule(url, rules):
    host, path = url_filters.split_url(url)
    fits = [(len(r), len(r.split("/")[0]), r, v) for r, v in rules if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return max(fits)[2:] if fits else None


RULES = [*url_filters.DEFAULT_RULES, ("a.net/", "allow"), ("a.net/x", "block"), ("b.a.net/", "block"), ("org/", "block")]
URLS = ["http://a.net/", "http://x.a.net/xy", "http://b.a.net/x", "http://aa.net/", "http://NET/x", "http://net", "https://q.org/fr/1", "https://q.org/f", "://example.NET/en/?x", "http://example.net/en", "x", "", None, "http://q.example.com/de/#a", "http://a.net:80/"]


def test_urls_by_brute_force_and_by_join(spark):
    want = {u: brute_rule(u or "", RULES) for u in URLS}
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    for found in (url_filters.url_filter(df, RULES), url_filters.match_by_join(df, spark.createDataFrame(RULES, "rule string, verdict string"))):
        got = {r["url"]: (r["rule"], r["verdict"]) if r["rule"] else None for r in found.collect()}
        assert got == want
    assert url_filters.url_filter(df, []).where("verdict = 'allow' AND rule IS NULL").count() == len(URLS)
    with pytest.raises(ValueError):
        url_filters.DigestIndex.build([("/x", "block")])


def test_digest_collisions_are_told_apart(monkeypatch):
    monkeypatch.setattr(url_filters, "digest", lambda host, path: 7)
    index = url_filters.DigestIndex.build([("aa/", "block"), ("bb/", "allow")])
    mapped = url_filters.DigestIndex.mapped(index.to_bytes(), index.sizes())
    assert mapped.probe(["aa", "bb", "cc"], ["/", "/", "/"]) == [("aa/", "block"), ("bb/", "allow"), None]


def test_many_rules_by_brute_force():
    rng = np.random.default_rng(7)
    label = lambda: "".join(rng.choice(list("ab"), int(rng.integers(1, 3))))
    host = lambda: ".".join(label() for _ in range(int(rng.integers(1, 5))))
    path = lambda: "/" + "/".join(label() for _ in range(int(rng.integers(0, 4))))
    rules = list({(host() + path()): ("block", "allow")[int(rng.integers(2))] for _ in range(600)}.items())
    index = url_filters.DigestIndex.build(rules)
    urls = [f"http://{host()}{path()}" for _ in range(400)] + ["http:///x", "http://a", "http://.a/", "http://a..b/a"]
    parts = [url_filters.split_url(u) for u in urls]
    got = url_filters.DigestIndex.mapped(index.to_bytes(), index.sizes()).probe([p[0] for p in parts], [p[1] for p in parts])
    assert got == [brute_rule(u, rules) for u in urls] and sum(g is not None for g in got) > 100


# op2
def test_shards_are_gapless_and_even(spark):
    got = sharding.op2_sharding(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id)
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    raw = {d: (t or "").encode() for d, t in zip(docs.doc_id, docs.text, strict=True)}
    assert all(s == len(raw[d]) + 1 and c == zlib.crc32(raw[d]) for d, s, c in zip(got.doc_id, got["size"], got.text_crc32, strict=True))
    loads = got.groupby("shard")["size"].sum()
    assert loads.max() - loads.min() <= got["size"].max()


def test_shards_by_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    size, rows, slot_of = collections.Counter(), collections.Counter(), {}
    for d, t in docs:
        seed = xxhash.xxh64_intdigest(d.to_bytes(8, "little", signed=True), 42)
        slot_of[d] = xxhash.xxh64_intdigest((t or "").encode(), seed) % 4096  # 2**64 is a multiple of 4096, so signs don't matter
        size[slot_of[d]] += len((t or "").encode()) + 1
        rows[slot_of[d]] += 1
    mean, shard, loads, loose = sum(size.values()) / 16, {}, [0] * 16, []
    for home in range(16):
        run = 0
        for slot in sorted(range(home, 4096, 16), key=lambda s: (-size[s], s)):
            run += size[slot]
            if run <= mean:
                shard[slot] = home
                loads[home] += size[slot]
            else:
                loose.append(slot)
    for slot in sorted(loose, key=lambda s: (-size[s], s)):
        shard[slot] = loads.index(min(loads))
        loads[shard[slot]] += size[slot]
    first = {s: sum(rows[x] for x in range(s) if shard[x] == shard[s]) for s in set(slot_of.values())}
    ranks = {d: k for s in first for k, d in enumerate(sorted(d for d in slot_of if slot_of[d] == s))}
    got = {r["doc_id"]: (r["virtual_slot"], r["shard"], r["slot"], r["map_version"]) for r in sharding.op2_sharding(spark, SF).collect()}
    assert got == {d: (s, shard[s], first[s] + ranks[d], 2) for d, s in slot_of.items()}


def test_versions_have_one_writer(spark, tmp_path):
    stats = spark.range(64).select(F.col("id").cast("int").alias("virtual_slot"), F.col("id").alias("bytes"), F.lit(1).cast("long").alias("rows"))
    first = sharding.store_map(sharding.even_map(stats, 4), f"file://{tmp_path}/map", 1)
    with pytest.raises(Exception, match="exist"):
        sharding.store_map(sharding.even_map(stats, 4), f"file://{tmp_path}/map", 1)
    sharding.store_map(sharding.rebalance(first, stats, 5), f"file://{tmp_path}/map", 2)
    newest = sharding.load_map(spark, f"file://{tmp_path}/map")
    assert {(r["version"], r["n_shards"]) for r in newest.collect()} == {(2, 5)} and newest.count() == 64
    assert sharding.load_map(spark, f"file://{tmp_path}/map", 1).where("version = 1 AND n_shards = 4").count() == 64


def test_rebalance_moves_few_slots(spark):
    stats = spark.range(64).select(F.col("id").cast("int").alias("virtual_slot"), (F.col("id") % 5 + 10).alias("bytes"), F.lit(1).cast("long").alias("rows"))
    first = sharding.assign_slots(stats, 4).cache()
    grown = sharding.rebalance(first, stats, 5).cache()
    moved = first.alias("a").join(grown.alias("b"), "virtual_slot").where("a.shard <> b.shard").count()
    loads = [r["s"] for r in grown.groupBy("shard").agg(F.sum("bytes").alias("s")).collect()]
    assert grown.count() == 64 and len(loads) == 5 and max(loads) < 1.25 * min(loads) and moved <= 20
    assert sharding.rebalance(first, stats, 4).alias("a").join(first.alias("b"), "virtual_slot").where("a.shard <> b.shard").count() <= 2
    assert {r["version"] for r in grown.collect()} == {2}


# op3
def test_decontamination_tolerates_substitutions(spark):
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    items = [[word() for _ in range(n)] for n in (24, 30, 14, 4)]
    noise = lambda n: [word() for _ in range(n)]
    swapped = [w if i % 6 else "zzz" for i, w in enumerate(items[0])]
    docs = {1: noise(50) + items[0] + noise(50), 2: noise(50) + swapped + noise(9), 3: noise(200), 4: noise(5) + items[1][:6] + noise(40), 5: items[2], 6: noise(20) + items[3] + noise(20), 7: items[0][3:17], 8: items[3][:3]}
    frame = spark.createDataFrame([(k, " ".join(v).upper() + "!") for k, v in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, ", ".join(v)) for i, v in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.overlaps(frame, bench).collect()}
    assert set(got) == {(1, 0), (2, 0), (5, 2), (6, 3), (7, 0)}
    assert got[1, 0]["equal"] == 24 and got[1, 0]["doc_at"] == 50 and got[2, 0]["equal"] >= 16
    assert sorted(r["doc_id"] for r in decontaminate.decontaminate(frame, bench).collect()) == [3, 4, 8]


def test_decontamination_finds_all_planted_passages(spark, duck):
    want = duck.execute("SELECT doc_id, item_id FROM documents d, benchmark b WHERE contains(d.text, b.text)").fetchall()
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.op3_benchmark_decontamination(spark, SF).collect()}
    assert set(want) <= got and len(got) <= len(want) + 2


def brute_overlaps(docs, items, masks, min_equal, min_share):
    """The rule on every pair of a document and an item, word by word, without hashes."""
    import re

    words = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    folded = collections.defaultdict(list)
    for i, t in items:
        if words(t):
            folded[tuple(words(t))].append(i)
    out = {}
    for d, t in docs:
        doc = words(t)
        for item, ids in folded.items():
            spans = masks if len(item) >= min(map(len, masks)) else ["1" * len(item)]
            diagonals = {
                at - p
                for mask in spans
                for p in range(len(item) - len(mask) + 1)
                for at in range(len(doc) - len(mask) + 1)
                if all(doc[at + k] == item[p + k] for k, c in enumerate(mask) if c == "1")
            }
            for g in diagonals:
                same = [(i, doc[g + i] == item[i]) for i in range(max(0, -g), min(len(item), len(doc) - g))]
                score, _, start, length, equal = max(
                    (sum(1 if e else -2 for _, e in same[a:b]), -b, same[a][0], b - a, sum(e for _, e in same[a:b])) for a in range(len(same)) for b in range(a + 1, len(same) + 1)
                )
                if equal >= min(len(item), min_equal) and equal >= min_share * length:
                    key = (equal, -length, -start, -g)
                    out[d, min(ids)] = max(out.get((d, min(ids)), key), key)
    return {k: (-g - s, -s, -n, e) for k, (e, n, s, g) in out.items()}


@pytest.mark.parametrize("most", [decontaminate.MAX_BROADCAST_ROWS, 0])
def test_decontamination_by_brute_force(spark, most):
    rng = np.random.default_rng(8)
    word = lambda: "w%d" % rng.integers(60)
    text = lambda n: [word() for _ in range(n)]
    start = text(14)
    items = [start + text(12), start + text(9), text(25), text(5), text(1), text(13), [], text(40)]
    docs = []
    for i in range(24):
        item = items[int(rng.integers(len(items)))]
        part = [w if rng.random() > 0.08 else word() for w in item[int(rng.integers(0, 4)) :]]
        docs.append((i % 22, " ".join(text(int(rng.integers(0, 12))) + part * int(rng.integers(1, 3)) + text(int(rng.integers(0, 9))))))
    docs += [(90, None), (91, ""), (92, docs[0][1])]
    bench = [(i, " ".join(t)) for i, t in enumerate(items)] + [(50, " ".join(items[2])), (51, None)]
    got = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), max_broadcast=most)
    want = brute_overlaps(docs, bench, decontaminate.MASKS, decontaminate.MIN_EQUAL, decontaminate.MIN_SHARE)
    assert {(r["doc_id"], r["item_id"]): (r["doc_at"], r["item_at"], r["length"], r["equal"]) for r in got.collect()} == want and len(want) > 15


# op4
def test_quality_on_held_out_labels(spark):
    sf = SF.replace("sf0.001", "sf0.1")
    got = quality.op4_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert ((got.predicted == 1) == (got.quality == 1)).mean() > 0.97
    order = got.score.rank()
    good = got.quality == 1
    auc = (order[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.98 and got.score.between(0, 1).all()


def test_word_ngrams_by_brute_force():
    import re

    def index(*hashes):
        h = hashes[0]
        for x in hashes[1:]:
            h = (h * 0xC2B2AE3D27D4EB4F + x) % 2**64
        return h * 0x9E3779B97F4A7C15 % 2**64 >> 64 - quality.BITS

    for text in ("", None, "one", "a a", "a, b, b! b! The THE 12 " * 3, "x" * 50_000 + " x x y x", "\u0663\u0301 z_z"):
        words = re.findall(r"\w+|[^\w\s]+", text or "")
        plain = [xxhash.xxh64_intdigest(w.encode(), 1) for w in words]
        h = [int(quality.AGAIN[0]) if i and words[i - 1] == w else int(quality.AGAIN[1]) if i > 1 and words[i - 2] == w else plain[i] for i, w in enumerate(words)]
        got = quality.Features(cache_entries=3).of(text)
        assert [k.tolist() for k in got] == [[index(x) for x in h], [index(*h[i : i + 2]) for i in range(len(h) - 1)]]


def test_no_stage_trains_on_all_documents_in_one_task(spark):
    docs = spark.range(4000).repartition(8).select(F.col("id").alias("doc_id"), F.lit("good words here").alias("text"))
    labels = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    assert np.array_equal(quality.train(docs, labels, max_train=50, bits=8), quality.train(docs.coalesce(1), labels, max_train=50, bits=8))


def test_quality_without_labels(spark):
    docs = odd(spark)
    weights = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality.score(docs, weights).collect()} == {0.5}


# op5
def test_ids_and_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).select("doc_id", "text").collect()
    strange = [(10_001, None), (10_002, ""), (10_003, "a  b\n c \n\n d'll  e   g "), (10_004, " x   y\n \nz"), (10_005, " \n"), (10_006, "x" * 9_000), (10_007, "a <|endoftext|> b<|endoftext|><|endoftext|>  c <|endoftext"), (10_008, "<|endoftext|>")]
    data = [(r["doc_id"], r["text"]) for r in docs] + strange
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = packing.pack(frame, packing.default_vocabulary(), with_ids=True).toPandas()
    for doc_id, text in data:
        part = got[got.doc_id == doc_id].sort_values("start")
        ids = np.frombuffer(b"".join(part.ids), "<u4").tolist()
        assert ids == tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        assert (part.doc_tokens == len(ids)).all() and part.start.tolist() == [0, *np.cumsum(part.length)[:-1]]
    assert all(zlib.crc32(i) == c for i, c in zip(got.ids, got.ids_crc32, strict=True))
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq.offset.tolist() == [0, *np.cumsum(seq.length)[:-1]] and seq.length.sum() == seq.context.iloc[0]
        assert seq.context.iloc[0] <= 1024 and seq.context.iloc[0] & (seq.context.iloc[0] - 1) == 0
    per_group = got.groupby("step_group").agg(tokens=("length", "sum"), contexts=("context", "nunique"))
    assert per_group.tokens.max() <= packing.STEP_TOKENS and (per_group.contexts == 1).all()
    with pytest.raises(ValueError):
        packing.Packer(1000, 64)


def test_special_tokens_as_text():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    tokenizer.encode_special_tokens = True
    for text in ("a <|endoftext|> b", "<|endoftext|>"):
        assert np.frombuffer(packing.ByteBpe(packing.default_vocabulary(), special=False).ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("pool", [0, 3, 1024])
def test_packer_fills_gaps_with_whole_documents(pool):
    rng = np.random.default_rng(5)
    packer, sizes = packing.Packer(pool=pool), [int(n) for n in rng.integers(1, 700, 6000)] + [5000]
    for doc, n in enumerate(sizes):
        packer.add(doc, np.full(n, doc, "<u4").tobytes())
        assert packer.n_waiting <= max(1, pool) and packer.n_waiting == sum(map(len, packer.waiting))
    packer.finish()
    pieces = collections.defaultdict(list)
    for tier, window in packer.closed:
        assert tier <= 1024 and tier & (tier - 1) == 0 and sum(len(ids) for _, _, ids in window) == 4 * tier
        for doc, start, ids in window:
            assert set(np.frombuffer(ids, "<u4")) == {doc}
            pieces[doc].append((start, len(ids) // 4))
    cut = 0
    for doc, n in enumerate(sizes):
        at = 0
        for start, length in sorted(pieces[doc]):
            assert start == at
            at += length
        assert at == n
        cut += n <= 1024 and len(pieces[doc]) > 1
    if pool == 1024:
        assert cut < 0.03 * len(sizes)


# op6
def test_lines_by_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    where, leaves = collections.defaultdict(list), collections.defaultdict(set)
    for d, t in docs:
        for i, line in enumerate(t.split("\n")):
            words = line_dedup._words_of(line)
            if len(words) >= line_dedup.MIN_WORDS:
                where[line].append((d, i))
                leaves[len(words), tuple(words[: line_dedup.LEVELS])].add(line)
    drop = set()
    for lines in leaves.values():
        ordered = sorted(lines, key=lambda x: xxhash.xxh64_intdigest(x.encode(), 42) - (1 << 64 if xxhash.xxh64_intdigest(x.encode(), 42) >> 63 else 0))
        groups = collections.defaultdict(list)
        for number, line in zip(line_dedup.parse_leaf([line_dedup._words_of(x) for x in ordered]), ordered, strict=True):
            groups[number] += where[line]
        for places in groups.values():
            if len({d for d, _ in places}) > 1:
                drop |= set(places) - {min(places)}
    want = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in drop) for d, t in docs}
    got = {r["doc_id"]: r["text"] for r in line_dedup.op6_line_dedup(spark, SF).collect()}
    assert got == want and drop


def test_templates_fold_variable_fields(spark):
    line = "user {} logged in from host alpha at noon"
    data = [(1, line.format("u1") + "\nonly one here please now"), (2, line.format("u2") + "\nsomething else that is unique"), (3, "user root logged in from host alpha at night"), (4, "a b")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    for most in (2_000, 1):
        got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, max_leaf=most).collect()}
        assert got[1] == data[0][1] and got[2] == "something else that is unique" and got[4] == "a b", most
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, keep_first=False).collect()}[1] == "only one here please now"


def test_hot_leaves_are_split(spark):
    data = [(i, f"the same three words then w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]} differs every time really") for i in range(60)] + [(100 + i, data_line) for i, data_line in enumerate(["the same three go on and on and on"] * 3)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = line_dedup.dedup_lines(docs, max_leaf=8)
    assert got.where("doc_id >= 100 AND n_dropped = 0").count() == 1 and got.count() == 63


# op7
def test_images_round_trip():
    rng = np.random.default_rng(0)
    grey, colour = rng.integers(0, 256, (13, 7), np.uint8), rng.integers(0, 256, (5, 6, 3), np.uint8)
    assert (media.decode(media.encode_pgm(grey)) == grey).all() and (media.decode(media.encode_bmp(grey)) == grey).all()
    assert (media.decode(b"P6 # note\n6 5\n255\n" + colour.tobytes()) == colour).all()
    assert (media.decode(b"P2\n2 2\n9\n1 2\n3 4") == [[1, 2], [3, 4]]).all()
    assert (media.decode(b"P1\n3 1\n1 0 1") == [[0, 1, 0]]).all() and (media.decode(b"P4\n3 1\n\xa0") == [[0, 1, 0]]).all()
    assert (media.decode(b"P5\n1 2\n65535\n\x01\x00\x00\x02") == [[256], [2]]).all()
    for bad in (b"", b"P9", b"P5\n", b"P5\n0 1\n255\n", b"BM123", b"P5\n4 4\n255\nxx"):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_area_resize_by_brute_force():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (10, 14)).astype(float)
    fine = np.kron(image, np.ones((3, 4)))  # 30 x 56
    assert np.allclose(media.area_resize(image, 3, 8), fine.reshape(3, 10, 8, 7).mean(axis=(1, 3)))
    assert np.allclose(media.area_resize(image, 10, 14), image)
    assert np.isclose(media.area_resize(image, 7, 5).mean(), image.mean())


def test_difference_hash_by_brute_force():
    rng = np.random.default_rng(6)
    for rows, cols in ((8, 9), (16, 18), (24, 27), (40, 45)):
        image = rng.integers(0, 256, (rows, cols), np.uint8)
        bits = 0
        for y in range(8):
            cell = lambda x, y=y: int(image[rows // 8 * y : rows // 8 * (y + 1), cols // 9 * x : cols // 9 * (x + 1)].sum())
            for x in range(8):
                bits = bits << 1 | (cell(x + 1) > cell(x))
        assert media.difference_hash(image) == f"{bits:016x}"


@pytest.mark.parametrize("n", [0, 1, 64, 65, media.BMP_FROM - 64, media.BMP_FROM - 63, media.BMP_FROM, 100_001])
def test_payloads_round_trip(n):
    raw = bytes(np.random.default_rng(n).integers(0, 128, n, np.uint8))
    image, length = media.payload_image(raw.decode())
    assert length == n and media.decode(image).tobytes() == raw + bytes(max(64, -(-n // 64) * 64) - n)
    assert image[:2] == (b"BM" if n + 63 >= media.BMP_FROM else b"P5")


def test_media_columns(spark):
    texts = [(1, "hello " * 30), (2, None), (3, "hello " * 30)]
    images = media.text_images(spark.createDataFrame(texts, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in media.image_digests(images).collect()}
    raw = b"hello " * 30
    padded = raw + bytes(-len(raw) % 64)
    assert got[1]["n_bytes"] == 180 and got[1]["payload_bytes"] == 192 and got[1]["payload_sha256"] == hashlib.sha256(padded).hexdigest()
    assert got[1]["tail_crc32"] == zlib.crc32(padded[-64:]) and got[2]["payload_bytes"] == 64 and got[1]["feature"] == got[3]["feature"]
    tiles = media.media_columns(images.unionByName(spark.createDataFrame([(9, "", b"broken", 0)], images.schema)), "image", 8)
    by = {r["doc_id"]: r for r in tiles.collect()}
    assert np.load(io.BytesIO(by[1]["tile_npy"])).shape == (8, 8) and by[1]["height"] == 3 and by[9]["tile_npy"] is None
    broken = media.image_digests(spark.createDataFrame([(1, b"broken"), (2, None), (3, b"BM123"), (4, b"P5\n4 4\n255\nxx")], "doc_id long, image binary")).collect()
    assert len(broken) == 4 and all(v is None for r in broken for n, v in r.asDict().items() if n not in ("doc_id", "image"))
    tile = media.tile_of(media.decode(media.payload_image("hello " * 30)[0]))
    assert got[1]["tile_sha256"] == hashlib.sha256(media.npy(tile)).hexdigest() and tile.shape == (32, 32)


# op8
def brute_components(data):
    shingler = ngram_join.Shingler()
    sets = [set(shingler.set_of(t).tolist()) for _, t in data]
    root = list(range(len(data)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    names = collections.defaultdict(list)
    for i, (d, _) in enumerate(data):
        names[find(i)].append(d)
    return sorted((d, len(sets[i]), min(names[find(i)])) for i, (d, _) in enumerate(data))


def planted(seed=0):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    out = []
    for n in (3, 4, 5, 6, 8, 12, 20, 40, 90, 200, 700):
        base = [word() for _ in range(n)]
        for edits in (0, 0, 1, 1, 2, max(1, n // 60), max(1, n // 45), max(1, n // 25)):
            text = list(base)
            for at in rng.choice(n, min(edits, n), replace=False):
                text[at] = word()
            out.append(" ".join(text))
            out.append(" ".join(text + [word() for _ in range(n // 6)]))
    passage = [word() for _ in range(50)]
    out += [" ".join([word() for _ in range(30)] + passage + [word() for _ in range(30)]) for _ in range(40)]
    return [(int(d), t) for d, t in zip(rng.permutation(len(out)) + 1, out, strict=True)]


@pytest.mark.parametrize("limits", [{}, {"cap": 4}, {"cap": 4, "block_cap": 6, "unit_cap": 8}, {"exact": True}])
def test_near_duplicates_by_brute_force(spark, limits):
    data = planted()
    got = ngram_join.jaccard_components(spark.createDataFrame(data, "doc_id long, text string").repartition(4), **limits)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute_components(data)


def test_words_and_short_sets():
    shingler = ngram_join.Shingler()
    assert len(shingler.set_of("a b c d e f")) == 2 and len(shingler.set_of("a b")) == 1 and len(shingler.set_of(" \x0b ")) == 0
    assert (shingler.set_of("A É b") == shingler.set_of("a É\x0cb")).all() and (shingler.set_of("a É") != shingler.set_of("a é")).all()
    assert len(shingler.set_of("a b c d e f")) == 1


def test_blocks_of_near_copies_are_folded(spark):
    """One text with a word changed in each copy, copies of copies, and strangers that share half of it."""
    rng = np.random.default_rng(10)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    base = [word() for _ in range(120)]
    data = []
    for i in range(240):
        text = list(base)
        for at in rng.choice(120, int(rng.integers(1, 6)), replace=False):
            text[at] = word()
        data.append(text if i % 12 else base[:60] + [word() for _ in range(60)])
    data = [(i, " ".join(t)) for i, t in enumerate(data)]
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    want = brute_components(data)
    for limits in ({"block_cap": 16}, {"block_cap": 40, "cap": 8, "unit_cap": 16}):
        got = ngram_join.jaccard_components(frame, **limits)
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == want
    points = [ngram_join.point_bytes(ngram_join.Shingler().set_of(t)) for _, t in data]
    alone = ngram_join.survivors_forest(ngram_join.points_of(points), [0] * len(data))
    assert alone == [] and ngram_join.survivors_forest(ngram_join.points_of(points), None, [False] * len(data)) == []


@pytest.mark.parametrize("n", [4, 5, 9, 15, 40, 100, 333, 1000, 4000, 20_000])
def test_pairs_at_the_threshold_meet(n):
    """Sets with a similarity of 0.80 to 0.82 share a block key, and their points pass the bound; random sets don't."""
    rng = np.random.default_rng(n)
    draw = lambda k: rng.integers(0, 1 << 63, k).astype(np.uint64)
    lost = tried = 0
    for trial in range(60 if n > 2000 else 300):
        base = np.unique(draw(n))
        most = int(len(base) * 0.2)  # shingles that only the first has; the second lacks them, or has others instead
        if trial % 2:
            other = np.unique(base[rng.permutation(len(base))[: len(base) - most]])
        else:
            away = len(base) // 9
            other = np.unique(np.concatenate([base[rng.permutation(len(base))[: len(base) - away]], draw(away)]))
        if not ngram_join.linked(base, other) or len(base) == len(other) == len(np.intersect1d(base, other)):
            continue
        tried += 1
        lost += not set(ngram_join.block_keys(base).tolist()) & set(ngram_join.block_keys(other).tolist())
        assert set(ngram_join.exact_keys(base).tolist()) & set(ngram_join.exact_keys(other).tolist())
        points = ngram_join.points_of([ngram_join.point_bytes(base), ngram_join.point_bytes(other)])
        assert ngram_join.survivors_forest(points)
    assert lost == 0 and (tried or n < 9)
    if n >= 333:
        points = ngram_join.points_of([ngram_join.point_bytes(np.unique(draw(n))) for _ in range(20)])
        assert not ngram_join.survivors_forest(points)


def test_tree_never_loses_a_pair():
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64))
    sets = [np.unique(np.concatenate([rng.choice(base, 280, replace=False), rng.integers(0, 1 << 63, int(k)).astype(np.uint64)])) for k in rng.integers(0, 60, 120)]
    points = ngram_join.points_of([ngram_join.point_bytes(s) for s in sets])
    tree = ngram_join.CountTree(points)
    for i, s in enumerate(sets):
        reach = set(tree.reach(points[i]).tolist())
        assert {j for j, t in enumerate(sets) if ngram_join.linked(s, t)} <= reach


def test_one_of_each(spark):
    docs = odd(spark)
    kept = ngram_join.one_of_each(docs)
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:4]) for r in kept.collect()) == [(0, ""), (0, "no i"), (1, ""), (2, ""), (3, " \n\t"), (4, "one"), (5, "same"), (7, "éééé"), (8, "long")]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(200, 201)], "a long, b long")
    got = dict(components.components(spark, edges).collect())
    assert {got[i] for i in range(71)} == {0} and got[201] == 200


# op9
def test_perspectives(spark):
    data = [(1, 0, "system", "rules"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", "yo"), (1, 3, "cat", None)]
    got = {r["participant"]: r for r in chat.rotate_perspectives(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {"ann", "bob", "cat"}
    text = got["bob"]["rendered"]
    assert text.startswith("<|im_start|>system\nrules<|im_end|>\n<|im_start|>user name=ann\nhi < |im_end|><|im_end|>\n<|im_start|>assistant\nyo")
    for r in got.values():
        spans = [tuple(map(int, s.split(":"))) for s in r["mask_spans"].split(",")]
        assert [r["rendered"][a : a + n] for a, n in spans] == [{"ann": "hi < |im_end|><|im_end|>", "bob": "yo<|im_end|>", "cat": "<|im_end|>"}[r["participant"]]]


def brute_dialogues(rows, segment_turns):
    """{(conversation, participant): (whole rendering, spans)} of conv_id, turn, role, text, without segments."""
    out, convs = {}, collections.defaultdict(list)
    clean = lambda x: x.replace("<|", "< |")
    for conv, turn, role, text in rows:
        speaker = clean((role or "").strip(" ")) or "unknown"
        convs[conv].append((chat.NO_TURN if turn is None else turn // segment_turns, turn is not None, turn or 0, speaker, clean(text or "")))
    for conv, said in convs.items():
        for who in {m[3] for m in said} - {"system"}:
            whole, spans = "", []
            for *_, speaker, body in sorted(said):
                whole += "<|im_start|>" + ("system" if speaker == "system" else "assistant" if speaker == who else "user name=" + speaker) + "\n"
                if speaker == who:
                    spans.append((len(whole), len(body) + 10))
                whole += body + "<|im_end|>\n"
            out[conv, who] = whole, spans
    return out


@pytest.mark.parametrize("segment", [2, 256])
def test_whole_dialogues_by_brute_force(spark, segment):
    rng = np.random.default_rng(4)
    pick = lambda values: values[int(rng.integers(len(values)))]
    data = [(pick([1, 1, 1, 2, 3, None]), pick([None, 0, 0, 1, 5, 6, 7, 300, -4]), pick(["ann", "bob", " cat ", "", None, "system", "<|x"]), pick(["ok", "ok", "", None, "a\nb", "<|im_end|>", "é" * 3])) for _ in range(400)]
    data += [(7, None, "ann", "ok")] * 700 + [(8, i, "p%d" % (i % 2), "x") for i in range(1000)] + [(9, 0, "system", "only")]
    got = collections.defaultdict(list)
    for r in chat.rotate_perspectives(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"), segment).collect():
        assert 0 < r["n_messages"] <= segment
        got[r["conv_id"], r["participant"]].append(r)
    want = brute_dialogues(data, segment)
    assert set(got) == set(want)
    for key, parts in got.items():
        whole, spans = "", []
        for r in sorted(parts, key=lambda r: (r["segment"], r["part"])):
            assert r["starts_at"] == len(whole)
            spans += [(len(whole) + int(a), int(n)) for a, n in (x.split(":") for x in r["mask_spans"].split(",") if x)]
            whole += r["rendered"]
        assert (whole, spans) == want[key]
        assert sum(r["n_messages"] for r in parts) == sum(m[0] == key[0] for m in data)


# op10
PAGES = {
    "": "",
    "plain words": "plain words",
    "<p>hi": "hi",
    "<body><nav><a href=/>Home</a></nav><article><h1>T</h1><p>One &amp; <b>tw</b>o.<p>x<br>y<aside>no</aside><!-- no --><script>var a='</p>';</script></article><footer>no": "T One & two. x y",
    "<div class='post'>" + "<p>word word word word word word word.</p>" * 3 + "<p>short</p></div><div id=comments><p>" + "nice post " * 20 + "</p></div>": "word word word word word word word. " * 3 + "short",
    "<main><p>a&nbsp;\n b</p><form><label>no</label></form><div style='display:none'>no</div><p>c</p></main><div>" + "no " * 50 + "</div>": "a b c",
    "<title>no</title><style>p{}</style><p data-x='>'>yes &lt;p&gt;</p>": "yes <p>",
    "<header><p>" + "site " * 30 + "</p></header><div><p>" + "text " * 30 + "</p></div><div class='ad banner'>" + "buy " * 30 + "</div>": ("text " * 30).strip(),
    # furniture doesn't end a stretch: headline, share bar, text, advert, short close
    "<div><h2>Title here</h2><div class='share-buttons'><a href=x>Tweet</a></div><p>" + "word " * 40 + "</p><div class=ad>Buy</div><p>Bye.</p></div>": "Title here " + "word " * 40 + "Bye.",
    # menus without marks go, a single link stays
    "<ul><li><a href=a>Home</a><li><a href=b>About us</a><li><a href=c>Contact</a></ul><p>" + "word " * 40 + "<p><a href=d>All of it is here</a><p>End.": "word " * 40 + "All of it is here End.",
    "<p>" + "word " * 40 + "</p><div><a href=a>Home</a> | <a href=b>About</a></div><div><a href=a>Imprint</a></div><div><a href=a>Privacy</a></div>": "word " * 40,
    # names that only contain a furniture word
    "<article><div id='social-history'><p>one</p></div><div class='search-theory x'>two</div><h2 id=comments>three</h2><p class='ad-hoc'>four</p><div class='comment-list'>no</div><div id=sidebar2>no</div></article>": "one two three four",
    # an unclosed link ends with its block
    "<div><p><a href=x>open<p>" + "word " * 30 + "</div>": "open " + "word " * 30,
    # a stretch that never surges
    "<div>" + "".join(f"<p><a href={i}>link {i}</a></p>" for i in range(9)) + "<p>(c)</p>" + "".join(f"<p><a href={i}>more {i}</a></p>" for i in range(9)) + "<p>" + "word " * 60 + "</p></div>": "word " * 60,
}


@pytest.mark.parametrize("page", PAGES)
def test_main_text(page):
    assert html_text.main_text(page) == PAGES[page].strip()


@pytest.mark.parametrize("declared", [True, False])
def test_pages_keep_the_whole_article(spark, declared):
    """Against the text of the article's own element, with that element named and without."""
    import html
    import re

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.sub(r"</?b>", "", re.search(r"<article>(.*)</article>", r["html"], re.S)[1])
        page = r["html"] if declared else r["html"].replace("<article>", "<div>").replace("</article>", "</div>")
        assert html_text.main_text(page) == " ".join(html.unescape(re.sub(r"<[^>]+>", " ", body)).split())
    got = html_text.op10_html_extraction(spark, SF).collect()
    assert all(r["n_chars"] == len(r["text"]) for r in got) and {r["text"] for r in got} == {html_text.main_text(r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}


def test_windows_by_brute_force():
    """Every line is kept that lies in a stretch with a surge; a stretch ends where a window has no weight."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        weights = [int(w) for w in rng.choice([0, 0, 0, 5, 30, 90], int(rng.integers(0, 30)))]
        page = "".join(f"<p>{'x' * w}</p>" if w else "<p><a href=1>q</a> <a href=2>q</a></p>" for w in weights)
        empty = [sum(weights[i : i + 3]) == 0 for i in range(len(weights))]
        least = min(60, max((sum(weights[i : i + 3]) for i in range(len(weights))), default=0) / 2)
        want = []
        for i, w in enumerate(weights):
            low = max((k for k in range(i + 1) if empty[k]), default=-1) + 1
            high = next((k for k in range(i, len(weights)) if empty[k]), len(weights))
            first = next((k for k in range(low, high) if weights[k]), high)
            if not empty[i] and i >= first and any(sum(weights[k : k + 3]) >= least for k in range(low, high)):
                want.append("x" * w if w else "q q")
        assert html_text.main_text(page) == " ".join(want)


def test_duck_views():
    assert set(TABLES) >= {"documents", "pages"} and duckdb.__version__
