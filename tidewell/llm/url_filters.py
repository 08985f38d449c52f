"""URL filters: a sorted digest array of rules, memory-mapped and probed by vectorised binary search.

A rule is `host/path-prefix` with a verdict.  It fits its host and every subdomain when the
url's path starts with the rule's path; the longest rule wins (of equal length the longer
host; of equal strings `block`).  The index holds the 64-bit xxhash of each rule's (host, path) in sorted order
beside the full strings, and a second sorted array the digests of the rules' hosts with the path lengths known for each.  A url's host is
walked at its dots; all suffixes of a batch are probed in one binary search, and for those that are some rule's host the path
prefixes of its lengths in a second one.  So a url costs its labels and the lengths of the hosts that it has, however many rules there are;
each digest that is found is confirmed against the stored string, so that two rules with one
digest cannot be confused.

An index of up to MAX_SHIPPED_BYTES travels with the task, is written once by each Python
worker to its own temp folder, unlinked and memory-mapped.  A larger one is never sent
whole: candidates and rules meet in a shuffled join on the digest (`match_by_join`).

Defined cases: a null url, and one without `://`, has an empty host and path and no rule;
a rule without a host is refused; an empty rule list leaves every url at the default verdict.
"""

from __future__ import annotations

import os
import re
import tempfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import field, read, with_columns

#: An index above this many bytes is joined by shuffle in place of being shipped to each worker.
MAX_SHIPPED_BYTES = 32 << 20
#: The lists given with the task: (rule, verdict).
DEFAULT_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
DEFAULT_VERDICT = "allow"
AUTHORITY = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path); both are empty without `://`."""
    found = AUTHORITY.search(url) if url else None
    return (found[1].translate(LOWER), found[2]) if found else ("", "")


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, rest = rule.partition("/")
    if not host:
        raise ValueError(f"a rule needs a host: {rule!r}")
    return host.translate(LOWER), slash + rest


def digest(host: str, path: str) -> int:
    return xxhash.xxh64_intdigest(f"{host}\0{path}".encode("utf-8", "surrogatepass"))


@dataclass
class DigestIndex:
    """Sorted keys, and for each the place of its strings in `blob`; sorted host keys, and for each its path lengths."""

    keys: np.ndarray  # uint64, sorted
    ends: np.ndarray  # int64, where each entry's text ends in blob
    hosts: np.ndarray  # uint64, sorted: digests of the rules' hosts
    stops: np.ndarray  # int64, where each host's lengths end in `lengths`
    lengths: np.ndarray  # int64: path lengths of a host's rules
    blob: np.ndarray  # uint8: host NUL path NUL rule NUL verdict

    @classmethod
    def build(cls, rules: list[tuple[str, str]]) -> DigestIndex:
        best: dict[tuple[str, str], tuple[str, str]] = {}
        for rule, verdict in sorted(rules, key=lambda r: (r[1] != "block", r[0])):
            best.setdefault(split_rule(rule), (rule, verdict))
        entries = sorted((digest(h, p), h, p, rule, verdict) for (h, p), (rule, verdict) in best.items())
        known: dict[int, set[int]] = {}
        for _, host, path, _, _ in entries:
            known.setdefault(digest(host, ""), set()).add(len(path))
        hosts = sorted(known)
        texts = ["\0".join(e[1:]).encode() for e in entries]
        return cls(
            np.array([e[0] for e in entries], np.uint64), np.cumsum([len(t) for t in texts], dtype=np.int64), np.array(hosts, np.uint64),
            np.cumsum([len(known[h]) for h in hosts], dtype=np.int64), np.array([n for h in hosts for n in sorted(known[h])], np.int64), np.frombuffer(b"".join(texts), np.uint8),
        )

    def parts(self) -> list[np.ndarray]:
        return [self.keys, self.ends, self.hosts, self.stops, self.lengths, self.blob]

    def to_bytes(self) -> bytes:
        return b"".join(part.tobytes() for part in self.parts())

    def sizes(self) -> list[int]:
        return [len(part) for part in self.parts()]

    def nbytes(self) -> int:
        return sum(part.nbytes for part in self.parts())

    @classmethod
    def mapped(cls, raw: bytes, sizes: list[int]) -> DigestIndex:
        """The index in a file of this worker's temp folder, memory-mapped; the file's name is gone at once."""
        kinds = [np.uint64, np.int64, np.uint64, np.int64, np.int64, np.uint8]
        if not raw:
            return cls(*[np.zeros(0, kind) for kind in kinds])
        handle, path = tempfile.mkstemp(prefix="urlidx")
        try:
            with os.fdopen(handle, "wb") as out:
                out.write(raw)
            whole = np.memmap(path, np.uint8, "r")
        finally:
            os.unlink(path)
        out, at = [], 0
        for n, kind in zip(sizes, kinds, strict=True):
            size = n * np.dtype(kind).itemsize
            out.append(whole[at : at + size].view(kind))
            at += size
        return cls(*out)

    def entry(self, at: int) -> list[str]:
        start = int(self.ends[at - 1]) if at else 0
        return bytes(self.blob[start : int(self.ends[at])]).decode().split("\0")

    def probe(self, hosts: list[str], paths: list[str]) -> list[tuple[str, str] | None]:
        """(rule, verdict) of the longest rule that fits each url."""
        out: list[tuple[str, str] | None] = [None] * len(hosts)
        if not len(self.keys):
            return out
        walked: dict[str, list[str]] = {}  # host: its suffixes, longest first
        for host in hosts:
            if host and host not in walked:
                labels = host.split(".")
                walked[host] = [".".join(labels[i:]) for i in range(len(labels))]
        suffixes = list({s for found in walked.values() for s in found})
        at, found = _search(self.hosts, [digest(s, "") for s in suffixes])
        known = {s: self.lengths[int(self.stops[i - 1]) if i else 0 : int(self.stops[i])].tolist() for s, i, ok in zip(suffixes, at.tolist(), found.tolist(), strict=True) if ok}
        asked = [(i, s, path[:n]) for i, (host, path) in enumerate(zip(hosts, paths, strict=True)) for s in walked.get(host, ()) for n in known.get(s, ()) if n <= len(path)]
        asked.sort(key=lambda a: (a[0], -(len(a[1]) + len(a[2])), -len(a[1])))
        at, found = _search(self.keys, [digest(h, p) for _, h, p in asked])
        for j in np.flatnonzero(found).tolist():
            i, *wanted = asked[j]
            if out[i] is not None:
                continue
            place = int(at[j])
            key = self.keys[place]
            while place < len(self.keys) and self.keys[place] == key:
                host, path, rule, verdict = self.entry(place)
                if [host, path] == wanted:
                    out[i] = (rule, verdict)
                    break
                place += 1
        return out


def _search(keys: np.ndarray, wanted: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The place of each wanted number in sorted keys, and whether it is there."""
    asked = np.array(wanted, np.uint64)
    at = np.searchsorted(keys, asked, "left")
    return at, (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == asked)


def url_filter(df: DataFrame, rules: list[tuple[str, str]], *, url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """df with host, path, rule and verdict of each url (columns of those names in df are replaced)."""
    index = DigestIndex.build(rules)
    if index.nbytes() > MAX_SHIPPED_BYTES:
        table = df.sparkSession.createDataFrame([(r, v) for r, v in rules], "rule string, verdict string")
        return match_by_join(df, table, url_col=url_col, default=default)
    raw, sizes = index.to_bytes(), index.sizes()
    held: list[DigestIndex] = []

    def judge(batch: pa.RecordBatch) -> dict:
        if not held:
            held.append(DigestIndex.mapped(raw, sizes))
        parts = [split_url(u) for u in batch.column(batch.schema.get_field_index(url_col)).to_pylist()]
        hosts, paths = [p[0] for p in parts], [p[1] for p in parts]
        found = held[0].probe(hosts, paths)
        return {"host": hosts, "path": paths, "rule": [x and x[0] for x in found], "verdict": [x[1] if x else default for x in found]}

    return with_columns(df, [field(n, "string") for n in ("host", "path", "rule", "verdict")], judge)


def match_by_join(df: DataFrame, rules: DataFrame, *, url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """The same for a list that is too large to ship: urls and rules (rule, verdict) meet by shuffle.

    Each distinct url is cut into its candidate (host suffix, path prefix) pairs, limited to the
    lengths that occur in the list; the join is on the 64-bit digest and compares the strings.
    """
    host, path = _host_path(F.col("_url"))
    urls = df.select(F.col(url_col).alias("_url")).where(F.col("_url").isNotNull()).distinct().select("_url", host.alias("_h"), path.alias("_p"))
    rule_host = F.translate(F.regexp_extract("rule", "^([^/]+)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    listed = rules.select("rule", "verdict", rule_host.alias("_rh"), F.expr("substring(rule, length(regexp_extract(rule, '^([^/]+)', 1)) + 1)").alias("_rp"))
    listed = listed.groupBy("_rh", "_rp").agg(F.min(F.struct((F.col("verdict") != "block").alias("o"), "rule", "verdict")).alias("_r"))
    lengths = listed.agg(F.collect_set(F.length("_rp")).alias("_lens"))  # path lengths: bounded by the longest url
    cand = (
        urls.crossJoin(F.broadcast(lengths))
        .select("_url", "_p", "_lens", F.explode(F.expr("transform(sequence(1, size(split(_h, '[.]'))), i -> array_join(slice(split(_h, '[.]'), i, 100000), '.'))")).alias("_ch"))
        .select("_url", "_ch", F.explode(F.expr("transform(filter(_lens, l -> l <= length(_p)), l -> substring(_p, 1, l))")).alias("_cp"))
    )
    key = lambda h, p: F.xxhash64(F.col(h), F.col(p))
    hits = cand.withColumn("_k", key("_ch", "_cp")).join(listed.withColumn("_k", key("_rh", "_rp")), "_k").where("_ch = _rh AND _cp = _rp")
    best = hits.groupBy("_url").agg(F.max(F.struct((F.length("_rh") + F.length("_rp")).alias("n"), F.length("_rh").alias("h"), F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("verdict"))).alias("_best"))
    kept = df.drop("host", "path", "rule", "verdict")
    h, p = _host_path(F.col(url_col))
    return kept.join(best, kept[url_col] == best["_url"], "left").select(*[kept[c] for c in kept.columns], h.alias("host"), p.alias("path"), F.col("_best.rule").alias("rule"), F.coalesce(F.col("_best.verdict"), F.lit(default)).alias("verdict"))


def _host_path(url: Column) -> tuple[Column, Column]:
    host = F.translate(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter(pages, DEFAULT_RULES).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH u AS (
  SELECT page_id, regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1) AS h0, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
p AS (SELECT page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
r(rule, rh, rp, verdict) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
m AS (
  SELECT p.page_id, r.rule, r.verdict, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC, length(rh) DESC) AS k
  FROM p JOIN r ON (p.host = r.rh OR ends_with(p.host, '.' || r.rh)) AND starts_with(p.path, r.rp))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.k = 1
"""

QUERIES = {"op1_url_filters": op1_url_filters}
ORACLES = {"op1_url_filters": ORACLE}
