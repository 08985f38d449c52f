"""Hierarchical multi-length packing of tokenised documents.

Context sizes (tiers) are the powers of two from MIN_TIER to MAX_TIER.  A document's tokens (its ids
and an end id) are cut into whole windows of the largest tier; the rest waits in a pool of POOL rests.  When the pool is
full, its longest rest is routed to the smallest tier that holds it, and the gap of that window is filled from shorter
waiting rests: one that fits exactly, or two that do, or the longest that fits, and so on (among the TRIES longest rests, the first
whose gap is filled exactly goes first).  Only a gap that no waiting rest fits is filled by cutting one, so nearly every document that fits a window stays whole, and every closed
window is full.  At the end of a partition the pool is packed the same way; what is left when it runs out is cut into full windows of the tiers downwards,
and below the smallest tier into windows of smaller powers of two, so that no token is padding.
Windows of a tier are dealt to step groups of STEP_TOKENS tokens each: a group holds one context size and
as many tokens as any other full group.

Packing is local to an input partition and needs no shuffle: memory is one Arrow batch, one
document's ids and the pool, whose rests are shorter than a window.  sequence_id and step_group hold the partition's number in the
bits above 36.  The input must give the same partitions when a task is run again; a
scan of stored files does (write other inputs first, as the pipeline's stages are).

Defined cases: a null or empty text is the end id alone; equal rows are packed each; any length of text works; the string of an added
token of the vocabulary in a text becomes that token's id, as the tokenizers library has it by default (`special=False`
makes it ordinary text).
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidewell.llm.common import field, pieces, read

MAX_TIER, MIN_TIER = 1024, 64
STEP_TOKENS = 8 * MAX_TIER
#: Rests that wait in a partition for a gap that they fit.
POOL = 1024
TRIES = 48
END_ID = 0
#: Entries of the cache from a chunk to its ids; a worker's cache is emptied when it is full.
CACHE_ENTRIES = 200_000
#: The pre-tokenisation pattern of the vocabulary file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BOUNDARY = re.compile(r" (?=\S)")


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are packed as native 32-bit numbers, which must be little-endian here")


class ByteBpe:
    """Ids of a byte-level BPE vocabulary file (JSON) whose ids follow the order of its merges."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES, special: bool = True):
        with open(path, encoding="utf-8") as file:
            vocab = json.load(file)
        added = {t["content"]: t for t in vocab.get("added_tokens", [])}
        if any(t.get(flag) for t in added.values() for flag in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that take white space or whole words aren't read")
        table = byte_of_char()
        ranks = {bytes(table[c] for c in token): i for token, i in vocab["model"]["vocab"].items() if token not in added}
        self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = {c: array("I", [t["id"]]).tobytes() for c, t in added.items()} if special else {}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=lambda c: (-len(c), c)))) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}
        self.cache_entries = cache_entries

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if self.split and any(c in text for c in self.special):
            return b"".join(self.special.get(part) or self._plain(part) for part in self.split.split(text) if part)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        """The ids of ordinary text.

        A text is cut at each space; the pattern begins a piece there unless white space
        follows, so a text where that is so is cut only at spaces that a non-space follows.
        The chunks' ids are then the text's ids.
        """
        chunks = text.split(" ")
        cache = self.cache
        if len(cache) + len(chunks) > self.cache_entries:
            cache.clear()
        first, rest = chunks[0], chunks[1:]
        missing = set(rest).difference(cache)
        if any(not c or c[0].isspace() for c in missing):  # never cached, so always seen here
            first, *rest = _BOUNDARY.split(text)
            missing = set(rest).difference(cache)
        encode = self.encoding._core_bpe.encode_ordinary
        for chunk in missing:
            cache[chunk] = array("I", encode(" " + chunk)).tobytes()
        return array("I", encode(first)).tobytes() + b"".join(map(cache.__getitem__, rest))


class Packer:
    """Windows of one partition.  Pieces are (document, start, ids); `closed` gets (tier, pieces) of each window."""

    def __init__(self, max_tier: int = MAX_TIER, min_tier: int = MIN_TIER, pool: int = POOL):
        if max_tier & (max_tier - 1) or min_tier & (min_tier - 1) or not 0 < min_tier <= max_tier:
            raise ValueError("tiers are powers of two")
        self.max_tier, self.min_tier, self.pool = max_tier, min_tier, pool
        self.waiting: list[list] = [[] for _ in range(max_tier)]  # by length: the rests of that length
        self.lengths: list[int] = []  # those that wait, ascending
        self.n_waiting = 0
        self.closed: list[tuple[int, list]] = []

    def tier_of(self, n: int) -> int:
        return max(self.min_tier, 1 << (n - 1).bit_length())

    def add(self, doc, ids: bytes) -> None:
        step, size = 4 * self.max_tier, len(ids)
        whole = size // step * step
        for at in range(0, whole, step):
            self.closed.append((self.max_tier, [(doc, at // 4, ids[at : at + step])]))
        if whole < size:
            self._wait((doc, whole // 4, ids[whole:]))
            while self.n_waiting > self.pool:
                self._pack()

    def _wait(self, rest: tuple) -> None:
        n = len(rest[2]) // 4
        if not self.waiting[n]:
            insort(self.lengths, n)
        self.waiting[n].append(rest)
        self.n_waiting += 1

    def _take(self, n: int) -> tuple:
        rest = self.waiting[n].pop()
        if not self.waiting[n]:
            del self.lengths[bisect_left(self.lengths, n)]
        self.n_waiting -= 1
        return rest

    def _exact(self, gap: int) -> list[int]:
        """Lengths of one waiting rest that is a gap, or of two that make it up; the more equal two first, so that short ones last."""
        if not gap or self.waiting[gap]:
            return [gap] * (gap > 0)
        for i in range(bisect_left(self.lengths, -(-gap // 2)), bisect_left(self.lengths, gap)):
            n = self.lengths[i]
            if self.waiting[gap - n] and (2 * n > gap or len(self.waiting[n]) > 1):
                return [n, gap - n]
        return []

    def _start(self) -> int:
        """The length of the rest that opens the next window."""
        for n in self.lengths[: -TRIES - 1 : -1]:
            gap = self.tier_of(n) - n
            fits = self._exact(gap)
            if not gap or fits and not (n in fits and len(self.waiting[n]) <= fits.count(n)):
                return n
        return self.lengths[-1]

    def _pack(self) -> None:
        """Closes a window; one that can't be filled any more ends the pool."""
        window = [self._take(self._start())]
        tier = self.tier_of(len(window[0][2]) // 4)
        gap = tier - len(window[0][2]) // 4
        while gap and self.n_waiting:
            at = bisect_left(self.lengths, gap)
            fits = self._exact(gap) or self.lengths[max(0, at - 1) : at]
            if not fits:  # every waiting rest is longer than the gap: the shortest is cut
                doc, start, ids = self._take(self.lengths[0])
                window.append((doc, start, ids[: 4 * gap]))
                self._wait((doc, start + gap, ids[4 * gap :]))
                gap = 0
            for n in fits:
                window.append(self._take(n))
                gap -= n
        if gap:
            self._cut(window)
        else:
            self.closed.append((tier, window))

    def finish(self) -> None:
        while self.n_waiting:
            self._pack()

    def _cut(self, pieces: list[tuple]) -> None:
        """Cuts the last pieces into full windows, largest tier first."""
        left = sum(len(p[2]) for p in pieces) // 4
        tier = self.max_tier
        while left:
            while tier > left:
                tier >>= 1
            window, need = [], tier
            while need:
                doc, start, ids = pieces.pop(0)
                take = min(need, len(ids) // 4)
                window.append((doc, start, ids[: 4 * take]))
                if 4 * take < len(ids):
                    pieces.insert(0, (doc, start + take, ids[4 * take :]))
                need -= take
            self.closed.append((tier, window))
            left -= tier


PIECES = T.StructType(
    [field(n, "long") for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [field("context", "int"), field("step_group", "long")]
)


def pack(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", max_tier: int = MAX_TIER, min_tier: int = MIN_TIER, step_tokens: int = STEP_TOKENS, pool: int = POOL, special: bool = True, with_ids: bool = False) -> DataFrame:
    """A row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, context, step_group (and ids, as array<int>)."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), *PIECES.fields, *([field("ids", "binary")] if with_ids else [])])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        bpe = _tokenizer(vocabulary, special)
        packer = Packer(max_tier, min_tier, pool)
        sequence, dealt = 0, {}
        group_of: dict[int, int] = {}
        groups = 0

        def rows_out() -> pa.RecordBatch | None:
            nonlocal sequence, groups
            cols: list[list] = [[] for _ in names]
            for tier, window in packer.closed:
                n = dealt.get(tier, 0)
                if n % max(1, step_tokens // tier) == 0:
                    group_of[tier] = groups
                    groups += 1
                dealt[tier] = n + 1
                offset = 0
                for (doc_id, doc_tokens), start, ids in window:
                    length = len(ids) // 4
                    row = [doc_id, start, length, zlib.crc32(ids), doc_tokens, high + sequence, offset, tier, high + group_of[tier]]
                    for col, value in zip(cols, row + [ids] * with_ids, strict=True):
                        col.append(value)
                    offset += length
                sequence += 1
            packer.closed.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names) if cols[0] else None

        kinds: list = []
        end = np.asarray([END_ID], "<u4").tobytes()
        for batch in pieces(batches):
            kinds = kinds or [batch.schema.field("doc_id").type, *[pa.int64()] * 6, pa.int32(), pa.int64(), *([pa.binary()] if with_ids else [])]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = bpe.ids(text.as_py() or "") + end
                packer.add((doc_id, len(ids) // 4), ids)
            if out := rows_out():
                yield out
        packer.finish()
        if out := rows_out():
            yield out

    return rows.mapInArrow(run, schema)


_HELD: dict[tuple[str, bool], ByteBpe] = {}


def _tokenizer(path: str, special: bool) -> ByteBpe:
    """One for each Python worker and vocabulary."""
    if (path, special) not in _HELD:
        _HELD[path, special] = ByteBpe(path, special=special)
    return _HELD[path, special]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), default_vocabulary())


QUERIES = {"op5_packing": op5_packing}
ORACLES: dict[str, str] = {}
