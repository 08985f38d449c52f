"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader updates.

Words are runs of letters and digits, as they are written (case is kept), and runs of other signs; a word that repeats the
one before it, or the one before that, is the word AGAIN[0] or AGAIN[1] instead, so that n-grams of repetition are the same for
all words.  A text's features are its hashed word 1- and 2-grams (ORDERS), in one space of 2**BITS weights.  A feature's value is its share among the text's
n-grams of its order, so a score doesn't depend on length; an empty text has the bias alone.

Training is FTRL-proximal (per-coordinate rates, L1 and L2) over a bounded sample: the MAX_TRAIN labelled
rows with the smallest hash of their id.  The bound is a parameter; all tasks scan and make features, only the sample's features
move to the one task that makes the updates, in hash order, so that the model doesn't depend on how the table is
stored.  The model (at most 2**BITS weights) is the only thing collected.  Scoring is a
sparse dot product per whole text, in Arrow batches without a shuffle.

Labels, language, source and id are never inputs of a score.
Defined cases: null text is an empty one; a null id is never held out nor trained on; labels that
contradict each other for one id are all used; without labels every score is 0.5.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import field, pieces, read, with_columns

BITS = 20
MAX_TRAIN = 12_000
EPOCHS = 3
THRESHOLD = 0.3
CACHE_ENTRIES = 100_000
#: Weight of the share of each order of n-grams; its length is the greatest order.
ORDERS = (16.0, 8.0)
_WORD = re.compile(r"\w+|[^\w\s]+")
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Hashes of the words that stand for a repetition one and two words back.
AGAIN = tuple(np.uint64(xxhash.xxh64_intdigest(bytes([i]), 2)) for i in (1, 2))


class Features:
    """Feature indexes of texts; words' hashes are cached, and the cache is emptied when it is full."""

    def __init__(self, bits: int = BITS, cache_entries: int = CACHE_ENTRIES):
        self.shift = np.uint64(64 - bits)
        self.cache_entries = cache_entries
        self.hashes: dict[str, int] = {}

    def of(self, text: str | None) -> list[np.ndarray]:
        """An array of indexes for each order of n-grams."""
        words = _WORD.findall(text or "")
        known = self.hashes
        if len(known) + len(words) > self.cache_entries:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 1)
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        marked = hashes.copy()
        for back in (2, 1):
            marked[back:][hashes[back:] == hashes[: max(0, len(words) - back)]] = AGAIN[back - 1]
        spread, step = (np.uint64(m) for m in _MIX)
        grams, out = marked, []
        for order in range(1, len(ORDERS) + 1):
            if order > 1:
                grams = grams[:-1] * step + marked[order - 1 :] if len(grams) else grams
            out.append(((grams * spread) >> self.shift).astype(np.int64))
        return out

    def sparse(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(indexes, values) with each index once."""
        kinds = self.of(text)
        index = np.concatenate(kinds)
        value = np.concatenate([np.full(len(k), s / max(1, len(k))) for k, s in zip(kinds, ORDERS, strict=True)])
        index, place = np.unique(index, return_inverse=True)
        return index, np.bincount(place, value, len(index)) if len(index) else np.zeros(0)


class Ftrl:
    """FTRL-proximal logistic regression; index 2**bits is the bias."""

    def __init__(self, bits: int = BITS, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.full(len(z), self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, index: np.ndarray, value: np.ndarray, label: int) -> float:
        index, value = np.append(index, len(self.z) - 1), np.append(value, 1.0)
        w = self.weights(index)
        p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
        g = (p - label) * value
        sigma = (np.sqrt(self.n[index] + g * g) - np.sqrt(self.n[index])) / self.alpha
        self.z[index] += g - sigma * w
        self.n[index] += g * g
        return p


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, max_train: int = MAX_TRAIN, epochs: int = EPOCHS, bits: int = BITS) -> np.ndarray:
    """Weights (float32, the bias last) from docs (doc_id, text) and labels (doc_id, quality)."""
    order = F.xxhash64(F.lit("quality"), F.col("doc_id"), F.col("quality"))
    wanted = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "quality", order.alias("h")).orderBy("h").limit(max_train)
    sample = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").select("h", "quality", "text")  # max_train narrow rows bound the broadcast

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(bits)
        for batch in pieces(batches):
            made = [features.sparse(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1).cast(pa.int32()), pa.array([i.astype("<i4").tobytes() for i, _ in made], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in made], pa.binary())],
                names=["h", "quality", "index", "value"],
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(h, q, np.frombuffer(i, "<i4"), np.frombuffer(v, "<f4")) for b in pieces(batches) for h, q, i, v in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        rows.sort(key=lambda r: (r[0], r[1], r[2].tobytes()))
        model = Ftrl(bits)
        for _ in range(epochs):
            for _, label, index, value in rows:
                model.update(index, value.astype(np.float64), int(label > 0))
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype("<f4").tobytes()], pa.binary())], names=["model"])

    kind = T.StructType([field("h", "long"), field("quality", "int"), field("index", "binary"), field("value", "binary")])
    # Only the sample moves, at most max_train rows.
    made = sample.mapInArrow(featurise, kind).repartition(1).mapInArrow(learn, T.StructType([field("model", "binary")]))
    return np.frombuffer(made.first()["model"], "<f4")


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) of each whole text; a column of that name is replaced."""
    bits = (len(weights) - 1).bit_length() - (0 if (len(weights) - 1) & (len(weights) - 2) else 1)
    packed = weights.astype("<f4").tobytes()
    held: list = []

    def run(batch: pa.RecordBatch) -> dict:
        if not held:
            held.extend([Features(bits), np.frombuffer(packed, "<f4").astype(np.float64)])
        features, w = held
        out = np.empty(batch.num_rows)
        for i, text in enumerate(batch.column(batch.schema.get_field_index(text_col))):
            kinds = features.of(text.as_py())
            out[i] = w[-1] + sum(s * w[k].mean() for k, s in zip(kinds, ORDERS, strict=True) if len(k))
        return {"score": 1 / (1 + np.exp(-np.clip(out, -35, 35)))}

    return with_columns(docs, [field("score", "double")], run)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    weights = train(docs, read(spark, sf_dir, "labels"))
    scored = score(docs, weights).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.round("score", 9).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


QUERIES = {"op4_quality_classifier": op4_quality_classifier}
ORACLES: dict[str, str] = {}
