"""Connectors to models and embeddings: retries, artifacts, a cache of vectors, and the record of every attempt."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.labels import cache_key

#: Seconds before each attempt.
DELAYS = (0, 30, 60, 120)
ATTEMPTS = "run_id string, attempt int, at timestamp_ntz, status string, prompt string, raw string, parsed string"
_ESCAPES = r"\x1b\[[0-?]*[ -/]*[@-~]|\x1b\][^\x07\x1b]*(?:\x07|\x1b\\\\)|\x1b[@-Z\\\\-_]|[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


class Model(Protocol):
    """Text in, text out; it raises where it fails.  A command, a service or a local function can be one."""

    def __call__(self, prompt: str) -> str: ...


def clean(text: str) -> str:
    """Without terminal escapes and control characters."""
    import re

    return re.sub(_ESCAPES, "", text).strip()


@dataclass
class Retrying:
    """A model that is asked again after DELAYS.  artifact: what the model may have handed in by another way; once it is there the
    attempt counts as a success, however the call ended, so that a finished task is never paid twice."""

    model: Model
    artifact: Callable[[], str | None] = lambda: None
    delays: tuple[float, ...] = DELAYS
    sleep: Callable[[float], None] = time.sleep
    attempts: list[dict[str, Any]] = field(default_factory=list)

    def __call__(self, prompt: str) -> str:
        self.attempts, problem = [], None
        for number, delay in enumerate(self.delays, 1):
            if delay:
                self.sleep(delay)
            try:
                answer, status = clean(self.model(prompt)), "ok"
            except Exception as error:  # whatever a connector raises is an attempt that failed
                answer, status, problem = "", f"{type(error).__name__}: {error}", error
            self.attempts.append({"attempt": number, "status": status, "raw": answer})
            if (handed := self.artifact()) is not None:
                return handed
            if status == "ok" and answer:
                return answer
        raise problem or RuntimeError("the model gave no text")


def record(spark: SparkSession, path: str, run_id: str, prompt: str, attempts: list[dict[str, Any]], at: datetime, parsed: Any = None) -> None:
    """Appends the attempts of a run: prompt, raw text, and for the last one what was parsed.  Nothing is ever rewritten."""
    rows = [(run_id, a["attempt"], at, a["status"], prompt, a["raw"], json.dumps(parsed, sort_keys=True, ensure_ascii=False) if parsed is not None and a is attempts[-1] else None) for a in attempts]
    spark.createDataFrame(rows, ATTEMPTS).coalesce(1).write.mode("append").parquet(path)


def with_cached(texts: DataFrame, cache: DataFrame, backend: str, model: str, text_col: str = "text") -> DataFrame:
    """texts with cache_key and vector, null where the cache (cache_key, vector) has none; each distinct text is looked up once."""
    keyed = texts.withColumn("cache_key", cache_key(backend, model, F.col(text_col)))
    known = keyed.select("cache_key").distinct().join(cache.dropDuplicates(["cache_key"]), "cache_key")
    return keyed.join(known, "cache_key", "left")


def missing(cached: DataFrame, text_col: str = "text") -> DataFrame:
    """(cache_key, text) to embed, each distinct text once."""
    return cached.where("vector IS NULL").select("cache_key", F.col(text_col).alias("text")).dropDuplicates(["cache_key"])


def embed(rows: DataFrame, embedder: Callable[[], Callable[[list[str]], list[list[float]]]]) -> DataFrame:
    """(cache_key, vector) of rows (cache_key, text), in Arrow batches; embedder makes the connector once in each worker."""
    import pyarrow as pa

    def run(batches):
        ask = embedder()
        for batch in batches:
            vectors = ask(batch.column(1).to_pylist())
            if len(vectors) != batch.num_rows:
                raise ValueError("an embedder gives a vector for each text")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float32()))], names=["cache_key", "vector"])

    return rows.select("cache_key", "text").mapInArrow(run, "cache_key string, vector array<float>")
