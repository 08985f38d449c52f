"""Read-only tools over an engine's tables: typed requests, checked bounds, JSON answers; and a line protocol."""

from __future__ import annotations

import inspect
import json
import sys
from collections.abc import Callable
from typing import Any, TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.config import DEFAULT, Settings
from tidewell.operators import browse
from tidewell.operators import search as text_search

LIMITS = {"search": 20, "card": 5, "session_context": 30, "wander": 20, "recent": 100}
MAX_QUERY = 500


class RequestError(ValueError):
    """A request out of bounds; the caller gets its text and not a trace."""


class Tools:
    """viewer is fixed for an instance: a client can't ask for another room's private text."""

    def __init__(self, cards: DataFrame, turns: DataFrame, card_tags: DataFrame, access: DataFrame, viewer: str | None, settings: Settings = DEFAULT, index: text_search.SearchIndex | None = None):
        self.cards, self.turns, self.tags, self.access, self.viewer, self.settings = cards, turns, card_tags, access, viewer, settings
        self.index = index  # a stored index; without one a search reads the cards
        self.calls: dict[str, Callable[..., list[dict]]] = {n: getattr(self, n) for n in LIMITS}

    def _rows(self, frame: DataFrame) -> list[dict]:
        return [json.loads(r) for r in frame.toJSON().collect()]  # LIMITS bounds every answer

    @staticmethod
    def _limit(tool: str, limit: Any) -> int:
        if not isinstance(limit, int) or isinstance(limit, bool) or not 1 <= limit <= LIMITS[tool]:
            raise RequestError(f"limit is 1 to {LIMITS[tool]}")
        return limit

    def _expanded(self, rows: list[dict], expand: Any) -> list[dict]:
        """rows, the first `expand` of them with their card's detail, in one look-up."""
        if not isinstance(expand, int) or isinstance(expand, bool) or not 0 <= expand <= self.settings.expand_most:
            raise RequestError(f"expand is 0 to {self.settings.expand_most}")
        wanted = [r["card_id"] for r in rows[:expand]]
        details = {d["card_id"]: d for d in self.card(wanted)} if wanted else {}
        return [r | {"card": details[r["card_id"]]} if r["card_id"] in details else r for r in rows]

    def search(self, query: str, limit: int = 10, expand: int = 0) -> list[dict]:
        if not isinstance(query, str) or not query.strip() or len(query) > MAX_QUERY:
            raise RequestError(f"query is a text of 1 to {MAX_QUERY} characters")
        try:
            groups = text_search.terms(query)
        except ValueError as problem:
            raise RequestError(str(problem)) from None
        limit = self._limit("search", limit)
        if not groups:
            return []
        index = self.index.read(groups) if self.index else None
        found = text_search.search(self.cards, index, self.tags, query, self.viewer, limit, explain=True)
        return self._expanded(self._rows(found.join(self.cards.select("card_id", "headline"), "card_id").orderBy("priority", F.desc("score"), "card_id")), expand)

    def card(self, ids: list[str], turns: bool = False) -> list[dict]:
        if not isinstance(ids, list) or not 1 <= len(ids) <= self.settings.expand_most or not all(isinstance(i, str) for i in ids):
            raise RequestError(f"ids is a list of 1 to {self.settings.expand_most} texts")
        chosen = self.cards.where(F.col("card_id").isin(ids))
        most = self.settings.clip_field_chars
        detail = browse.card_detail(chosen, self.tags, self.viewer).select("card_id", "headline", "room", F.substring("share", 1, most).alias("share"), F.substring("private", 1, most).alias("private"), "tags")
        out = self._rows(detail)
        if turns:
            spans = browse.card_turns(chosen, self.turns, self.viewer).select("card_id", "round", "message_seq", "role", "text")
            cut = browse.clip(spans, "text", ["card_id"], ["round", "message_seq"], most, self.settings.clip_total_chars)
            by: dict[str, list] = {}
            for row in self._rows(cut.orderBy("card_id", "round", "message_seq")):
                by.setdefault(row.pop("card_id"), []).append(row)
            for item in out:
                item["turns"] = by.get(item["card_id"], [])
        return out

    def session_context(self, card_id: str, limit: int = 5, mode: str = "around") -> list[dict]:
        if mode not in ("around", "before"):
            raise RequestError("mode is around or before")
        limit = self._limit("session_context", limit)
        session = self.cards.where(F.col("card_id") == card_id).select("session_id")
        placed = browse.ordered_siblings(self.cards.join(session, "session_id", "left_semi"), self.viewer)
        found = (browse.around if mode == "around" else browse.before)(placed, limit).where(F.col("anchor") == card_id)
        return self._rows(found.join(self.cards.select("card_id", "headline"), "card_id").orderBy("idx"))

    def wander(self, limit: int = 5, expand: int = 0, seed: int | None = None) -> list[dict]:
        now = self.settings.now.strftime("%Y-%m-%d %H:%M:%S")
        drawn = browse.wander_rank(self.cards, self.access, self.viewer, now, seed=seed).orderBy("n_access", "dice").limit(self._limit("wander", limit))
        return self._expanded(self._rows(drawn.join(self.cards.select("card_id", "headline"), "card_id").orderBy("n_access", "dice")), expand)

    def recent(self, limit: int = 20, since: str | None = None, until_date: str | None = None, expand: int = 0) -> list[dict]:
        between = {k: v for k, v in (("since", since), ("until_date", until_date)) if v}
        return self._expanded(self._rows(browse.recent(self.cards, self.viewer, self._limit("recent", limit), **between).select("card_id", "room", "headline", "card_ts")), expand)

    def answer(self, request: dict) -> dict:
        """One request {id, method, params} to one answer with result or error."""
        out: dict[str, Any] = {"jsonrpc": "2.0", "id": request.get("id")}
        method, params = request.get("method"), request.get("params") or {}
        if method == "tools/list":
            return out | {"result": {"tools": [{"name": n, "most": m} for n, m in LIMITS.items()]}}
        if method not in self.calls:
            return out | {"error": {"code": -32601, "message": f"no tool {method}"}}
        if not isinstance(params, dict):
            return out | {"error": {"code": -32602, "message": "params is an object"}}
        if unknown := sorted(set(params) - set(inspect.signature(self.calls[method]).parameters)):
            return out | {"error": {"code": -32602, "message": f"unknown arguments: {', '.join(unknown)}"}}
        try:
            return out | {"result": self.calls[method](**params)}
        except (RequestError, TypeError) as problem:
            return out | {"error": {"code": -32602, "message": str(problem)}}

    def serve(self, source: TextIO = sys.stdin, sink: TextIO = sys.stdout) -> None:
        """One JSON object a line in, one a line out."""
        for line in source:
            if not line.strip():
                continue
            try:
                request = json.loads(line)
                reply = self.answer(request) if isinstance(request, dict) else {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "a request is an object"}}
            except json.JSONDecodeError:
                reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}}
            print(json.dumps(reply, ensure_ascii=False), file=sink, flush=True)
