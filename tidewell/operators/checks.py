"""Driver-side checks of what a model hands back, and texts that are rendered for people.  All inputs are small and bounded."""

from __future__ import annotations

import json
import re
from typing import Any

OPS = ("add", "update", "retire")
#: A digest may be so much longer than its limit before it is refused.
SLACK = 1.1


def extract_json(text: str) -> Any:
    """The JSON value in a model's text: a fenced block, or from the first bracket to its last partner."""
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    body = fenced[1] if fenced else text
    starts = [i for i in (body.find("{"), body.find("[")) if i >= 0]
    if not starts:
        raise ValueError("no JSON")
    start = min(starts)
    end = body.rfind("}" if body[start] == "{" else "]")
    return json.loads(body[start : end + 1])


def judge_batch(asked: list[tuple[str, list[str]]], verdicts: list[dict]) -> dict[str, str | None]:
    """tag -> entity or None; an omission, a repeat, an unknown tag or a foreign candidate fails the whole batch."""
    allowed = dict(asked)
    out: dict[str, str | None] = {}
    for verdict in verdicts:
        tag, entity = verdict.get("tag"), verdict.get("entity")
        if tag not in allowed:
            raise ValueError(f"unknown tag {tag!r}")
        if tag in out:
            raise ValueError(f"tag {tag!r} twice")
        if entity is not None and entity not in allowed[tag]:
            raise ValueError(f"{entity!r} is no candidate of {tag!r}")
        out[tag] = entity
    if missing := [t for t in allowed if t not in out]:
        raise ValueError(f"no verdict for {missing[0]!r}")
    return out


def exact_names(asked: list[tuple[str, list[str]]]) -> list[dict]:
    """The conservative default of a judge: only equal names, but for case and spaces, are merged."""
    fold = lambda x: re.sub(r"\s+", "", x).casefold()
    return [{"tag": tag, "entity": next((c for c in candidates if fold(c) == fold(tag)), None)} for tag, candidates in asked]


def estimate_tokens(text: str) -> int:
    wide = len(re.findall(r"[぀-ヿ㐀-䶿一-鿿가-힯]", text))
    return wide + -(-(len(text) - wide) // 4)


def submission(data: Any, known_ids: set[str] | None, max_tokens: int) -> list[str]:
    """Problems of a digest submission {digest, constants: [{op, constant_id, content, shared}], constants_md}; empty if it is fine.

    known_ids None leaves ids unchecked; an update gives content, shared or both.
    """
    if not isinstance(data, dict):
        return ["a submission is an object"]
    out = [f"unknown key {k}" for k in sorted(set(data) - {"digest", "constants", "constants_md"})]
    digest, most = data.get("digest"), int(max_tokens * SLACK)
    if not isinstance(digest, str) or not digest.strip():
        out.append("digest is a text")
    elif (n := estimate_tokens(digest.strip())) > most:
        out.append(f"digest has {n} tokens of {max_tokens}, {most} with slack")
    rendered = data.get("constants_md")
    if rendered is not None and (not isinstance(rendered, str) or not rendered.strip()):
        out.append("constants_md is a text, or isn't given")
    ops = data.get("constants", [])
    if not isinstance(ops, list):
        return [*out, "constants is a list"]
    for i, op in enumerate(ops):
        if not isinstance(op, dict) or op.get("op") not in OPS:
            out.append(f"constants[{i}]: op is one of {', '.join(OPS)}")
            continue
        if op["op"] == "add":
            if not isinstance(op.get("content"), str) or not op["content"].strip():
                out.append(f"constants[{i}]: content is empty")
            continue
        if not op.get("constant_id"):
            out.append(f"constants[{i}]: no id")
        elif known_ids is not None and op["constant_id"] not in known_ids:
            out.append(f"constants[{i}]: unknown id {op['constant_id']}")
        if op["op"] == "update" and "content" not in op and "shared" not in op:
            out.append(f"constants[{i}]: neither content nor shared")
    return out


def summary(data: Any, most: int = 700) -> list[str]:
    """Problems of a summary {summary: text}."""
    unknown = [f"unknown key {k}" for k in sorted(set(data) - {"summary"})] if isinstance(data, dict) else []
    text = data.get("summary") if isinstance(data, dict) else None
    if not isinstance(text, str) or not text.strip():
        return [*unknown, "summary is a text"]
    return unknown if len(text) <= most else [*unknown, f"summary has {len(text)} characters of {most}"]


def policy(value: Any) -> bool:
    """A projection policy is true or false, and false where it isn't given."""
    if value is None:
        return False
    if not isinstance(value, bool):
        raise ValueError("a policy is true or false")
    return value


def ledger(rows: list[dict]) -> str:
    """The day's cards as text, by local day; rows: day, room, headline, in order."""
    out, day = [], None
    for row in rows:
        if row["day"] != day:
            day = row["day"]
            out.append(f"## {day}")
        out.append(f"- [{row['room']}] {row['headline']}")
    return "\n".join(out) if out else "Nothing in the last 24 hours."


def duplicate_report(groups: list[dict]) -> str:
    """Groups of duplicates (component, card_id, k) to be reviewed: a line a card, the newest marked KEEP."""
    out, last = [], None
    for row in sorted(groups, key=lambda r: (r["component"], r["k"])):
        if row["component"] != last:
            last = row["component"]
            out.append(f"\n# group {last}")
        out.append(f"{'KEEP' if row['k'] == 1 else 'DROP'} {row['card_id']}")
    return "\n".join(out).strip()


def review(text: str) -> tuple[set[str], set[str]]:
    """(keep, drop) of a reviewed report; a group without a KEEP is skipped, a card with two marks is an error."""
    keep: set[str] = set()
    drop: set[str] = set()
    for part in re.split(r"(?m)^# group .*$", text):
        marks = re.findall(r"(?m)^(KEEP|DROP) (\S+)$", part)
        kept, dropped = {c for m, c in marks if m == "KEEP"}, {c for m, c in marks if m == "DROP"}
        if both := kept & dropped:
            raise ValueError(f"{sorted(both)[0]} is kept and dropped")
        if kept:
            keep |= kept
            drop |= dropped
    return keep, drop
