"""Labels of models, paths and cache entries."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def cache_key(backend: str, model: str, text: Column) -> Column:
    """The key under which a text's vector is kept."""
    return F.sha1(F.concat_ws("|", F.lit(backend), F.lit(model), F.coalesce(text, F.lit(""))).cast("binary"))


def source_label(model: Column, known: dict[str, str] | None = None) -> Column:
    """A known name, else `family major.minor` of an id such as `family-4-2-20240101`, else the id itself."""
    parts = [F.regexp_extract(model, r"^([A-Za-z]+)-(\d+)[-.](\d{1,2})(?!\d)", i) for i in (1, 2, 3)]
    label = F.when(parts[0] != "", F.concat(parts[0], F.lit(" "), parts[1], F.lit("."), parts[2])).otherwise(model)
    if not known:
        return label
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.try_element_at(names, model), label)


def glob_pattern(glob: str) -> str:
    """A file glob as an anchored regular expression: `*` and `?` match any character, `[...]` a set."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if end > 0:
            body = glob[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += ".*" if c == "*" else "." if c == "?" else re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def matches_glob(path: Column, globs: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [path.rlike(glob_pattern(g)) for g in globs], F.lit(False))


def room_of_path(path: Column, rules: dict[str, str]) -> Column:
    """The room of the longest prefix; null without one."""
    ordered = sorted(rules.items(), key=lambda r: (-len(r[0]), r[0]))
    return F.coalesce(*[F.when(path.startswith(prefix), F.lit(room)) for prefix, room in ordered], F.lit(None).cast("string"))
