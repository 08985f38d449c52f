"""Column builders: ids, text, time, vectors and visibility.  All stay inside the JVM."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_id(prefix: str, *parts: Column) -> Column:
    """prefix:<32 hex> of the parts joined by a bar; without a prefix the bare digest."""
    digest = F.substring(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), 1, 32)
    return F.concat(F.lit(f"{prefix}:"), digest) if prefix else digest


def blank(text: Column) -> Column:
    """Null, empty or all white space."""
    return ~F.coalesce(text, F.lit("")).rlike(r"\S")


def visible(viewer: str | None, room: str = "room", share: str = "share") -> Column:
    """Own room in full; another room only where share isn't blank; without a viewer everything."""
    return F.lit(True) if viewer is None else (F.col(room) == viewer) | ~blank(F.col(share))


def masked_private(viewer: str | None, room: str = "room", private: str = "private") -> Column:
    return F.col(private) if viewer is None else F.when(F.col(room) == viewer, F.col(private)).otherwise(F.lit(""))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def card_text(*fields: Column) -> Column:
    """The fields that aren't blank, trimmed, one a line."""
    return F.trim(F.concat_ws("\n", *[F.when(~blank(f), F.trim(f)) for f in fields]))


def estimate_tokens(text: Column) -> Column:
    """Ideographs and kana count one each, other characters a quarter."""
    wide = F.length(text) - F.length(F.regexp_replace(text, r"[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}]", ""))
    return wide + F.ceil((F.length(text) - wide) / 4)


def join_wide(text: Column) -> Column:
    """White space between two characters outside ASCII goes."""
    return F.regexp_replace(text, r"(?<=[^\x00-\x7f])\s+(?=[^\x00-\x7f])", "")


def round_label(number: Column, role: Column) -> Column:
    """Two digits and L (user) or C (assistant)."""
    return F.format_string("%02d%s", number, F.when(role == "user", "L").otherwise("C"))


def local_time(ts: Column, timezone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, timezone), "yyyy-MM-dd HH:mm")


def canonical_time(text: Column) -> Column:
    """ISO text with an offset as UTC text with microseconds and Z; null if it isn't one."""
    stamp = F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(text))
    return F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """a over its length, which counts 1e-12 at least."""
    return F.transform(a, lambda x: x.cast("double") / F.greatest(norm(a), F.lit(1e-12)))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


#: Markers of injected text that isn't the user's own.
REMINDER = r"(?s)<system-reminder>.*?</system-reminder>"
ARGUMENTS = r"(?s)<command-args>(.*?)</command-args>"
COMMAND = "<command-name>"
NOT_SAID = ("<task-notification>", '{"type":"result"', "<local-command-stdout>", "<local-command-stderr>")
INTERRUPTED = ("[Request interrupted by user for tool use]", "[Request interrupted by user]")
HEARTBEAT = ("[heartbeat]", "# atrun")
BARE_TOKEN = r"(?U)^[\w./:@-]+\z"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def clean_user_text(text: Column) -> Column:
    """A user's own words.

    Reminders are cut out wherever they stand; what then begins as a notification, a result or a command's output, or is an
    interruption note or a heartbeat, is nothing.  What begins as a command's echo is its arguments, unless
    they are one bare token such as a model's name or a path.  Markers inside a sentence mean nothing.
    """
    said = strip(F.regexp_replace(F.coalesce(text, F.lit("")), REMINDER, ""))
    arguments = strip(F.regexp_extract(said, ARGUMENTS, 1))
    beat = said.startswith(HEARTBEAT[0]) & F.contains(said, F.lit(HEARTBEAT[1]))
    void = said.isin(*INTERRUPTED) | beat
    for mark in NOT_SAID:
        void = void | said.startswith(mark)
    return F.when(void, F.lit("")).when(said.startswith(COMMAND), F.when(arguments.rlike(BARE_TOKEN), F.lit("")).otherwise(arguments)).otherwise(said)


def canonical_json(payload: Column) -> Column:
    """Any JSON text with sorted keys and no spaces; null if it isn't JSON."""
    def dump(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(json.loads(text), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return None

    return F.udf(dump, "string", useArrow=True)(payload)


def strip_ansi(text: Column) -> Column:
    """Without terminal escapes and control characters other than tab and line ends."""
    escapes = r"\x1b\[[0-?]*[ -/]*[@-~]|\x1b\][^\x07\x1b]*(?:\x07|\x1b\\)|\x1b[@-Z\\-_]"
    return F.regexp_replace(F.regexp_replace(text, escapes, ""), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def fill(template: Column, values: dict[str, Column]) -> Column:
    """`{name}` of the given names replaced, in one pass over the template; other braces stay."""
    pieces = F.regexp_extract_all(template, F.lit(r"(?s)\{\w+\}|[^{]+|\{"), F.lit(0))

    def one(piece: Column) -> Column:
        out = piece
        for name, value in values.items():
            out = F.when(piece == f"{{{name}}}", value).otherwise(out)
        return out

    return F.array_join(F.transform(pieces, one), "")
