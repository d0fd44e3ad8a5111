"""Columns for chat logs: conversation names, addressees, times, mentions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Senders that mark system lines, and a line without fields that is no error.
SYSTEM_SENDERS = ["--", "<--", "-->", "←", "→", ""]
DISCONNECT_LINE = "irc: disconnected from server"
ADDRESSEE_PATTERN = r"^([^: ]+): "
MENTION_PATTERN = r"<@(\d+)>"

LOG_TIME_PATTERN = r"^(\d{4}-\d\d-\d\d) +(\d{1,2}:\d\d:\d\d)(?:[.,](\d{1,6})\d*)? *\z"


def conversation_from_dir(name: Column) -> tuple[Column, Column]:
    """Server and channel or person, from a log directory name.

    ``server.#channel`` is cut before the ``#`` (the character before it is dropped),
    ``server.person`` at its last dot. Both columns are null for other names, and for a
    name that starts with ``#``."""
    hash_at = F.instr(name, "#")
    dot_at = F.length(name) - F.instr(F.reverse(name), ".") + 1
    has_dot = F.contains(name, F.lit("."))
    server = F.when(hash_at > 1, F.substr(name, F.lit(1), hash_at - 2)).when(
        (hash_at == 0) & has_dot, F.substr(name, F.lit(1), dot_at - 1)
    )
    channel = F.when(hash_at > 1, F.substr(name, hash_at)).when(
        (hash_at == 0) & has_dot, F.substr(name, dot_at + 1)
    )
    return server, channel


def parse_log_time(text: Column) -> Column:
    """UTC time of a log line, null if it is not one.

    Blanks after the time may be missing or several, the hour may have one digit, and
    a fraction may follow the seconds."""
    iso = F.regexp_replace(text, LOG_TIME_PATTERN, "$1 $2.$3Z")
    return F.when(text.rlike(LOG_TIME_PATTERN), iso.try_cast("timestamp"))


def addressee(text: Column) -> Column:
    """``[nick]`` for a text that starts with ``nick: ``, else null."""
    nick = F.regexp_extract(text, ADDRESSEE_PATTERN, 1)
    return F.when(text.rlike(ADDRESSEE_PATTERN), F.array(nick))


def mention_ids(text: Column) -> Column:
    """Ids of all ``<@digits>`` mentions, in order."""
    return F.regexp_extract_all(text, F.lit(MENTION_PATTERN), F.lit(1))


def weave_mentions(text: Column, names: Column) -> Column:
    """Put ``@name`` in place of each mention. Only the original text is searched, so a
    name that looks like a mention stays as it is."""
    pieces = F.split(text, MENTION_PATTERN, -1)
    joined = F.zip_with(
        pieces, names, lambda piece, name: F.concat(piece, F.coalesce(F.concat(F.lit("@"), name), F.lit("")))
    )
    return F.array_join(joined, "")


def resolve_mentions(
    text: Column, name_of: Callable[[Column], Column]
) -> tuple[Column, Column]:
    """Text with names for mentions, and the names in order, given the lookup of a name
    by id."""
    names = F.transform(mention_ids(text), name_of)
    return weave_mentions(text, names), names


def channel_title(server_type: Column, name: Column) -> Column:
    """``#name`` on a SERVER, the bare name for a DM; another type fails the job."""
    unknown = F.concat(F.lit("unknown server type "), F.coalesce(server_type, F.lit("")))
    return (
        F.when(server_type == "SERVER", F.concat(F.lit("#"), name))
        .when(server_type == "DM", name)
        .otherwise(F.raise_error(unknown))
    )


def addressees(is_server: Column, names: Column) -> Column:
    """Mentioned names on a SERVER, null without any; always empty for a DM."""
    return F.when(is_server, F.when(F.size(names) > 0, names)).otherwise(
        F.array().cast("array<string>")
    )


def time_text(time: Column) -> Column:
    """UTC time with milliseconds only where there are some, then offset and zone."""
    utc = F.convert_timezone(None, F.lit("UTC"), time.cast("timestamp_ntz"))
    return F.concat(utc.cast("string"), F.lit(" +0000 UTC"))
