"""Chat messages: log lines, exports, wire form and printed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.functions.chat import (
    DISCONNECT_LINE,
    SYSTEM_SENDERS,
    addressee,
    addressees,
    channel_title,
    mention_ids,
    parse_log_time,
    time_text,
    weave_mentions,
)

MESSAGE_SCHEMA = T.StructType(
    [
        T.StructField("protocol", T.StringType()),
        T.StructField("server", T.StringType()),
        T.StructField("channel_or_person", T.StringType()),
        T.StructField("time", T.TimestampType()),
        T.StructField("from", T.StringType()),
        T.StructField("to", T.ArrayType(T.StringType())),
        T.StructField("message", T.StringType()),
    ]
)
MESSAGE_COLUMNS = MESSAGE_SCHEMA.names

_WIRE_SCHEMA = T.StructType(
    [f if f.name != "time" else T.StructField("time", T.LongType()) for f in MESSAGE_SCHEMA]
)


def _fields(line: Column) -> Column:
    return F.split(line, "\t", 3)


def is_bad_line(line: Column) -> Column:
    """True for a line that does not hold three fields and a time."""
    fields = _fields(line)
    well_formed = (F.size(fields) == 3) & parse_log_time(F.get(fields, 0)).isNotNull()
    return (line != DISCONNECT_LINE) & ~well_formed


def drop_after_first_bad_line(lines: DataFrame, file: str = "file") -> DataFrame:
    """Lines (``file``, ``line_no``, ``line``) before the first bad one of their file.

    Only the smallest bad line number of a file is shuffled, combined per task, so a
    file with very many lines is never brought into one task."""
    first_bad = (
        lines.where(is_bad_line(F.col("line")))
        .groupBy(file)
        .agg(F.min("line_no").alias("first_bad"))
    )
    kept = lines.join(first_bad, file, "left")
    return kept.where(
        F.col("first_bad").isNull() | (F.col("line_no") < F.col("first_bad"))
    ).drop("first_bad")


def cut_at_first_bad_line(lines: Column) -> Column:
    """The same for an array with the lines of one file."""
    bad_at = F.array_position(F.transform(lines, is_bad_line), True)
    return F.when(bad_at == 0, lines).otherwise(
        F.slice(lines, F.lit(1), F.greatest(bad_at - 1, F.lit(0)).cast("int"))
    )


def drop_system_lines(messages: DataFrame) -> DataFrame:
    """Messages without those of the log writer itself."""
    return messages.where(~F.col("from").isin(SYSTEM_SENDERS))


def parse_log_lines(lines: DataFrame) -> DataFrame:
    """Messages from good log lines; other columns are kept."""
    others = [c for c in lines.columns if c != "line"]
    fields = lines.where(F.col("line") != DISCONNECT_LINE).select(
        *others, _fields(F.col("line")).alias("fields")
    )
    messages = fields.select(
        *others,
        parse_log_time(F.get("fields", 0)).alias("time"),
        F.get("fields", 1).alias("from"),
        addressee(F.get("fields", 2)).alias("to"),
        F.get("fields", 2).alias("message"),
    )
    return drop_system_lines(messages)


def resolve_names(
    messages: DataFrame, authors: DataFrame, channels: DataFrame, servers: DataFrame
) -> DataFrame:
    """Names for the ids of an export, by lookups on equal keys.

    ``messages`` (``file``, ``channel_id``, ``author``, ...), ``authors`` (``file``,
    ``author``, ``from``), ``channels`` (``file``, ``channel_id``, ``server_at``,
    ``channel_name``) and ``servers`` (``file``, ``server_at``, ``server``,
    ``server_type``). Spark broadcasts the lookup tables where they are small. A server
    that is neither a SERVER nor a DM fails the job."""
    channel = channel_title(F.col("server_type"), F.col("channel_name"))
    named = channels.join(servers, ["file", "server_at"], "left").select(
        "file", "channel_id", "server", "server_type", channel.alias("channel_or_person")
    )
    return messages.join(named, ["file", "channel_id"], "left").join(
        authors, ["file", "author"], "left"
    )


def join_mentions(messages: DataFrame, users: DataFrame, key: list[str]) -> DataFrame:
    """Names for ``<@id>`` mentions, from ``users`` (``file``, ``user_id``, ``name``).

    ``key`` identifies a message. Only messages with a mention take part in the lookup;
    their mentions come back together in order, so a hot user is only a hot lookup key.
    ``to`` is the names for a SERVER (null without any) and empty for a DM."""
    server = F.col("server_type") == "SERVER"
    with_ids = messages.withColumn("ids", mention_ids(F.col("message")))
    none = addressees(server, F.array().cast("array<string>"))
    plain = with_ids.where(F.size("ids") == 0).drop("ids").withColumn("to", none)
    mentioning = with_ids.where(F.size("ids") > 0)
    names = (
        mentioning.select("file", *key, F.posexplode("ids").alias("at", "user_id"))
        .join(users, ["file", "user_id"], "left")
        .groupBy("file", *key)
        .agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("name", F.lit("")).alias("name")))).alias("found"))
        .select("file", *key, F.col("found.name").alias("names"))
    )
    woven = (
        mentioning.join(names, ["file", *key])
        .withColumn("message", weave_mentions(F.col("message"), F.col("names")))
        .withColumn("to", addressees(server, F.col("names")))
        .drop("ids", "names")
    )
    return plain.unionByName(woven)


def message_json(messages: DataFrame) -> DataFrame:
    """Wire form: one JSON object per message, the time in epoch milliseconds."""
    fields = [
        F.unix_millis("time").alias("time") if c == "time" else F.col(f"`{c}`")
        for c in MESSAGE_COLUMNS
    ]
    others = [c for c in messages.columns if c not in MESSAGE_COLUMNS]
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return messages.select(*others, body.alias("json"))


def parse_message_json(wire: DataFrame) -> DataFrame:
    """Messages from their wire form."""
    others = [c for c in wire.columns if c != "json"]
    read = wire.select(*others, F.from_json("json", _WIRE_SCHEMA, {"mode": "FAILFAST"}).alias("m"))
    fields = [
        F.timestamp_millis("m.time").alias("time") if c == "time" else F.col(f"m.`{c}`")
        for c in MESSAGE_COLUMNS
    ]
    return read.select(*others, *fields)


def format_message(messages: DataFrame) -> DataFrame:
    """Printed form, ``protocol://server/channel time <from> message``."""
    # Fixed value: the printed layout.
    printed = F.format_string(
        "%s://%s/%s %s <%s> %s",
        "protocol", "server", "channel_or_person", time_text(F.col("time")), "from", "message",
    )
    return messages.withColumn("printed", printed)
