"""Discord exports: one JSON object per file, with ids for users, channels and servers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions.chat import addressees, channel_title, resolve_mentions
from textquarry.operators.messages import MESSAGE_COLUMNS, join_mentions, resolve_names

EXPORT_SCHEMA = """
    meta STRUCT<
        users: MAP<STRING, STRUCT<name: STRING>>,
        userindex: ARRAY<STRING>,
        servers: ARRAY<STRUCT<name: STRING, type: STRING>>,
        channels: MAP<STRING, STRUCT<server: INT, name: STRING>>>,
    data MAP<STRING, MAP<STRING, STRUCT<u: INT, t: BIGINT, m: STRING>>>
"""


def read_exports(exports: DataFrame) -> DataFrame:
    """Exports (``file``, ``text``) as ``file``, ``meta`` and ``data``."""
    parsed = F.from_json("text", EXPORT_SCHEMA, {"mode": "FAILFAST"}).alias("e")
    return exports.select("file", parsed).select("file", "e.meta", "e.data")


def parse_discord(exports: DataFrame) -> DataFrame:
    """Messages of exports (``file``, ``text``), with all names looked up in the file.

    A file is one row and brings its own users, channels and servers, so nothing is
    shuffled. Names are put into the messages before these are exploded, so that no
    message carries the user table with it. ``message_id`` is the same whenever the same
    message is loaded again. See ``parse_discord_tables`` for the same by joins."""
    users = F.col("meta.users")
    files = read_exports(exports).select(
        users.alias("users"),
        F.transform("meta.userindex", lambda i: _name_of(users, i)).alias("authors"),
        F.col("meta.servers").alias("servers"),
        F.col("meta.channels").alias("channels"),
        "data",
    )
    channels = files.select(
        "users", "authors", "servers", "channels", F.explode_outer("data").alias("channel_id", "posts")
    ).where(F.col("channel_id").isNotNull())
    channel = F.try_element_at("channels", F.col("channel_id"))
    server = F.get("servers", F.coalesce(channel["server"], F.lit(0)))
    named = channels.select(
        "users",
        "authors",
        "channel_id",
        server["name"].alias("server"),
        channel_title(server["type"], F.coalesce(channel["name"], F.lit(""))).alias("title"),
        (server["type"] == "SERVER").alias("is_server"),
        "posts",
    )

    def message(post):
        text, names = resolve_mentions(
            F.coalesce(post["value"]["m"], F.lit("")), lambda i: _name_of(F.col("users"), i)
        )
        author = F.get("authors", F.coalesce(post["value"]["u"], F.lit(0)))
        return F.struct(
            post["key"].alias("post_id"),
            F.timestamp_millis(F.coalesce(post["value"]["t"], F.lit(0))).alias("time"),
            F.coalesce(author, F.lit("")).alias("from"),
            addressees(F.col("is_server"), names).alias("to"),
            text.alias("message"),
        )

    rows = named.select(
        "channel_id",
        "server",
        F.col("title").alias("channel_or_person"),
        F.explode_outer(F.transform(F.map_entries("posts"), message)).alias("m"),
    ).where(F.col("m").isNotNull())
    return _messages(rows.select("channel_id", "server", "channel_or_person", "m.*"))


def _name_of(users, user_id):
    return F.coalesce(F.try_element_at(users, user_id)["name"], F.lit(""))


def _messages(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.concat_ws("-", F.lit("discord"), "server", "channel_id", "post_id").alias("message_id"),
        *[
            F.lit("discord").alias("protocol") if c == "protocol" else F.col(f"`{c}`")
            for c in MESSAGE_COLUMNS
        ],
    )


def parse_discord_tables(exports: DataFrame) -> DataFrame:
    """The same from lookup tables: those of all files are exploded and joined on equal
    keys. Made for exports with very many users, where a look into the file's own user
    map for each message would be slow, and for lookup tables kept apart."""
    read = read_exports(exports)
    messages = (
        read.select("file", F.explode_outer("data").alias("channel_id", "posts"))
        .select("file", "channel_id", F.explode_outer("posts").alias("post_id", "post"))
        .where(F.col("post_id").isNotNull())
        .select(
            "file",
            "channel_id",
            "post_id",
            F.coalesce("post.u", F.lit(0)).alias("author"),
            F.timestamp_millis(F.coalesce("post.t", F.lit(0))).alias("time"),
            F.coalesce("post.m", F.lit("")).alias("message"),
        )
    )
    users = read.select("file", F.explode_outer("meta.users").alias("user_id", "user")).select(
        "file", "user_id", F.coalesce("user.name", F.lit("")).alias("name")
    )
    authors = (
        read.select("file", F.posexplode_outer("meta.userindex").alias("author", "user_id"))
        .join(users, ["file", "user_id"], "left")
        .select("file", "author", F.coalesce("name", F.lit("")).alias("from"))
    )
    listed = read.select("file", F.explode_outer("meta.channels").alias("channel_id", "c"))
    channels = (
        read.select("file", F.explode_outer(F.map_keys("data")).alias("channel_id"))
        .join(listed, ["file", "channel_id"], "left")
        .select(
            "file",
            "channel_id",
            F.coalesce("c.server", F.lit(0)).alias("server_at"),
            F.coalesce("c.name", F.lit("")).alias("channel_name"),
        )
    )
    servers = read.select("file", F.posexplode_outer("meta.servers").alias("server_at", "s")).select(
        "file", "server_at", F.col("s.name").alias("server"), F.col("s.type").alias("server_type")
    )
    named = resolve_names(messages, authors, channels, servers).withColumn(
        "from", F.coalesce("from", F.lit(""))
    )
    return _messages(join_mentions(named, users, ["channel_id", "post_id"]))


def read_discord(spark: SparkSession, path: str) -> DataFrame:
    """Messages of one export file, or of all files that match a path pattern."""
    files = spark.read.text(path, wholetext=True)
    return parse_discord(files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")))
