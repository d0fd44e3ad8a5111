"""Chat logs and ranked message search over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from textquarry.functions.chat import conversation_from_dir, parse_log_time
from textquarry.functions.text import english_terms, plain_terms, shingles
from textquarry.layout import durable_dir
from textquarry.operators.filters import match_any_username, match_username
from textquarry.operators.messages import (
    drop_after_first_bad_line,
    format_message,
    message_json,
    parse_log_lines,
    parse_message_json,
)
from textquarry.operators.ranking import bm25, collection_stats, term_postings
from textquarry.plans.chat_index import ChatIndex, index_messages, search_chat_index
from textquarry.plans.chat_search import search_messages
from textquarry.sources.discord import parse_discord, parse_discord_tables
from textquarry.sources.weechat import parse_weechat, weechat_stats
from workload.porter_sql import stems_sql
from workload.tables import MESSAGES_SQL, messages, table

SEARCH = "The thing of their ins"
TERMS = ["thing", "ins"]  # SEARCH without stop words

# The same words as the library's, and its stop words, for SQL.
WORDS_SQL = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{M}}\p{{N}}_]+(?:[''\x{{2019}}][\p{{L}}\p{{M}}\p{{N}}_]+)*')"
STOP_SQL = (
    "['a','an','and','are','as','at','be','but','by','for','if','in','into','is','it','no','not',"
    "'of','on','or','such','that','the','their','then','there','these','they','this','to','was',"
    "'will','with']"
)


def _words_sql(column: str) -> str:
    return WORDS_SQL.format(column)


def _plain_sql(column: str) -> str:
    bare = f"list_transform({_words_sql(column)}, lambda w: regexp_replace(w, '[''\\x{{2019}}\\x{{FF07}}]s$', ''))"
    return f"list_filter({bare.replace('{{', '{').replace('}}', '}')}, lambda w: NOT list_contains({STOP_SQL}, w))"


def _pairs_sql(column: str) -> str:
    return (
        f"(SELECT list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) "
        f"FROM (SELECT {_words_sql(column)} AS w))"
    )


def _usernames(spark, sf_dir):
    rows = messages(spark, sf_dir)
    rows = rows.withColumn("to", F.array(F.lit("%Other"), F.col("from")))
    hit = match_username(F.col("from"), "aSSistant") | match_any_username(F.col("to"), "+SYSTEM")
    return rows.where(hit).select("message_id", "from")


def _shingles(spark, sf_dir):
    pairs = messages(spark, sf_dir).select(F.explode_outer(shingles(F.col("message"))).alias("pair"))
    return pairs.where(F.col("pair").isNotNull()).groupBy("pair").agg(F.count("*").alias("n"))


def _terms(analyzer):
    def query(spark, sf_dir):
        terms = messages(spark, sf_dir).select(F.explode_outer(analyzer(F.col("message"))).alias("term"))
        return terms.where(F.col("term").isNotNull()).groupBy("term").agg(F.count("*").alias("n"))

    return query


def _bm25(spark, sf_dir):
    rows = messages(spark, sf_dir)
    terms = plain_terms(F.col("message"))
    size = collection_stats(rows, terms).first()
    postings = term_postings(rows, terms, "message_id")
    scored = bm25(postings, TERMS, size.n_docs, size.avg_length, key="message_id")
    return scored.select("message_id", F.round("score", 6).alias("score"))


def _search(**options):
    def query(spark, sf_dir):
        found = search_messages(messages(spark, sf_dir), **options)
        return found.select("message_id", F.col("from").alias("sender"), F.round("score", 6).alias("score"))

    return query


def _stored_search(spark, sf_dir):
    """The same search over stored postings."""
    index = ChatIndex(durable_dir(spark, "chat"), plain_terms)
    index_messages(messages(spark, sf_dir), index)
    found = search_chat_index(
        spark, index, SEARCH, sender="ASSISTANT", protocol="irc", server="net.two"
    )
    return found.select("message_id", F.col("from").alias("sender"), F.round("score", 6).alias("score"))


def _stored_newest(spark, sf_dir):
    """A stored search without text."""
    index = ChatIndex(durable_dir(spark, "chat"), plain_terms)
    index_messages(messages(spark, sf_dir), index)
    found = search_chat_index(spark, index, "", sender="assistant", server="net.one", k=20)
    return found.select("message_id", "time")


def _newest(spark, sf_dir):
    found = search_messages(messages(spark, sf_dir), sender="assistant", server="net.one", k=20)
    return found.select("message_id", "time")


def _formatted(spark, sf_dir):
    rows = messages(spark, sf_dir)
    late = rows.withColumn("time", F.col("time") + F.expr("INTERVAL 250 MILLISECONDS"))
    return format_message(rows.where("server = 'net.one'").unionByName(late.where("server <> 'net.one'"))).select(
        "message_id", "printed"
    )


def _wire(spark, sf_dir):
    rows = messages(spark, sf_dir)
    rows = rows.withColumn("to", F.when(F.col("from") == "System", F.array(F.lit("a b"), F.lit('"c"'))))
    wire = message_json(rows)
    return wire.select("message_id", "json")


def _wire_round_trip(spark, sf_dir):
    back = parse_message_json(_wire(spark, sf_dir))
    return back.select("message_id", "server", "time", "from", F.to_json("to").alias("addressees"), "message")


def _log_files(spark, sf_dir):
    """One log file per message: a message line per line of text. User messages get a
    bad line and one more good line, which must be cut off."""
    rows = table(spark, sf_dir, "conversations")
    stamp = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id")), "yyyy-MM-dd HH:mm:ss ")
    sender = F.when(F.col("role") == "system", "-->").otherwise(F.concat(F.lit("@"), "role"))
    call = F.when(F.col("role") == "assistant", "user: ").otherwise("")
    head = F.concat(stamp, F.lit("\t"), sender, F.lit("\t"), call)
    body = F.array_join(F.transform(F.split("text", "\n"), lambda line: F.concat(head, line)), "\n")
    tail = F.when(
        F.col("role") == "user", F.concat(F.lit("\nno tabs\n"), head, F.lit("after\n"))
    ).otherwise("\nirc: disconnected from server\n")
    folder = F.concat(F.lit("net."), F.when(F.col("role") == "user", "#c").otherwise("c"), "conv_id")
    return rows.select(
        F.concat_ws("/", F.lit("/logs/irc"), folder, F.concat(F.col("turn"), F.lit(".weechatlog"))).alias("file"),
        F.concat(body, tail).alias("text"),
    )


def _weechat(spark, sf_dir):
    return parse_weechat(_log_files(spark, sf_dir)).select(
        "file", "line_no", "server", "channel_or_person", "time", "from",
        F.array_join("to", ",").alias("addressee"), "message",
    )


def _weechat_stats(spark, sf_dir):
    return weechat_stats(_log_files(spark, sf_dir))


def _log_lines(spark, sf_dir):
    """Events as log lines, a file per user: errors are lines without fields."""
    events = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss ")
    bad = (F.col("event_type") == "error") & (F.col("event_id") > 3000)
    line = F.when(bad, "error").otherwise(
        F.concat(stamp, F.lit("\t"), "event_type", F.lit("\tevent "), "event_id")
    )
    return events.select(
        F.col("user_id").alias("file"), (F.col("event_id") + 1).alias("line_no"), line.alias("line")
    )


def _cut_lines(spark, sf_dir):
    kept = drop_after_first_bad_line(_log_lines(spark, sf_dir))
    return parse_log_lines(kept).select("file", "line_no", "time", "from", "message")


def _log_times(spark, sf_dir):
    events = table(spark, sf_dir, "events", "event_id", "ts", "event_type")
    forms = {"click": "yyyy-MM-dd HH:mm:ss ", "view": "yyyy-MM-dd  H:mm:ss", "error": "dd.MM.yyyy HH:mm:ss "}
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    for kind, form in forms.items():
        text = F.when(F.col("event_type") == kind, F.date_format("ts", form)).otherwise(text)
    return events.select("event_id", parse_log_time(text).alias("time"))


def _conversations(spark, sf_dir):
    """Host names and parts of URLs as log directory names."""
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    name = F.concat(
        F.element_at(F.split("url", "/"), 3), F.lit("."),
        F.when(F.col("url").contains("#"), F.regexp_extract("url", "#.*", 0)).otherwise(F.lit("")),
    )
    server, channel = conversation_from_dir(name)
    return pages.select("page_id", server.alias("server"), channel.alias("channel_or_person"))


def _exports(spark, sf_dir):
    """One export file per message, with mentions of two known users and an unknown one."""
    rows = table(spark, sf_dir, "conversations")

    def user(name):
        return F.struct(F.lit(name).alias("name") if isinstance(name, str) else name.alias("name"))

    users = F.create_map(
        F.lit("10"), user(F.col("role")), F.lit("7"), user("<@9>"), F.lit("9"), user("Nine")
    )
    server = F.struct(
        F.lit("srv").alias("name"),
        F.when(F.col("role") == "system", "DM").otherwise("SERVER").alias("type"),
    )
    channel = F.struct(F.lit(1).alias("server"), F.col("role").alias("name"))
    other = F.struct(F.lit("other").alias("name"), F.lit("DM").alias("type"))
    meta = F.struct(
        users.alias("users"),
        F.array(F.lit("9"), F.lit("10")).alias("userindex"),
        F.array(other, server).alias("servers"),
        F.create_map(F.col("conv_id").cast("string"), channel).alias("channels"),
    )
    mentions = F.when(F.col("role") == "user", "").otherwise("<@7> and <@9>, <@404>.")
    post = F.struct(
        F.lit(1).alias("u"),
        ((F.lit(1704067200) + F.col("conv_id")) * 1000 + F.col("turn")).alias("t"),
        F.concat("text", mentions).alias("m"),
    )
    posts = F.create_map(F.col("turn").cast("string"), post)
    data = F.create_map(F.col("conv_id").cast("string"), posts)
    return rows.select(
        F.concat_ws("-", "conv_id", "turn").alias("file"),
        F.to_json(F.struct(meta.alias("meta"), data.alias("data"))).alias("text"),
    )


def _discord(parse):
    def query(spark, sf_dir):
        return parse(_exports(spark, sf_dir)).select(
            "message_id", "server", "channel_or_person", "time", "from",
            F.to_json("to").alias("addressees"), "message",
        )

    return query


QUERIES = {
    "username_match": _usernames,
    "shingle_frequency": _shingles,
    "plain_term_frequency": _terms(plain_terms),
    "english_term_frequency": _terms(english_terms),
    "bm25_scores": _bm25,
    "search_messages": _search(text=SEARCH, k=25, analyzer=plain_terms),
    "search_messages_filtered": _search(
        text=SEARCH, sender="ASSISTANT", protocol="irc", server="net.two", k=10, analyzer=plain_terms
    ),
    "stored_message_search": _stored_search,
    "search_messages_stemmed": _search(text=SEARCH, k=10),
    "newest_messages": _newest,
    "stored_newest_messages": _stored_newest,
    "format_messages": _formatted,
    "message_json": _wire,
    "message_json_round_trip": _wire_round_trip,
    "weechat_files": _weechat,
    "weechat_stats": _weechat_stats,
    "log_lines_cut": _cut_lines,
    "log_times": _log_times,
    "conversation_names": _conversations,
    "discord_exports": _discord(parse_discord),
    "discord_exports_by_joins": _discord(parse_discord_tables),
}


def _search_sql(where: str, k: int, terms: list[str] = TERMS, stemmed: bool = False) -> str:
    def part(field: str, wanted: list[str]) -> str:
        terms = ", ".join(
            f"(SELECT count(*) FROM unnest({field}) t(x) WHERE x = '{w}') AS {field}_{i}"
            for i, w in enumerate(wanted)
        )
        return terms

    def score(field: str, wanted: list[str]) -> str:
        return " + ".join(
            f"""CASE WHEN {field}_{i} > 0 THEN
                ln(1 + ({field}_n - {field}_df_{i} + 0.5) / ({field}_df_{i} + 0.5))
                * {field}_{i} * 2.2 / ({field}_{i} + 1.2 * (0.25 + 0.75 * len({field}) / {field}_avg))
                ELSE 0 END"""
            for i, _ in enumerate(wanted)
        )

    def stats(field: str, wanted: list[str]) -> str:
        df = ", ".join(
            f"count(*) FILTER (WHERE {field}_{i} > 0) AS {field}_df_{i}" for i, _ in enumerate(wanted)
        )
        return (
            f"count(*) FILTER (WHERE len({field}) > 0) AS {field}_n, "
            f"avg(len({field})) FILTER (WHERE len({field}) > 0) AS {field}_avg, {df}"
        )

    pairs = ["the thing", "thing of", "of their", "their ins"]
    found, stems = _plain_sql("message"), ""
    if stemmed:
        held = f"SELECT DISTINCT unnest({found}) AS term FROM ({MESSAGES_SQL})"
        stems = f"stems AS (SELECT map(list(term), list(stem)) AS stem_of FROM ({stems_sql(held)})), "
        found = f"list_transform({found}, lambda t: stem_of[t])"
    return f"""
        WITH {stems} analysed AS (SELECT *, {found} AS terms, {_pairs_sql("message")} AS pairs
                          FROM ({MESSAGES_SQL}){", stems" if stemmed else ""}),
             counted AS (SELECT *, {part("terms", terms)}, {part("pairs", pairs)} FROM analysed),
             stats AS (SELECT {stats("terms", terms)}, {stats("pairs", pairs)} FROM counted)
        SELECT message_id, sender,
               round({score("terms", terms)} + {score("pairs", pairs)}, 6) AS score
        FROM counted, stats
        WHERE (terms_0 > 0 OR terms_1 > 0) AND {where}
        ORDER BY score DESC, message_id LIMIT {k}
    """


_LOG_SQL = """
    SELECT '/logs/irc/net.' || CASE role WHEN 'user' THEN '#c' ELSE 'c' END || conv_id
               || '/' || turn || '.weechatlog' AS file,
           CAST(unnest(generate_series(1, len(parts))) AS INTEGER) AS line_no,
           'net' AS server,
           CASE role WHEN 'user' THEN '#c' ELSE 'c' END || conv_id AS channel_or_person,
           make_timestamp((1704067200 + conv_id) * 1000000) AS time,
           '@' || role AS "from",
           CASE role WHEN 'assistant' THEN 'user' END AS addressee,
           CASE role WHEN 'assistant' THEN 'user: ' ELSE '' END || unnest(parts) AS message
    FROM (SELECT *, string_split(text, chr(10)) AS parts FROM conversations)
    WHERE role <> 'system'
"""

_EXPORT_SQL = """
    SELECT 'discord-srv-' || conv_id || '-' || turn AS message_id, 'srv' AS server,
           CASE role WHEN 'system' THEN role ELSE '#' || role END AS channel_or_person,
           make_timestamp(((1704067200 + conv_id) * 1000 + turn) * 1000) AS time,
           role AS "from",
           CASE role WHEN 'system' THEN '[]' WHEN 'assistant' THEN '["<@9>","Nine",""]' END
               AS addressees,
           text || CASE role WHEN 'user' THEN '' ELSE '@<@9> and @Nine, @.' END AS message
    FROM conversations
"""

ORACLE = {
    "username_match": f"""
        SELECT message_id, sender AS "from" FROM ({MESSAGES_SQL})
        WHERE sender IN ('@Assistant', 'System')
    """,
    "shingle_frequency": f"""
        SELECT pair, count(*) AS n
        FROM (SELECT unnest({_pairs_sql("message")}) AS pair FROM ({MESSAGES_SQL})) GROUP BY pair
    """,
    "plain_term_frequency": f"""
        SELECT term, count(*) AS n
        FROM (SELECT unnest({_plain_sql("message")}) AS term FROM ({MESSAGES_SQL})) GROUP BY term
    """,
    "english_term_frequency": f"""
        WITH terms AS (SELECT term, count(*) AS n
                       FROM (SELECT unnest({_plain_sql("message")}) AS term FROM ({MESSAGES_SQL}))
                       GROUP BY term)
        SELECT stem AS term, CAST(sum(n) AS BIGINT) AS n
        FROM ({stems_sql("SELECT term FROM terms")}) JOIN terms USING (term) GROUP BY stem
    """,
    "bm25_scores": f"""
        WITH analysed AS (SELECT message_id, {_plain_sql("message")} AS terms FROM ({MESSAGES_SQL})),
             corpus AS (SELECT count(*) AS n, avg(len(terms)) AS average
                        FROM analysed WHERE len(terms) > 0),
             held AS (SELECT message_id, len(terms) AS length, term, count(*) AS tf
                      FROM (SELECT message_id, terms, unnest(terms) AS term FROM analysed)
                      WHERE term IN ('thing', 'ins') GROUP BY ALL),
             counts AS (SELECT term, count(*) AS df FROM held GROUP BY term)
        SELECT message_id,
               round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
                         / (tf + 1.2 * (0.25 + 0.75 * length / average))), 6) AS score
        FROM held JOIN counts USING (term), corpus GROUP BY message_id
    """,
    "search_messages": _search_sql("true", 25),
    # The stems of the search's terms.
    "search_messages_stemmed": _search_sql("true", 10, ["thing", "in"], stemmed=True),
    "search_messages_filtered": _search_sql("sender = '@Assistant' AND server = 'net.two'", 10),
    "stored_message_search": _search_sql("sender = '@Assistant' AND server = 'net.two'", 10),
    "newest_messages": f"""
        SELECT message_id, time FROM ({MESSAGES_SQL})
        WHERE sender = '@Assistant' AND server = 'net.one'
        ORDER BY time DESC, message_id LIMIT 20
    """,
    "format_messages": f"""
        SELECT message_id,
               'irc://' || server || '/' || channel_or_person || ' '
               || strftime(time, '%Y-%m-%d %H:%M:%S')
               || CASE server WHEN 'net.one' THEN '' ELSE '.25' END
               || ' +0000 UTC <' || sender || '> ' || message AS printed
        FROM ({MESSAGES_SQL})
    """,
    "message_json": f"""
        SELECT message_id, CAST(to_json({{
                   'protocol': protocol, 'server': server, 'channel_or_person': channel_or_person,
                   'time': epoch_ms(time), 'from': sender,
                   'to': CASE sender WHEN 'System' THEN ['a b', '"c"'] END,
                   'message': message}}) AS VARCHAR) AS json
        FROM ({MESSAGES_SQL})
    """,
    "message_json_round_trip": f"""
        SELECT message_id, server, time, sender AS "from",
               CASE sender WHEN 'System' THEN '["a b","\\"c\\""]' END AS addressees, message
        FROM ({MESSAGES_SQL})
    """,
    "weechat_files": _LOG_SQL,
    "weechat_stats": """
        SELECT count(*) FILTER (WHERE role <> 'user') AS indexed,
               count(*) FILTER (WHERE role = 'user') AS skipped
        FROM conversations
    """,
    "log_lines_cut": """
        WITH lines AS (
            SELECT *, min(CASE WHEN event_type = 'error' AND event_id > 3000 THEN event_id END)
                          OVER (PARTITION BY user_id) AS first_bad
            FROM events)
        SELECT user_id AS file, event_id + 1 AS line_no, date_trunc('second', ts) AS time,
               event_type AS "from", 'event ' || event_id AS message
        FROM lines WHERE first_bad IS NULL OR event_id < first_bad
    """,
    "log_times": """
        SELECT event_id, CASE event_type WHEN 'error' THEN NULL
                   WHEN 'click' THEN date_trunc('second', ts)
                   WHEN 'view' THEN date_trunc('second', ts) ELSE ts END AS time
        FROM events
    """,
    "conversation_names": """
        SELECT page_id, split_part(url, '/', 3) AS server,
               regexp_extract(url, '#.*') AS channel_or_person
        FROM pages
    """,
    "discord_exports": _EXPORT_SQL,
    "discord_exports_by_joins": _EXPORT_SQL,
}
ORACLE["stored_newest_messages"] = ORACLE["newest_messages"]
