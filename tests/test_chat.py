"""Log and export readers, terms, and ranked search."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from textquarry.functions.chat import conversation_from_dir, parse_log_time
from textquarry.functions.text import (
    english_terms,
    normalize_username,
    plain_terms,
    porter_stem,
    shingles,
    words,
)
from textquarry.operators.messages import (
    MESSAGE_COLUMNS,
    MESSAGE_SCHEMA,
    format_message,
    message_json,
    parse_message_json,
)
from textquarry.operators.ranking import term_postings
from textquarry.plans.chat_index import ChatIndex, index_messages, search_chat_index
from textquarry.plans.chat_search import search_messages
from textquarry.sources.discord import read_discord
from textquarry.sources.weechat import log_files, read_weechat, weechat_stats


@pytest.fixture(scope="module")
def logs(tmp_path_factory):
    root = tmp_path_factory.mktemp("logs")

    def write(folder, name, *lines, end="\n"):
        (root / "irc" / folder).mkdir(parents=True, exist_ok=True)
        (root / "irc" / folder / name).write_text("\n".join(lines) + end)

    stamp = "2024-02-29 10:00:00"
    write(
        "libera.#go", "2024.log",
        f"{stamp} \t@ann\tbob: hi\tthere",
        "irc: disconnected from server",
        f"{stamp}\t--\tsystem",
        f"{stamp} \t\tempty sender",
        f"{stamp} \t←\tarrow",
        f"{stamp} \tbob\t: no addressee\r",
        end="",
    )
    write("libera.bob", "a.log", f"{stamp} \tbob\tfirst", "bad line", f"{stamp} \tbob\tlost")
    write("libera.bob", "b.log", "2024-02-30 10:00:00 \tbob\tno such day")
    write("net.sub.#x.y", "c.log", f"{stamp} \t+eve\tone", f"{stamp} \t+eve\ttwo")
    write("neither", "d.log", f"{stamp} \tbob\tskipped folder")
    write("#lead", "e.log", f"{stamp} \tbob\tskipped folder")
    return str(root)


def test_weechat(spark, logs):
    rows = read_weechat(spark, logs).orderBy("server", "channel_or_person", "line_no").collect()
    got = [(r.server, r.channel_or_person, r.line_no, r["from"], r.to, r.message) for r in rows]
    assert got == [
        ("libera", "#go", 1, "@ann", ["bob"], "bob: hi\tthere"),
        ("libera", "#go", 6, "bob", None, ": no addressee"),
        ("libera", "bob", 1, "bob", None, "first"),
        ("net.sub", "#x.y", 1, "+eve", None, "one"),
        ("net.sub", "#x.y", 2, "+eve", None, "two"),
    ]
    assert {r.protocol for r in rows} == {"irc"}
    assert rows[0].time == dt.datetime(2024, 2, 29, 10)
    stats = weechat_stats(log_files(spark, logs)).first()
    assert (stats.indexed, stats.skipped) == (2, 2)


def test_log_times(spark):
    good = ["2024-01-02 03:04:05 ", "2024-01-02 03:04:05", "2024-01-02  3:04:05   ", "2024-01-02 03:04:05.5 "]
    bad = ["2024-01-02T03:04:05 ", "2024-13-02 03:04:05 ", "2024-01-02 25:04:05 ", "", "2024-1-2 03:04:05 ", "x"]
    rows = spark.createDataFrame([(t,) for t in good + bad], "t string")
    got = [r.t for r in rows.select(parse_log_time(F.col("t")).alias("t")).collect()]
    base = dt.datetime(2024, 1, 2, 3, 4, 5)
    assert got == [base, base, base, base.replace(microsecond=500_000)] + [None] * len(bad)


def test_conversation_names(spark):
    names = ["a.#b", "a.b.c", "x", "#c", "a#b", "n.é.#ü#v", ".p"]
    server, channel = conversation_from_dir(F.col("n"))
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(server, channel).collect()
    want = [("a", "#b"), ("a.b", "c"), (None, None), (None, None), ("", "#b"), ("n.é", "#ü#v"), ("", "p")]
    assert [tuple(r) for r in rows] == want


def export(server_type="SERVER"):
    return {
        "meta": {
            "users": {"1": {"name": "<@2>"}, "2": {"name": "two"}, "3": {"name": "three"}},
            "userindex": ["2", "1", "44"],
            "servers": [{"name": "S", "type": server_type}, {"name": "D", "type": "DM"}],
            "channels": {"10": {"server": 0, "name": "gen"}, "11": {"server": 1, "name": "pal"}},
        },
        "data": {
            "10": {
                "100": {"u": 0, "t": 1700000000123, "m": "plain"},
                "101": {"u": 1, "t": 1700000001000, "m": "<@1> and <@2><@2> but <@9> <@x>"},
                "102": {"u": 2, "t": 1700000002000, "m": ""},
            },
            "11": {"103": {"u": 1, "t": 1700000003000, "m": "hi <@3>"}, "104": {"u": 0, "t": 0, "m": "yo"}},
        },
    }


def test_discord(spark, tmp_path):
    path = tmp_path / "export.json"
    path.write_text(json.dumps(export(), indent=1))
    rows = {r.message_id: r for r in read_discord(spark, str(path)).collect()}
    got = {k: (r.server, r.channel_or_person, r["from"], r.to, r.message) for k, r in rows.items()}
    assert got == {
        "discord-S-10-100": ("S", "#gen", "two", None, "plain"),
        "discord-S-10-101": ("S", "#gen", "<@2>", ["<@2>", "two", "two", ""], "@<@2> and @two@two but @ <@x>"),
        "discord-S-10-102": ("S", "#gen", "", None, ""),
        "discord-D-11-103": ("D", "pal", "<@2>", [], "hi @three"),
        "discord-D-11-104": ("D", "pal", "two", [], "yo"),
    }
    assert rows["discord-S-10-100"].time == dt.datetime(2023, 11, 14, 22, 13, 20, 123000)
    path.write_text(json.dumps(export("GROUP")))
    with pytest.raises(Exception, match="unknown server type GROUP"):
        read_discord(spark, str(path)).collect()


def test_wire_form_round_trip(spark):
    time = dt.datetime(2024, 1, 2, 3, 4, 5, 60_000)
    rows = [
        ("irc", "s", "#c", time, "@a", None, 'q"\n'),
        ("discord", "s", "p", time, "é", [], "<&>"),
        ("irc", "s", "p", time.replace(microsecond=0), "b", ["x", "y"], ""),
    ]
    messages = spark.createDataFrame(rows, MESSAGE_SCHEMA)
    wire = message_json(messages)
    first = json.loads(wire.first().json)
    assert list(first) == MESSAGE_COLUMNS
    assert first["time"] == 1704164645060 and first["to"] is None
    assert [tuple(r) for r in parse_message_json(wire).collect()] == rows
    printed = [r.printed for r in format_message(messages).collect()]
    assert printed[0] == 'irc://s/#c 2024-01-02 03:04:05.06 +0000 UTC <@a> q"\n'
    assert printed[2] == "irc://s/p 2024-01-02 03:04:05 +0000 UTC <b> "


STEMS = dict(
    caresses="caress", ponies="poni", ties="ti", caress="caress", cats="cat", feed="feed", agreed="agre",
    plastered="plaster", bled="bled", motoring="motor", sing="sing", conflated="conflat", troubled="troubl",
    sized="size", hopping="hop", tanned="tan", falling="fall", hissing="hiss", fizzed="fizz", failing="fail",
    filing="file", happy="happi", sky="sky", relational="relat", conditional="condit", rational="ration",
    valenci="valenc", hesitanci="hesit", digitizer="digit", conformabli="conform", radicalli="radic",
    differentli="differ", vileli="vile", analogousli="analog", vietnamization="vietnam", predication="predic",
    operator="oper", feudalism="feudal", decisiveness="decis", hopefulness="hope", callousness="callous",
    formaliti="formal", sensitiviti="sensit", sensibiliti="sensibl", triplicate="triplic", formative="form",
    formalize="formal", electriciti="electr", electrical="electr", hopeful="hope", goodness="good",
    revival="reviv", allowance="allow", inference="infer", airliner="airlin", gyroscopic="gyroscop",
    adjustable="adjust", defensible="defens", irritant="irrit", replacement="replac", adjustment="adjust",
    dependent="depend", adoption="adopt", homologou="homolog", communism="commun", activate="activ",
    angulariti="angular", homologous="homolog", effective="effect", bowdlerize="bowdler", probate="probat",
    rate="rate", cease="ceas", controll="control", roll="roll", by="by", searching="search", yes="ye",
)


def test_published_stems():
    assert {w: porter_stem(w) for w in STEMS} == STEMS


def test_terms(spark):
    text = "The Dogs' dog's don’t RUNNING, über-cool x_1 3.5 l’Été"
    row = spark.createDataFrame([(text,)], "t string").select(
        words(F.col("t")).alias("w"), plain_terms(F.col("t")).alias("p"),
        english_terms(F.col("t")).alias("e"), shingles(F.lit("One two THREE")).alias("s"),
        shingles(F.lit("one")).alias("s1"), shingles(F.lit("")).alias("s0"),
        english_terms(F.lit(None).cast("string")).alias("n"),
    ).first()
    assert row.w == ["the", "dogs", "dog's", "don’t", "running", "über", "cool", "x_1", "3", "5", "l’été"]
    assert row.p == ["dogs", "dog", "don’t", "running", "über", "cool", "x_1", "3", "5", "l’été"]
    assert row.e[:4] == ["dog", "dog", "don’t", "run"]
    assert (row.s, row.s1, row.s0, row.n) == (["one two", "two three"], [], [], None)


def test_term_postings(spark):
    texts = ["b a b c", "", "x", "é é é a"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, t string")
    got = sorted(map(tuple, term_postings(rows, words(F.col("t"))).collect()))
    want = [(i, len(t.split()), w, t.split().count(w)) for i, t in enumerate(texts) for w in set(t.split())]
    assert got == sorted(want)


def test_usernames(spark):
    names = ["@Ann", "+ann", "ann", "%@ann", "@", "", "+"]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.n for r in rows.select(normalize_username(F.col("n")).alias("n")).collect()]
    assert got == ["ann", "ann", "ann", "@ann", "@", "", "+"]


@pytest.fixture(scope="module")
def messages(spark):
    texts = [
        "the quick brown fox", "quick quick fox", "brown foxes running", "a fox quick brown dog",
        "nothing here", "", "the the the", "runs quickly",
    ]
    time = dt.datetime(2024, 1, 1)
    rows = [
        (str(i), "irc", "s", "#c" if i < 4 else "#d", time + dt.timedelta(i), "@A" if i % 2 else "b", None, t)
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, "message_id string, " + MESSAGE_SCHEMA.simpleString()[7:-1].replace(":", " "))


def test_ranked_search_by_brute_force(messages):
    rows = [(r.message_id, r.message) for r in messages.collect()]
    stop = {"the", "a"}
    terms = {i: [porter_stem(w) for w in t.split() if w not in stop] for i, t in rows}
    pairs = {i: [f"{a} {b}" for a, b in zip(t.split(), t.split()[1:])] for i, t in rows}

    def score(held, query, i):
        used = [v for v in held.values() if v]
        average, total = sum(map(len, used)) / len(used), 0.0
        for q in query:
            df, tf = sum(q in v for v in used), held[i].count(q)
            idf = math.log(1 + (len(used) - df + 0.5) / (df + 0.5))
            total += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(held[i]) / average)) if tf else 0
        return total

    want = {
        i: score(terms, ["quick", "brown"], i) + score(pairs, ["quick brown"], i)
        for i in terms
        if {"quick", "brown"} & set(terms[i])
    }
    found = search_messages(messages, "quick browns").collect()
    want_plain = {i: s - score(pairs, ["quick brown"], i) for i, s in want.items()}
    assert {r.message_id: round(r.score, 9) for r in found} == {i: round(s, 9) for i, s in want_plain.items()}
    found = search_messages(messages, "quick brown").collect()
    assert [r.message_id for r in found] == sorted(want, key=lambda i: (-want[i], i))
    assert {r.message_id: round(r.score, 9) for r in found} == {i: round(s, 9) for i, s in want.items()}


def test_stored_search_equals_full_search(spark, messages, tmp_path):
    index = ChatIndex(str(tmp_path / "chat"))
    index_messages(messages, index, files_per_bucket=2)
    for options in [
        dict(text="quick brown"), dict(text="run"), dict(text="the"), dict(text="quick quick fox", k=2),
        dict(text="quick brown", sender="a"), dict(text="fox", channel="#c", server="s", protocol="irc"),
    ]:
        want = [(r.message_id, round(r.score, 9)) for r in search_messages(messages, **options).collect()]
        got = search_chat_index(spark, index, **options).collect()
        assert [(r.message_id, round(r.score, 9)) for r in got] == want


def test_search_filters(messages):
    def ids(**options):
        return [r.message_id for r in search_messages(messages, **options).collect()]

    assert ids(sender="+a") == ["7", "5", "3", "1"]
    assert ids(channel="#c", k=2) == ["3", "2"]
    assert ids(server="none") == ids(protocol="discord") == ids(text="the") == []
    assert set(ids(text="run", channel="#d")) == {"7"}
    assert set(ids(text="run", k=None)) == {"2", "7"}
    assert len(ids()) == 8
