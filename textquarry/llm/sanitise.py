"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Protected entities are the values that four patterns find. A term that stands near an entity may
reveal it: with P(e|t) the share of the texts with term t in which t stands near entity e, seeing t
leaves -log2 P(e|t) bits of doubt that e is meant. Terms that leave too little doubt are generalised
to a tag, those that leave next to none are removed, wherever they occur. Contexts are told apart by
their words, so that copies of one passage are no further evidence.

Two passes read the texts: one finds entities and the terms near them, one finds where candidate terms
occur. Only terms and places are shuffled between them, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, table

KINDS = ("email", "ip", "card", "phone", "term")

#: Characters before and after an entity that are its context.
CONTEXT = 60
#: Least number of different contexts in which a term stands near an entity.
MIN_CONTEXTS = 2
#: Bits of doubt up to which a term is generalised, and removed.
GENERALISE_BITS, REMOVE_BITS = 1.0, 0.15
#: Numbers of 64 bits in the filter that candidate terms must pass before they are joined.
FILTER_WORDS = 1 << 15

_TERM = r"\p{L}{3,}"

#: Possessive, so that time is linear in the text; the look-behinds only skip starts at which no match can begin.
_PATTERNS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: A cheap condition without which a pattern is not tried.
_NEEDS = ("@", r"[0-9]\.[0-9]", r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", r"\+[0-9]")

_SPAN = "array<struct<start:int,kind:int,stop:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: int, value: Column) -> Column:
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        return F.forall(F.split(value, r"\."), lambda part: part.cast("double") <= 255)
    digits = _digits(value)
    least, most = ((12, 19), (9, 15))[kind - 2]
    return F.length(digits).between(least, most) & (F.call_function("luhn_check", digits) if kind == 2 else F.lit(True))


def _is_valid(kind: int):
    return lambda span: _valid(kind, span["value"])


def _places(text: Column, pattern: Column, kind: int) -> Column:
    """Spans of all matches: between two of them lies one piece of the text split by the pattern."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans"))

    def add(held, part):
        start = held["at"] + F.length(part["piece"])
        stop = start + F.coalesce(F.length(part["found"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), part["found"].alias("value"))
        return F.struct(stop.alias("at"), F.when(part["found"].isNull(), held["spans"]).otherwise(F.concat(held["spans"], F.array(span))).alias("spans"))

    return F.aggregate(parts, empty, add, lambda held: held["spans"])


def base_spans(text: Column) -> Column:
    """Valid matches of all four patterns by start and kind."""
    none = F.array().cast(_SPAN)
    found = []
    for kind, (pattern, needs) in enumerate(zip(_PATTERNS, _NEEDS)):
        likely = F.contains(text, F.lit(needs)) if kind == 0 else text.rlike(needs)
        spans = F.filter(_places(text, F.lit(pattern), kind), _is_valid(kind))
        found.append(F.when(likely, spans).otherwise(none))
    return F.array_sort(F.concat(*found))


def _entity(span: Column) -> Column:
    value = F.when(span["kind"] >= 2, _digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.xxhash64(span["kind"], value)


def _contexts(text: Column, spans: Column) -> Column:
    """For each span the entity, a number of its context, and the terms there."""

    def of(span):
        start = F.greatest(span["start"] - CONTEXT, F.lit(0))
        before = F.lower(F.substring(text, start + 1, span["start"] - start))
        after = F.lower(F.substring(text, span["stop"] + 1, F.lit(CONTEXT)))
        # A word that the window cuts is no term.
        before = F.when(start > 0, F.regexp_replace(before, r"^\p{L}+", "")).otherwise(before)
        after = F.when(F.length(after) == CONTEXT, F.regexp_replace(after, r"\p{L}+$", "")).otherwise(after)
        around = F.concat(before, F.lit(" "), after)
        return F.struct(_entity(span).alias("entity"), F.xxhash64(around).alias("context"), F.array_distinct(F.regexp_extract_all(around, F.lit(_TERM), F.lit(0))).alias("terms"))

    return F.transform(spans, of)


def _read(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("text_key", F.xxhash64("text"))


def find_entities(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, text_key, spans and contexts of each row."""
    rows = _read(docs, id_column, text).withColumn("spans", base_spans(F.col("text")))
    return rows.select("id", "text_key", "spans", F.when(F.size("spans") > 0, _contexts(F.col("text"), F.col("spans"))).alias("contexts"))


def candidate_terms(entities: DataFrame) -> DataFrame:
    """term, near: terms that may reveal an entity as far as contexts tell, and the contexts with it.

    A term stands in as many texts as contexts at least, so none is left out that could pass later.
    """
    seen = entities.filter("contexts IS NOT NULL").select(F.explode("contexts").alias("c")).select("c.entity", "c.context", F.explode("c.terms").alias("term")).distinct()
    near = seen.groupBy("term", "entity").agg(F.count("*").alias("near"))
    by_term = near.groupBy("term").agg(F.max("near").alias("near"), F.sum("near").alias("all"))
    return by_term.filter((F.col("near") >= MIN_CONTEXTS) & (F.col("near") >= F.col("all") * 2**-GENERALISE_BITS)).select("term", "near")


def _bit(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(FILTER_WORDS * 64))


def _filter_of(terms: DataFrame) -> DataFrame:
    """One row with an array of FILTER_WORDS numbers in which each term has set its bit."""
    spark = terms.sparkSession
    bit = _bit(F.col("term"))
    words = terms.select(F.shiftright(bit, 6).alias("word"), F.expr("1L").alias("one"), (bit % 64).cast("int").alias("place"))
    words = words.select("word", F.expr("shiftleft(one, place)").alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    every = spark.range(FILTER_WORDS).withColumnRenamed("id", "word").join(words, "word", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", F.coalesce("mask", F.lit(0).cast("long")).alias("mask")))), lambda w: w["mask"]).alias("masks"))


def find_terms(docs: DataFrame, terms: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, text_key, term and places (spans) of those terms in each row, and of some others."""
    masks = stored(_filter_of(terms), "term-filter")

    def passes(term):
        bit = _bit(term)
        return F.getbit(F.element_at(F.col("masks"), (F.shiftright(bit, 6) + 1).cast("int")), (bit % 64).cast("int")) == 1

    rows = _read(docs, id_column, text).withColumn("masks", masks.scalar())
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_TERM), F.lit(0)))
    rows = rows.withColumn("terms", F.filter(words, passes)).filter(F.size("terms") > 0).select("id", "text_key", "text", F.explode("terms").alias("term"))
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})"), F.col("term"), F.lit(r"(?!\p{L})"))
    return rows.select("id", "text_key", "term", _places(F.col("text"), pattern, 4).alias("places"))


def revealing_terms(candidates: DataFrame, places: DataFrame) -> DataFrame:
    """term and bits of doubt, of the terms that leave GENERALISE_BITS or less."""
    texts = places.groupBy("term", "text_key").agg(F.lit(1).alias("one")).groupBy("term").agg(F.count("*").alias("texts"))
    bits = -F.log2(F.col("near") / F.greatest("texts", "near"))
    return candidates.join(texts, "term").select("term", bits.alias("bits")).filter(F.col("bits") <= GENERALISE_BITS)


def find_personal_data(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, text_key, spans (base) and terms (spans with the bits of doubt) of each row.

    Starts and stops count code points. A null text counts as empty and has no spans. Repeated rows
    have equal spans; extra columns are ignored, whatever their names.
    """
    entities = stored(find_entities(docs, id_column, text), "entities")
    candidates = stored(candidate_terms(entities), "candidate-terms")
    # Candidates among the terms that pass the filter, with their places.
    places = stored(find_terms(docs, candidates, id_column, text).join(candidates.select("term"), "term", "left_semi"), "term-places")
    revealing = revealing_terms(candidates, places)
    terms = places.join(revealing, "term").select("id", "text_key", F.explode("places").alias("place"), "bits")
    terms = terms.groupBy("id", "text_key").agg(F.array_sort(F.collect_set(F.struct("place.start", "place.kind", "place.stop", "place.value", "bits"))).alias("terms"))
    terms = terms.select(F.col("id").alias("term_id"), F.col("text_key").alias("term_text_key"), "terms")
    joined = entities.join(terms, F.col("id").eqNullSafe(F.col("term_id")) & (F.col("text_key") == F.col("term_text_key")), "left")
    return joined.select("id", "text_key", "spans", F.coalesce("terms", F.array().cast(terms.schema["terms"].dataType)).alias("terms"))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")


def sanitise(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id and sanitised text of each row: entities and generalised terms become tags, others go."""
    found = find_personal_data(docs, id_column, text).dropDuplicates(["id", "text_key"]).select(F.col("id").alias("found_id"), F.col("text_key").alias("found_key"), "spans", "terms")
    rows = _read(docs, id_column, text).join(found, F.col("id").eqNullSafe(F.col("found_id")) & (F.col("text_key") == F.col("found_key")))
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    base = F.transform("spans", lambda s: F.struct(s["start"], (-s["stop"]).alias("long_first"), s["stop"], F.element_at(tags, s["kind"] + 1).alias("tag")))
    terms = F.transform("terms", lambda s: F.struct(s["start"], (-s["stop"]).alias("long_first"), s["stop"], F.when(s["bits"] <= REMOVE_BITS, "").otherwise(tags[4]).alias("tag")))
    spans = F.array_sort(F.concat(base, terms))
    body = F.col("text")

    def add(held, span):
        piece = F.concat(held["out"], F.substring(body, held["at"] + 1, span["start"] - held["at"]), span["tag"])
        new = F.struct(span["stop"].alias("at"), piece.alias("out"))
        inside = F.struct(F.greatest(held["at"], span["stop"]).alias("at"), held["out"].alias("out"))
        return F.when(span["start"] >= held["at"], new).otherwise(inside)

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return rows.select("id", F.aggregate(spans, start, add, lambda held: F.concat(held["out"], F.substring(body, held["at"] + 1, F.length(body)))).alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    every = F.array_sort(F.concat("spans", F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), s["value"].alias("value")))))
    return found.select(F.col("id").alias("doc_id"), *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)], F.sha2(_written(F.col("spans")), 256).alias("base_sha256"), _written(every).alias("spans"))
