"""Line search over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from textquarry.operators.grep import format_matches, grep, grep_files, search_summary
from workload.tables import documents

LITERAL = "thre+a[nt]"
IGNORE_CASE = "ÉLLE|STRASSE|Keit"
BOUNDARY = r"\b[A-Z]\w+tion\b.*\bou\b"
ANCHORS = r"\A(?:The|Le|In|Es) |on\.\z"
CLASSES = r"[[:upper:]][^[:space:]]*ß|\p{Lu}[^\PLa-z]{2,}|\d{3,}[^\D5]"
NESTED = "^(?:[a-zß-ÿ]+[ ,]*)+of(?: [a-z]+)*$|(?:ou|eau)+x"
RARE = "x[aeiou]{2,}[a-zé]*x"
FLAGS = "(?i)the(?-i: [A-Z])|(?s:b.e) Y"


def lines_sql(*columns: str) -> str:
    """Numbered lines of all documents; a final newline starts no line."""
    names = "".join(f"{c}, " for c in columns)
    return f"""
        SELECT {names}line_no, line, line_no = n_parts AS ends_text
        FROM (SELECT {names}len(parts) AS n_parts,
                     CAST(unnest(generate_series(1, len(parts))) AS INTEGER) AS line_no,
                     unnest(parts) AS line
              FROM (SELECT *, string_split(text, chr(10)) AS parts FROM documents))
        WHERE NOT (line_no = n_parts AND line = '')
    """


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _grep_sql(pattern: str, options: str = "") -> str:
    more = f", '{options}'" if options else ""
    return f"""
        SELECT doc_id, line_no, line FROM ({lines_sql("doc_id")})
        WHERE regexp_matches(line, {_quoted(pattern)}{more})
    """


def _grep(pattern: str, **options):
    def query(spark, sf_dir):
        docs = documents(spark, sf_dir)
        return grep(docs, pattern, text="text", keep=("doc_id",), **options)

    return query


def _files(pattern: str, **options):
    def query(spark, sf_dir):
        return grep_files(documents(spark, sf_dir), pattern, text="text", keep=("doc_id",), **options)

    return query


def _formatted(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "source", "lang", "text").withColumn(
        "name", F.concat_ws("/", "source", "lang", "doc_id")
    )
    found = grep(docs, LITERAL, text="text", keep=("doc_id", "name"))
    return format_matches(found, names=True, numbers=True).select("doc_id", "line_no", "printed")


def _summary(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return search_summary(docs, grep(docs, LITERAL, text="text", keep=("doc_id",)))


QUERIES = {
    "grep_lines": _grep(LITERAL),
    "grep_ignore_case": _grep(IGNORE_CASE, ignore_case=True),
    "grep_word_boundary": _grep(BOUNDARY),
    "grep_text_anchors": _grep(ANCHORS),
    "grep_classes": _grep(CLASSES),
    "grep_inline_flags": _grep(FLAGS),
    "grep_nested_repeats": _grep(NESTED),
    "grep_re2_engine": _grep(BOUNDARY, engine="re2"),
    "grep_files": _files(RARE),
    "grep_files_by_line": _files(r"[^a-zA-Z ]*\bof [^.]*, [^.]*\bof"),
    "grep_formatted": _formatted,
    "grep_summary": _summary,
}

ORACLE = {
    "grep_lines": _grep_sql(LITERAL),
    "grep_ignore_case": _grep_sql(IGNORE_CASE, "i"),
    "grep_word_boundary": _grep_sql(BOUNDARY),
    "grep_text_anchors": f"""
        SELECT doc_id, line_no, line FROM ({lines_sql("doc_id")})
        WHERE (line_no = 1 AND regexp_matches(line, '^(?:The|Le|In|Es) '))
           OR (ends_text AND regexp_matches(line, 'on\\.$'))
    """,
    "grep_classes": _grep_sql(CLASSES),
    "grep_inline_flags": _grep_sql(FLAGS),
    "grep_nested_repeats": _grep_sql(NESTED),
    "grep_re2_engine": _grep_sql(BOUNDARY),
    "grep_files": f"SELECT DISTINCT doc_id FROM ({_grep_sql(RARE)})",
    "grep_files_by_line": f"""
        SELECT DISTINCT doc_id FROM ({_grep_sql(r"[^a-zA-Z ]*\bof [^.]*, [^.]*\bof")})
    """,
    "grep_formatted": f"""
        SELECT doc_id, line_no,
               source || '/' || lang || '/' || doc_id || ':' || line_no || ':' || line AS printed
        FROM ({lines_sql("doc_id", "source", "lang")})
        WHERE regexp_matches(line, {_quoted(LITERAL)})
    """,
    "grep_summary": f"""
        SELECT (SELECT count(*) FROM documents) AS candidates,
               count(DISTINCT doc_id) AS matched_files
        FROM ({_grep_sql(LITERAL)})
    """,
}
