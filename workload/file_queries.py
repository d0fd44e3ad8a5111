"""File filters, document ids, paths, content types, archives and table maintenance."""

from __future__ import annotations

import io
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import functions as F

from textquarry.functions.paths import path_tokens, under
from textquarry.layout import durable_dir
from textquarry.operators.documents import to_documents
from textquarry.operators.filters import (
    bool_filter,
    content_type_profile,
    drop_reason,
    hit_fields,
    index_stats,
    match_all,
    match_none,
    term,
)
from textquarry.operators.grep import grep
from textquarry.operators.maintenance import (
    append,
    bulk_lines,
    create_index,
    delete_summary,
    delete_under,
    drop_missing,
    upsert,
    with_fresh_ids,
    write_documents,
)
from textquarry.plans.index_corpus import files_with_reason
from textquarry.sources.archives import FILES_SCHEMA, expand_archives
from textquarry.streaming.stream_index import current_documents, stream_index
from workload.grep_queries import lines_sql
from workload.tables import documents, page_files, table

PREFIX = "/blog.tionsh.example.net"
TREE_PATTERN = "e[nr]t[.,]"

# File paths for documents, some in ignored directories or with an ignored name.
PATH_SQL = """
    '/corpus/' || CASE lang WHEN 'de' THEN '.git/' WHEN 'es' THEN 'sub/__MACOSX/' ELSE 'x.git/' END
    || source || '/' || CASE source WHEN 'src3' THEN '.DS_Store' ELSE doc_id || '.txt' END
"""


def _files(spark, sf_dir):
    """Documents as files: text is content, two sources are special or binary."""
    docs = documents(spark, sf_dir, "doc_id", "source", "lang", "text")
    nul = F.when(F.col("source") == "src7", F.lit("\0")).otherwise("")
    directory = (
        F.when(F.col("lang") == "de", ".git/").when(F.col("lang") == "es", "sub/__MACOSX/")
    ).otherwise("x.git/")
    name = F.when(F.col("source") == "src3", ".DS_Store").otherwise(
        F.concat(F.col("doc_id"), F.lit(".txt"))
    )
    return docs.select(
        "doc_id",
        F.concat(F.lit("/corpus/"), directory, "source", F.lit("/"), name).alias("path"),
        F.concat(nul, "text").cast("binary").alias("content"),
        F.when(F.col("source") == "src5", "symlink").otherwise("file").alias("kind"),
    ).withColumn("length", F.octet_length("content"))


def _with_reason(spark, sf_dir):
    reason = drop_reason(
        F.col("path"), F.col("length"), F.col("content"), F.col("kind"), 3000, "/corpus"
    )
    return _files(spark, sf_dir).select("doc_id", "path", reason.alias("drop_reason"))


_REASON_SQL = f"""
    SELECT doc_id, {PATH_SQL} AS path,
           CASE WHEN source = 'src5' THEN 'special'
                WHEN lang IN ('de', 'es') OR source = 'src3' THEN 'name'
                WHEN octet_length(encode(text)) + CASE source WHEN 'src7' THEN 1 ELSE 0 END > 3000
                    THEN 'size'
                WHEN source = 'src7' THEN 'binary' END AS drop_reason
    FROM documents
"""


def _document_ids(spark, sf_dir):
    files = table(spark, sf_dir, "pages", "url", "html").select(
        F.regexp_replace("url", "^https?:/", "").alias("path"),
        F.col("html").cast("binary").alias("content"),
        F.lit(None).cast("timestamp").alias("modificationTime"),
    )
    return to_documents(files).select("doc_id", "name", "path", F.length("data").alias("n_chars"))


def _path_tokens(spark, sf_dir):
    pages = page_files(spark, sf_dir)
    tokens = pages.select("page_id", F.explode_outer(path_tokens(F.col("path"))).alias("token"))
    tokens = tokens.where(F.col("token").isNotNull())
    return tokens.groupBy("token").agg(F.count("*").alias("n_pages"))


def _delete_under(spark, sf_dir):
    return delete_under(page_files(spark, sf_dir), PREFIX).select("page_id", "path")


def _delete_summary(spark, sf_dir):
    pages = page_files(spark, sf_dir)
    return delete_summary(pages, under(F.col("path"), PREFIX))


def _content_types(spark, sf_dir):
    pages = table(spark, sf_dir, "pages", "html")
    return content_type_profile(pages.select(F.col("html").cast("binary").alias("content")))


# First bytes given to the documents of some sources, and the type they must get.
SIGNATURES = {
    "src0": ("25504446 2D", "application/pdf"),
    "src1": ("474946383961", "image/gif"),
    "src2": ("52494646 00000000 57454250 5650", "image/webp"),
    "src3": ("504B0304", "application/zip"),
    "src4": ("1F8B08", "application/x-gzip"),
    "src5": ("20090A 3C68746D6C3E", "text/html; charset=utf-8"),
    "src6": ("FEFF", "text/plain; charset=utf-16be"),
    "src7": ("00", "application/octet-stream"),
    "src8": ("00000018 66747970 69736F6D 00000200 6D703431 69736F6D", "video/mp4"),
    "src9": ("0000000C 66747970 69736F6D", "application/octet-stream"),
    "src10": ("EFBBBF", "text/plain; charset=utf-8"),
    "src11": ("0A 3C3F786D6C 20", "text/xml; charset=utf-8"),
}


def _signatures(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "source", "text")
    head = F.lit("")
    for source, (bytes_hex, _) in SIGNATURES.items():
        head = F.when(F.col("source") == source, bytes_hex.replace(" ", "")).otherwise(head)
    content = F.concat(F.unhex(head), F.col("text").cast("binary"))
    return content_type_profile(docs.select(content.alias("content")))


_SIGNATURE_CASES = " ".join(
    f"WHEN source = '{source}' THEN '{kind}'" for source, (_, kind) in SIGNATURES.items()
)
_SIGNATURE_BYTES = " ".join(
    f"WHEN '{source}' THEN {len(head.replace(' ', '')) // 2}"
    for source, (head, _) in SIGNATURES.items()
)


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts as ZIP, TAR, gzip and ZIP-in-ZIP files, by language."""
    for batch in batches:
        rows = []
        for row in batch.itertuples(index=False):
            body, name = row.text.encode(), f"{row.doc_id}.txt"
            if row.lang == "fr":
                content = _zipped({f"a/{name}": body, f"b/{name}": body})
            elif row.lang == "de":
                content = _zipped({"in.zip": _zipped({name: body})})
            elif row.lang == "es":
                out = io.BytesIO()
                with tarfile.open(fileobj=out, mode="w") as archive:
                    info = tarfile.TarInfo(name)
                    info.size = len(body)
                    archive.addfile(info, io.BytesIO(body))
                content = out.getvalue()
            else:
                press = zlib.compressobj(wbits=31)
                content = press.compress(body) + press.flush()
            rows.append((f"/packed/{row.doc_id}", None, len(content), content, "file", None, None))
        names = "path modificationTime length content kind container entry_path".split()
        yield pd.DataFrame(rows, columns=names).astype({"modificationTime": "datetime64[us]"})


def _zipped(members: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, body in members.items():
            archive.writestr(name, body)
    return out.getvalue()


def _archive_members(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "lang", "text")
    members = to_documents(expand_archives(docs.mapInPandas(_pack, FILES_SCHEMA)))
    return members.select("doc_id", "path", "name", "display", F.sha2("data", 256).alias("body"))


def _missing_archives(mode: str):
    """The French files are gone from the listing: their members go, all others stay."""

    def query(spark, sf_dir):
        docs = documents(spark, sf_dir, "doc_id", "lang", "text")
        index = to_documents(expand_archives(docs.mapInPandas(_pack, FILES_SCHEMA)))
        path = F.concat(F.lit("/packed/"), "doc_id").alias("path")
        listing = table(spark, sf_dir, "documents", "doc_id", "lang").where("lang <> 'fr'").select(path)
        left = drop_missing(index, listing, mode)
        return left.select("doc_id", "path", "name", "display", F.sha2("data", 256).alias("body"))

    return query


def _write_archives(folder: str):
    """Documents as members of ZIP files of over 10 MiB, 300 in each, beside hidden and
    empty files."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, inside = fs.FileSystem.from_uri(folder)
        files.create_dir(f"{inside}/pkg")
        for batch in batches:
            for at in range(0, len(batch), 300):
                part = batch.iloc[at : at + 300]
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                    pad = zipfile.ZipInfo("pad")
                    archive.writestr(pad, bytes(11 << 20), zipfile.ZIP_STORED)
                    for row in part.itertuples(index=False):
                        archive.writestr(f"a/{row.doc_id}", row.text)
                first = part["doc_id"].iloc[0]
                for name, body in ((f".h{first}.zip", out.getvalue()), (f"pkg/_{first}.py", b"")):
                    with files.open_output_stream(f"{inside}/{name}") as file:
                        file.write(body)
                yield part[["doc_id"]]

    return write


def _scan_archives(spark, sf_dir):
    """Archives in a tree: every member is found, and every hidden or empty file."""
    tree = durable_dir(spark, "archives")
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    docs.mapInPandas(_write_archives(tree), "doc_id bigint").write.format("noop").mode("overwrite").save()
    files = files_with_reason(spark, tree).where(F.col("drop_reason").isNull())
    members = to_documents(files.where(F.col("container").isNotNull()))
    return members.select(F.col("name").cast("bigint").alias("doc_id"), F.sha2("data", 256).alias("body"))


def _scan_tree(spark, sf_dir):
    """Documents written as text files, then scanned, filtered and searched."""
    tree = durable_dir(spark, "tree")
    docs = documents(spark, sf_dir, "doc_id", "lang", "text")
    docs.select("lang", "text").write.partitionBy("lang").option("maxRecordsPerFile", 100).text(tree)
    files = files_with_reason(spark, tree)
    found = grep(
        to_documents(files.where(F.col("drop_reason").isNull())), TREE_PATTERN, keep=("path",)
    )
    lang = F.regexp_extract("path", "lang=([a-z]+)", 1)
    return found.groupBy(lang.alias("lang")).agg(F.count("*").alias("n_lines"))


def _stream_index(spark, sf_dir):
    """Documents read as a stream into a log, read twice to show that a restart adds
    nothing, then the latest version of each."""
    place = durable_dir(spark, "stream")
    table_path, checkpoint = f"{place}/documents", f"{place}/checkpoint"
    schema = table(spark, sf_dir, "documents").schema

    def to_docs(batch):
        return batch.select("doc_id", "lang", F.col("text").alias("data"))

    for _ in range(2):
        source = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents*.parquet")
        stream_index(source, table_path, checkpoint, to_docs).awaitTermination()
    current = current_documents(spark.read.parquet(table_path))
    return current.groupBy("lang").agg(
        F.count("*").alias("n_docs"), F.sum(F.length("data")).alias("n_chars")
    )


def _bulk(spark, sf_dir):
    pages = table(spark, sf_dir, "pages", "url", "html").select(
        F.sha2("url", 256).alias("doc_id"), F.col("html").alias("data"), F.col("url").alias("name")
    )
    return bulk_lines(pages, ["data", "name"], "doc_id")


def _upsert(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "text")
    french = docs.where(F.col("lang") == "fr")
    # Not upper(): Java makes "SS" of "ß", the SQL engine keeps it.
    first = french.withColumns({"text": F.concat(F.lit("first "), "text"), "sequence": F.lit(1)})
    second = french.where(F.length("text") > 500).withColumns(
        {"text": F.concat(F.lit("second "), "text"), "sequence": F.lit(2)}
    )
    fresh = docs.where(F.col("lang") == "de").withColumns(
        {"doc_id": F.col("doc_id") + 10_000_000, "sequence": F.lit(1)}
    )
    changes = first.unionByName(second).unionByName(fresh)
    return upsert(docs, changes, "doc_id", "sequence")


def _append_twice(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn")
    twice = with_fresh_ids(rows.unionByName(rows))
    return twice.groupBy("conv_id", "turn").agg(
        F.count("*").alias("n_rows"), F.count_distinct("message_id").alias("n_ids")
    )


def _create_and_append(spark, sf_dir):
    """A table is created, loaded, and created again, which must leave it alone."""
    path = durable_dir(spark, "messages")
    schema = "conv_id bigint, turn bigint, role string, text string, message_id string"
    create_index(spark, path, schema)
    append(table(spark, sf_dir, "conversations"), path)
    create_index(spark, path, schema)
    stored = spark.read.parquet(path)
    return stored.groupBy("role").agg(
        F.count("*").alias("n_rows"), F.count_distinct("message_id").alias("n_ids")
    )


def _write_documents(spark, sf_dir):
    """Documents stored in files of at most 100 rows, and read back."""
    path = durable_dir(spark, "documents")
    write_documents(documents(spark, sf_dir, "doc_id", "lang", "text"), path, records_per_file=100)
    stored = spark.read.parquet(path).withColumn("file", F.col("_metadata.file_path"))
    per_file = stored.groupBy("file").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c"))
    return per_file.agg(
        F.sum("n").alias("n_docs"), F.sum("c").alias("n_chars"), (F.max("n") <= 100).alias("bounded")
    )


def _missing(mode: str):
    def query(spark, sf_dir):
        index = page_files(spark, sf_dir).select(
            F.col("page_id").alias("doc_id"),
            F.regexp_replace("path", "/[^/]*$", "").alias("path"),
            "url",
        )
        listing = index.where(~F.col("url").contains("ref=x"))
        return drop_missing(index, listing, mode).select("doc_id", "path")

    return query


def _term(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "source")
    return docs.where(term(F.col("lang"), "de")).select("doc_id", "source")


def _bool(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "source", "n_chars")
    should = [
        F.col("source") == "src1",
        F.col("n_chars") > 2000,
        F.col("source").isin("src1", "src2", "src4"),
    ]
    return docs.where(bool_filter([F.col("lang") != "fr"], should, 2)).select("doc_id", "source")


def _constants(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id")
    every = docs.where(match_all() & bool_filter()).agg(F.count("*").alias("n_docs"))
    none = docs.where(match_none()).agg(F.count("*").alias("n_docs"))
    return every.withColumn("condition", F.lit("all")).unionByName(
        none.withColumn("condition", F.lit("none"))
    )


def _hits(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "source", "text").select(
        "doc_id", F.col("source").alias("name"), F.col("lang").alias("path"), "text"
    )
    return hit_fields(docs.where(F.col("text").contains("the the")))


QUERIES = {
    "drop_reasons": _with_reason,
    "index_stats": lambda spark, sf_dir: index_stats(_with_reason(spark, sf_dir)),
    "document_ids": _document_ids,
    "path_tokens": _path_tokens,
    "delete_under": _delete_under,
    "delete_summary": _delete_summary,
    "content_types": _content_types,
    "content_type_signatures": _signatures,
    "archive_members": _archive_members,
    "scan_tree_and_grep": _scan_tree,
    "scan_large_archives": _scan_archives,
    "missing_archives": _missing_archives("file"),
    "missing_archive_directories": _missing_archives("directory"),
    "stream_index": _stream_index,
    "bulk_lines": _bulk,
    "write_documents": _write_documents,
    "create_and_append": _create_and_append,
    "upsert_documents": _upsert,
    "append_twice": _append_twice,
    "drop_missing_files": _missing("file"),
    "drop_missing_directories": _missing("directory"),
    "term_filter": _term,
    "bool_filter": _bool,
    "constant_filters": _constants,
    "hit_fields": _hits,
}

_PAGE_PATH = "regexp_replace(url, '^https?:/', '')"
_PAGES = f"SELECT page_id, url, {_PAGE_PATH} AS path FROM pages"
_PAGE_DIRS = f"""
    SELECT page_id AS doc_id, regexp_replace({_PAGE_PATH}, '/[^/]*$', '') AS path,
           contains(url, 'ref=x') AS gone
    FROM pages
"""


def _member_sql(where: str, full_name: str, path: str, name: str, display: str) -> str:
    return f"""
        SELECT sha256({full_name}) AS doc_id, {path} AS path, {name} AS name,
               {display} AS display, sha256(text) AS body
        FROM documents WHERE {where}
    """


_FILE = "'/packed/' || doc_id"
_NAME = "doc_id || '.txt'"
_NUL = "chr(0) || '/'"

ORACLE = {
    "drop_reasons": _REASON_SQL,
    "index_stats": f"""
        SELECT count(*) FILTER (WHERE drop_reason IS NULL) AS indexed,
               count(drop_reason) AS skipped
        FROM ({_REASON_SQL})
    """,
    "document_ids": f"""
        SELECT sha256(path) AS doc_id, regexp_extract(path, '[^/]*$') AS name,
               regexp_replace(path, '/[^/]*$', '') AS path,
               CAST(length(html) AS INTEGER) AS n_chars
        FROM (SELECT {_PAGE_PATH} AS path, html FROM pages)
    """,
    "path_tokens": f"""
        SELECT token, count(*) AS n_pages
        FROM (SELECT unnest(list_transform(generate_series(1, len(parts)),
                  lambda i: array_to_string(parts[1:i], '/'))) AS token
              FROM (SELECT string_split(path, '/') AS parts FROM ({_PAGES})))
        WHERE token <> '' GROUP BY token
    """,
    "delete_under": f"""
        SELECT page_id, path FROM ({_PAGES})
        WHERE NOT (path = '{PREFIX}' OR starts_with(path, '{PREFIX}/'))
    """,
    "delete_summary": f"""
        SELECT count(*) AS total, count(*) AS deleted FROM ({_PAGES})
        WHERE path = '{PREFIX}' OR starts_with(path, '{PREFIX}/')
    """,
    "content_types": r"""
        SELECT CASE WHEN regexp_matches(html, '^[\t\n\f\r ]*<(!DOCTYPE HTML|HTML)[ >]', 'i')
                    THEN 'text/html; charset=utf-8' ELSE 'text/plain; charset=utf-8'
               END AS content_type,
               count(*) AS files, CAST(sum(octet_length(encode(html))) AS BIGINT) AS bytes
        FROM pages GROUP BY 1
    """,
    "content_type_signatures": rf"""
        SELECT CASE {_SIGNATURE_CASES}
                    WHEN regexp_matches(text, '^[\t\n\f\r ]*<(?:!DOCTYPE HTML|HTML|HEAD|SCRIPT|IFRAME|H1|DIV|FONT|TABLE|A|STYLE|TITLE|B|BODY|BR|P|!--)[ >]', 'i')
                        THEN 'text/html; charset=utf-8'
                    WHEN starts_with(text, 'BM') THEN 'image/bmp'
                    WHEN starts_with(text, 'ID3') THEN 'audio/mpeg'
                    WHEN regexp_matches(substr(hex(encode(text)), 1, 1024),
                                        '^(?:..)*(?:0[0-8BEF]|1[0-9ACDEF])')
                        THEN 'application/octet-stream'
                    ELSE 'text/plain; charset=utf-8' END AS content_type,
               count(*) AS files,
               CAST(sum(octet_length(encode(text))
                   + CASE source {_SIGNATURE_BYTES} ELSE 0 END) AS BIGINT) AS bytes
        FROM documents GROUP BY 1
    """,
    "archive_members": " UNION ALL ".join(
        [
            *[
                _member_sql(
                    "lang = 'fr'",
                    f"{_FILE} || {_NUL} || '{d}/' || {_NAME}",
                    f"{_FILE} || '/{d}'",
                    _NAME,
                    f"{_FILE} || ' -> /{d}/' || {_NAME}",
                )
                for d in "ab"
            ],
            _member_sql(
                "lang = 'de'",
                f"{_FILE} || {_NUL} || 'in.zip' || {_NUL} || {_NAME}",
                f"{_FILE} || '/in.zip'",
                _NAME,
                f"{_FILE} || ' -> /in.zip -> /' || {_NAME}",
            ),
            _member_sql(
                "lang = 'es'",
                f"{_FILE} || {_NUL} || {_NAME}",
                _FILE,
                _NAME,
                f"{_FILE} || ' -> /' || {_NAME}",
            ),
            _member_sql(
                "lang NOT IN ('fr', 'de', 'es')",
                _FILE,
                "'/packed'",
                "CAST(doc_id AS VARCHAR)",
                _FILE,
            ),
        ]
    ),
    "scan_tree_and_grep": f"""
        SELECT lang, count(*) AS n_lines FROM ({lines_sql("lang")})
        WHERE regexp_matches(line, '{TREE_PATTERN}') GROUP BY lang
    """,
    "stream_index": """
        SELECT lang, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars
        FROM documents GROUP BY lang
    """,
    "bulk_lines": """
        SELECT '{"index":{"_id":"' || sha256(url) || '"}}' AS value FROM pages
        UNION ALL
        SELECT CAST(to_json({'data': html, 'name': url}) AS VARCHAR) AS value FROM pages
    """,
    "write_documents": """
        SELECT count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars, true AS bounded
        FROM documents
    """,
    "create_and_append": """
        SELECT role, count(*) AS n_rows, count(*) AS n_ids FROM conversations GROUP BY role
    """,
    "upsert_documents": """
        SELECT doc_id, lang,
               CASE WHEN lang <> 'fr' THEN text
                    WHEN length(text) > 500 THEN 'second ' || text
                    ELSE 'first ' || text END AS text
        FROM documents
        UNION ALL
        SELECT doc_id + 10000000 AS doc_id, lang, text FROM documents WHERE lang = 'de'
    """,
    "append_twice": """
        SELECT conv_id, turn, CAST(2 AS BIGINT) AS n_rows, CAST(2 AS BIGINT) AS n_ids
        FROM conversations
    """,
    "drop_missing_files": f"SELECT doc_id, path FROM ({_PAGE_DIRS}) WHERE NOT gone",
    "drop_missing_directories": f"""
        WITH files AS ({_PAGE_DIRS}), gone AS (SELECT DISTINCT path FROM files WHERE gone)
        SELECT doc_id, path FROM files
        WHERE NOT EXISTS (SELECT 1 FROM gone WHERE files.path = gone.path
                                               OR starts_with(files.path, gone.path || '/'))
    """,
    "term_filter": "SELECT doc_id, source FROM documents WHERE lang = 'de'",
    "bool_filter": """
        SELECT doc_id, source FROM documents
        WHERE lang <> 'fr'
          AND CAST(source = 'src1' AS INTEGER) + CAST(n_chars > 2000 AS INTEGER)
              + CAST(source IN ('src1', 'src2', 'src4') AS INTEGER) >= 2
    """,
    "constant_filters": """
        SELECT count(*) AS n_docs, 'all' AS condition FROM documents
        UNION ALL SELECT count(*) AS n_docs, 'none' AS condition FROM documents WHERE false
    """,
    "hit_fields": """
        SELECT doc_id, source AS name, lang AS path FROM documents
        WHERE contains(text, 'the the')
    """,
}

_LEFT = f"SELECT * FROM ({ORACLE['archive_members']}) WHERE path NOT IN (SELECT {_FILE} || d FROM documents, (VALUES ('/a'), ('/b')) v(d) WHERE lang = 'fr')"
ORACLE["missing_archives"] = ORACLE["missing_archive_directories"] = _LEFT
ORACLE["scan_large_archives"] = "SELECT doc_id, sha256(text) AS body FROM documents"
