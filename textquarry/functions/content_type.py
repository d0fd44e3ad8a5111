"""Content type of a file, guessed from its first 512 bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SNIFF_BYTES = 512

# Tag names and byte signatures of the WHATWG MIME sniffing standard, in
# the order in which they are tried. Each signature is a regular expression over the
# bytes read as ISO-8859-1; "." is any byte.
HTML_TAGS = [
    "!DOCTYPE HTML", "HTML", "HEAD", "SCRIPT", "IFRAME", "H1", "DIV", "FONT", "TABLE",
    "A", "STYLE", "TITLE", "B", "BODY", "BR", "P", "!--",
]
SIGNATURES = [
    (r"[\t\n\f\r ]*<\?xml", "text/xml; charset=utf-8"),
    (r"%PDF-", "application/pdf"),
    (r"%!PS-Adobe-", "application/postscript"),
    (r"\xFE\xFF..", "text/plain; charset=utf-16be"),
    (r"\xFF\xFE..", "text/plain; charset=utf-16le"),
    (r"\xEF\xBB\xBF.", "text/plain; charset=utf-8"),
    (r"GIF87a", "image/gif"),
    (r"GIF89a", "image/gif"),
    (r"\x89PNG\x0D\x0A\x1A\x0A", "image/png"),
    (r"\xFF\xD8\xFF", "image/jpeg"),
    (r"BM", "image/bmp"),
    (r"RIFF....WEBPVP", "image/webp"),
    (r"\x00\x00\x01\x00", "image/vnd.microsoft.icon"),
    (r"RIFF....WAVE", "audio/wave"),
    (r"FORM....AIFF", "audio/aiff"),
    (r"\.snd", "audio/basic"),
    (r"OggS\x00", "application/ogg"),
    (r"MThd\x00\x00\x00\x06", "audio/midi"),
    (r"ID3", "audio/mpeg"),
    (r"RIFF....AVI ", "video/avi"),
    (r".{34}LP", "application/vnd.ms-fontobject"),
    (r"\x00\x01\x00\x00", "font/ttf"),
    (r"OTTO", "font/otf"),
    (r"ttcf", "font/collection"),
    (r"wOFF", "font/woff"),
    (r"wOF2", "font/woff2"),
    (r"\x1A\x45\xDF\xA3", "video/webm"),
    (r"Rar \x1A\x07\x00", "application/x-rar-compressed"),
    (r"PK\x03\x04", "application/zip"),
    (r"\x1F\x8B\x08", "application/x-gzip"),
]
HTML = "text/html; charset=utf-8"
MP4 = "video/mp4"
TEXT = "text/plain; charset=utf-8"
UNKNOWN = "application/octet-stream"
CONTROL_BYTES = r"[\x00-\x08\x0B\x0E-\x1A\x1C-\x1F]"


def content_type(content: Column) -> Column:
    """MIME type of a BINARY column."""
    head = F.substring(content, 1, SNIFF_BYTES)
    chars = F.decode(head, "ISO-8859-1")
    html = r"(?i)\A[\t\n\f\r ]*<(?:" + "|".join(HTML_TAGS) + ")[ >]"
    out = F.when(chars.rlike(html), F.lit(HTML))
    for signature, name in SIGNATURES:
        out = out.when(chars.rlike(r"(?s)\A" + signature), F.lit(name))
    out = out.when(_is_mp4(head, chars), F.lit(MP4))
    return out.when(~chars.rlike(CONTROL_BYTES), F.lit(TEXT)).otherwise(F.lit(UNKNOWN))


def _is_mp4(head: Column, chars: Column) -> Column:
    """A leading ``ftyp`` box, complete and a multiple of four long, that names an
    ``mp4`` brand in one of its words, the version word left out."""
    size = F.conv(F.hex(F.substring(head, 1, 4)), 16, 10).cast("bigint")
    complete = (F.length(head) >= 12) & (size % 4 == 0) & (F.length(head) >= size)
    box = F.substr(chars, F.lit(1), size.cast("int"))
    return (
        chars.rlike(r"(?s)\A.{4}ftyp")
        & complete
        & box.rlike(r"(?s)\A.{8}(?:mp4|.{8}(?:.{4})*?mp4)")
    )
