"""Column functions on text, hashes, dates and sizes. All of them are native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_front_matter(text) -> Column:
    """Text without a leading YAML front matter (``---`` up to the next line that begins with ``---``); null stays null."""
    return F.regexp_replace(_c(text), r"(?s)\A\s*---.*?\n---[^\n]*(\n|\z)\s*", "")


def asciidoc_fences(text) -> Column:
    """Listing delimiters (lines of four or more hyphens) as bare code fences."""
    return F.regexp_replace(_c(text), r"(?m)^[ \t]*-{4,}[ \t]*$", "```")


def repair_hyphens(text) -> Column:
    """Join words cut by a hyphen at a line end before a lower-case letter."""
    return F.regexp_replace(_c(text), r"-\s+(?=[a-z])", "")


def json_escape(text) -> Column:
    """Escape backslash, quote, newline, carriage return and tab, nothing else."""
    out = _c(text)
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def xml_attribute(text) -> Column:
    """Escape for use in a double-quoted attribute."""
    out = _c(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def safe_file_name(name, most: int = 120) -> Column:
    """Everything but ASCII letters and digits becomes ``_``; at most ``most`` characters."""
    return F.left(F.regexp_replace(_c(name), "[^a-zA-Z0-9]", "_"), F.lit(most))


def heading_prefix(level, title) -> Column:
    """``## Title`` for level 2; null if the title is null."""
    return F.concat(F.repeat(F.lit("#"), _c(level)), F.lit(" "), _c(title))


def path_string(path) -> Column:
    """Heading path joined by `` > ``."""
    return F.array_join(_c(path), " > ")


def file_name(path) -> Column:
    """Last segment of a path."""
    return F.element_at(F.split(_c(path), "/"), -1)


def extension(path) -> Column:
    """Lower-case extension of a path without its dot, query or fragment; empty if there is none."""
    last = F.regexp_replace(file_name(path), r"[?#].*$", "")
    return F.lower(F.regexp_extract(last, r"\.([A-Za-z0-9]+)$", 1))


def excerpt(text, most: int = 200) -> Column:
    """The first ``most`` characters."""
    return F.substring(_c(text), 1, most)


def content_hash(text) -> Column:
    """SHA-256 in hex of the text's UTF-8 bytes."""
    return F.sha2(_c(text), 256)


def http_date_ms(value) -> Column:
    """HTTP date to epoch milliseconds, 0 where it is null or not a date; the weekday is not looked at."""
    bare = F.regexp_replace(_c(value), r"^[A-Za-z]{3,9},\s*", "")
    return F.coalesce(F.unix_millis(F.try_to_timestamp(bare, F.lit("dd MMM yyyy HH:mm:ss zzz"))), F.lit(0).cast("bigint"))


def iso_utc(ms) -> Column:
    """Epoch milliseconds as ISO 8601 in UTC with seconds."""
    return F.date_format(F.timestamp_millis(_c(ms)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def human_size(size) -> Column:
    """Bytes as ``B``, ``KB`` or ``MB`` by whole division."""
    s = _c(size)
    kb, mb = F.floor(s / 1024).cast("bigint").cast("string"), F.floor(s / (1024 * 1024)).cast("bigint").cast("string")
    return F.when(s < 1024, F.concat(s.cast("string"), F.lit(" B"))).when(s < 1024 * 1024, F.concat(kb, F.lit(" KB"))).otherwise(F.concat(mb, F.lit(" MB")))


def is_binary(content, first: int = 8192) -> Column:
    """Is there a NUL byte among the first bytes?"""
    return F.locate("00", F.regexp_replace(F.hex(F.substring(_c(content), 1, first)), "(..)", "$1 ")) > 0


def printable_runs(content, least: int = 4) -> Column:
    """Runs of at least ``least`` printable ASCII characters (tab and line ends count), joined by newlines."""
    text = F.decode(_c(content), "ISO-8859-1")
    return F.array_join(F.regexp_extract_all(text, F.lit(r"[\x20-\x7E\t\n\r]{%d,}" % least), F.lit(0)), "\n")


def font_size_class(size, mode) -> Column:
    """Class of a font size by its ratio to the body size."""
    r = _c(size) / _c(mode)
    out = F.when(r < 0.6, "xx-small").when(r < 0.75, "x-small").when(r < 0.9, "small").when(r < 1.1, "medium")
    return out.when(r < 1.35, "large").when(r < 1.7, "x-large").otherwise("xx-large")


def plain_token_count(text) -> Column:
    """Number of pieces between white space, as a rough token count."""
    return F.size(F.split(_c(text), r"\s+"))


def to_long(value) -> Column:
    """Lenient whole number: null where the value is not numeric."""
    return _c(value).try_cast("bigint")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a, b) -> Column:
    """Cosine of two numeric arrays of the same length; null where one of them has no length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


def hit(source_name, content, expected_sources, phrases) -> Column:
    """Is a result relevant? With phrases: one of them occurs in it (case ignored). Else its file name is expected."""
    low = F.lower(_c(content))
    by_phrase = F.exists(_c(phrases), lambda p: F.contains(low, F.lower(p)))
    return F.coalesce(F.when(F.size(_c(phrases)) > 0, by_phrase).otherwise(F.array_contains(_c(expected_sources), _c(source_name))), F.lit(False))
