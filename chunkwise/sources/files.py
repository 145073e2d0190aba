"""Scanning sources and reading every supported format to chunks."""

from __future__ import annotations

import http.client
import os
import re
import urllib.error
import urllib.request
import warnings
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwise.functions import text as tx
from chunkwise.functions.tokens import counter
from chunkwise.operators.blocks import sections
from chunkwise.operators.chunking import pack_section, splitter, token_split, word_split
from chunkwise.sources import code, html, office, rst, tabular, xmldoc

#: Reader by file extension.
READERS = {
    "md": "markdown", "markdown": "markdown", "txt": "plain", "text": "plain", "log": "plain", "html": "html", "htm": "html", "xhtml": "html", "adoc": "asciidoc", "asciidoc": "asciidoc",
    "rst": "rst", "xml": "xml", "svg": "xml", "rss": "xml", "atom": "xml", "csv": "csv", "json": "json", "jsonc": "jsonc", "jsonl": "jsonl", "rtf": "rtf", "kt": "code", "kts": "code", "java": "code",
    "ts": "code", "tsx": "code", "js": "code", "jsx": "code", "docx": "docx", "pptx": "pptx", "xlsx": "xlsx", "pdf": "pdf", "doc": "old office", "ppt": "old office", "xls": "old office",
}


def reader_for(ext) -> object:
    """Reader name of an extension column; unknown extensions are plain text."""
    out = F.lit(None).cast("string")
    for reader in sorted(set(READERS.values())):
        out = F.when(ext.isin(*[e for e, r in READERS.items() if r == reader]), reader).otherwise(out)
    return F.coalesce(out, F.lit("plain"))


def reader_for_content_type(content_type) -> object:
    """Reader of a fetched page by its content type; anything else is looked at for NUL bytes."""
    t = F.lower(F.coalesce(content_type, F.lit("")))
    return F.when(t.startswith("text/html") | t.startswith("application/xhtml"), "html").when(t.startswith("application/pdf"), "pdf").when(t.startswith("text/plain"), "plain").otherwise("sniff")


def expand(paths: list[str]) -> tuple[list[str], list[str], list[str]]:
    """Existing paths, URLs, and missing paths (for a warning)."""
    urls = [p for p in paths if p.startswith(("http://", "https://"))]
    rest = [p for p in paths if p not in urls]
    return [p for p in rest if os.path.exists(p)], urls, [p for p in rest if not os.path.exists(p)]


def scan(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(source, kind, mtime, ext, content)`` of all regular files below the paths, content as bytes.

    Local paths that are not there are left out with a warning; nothing is read where none is there."""
    there, _, missing = expand([p for p in paths if "://" not in p])
    for p in missing:
        warnings.warn(f"no such file or folder: {p}", stacklevel=2)
    paths = [*there, *(p for p in paths if "://" in p)]
    if not paths:
        return spark.createDataFrame([], "source string, kind string, mtime bigint, ext string, content binary")
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    source = F.regexp_replace("path", "^file:(//)?", "")
    return df.select(source.alias("source"), F.lit("file").alias("kind"), F.unix_millis("modificationTime").alias("mtime"), tx.extension(source).alias("ext"), "content")


#: Status of a URL that gave no answer; as any from 400 on it counts as failed.
UNREACHABLE = 599


def fetch_url(url: str, timeout: float = 30.0) -> tuple[bytes, str, str | None, int]:
    """Bytes, content type, Last-Modified and status of a URL; redirects are followed."""
    try:
        with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
            return r.read(), r.headers.get("Content-Type", ""), r.headers.get("Last-Modified"), r.status
    except urllib.error.HTTPError as e:
        return b"", "", None, e.code
    except (OSError, ValueError, http.client.HTTPException):  # no such host, time-out, broken answer, no URL
        return b"", "", None, UNREACHABLE


def fetch(urls: DataFrame, fetcher: Callable = fetch_url) -> DataFrame:
    """``(source, content, content_type, mtime, status_code)`` of ``urls(source)``; the fetcher can be replaced."""
    def run(frames):
        for pdf in frames:
            rows = [(u, *fetcher(u)) for u in pdf["source"]]
            yield pd.DataFrame(rows, columns=["source", "content", "content_type", "modified", "status_code"])

    got = urls.select("source").mapInPandas(run, "source string, content binary, content_type string, modified string, status_code int")
    return got.select("source", "content", "content_type", tx.http_date_ms("modified").alias("mtime"), "status_code")


def collected(spark: SparkSession, paths: list[str], urls: list[str], fetcher: Callable | None = None) -> DataFrame:
    """``(source, mtime, ext, content, status_code)`` of files below existing paths and of URLs.

    The format of a URL follows from its content type (``html``, ``pdf``, ``txt``), else from its path."""
    schema = "source string, mtime bigint, ext string, content binary, status_code int"
    got = spark.createDataFrame([], schema)
    if paths:
        got = got.unionByName(scan(spark, paths).select("source", "mtime", "ext", "content", F.lit(None).cast("int").alias("status_code")))
    if urls:
        pages = fetch(spark.createDataFrame([(u,) for u in urls], "source string"), fetcher or fetch_url)
        kind = F.create_map(*[F.lit(x) for x in ("html", "html", "pdf", "pdf", "plain", "txt")])[reader_for_content_type(F.col("content_type"))]
        got = got.unionByName(pages.select("source", F.coalesce("mtime", F.lit(0)).alias("mtime"), F.coalesce(kind, tx.extension("source")).alias("ext"), "content", "status_code"))
    return got


def decode(data: bytes) -> str:
    return data.decode("utf-8", "replace").removeprefix("﻿")


class Unreadable(Exception):
    """A file that is skipped; its text is the status."""


def read_bytes(data: bytes, reader: str, ext: str, size: int, tokens: str = "words") -> list[dict]:
    """Chunks ``{chunk, heading_title, heading_level, heading_path}`` of one file; errors name what is wrong."""
    count, split = counter(tokens), splitter(tokens)

    def plain(text: str) -> list[dict]:
        pieces = token_split(text, size, 0, 5) if tokens == "bpe" else word_split(text, size)
        return [{"chunk": p, "heading_title": None, "heading_level": None, "heading_path": []} for p in pieces]

    def markdown(text: str) -> list[dict]:
        text = re.sub(r"(?s)\A\s*---.*?\n---[^\n]*(\n|\Z)\s*", "", text)
        parts = sections(text)
        if all(level is None for _, level, *_ in parts):
            return plain(text)
        out = []
        for _, level, title, path, body in parts:
            for p in pack_section(body, "#" * level + " " + title if level else "", size, count, split):
                out.append({"chunk": p, "heading_title": title, "heading_level": level, "heading_path": path})
        return out

    def whole(pieces: list[str]) -> list[dict]:
        return [{"chunk": p, "heading_title": None, "heading_level": None, "heading_path": []} for p in pieces]

    if reader in ("pdf", "old office"):
        raise Unreadable("unsupported")
    if reader in ("docx", "pptx", "xlsx") and office.is_encrypted(data):
        raise Unreadable("encrypted")
    if reader == "docx":
        return markdown(office.docx_to_markdown(data))
    if reader == "pptx":
        return markdown(office.pptx_to_markdown(data))
    if reader == "xlsx":
        return whole(office.xlsx_chunks(data, size, count))
    text = decode(data)
    if reader == "html":
        return markdown(html.html_to_markdown(text))
    if reader == "xml":
        return markdown(xmldoc.xml_to_markdown(text, (), size))
    if reader == "rst":
        return markdown(rst.rst_to_markdown(text))
    if reader == "asciidoc":
        return markdown(rst.asciidoc_to_markdown(text))
    if reader == "rtf":
        return plain(rst.rtf_to_text(text))
    if reader == "csv":
        return whole(tabular.csv_chunks(text, size, count))
    if reader == "json":
        import json

        json.loads(text)
        return whole(tabular.jsonc_chunks(text, size, count))
    if reader == "jsonc":
        return whole(tabular.jsonc_chunks(text, size, count))
    if reader == "jsonl":
        import json

        return whole(tabular.jsonc_chunks(json.dumps(tabular.jsonl_objects(text), ensure_ascii=False), size, count))
    if reader == "code":
        return [{"chunk": c["chunk"], "heading_title": c["name"], "heading_level": 2 if c["type"] == "CLASS" else 3, "heading_path": [*(c["class_name"].split(".") if c["class_name"] else []), c["name"].rsplit(".", 1)[-1]]} for c in code.code_chunks(text, code.LANGUAGES[ext], size, tokens)]
    return markdown(text) if reader == "markdown" else plain(text)


CHUNKS = "source string, chunk_index int, content string, heading_title string, heading_level int, heading_path array<string>, status string"


def read_files(files: DataFrame, size: int = 1000, tokens: str = "bpe", strip_binary: bool = False) -> DataFrame:
    """Chunks of ``files(source, ext, content BINARY)``: one row per chunk with ``status`` ``ok``, or one row without
    content whose status says why a file has none (``empty``, ``binary``, ``encrypted``, ``unsupported``, ``error: ...``).

    Bytes of PDF files (their positioned elements are read by ``pdf``) and of old Office formats are unsupported and
    never taken for text. Binary files of unknown formats are skipped, or their printable runs are read if ``strip_binary``. Null contents are
    empty. Files are independent: no shuffle.
    """
    ext = F.coalesce("ext", F.lit(""))
    known = files.select("source", ext.alias("ext"), reader_for(ext).alias("reader"), "content")
    unknown = ~F.col("ext").isin(*READERS)
    rows = known.withColumn("binary", unknown & F.coalesce(tx.is_binary("content"), F.lit(False)))
    if strip_binary:
        rows = rows.withColumn("content", F.when(F.col("binary"), F.encode(tx.printable_runs("content"), "UTF-8")).otherwise(F.col("content"))).withColumn("binary", F.lit(False))

    def run(frames):
        for pdf in frames:
            out = []
            for source, e, reader, data, binary in pdf[["source", "ext", "reader", "content", "binary"]].itertuples(index=False):
                if binary:
                    out.append((source, None, None, None, None, None, "binary"))
                    continue
                try:
                    got = read_bytes(data or b"", reader, e, size, tokens)
                except Unreadable as err:
                    out.append((source, None, None, None, None, None, str(err)))
                    continue
                except Exception as err:  # a broken file must not end the job
                    out.append((source, None, None, None, None, None, f"error: {err}"))
                    continue
                if not got:
                    out.append((source, None, None, None, None, None, "empty"))
                for i, c in enumerate(got):
                    out.append((source, i, c["chunk"], c["heading_title"], c["heading_level"], c["heading_path"], "ok"))
            frame = pd.DataFrame(out, columns=[f.split()[0] for f in CHUNKS.split(", ")])
            yield frame.astype({"chunk_index": "Int32", "heading_level": "Int32"})

    return rows.mapInPandas(run, CHUNKS)


def to_document(df: DataFrame, id_col: str, text_col: str, fmt_col: str) -> DataFrame:
    """``(<id>, markdown)``: texts of the formats named by ``fmt_col`` (md, html, rst, adoc, xml, rtf, csv, jsonl, …) as Markdown."""
    kind = dict(df.dtypes)[id_col]

    def convert(fmt: str, text: str) -> str:
        reader = READERS.get(fmt or "", "plain")
        if reader == "html":
            return html.html_to_markdown(text)
        if reader == "xml":
            return xmldoc.xml_to_markdown(text)
        if reader in ("rst", "asciidoc"):
            return (rst.rst_to_markdown if reader == "rst" else rst.asciidoc_to_markdown)(text)
        if reader == "rtf":
            return rst.rtf_to_text(text)
        big = 1 << 30
        if reader == "csv":
            return "\n\n".join(tabular.csv_chunks(text, big, counter("words")))
        if reader == "jsonl":
            import json

            return "\n\n".join(tabular.jsonc_chunks(json.dumps(tabular.jsonl_objects(text), ensure_ascii=False), big, counter("words")))
        return text

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"id": pdf["id"], "markdown": [convert(f, t) for f, t in zip(pdf["fmt"], pdf["text"])]})

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(fmt_col).alias("fmt")).where("text IS NOT NULL")
    return src.mapInPandas(run, f"id {kind}, markdown string").withColumnRenamed("id", id_col)
