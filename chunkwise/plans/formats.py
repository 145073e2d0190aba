"""Queries over format readers, text functions and result sinks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from chunkwise.functions import output
from chunkwise.functions import text as tx
from chunkwise.functions.tokens import counter
from chunkwise.operators.search import live_chunks
from chunkwise.plans.search import CHUNKS, _ranked, _ranked_sql
from chunkwise.session import table
from chunkwise.sources import code, files, pdf, tabular, xmldoc
from chunkwise.sources import html as htm
from chunkwise.streaming import ingest


def _docs(spark, d, fmt=None):
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.where(F.col("fmt") == fmt) if fmt else docs


def _each(df, fn, schema):
    """Rows ``fn(doc_id, text)`` of every document, over Arrow batches."""
    cols = [c.split()[0] for c in schema.split(", ")]

    def run(frames):
        for p in frames:
            yield pd.DataFrame([r for i, t in zip(p["doc_id"], p["text"]) for r in fn(i, t)], columns=cols)

    return df.select("doc_id", "text").mapInPandas(run, schema)


# scans and routing
def reader_routing(spark, d):
    ext = tx.extension("path")
    return table(spark, d, "documents").select("doc_id", ext.alias("ext"), files.reader_for(ext).alias("reader"))


def content_type_routing(spark, d):
    """Content types made from the format of each document."""
    ct = F.concat(F.lit("TEXT/"), F.when(F.col("fmt") == "html", "HTML; charset=utf-8").when(F.col("fmt") == "txt", "plain").otherwise(F.col("fmt")))
    return table(spark, d, "documents").groupBy(files.reader_for_content_type(ct).alias("reader")).agg(F.count(F.lit(1)).alias("n"))


def binary_detect(spark, d):
    """Documents with a NUL byte put into the first or behind the first 8192 bytes, or none."""
    nul = F.unhex(F.lit("00"))
    data = F.encode("text", "UTF-8")
    made = F.when(F.col("doc_id") % 3 == 0, F.concat(F.substring(data, 1, 40), nul, data)).when(F.col("doc_id") % 3 == 1, F.concat(F.encode(F.repeat(F.lit("x"), 8192), "UTF-8"), nul)).otherwise(data)
    return _docs(spark, d).select("doc_id", tx.is_binary(made).alias("is_binary"))


def binary_strip(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(tx.printable_runs(F.encode("text", "UTF-8")), 256).alias("digest"))


def read_document_files(spark, d):
    """Chunks of every document read as a file of its format, by status and reader."""
    source = F.coalesce("path", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))
    f = _docs(spark, d).select(source.alias("source"), tx.extension("path").alias("ext"), F.encode("text", "UTF-8").alias("content"))
    return files.read_files(f, 200, "words")


def to_document(spark, d):
    return files.to_document(_docs(spark, d), "doc_id", "text", "fmt")


# formats
def html_title(spark, d):
    """Native title extraction."""
    t = F.regexp_extract("text", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return _docs(spark, d, "html").select("doc_id", F.trim(F.regexp_replace(t, r"\s+", " ")).alias("title"))


def html_markdown(spark, d):
    return _each(_docs(spark, d, "html"), lambda i, t: [(i, htm.html_title(t), htm.html_to_markdown(t))], "doc_id bigint, title string, markdown string")


def html_paragraphs(spark, d):
    """Paragraphs of HTML pages without inner markup."""
    p = F.regexp_extract_all("text", F.lit(r"(?s)<p>([^<]*)</p>"), F.lit(1))
    return _docs(spark, d, "html").select("doc_id", F.size(p).cast("bigint").alias("n"), F.sha2(F.array_join(p, "\n"), 256).alias("digest"))


def csv_markdown_table(spark, d):
    count = counter("words")
    return _each(_docs(spark, d, "csv"), lambda i, t: [(i, n, c) for n, c in enumerate(tabular.csv_chunks(t, 60, count))], "doc_id bigint, chunk_index int, chunk string")


def csv_rows(spark, d):
    """Number of data rows and header width of each table of comma-separated values."""
    return _each(_docs(spark, d, "csv"), lambda i, t: [(i, max(0, len(r) - 1), len(r[0]))] if (r := tabular.csv_rows(t)) else [], "doc_id bigint, n_rows bigint, n_columns bigint")


def jsonl_items(spark, d):
    """Valid lines of JSON-lines documents with two of their fields, natively."""
    lines = _docs(spark, d, "jsonl").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    ok = lines.where((F.length(F.trim("line")) > 0) & F.try_parse_json("line").isNotNull())
    return ok.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.get_json_object("line", "$.level").alias("level"), F.get_json_object("line", "$.hits").alias("hits"))


def json_field_render(spark, d):
    """Fields of event properties as Markdown lines."""
    e = table(spark, d, "events").where("props IS NOT NULL")
    return e.select("event_id", F.concat(F.lit("**k**: "), F.get_json_object("props", "$.k")).alias("line"))


def jsonl_chunks(spark, d):
    count = counter("words")

    def one(i, t):
        import json

        return [(i, n, c) for n, c in enumerate(tabular.jsonc_chunks(json.dumps(tabular.jsonl_objects(t)), 60, count))]

    return _each(_docs(spark, d, "jsonl"), one, "doc_id bigint, chunk_index int, chunk string")


def xml_sections(spark, d):
    """Customers of each nation as an XML document, as sections."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    row = F.format_string('<customer id="%d"><name>%s</name><segment>%s</segment></customer>', "c_custkey", "c_name", "c_mktsegment")
    docs = c.groupBy(F.col("n_nationkey").cast("bigint").alias("doc_id")).agg(F.concat(F.lit('<nation name="'), F.first("n_name"), F.lit('">'), F.array_join(F.array_sort(F.collect_list(row)), ""), F.lit("</nation>")).alias("text"))
    return _each(docs, lambda i, t: [(i, xmldoc.xml_to_markdown(t, (), 200))], "doc_id bigint, markdown string")


def rst_sections(spark, d):
    return files.to_document(_docs(spark, d, "rst"), "doc_id", "text", "fmt")


def code_declarations(spark, d):
    """Declarations found in whole classes of the store, with their kind and class."""
    src = table(spark, d, "declarations").where("declaration_type = 'CLASS' AND lang IS NOT NULL AND full_text IS NOT NULL").dropDuplicates(["decl_id"])

    def run(frames):
        for p in frames:
            rows = [(i, x.type, x.name, x.class_name, len(x.full_text)) for i, lang, t in zip(p["decl_id"], p["lang"], p["full_text"]) for x in code.declarations(t, lang)]
            yield pd.DataFrame(rows, columns=["decl_id", "type", "name", "class_name", "n_chars"])

    return src.select("decl_id", "lang", "full_text").mapInPandas(run, "decl_id bigint, type string, name string, class_name string, n_chars int")


def code_chunks(spark, d):
    """Chunks of all code documents, read in the language of their path (Kotlin where it tells none)."""
    def run(frames):
        for p in frames:
            rows = [(i, n, c["type"], c["name"], c["chunk"]) for i, e, t in zip(p["doc_id"], p["ext"], p["text"]) for n, c in enumerate(code.code_chunks(t, code.LANGUAGES.get(e, "kotlin"), 120))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "type", "name", "chunk"])

    src = _docs(spark, d, "code").select("doc_id", F.coalesce(tx.extension("path"), F.lit("")).alias("ext"), "text")
    return src.mapInPandas(run, "doc_id bigint, chunk_index int, type string, name string, chunk string")


def declaration_stats(spark, d):
    x = table(spark, d, "declarations").dropDuplicates(["decl_id"])
    return x.groupBy("lang", "declaration_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"), F.sum(F.size("imports")).cast("bigint").alias("imports"))


def _elements(spark, d):
    """Words of order lines laid out on pages: a running head, a title, text rows and a page number."""
    o = table(spark, d, "lineitem")
    line = o.select(F.col("l_orderkey").alias("doc_id"), (F.floor((F.col("l_linenumber") - 1) / 3) + 1).cast("int").alias("page"), (F.lit(72.0)).alias("x"), (100.0 + 14 * F.col("l_linenumber")).alias("y"), F.lit(300.0).alias("end_x"), F.lit(10.0).alias("size"), F.lit("Serif").alias("font"), F.concat(F.lit("part "), F.col("l_partkey").cast("string"), F.lit(" was sent-")).alias("text"))
    pages = line.select("doc_id", "page").distinct()
    fixed = lambda x, y, s, f, t: pages.select("doc_id", "page", F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(x + 100.0).alias("end_x"), F.lit(s).alias("size"), F.lit(f).alias("font"), t.alias("text"))
    head = fixed(72.0, 40.0, 8.0, "Serif", F.lit("Delivery notes"))
    title = fixed(72.0, 70.0, 18.0, "Serif-Bold", F.concat(F.lit("Order "), F.col("doc_id").cast("string"))).where("page = 1")
    number = fixed(280.0, 780.0, 8.0, "Serif", F.col("page").cast("string"))
    return line.unionByName(head).unionByName(title).unionByName(number)


def pdf_layout_markdown(spark, d):
    return pdf.documents_to_markdown(_elements(spark, d))


def pdf_repeated_elements(spark, d):
    return pdf.repeated_elements(_elements(spark, d))


def pdf_font_size_class(spark, d):
    """Quantities as font sizes, the usual one being 25."""
    return table(spark, d, "lineitem").groupBy(tx.font_size_class("l_quantity", F.lit(25.0)).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def repeated_lines(spark, d):
    """Lines that stand in at least three documents: boilerplate."""
    x = _docs(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.length(F.trim("line")) > 0)
    return x.groupBy(F.trim("line").alias("line")).agg(F.count_distinct("doc_id").alias("docs")).where("docs >= 3")


# text functions
def hyphen_repair(spark, d):
    made = F.regexp_replace("text", r"([a-z]{3})([a-z]{3}) ", "$1-\n$2 ")
    return _docs(spark, d).select("doc_id", F.sha2(tx.repair_hyphens(made), 256).alias("digest"))


def text_escapes(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(tx.json_escape("text"), 256).alias("json"), F.sha2(tx.xml_attribute("text"), 256).alias("xml"))


def http_dates(spark, d):
    """HTTP dates made from order dates, and some broken ones."""
    day = F.date_format("o_orderdate", "dd MMM yyyy HH:mm:ss")
    made = F.when(F.col("o_orderkey") % 7 == 0, "yesterday").otherwise(F.concat(F.lit("Mon, "), day, F.lit(" GMT")))
    return table(spark, d, "orders").select("o_orderkey", tx.http_date_ms(made).alias("ms"))


def iso_times(spark, d):
    return table(spark, d, "documents").where("mtime IS NOT NULL").select("doc_id", tx.iso_utc("mtime").alias("iso"))


def sizes_shown(spark, d):
    return table(spark, d, "source_scan").where("size_bytes IS NOT NULL").select("scan_id", tx.human_size("size_bytes").alias("shown"))


def lenient_numbers(spark, d):
    v = F.regexp_extract("path", r"([0-9]+)[^/]*$", 1)
    return table(spark, d, "documents").where("path IS NOT NULL").select("doc_id", tx.to_long(v).alias("n"))


def word_counts(spark, d):
    return _docs(spark, d).select("doc_id", tx.plain_token_count("text").cast("bigint").alias("n"), F.sha2("text", 256).alias("digest"))


def path_parts(spark, d):
    return table(spark, d, "chunks").where("source IS NOT NULL").select("source").distinct().select("source", tx.file_name("source").alias("file"), tx.extension("source").alias("ext"))


def heading_path_json(spark, d):
    """Heading paths to JSON and back."""
    c = live_chunks(table(spark, d, "chunks")).where("heading_path IS NOT NULL")
    j = F.to_json("heading_path")
    return c.select("chunk_id", j.alias("js"), F.size(F.from_json(j, "array<string>")).cast("bigint").alias("n"))


# sinks
def _results(spark, d):
    c = live_chunks(table(spark, d, "chunks")).select("chunk_id", "source", "chunk_index", "content")
    return _ranked(spark, d, "rerank", 3).join(c, "chunk_id").where("source IS NOT NULL").select("query_id", "rank", "source", "chunk_index", F.round("score", 6).alias("score"), "content")


def format_text(spark, d):
    return output.search_text(_results(spark, d))


def format_json(spark, d):
    return output.search_json(_results(spark, d))


def format_xml(spark, d):
    return output.search_xml(_results(spark, d))


def format_answer_text(spark, d):
    answers = table(spark, d, "queries").select("query_id", F.concat(F.lit("About: "), F.coalesce("question", F.lit(""))).alias("answer"))
    return output.answer_text(answers, _results(spark, d))


def format_answer_json(spark, d):
    answers = table(spark, d, "queries").select("query_id", F.concat(F.lit("About: "), F.coalesce("question", F.lit(""))).alias("answer"))
    return output.answer_json(answers, _results(spark, d))


def _listed(spark, d):
    return live_chunks(table(spark, d, "chunks")).where("source IS NOT NULL AND chunk_index IS NOT NULL")


def chunk_list_text(spark, d):
    return output.chunk_list_text(_listed(spark, d)).select("source", F.sha2("out", 256).alias("digest"))


def chunk_list_json(spark, d):
    return output.chunk_list_json(_listed(spark, d)).select("source", F.sha2("out", 256).alias("digest"))


def chunk_list_lines(spark, d):
    return output.chunk_lines(live_chunks(table(spark, d, "chunks")).where("content IS NOT NULL AND chunk_index IS NOT NULL AND heading_path IS NOT NULL"))


def chunk_list_xml(spark, d):
    x = output.chunk_xml(live_chunks(table(spark, d, "chunks")).where("heading_path IS NOT NULL AND chunk_index IS NOT NULL"))
    return x.select("chunk_id", F.sha2("xml", 256).alias("digest"))


# monitoring
def arrivals_per_day(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("date").alias("day"), "event_type", "n")


def arrivals_window(spark, d):
    return ingest.arrivals(table(spark, d, "events")).select(F.col("start").cast("date").alias("day"), "event_type", "n")


def freshness_of_chunks(spark, d):
    c = table(spark, d, "chunks").where("ingest_time IS NOT NULL AND source IS NOT NULL").groupBy("source").agg(F.max("ingest_time").alias("ingest_time"))
    return ingest.freshness(c, 1_757_100_000_000, 24 * 30)


NAMES = (
    reader_routing, content_type_routing, binary_detect, binary_strip, read_document_files, to_document, html_title, html_markdown, html_paragraphs, csv_markdown_table, csv_rows, jsonl_items, json_field_render, jsonl_chunks,
    xml_sections, rst_sections, code_declarations, code_chunks, declaration_stats, pdf_layout_markdown, pdf_repeated_elements, pdf_font_size_class, repeated_lines, hyphen_repair, text_escapes, http_dates, iso_times, sizes_shown,
    lenient_numbers, word_counts, path_parts, heading_path_json, format_text, format_json, format_xml, format_answer_text, format_answer_json, chunk_list_text, chunk_list_json, chunk_list_lines, chunk_list_xml, arrivals_per_day, arrivals_window, freshness_of_chunks,
)
QUERIES = {f.__name__: f for f in NAMES}

DOCS = "(SELECT * FROM documents WHERE text IS NOT NULL)"
EXT = r"lower(regexp_extract(regexp_replace(string_split({0}, '/')[-1], '[?#].*$', ''), '\.([A-Za-z0-9]+)$', 1))"
READER = "CASE " + " ".join(f"WHEN ext IN ({', '.join(repr(e) for e, r in files.READERS.items() if r == reader)}) THEN '{reader}'" for reader in sorted(set(files.READERS.values()))) + " ELSE 'plain' END"
RES = f"(SELECT r.query_id, r.rank, c.source, c.chunk_index, round(r.score, 6) AS score, c.content FROM ({_ranked_sql('rerank', 3)}) r JOIN ({CHUNKS}) c USING (chunk_id) WHERE c.source IS NOT NULL)"
NL = "chr(10)"
JSON = "replace(replace(replace(replace(replace({0}, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't')"
XML = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
CLASS = "CASE WHEN r < 0.6 THEN 'xx-small' WHEN r < 0.75 THEN 'x-small' WHEN r < 0.9 THEN 'small' WHEN r < 1.1 THEN 'medium' WHEN r < 1.35 THEN 'large' WHEN r < 1.7 THEN 'x-large' ELSE 'xx-large' END"
REFS = f"SELECT query_id, string_agg(source || ' (score: ' || score || ')' || {NL}, '' ORDER BY rank) AS body FROM {RES} GROUP BY 1"
REFS_JSON = "SELECT query_id, string_agg('{\"path\": \"' || " + JSON.format("source") + " || '\", \"score\": ' || score || ', \"excerpt\": \"' || " + JSON.format("coalesce(substring(content, 1, 200), '')") + f" || '\"}}', ',' || {NL} || '    ' ORDER BY rank) AS body FROM {RES} GROUP BY 1"
LISTED = f"(SELECT *, row_number() OVER (PARTITION BY source ORDER BY chunk_index, chunk_id) AS no, CASE WHEN len(heading_path) > 0 THEN array_to_string(heading_path, ' > ') END AS hp FROM ({CHUNKS}) WHERE source IS NOT NULL AND chunk_index IS NOT NULL)"
SQL = {
    "binary_strip": f"SELECT doc_id, sha256(array_to_string(regexp_extract_all(decode(encode(text)), '[\\x20-\\x7E\\t\\n\\r]{{4,}}'), {NL})) AS digest FROM {DOCS}",
    "csv_rows": f"SELECT doc_id, len(rows)::BIGINT - 1 AS n_rows, len(string_split(regexp_replace(rows[1], '\"[^\"]*\"', '', 'g'), ','))::BIGINT AS n_columns FROM (SELECT doc_id, list_filter(string_split(regexp_replace(text, '\"[^\"]*\"', 'q', 'g'), {NL}), lambda x: trim(x) <> '') AS rows FROM {DOCS} WHERE fmt = 'csv') WHERE len(rows) > 0",
    "reader_routing": f"SELECT doc_id, ext, {READER} AS reader FROM (SELECT doc_id, {EXT.format('path')} AS ext FROM documents)",
    "content_type_routing": "SELECT CASE WHEN fmt = 'html' THEN 'html' WHEN fmt = 'txt' THEN 'plain' ELSE 'sniff' END AS reader, count(*) AS n FROM documents GROUP BY 1",
    "binary_detect": f"SELECT doc_id, doc_id % 3 = 0 OR (doc_id % 3 = 2 AND contains(left(text, 8192), chr(0))) AS is_binary FROM {DOCS}",
    "html_title": f"SELECT doc_id, trim(regexp_replace(regexp_extract(text, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g'), ' ') AS title FROM {DOCS} WHERE fmt = 'html'",
    "html_paragraphs": f"SELECT doc_id, len(p)::BIGINT AS n, sha256(array_to_string(p, {NL})) AS digest FROM (SELECT doc_id, regexp_extract_all(text, '(?s)<p>([^<]*)</p>', 1) AS p FROM {DOCS} WHERE fmt = 'html')",
    "jsonl_items": f"SELECT doc_id, pos, json_extract_string(line, '$.level') AS level, json_extract_string(line, '$.hits') AS hits FROM (SELECT doc_id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, {NL}) AS ls FROM {DOCS} WHERE fmt = 'jsonl')) WHERE trim(line, ' ') <> '' AND json_valid(line)",
    "json_field_render": "SELECT event_id, '**k**: ' || json_extract_string(props, '$.k') AS line FROM events WHERE props IS NOT NULL",
    "declaration_stats": "SELECT lang, declaration_type, count(*) AS n, count(DISTINCT source) AS sources, sum(len(imports))::BIGINT AS imports FROM (SELECT DISTINCT ON (decl_id) * FROM declarations) GROUP BY 1, 2",
    "pdf_repeated_elements": "WITH li AS (SELECT l_orderkey AS doc_id, (floor((l_linenumber - 1) / 3) + 1)::INT AS page, 72.0::DOUBLE AS x, 100 + 14 * l_linenumber AS y, 'part ' || l_partkey || ' was sent-' AS text FROM lineitem), pg AS (SELECT DISTINCT doc_id, page FROM li), el AS (SELECT * FROM li UNION ALL SELECT doc_id, page, 72, 40, 'Delivery notes' FROM pg UNION ALL SELECT doc_id, page, 72, 70, 'Order ' || doc_id FROM pg WHERE page = 1 UNION ALL SELECT doc_id, page, 280, 780, page::VARCHAR FROM pg), n AS (SELECT doc_id, count(DISTINCT page) AS n FROM el GROUP BY 1), s AS (SELECT doc_id, text, count(DISTINCT page) AS pages FROM el GROUP BY doc_id, round(x), round(y), text) SELECT s.doc_id, text, pages FROM s JOIN n USING (doc_id) WHERE pages >= greatest(2, floor(n / 3))",
    "pdf_font_size_class": f"SELECT {CLASS} AS class, count(*) AS n FROM (SELECT l_quantity / 25.0::DOUBLE AS r FROM lineitem) GROUP BY 1",
    "repeated_lines": f"SELECT trim(line, ' ') AS line, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(string_split(text, {NL})) AS line FROM {DOCS}) WHERE trim(line, ' ') <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3",
    "hyphen_repair": f"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '([a-z]{{3}})([a-z]{{3}}) ', '\\1-' || {NL} || '\\2 ', 'g'), '-\\s+([a-z])', '\\1', 'g')) AS digest FROM {DOCS}",
    "text_escapes": f"SELECT doc_id, sha256({JSON.format('text')}) AS json, sha256({XML.format('text')}) AS xml FROM {DOCS}",
    "http_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE (epoch_ms(o_orderdate) // 1000) * 1000 END AS ms FROM orders",
    "iso_times": "SELECT doc_id, strftime(make_timestamp(mtime * 1000), '%Y-%m-%dT%H:%M:%SZ') AS iso FROM documents WHERE mtime IS NOT NULL",
    "sizes_shown": "SELECT scan_id, CASE WHEN size_bytes < 1024 THEN size_bytes || ' B' WHEN size_bytes < 1048576 THEN (size_bytes // 1024) || ' KB' ELSE (size_bytes // 1048576) || ' MB' END AS shown FROM source_scan WHERE size_bytes IS NOT NULL",
    "lenient_numbers": "SELECT doc_id, try_cast(regexp_extract(path, '([0-9]+)[^/]*$', 1) AS BIGINT) AS n FROM documents WHERE path IS NOT NULL",
    "word_counts": f"SELECT doc_id, len(regexp_split_to_array(text, '\\s+'))::BIGINT AS n, sha256(text) AS digest FROM {DOCS}",
    "path_parts": f"SELECT source, string_split(source, '/')[-1] AS file, {EXT.format('source')} AS ext FROM (SELECT DISTINCT source FROM chunks WHERE source IS NOT NULL)",
    "heading_path_json": f"SELECT chunk_id, to_json(heading_path)::VARCHAR AS js, len(heading_path) AS n FROM ({CHUNKS}) WHERE heading_path IS NOT NULL",
    "format_text": f"SELECT query_id, string_agg('[' || rank || '] score=' || printf('%.2f', score) || '  source=' || source || '  chunk=' || chunk_index || {NL} || coalesce(content, ''), {NL} || {NL} ORDER BY rank) AS out FROM {RES} GROUP BY 1",
    "format_json": "SELECT query_id, '{' || chr(10) || '  \"mode\": \"hybrid\",' || chr(10) || '  \"chunks\": [' || chr(10) || '    ' || string_agg('{\"path\": \"' || " + JSON.format("source") + " || '\", \"chunkIndex\": ' || chunk_index || ', \"score\": ' || score || ', \"content\": \"' || " + JSON.format("coalesce(content, '')") + f" || '\"}}', ',' || {NL} || '    ' ORDER BY rank) || {NL} || '  ]' || {NL} || '}}' AS out FROM {RES} GROUP BY 1",
    "format_xml": f"SELECT query_id, '<results mode=\"hybrid\">' || {NL} || string_agg('<result index=\"' || rank || '\" score=\"' || printf('%.2f', score) || '\" source=\"' || source || '\" chunk=\"' || chunk_index || '\">' || {NL} || coalesce(content, '') || {NL} || '</result>', {NL} ORDER BY rank) || {NL} || '</results>' AS out FROM {RES} GROUP BY 1",
    "format_answer_text": f"SELECT q.query_id, 'About: ' || coalesce(question, '') || CASE WHEN body IS NULL THEN '' ELSE {NL} || {NL} || '--- Sources ---' || {NL} || body END AS out FROM queries q LEFT JOIN ({REFS}) r USING (query_id)",
    "format_answer_json": "SELECT q.query_id, '{' || chr(10) || '  \"answer\": \"' || " + JSON.format("'About: ' || coalesce(question, '')") + f" || '\",' || {NL} || '  \"sources\": ' || CASE WHEN body IS NULL THEN '[]' ELSE '[' || {NL} || '    ' || body || {NL} || '  ]' END || {NL} || '}}' AS out FROM queries q LEFT JOIN ({REFS_JSON}) r USING (query_id)",
    "chunk_list_text": f"SELECT source, sha256(string_agg('[' || no || '] chunk=' || chunk_index || coalesce('  heading_path=' || hp, '') || {NL} || coalesce(content, ''), {NL} || {NL} ORDER BY no)) AS digest FROM {LISTED} GROUP BY 1",
    "chunk_list_json": "SELECT source, sha256('{' || chr(10) || '  \"chunks\": [' || chr(10) || '    ' || string_agg('{\"chunkIndex\": ' || chunk_index || coalesce(', \"headingPath\": \"' || " + JSON.format("hp") + " || '\"', '') || ', \"content\": \"' || " + JSON.format("coalesce(content, '')") + f" || '\"}}', ',' || {NL} || '    ' ORDER BY no) || {NL} || '  ]' || {NL} || '}}') AS digest FROM {LISTED} GROUP BY 1",
    "chunk_list_lines": f"SELECT chunk_id, '[' || chunk_index || '] chars=' || length(content) || CASE WHEN len(heading_path) > 0 THEN '  heading_path=' || array_to_string(heading_path, ' > ') ELSE '' END || '  ' || replace(substring(content, 1, 60), {NL}, ' ') AS line FROM ({CHUNKS}) WHERE content IS NOT NULL AND chunk_index IS NOT NULL AND heading_path IS NOT NULL",
    "chunk_list_xml": f"SELECT chunk_id, sha256('<chunk index=\"' || chunk_index || '\"' || CASE WHEN len(heading_path) > 0 THEN ' heading_path=\"' || {XML.format('array_to_string(heading_path, chr(32) || chr(62) || chr(32))')} || '\"' ELSE '' END || '>' || {NL} || coalesce(content, '') || {NL} || '</chunk>') AS digest FROM ({CHUNKS}) WHERE heading_path IS NOT NULL AND chunk_index IS NOT NULL",
    "arrivals_per_day": "SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "arrivals_window": "SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "freshness_of_chunks": f"SELECT source, 1757100000000 - max(ingest_time) < {24 * 30 * 3600 * 1000} AS fresh FROM chunks WHERE ingest_time IS NOT NULL AND source IS NOT NULL GROUP BY 1",
}
