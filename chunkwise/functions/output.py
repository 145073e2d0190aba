"""Result sinks: search results, answers and chunk lists as text, JSON and XML. Native expressions over sorted lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwise.functions.text import excerpt, json_escape, path_string, xml_attribute


def _per_query(results: DataFrame, piece, sep: str) -> DataFrame:
    rows = results.select("query_id", F.struct("rank", piece.alias("p")).alias("x")).groupBy("query_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return rows.select("query_id", F.array_join(F.transform("xs", lambda x: x["p"]), sep).alias("body"))


def quoted(c):
    return F.concat(F.lit('"'), json_escape(c), F.lit('"'))


def search_text(results: DataFrame) -> DataFrame:
    """``(query_id, out)``: ``[rank] score=0.98  source=…  chunk=N`` and the text, results apart by a blank line."""
    head = F.format_string("[%d] score=%.2f  source=%s  chunk=%d\n", "rank", "score", "source", "chunk_index")
    return _per_query(results, F.concat(head, F.coalesce("content", F.lit(""))), "\n\n").withColumnRenamed("body", "out")


#: Layout of JSON lists in the output.
FIRST, NEXT, LAST = "[\n    ", ",\n    ", "\n  ]"


def _listed(body):
    return F.when(F.length(F.coalesce(body, F.lit(""))) > 0, F.concat(F.lit(FIRST), body, F.lit(LAST))).otherwise("[]")


def search_json(results: DataFrame, mode: str = "hybrid") -> DataFrame:
    """``(query_id, out)``: mode and chunks, one chunk a line; scores in full."""
    one = F.concat(F.lit('{"path": '), quoted(F.col("source")), F.lit(', "chunkIndex": '), F.col("chunk_index").cast("string"), F.lit(', "score": '), F.col("score").cast("string"), F.lit(', "content": '), quoted(F.coalesce("content", F.lit(""))), F.lit("}"))
    body = _per_query(results, one, NEXT)
    return body.select("query_id", F.concat(F.lit('{\n  "mode": "' + mode + '",\n  "chunks": '), _listed(F.col("body")), F.lit("\n}")).alias("out"))


def search_xml(results: DataFrame, mode: str = "hybrid") -> DataFrame:
    one = F.concat(F.format_string('<result index="%d" score="%.2f" source="%s" chunk="%d">\n', "rank", "score", "source", "chunk_index"), F.coalesce("content", F.lit("")), F.lit("\n</result>"))
    body = _per_query(results, one, "\n")
    return body.select("query_id", F.concat(F.lit(f'<results mode="{mode}">\n'), "body", F.lit("\n</results>")).alias("out"))


def answer_text(answers: DataFrame, results: DataFrame) -> DataFrame:
    """The answer and a list of its sources with scores; the answer alone without sources."""
    refs = _per_query(results, F.concat("source", F.lit(" (score: "), F.col("score").cast("string"), F.lit(")\n")), "")
    said = F.concat("answer", F.when(F.col("body").isNotNull(), F.concat(F.lit("\n\n--- Sources ---\n"), "body")).otherwise(""))
    return answers.join(refs, "query_id", "left").select("query_id", said.alias("out"))


def answer_json(answers: DataFrame, results: DataFrame) -> DataFrame:
    one = F.concat(F.lit('{"path": '), quoted(F.col("source")), F.lit(', "score": '), F.col("score").cast("string"), F.lit(', "excerpt": '), quoted(F.coalesce(excerpt("content"), F.lit(""))), F.lit("}"))
    refs = _per_query(results, one, NEXT)
    return answers.join(refs, "query_id", "left").select("query_id", F.concat(F.lit('{\n  "answer": '), quoted(F.col("answer")), F.lit(',\n  "sources": '), _listed(F.col("body")), F.lit("\n}")).alias("out"))


def _chunk_list(chunks: DataFrame, piece, sep: str) -> DataFrame:
    """``(source, body)``: the chunks of a source in order; ``piece(number, path)`` writes one, ``path`` is null if empty."""
    path = F.when(F.size("heading_path") > 0, path_string("heading_path"))
    part = F.struct("chunk_index", "chunk_id", path.alias("path"), F.coalesce("content", F.lit("")).alias("text"))
    rows = chunks.select("source", part.alias("x")).groupBy("source").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return rows.select("source", F.array_join(F.transform("xs", lambda x, i: piece(x, i + 1)), sep).alias("body"))


def chunk_list_text(chunks: DataFrame) -> DataFrame:
    """``(source, out)``: ``[1] chunk=0  heading_path=A > B`` and the text of each chunk."""
    def piece(x, n):
        return F.concat(F.lit("["), n.cast("string"), F.lit("] "), F.concat_ws("  ", F.concat(F.lit("chunk="), x["chunk_index"].cast("string")), F.concat(F.lit("heading_path="), x["path"])), F.lit("\n"), x["text"])

    return _chunk_list(chunks, piece, "\n\n").withColumnRenamed("body", "out")


def chunk_list_json(chunks: DataFrame) -> DataFrame:
    """``(source, out)``: index, heading path if there is one, and content of each chunk, one a line."""
    def piece(x, n):
        path = F.concat(F.lit('"headingPath": '), quoted(x["path"]))
        return F.concat(F.lit("{"), F.concat_ws(", ", F.concat(F.lit('"chunkIndex": '), F.coalesce(x["chunk_index"].cast("string"), F.lit("null"))), path, F.concat(F.lit('"content": '), quoted(x["text"]))), F.lit("}"))

    return _chunk_list(chunks, piece, NEXT).select("source", F.concat(F.lit('{\n  "chunks": '), _listed(F.col("body")), F.lit("\n}")).alias("out"))


def chunk_lines(chunks: DataFrame) -> DataFrame:
    """``(chunk_id, line)``: index, length, heading path and first 60 characters of each chunk."""
    path = F.when(F.size("heading_path") > 0, F.concat(F.lit("  heading_path="), path_string("heading_path"))).otherwise("")
    return chunks.select("chunk_id", F.concat(F.format_string("[%d] chars=%d", "chunk_index", F.length("content")), F.coalesce(path, F.lit("")), F.lit("  "), F.translate(F.substring("content", 1, 60), "\n", " ")).alias("line"))


def chunk_xml(chunks: DataFrame) -> DataFrame:
    """``(chunk_id, xml)``: chunks as elements, of which only the heading path is escaped."""
    attr = F.when(F.size("heading_path") > 0, F.concat(F.lit(' heading_path="'), xml_attribute(path_string("heading_path")), F.lit('"'))).otherwise("")
    return chunks.select("chunk_id", F.concat(F.lit('<chunk index="'), F.col("chunk_index").cast("string"), F.lit('"'), F.coalesce(attr, F.lit("")), F.lit(">\n"), F.coalesce("content", F.lit("")), F.lit("\n</chunk>")).alias("xml"))
