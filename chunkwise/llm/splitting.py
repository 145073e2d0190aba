"""Content-defined splitting: rolling-hash landmarks snapped to the nearest natural boundary."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Natural boundaries, strongest first; a cut lies behind the match.
BOUNDARIES = (
    re.compile(r"\n(?=#{1,6} )"),
    re.compile(r"\n[ \t\r]*\n\s*"),
    re.compile(r"\n"),
    re.compile(r"[.!?…]['\")\]»”’]*\s+|[。！？]"),
    re.compile(r"[,;:]\s+|[、，；：]"),
    re.compile(r"\s+"),
)


def rolling(text: str, window: int) -> np.ndarray:
    """Hash of the last ``window`` characters at every position (0 where fewer stand before it), in O(n) numpy steps."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * (x >> np.uint64(7) | np.uint64(1)), dtype=np.uint64)])
    out = np.zeros(len(text) + 1, np.uint64)
    if len(text) >= window:
        h = total[window:] - total[:-window]
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        out[window:] = h ^ (h >> np.uint64(29))
    return out


def split_text(text: str, limit: int = 2000, overlap: int = 200, window: int = 48, slack: int = 160) -> list[tuple[int, int, int]]:
    """Pieces as ``(start, body, end)`` offsets: characters ``start..body`` repeat the end of the piece before,
    ``body..end`` are new; ``end - start <= limit``.

    New text of a piece is at most ``limit - overlap`` long and, but for the last piece, at least a third of that. In
    this range the landmark is the position with the smallest rolling hash, which depends on the ``window`` characters
    before it only; the cut snaps to the nearest boundary of the strongest kind within ``slack`` characters, or is made
    at the landmark itself where there is none. Since landmarks come from the text alone, an edit moves the cuts near it
    and later ones fall back into step. A text within the limit is one piece.
    The overlap begins at a word border where there is one in its first half, so it is at most ``overlap`` long.
    """
    n = len(text)
    if n <= limit:
        return [(0, 0, n)]
    most, least = limit - overlap, max(1, (limit - overlap) // 3)
    marks = [np.array([m.end() for m in b.finditer(text)], np.int64) for b in BOUNDARIES]
    h = rolling(text, window)
    cuts, at = [0], 0
    while n - at > most:
        lo, hi = at + least, at + most
        mark = lo + int(np.argmin(h[lo : hi + 1]))
        cut = mark
        for kind in marks:
            a, b = np.searchsorted(kind, [max(lo, mark - slack), min(hi, mark + slack) + 1])
            if b > a:
                near = kind[a:b]
                cut = int(near[np.argmin(np.abs(near - mark))])
                break
        else:
            cut = whole(text, cut, lo)
        cuts.append(cut)
        at = cut
    cuts.append(n)
    out = []
    for i in range(len(cuts) - 1):
        body = cuts[i]
        start = body
        if i and overlap:
            start = max(0, body - overlap)
            a, b = np.searchsorted(marks[-1], [start, start + overlap // 2])
            start = int(marks[-1][a]) if b > a and start else whole(text, start, start)
        out.append((start, body, cuts[i + 1]))
    return out


def whole(text: str, cut: int, lo: int) -> int:
    """Do not cut between a character and its combining marks, joiners or the second half of CRLF."""
    import unicodedata

    at = cut
    while at > lo and at < len(text) and (unicodedata.combining(text[at]) or text[at] in "‍️" or text[at - 1] == "‍" or text[at - 1 : at + 1] == "\r\n"):
        at -= 1
    return at if at > lo else cut


def split_chunks(chunks: DataFrame, limit: int = 2000, overlap: int = 200, oversized_only: bool = True) -> DataFrame:
    """Pieces of the oversized ``content`` of ``chunks`` in order.

    Gives ``chunk_id, source, heading_path, chunk_index`` of the item, ``piece_index`` from 0, ``n_pieces``,
    ``overlap_chars`` (how many characters repeat the piece before) and ``piece`` (at most ``limit`` code points).
    The new parts in order are the text, unchanged. Null and empty contents have no piece; with ``oversized_only`` only
    items above the limit come out, else items within it stay one piece. Rows repeated whole with the same ``chunk_id``
    count once; chunks with a null id are kept. Extra columns are not read. No text meets another, so only the removal
    of repeated rows shuffles, and only the oversized ones.
    """
    src = chunks.select("chunk_id", "source", "heading_path", "chunk_index", "content").where(F.length("content") > (limit if oversized_only else 0))
    src = src.dropDuplicates(["chunk_id", "source", "chunk_index", "content"])

    def run(frames):
        for pdf in frames:
            for at in range(0, len(pdf), 64):
                part = pdf.iloc[at : at + 64]
                rows = []
                for cid, source, path, index, text in part.itertuples(index=False):
                    pieces = split_text(text, limit, overlap)
                    for i, (start, body, end) in enumerate(pieces):
                        rows.append((cid, source, path, index, i, len(pieces), body - start, text[start:end]))
                yield pd.DataFrame(rows, columns=["chunk_id", "source", "heading_path", "chunk_index", "piece_index", "n_pieces", "overlap_chars", "piece"])

    return src.mapInPandas(run, "chunk_id string, source string, heading_path array<string>, chunk_index int, piece_index int, n_pieces int, overlap_chars int, piece string")


def new_indexes(chunks: DataFrame, pieces: DataFrame) -> DataFrame:
    """``(source, chunk_id, piece_index, new_index)``: indexes of all chunks of a source after the split, in order.

    Unsplit chunks count as one piece. Distributed prefix sum: counts per (source, block of 1024 indexes) are summed
    over the blocks, then a window runs within one block, so a source with a third of all rows is spread over tasks.
    """
    from pyspark.sql import Window

    n = pieces.groupBy("source", "chunk_id", "chunk_index").agg(F.max("n_pieces").alias("n"))
    base = chunks.select("source", "chunk_id", "chunk_index").distinct()
    null_safe = base.source.eqNullSafe(n.source) & base.chunk_id.eqNullSafe(n.chunk_id) & base.chunk_index.eqNullSafe(n.chunk_index)
    rows = base.join(n, null_safe, "left").select(base.source, base.chunk_id, base.chunk_index, F.coalesce("n", F.lit(1)).alias("n"))
    rows = rows.withColumn("block", F.floor(F.coalesce("chunk_index", F.lit(-1)) / 1024))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offset = rows.groupBy("source", "block").agg(F.sum("n").alias("bn")).withColumn("offset", F.coalesce(F.sum("bn").over(before), F.lit(0)))
    offset = offset.select(F.col("source").alias("s"), F.col("block").alias("b"), "offset")
    inside = Window.partitionBy("source", "block").orderBy("chunk_index", "chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(offset, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    return placed.select("source", "chunk_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("piece_index"), (F.col("offset") + F.col("within")).alias("first")).select(
        "source", "chunk_id", "piece_index", (F.col("first") + F.col("piece_index")).cast("bigint").alias("new_index")
    )
