"""Byte-pair encoding of a corpus by recursive DuckDB queries inside each Spark partition."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.json")

#: How this family of tokenizers cuts text into words before merging.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A piece ends where a space comes before a visible character: a word border whatever stands around it.
PIECE = r" (?=\S)"
#: A first piece is marked by a white space in front, which no other piece begins with.
FIRST = "\n"
#: ASCII texts with none of these can be cut at each space.
BLANKS = ("  ", " \n", " \r", " \t", " \x0b", " \x0c", "\x1c", "\x1d", "\x1e", "\x1f")

#: One recursion step contracts the leftmost minimum-rank pair of every word that still has a pair in the merge table.
CONTRACT = """
WITH RECURSIVE step AS (
    SELECT wid, pos, tok, 0 AS it FROM letters
    UNION ALL
    SELECT wid, pos, CASE WHEN pos = best % 1048576 THEN fresh ELSE tok END AS tok, it + 1 AS it
    FROM (
        SELECT p.wid, p.pos, p.before, p.tok, p.it, m.fresh,
               min(m.prio::BIGINT * 1048576 + p.pos) OVER (PARTITION BY p.wid) AS best
        FROM (
            SELECT wid, pos, tok, it, lead(tok) OVER w AS nxt, lag(pos) OVER w AS before
            FROM step WINDOW w AS (PARTITION BY wid ORDER BY pos)
        ) p LEFT JOIN merges m ON m.l = p.tok AND m.r = p.nxt
    ) WHERE best IS NOT NULL AND before IS DISTINCT FROM best % 1048576
)
SELECT wid, list(tok ORDER BY pos) AS toks
FROM (SELECT wid, pos, tok, it, max(it) OVER (PARTITION BY wid) AS last FROM step) WHERE it = last
GROUP BY wid
"""

#: The same for long words, where one step contracts every place of the minimum-rank pair (runs of overlapping places
#: from the left), which gives the same tokens: a new pair never has a lower rank than the one it was made by. The query
#: ends after 64 steps, so that the rows of all steps fit in memory, and goes on from there for words not yet done.
CONTRACT_LONG = """
WITH RECURSIVE step AS (
    SELECT wid, pos, tok, 0 AS it FROM letters
    UNION ALL
    SELECT wid, pos, tok, it FROM (
        SELECT wid, pos, it + 1 AS it, CASE WHEN start THEN fresh ELSE tok END AS tok,
               lag(start, 1, false) OVER (PARTITION BY wid ORDER BY pos) AS eaten
        FROM (
            SELECT wid, pos, tok, it, fresh,
                   hit AND (row_number() OVER (PARTITION BY wid, isle ORDER BY pos)) % 2 = 1 AS start
            FROM (
                SELECT *, count(*) FILTER (NOT hit) OVER (PARTITION BY wid ORDER BY pos ROWS UNBOUNDED PRECEDING) * 2 + hit::INT AS isle
                FROM (
                    SELECT *, coalesce(prio = best, false) AS hit
                    FROM (
                        SELECT p.wid, p.pos, p.tok, p.it, m.fresh, m.prio, min(m.prio) OVER (PARTITION BY p.wid) AS best
                        FROM (SELECT wid, pos, tok, it, lead(tok) OVER (PARTITION BY wid ORDER BY pos) AS nxt FROM step WHERE it < 64) p
                        LEFT JOIN merges m ON m.l = p.tok AND m.r = p.nxt
                    ) WHERE best IS NOT NULL
                )
            )
        )
    ) WHERE NOT eaten
)
SELECT wid, list(tok ORDER BY pos) AS toks, max(it) AS steps
FROM (SELECT wid, pos, tok, it, max(it) OVER (PARTITION BY wid) AS last FROM step) WHERE it = last
GROUP BY wid
"""

LONG = 48
#: Bytes from which a word is encoded in segments, and half the width of the windows over their borders at first.
SEGMENT, WINDOW = 512, 64


def byte_letters() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies: visible Latin-1 stays, the rest moves above 255."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, moved = [], 0
    for b in range(256):
        out.append(chr(b if b in visible else 256 + moved))
        moved += b not in visible
    return out


class DuckEncoder:
    """Token ids of pieces of text. Distinct words meet the merge table once per cache life; the cache is bounded."""

    def __init__(self, vocabulary: str = VOCABULARY, cache: int = 200_000):
        import duckdb
        import regex

        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = np.array([(vocab[a], vocab[b], i, vocab[a + b]) for i, (a, b) in enumerate(pairs)], np.int32)
        #: Whether every token is made by one merge only: then all places of a pair may be contracted in one step.
        self.unambiguous = len(np.unique(ids[:, 3])) == len(ids)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})  # nothing on local disks
        self.con.register("m", pa.table({k: pa.array(ids[:, i]) for i, k in enumerate(("l", "r", "prio", "fresh"))}))
        self.con.execute("CREATE TABLE merges AS SELECT * FROM m")
        self.con.unregister("m")
        letters = byte_letters()
        self.byte_ids = np.array([vocab[c] for c in letters], np.int32)
        byte = {c: b for b, c in enumerate(letters)}
        made = {*letters, *(a + b for a, b in pairs)}
        self.bytes_of = {i: bytes(byte[c] for c in t) for t, i in vocab.items() if t in made}
        self.words, self.split, self.most = regex.compile(WORDS), regex.compile(PIECE), cache
        self.reset()

    def reset(self) -> None:
        self.word_tokens: dict[str, np.ndarray] = {}
        self.piece_at: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.sizes: list[int] = []

    def contract(self, words: list[str], block: int = 400_000) -> None:
        """Run the recursive contraction for words not seen before, short and long ones apart, in blocks of bounded size.

        Long words contract all places of their best pair in a step, which gives the same tokens if the vocabulary is
        unambiguous; in one that is not, they go the way of short ones."""
        raws = [(w, w.encode("utf-8", "surrogatepass")) for w in words]
        for w, raw in raws:
            if len(raw) > SEGMENT:
                self.word_tokens[w] = self.stitched(raw)
        self.contract_all([r for r in raws if len(r[1]) <= SEGMENT], block)

    def contract_all(self, raws: list[tuple], block: int = 400_000) -> None:
        for query, part in ((CONTRACT, [r for r in raws if len(r[1]) <= LONG or not self.unambiguous]), (CONTRACT_LONG, [r for r in raws if len(r[1]) > LONG and self.unambiguous])):
            at = 0
            while at < len(part):
                group, size = [], 0
                while at < len(part) and (not group or size < block):
                    group.append(part[at])
                    size += len(part[at][1])
                    at += 1
                self.contract_block(query, group)

    def tokens_of(self, parts: list[bytes]) -> list[np.ndarray]:
        """Tokens of byte strings, each by itself."""
        fresh = sorted({p for p in parts if p not in self.word_tokens}, key=len)
        self.contract_all([(p, p) for p in fresh])
        return [self.word_tokens[p] for p in parts]

    def stitched(self, raw: bytes) -> np.ndarray:
        """Tokens of one long word: segments are encoded apart, and so are windows over their borders.

        A row of tokens is the encoding of its bytes if and only if every two neighbours are the encoding of theirs. So
        the tokens of a segment go on as those of the window where both have a border and the two tokens at it are such
        neighbours, and in the same way back behind the border. Where there is no such place the windows are widened; a
        word that has none even then is contracted whole.
        """
        starts = list(range(0, len(raw), SEGMENT))
        cuts = starts[1:]
        segments = self.tokens_of([raw[a : a + SEGMENT] for a in starts])
        ends = [a + np.cumsum([len(self.bytes_of[t]) for t in seg.tolist()]) for a, seg in zip(starts, segments)]
        joints: dict[int, tuple] = {}
        half = WINDOW
        while half <= SEGMENT // 2 and len(joints) < len(cuts):
            open_cuts = [c for c in cuts if c not in joints]
            windows = self.tokens_of([raw[c - half : c + half] for c in open_cuts])
            offers = []
            for c, win in zip(open_cuts, windows):
                k = c // SEGMENT
                stops = c - half + np.cumsum([len(self.bytes_of[t]) for t in win.tolist()])
                begins = np.concatenate(([c - half], stops[:-1]))
                left = [(x, int(segments[k - 1][i]), int(win[j])) for x, i, j in zip(*np.intersect1d(ends[k - 1], begins, return_indices=True)) if x <= c][::-1]
                first = np.concatenate(([c], ends[k][:-1]))
                right = [(y, int(win[j]), int(segments[k][i])) for y, i, j in zip(*np.intersect1d(first, stops, return_indices=True)) if y >= c]
                offers.append((c, win, begins, left, right))
            self.tokens_of([self.bytes_of[a] + self.bytes_of[b] for *_, l, r in offers for _, a, b in (*l, *r)])
            for c, win, begins, left, right in offers:
                x = next((x for x, a, b in left if self.neighbours(a, b)), None)
                y = next((y for y, a, b in right if self.neighbours(a, b)), None)
                if x is not None and y is not None:
                    joints[c] = (x, y, win[(begins >= x) & (begins < y)])
            half *= 2
        if len(joints) < len(cuts):
            self.contract_all([(raw, raw)])
            return self.word_tokens[raw]
        out, at = [], 0
        for k, seg in enumerate(segments):
            begins = np.concatenate(([starts[k]], ends[k][:-1]))
            stop = joints[cuts[k]][0] if k < len(cuts) else len(raw)
            out.append(seg[(begins >= at) & (begins < stop)])
            if k < len(cuts):
                _, at, window = joints[cuts[k]]
                out.append(window)
        return np.concatenate(out)

    def neighbours(self, a: int, b: int) -> bool:
        """Are the two tokens the encoding of their bytes?"""
        return self.word_tokens[self.bytes_of[a] + self.bytes_of[b]].tolist() == [a, b]

    def contract_block(self, query: str, group: list[tuple[str, bytes]]) -> None:
        words = [w for w, _ in group]
        states = [self.byte_ids[np.frombuffer(raw, np.uint8)] for _, raw in group]
        while words:
            lengths = np.array([len(x) for x in states], np.int64)
            wid = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
            pos = np.arange(len(wid), dtype=np.int64) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            self.con.register("letters", pa.table({"wid": wid, "pos": pos.astype(np.int32), "tok": np.concatenate(states)}))
            done = self.con.sql(query).to_arrow_table()
            self.con.unregister("letters")
            toks = done["toks"].combine_chunks()
            values, ends = toks.values.to_numpy(zero_copy_only=False).astype(np.int32), toks.offsets.to_numpy()
            steps = done["steps"].to_numpy() if "steps" in done.column_names else np.zeros(len(toks), np.int32)
            after, unfinished = [], []
            for i, (w, n) in enumerate(zip(done["wid"].to_numpy(), steps)):
                out = values[ends[i] : ends[i + 1]]
                if n >= 64:
                    after.append(words[w])
                    unfinished.append(out)
                else:
                    self.word_tokens[words[w]] = out
            words, states = after, unfinished

    def learn(self, pieces: list[str]) -> None:
        """Fill the caches for new pieces; a piece not at the start of its text stands for itself behind a space."""
        cut = [self.words.findall(p[1:] if p[0] == FIRST else " " + p) for p in pieces]
        fresh = list({w for ws in cut for w in ws} - self.word_tokens.keys())
        if fresh:
            self.contract(fresh)
        for p, ws in zip(pieces, cut):
            toks = [self.word_tokens[w] for w in ws]
            arr = toks[0] if len(toks) == 1 else np.concatenate(toks) if toks else np.empty(0, np.int32)
            self.piece_at[p] = len(self.sizes)
            self.keep(arr)
            self.sizes.append(len(arr))

    def keep(self, arr: np.ndarray) -> None:
        """Put tokens behind those kept so far, in a buffer that doubles, so that a batch copies only what is new."""
        end = self.used + len(arr)
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(max(end, 2 * len(self.flat)) - self.used, np.int32)])
        self.flat[self.used : end] = arr
        self.used = end

    def pieces(self, text: str) -> list[str]:
        """The text cut before every space that a visible character follows; these spaces are left out."""
        if text.isascii() and not any(x in text for x in BLANKS) and text[-1] != " ":
            out = text.split(" ")
        else:
            out = self.split.split(text)
        out[0] = FIRST + out[0]
        return out

    def encode(self, texts: list[str | None], counts_only: bool = False):
        """Flat ids and the number of tokens of each text (ids are None if only counts are asked for)."""
        if len(self.piece_at) > self.most or len(self.word_tokens) > self.most:
            self.reset()
        docs = [self.pieces(t) if t else [] for t in texts]
        known = self.piece_at
        fresh = list(set(chain.from_iterable(docs)) - known.keys())
        if fresh:
            self.learn(fresh)
        at = np.fromiter(map(known.__getitem__, chain.from_iterable(docs)), np.int64)
        sizes = np.array(self.sizes, np.int64)
        per = sizes[at] if len(at) else np.empty(0, np.int64)
        doc_of = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        counts = np.bincount(doc_of, per, len(docs)).astype(np.int64) if len(at) else np.zeros(len(docs), np.int64)
        if counts_only:
            return None, counts
        if not len(at):
            return np.empty(0, np.int32), counts
        starts = (np.cumsum(sizes) - sizes)[at]
        out = self.flat[np.arange(per.sum()) + np.repeat(starts - (np.cumsum(per) - per), per)]
        return out, counts


_CODERS: dict[str, DuckEncoder] = {}


def coder(vocabulary: str) -> DuckEncoder:
    """The encoder of this Python worker, kept from task to task with its caches."""
    if vocabulary not in _CODERS:
        _CODERS[vocabulary] = DuckEncoder(vocabulary)
    return _CODERS[vocabulary]


def encode_corpus(documents: DataFrame, vocabulary: str = VOCABULARY, batch: int = 2_000_000) -> DataFrame:
    """``(doc_id, ids)`` of every row of ``documents``: ids by the byte-level vocabulary, special tokens as plain text.

    Null and empty texts both give an empty list; blank texts are encoded like any other; rows repeated in the input
    give repeated rows; other columns are neither read nor kept. Long texts are encoded whole. Texts go to DuckDB in
    batches of about ``batch`` characters; there every distinct word starts as one row per byte, each recursion step
    joins neighbouring tokens to the merge table and contracts each word's minimum-rank pair from the left, until no
    word has a pair left. No shuffle takes place.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = coder(vocabulary)
        for rb in batches:
            for ids, texts in grouped(rb, batch):
                flat, counts = enc.encode(texts)
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([ids, lists], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def token_counts(documents: DataFrame, columns: list[str], vocabulary: str = VOCABULARY, batch: int = 2_000_000) -> DataFrame:
    """``columns`` and ``tokens`` (BIGINT, 0 for null or empty texts) of every row, by the same encoder."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*columns).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = coder(vocabulary)
        for rb in batches:
            at = 0
            for ids, texts in grouped(rb, batch):
                _, counts = enc.encode(texts, counts_only=True)
                part = rb.slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(columns))], pa.array(counts)], [*columns, "tokens"])

    return documents.select(*columns, "text").mapInArrow(run, f"{fields}, tokens bigint")


def grouped(rb: pa.RecordBatch, most: int) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Slices of a batch whose texts together hold about ``most`` characters: first column and texts (last column)."""
    texts = rb.column(rb.num_columns - 1).to_pylist()
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most or i == len(texts) - 1:
            yield rb.column(0).slice(start, i + 1 - start), texts[start : i + 1]
            start, size = i + 1, 0
