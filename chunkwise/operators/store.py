"""A chunk store of appended segments on Parquet, and the plans behind ingest, reingest, delete, list and status."""

from __future__ import annotations

import functools
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwise.commits import CommitLog, Conflict
from chunkwise.functions import tokens
from chunkwise.functions.text import content_hash
from chunkwise.operators import search
from chunkwise.session import persist_table, shuffles_removed

CHUNK_SCHEMA = (
    "chunk_id STRING, source STRING, mtime BIGINT, chunk_index INT, content STRING, content_hash STRING, ingest_time BIGINT, "
    "heading_title STRING, heading_level INT, heading_path ARRAY<STRING>, extra MAP<STRING,STRING>, vector ARRAY<FLOAT>"
)
DAY_MS = 24 * 3600 * 1000


def _figures(chunks: DataFrame, *more) -> DataFrame:
    return chunks.groupBy("source").agg(
        F.count(F.lit(1)).alias("chunks"), F.max("mtime").alias("mtime"), F.max("ingest_time").alias("ingest_time"), F.min("content_hash").alias("content_hash"), *more
    )


def source_stats(chunks: DataFrame) -> DataFrame:
    """``(source, chunks, mtime, ingest_time, content_hash)`` per source; vectors and texts are not read.

    The hash is the smallest non-null one, so the result does not depend on row order. Null sources are left out.
    """
    return _figures(chunks.where("source IS NOT NULL"))


def staleness(state: DataFrame, probe: DataFrame, now_ms: int, threshold_ms: int = DAY_MS) -> DataFrame:
    """``state`` with ``status``: URLs are current while ``ingest_time > 0`` is younger than the threshold, files while the
    probed ``current_mtime`` equals the stored one; everything else, vanished files too, is STALE."""
    seen = probe.groupBy(F.col("source").alias("_s")).agg(F.max("current_mtime").alias("current_mtime"))
    joined = state.join(seen, F.col("source") == F.col("_s"), "left").drop("_s")
    url = F.col("source").rlike("^https?://")
    fresh = F.when(url, (F.coalesce("ingest_time", F.lit(0)) > 0) & (F.lit(now_ms) - F.col("ingest_time") < threshold_ms)).otherwise(F.col("current_mtime") == F.col("mtime"))
    return joined.withColumn("status", F.when(F.coalesce(fresh, F.lit(False)), "CURRENT").otherwise("STALE"))


def unchanged(scan: DataFrame, state: DataFrame) -> DataFrame:
    """``scan`` with ``unchanged``: equal non-zero mtime, or equal hash (nulls never match)."""
    st = state.select(F.col("source").alias("_s"), F.col("mtime").alias("_m"), F.col("content_hash").alias("_h"))
    j = scan.join(st, F.col("source") == F.col("_s"), "left")
    same = ((F.col("mtime") != 0) & (F.col("mtime") == F.col("_m"))) | (F.col("content_hash") == F.col("_h"))
    return j.withColumn("unchanged", F.coalesce(same, F.lit(False))).drop("_s", "_m", "_h")


def ingest_plan(scan: DataFrame, state: DataFrame) -> DataFrame:
    """``(source, action)``: ``failed`` (status 400 and up), ``skip`` (mtime or hash unchanged), ``add``, ``update``."""
    known = state.select(F.col("source").alias("_k"))
    rows = unchanged(scan, state).join(known, F.col("source") == F.col("_k"), "left")
    action = F.when(F.coalesce("status_code", F.lit(0)) >= 400, "failed").when(F.col("unchanged"), "skip").when(F.col("_k").isNull(), "add").otherwise("update")
    return rows.withColumn("action", action).drop("_k", "unchanged")


def reingest_plan(state: DataFrame, scan: DataFrame, now_ms: int, threshold_ms: int = DAY_MS, everything: bool = False) -> DataFrame:
    """``(source, status, action)`` for stored sources: ``keep``, ``skip`` (vanished file, failed fetch), ``touch`` (URL with
    the same hash: only its ingest time moves on) or ``replace``."""
    s = staleness(state, scan.select("source", F.col("mtime").alias("current_mtime")), now_ms, threshold_ms)
    seen = scan.select(F.col("source").alias("_s"), F.col("content_hash").alias("_h"), F.col("status_code").alias("_c"), F.lit(True).alias("_there"))
    j = s.join(seen, F.col("source") == F.col("_s"), "left")
    url = F.col("source").rlike("^https?://")
    gone = F.col("_there").isNull() | (F.coalesce("_c", F.lit(0)) >= 400)
    action = F.when((F.col("status") == "CURRENT") & F.lit(not everything), "keep").when(gone, "skip").when(url & F.coalesce(F.col("_h") == F.col("content_hash"), F.lit(False)), "touch").otherwise("replace")
    return j.select("source", "status", action.alias("action"))


def with_provenance(pieces: DataFrame, sources: DataFrame) -> DataFrame:
    """Chunk rows from ``pieces(source, chunk_index, content, ...)`` and ``sources(source, mtime, content_hash, ingest_time)``."""
    rows = pieces.join(sources.select("source", "mtime", "content_hash", "ingest_time"), "source")
    return rows.withColumn("chunk_id", F.concat("source", F.lit("#"), F.col("chunk_index").cast("string")))


def hashed_vector(text, dim: int = 64):
    """Default embedder: signed hashing of words to ``dim`` buckets, unit length; empty texts give zeros. Native."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    zero = F.array_repeat(F.lit(0.0), dim)
    at = lambda w: (F.pmod(F.xxhash64(w), F.lit(dim)) + 1).cast("int")
    sign = lambda w: F.when(F.pmod(F.xxhash64(w, F.lit(7)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    counts = F.aggregate(words, zero, lambda v, w: F.transform(v, lambda x, i: F.when(i + 1 == at(w), x + sign(w)).otherwise(x)))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(counts, lambda x: (x / norm).cast("float"))).otherwise(F.transform(zero, lambda x: x.cast("float")))


def embed(df: DataFrame, text_col: str, embedder=None, dim: int = 64) -> DataFrame:
    """``df`` with ``vector``. ``embedder(list[str]) -> list[list[float]]`` runs on Arrow batches; default: hashed words."""
    if embedder is None:
        return df.withColumn("vector", hashed_vector(F.col(text_col), dim))

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(embedder(texts.fillna("").tolist())))

    return df.withColumn("vector", run(text_col))


def by_bucket(texts: DataFrame, buckets: int) -> DataFrame:
    """``(bucket, chunk_id, source, dl, terms, tfs)`` of ``texts(chunk_id, source, terms, buckets)``: the distinct terms of a
    chunk in one row per bucket, so that ids and sources go through the shuffle once a bucket and not once a term."""
    def run(batches):
        for rb in batches:
            coded = pc.list_flatten(rb["terms"]).dictionary_encode()
            word, most = coded.indices.to_numpy(), max(1, len(coded.dictionary))
            bucket = np.zeros(most, np.int64)
            bucket[word] = pc.list_flatten(rb["buckets"]).to_numpy()
            key, tf = np.unique(pc.list_parent_indices(rb["terms"]).to_numpy().astype(np.int64) * most + word, return_counts=True)
            row, word = np.divmod(key, most)
            cell = row * buckets + bucket[word]
            by = np.argsort(cell, kind="stable")
            cells, first = np.unique(cell[by], return_index=True)
            ends = pa.array(np.r_[first, len(cell)].astype(np.int32))
            row = pa.array(cells // buckets)
            lists = [pa.ListArray.from_arrays(ends, x) for x in (coded.dictionary.take(pa.array(word[by])), pa.array(tf[by]))]
            yield pa.RecordBatch.from_arrays([pa.array((cells % buckets).astype(np.int32)), rb["chunk_id"].take(row), rb["source"].take(row), pc.list_value_length(rb["terms"]).take(row), *lists], ["bucket", "chunk_id", "source", "dl", "terms", "tfs"])

    return texts.mapInArrow(run, "bucket int, chunk_id string, source string, dl int, terms array<string>, tfs array<bigint>")


NOTHING: dict = {"dim": None, "segments": [], "dead": [], "touched": []}


class Store:
    """Chunks in segments that are written once, and a log of commits that says which segments and tombstones count.

    A commit adds a segment (chunks, their postings, one row of figures per source), a list of sources whose older rows
    are dead, or a list of sources whose ingest time moved on. So a change writes about as much as it changes, readers
    see whole commits and never lock, and what a writer that died has left is named by no commit. Writers that come at
    the same time follow one another: a commit that another writer was first with is made again behind it, without
    writing its data again (:class:`chunkwise.commits.CommitLog`). :meth:`compact` rewrites the live rows as one segment,
    by itself when there are more than ``most_segments``; :meth:`vacuum` removes what no commit names.

    Postings lie in ``buckets`` folders by the hash of the term, sorted by term, so that a search reads the folders of
    its terms only; figures per source give document counts and mean length without reading texts.
    """

    def __init__(self, spark: SparkSession, path: str, dim: int | None = None, retry_ms: int = 100, timeout_s: float = 30.0, buckets: int = 16, most_segments: int = 32):
        self.spark, self.path, self.dim, self.retry_ms, self.timeout_s, self.buckets, self.most_segments = spark, path.rstrip("/"), dim, retry_ms, timeout_s, buckets, most_segments
        self.log = CommitLog(spark, path)
        have = self.manifest()["dim"]
        if dim and have and dim != have:
            raise ValueError(f"store has vectors of {have} dimensions, not {dim}")

    def manifest(self) -> dict:
        """The last commit: dimension, and folders of segments, tombstones and moved ingest times with their commits."""
        return {**NOTHING, **self.log.last()[1]}

    def exists(self) -> bool:
        return self.log.head() >= 0

    def _read(self, kind: str, part: str, schema: str, m: dict | None = None) -> DataFrame | None:
        """Rows of all folders of a kind with the number of their commit as ``_n``; None if there are no folders."""
        folders = (m or self.manifest())[kind]
        if not folders:
            return None
        number = F.create_map(*[F.lit(x) for f in folders for x in (f["folder"], f["commit"])])
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/{f['folder']}{part}" for f in folders])
        return rows.withColumn("_n", F.element_at(number, F.regexp_extract("_metadata.file_path", r"((?:seg|dead|touched)-[0-9a-f]{32})", 1)))

    def _live(self, rows: DataFrame, m: dict) -> DataFrame:
        """Rows whose source no later commit has replaced or deleted; rows with a null source stay."""
        dead = self._read("dead", "", "source STRING", m)
        if dead is None:
            return rows
        gone = dead.groupBy(F.col("source").alias("_s")).agg(F.max("_n").alias("_gone"))
        return rows.join(gone, F.col("source") == F.col("_s"), "left").where("_gone IS NULL OR _n >= _gone").drop("_s", "_gone")

    def _moved(self, rows: DataFrame, m: dict) -> DataFrame:
        """Rows with the ingest time a later commit has moved on."""
        touched = self._read("touched", "", "source STRING, ingest_time BIGINT", m)
        if touched is None:
            return rows
        t = touched.groupBy(F.col("source").alias("_s")).agg(F.max_by(F.struct(F.col("_n").alias("n"), "ingest_time"), F.struct("_n", "ingest_time")).alias("_t"))
        joined = rows.join(t, F.col("source") == F.col("_s"), "left")
        return joined.withColumn("ingest_time", F.when(F.col("_t.n") > F.col("_n"), F.col("_t.ingest_time")).otherwise(F.col("ingest_time"))).drop("_s", "_t")

    def _chunks(self, m: dict) -> DataFrame:
        rows = self._read("segments", "/chunks", CHUNK_SCHEMA, m)
        return self.spark.createDataFrame([], CHUNK_SCHEMA) if rows is None else self._moved(self._live(rows, m), m).drop("_n")

    def chunks(self) -> DataFrame:
        return self._chunks(self.manifest())

    def _segment(self, chunks: DataFrame) -> str:
        """Write chunks, sorted by source so that lookups by source skip files, their postings and figures per source."""
        folder = f"seg-{uuid.uuid4().hex}"
        schema = self.spark.createDataFrame([], CHUNK_SCHEMA).schema
        have = set(chunks.columns)
        full = chunks.withColumns({f.name: F.lit(None) for f in schema if f.name not in have}).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
        with shuffles_removed(self.spark):
            full.repartitionByRange("source", "chunk_index").sortWithinPartitions("source", "chunk_index").write.parquet(f"{self.path}/{folder}/chunks")
        rows = self.spark.read.schema(CHUNK_SCHEMA).parquet(f"{self.path}/{folder}/chunks")
        texts = rows.where("chunk_id IS NOT NULL AND content IS NOT NULL").select("chunk_id", "source", tokens.standard("content").alias("terms"))
        lists = by_bucket(texts.withColumn("buckets", F.transform("terms", self._bucket)), self.buckets).repartition("bucket")
        posts = lists.select("chunk_id", "source", "dl", "bucket", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("bucket", F.col("x.terms").alias("term"), "chunk_id", "source", F.col("x.tfs").alias("tf"), "dl")
        posts = posts.dropDuplicates(["bucket", "term", "chunk_id"]).sortWithinPartitions("bucket", "term", "chunk_id")  # repeated rows of a chunk lie together now
        with shuffles_removed(self.spark):
            posts.write.partitionBy("bucket").parquet(f"{self.path}/{folder}/postings")
        written = self.spark.read.schema("chunk_id STRING, source STRING, dl INT, tf BIGINT").parquet(f"{self.path}/{folder}/postings")
        size = written.groupBy(F.col("source").alias("_s")).agg(F.count_distinct("chunk_id").alias("docs"), F.sum("tf").alias("terms"))
        figures = _figures(rows, F.sum(F.octet_length("content")).alias("bytes")).join(size, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        figures.write.parquet(f"{self.path}/{folder}/sources")
        return folder

    def _bucket(self, term):
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _list(self, kind: str, rows: DataFrame) -> str:
        folder = f"{kind}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return folder

    def _commit(self, **added: str) -> None:
        """Commit folders of the given kinds behind whatever was committed meanwhile."""
        def make(n: int, entry: dict) -> dict:
            e = {**NOTHING, **entry, "dim": self.dim or entry.get("dim")}
            return {k: [*v, {"folder": added[k], "commit": n}] if k in added else v for k, v in e.items()}

        self.log.change(make, self.retry_ms, self.timeout_s)
        if len(self.manifest()["segments"]) > self.most_segments:
            self.compact()

    def compact(self, tries: int = 5) -> None:
        """Rewrite the live rows as one segment without tombstones. If another writer commits meanwhile, again."""
        for _ in range(tries):
            n, entry = self.log.last()
            folder = self._segment(self._chunks({**NOTHING, **entry}))
            try:
                self.log.commit(n + 1, {**NOTHING, "dim": entry.get("dim"), "segments": [{"folder": folder, "commit": n + 1}]})
                return
            except Conflict:
                self.log.remove(folder)
        raise Conflict(f"{tries} rewrites lost against other writers")

    def vacuum(self) -> list[str]:
        """Remove the folders that the last commit does not name; only when no reader of an older state or writer is at work."""
        m = self.manifest()
        named = {f["folder"] for k in ("segments", "dead", "touched") for f in m[k]} | {CommitLog.FOLDER}
        gone = [n for n in self.log.names() if n not in named]
        for n in gone:
            self.log.remove(n)
        return gone

    FIGURES = "source STRING, chunks BIGINT, mtime BIGINT, ingest_time BIGINT, content_hash STRING, bytes BIGINT, docs BIGINT, terms BIGINT"

    def figures(self) -> DataFrame:
        """One row per live source and segment: chunks, times, hash, bytes, documents with a term and number of terms."""
        m = self.manifest()
        rows = self._read("segments", "/sources", self.FIGURES, m)
        return self.spark.createDataFrame([], self.FIGURES) if rows is None else self._moved(self._live(rows, m), m).drop("_n")

    def state(self) -> DataFrame:
        """As :func:`source_stats`, from the figures written with the segments; no chunk is read."""
        return self.figures().where("source IS NOT NULL").groupBy("source").agg(F.sum("chunks").alias("chunks"), F.max("mtime").alias("mtime"), F.max("ingest_time").alias("ingest_time"), F.min("content_hash").alias("content_hash"))

    def upsert(self, chunks: DataFrame, append: bool = False) -> None:
        """Replace the chunks of every source in ``chunks``; with ``append`` old chunks stay beside the new ones."""
        folder = self._segment(chunks)
        if append or not self.manifest()["segments"]:
            return self._commit(segments=folder)
        sources = self.spark.read.schema("source STRING").parquet(f"{self.path}/{folder}/sources")
        self._commit(segments=folder, dead=self._list("dead", sources.where("source IS NOT NULL")))

    def ingest(self, sources: DataFrame, chunk, now_ms: int = 0, embedder=None) -> dict:
        """Ingest ``sources(source, mtime, text[, status_code])``; ``chunk(DataFrame) -> (source, chunk_index, content, ...)``.

        Counts: sources added or replaced, chunks made, sources skipped (unchanged) or failed. Sources whose text gives
        no chunk are ``empty`` and leave the store alone. Hashes are taken only where the mtime differs.
        """
        return self._ingest(sources, "text", lambda todo: chunk(todo.select("source", "text")), now_ms, embedder)

    def ingest_paths(self, paths: list[str], size: int = 1000, tokens: str = "bpe", now_ms: int = 0, embedder=None, fetcher=None) -> dict:
        """Scan files, folders and URLs, read every format to chunks, embed and store them; counts as :meth:`ingest`, with
        the list of ``missing`` paths. Files that cannot be read give no chunk and count as ``empty``."""
        from chunkwise.sources import files

        there, urls, missing = files.expand(paths)
        found = files.collected(self.spark, there, urls, fetcher)

        def chunk(todo: DataFrame) -> DataFrame:
            return files.read_files(todo, size, tokens).where("status = 'ok'").drop("status")

        return {**self._ingest(found, "content", chunk, now_ms, embedder), "missing": missing}

    def _ingest(self, sources: DataFrame, body: str, chunk, now_ms: int, embedder) -> dict:
        state = self.state()
        known = state.select(F.col("source").alias("_s"), F.col("mtime").alias("_m"))
        status = F.col("status_code") if "status_code" in sources.columns else F.lit(None).cast("int")
        src = sources.withColumn("status_code", status).dropDuplicates(["source"])
        new = src.join(known, (F.col("source") == F.col("_s")) & (F.col("mtime") == F.col("_m")) & (F.col("mtime") != 0), "left_anti")
        plan = ingest_plan(new.withColumn("content_hash", content_hash(body)), state)
        counts = {r["action"]: r["n"] for r in plan.groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()}
        total = src.count()
        todo = plan.where("action IN ('add', 'update')")
        url = F.col("source").rlike("^https?://")
        made = {"c": 0, "s": 0}
        if counts.get("add", 0) + counts.get("update", 0):
            pieces = embed(chunk(todo), "content", embedder)
            rows = persist_table(with_provenance(pieces, todo.withColumn("ingest_time", F.when(url, F.lit(now_ms).cast("bigint")))), "ingest")
            made = rows.agg(F.count(F.lit(1)).alias("c"), F.count_distinct("source").alias("s")).first()
            if made["c"]:
                self.upsert(rows)
        done = counts.get("add", 0) + counts.get("update", 0)
        return {"ingested": made["s"], "chunks": made["c"], "skipped": total - done - counts.get("failed", 0), "failed": counts.get("failed", 0), "empty": done - made["s"]}

    def touch(self, sources: DataFrame, now_ms: int) -> None:
        """Set only the ingest time of the chunks of ``sources``; everything else stays."""
        self._commit(touched=self._list("touched", sources.select("source", F.lit(now_ms).cast("bigint").alias("ingest_time")).where("source IS NOT NULL").distinct()))

    def reingest(self, sources: DataFrame, chunk, now_ms: int, threshold_ms: int = DAY_MS, everything: bool = False) -> dict:
        """Look at every stored source again and do what :func:`reingest_plan` says; ``stale`` is null if ``everything``."""
        scan = sources.withColumn("content_hash", content_hash("text")).withColumn("status_code", F.col("status_code") if "status_code" in sources.columns else F.lit(None).cast("int"))
        plan = persist_table(reingest_plan(self.state(), scan, now_ms, threshold_ms, everything), "reingest-plan")
        counts = {r["action"]: r["n"] for r in plan.groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()}
        stale = None if everything else plan.where("status = 'STALE'").count()
        made = 0
        if counts.get("replace"):
            todo = scan.join(plan.where("action = 'replace'").select("source"), "source", "left_semi")
            url = F.col("source").rlike("^https?://")
            rows = persist_table(with_provenance(embed(chunk(todo.select("source", "text")), "content"), todo.withColumn("ingest_time", F.when(url, F.lit(now_ms).cast("bigint")))), "ingest")
            made = rows.count()
            if made:
                self.upsert(rows)
        if counts.get("touch"):
            self.touch(plan.where("action = 'touch'").select("source"), now_ms)
        return {"stale": stale, "reingested": counts.get("replace", 0), "chunks": made, "touched": counts.get("touch", 0), "skipped": counts.get("skip", 0)}

    def delete(self, sources: list[str]) -> dict[str, int]:
        """Removed chunks per source; 0 for sources that are not stored."""
        counts = {r["source"]: r["chunks"] for r in self.state().where(F.col("source").isin(*sources)).select("source", "chunks").collect()}
        if counts:
            self.delete_all(self.spark.createDataFrame([(s,) for s in counts], "source string"))
        return {s: counts.get(s, 0) for s in sources}

    def delete_all(self, sources: DataFrame) -> None:
        """Delete the sources of a table, however many."""
        self._commit(dead=self._list("dead", sources.select("source").where("source IS NOT NULL").distinct()))

    def drop_all(self) -> None:
        self.log.change(lambda n, e: {**NOTHING, "dim": self.dim or e.get("dim")}, self.retry_ms, self.timeout_s)

    def list(self, probe: DataFrame, now_ms: int, threshold_ms: int = DAY_MS) -> DataFrame:
        return staleness(self.state(), probe, now_ms, threshold_ms).select("source", "chunks", "mtime", "content_hash", "status").orderBy("source")

    def status(self, probe: DataFrame, now_ms: int, threshold_ms: int = DAY_MS) -> DataFrame:
        """One row as :func:`totals`, with the ``bytes`` of all texts."""
        size = self.figures().agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
        return totals(staleness(self.state(), probe, now_ms, threshold_ms)).join(F.broadcast(size))  # one row each

    def show(self, source: str) -> DataFrame:
        return self.chunks().where(F.col("source") == source).orderBy("chunk_index")

    def chunk(self, source: str, index: int, window: int = 0) -> DataFrame:
        """A chunk and up to ``window`` chunks before and behind it; ``LookupError`` if there is no such chunk."""
        rows = search.chunk_range(self.chunks(), source, index, window)
        if rows.isEmpty():
            raise LookupError(f"no chunk {index} of {source}")
        return rows

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """``(term, chunk_id, tf, dl, part)`` of live chunks, of the given ``terms(term, id)`` only, with their ``id``; ``part`` is the commit of the segment."""
        m = self.manifest()
        schema = "term STRING, chunk_id STRING, source STRING, tf BIGINT, dl INT, bucket INT"
        each = [self.spark.read.schema(schema).parquet(f"{self.path}/{f['folder']}/postings").withColumn("_n", F.lit(f["commit"])) for f in m["segments"]]
        rows = functools.reduce(DataFrame.unionByName, each) if each else self.spark.createDataFrame([], schema).withColumn("_n", F.lit(0))
        if terms is not None:
            rows = rows.join(terms.withColumn("bucket", self._bucket("term")), ["bucket", "term"])
        return self._live(rows, m).select("term", "chunk_id", "tf", "dl", F.col("_n").alias("part"), *([] if terms is None else ["id"]))

    def search(self, queries: DataFrame, k: int = 5, mode: str = "hybrid", min_score: float = 0.0, rerank: bool = False, embedder=None, candidates: int = 25) -> DataFrame:
        """``(query_id, rank, chunk_id, score, source, chunk_index, content)`` for ``queries(query_id, question[, qvec])``.

        ``mode`` is ``bm25`` (from the stored postings), ``embedding`` or ``hybrid``; questions without ``qvec`` are
        embedded. With ``rerank`` the best ``candidates`` are scored again. Null and blank questions give no rows.
        """
        q = queries.where(F.length(F.trim("question")) > 0)
        if "qvec" not in q.columns and mode != "bm25":
            q = embed(q, "question", embedder).withColumnRenamed("vector", "qvec")
        n = max(k, candidates) if rerank else k
        if mode == "bm25":
            hits = self._bm25(q, n, min_score)
        elif mode == "embedding":
            hits = search.knn(self.chunks(), q, n, min_score)
        elif mode == "hybrid":
            hits = search.fuse(self._bm25(q, 2 * n, min_score), search.knn(self.chunks(), q, 2 * n), n, min_score)
        else:
            raise ValueError(f"unknown search mode: {mode}")
        if rerank:
            hits = search.rerank(hits, q, self.chunks(), k)
        text = search.live_chunks(self.chunks().select("chunk_id", "source", "chunk_index", "content"))
        return hits.select("query_id", "rank", "chunk_id", "score").join(text, "chunk_id").select("query_id", "rank", "chunk_id", "score", "source", "chunk_index", "content")

    def _bm25(self, q: DataFrame, k: int, min_score: float) -> DataFrame:
        """Postings of the terms of the questions are brought together by chunk, then scored as those of any chunks."""
        terms = search.question_terms(q).toArrow()
        vocabulary = pc.unique(terms["term"])
        known = self.spark.createDataFrame(pa.table({"term": vocabulary, "id": np.arange(len(vocabulary), dtype=np.int32)}), "term string, id int")
        rows = self.postings(known).select("chunk_id", "part", "dl", F.struct("id", F.col("tf").cast("int").alias("tf")).alias("x"))
        docs = rows.groupBy("chunk_id", "part").agg(F.first("dl").alias("dl"), F.collect_list("x").alias("xs"))
        docs = persist_table(docs.select("chunk_id", "dl", F.col("xs.id").alias("ids"), F.col("xs.tf").alias("tfs")), "bm25")
        stats = self.figures().agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n"), (F.sum("terms") / F.sum("docs")).alias("avgdl")).first()
        return search.ranked(docs, (stats["n"], stats["avgdl"]), search.figures(docs, len(vocabulary))[2], vocabulary, terms, k, min_score, repeats=True)

    def query(self, queries: DataFrame, k: int = 5, mode: str = "hybrid", chat=None, **more) -> DataFrame:
        """``(query_id, answer)``: the answers of ``chat(question, context)`` to the results; without one the context."""
        return search.answer(self.search(queries, k, mode, **more), queries, chat)


class Conversation:
    """Questions to a store one after the other; earlier turns are part of what ``chat(question, context, history)`` sees."""

    def __init__(self, store: Store, chat, k: int = 5, mode: str = "hybrid"):
        self.store, self.chat, self.k, self.mode, self.turns = store, chat, k, mode, []

    def ask(self, question: str) -> str:
        """The answer to one question; a blank question is a ``ValueError`` and no turn."""
        if not question or not question.strip():
            raise ValueError("a question must not be blank")
        q = self.store.spark.createDataFrame([(0, question)], "query_id long, question string")
        context = self.store.query(q, self.k, self.mode).first()["answer"]  # one question, k chunks
        said = self.chat(question, context, list(self.turns))
        self.turns.append((question, said))
        return said

    def reset(self) -> None:
        """Forget the earlier turns."""
        self.turns.clear()


def totals(listed: DataFrame) -> DataFrame:
    """One row: sources, chunks, latest mtime (0 if there is none) and stale sources."""
    return listed.agg(
        F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.max("mtime"), F.lit(0)).alias("last_mtime"), F.count_if(F.col("status") == "STALE").alias("stale")
    )


def missing_indexes(chunks: DataFrame) -> DataFrame:
    """``(source, after, before)``: gaps in the chunk indexes of a source."""
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy("chunk_index")
    rows = chunks.where("source IS NOT NULL AND chunk_index IS NOT NULL").select("source", "chunk_index").distinct()
    return rows.withColumn("before", F.lead("chunk_index").over(w)).where("before > chunk_index + 1").select("source", F.col("chunk_index").alias("after"), "before")


def latest_versions(chunks: DataFrame) -> DataFrame:
    """The newest row per (source, chunk_index): latest mtime, then larger id. Other versions are superseded."""
    key = F.struct("mtime", "chunk_id")
    return chunks.where("source IS NOT NULL AND chunk_index IS NOT NULL").groupBy("source", "chunk_index").agg(F.max_by("chunk_id", key).alias("chunk_id"), F.count_distinct("chunk_id").alias("versions"))
