"""Incremental processing over a ledger of processed sequence numbers kept as disjoint closed intervals."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkwise.commits import CommitLog, Conflict
from chunkwise.session import persist_table

INTERVALS = "lo BIGINT, hi BIGINT"
#: Numbers of a block in the join of rows with intervals: 2 ** BITS.
BITS = 16


def ranged(df: DataFrame, by: str, label: str) -> DataFrame:
    """``df`` as a table in ranges of ``by``, with ``blk``, the number of the range. Its rows grow with the partitions of
    the session only, so what is carried from range to range is one row per partition."""
    return persist_table(df.repartitionByRange(by).withColumn("blk", F.spark_partition_id()), label)


def carried(summary: DataFrame) -> DataFrame:
    """``(blk, before)``: the largest ``v`` of all earlier ranges; one row per range, to be broadcast."""
    w = Window.partitionBy(F.lit(0)).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition of the table
    return F.broadcast(summary.select("blk", F.max("v").over(w).alias("before")))


def merge_intervals(intervals: DataFrame) -> DataFrame:
    """Union of closed integer intervals ``(lo, hi)`` as maximal disjoint intervals; adjacent ones join.

    Repeated, nested and overlapping intervals are allowed; rows with a null bound or ``lo > hi`` are ignored; an empty
    input gives an empty ledger. A row begins an island if its ``lo`` lies behind the largest ``hi`` before it. That
    running maximum, and then the last beginning before each row, are taken within ranges of ``lo``, one per partition,
    and carried from range to range; no window sees the rows of more than one range.
    """
    clean = intervals.select(F.col("lo").cast("bigint").alias("lo"), F.col("hi").cast("bigint").alias("hi")).where("lo <= hi")
    clean = ranged(clean.groupBy("lo").agg(F.max("hi").alias("hi")), "lo", "intervals")
    before = Window.partitionBy("blk").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("blk").orderBy("lo").rowsBetween(Window.unboundedPreceding, 0)
    df = clean.withColumn("far", F.max("hi").over(before)).join(carried(clean.groupBy("blk").agg(F.max("hi").alias("v"))), "blk")
    far = F.greatest("far", "before")
    df = df.select("blk", "lo", "hi", F.when(far.isNull() | (F.col("lo") - 1 > far), F.col("lo")).alias("begin"))
    islands = df.withColumn("own", F.max("begin").over(upto)).join(carried(df.groupBy("blk").agg(F.max("begin").alias("v"))), "blk")
    return islands.groupBy(F.coalesce("own", "before").alias("lo")).agg(F.max("hi").alias("hi"))


def subtract_intervals(available: DataFrame, processed: DataFrame) -> DataFrame:
    """Parts of the ``available`` intervals that no ``processed`` interval covers, as disjoint intervals.

    Every boundary is an event; running sums within ranges of numbers, carried from range to range, say where only
    ``available`` covers. Both sides may overlap in themselves. Null or inverted intervals are ignored; if nothing is
    available the result is empty.
    """
    def events(df: DataFrame, a: int, p: int) -> DataFrame:
        m = df.select(F.col("lo").cast("bigint").alias("lo"), F.col("hi").cast("bigint").alias("hi")).where("lo <= hi")
        up = m.select(F.col("lo").alias("at"), F.lit(a).alias("a"), F.lit(p).alias("p"))
        return up.unionAll(m.select((F.col("hi") + 1).alias("at"), F.lit(-a).alias("a"), F.lit(-p).alias("p")))

    steps = ranged(events(available, 1, 0).unionAll(events(processed, 0, 1)).groupBy("at").agg(F.sum("a").alias("a"), F.sum("p").alias("p")), "at", "interval-events")
    w = Window.partitionBy("blk").orderBy("at")
    sums = steps.groupBy("blk").agg(F.struct(F.sum("a").alias("a"), F.sum("p").alias("p")).alias("s"), F.min("at").alias("first"))
    whole = Window.partitionBy(F.lit(0)).orderBy("blk")  # one row per partition of the table
    past = whole.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("blk", F.coalesce(F.sum("s.a").over(past), F.lit(0)).alias("a0"), F.coalesce(F.sum("s.p").over(past), F.lit(0)).alias("p0"), F.lead("first").over(whole).alias("next"))
    cover = steps.join(F.broadcast(sums), "blk").select("at", (F.sum("a").over(w) + F.col("a0")).alias("a"), (F.sum("p").over(w) + F.col("p0")).alias("p"), (F.coalesce(F.lead("at").over(w), F.col("next")) - 1).alias("hi"))
    return merge_intervals(cover.where("a > 0 AND p = 0 AND hi IS NOT NULL").select(F.col("at").alias("lo"), "hi"))


def cut(intervals: DataFrame, bits: int = BITS) -> DataFrame:
    """``(blk, lo, hi)``: intervals cut at the borders of blocks, one row per block they reach into."""
    blk = F.explode(F.sequence(F.shiftright("lo", bits), F.shiftright("hi", bits)))
    first = F.shiftleft("blk", bits)
    return intervals.select("lo", "hi", blk.alias("blk")).select("blk", F.greatest("lo", first).alias("lo"), F.least("hi", first + (1 << bits) - 1).alias("hi"))


def rows_in(df: DataFrame, seq: str, intervals: DataFrame, bits: int = BITS) -> DataFrame:
    """Rows of ``df`` whose ``seq`` lies in one of the disjoint ``intervals``; rows with a null ``seq`` are left out.

    The intervals are cut at block borders and joined on the block number, so it is an equi-join and no row meets
    intervals of another block. Extra columns of ``df``, whatever their names, pass through unchanged.
    """
    parts = cut(intervals, bits).select(F.struct("lo", "hi").alias("__iv"), F.col("blk").alias("__iv_block"))
    left = df.withColumn("__seq_block", F.shiftright(F.col(seq).cast("bigint"), bits))
    on = (F.col("__seq_block") == F.col("__iv_block")) & F.col(seq).cast("bigint").between(F.col("__iv.lo"), F.col("__iv.hi"))
    return left.join(parts, on, "left_semi").drop("__seq_block")


def points(df: DataFrame, seq: str) -> DataFrame:
    """Sequence numbers of ``df`` as unit intervals, pre-reduced to whole runs by :func:`merge_intervals`."""
    s = F.col(seq).cast("bigint")
    return df.where(s.isNotNull()).select(s.alias("lo"), s.alias("hi"))


def committed_runs(runs: DataFrame) -> DataFrame:
    """Ledger of the runs that ended well: their ``run_id`` as disjoint intervals. Failed or open runs stay gaps."""
    return merge_intervals(points(runs.where("run_status = 'ok'"), "run_id"))


def stored_versions(log: DataFrame, committed: DataFrame) -> DataFrame:
    """``(stored_source, stored)``: what each source's latest successful run stored: its run, time, mtime and hash.

    Only rows of the log inside the ledger of ``committed`` runs count; ties within a run go by ingest time, mtime, hash."""
    return (
        rows_in(log, "run_id", committed)
        .where("source IS NOT NULL")
        .groupBy(F.col("source").alias("stored_source"))
        .agg(F.max(F.struct("run_id", "ingest_time", "mtime", "content_hash")).alias("stored"))
    )


def done_scans(scan: DataFrame, stored: DataFrame) -> DataFrame:
    """Ledger of the ``scan_id`` that need no work: the sighting shows what is ``stored`` (:func:`stored_versions`).

    The ledger a store begins with when it has a log of its runs but no ledger yet; afterwards :class:`IntervalLedger`
    keeps it. Sightings of other hashes, failed runs' among them, stay gaps."""
    have = stored.select("stored_source", F.col("stored.content_hash").alias("stored_hash"))
    same = (F.col("source") == F.col("stored_source")) & (F.col("content_hash") == F.col("stored_hash"))
    return merge_intervals(points(scan.select("scan_id", "source", "content_hash").join(have, same, "left_semi"), "scan_id"))


def changed_sources(scan: DataFrame, log: DataFrame, runs: DataFrame, processed: DataFrame | None = None) -> DataFrame:
    """Sources that must be processed: new ones and those whose content differs from what a successful run stored last.

    ``scan`` rows are taken by sequence number ``scan_id``: available numbers minus the ``processed`` intervals give the
    gaps, late arrivals included. ``processed`` is the ledger so far, by default the one that the log of the runs amounts
    to (:func:`done_scans`). The current version of a source is its row with the latest ``scanned_at`` (ties: larger
    ``scan_id``) that has a hash and no ``status_code`` >= 400; the source is a case if that row lies in a gap. ``mtime``
    plays no part. Rows with a null ``source`` or ``scanned_at`` give nothing; empty tables give no rows; repeated rows
    change nothing. Both sides are aggregated per source before they are joined, with map-side partial aggregates, so a
    hot source costs nothing.
    """
    stored = stored_versions(log, persist_table(committed_runs(runs), "committed-runs"))
    gaps = subtract_intervals(points(scan, "scan_id"), done_scans(scan, stored) if processed is None else processed)
    seen = scan.where("content_hash IS NOT NULL AND coalesce(status_code, 0) < 400 AND source IS NOT NULL AND scanned_at IS NOT NULL")
    current = seen.groupBy("source").agg(F.max_by(F.struct("content_hash", "scan_id"), F.struct("scanned_at", "scan_id")).alias("c"))
    todo = rows_in(current.select("source", "c.content_hash", "c.scan_id"), "scan_id", gaps)
    stored = stored.select("stored_source", F.col("stored.content_hash").alias("stored_hash"))
    return todo.join(stored, F.col("source") == F.col("stored_source"), "left").select("source", "content_hash", "scan_id", "stored_hash")


class IntervalLedger:
    """Durable ledger beside its output: one folder per run, named by the commit that made it good.

    A run freezes the pending rows in its folder, processes those, and commits output and merged intervals by one
    :class:`chunkwise.commits.CommitLog` entry. A run that dies before leaves a folder no commit names: the next run sees
    the old ledger and repeats exactly the same gaps. Rows that arrive while a run works are not in the frozen rows and
    so stay gaps. Of two runs at the same time the one that commits first stands; the other learns it by a
    :class:`chunkwise.commits.Conflict`, its output is dropped and it starts again from the new ledger. A number is
    therefore never skipped and never committed twice.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = CommitLog(spark, path)

    def commits(self) -> list[str]:
        """Folders of the committed runs, in order."""
        return [self.log.read(i)["run"] for i in range(self.log.head() + 1)]

    def intervals(self) -> DataFrame:
        run = self.log.last()[1].get("run")
        return self.spark.read.schema(INTERVALS).parquet(f"{self.path}/{run}/intervals") if run else self.spark.createDataFrame([], INTERVALS)

    def output(self) -> DataFrame | None:
        done = self.commits()
        return self.spark.read.parquet(*[f"{self.path}/{c}/output" for c in done]) if done else None

    def pending(self, df: DataFrame, seq: str) -> DataFrame:
        """Rows of ``df`` not yet committed, late arrivals included."""
        return rows_in(df, seq, subtract_intervals(points(df, seq), self.intervals()))

    def run(self, df: DataFrame, seq: str, process, fail_before_commit: bool = False, tries: int = 5) -> str:
        """Process the pending rows with ``process(DataFrame) -> DataFrame`` and commit output and ledger together."""
        for _ in range(tries):
            number, name = self.log.head() + 1, f"run-{uuid.uuid4().hex}"
            folder = f"{self.path}/{name}"
            self.pending(df, seq).write.parquet(f"{folder}/pending")
            todo = self.spark.read.schema(df.schema).parquet(f"{folder}/pending")
            process(todo).write.parquet(f"{folder}/output")
            merge_intervals(self.intervals().unionByName(points(todo, seq))).write.parquet(f"{folder}/intervals")
            if fail_before_commit:
                raise RuntimeError("run ended before its commit")
            try:
                self.log.commit(number, {"run": name})
            except Conflict:
                self.log.remove(name)
                continue
            self.log.remove(f"{name}/pending")
            return name
        raise Conflict(f"{tries} runs lost against others")
