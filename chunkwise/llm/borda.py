"""One ranking from several differently scaled scores: Borda count with averaged ties and mid-rank for missing scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MODES = ("bm25", "embedding", "rerank")
#: Parts into which the items of a query are cut where they meet its figures, so that a hot query is not one key.
SALT = 16


def clean_scores(scores: DataFrame, modes=MODES) -> DataFrame:
    """One row per (query, item, mode) with its best finite score; null and NaN scores mean "not retrieved"."""
    usable = F.when(F.isnan("score"), None).otherwise(F.col("score"))
    return (
        scores.where(F.col("search_mode").isin(*modes) & F.col("query_id").isNotNull() & F.col("chunk_id").isNotNull())
        .groupBy("query_id", "chunk_id", "search_mode")
        .agg(F.max(usable).alias("score"))
    )


def doubled_ranks(present: DataFrame, buckets: int = 64) -> DataFrame:
    """Twice the averaged-tie competition rank of every score within its (query, mode), higher scores first.

    Exact and safe for a query that holds a large part of all rows: scores are first counted per distinct value, the
    values are cut into monotone ranges at approximate quantiles, and a window runs inside one range only; the counts of
    the ranges above are added from a table of ``buckets`` rows per (query, mode). Twice the rank is an integer, so no
    rounding can disturb ties: it is ``2 * (scores above) + (equal scores) + 1``.
    """
    keys = ["query_id", "search_mode"]
    values = present.groupBy(*keys, "score").agg(F.count("*").alias("n"))
    cuts = values.groupBy(*keys).agg(F.percentile_approx("score", [(i + 1) / buckets for i in range(buckets - 1)], 10000).alias("cuts"))
    placed = values.join(cuts, keys).withColumn("b", F.size(F.filter("cuts", lambda c: c < F.col("score")))).drop("cuts")
    above = Window.partitionBy(*keys).orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*keys, "b").agg(F.sum("n").alias("bn")).withColumn("before", F.coalesce(F.sum("bn").over(above), F.lit(0))).drop("bn")
    inside = Window.partitionBy(*keys, "b").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(offsets, [*keys, "b"])
    return ranked.select(*keys, "score", (2 * (F.col("before") + F.col("within")) + F.col("n") + 1).alias("rank2"))


def borda(scores: DataFrame, weights: dict[str, int] | None = None, buckets: int = 64) -> DataFrame:
    """``(query_id, chunk_id, points2, rank_sum2)`` for every item of every query; more points are better.

    ``weights`` maps each score name to an integer weight (all 1 by default, so each score has the same say). With ``n``
    items in a query and ``m`` of them scored in a mode, an item gets ``n - rank`` points per mode; ties share their
    averaged rank; the ``n - m`` items without a score (absent row, null, NaN) share the middle rank ``(m + 1 + n) / 2``
    of the places behind all scored ones. All figures are doubled to stay integers.
    An item known only by null scores takes part and comes last; rows with null keys or unknown modes are dropped;
    repeated rows count once (the best score stands); an empty table gives no rows.
    """
    weights = weights or {m: 1 for m in MODES}
    one = clean_scores(scores, tuple(weights))
    present = one.where("score IS NOT NULL")
    n = one.select("query_id", "chunk_id").distinct().groupBy("query_id").agg(F.count("*").alias("n"))
    m = present.groupBy("query_id").pivot("search_mode", list(weights)).agg(F.count(F.lit(1)))
    m = m.select("query_id", *[F.coalesce(F.col(w), F.lit(0)).alias(f"m_{i}") for i, w in enumerate(weights)])
    sizes = n.join(m, "query_id", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    wide = one.join(doubled_ranks(present, buckets), ["query_id", "search_mode", "score"], "left").groupBy("query_id", "chunk_id").pivot("search_mode", list(weights)).agg(F.max("rank2"))
    full = wide.withColumn("salt", F.pmod(F.xxhash64("chunk_id"), F.lit(SALT)).cast("int")).join(sizes, ["query_id", "salt"])
    total = F.lit(0)
    for i, (mode, weight) in enumerate(weights.items()):
        missing = F.coalesce(F.col(f"m_{i}"), F.lit(0)) + 1 + F.col("n")
        total = total + F.lit(int(weight)) * F.coalesce(F.col(mode), missing)
    full = full.withColumn("rank_sum2", total)
    return full.select("query_id", "chunk_id", (2 * F.col("n") * sum(weights.values()) - F.col("rank_sum2")).alias("points2"), "rank_sum2")


def top(scores: DataFrame, k: int = 5, **options) -> DataFrame:
    """The first ``k`` items per query: most points first, then the smaller ``chunk_id``."""
    w = Window.partitionBy("query_id").orderBy(F.desc("points2"), F.asc("chunk_id"))
    return borda(scores, **options).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
