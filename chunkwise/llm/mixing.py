"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkwise.llm.encode import VOCABULARY, token_counts
from chunkwise.session import persist_table

#: Hash ranges of a source in which prefix sums run, at least; more from ``RANGE_ROWS`` rows a range on.
BUCKETS, RANGE_ROWS = 256, 500_000


def sized(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, source, tokens)`` of every document as a table in the shared folder; encoding is done once."""
    return persist_table(token_counts(documents, ["doc_id", "source"], vocabulary), "mixing-tokens")


def plan(tokens: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source of ``targets``: its tokens, demand, passes and the share the mixture really gives it.

    The mixture is as large as the corpus in tokens (all sources, null ones too, count). A source asks for
    ``target_share`` of it and can give its tokens ``max_repeats`` times at most; ``given`` is the smaller of both and
    ``short`` says that it cannot reach its share. A source without documents has no tokens and is short unless its
    share is 0. Targets with a null source, share or repeats are ignored; if a source is listed more than once its
    largest share and repeats stand. ``targets`` has one row per source and is joined to one row per source.
    """
    have = tokens.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    total = have.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("corpus_tokens"))
    t = targets.where("source IS NOT NULL AND target_share IS NOT NULL AND max_repeats IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = t.join(have, "source", "left").join(F.broadcast(total))
    rows = rows.withColumn("tokens", F.coalesce("tokens", F.lit(0))).withColumn("documents", F.coalesce("documents", F.lit(0)))
    rows = rows.withColumn("demand", F.col("target_share") * F.col("corpus_tokens")).withColumn("most", F.col("tokens") * F.greatest("max_repeats", F.lit(0)))
    rows = rows.withColumn("short", F.col("most") < F.col("demand")).withColumn("given", F.least("demand", F.col("most").cast("double")))
    return rows


def schedule_cdf(t, ramp):
    """Integral from 0 to ``t`` of the normalised weight ``1 + ramp * (2t - 1)``: falling for ramp < 0, rising for > 0."""
    return t * (1 - ramp) + ramp * t * t


def schedule_inverse(u, ramp):
    """Time at which the share ``u`` of a source's demand is met: the root of ``schedule_cdf(t) = u`` in 0..1."""
    b = 1 - ramp
    root = (F.sqrt(b * b + 4 * ramp * u) - b) / (2 * ramp)
    return F.when(F.abs(ramp) < 1e-9, u).otherwise(F.least(F.greatest(root, F.lit(0.0)), F.lit(1.0)))


def ramps(targets: DataFrame) -> DataFrame:
    """Curriculum where none is given: small sources, which repeat most, come to the fore towards the end."""
    r = F.col("max_repeats").cast("double")
    return targets.select("source", ((r - 2.5) / (F.abs(r - 2.5) + 1.5)).alias("ramp"))


def schedules(plan: DataFrame, ramp: DataFrame) -> DataFrame:
    """``plan`` with the slope ``ramp`` of each source's weight ``given * (1 + ramp * (2t - 1))`` over training time t.

    Slopes are shifted by their mean, weighted by ``given``, and then scaled down together until none is beyond -1..1. So
    no weight is ever negative and the weights of all sources sum to the size of the mixture at every t: t is the part
    of all tokens that was trained on, and the share of a source at t is its weight over that sum. Sources without a
    slope take part with slope 0.
    """
    one = ramp.where("source IS NOT NULL AND ramp IS NOT NULL").groupBy("source").agg(F.max("ramp").alias("raw"))
    p = plan.join(one, "source", "left").withColumn("raw", F.coalesce("raw", F.lit(0.0)))
    mean = p.agg((F.sum(F.col("raw") * F.col("given")) / F.sum("given")).alias("mean"))
    p = p.join(F.broadcast(mean)).withColumn("raw", F.col("raw") - F.coalesce("mean", F.lit(0.0)))  # one row
    most = p.agg(F.greatest(F.max(F.abs("raw")), F.lit(1.0)).alias("steepest"))
    return p.join(F.broadcast(most)).withColumn("ramp", F.col("raw") / F.col("steepest")).drop("raw", "mean", "steepest")


def mixture(tokens: DataFrame, targets: DataFrame, seed: int = 17, ramp: DataFrame | None = None) -> DataFrame:
    """``(source, doc_id, copy, tokens, position)``: the mixture; ``position`` in 0..1 is the place in training.

    Each source's weight at time t is its size in the mixture times ``1 + ramp * (2t - 1)``, normalised over all sources
    (:func:`schedules`). Its documents stand in a random order of fixed ``seed``, pass after pass; the cumulative tokens
    of a document (its middle) are a part of the source's demand, and the inverted integral of the schedule gives the
    time. Taken are documents that begin before the demand is met, so a source overshoots by less than one document,
    and no document is used more than ``max_repeats`` times. Empty and null texts have no tokens and are left out; rows
    repeated with the same ``doc_id`` count once per row.
    Prefix sums run in hash ranges per source, their number in proportion to the rows, with the sums of the ranges
    added; documents meet the plan of their source by source and range, so that a source that holds a third of all rows
    is never in one task; passes are rows made from one prefix sum.
    """
    p = plan(tokens, targets).where("tokens > 0 AND given > 0")
    p = schedules(p, ramp if ramp is not None else ramps(targets)).select("source", F.col("tokens").alias("all"), "given", "max_repeats", "ramp")
    buckets = max(BUCKETS, 1 << (tokens.count() // RANGE_ROWS).bit_length())
    docs = tokens.select("doc_id", "source", "tokens").where("tokens > 0 AND source IS NOT NULL").withColumn("h", F.xxhash64("doc_id", F.lit(seed)))
    docs = docs.withColumn("b", F.pmod(F.shiftrightunsigned("h", 40), F.lit(buckets)))
    before = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offset = docs.groupBy("source", "b").agg(F.sum("tokens").alias("bt")).withColumn("offset", F.coalesce(F.sum("bt").over(before), F.lit(0))).drop("bt").join(p, "source")
    inside = Window.partitionBy("source", "b").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.withColumn("within", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(offset, ["source", "b"])
    passes = placed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.ceil(F.col("given") / F.col("all")).cast("int"), F.col("max_repeats"))))))
    begin = (F.col("copy") - 1) * F.col("all") + F.col("offset") + F.col("within")
    taken = passes.withColumn("begin", begin).where(F.col("begin") < F.col("given"))
    u = F.least((F.col("begin") + F.col("tokens") / 2.0) / F.col("given"), F.lit(1.0))
    return taken.select("source", "doc_id", "copy", "tokens", schedule_inverse(u, F.col("ramp")).alias("position"))


def found(tokens: DataFrame, targets: DataFrame, seed: int = 17, ramp: DataFrame | None = None) -> DataFrame:
    """Sources whose tokens in the mixture end before their demand is met: they cannot reach their target share, however
    the curriculum spreads them. A source that has no document in the mixture is one unless its demand is 0."""
    met = mixture(tokens, targets, seed, ramp).groupBy("source").agg(F.sum("tokens").alias("mixed"))
    return plan(tokens, targets).select("source", "demand").join(met, "source", "left").where(F.coalesce("mixed", F.lit(0)) < F.col("demand")).select("source")


def in_training_order(mix: DataFrame) -> DataFrame:
    """The mixture range-partitioned and sorted by position (ties: source, document, copy)."""
    return mix.repartitionByRange("position", "source", "doc_id", "copy").sortWithinPartitions("position", "source", "doc_id", "copy")


def shares(tokens: DataFrame, targets: DataFrame, seed: int = 17) -> DataFrame:
    """Per source of ``targets``: target share, tokens taken, the share of the mixture really reached, copies used."""
    used = mixture(tokens, targets, seed).groupBy("source").agg(F.sum("tokens").alias("mixed"), F.max("copy").alias("repeats"))
    total = used.agg(F.sum("mixed").alias("all_mixed"))
    rows = plan(tokens, targets).select("source", "target_share", "corpus_tokens", F.col("tokens").alias("source_tokens"), "short").join(used, "source", "left").join(F.broadcast(total))
    mixed = F.coalesce("mixed", F.lit(0))
    return rows.select(
        "source", "target_share", "source_tokens", mixed.alias("mixed_tokens"), F.coalesce("repeats", F.lit(0)).alias("repeats"),
        (mixed / F.col("corpus_tokens")).alias("share_of_corpus_size"), (mixed / F.col("all_mixed")).alias("share_of_mixture"), "short",
    )
