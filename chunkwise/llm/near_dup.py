"""Near-duplicate texts by b-bit MinHash: banded candidates, then a collision-corrected estimate by bit counts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkwise.session import persist_table

WORD = re.compile(r"[^\W_]+")
BITS = 4
PER_LONG = 64 // BITS


class Params:
    """Shingle width, similarity, ``bands`` x ``rows`` minima, and the sizes from which hot groups take another way.

    The estimate from 256 four-bit minima has a standard deviation of about 0.033 near one half. Pairs whose estimate
    lies within ``doubt`` (four deviations) of ``least`` are decided by their shingles, so the threshold is exact.
    """

    def __init__(self, width: int = 5, least: float = 0.8, bands: int = 64, rows: int = 4, bucket: int = 64, copies: int = 32, doubt: float = 0.135):
        self.width, self.least, self.bands, self.rows, self.bucket, self.copies, self.doubt = width, least, bands, rows, bucket, copies, doubt
        self.minima = bands * rows


def seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20240917))
    return rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def shingles(text: str, width: int, known: dict) -> np.ndarray:
    """Distinct 64-bit hashes of all runs of ``width`` consecutive words (lower-cased runs of letters and digits)."""
    words = WORD.findall(text.lower())
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    ids = []
    for w in words:
        h = known.get(w)
        if h is None:
            if len(known) > 500_000:
                known.clear()
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        ids.append(h)
    h = np.array(ids, np.uint64)
    out = h[:n].copy()
    for i in range(1, width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    out ^= out >> np.uint64(29)
    return np.unique(out * np.uint64(0xBF58476D1CE4E5B9))


def minima(sh: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 2048) -> np.ndarray:
    """Minimum of every hash function over all shingles; long texts go in steps, so memory stays bounded."""
    x = (sh >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), step):
        best = np.minimum(best, (a[:, None] * x[None, i : i + step] + b[:, None]).min(1))
    return best


def sign(frames: Iterator[pd.DataFrame], p: Params) -> Iterator[pd.DataFrame]:
    a, b = seeds(p.minima)
    known: dict = {}
    seen: set[int] = set()
    weights = (np.uint64(1) << (np.arange(PER_LONG, dtype=np.uint64) * np.uint64(BITS)))
    for pdf in frames:
        ids, fps, sigs, keys = [], [], [], []
        if len(seen) > 1_000_000:
            seen.clear()
        for cid, text in zip(pdf["chunk_id"], pdf["content"]):
            sh = shingles(text, p.width, known)
            if not len(sh):
                continue
            fp = xxhash.xxh3_64_intdigest(sh.tobytes()) - (1 << 63)
            ids.append(cid)
            fps.append(fp)
            if fp in seen:
                sigs.append(None)
                keys.append(None)
                continue
            seen.add(fp)
            low = minima(sh, a, b)
            bits = ((low * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)).astype(np.uint64)
            sigs.append((bits.reshape(-1, PER_LONG) * weights).sum(1, dtype=np.uint64).view(np.int64))
            rows = low.reshape(p.bands, p.rows).astype(np.uint64)
            key = np.arange(1, p.bands + 1, dtype=np.uint64)
            for i in range(p.rows):
                key = key * np.uint64(0x9E3779B97F4A7C15) + rows[:, i]
                key ^= key >> np.uint64(31)
            keys.append((key * np.uint64(0x94D049BB133111EB)).view(np.int64))
        yield pd.DataFrame({"chunk_id": ids, "fp": np.array(fps, np.int64), "sig": sigs, "bands": keys})


def estimate(sa: str, sb: str, p: Params):
    """Similarity estimate from two packed signatures: equal ``BITS``-bit groups, corrected for chance collisions."""
    ones = F.lit(0x1111111111111111)

    def differing(x, y):
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        return F.bit_count(d.bitwiseAND(ones))

    diff = F.aggregate(F.zip_with(sa, sb, differing), F.lit(0), lambda s, v: s + v)
    equal = 1.0 - diff.cast("double") / p.minima
    chance = 1.0 / (1 << BITS)
    return (equal - chance) / (1.0 - chance)


def signatures(chunks: DataFrame, p: Params) -> DataFrame:
    """``(chunk_id, fp, sig, bands)`` of every text with at least one shingle, as a table in the shared folder.

    ``fp`` names the shingle set; ``sig`` and ``bands`` stand only at its first text in a task, so exact copies are
    combined before any shuffle.
    """
    src = chunks.select("chunk_id", "content").where("content IS NOT NULL AND chunk_id IS NOT NULL")
    schema = "chunk_id string, fp bigint, sig array<bigint>, bands array<bigint>"
    return persist_table(src.mapInPandas(lambda it: sign(it, p), schema), "near-dup-signatures")


#: One set in so many is looked at to find crowded buckets, and how many of these make one; most keys that are broadcast.
SAMPLED, CROWD, MOST_KEYS = 128, 16, 100_000


def class_pairs(chunks: DataFrame, sigs: DataFrame, p: Params) -> DataFrame:
    """Pairs ``(fa, fb)`` of different shingle sets whose similarity reaches ``p.least``.

    One shuffle of ``(band key, set)`` rows finds the buckets; keys have 64 bits, so that strangers do not meet however
    many sets there are. Sets are made distinct in it, so exact copies, however many, are one member. Buckets of up to
    ``p.bucket`` sets give their pairs directly. Members of larger buckets go to :func:`prefix_join`, which is exact and
    never pairs a whole bucket; buckets that a hash sample shows to be crowded go there without being gathered at all.
    Candidates are judged by the corrected estimate, those in doubt by their shingles.
    """
    rows = sigs.where("bands IS NOT NULL").select("fp", F.explode("bands").alias("key"))
    crowded = persist_table(rows.where(F.pmod("fp", F.lit(SAMPLED)) == 0).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= CROWD).select("key"), "near-dup-crowded")
    many = crowded.count()
    hot = None
    if many:
        few = F.broadcast(crowded) if many <= MOST_KEYS else crowded
        hot = rows.join(few, "key", "left_semi").select("fp").distinct()
        rows = rows.join(few, "key", "left_anti")
    rows = rows.repartition("key").dropDuplicates(["key", "fp"])  # copies of a set from several tasks; no second shuffle
    shared = rows.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1")
    shared = persist_table(shared.groupBy("key").agg(F.array_sort(F.collect_list("fp")).alias("m")), "near-dup-buckets")  # where the rows lie
    small = shared.where(F.size("m") <= p.bucket)
    inner = F.transform(F.sequence(F.lit(1), F.size("m") - 1), lambda i: F.transform(F.slice("m", 1, i), lambda x: F.struct(x.alias("fa"), F.element_at("m", (i + 1).cast("int")).alias("fb"))))
    pairs = small.select(F.explode(F.flatten(inner)).alias("p")).select("p.fa", "p.fb").distinct()
    full = shared.where(F.size("m") > p.bucket).select(F.explode("m").alias("fp")).distinct()
    hot = full if hot is None else hot.unionByName(full).distinct()
    if not hot.isEmpty():
        pairs = pairs.unionByName(prefix_join(chunks, sigs, hot, p)).distinct()
    sig = sigs.where("sig IS NOT NULL").select("fp", "sig").dropDuplicates(["fp"])
    left, right = sig.select(F.col("fp").alias("fa"), F.col("sig").alias("sa")), sig.select(F.col("fp").alias("fb"), F.col("sig").alias("sb"))
    scored = pairs.join(left, "fa").join(right, "fb").withColumn("estimate", estimate("sa", "sb", p)).where(F.col("estimate") >= p.least - p.doubt)
    scored = persist_table(scored.select("fa", "fb", "estimate"), "near-dup-scored")
    sure = scored.where(F.col("estimate") > p.least + p.doubt).select("fa", "fb")
    return sure.unionByName(verified(chunks, sigs, scored.where(F.col("estimate") <= p.least + p.doubt).select("fa", "fb"), p))


def shingle_sets(chunks: DataFrame, sigs: DataFrame, wanted: DataFrame, p: Params) -> DataFrame:
    """``(fp, sh)``: the shingles of the ``wanted`` sets, from the text of the first chunk that has them; a set comes
    again for each row that repeats the chunk."""
    rep = persist_table(sigs.select("fp", "chunk_id").join(wanted, "fp").groupBy("fp").agg(F.min("chunk_id").alias("chunk_id")), "near-dup-wanted")
    rep = F.broadcast(rep) if rep.count() <= MOST_KEYS else rep  # else all texts would be shuffled for a few
    texts = chunks.select("chunk_id", "content").where("content IS NOT NULL").join(rep, "chunk_id").select("fp", "content")

    def tokens(frames):
        known: dict = {}
        for pdf in frames:
            yield pd.DataFrame({"fp": pdf["fp"], "sh": [shingles(t, p.width, known).view(np.int64) for t in pdf["content"]]})

    return texts.mapInPandas(tokens, "fp bigint, sh array<bigint>")


def verified(chunks: DataFrame, sigs: DataFrame, pairs: DataFrame, p: Params) -> DataFrame:
    """Of ``pairs`` of sets those that really share ``p.least`` of all their shingles."""
    sets = persist_table(shingle_sets(chunks, sigs, pairs.select(F.explode(F.array("fa", "fb")).alias("fp")).distinct(), p), "near-dup-sets")
    sets = sets.groupBy("fp").agg(F.first("sh").alias("sh"))  # one exchange serves this and both joins
    a, b = sets.select(F.col("fp").alias("fa"), F.col("sh").alias("x")), sets.select(F.col("fp").alias("fb"), F.col("sh").alias("y"))
    both = pairs.join(a, "fa").join(b, "fb").select("fa", "fb", F.size(F.array_intersect("x", "y")).alias("c"), (F.size("x") + F.size("y")).alias("n"))
    return both.where(F.col("c") >= p.least * (F.col("n") - F.col("c")) - 1e-9).select("fa", "fb")


#: Most members of one shingle that meet all others of it in one task.
MEMBERS = 2048


def prefix_join(chunks: DataFrame, sigs: DataFrame, hot: DataFrame, p: Params) -> DataFrame:
    """Candidates among the sets of over-full buckets: two sets of similarity ``p.least`` share one of their rarest shingles.

    Shingles are ordered by how many hot sets hold them; of a set of size s the first ``s - ceil(p.least * s) + 1`` form
    its prefix, and sets that reach the similarity must share a prefix shingle (prefix filtering), with sizes at most
    ``1 / p.least`` apart. It finds all of them, with no cap on partners; the members of a frequent shingle are cut into
    blocks, so that it is not the work of one task.
    """
    sh = persist_table(shingle_sets(chunks, sigs, hot, p).select("fp", F.size("sh").alias("s"), F.explode("sh").alias("g")).distinct(), "near-dup-prefix")
    df = sh.groupBy("g").agg(F.count("*").alias("df")).where("df > 1")
    ranked = sh.join(df, "g", "left").withColumn("i", F.row_number().over(Window.partitionBy("fp").orderBy(F.coalesce("df", F.lit(1)), "g")))
    prefix = ranked.where((F.col("i") <= F.col("s") - F.ceil(F.col("s") * p.least) + 1) & F.col("df").isNotNull()).withColumn("parts", F.ceil(F.col("df") / MEMBERS).cast("int"))
    a = prefix.select("g", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part"), F.col("fp").alias("fa"), F.col("s").alias("na"))
    b = prefix.select("g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("fp").alias("fb"), F.col("s").alias("nb"))
    near = (F.col("fa") < F.col("fb")) & (F.least("na", "nb") >= F.greatest("na", "nb") * p.least)
    return a.join(b, ["g", "part"]).where(near).select("fa", "fb").distinct()


def near_duplicate_pairs(chunks: DataFrame, p: Params) -> DataFrame:
    """Pairs ``(chunk_id_a, chunk_id_b)``, smaller id first, of chunks whose texts have similar shingle sets.

    Chunks with the same shingle set form a class. Links between classes are found once per pair of classes and then
    carried over to the members. Classes of up to ``p.copies`` chunks are written out in full; a larger class, in which
    all chunks are copies, is given as pairs of its representative (smallest id) with every member, and stands in links
    to other classes by its representative, so the result is whole but never quadratic in the copies.
    Null, empty, blank texts and texts of fewer words than a shingle are in no pair; rows repeated with the same
    ``chunk_id`` count once; an empty table gives no pair.
    """
    sigs = signatures(chunks, p)
    links = class_pairs(chunks, sigs, p)
    members = sigs.select("fp", "chunk_id").distinct()
    sizes = members.groupBy("fp").agg(F.count("*").alias("c"), F.min("chunk_id").alias("rep"))
    known = members.join(sizes.where("c > 1"), "fp", "left")
    shown = known.where((F.coalesce("c", F.lit(1)) <= p.copies) | (F.col("chunk_id") == F.col("rep"))).select("fp", "chunk_id")
    across = links.join(shown.select(F.col("fp").alias("fa"), F.col("chunk_id").alias("x")), "fa").join(shown.select(F.col("fp").alias("fb"), F.col("chunk_id").alias("y")), "fb")
    some = known.where((F.col("c") > 1) & (F.col("c") <= p.copies)).select("fp", "chunk_id")
    within = some.select("fp", F.col("chunk_id").alias("x")).join(some.select("fp", F.col("chunk_id").alias("y")), "fp").where("x < y")
    star = known.where((F.col("c") > p.copies) & (F.col("chunk_id") != F.col("rep"))).select(F.col("rep").alias("x"), F.col("chunk_id").alias("y"))
    every = across.select("x", "y").unionByName(within.select("x", "y")).unionByName(star)
    return every.where("x <> y").select(F.least("x", "y").alias("chunk_id_a"), F.greatest("x", "y").alias("chunk_id_b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components ``(node, component)`` of the edges by alternating large-star and small-star steps.

    The component is the smallest node. Each round is a group-by and a join; lineage is cut in the shared folder each
    round and rounds end only when nothing changes. Isolated nodes have no edge and so no row.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = persist_table(e, "components")
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = persist_table(small, "components")
        if small.exceptAll(e).isEmpty() and e.exceptAll(small).isEmpty():
            break
        e = small
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()


def near_duplicate_groups(chunks: DataFrame, p: Params) -> DataFrame:
    """One row per distinct ``chunk_id``: ``class_id`` (smallest id of its exact class) and ``group_id`` (smallest id of
    all chunks linked to it, directly or over others). Chunks without shingles stand alone."""
    sigs = signatures(chunks, p)
    links = class_pairs(chunks, sigs, p)
    members = sigs.select("fp", "chunk_id").distinct()
    classes = members.groupBy("fp").agg(F.min("chunk_id").alias("class_id"))
    named = links.join(classes.select(F.col("fp").alias("fa"), F.col("class_id").alias("a")), "fa").join(classes.select(F.col("fp").alias("fb"), F.col("class_id").alias("b")), "fb")
    comp = components(named)
    grouped = members.join(classes, "fp").join(comp, F.col("class_id") == F.col("node"), "left")
    grouped = grouped.select("chunk_id", "class_id", F.coalesce("component", "class_id").alias("group_id"))
    every = chunks.select("chunk_id").where("chunk_id IS NOT NULL").distinct().join(grouped, "chunk_id", "left")
    return every.select("chunk_id", F.coalesce("class_id", "chunk_id").alias("class_id"), F.coalesce("group_id", "chunk_id").alias("group_id"))
