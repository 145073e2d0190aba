"""Registered queries of the training-data operators: name -> callable(spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkwise.llm import borda, code_docs, encode, garbled, markup, mixing, near_dup, neighbours, splitting
from chunkwise.session import table

#: Near-duplicate chunks: runs of three words, half of them shared.
PASSAGES = near_dup.Params(width=3, least=0.5)


def p1_found(spark, d):
    return near_dup.near_duplicate_pairs(table(spark, d, "chunks"), PASSAGES)


def p1_groups(spark, d):
    return near_dup.near_duplicate_groups(table(spark, d, "chunks"), PASSAGES)


def p2_found(spark, d):
    return borda.top(table(spark, d, "search_scores"), 5).select("query_id", "chunk_id")


def p2_ranking(spark, d):
    return borda.borda(table(spark, d, "search_scores")).select("query_id", "chunk_id", F.col("points2").cast("bigint").alias("points2"), F.col("rank_sum2").cast("bigint").alias("rank_sum2"))


def p3_found(spark, d):
    return code_docs.declaration_pairs(table(spark, d, "declarations")).select("decl_id")


def p3_pairs(spark, d):
    return code_docs.declaration_pairs(table(spark, d, "declarations"))


def p3_class_methods(spark, d):
    """Documented methods cut out of whole classes."""
    classes = table(spark, d, "declarations").where("declaration_type = 'CLASS'").dropDuplicates(["decl_id"])
    return code_docs.file_pairs(classes, "decl_id", "full_text")


def p4_found(spark, d):
    return markup.residue(table(spark, d, "chunks")).select("chunk_id")


def p4_clean(spark, d):
    return markup.cleaned(table(spark, d, "chunks"))


def p4_wrappers(spark, d):
    return markup.wrappers(table(spark, d, "chunks"))


def p5_found(spark, d):
    return splitting.split_chunks(table(spark, d, "chunks")).where("n_pieces > 1").select("chunk_id").distinct()


def p5_pieces(spark, d):
    return splitting.split_chunks(table(spark, d, "chunks"))


def p5_new_indexes(spark, d):
    chunks = table(spark, d, "chunks")
    return splitting.new_indexes(chunks, splitting.split_chunks(chunks))


def p6_found(spark, d):
    return neighbours.pairs(table(spark, d, "chunks"))


def p6_neighbours(spark, d):
    return neighbours.nearest(table(spark, d, "chunks"))


def p8_ids(spark, d):
    return encode.encode_corpus(table(spark, d, "documents"))


def p8_counts(spark, d):
    return encode.token_counts(table(spark, d, "documents"), ["doc_id"])


def p9_found(spark, d):
    return mixing.found(mixing.sized(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p9_shares(spark, d):
    return mixing.shares(mixing.sized(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p9_mixture(spark, d):
    return mixing.in_training_order(mixing.mixture(mixing.sized(table(spark, d, "documents")), table(spark, d, "mix_targets")))


def p10_found(spark, d):
    return garbled.found(table(spark, d, "documents"))


def p10_restored(spark, d):
    return garbled.restore(table(spark, d, "documents"))


ALL = (
    p1_found, p1_groups, p2_found, p2_ranking, p3_found, p3_pairs, p3_class_methods, p4_found, p4_clean, p4_wrappers,
    p5_found, p5_pieces, p5_new_indexes, p6_found, p6_neighbours, p8_ids, p8_counts, p9_found, p9_shares, p9_mixture, p10_found, p10_restored,
)
QUERIES = {f.__name__: f for f in ALL}
