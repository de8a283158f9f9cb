"""Weighted reciprocal rank fusion and hybrid search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K, LEXICAL_K, LEXICAL_WEIGHT = 60, 5, 0.3
CANDIDATES = 20


def ranked(df: DataFrame, list_no: int, weight: float, k: int) -> DataFrame:
    """A bounded list (id, score), best first, as list_no, id, rank and its part of the fused score."""
    rank = F.row_number().over(Window.partitionBy(F.lit(list_no)).orderBy(F.desc("score"), "id"))
    return df.withColumn("rank", rank).select(F.lit(list_no).alias("list_no"), "id", "rank", (F.lit(weight) / (k + F.col("rank"))).alias("part"))


def rrf_fuse(lists: Sequence[tuple[DataFrame, float, int]]) -> DataFrame:
    """Fuses lists of candidates, given as (list, weight, k): id, score, first_list, first_rank.

    Every list has been cut to its best candidates before, so ranks are numbered over bounded input.  Ties keep the order
    of first appearance.
    """
    parts = [ranked(df, n, w, k) for n, (df, w, k) in enumerate(lists)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    first = F.min(F.struct("list_no", "rank")).alias("first")
    fused = both.groupBy("id").agg(F.round(F.sum("part"), 9).alias("score"), first, F.collect_set("list_no").alias("in_lists"))
    return fused.select("id", "score", F.col("first.list_no").alias("first_list"), F.col("first.rank").alias("first_rank"), "in_lists")


def hybrid(dense: DataFrame, lexical: DataFrame, limit: int) -> DataFrame:
    """Dense and lexical candidates (id, score) fused: id, fused, retrieval (both, dense, lexical) and the dense score."""
    fused = rrf_fuse([(dense, 1.0, RRF_K), (lexical, LEXICAL_WEIGHT, LEXICAL_K)])
    dense_, lex = F.array_contains("in_lists", 0), F.array_contains("in_lists", 1)
    best = fused.orderBy(F.desc("score"), "first_list", "first_rank").limit(limit)
    tag = F.when(dense_ & lex, "both").when(dense_, "dense").otherwise("lexical")
    return best.join(dense.select("id", F.col("score").alias("dense_score")), "id", "left").select("id", F.col("score").alias("fused"), tag.alias("retrieval"), "dense_score")
