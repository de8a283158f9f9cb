"""Vector expressions and exact top-k search; all of it stays in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for vectors of unequal length and for zero vectors."""
    scale = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (scale > 0), dot(a, b) / scale)


def l2_normalize(a: Column) -> Column:
    """The vector at length 1; a zero vector as it is."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def chunk_filter(manual_ids: Sequence[str] | None = None, bookmark_ids: Sequence[str] | None = None) -> Column:
    """Both optional lists must hold.  None doesn't restrict; an empty list matches nothing."""
    cond = F.lit(True)
    for column, ids in (("manual_id", manual_ids), ("bookmark_id", bookmark_ids)):
        if ids is not None:
            cond = cond & (F.coalesce(F.col(column).isin(list(ids)), F.lit(False)) if ids else F.lit(False))
    return cond


def dense_top(chunks: DataFrame, query: Sequence[float], k: int, where: Column | None = None) -> DataFrame:
    """The ``k`` chunks (id, embedding) most similar to ``query``: id and score, best first, ties by id.

    The filter applies before the ranking.  The vector of the query is a literal; the plan is one scan and a top-k.
    """
    wide = chunks if where is None else chunks.filter(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scored = wide.filter(fine).select("id", F.round(cosine(F.col("embedding"), q), 6).alias("score")).filter(F.col("score").isNotNull())
    return scored.orderBy(F.desc("score"), "id").limit(k)

