"""Term statistics and BM25 over an inverted index of DataFrames.

The index is three tables: postings (chunk_id, manual_id, term, tf, dl), term_stats (term, df) and corpus_stats (n_docs,
total_tokens).  A query only ever touches the postings of its own few terms: the terms are a bounded literal list, so the
scan is filtered by them and only those rows reach the aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Floor of the inverse document frequency.
IDF_FLOOR = 1e-6
MAX_DF_RATIO, MIN_DF = 0.0005, 25

# Latin letters with marks, and the letters that a diacritic-blind index stores for them.
_MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"


def tokens(text: Column) -> Column:
    """Index terms of a text: lower-case runs of letters, numbers and private-use characters, Latin diacritics removed."""
    folded = F.translate(F.lower(F.coalesce(text, F.lit(""))), _MARKED, _PLAIN)
    return F.filter(F.split(folded, r"[^\p{L}\p{N}\p{Co}]+"), lambda t: t != "")


def query_terms(text: Column) -> Column:
    """Terms of a query: distinct ASCII runs of two and more characters, in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]{2,}"), F.lit(0)))


def match_query(text: Column) -> Column:
    """The terms quoted and joined by OR; null if there are none."""
    terms = query_terms(text)
    return F.when(F.size(terms) > 0, F.array_join(F.transform(terms, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR "))


def postings(chunks: DataFrame) -> DataFrame:
    """``chunks`` (chunk_id, manual_id, content), one row per chunk, to the postings table."""
    listed = chunks.select("chunk_id", "manual_id", tokens(F.col("content")).alias("t"))
    single = listed.select("chunk_id", "manual_id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    return single.groupBy("chunk_id", "manual_id", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def term_stats(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: n_docs and total_tokens.  Chunks without terms count as documents."""
    return chunks.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum(F.size(tokens(F.col("content")))), F.lit(0)).alias("total_tokens"))


def gate(stats: DataFrame, corpus: DataFrame, terms: Sequence[str], ratio: float = MAX_DF_RATIO) -> DataFrame:
    """Query terms rare enough to tell documents apart: 0 < df <= max(25, floor(n ratio)).  ``terms`` is a query: a short list."""
    wanted = stats.filter(F.col("term").isin([t.lower() for t in terms]))
    return wanted.crossJoin(F.broadcast(corpus)).filter(F.col("df") <= F.greatest(F.lit(MIN_DF), F.floor(F.col("n_docs") * ratio))).select("term", "df")


def bm25(posts: DataFrame, corpus: DataFrame, terms: Sequence[str], manuals: Sequence[str] | DataFrame | None = None, ratio: float = MAX_DF_RATIO, stats: DataFrame | None = None) -> DataFrame:
    """chunk_id and score of every chunk with a gated term.  Statistics are the whole corpus's, also under a manual filter.

    ``stats`` are stored term statistics; without them the postings of the terms are counted.

    ``manuals`` is a short list of ids, or rows of any number with manual_id.  Terms that differ only in case are counted as often as they stand in the query.
    """
    times = {t.lower(): sum(x.lower() == t.lower() for x in terms) for t in terms}
    hits = posts.filter(F.col("term").isin(list(times)))
    rare = gate(term_stats(hits) if stats is None else stats, corpus, list(times), ratio)
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in times.items() for x in kv])[F.col("term")], F.lit(1)) if times else F.lit(1)
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, IDF_FLOOR).otherwise(idf)
    mean = F.col("total_tokens") / F.col("n_docs")
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / mean))
    # At most one row per query term: the gate's result is bounded by the query, not by the data.
    scored = hits.join(F.broadcast(rare), "term").crossJoin(F.broadcast(corpus))
    if isinstance(manuals, DataFrame):
        scored = scored.join(manuals.select("manual_id"), "manual_id", "left_semi")
    elif manuals is not None:
        scored = scored.filter(F.col("manual_id").isin(list(manuals)) if manuals else F.lit(False))
    return scored.groupBy("chunk_id").agg(F.round(F.sum(weight * part), 6).alias("score"))


def top(scored: DataFrame, k: int) -> DataFrame:
    return scored.orderBy(F.desc("score"), "chunk_id").limit(k)


def without_manuals(posts: DataFrame, manuals: DataFrame) -> DataFrame:
    """Postings without those of the given manuals (manual_id); statistics are derived and so follow."""
    return posts.join(manuals.select("manual_id").distinct(), "manual_id", "left_anti")
