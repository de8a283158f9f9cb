"""Retrieval queries over the library tables: lexical, dense, hybrid, and vector store reads."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.identifiers import id_key
from marginalia.operators import fusion, lexical, outline, search, vectors
from marginalia.operators.library import LibraryError
from marginalia.plans import sqltext as T
from marginalia.runtime import checkpoint_dir, stamp, table
from marginalia.sources import embedders
from marginalia.sources.lexical_store import LexicalStore

#: The queries of the search plans.
TEXT = "which rotor purges the throttled flange near Broglex, message FNU6092I"
TERMS = ["rotor", "purges", "flange", "magazine", "skips", "encoder"]
RATIO = 0.2
#: Path pattern of the scoped search.
SCOPE = "Tarvel OS/*"


def chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    """One row per chunk: id, content, manual_id (key of the id's own manual part), bookmark_id, kind, page, figure_id."""
    c = table(spark, d, "chunks")
    m = F.col("metadata")
    wide = c.select(
        "id",
        "document",
        "embedding",
        F.regexp_replace(F.lower("id"), "_[^_]*$", "").alias("manual_id"),
        id_key(m["bookmark_id"]).alias("bookmark_id"),
        m["type"].alias("kind"),
        m["page"].alias("page"),
        id_key(m["figure_id"]).alias("figure_id"),
        m["chunk_index"].alias("chunk_index"),
    )
    return wide.dropDuplicates(["id"])


def index_rows(spark: SparkSession, d: str) -> DataFrame:
    """The lexical index's input: one row per chunk id, null documents as empty text."""
    return chunk_rows(spark, d).select(F.col("id").alias("chunk_id"), "manual_id", F.coalesce("document", F.lit("")).alias("content"))


def query_vector(spark: SparkSession, d: str) -> list[float]:
    """The vector that the dense plans search for: the one with the smallest id (one row)."""
    return table(spark, d, "embeddings").orderBy("vec_id").limit(1).select("embedding").first()[0]


def stored_index(spark: SparkSession, d: str) -> LexicalStore:
    """The stored index of the chunks as they are now; made if there is none yet."""
    store = LexicalStore(spark, f"{checkpoint_dir(spark)}/lexical-{stamp(spark, d, 'chunks')}")
    if not store.exists():
        try:
            store.create(index_rows(spark, d))
        except LibraryError:
            if not store.exists():  # another query may have made it meanwhile
                raise
    return store


def build_postings(spark, d):
    return lexical.postings(index_rows(spark, d))


def doc_freq(spark, d):
    return lexical.term_stats(build_postings(spark, d))


def corpus_stats(spark, d):
    return lexical.corpus_stats(index_rows(spark, d))


def reindex_lexical(spark, d):
    """Sizes of a rebuilt index per manual."""
    return build_postings(spark, d).groupBy("manual_id").agg(F.count(F.lit(1)).alias("postings"), F.countDistinct("chunk_id").alias("chunks"))


def delete_lexical(spark, d):
    """Document frequencies after the manuals in the deletion log have left the index."""
    gone = table(spark, d, "removed_keys").filter("target_table = 'manuals'").select(id_key(F.col("target_id")).alias("k"))
    posts = build_postings(spark, d).withColumn("k", F.regexp_replace("manual_id", "-", ""))
    return lexical.term_stats(posts.join(gone.distinct(), "k", "left_anti"))


def rarity_gate(spark, d):
    store = stored_index(spark, d)
    return lexical.gate(store.term_stats(TERMS), store.corpus_stats(), TERMS, RATIO)


def bm25_search(spark, d):
    return lexical.top(stored_index(spark, d).search(TERMS, ratio=RATIO), fusion.CANDIDATES)


def stored_postings(spark, d):
    """Postings as the stored index has them, after a manual was deleted, added again and all was optimised."""
    store = LexicalStore(spark, f"{checkpoint_dir(spark)}/lexical-{os.urandom(8).hex()}")
    rows = index_rows(spark, d)
    gone = table(spark, d, "removed_keys").filter("target_table = 'manuals'").select(id_key(F.col("target_id")).alias("k"))
    again = rows.select("manual_id").distinct().join(gone.distinct(), F.regexp_replace("manual_id", "-", "") == F.col("k"), "left_semi")
    store.create(rows)
    store.delete(again)
    store.add(rows.join(again, "manual_id", "left_semi"))
    store.optimize()
    store.vacuum()
    return store.postings().drop("bucket")


def stored_after_delete(spark, d):
    """Term statistics of the stored index after the manuals in the deletion log have left it."""
    store = LexicalStore(spark, f"{checkpoint_dir(spark)}/lexical-{os.urandom(8).hex()}")
    rows = index_rows(spark, d)
    gone = table(spark, d, "removed_keys").filter("target_table = 'manuals'").select(id_key(F.col("target_id")).alias("k"))
    store.create(rows)
    store.delete(rows.select("manual_id").distinct().join(gone.distinct(), F.regexp_replace("manual_id", "-", "") == F.col("k"), "left_semi"))
    return store.term_stats()


def _scope(spark, d) -> DataFrame:
    """Ids (manual_id) of all manuals under the product folders of one pattern."""
    return table(spark, d, "manuals").filter(F.col("relative_path").rlike("^Tarvel")).select(F.lower("id").alias("manual_id")).distinct()


def bm25_scoped(spark, d):
    return lexical.top(stored_index(spark, d).search(TERMS, _scope(spark, d), RATIO), fusion.CANDIDATES)


def query_terms(spark, d):
    docs = table(spark, d, "documents")
    return docs.filter("text is not null").select("doc_id", F.array_join(lexical.query_terms(F.col("text")), " ").alias("terms"))


def match_query(spark, d):
    items = table(spark, d, "eval_items")
    return items.select("item_id", lexical.match_query(F.col("text")).alias("match"))


def tokenize(spark, d):
    docs = table(spark, d, "documents")
    t = lexical.tokens(F.col("text"))
    return docs.select("doc_id", F.size(t).alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


def dense_topk(spark, d):
    return vectors.dense_top(chunk_rows(spark, d), query_vector(spark, d), fusion.CANDIDATES)


def dense_topk_filtered(spark, d):
    return vectors.dense_top(chunk_rows(spark, d).join(_scope(spark, d), "manual_id", "left_semi"), query_vector(spark, d), fusion.CANDIDATES)


def chunk_filter(spark, d):
    rows = chunk_rows(spark, d).join(_scope(spark, d), "manual_id", "left_semi")
    return rows.select("id", "manual_id", "kind")


def _lists(spark, d):
    lex = bm25_search(spark, d).withColumnRenamed("chunk_id", "id")
    return dense_topk(spark, d), lex


def rrf_fuse(spark, d):
    dense, lex = _lists(spark, d)
    return fusion.rrf_fuse([(dense, 1.0, 60), (lex, 0.3, 5)]).drop("in_lists")


def retrieval_tag(spark, d):
    return fusion.hybrid(*_lists(spark, d), limit=2 * fusion.CANDIDATES).select("id", "retrieval")


def _manual_names(spark, d) -> DataFrame:
    """One row per manual: the latest row's path and title."""
    last = F.max_by(F.struct("relative_path", "document_title", "file_name", "page_count", "file_hash"), F.struct("updated_at", "file_hash")).alias("m")
    return table(spark, d, "manuals").groupBy(F.lower("id").alias("manual_id")).agg(last).select("manual_id", "m.*")


def _outline(spark, d) -> DataFrame:
    return table(spark, d, "bookmarks").dropDuplicates(["id"])


def _hybrid(spark, d, **scope) -> DataFrame:
    request = search.Request(" ".join(TERMS), query_vector(spark, d), 5, ratio=RATIO, **scope)
    return search.hybrid(request, chunk_rows(spark, d), stored_index(spark, d), _manual_names(spark, d), _outline(spark, d), id_key)


def hybrid_search(spark, d):
    """Fused hits with their manual's path, best five."""
    return _hybrid(spark, d)


def hybrid_scoped(spark, d):
    """The same among the manuals of a path pattern."""
    return _hybrid(spark, d, manual_path=SCOPE)


def hybrid_in_section(spark, d):
    """The same in one section and all below it: that of the least id among those of level 1 with chunks in their own and four more sections."""
    held = chunk_rows(spark, d).filter("bookmark_id is not null").select(F.col("bookmark_id").alias("sub")).distinct()
    wide = section_pairs(spark, d).join(held, "sub", "left_semi").groupBy("bookmark_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5")
    tops = _outline(spark, d).filter("level = 1").withColumn("bookmark_id", id_key(F.col("id")))
    first = tops.join(wide, "bookmark_id", "left_semi").agg(F.min("id")).first()[0]
    if first is None:
        return _hybrid(spark, d).filter(F.lit(False))
    return _hybrid(spark, d, section=first)


def hits_with_manual(spark, d):
    """Every chunk with its manual; chunks of unknown manuals stay, without a path."""
    hits = chunk_rows(spark, d).select("id", "manual_id")
    return hits.join(_manual_names(spark, d).select("manual_id", "relative_path", "document_title"), "manual_id", "left").select("id", "relative_path", "document_title")


def hits_with_figure(spark, d):
    """Figure chunks with their figure; ``figure_missing`` tells a named figure that has no row."""
    figs = table(spark, d, "figures").select(id_key(F.col("id")).alias("figure_id"), F.col("page").alias("figure_page"), "caption").distinct()
    hits = chunk_rows(spark, d).filter("kind = 'figure'").select("id", "figure_id")
    return hits.join(figs, "figure_id", "left").select("id", "figure_page", "caption", (F.col("figure_id").isNotNull() & F.col("figure_page").isNull()).alias("figure_missing"))


def section_pairs(spark, d) -> DataFrame:
    """Every bookmark (bookmark_id) with itself and those below it (sub), as keys."""
    b = _outline(spark, d)
    below = outline.ancestors(b).select(id_key(F.col("ancestor")).alias("bookmark_id"), id_key(F.col("id")).alias("sub"))
    return b.select(id_key(F.col("id")).alias("bookmark_id"), id_key(F.col("id")).alias("sub")).unionByName(below)


def lexical_in_section(spark, d):
    """BM25 hits inside the sections, with all below them, of the bookmarks that the dense hits name."""
    c = chunk_rows(spark, d).select("id", "bookmark_id")
    section = c.join(dense_topk(spark, d).select("id"), "id", "left_semi").select("bookmark_id").filter("bookmark_id is not null").distinct()
    named = section_pairs(spark, d).join(F.broadcast(section), "bookmark_id", "left_semi").select(F.col("sub").alias("bookmark_id"))
    # Chunks of a bookmark without a row are still its own.
    allowed = c.join(section.unionByName(named), "bookmark_id", "left_semi").select(F.col("id").alias("chunk_id"))
    return stored_index(spark, d).search(TERMS, ratio=RATIO).join(allowed, "chunk_id", "left_semi")


def get_by_ids(spark, d):
    """Point reads; the request is every index row's chunk as spelled there, unknown ids are dropped."""
    asked = table(spark, d, "chunks_fts").select("chunk_id").distinct()
    return asked.join(chunk_rows(spark, d).select("id", F.length("document").alias("n_chars"), "kind"), F.col("chunk_id") == F.col("id")).select("id", "n_chars", "kind")


def scroll_filtered(spark, d):
    return chunk_rows(spark, d).filter("kind = 'table'").select("id", "document")


def count_chunks(spark, d):
    return table(spark, d, "chunks").agg(F.countDistinct("id").alias("chunks"))


def l2_normalize(spark, d):
    """Every vector at length 1, as text: all of its numbers to six digits."""
    v = vectors.l2_normalize(F.col("embedding"))
    shown = F.array_join(F.transform(v, lambda x: F.round(x * 1_000_000).cast("bigint").cast("string")), " ")
    return table(spark, d, "embeddings").select("vec_id", F.round(vectors.norm(v), 6).alias("length"), shown.alias("millionths"))


def cosine(spark, d):
    q = F.array(*[F.lit(float(x)) for x in query_vector(spark, d)])
    return table(spark, d, "embeddings").select("vec_id", F.round(vectors.cosine(F.col("embedding"), q), 6).alias("similarity"))


def embed_hash(spark, d):
    """A deterministic embedding of every chunk: hashed trigrams of the lower-cased text in 16 buckets, at length 1; all numbers to six digits."""
    t = F.lower(F.coalesce("content", F.lit("")))
    # All overlapping trigrams in one pass over the text, character by character.
    grams = F.regexp_extract_all(t, F.lit("(?s)(?=(...))."), F.lit(1))
    single = index_rows(spark, d).select("chunk_id", F.explode(grams).alias("g"))
    bucket = F.conv(F.substring(F.md5(F.col("g").cast("binary")), 1, 1), 16, 10).cast("int")
    counts = single.groupBy("chunk_id", bucket.alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    # Sixteen numbers a chunk.
    found = counts.groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"))
    v = vectors.l2_normalize(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda b: F.coalesce(F.col("m")[b], F.lit(0.0))))
    return found.select(F.col("chunk_id").alias("id"), F.array_join(F.transform(v, lambda x: F.round(x * 1_000_000).cast("bigint").cast("string")), " ").alias("millionths"))


def embed_chunks(spark, d):
    """Every chunk through the embedder boundary: dimension and length of its vector (0 for texts without a trigram)."""
    rows = index_rows(spark, d).select(F.col("chunk_id").alias("id"), F.col("content").alias("text"))
    made = embedders.embed_rows(rows, "hash", dimension=64)
    return made.select("id", F.size("embedding").alias("dimension"), F.round(vectors.norm(F.col("embedding")), 4).alias("length"))


QUERIES = {
    f.__name__: f
    for f in (
        hybrid_search, hybrid_scoped, hybrid_in_section, stored_postings, stored_after_delete, bm25_search, bm25_scoped, build_postings, doc_freq, corpus_stats, reindex_lexical, delete_lexical, rarity_gate, query_terms, match_query, tokenize,
        dense_topk, dense_topk_filtered, chunk_filter, rrf_fuse, retrieval_tag, hits_with_manual, hits_with_figure, lexical_in_section, get_by_ids, scroll_filtered,
        count_chunks, l2_normalize, cosine, embed_hash, embed_chunks,
    )
}
SQL = T.search_sql(TERMS, RATIO, lexical._MARKED, lexical._PLAIN)
