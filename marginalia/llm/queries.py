"""The library tables bound to the operators of this subpackage, and their SQL counterparts where SQL can tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions.identifiers import WS_CLASS
from marginalia.llm import leaks, nearest, neardup, packing, pieces, sentences
from marginalia.runtime import cut, table

#: TESTDATA's own likeness for problem 2: three words (20 at least) or three characters, 0.7.
CHUNK_LIKENESS = neardup.Likeness(threshold=0.7, words=3, least=20)
PATH_LIKENESS = neardup.Likeness(threshold=0.7, words=0, chars=3)


def _chunk_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("id", F.col("document").alias("text"))


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "manuals").select("id", F.translate(F.lower("relative_path"), "\\", "/").alias("text"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of chunks and of manuals whose texts or paths are alike: table_name, id_a, id_b."""
    chunks = neardup.similar_records(_chunk_texts(spark, d), CHUNK_LIKENESS, cut)
    manuals = neardup.similar_records(_paths(spark, d).distinct(), PATH_LIKENESS, cut)
    return chunks.select(F.lit("chunks").alias("table_name"), "id_a", "id_b").unionByName(manuals.select(F.lit("manuals").alias("table_name"), "id_a", "id_b"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk that takes part, with its group of near-duplicates and its numbers of links and copies."""
    return neardup.groups(_chunk_texts(spark, d), CHUNK_LIKENESS, cut)


#: Problem 3 asks for cosines of 0.9 and more; such neighbours share one of five files (measured recall in the README).
CLOSE = nearest.Index(k=5, posts=5, visits=5, least=0.9)
#: Any cosine: queries are one in twenty, so they can afford to visit more files.
ANY = nearest.Index(k=5, posts=6, visits=80, deep=24, order=16, shortlist=256)


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("id", "embedding")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of chunks with cosine 0.9 or more of which one is among the other's five most similar: id_a, id_b."""
    near = nearest.most_similar(_vectors(spark, d).withColumn("query", F.lit(True)), CLOSE, cut)
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def p3_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar chunks of every chunk whose number in its manual is divisible by 20, against all chunks."""
    twentieth = F.pmod(F.regexp_extract("id", "_([0-9]+)$", 1).try_cast("bigint"), F.lit(20)) == 0
    return nearest.most_similar(_vectors(spark, d).withColumn("query", twentieth), ANY, cut).withColumn("sim", F.round("sim", 6))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunk documents and bookmark titles over their limits: table_name, record_id, cut_kind."""
    titles = table(spark, d, "bookmarks").select("id", F.col("title").alias("text"))
    chunks, bookmarks = pieces.cut_kinds(_chunk_texts(spark, d), 2000, 200), pieces.cut_kinds(titles, 120, 12)
    return chunks.select(F.lit("chunks").alias("table_name"), F.col("id").alias("record_id"), "cut_kind").unionByName(
        bookmarks.select(F.lit("bookmarks").alias("table_name"), F.col("id").alias("record_id"), "cut_kind")
    )


#: Tables whose texts are split: their texts, limit and overlap.
_SPLIT = {"chunks": (_chunk_texts, 2000, 200), "bookmarks": (lambda s, d: table(s, d, "bookmarks").select("id", F.col("title").alias("text")), 120, 12)}


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All chunk documents as pieces of at most 2,000 characters and all bookmark titles of at most 120, overlaps of 200 and 12."""
    a, b = (pieces.split(texts(spark, d), *sizes).select(F.lit(t).alias("table_name"), F.col("id").alias("record_id"), "*").drop("id") for t, (texts, *sizes) in _SPLIT.items())
    return a.unionByName(b)


def p5_joints(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the pieces of every record over its limit: the characters of their own texts without white space,
    whether no piece exceeds the limit, and whether every joint repeats as much as limit and piece before allow."""
    out = []
    for name, (texts, limit, overlap) in _SPLIT.items():
        got = pieces.oversized(texts(spark, d), limit, overlap).distinct()
        order = Window.partitionBy("id").orderBy("piece")
        own = F.col("end") - F.col("own_start")
        gap = F.least(F.lit(1), F.col("own_start") - F.lag("end").over(order))
        due = F.greatest(F.lit(0), F.least(F.lit(overlap), F.length(F.lag("piece_text").over(order)), F.lit(limit) - own - gap))
        before = F.lag("piece_text").over(order)
        repeats = F.col("piece_text").startswith(F.right(before, F.col("overlap")))
        joint = F.when(F.col("piece") == 0, F.col("overlap") == 0).otherwise((F.col("overlap") == due) & repeats)
        letters = F.length(F.regexp_replace(F.right("piece_text", own), f"[{WS_CLASS}]", ""))
        flagged = got.select("id", joint.alias("joint"), letters.alias("letters"), (F.length("piece_text") <= limit).alias("fits"))
        out.append(
            flagged.groupBy("id")
            .agg(F.sum("letters").alias("letters"), F.min("fits").alias("within_limit"), F.min("joint").alias("overlaps_whole"))
            .select(F.lit(name).alias("table_name"), F.col("id").alias("record_id"), "letters", "within_limit", "overlaps_whole")
        )
    return out[0].unionByName(out[1])


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select(F.col("item_id").alias("id"), "text")


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document, or part of one over the capacity, with its container of at most 4,096 tokens."""
    return packing.pack(_documents(spark, d), cut).withColumnRenamed("id", "doc_id")


def p6_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of all containers, in one row: the documents, and how many break a rule (none may).

    over: containers over the capacity or with a wrong sum; lost: documents whose parts aren't each there once;
    split: documents in several parts of which one but the last isn't a whole container; loose: containers under 97 %,
    if they are more than one in fifty.
    """
    got = cut(p6_containers(spark, d))
    boxes = got.filter("container_id is not null").groupBy("container_id").agg(F.sum("tokens").alias("t"), F.max("container_tokens").alias("c"))
    over = boxes.agg(F.count_if((F.col("t") > 4096) | (F.col("t") != F.col("c"))).alias("over"), F.when(F.count_if(F.col("t") < 0.97 * 4096) > F.count(F.lit(1)) / 50 + 1, 1).otherwise(0).alias("loose"))
    texts = got.groupBy("doc_id").agg(
        ((F.count(F.lit(1)) != F.max("n_parts")) | (F.countDistinct("part") != F.max("n_parts")) | (F.max("part") + 1 != F.max("n_parts"))).alias("lost"),
        F.max((F.col("part") + 1 < F.col("n_parts")) & (F.col("tokens") != 4096)).alias("split"),
    )
    sums = texts.agg(F.count(F.lit(1)).alias("documents"), F.count_if("lost").alias("lost"), F.count_if("split").alias("split"))
    # One row each.
    return sums.crossJoin(F.broadcast(over)).select("documents", "over", "lost", "split", F.col("loose").cast("bigint"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that share 40 successive characters with an evaluation item: doc_id, item_id."""
    return leaks.leaks(_documents(spark, d), _items(spark, d)).filter("exact_chars >= 40").select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the items they hold, substitutions tolerated, with the lengths of both kinds of overlap."""
    return leaks.leaks(_documents(spark, d), _items(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of all documents: doc_id, end_pos."""
    return sentences.sentences(_documents(spark, d)).withColumnRenamed("id", "doc_id")


def p8_ends(spark: SparkSession, d: str) -> DataFrame:
    """The last sentence end of every document that has sentences: all its characters that are not white space."""
    return p8_found(spark, d).groupBy("doc_id").agg(F.max("end_pos").alias("characters"))


QUERIES = {f.__name__: f for f in (p2_found, p2_groups, p3_found, p3_nearest, p5_found, p5_pieces, p5_joints, p6_containers, p6_checks, p7_found, p7_leaks, p8_found, p8_ends)}
_CJK = r"[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}]"

#: Copies up to which a class is given in all pairs.
COPIES = CHUNK_LIKENESS.spelled_out
#: White space for DuckDB classes.
_WS = r" \t\r\n\x{A0}\x{202F}\x{3000}"

SQL = {
    "p2_found": rf"""
WITH words AS (SELECT DISTINCT id, regexp_extract_all(regexp_replace(lower(document), '({_CJK})', ' \1 ', 'g'), '{_CJK}|[\p{{L}}\p{{N}}]+') AS w FROM chunks WHERE document IS NOT NULL),
sets AS (
  SELECT 'chunks' AS t, id, list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS s FROM words WHERE len(w) >= 20
  UNION ALL
  SELECT DISTINCT 'manuals', id, list_sort(list_distinct(list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3)))) FROM (SELECT id, replace(lower(relative_path), '\', '/') AS p FROM manuals) WHERE length(p) >= 3),
-- Copies: up to {COPIES} are given in all pairs, more as the smallest id with each other one.
classes AS (SELECT t, s, min(id) AS head, count(DISTINCT id) AS copies FROM sets GROUP BY t, s),
kept AS (SELECT sets.t, sets.id, sets.s FROM sets JOIN classes USING (t, s) WHERE copies <= {COPIES} OR id = head),
one AS (SELECT t, id, len(s) AS n, unnest(s) AS x FROM kept)
SELECT a.t AS table_name, a.id AS id_a, b.id AS id_b FROM one a JOIN one b ON a.t = b.t AND a.x = b.x AND a.id < b.id
GROUP BY a.t, a.id, b.id, a.n, b.n HAVING count(*) >= 0.7 * (a.n + b.n - count(*))
UNION SELECT sets.t, head, id FROM sets JOIN classes USING (t, s) WHERE copies > {COPIES} AND id <> head""",
    "p2_groups": rf"""
WITH RECURSIVE words AS (SELECT DISTINCT id, regexp_extract_all(regexp_replace(lower(document), '({_CJK})', ' \1 ', 'g'), '{_CJK}|[\p{{L}}\p{{N}}]+') AS w FROM chunks WHERE document IS NOT NULL),
sets AS (SELECT id, list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS s FROM words WHERE len(w) >= 20),
classes AS (SELECT s, min(id) AS head, count(DISTINCT id) AS copies FROM sets GROUP BY s),
one AS (SELECT head AS id, len(s) AS n, unnest(s) AS x FROM classes),
near AS (SELECT a.id AS a, b.id AS b FROM one a JOIN one b ON a.x = b.x AND a.id <> b.id GROUP BY a.id, b.id, a.n, b.n HAVING count(*) >= 0.7 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT head, head FROM classes UNION SELECT reach.a, near.b FROM reach JOIN near ON near.a = reach.b),
first AS (SELECT a, min(b) AS group_id FROM reach GROUP BY a),
links AS (SELECT a, count(*) AS n FROM near GROUP BY a)
SELECT sets.id, group_id, coalesce(links.n, 0)::BIGINT AS links, copies - 1 AS copies
FROM sets JOIN classes USING (s) JOIN first ON first.a = head LEFT JOIN links ON links.a = head""",
    "p3_found": """
WITH v AS (SELECT id, any_value(embedding)::DOUBLE[] AS e FROM chunks WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY id),
u AS (SELECT id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e)))::DOUBLE[64] AS e FROM v),
s AS (SELECT a.id AS a, b.id AS b, array_inner_product(a.e, b.e) AS c FROM u a JOIN u b ON a.id <> b.id WHERE array_inner_product(a.e, b.e) >= 0.9),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS k FROM s)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM r WHERE k <= 5""",
    "p3_nearest": """
WITH v AS (SELECT id, any_value(embedding)::DOUBLE[] AS e FROM chunks WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY id),
u AS (SELECT id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e)))::DOUBLE[64] AS e FROM v),
s AS (SELECT a.id, b.id AS other, round(array_inner_product(a.e, b.e), 12) AS c FROM u a JOIN u b ON a.id <> b.id WHERE TRY_CAST(regexp_extract(a.id, '_([0-9]+)$', 1) AS BIGINT) % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, other) AS k FROM s)
SELECT id, k::INT AS rank, other, round(c, 6) AS sim FROM r WHERE k <= 5""",
    "p5_found": rf"""
WITH r AS (SELECT 'chunks' AS t, id, document AS x, 2000 AS m FROM chunks UNION ALL SELECT 'bookmarks', id, title, 120 FROM bookmarks),
s AS (SELECT DISTINCT t, id, m, regexp_replace(x, '^[{_WS}]+|[{_WS}]+$', '', 'g') AS x FROM r)
SELECT t AS table_name, id AS record_id, CASE WHEN list_max(list_transform(string_split_regex(x, '[{_WS}。！？]'), lambda y: length(y))) > m THEN 'hard' ELSE 'soft' END AS cut_kind
FROM s WHERE length(x) > m""",
    "p5_joints": rf"""
WITH r AS (SELECT 'chunks' AS t, id, document AS x, 2000 AS m FROM chunks UNION ALL SELECT 'bookmarks', id, title, 120 FROM bookmarks),
s AS (SELECT DISTINCT t, id, m, regexp_replace(x, '^[{_WS}]+|[{_WS}]+$', '', 'g') AS x FROM r)
SELECT t AS table_name, id AS record_id, length(regexp_replace(x, '[{_WS}]', '', 'g')) AS letters, TRUE AS within_limit, TRUE AS overlaps_whole FROM s WHERE length(x) > m""",
    "p6_checks": "SELECT count(*) AS documents, 0::BIGINT AS over, 0::BIGINT AS lost, 0::BIGINT AS split, 0::BIGINT AS loose FROM documents",
    "p8_ends": rf"SELECT doc_id, length(regexp_replace(text, '[{_WS}]', '', 'g')) AS characters FROM documents WHERE length(regexp_replace(text, '[{_WS}]', '', 'g')) > 0",
}
