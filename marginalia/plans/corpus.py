"""The library tables bound to the core corpus operators (problems 1 and 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.identifiers import chunk_key, chunk_manual_key, id_key
from marginalia.operators import hierarchy as H
from marginalia.operators.orphans import Reference, Target, orphan_counts, orphan_rows
from marginalia.runtime import cut, table


def _references(spark: SparkSession, d: str) -> tuple[list[Reference], list[Target], DataFrame]:
    fig, chk, fts = (table(spark, d, t) for t in ("figures", "chunks", "chunks_fts"))
    man, bkm, gone = (table(spark, d, t) for t in ("manuals", "bookmarks", "removed_keys"))
    c = F.col
    references = [
        Reference("figures", fig, c("id"), "manual_id", "manuals", id_key(c("manual_id")), c("created_at")),
        Reference("figures", fig, c("id"), "bookmark_id", "bookmarks", id_key(c("bookmark_id")), c("created_at")),
        Reference("chunks", chk, c("id"), "id", "manuals", chunk_manual_key(c("id")), c("added_at")),
        Reference("chunks_fts", fts, c("chunk_id"), "chunk_id", "chunks", chunk_key(c("chunk_id")), c("indexed_at")),
    ]
    targets = [
        Target("manuals", man, id_key(c("id")), c("updated_at")),
        Target("bookmarks", bkm, id_key(c("id")), None),
        Target("chunks", chk, chunk_key(c("id")), c("added_at")),
    ]
    removed = gone.select(
        "target_table", F.when(c("target_table") == "chunks", chunk_key(c("target_id"))).otherwise(id_key(c("target_id"))).alias("key"), "removed_at"
    )
    return references, targets, removed


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Broken references of figures, chunks and index rows: table_name, record_id, ref_field."""
    return orphan_rows(*_references(spark, d), cut).select("table_name", "record_id", "ref_field")


def p1_orphan_counts(spark: SparkSession, d: str) -> DataFrame:
    """Broken references per table, field and calendar month of the referring record."""
    return orphan_counts(*_references(spark, d), cut)


def _outline(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return H.nodes_of(table(spark, d, "bookmarks"), id_key(c("id")), c("id"), id_key(c("parent_id")), id_key(c("manual_id")), c("ordering"), c("level"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Bookmarks without a sound place: bookmark_id, kind, ref_id."""
    return H.unsound(_outline(spark, d), cut).withColumnRenamed("id", "bookmark_id")


def p4_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Path, depth, root and number of descendants of every bookmark; the path as ids joined by ``/``."""
    return H.hierarchy(_outline(spark, d), cut).withColumnRenamed("id", "bookmark_id").withColumn("path", F.array_join("path", "/"))


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every bookmark below every bookmark, with its distance."""
    return H.descendants(_outline(spark, d), cut)



#: DuckDB expressions for the spellings of ids.
_WS = r" \t\r\n\x{A0}\x{202F}\x{3000}"


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def _core(x: str) -> str:
    return rf"lower(replace(regexp_replace({x}, '^[{_WS}{{}}]+|[{_WS}{{}}]+$', '', 'g'), '-', ''))"


def _id(x: str) -> str:
    return f"CASE WHEN lower({_trim(x)}) NOT IN ('', 'none', 'null') THEN {_core(x)} END"


def _manual(x: str) -> str:
    return f"CASE WHEN contains({x}, '_') THEN {_core(f"regexp_extract({x}, '^((?s:.*))_[^_]*$', 1)")} END"


def _chunk(x: str) -> str:
    return f"({_manual(x)}) || '_' || {_core(f"regexp_extract({x}, '_([^_]*)$', 1)")}"


_P1 = f"""
WITH refs AS (
  SELECT t, f, tt, k, rid, min(dt) AS fd FROM (
    SELECT 'figures' AS t, 'manual_id' AS f, 'manuals' AS tt, {_id("manual_id")} AS k, id AS rid, created_at AS dt FROM figures
    UNION ALL SELECT 'figures', 'bookmark_id', 'bookmarks', {_id("bookmark_id")}, id, created_at FROM figures
    UNION ALL SELECT 'chunks', 'id', 'manuals', {_manual("id")}, id, added_at FROM chunks
    UNION ALL SELECT 'chunks_fts', 'chunk_id', 'chunks', {_chunk("chunk_id")}, chunk_id, indexed_at FROM chunks_fts)
  WHERE k IS NOT NULL GROUP BY ALL),
tgt AS (
  SELECT tt, k, min(dt) AS d0, max(dt) AS d1 FROM (
    SELECT 'manuals' AS tt, {_id("id")} AS k, updated_at AS dt FROM manuals
    UNION ALL SELECT 'bookmarks', {_id("id")}, NULL FROM bookmarks
    UNION ALL SELECT 'chunks', {_chunk("id")}, added_at FROM chunks) GROUP BY ALL),
rem AS (
  SELECT target_table AS tt, CASE WHEN target_table = 'chunks' THEN {_chunk("target_id")} ELSE {_id("target_id")} END AS k, max(removed_at) AS r
  FROM removed_keys GROUP BY ALL),
cases AS (
  SELECT refs.*, tgt.k IS NULL OR (rem.k IS NOT NULL AND (d1 IS NULL OR r >= d1)) OR (fd < d0) AS bad
  FROM refs LEFT JOIN tgt USING (tt, k) LEFT JOIN rem USING (tt, k))
"""
_P4 = f"""
WITH RECURSIVE n AS (
  SELECT {_id("id")} AS k, min(id) AS id, min({_id("parent_id")}) AS p, min({_id("manual_id")}) AS m, min(ordering) AS o, min(level) AS l FROM bookmarks GROUP BY 1),
up(k, cur, hops, way) AS (
  SELECT k, k, 1, [k] FROM n
  UNION ALL SELECT up.k, n2.k, hops + 1, list_append(way, n2.k) FROM up JOIN n n1 ON n1.k = up.cur JOIN n n2 ON n2.k = n1.p WHERE NOT list_contains(way, n2.k)),
ends AS (SELECT up.k, up.hops, n.id AS eid, n.p FROM up JOIN n ON n.k = up.cur WHERE n.p IS NULL OR n.p NOT IN (SELECT k FROM n WHERE k IS NOT NULL)),
turns AS (SELECT up.k, unnest(way[list_position(way, n.p):]) AS member FROM up JOIN n ON n.k = up.cur WHERE list_contains(way, n.p)),
ring AS (SELECT turns.k, min(n.id) AS rid FROM turns JOIN n ON n.k = member GROUP BY 1)
"""

SQL = {
    "p1_found": _P1 + "SELECT t AS table_name, rid AS record_id, f AS ref_field FROM cases WHERE bad",
    "p1_orphan_counts": _P1 + "SELECT t AS table_name, f AS ref_field, strftime(fd AT TIME ZONE 'UTC', '%Y-%m') AS period, count(*) AS orphans FROM cases WHERE bad GROUP BY ALL",
    "p4_found": _P4
    + """
SELECT n.id AS bookmark_id, 'loop' AS kind, rid AS ref_id FROM ring JOIN n USING (k)
UNION ALL SELECT n.id, 'cut', eid FROM ends JOIN n USING (k) WHERE ends.p IS NOT NULL
UNION ALL SELECT n.id, 'depth', eid FROM ends JOIN n USING (k) WHERE ends.p IS NULL AND hops IS DISTINCT FROM n.l
UNION ALL SELECT a.id, 'order', b.id FROM n a JOIN n b ON b.k = a.p AND b.m = a.m AND b.o >= a.o WHERE a.k IN (SELECT k FROM ends)""",
    "p4_descendants": _P4 + "SELECT b.id AS ancestor_id, a.id AS descendant_id, up.hops - 1 AS distance FROM up JOIN ends USING (k) JOIN n a ON a.k = up.k JOIN n b ON b.k = up.cur WHERE up.hops > 1",
    "p4_hierarchy": _P4
    + """,
paths AS (SELECT up.k, string_agg(n.id, '/' ORDER BY up.hops DESC) AS path FROM up JOIN ends USING (k) JOIN n ON n.k = up.cur GROUP BY up.k),
below AS (SELECT up.cur AS k, count(*) AS c FROM up JOIN ends USING (k) WHERE up.hops > 1 GROUP BY 1)
SELECT n.id AS bookmark_id, CASE WHEN ends.p IS NULL THEN 'root' ELSE 'cut' END AS kind, eid AS root_id, NULL::VARCHAR AS loop_id, hops::BIGINT AS depth, path, coalesce(c, 0) AS n_descendants
FROM ends JOIN n USING (k) JOIN paths USING (k) LEFT JOIN below USING (k)
UNION ALL SELECT n.id, 'loop', NULL, rid, NULL, NULL, NULL FROM ring JOIN n USING (k)""",
}
QUERIES = {f.__name__: f for f in (p1_found, p1_orphan_counts, p4_found, p4_hierarchy, p4_descendants)}
