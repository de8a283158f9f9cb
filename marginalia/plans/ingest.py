"""Source queries: files, parsing and batching over the tables' texts."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from marginalia.plans.library import figures, manuals, marks
from marginalia.plans.search import chunk_rows
from marginalia.runtime import checkpoint_dir, table
from marginalia.sources import documents as D

c = F.col


def _contents(s, d):
    docs = table(s, d, "documents")
    return docs.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.encode("text", "UTF-8").alias("content"))


def fingerprint(s, d):
    """Hash, title and outline of every document; null texts come out as errors."""
    return D.fingerprints(_contents(s, d), D.MarkdownParser()).select("path", "file_hash", "page_count", "error")


def parse_items(s, d):
    """Layout items of every document."""
    return D.parse_items(_contents(s, d), D.MarkdownParser())


def plan_batches(s, d):
    """Embedding batches of all chunks under a budget of padded words."""
    rows = chunk_rows(s, d).select("id", F.size(F.split(F.coalesce("document", F.lit("")), " ")).alias("length"))
    return D.batched(rows, 24_576)


def batch_checks(s, d):
    """What must hold of the batches: every chunk in one, and none over the budget but single texts."""
    b = plan_batches(s, d)
    # Arrow batches of different tasks may have the same number: tasks are told apart by what they hold.
    sized = b.withColumn("task", F.spark_partition_id()).groupBy("task", "frame", "batch").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest"))
    over = sized.agg(F.count_if((c("n") > 1) & (c("n") * c("longest") > 24_576)).alias("over"))
    # One row each.
    return b.agg(F.count(F.lit(1)).alias("texts"), F.countDistinct("id").alias("ids")).crossJoin(F.broadcast(over))


def archive_roundtrip(s, d):
    """One folder's manuals exported and imported again: rows per member."""
    m = manuals(s, d).filter(F.col("relative_path").startswith("Tarvel OS/")).select(F.lower("id").alias("id"), "relative_path", "file_hash")
    b = marks(s, d).select("id", F.lower("manual_id").alias("manual_id"), "title")
    f = table(s, d, "figures").select("id", F.lower("manual_id").alias("manual_id"), "page", "image").distinct()
    c = chunk_rows(s, d).select("id", "manual_id", "document", "embedding")
    base = os.path.join(checkpoint_dir(s), "archive", os.urandom(6).hex())
    D.write_archive(base, m, b, f, c, "model")
    schemas = {n: ", ".join(f"{x} {t}" for x, t in r.dtypes) for n, r in (("manuals", m), ("bookmarks", b), ("figures", f), ("chunks", c))}
    got = D.read_archive(s, base, m.filter("false"), "model", schemas)
    counts = [r.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("member"), "rows") for n, r in got.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


_M = "(SELECT DISTINCT lower(id) FROM m WHERE starts_with(relative_path, 'Tarvel OS/'))"
QUERIES = {f.__name__: f for f in (fingerprint, parse_items, plan_batches, batch_checks, archive_roundtrip)}
_SPACE = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SQL = {
    "parse_items": rf"""
WITH pages AS (SELECT doc_id, unnest(string_split(text, chr(12))) AS page, unnest(range(1, len(string_split(text, chr(12))) + 1)) AS p FROM documents WHERE text IS NOT NULL),
parts AS (SELECT doc_id, p, string_split_regex(page, '\n[ \t]*\n') AS b FROM pages),
blocks AS (SELECT doc_id, p, unnest(list_filter(b, lambda x: regexp_matches(x, '[^{_SPACE}]'))) AS b, unnest(range(0, len(list_filter(b, lambda x: regexp_matches(x, '[^{_SPACE}]'))))) AS k FROM parts),
bare AS (SELECT *, regexp_replace(b, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g') AS t FROM blocks),
head AS (SELECT *, regexp_matches(t, '^#{{1,6}}[{_SPACE}]+') AS h, regexp_matches(b, '^[{_SPACE}]*[|]') AS bar FROM bare)
SELECT 'doc/' || doc_id || '.md' AS path, (row_number() OVER (PARTITION BY doc_id ORDER BY p, k) - 1)::INT AS seq, CASE WHEN h THEN 'section_header' WHEN bar THEN 'table' ELSE 'text' END AS label,
  CASE WHEN h THEN regexp_extract(t, '^#{{1,6}}[{_SPACE}]+([^\n]*)', 1) ELSE t END AS text, p::INT AS page, 800.0::DOUBLE - 10.0::DOUBLE * k AS top, NULL::VARCHAR AS error FROM head
UNION ALL SELECT 'doc/' || doc_id || '.md', NULL, NULL, NULL, NULL, NULL, 'ValueError: no content' FROM documents WHERE text IS NULL""",
    "batch_checks": "SELECT count(DISTINCT id) AS texts, count(DISTINCT id) AS ids, 0::BIGINT AS over FROM chunks",
    "fingerprint": r"SELECT 'doc/' || doc_id || '.md' AS path, sha256(text) AS file_hash, CASE WHEN text IS NOT NULL THEN length(text) - length(replace(text, chr(12), '')) + 1 END AS page_count, CASE WHEN text IS NULL THEN 'ValueError: no content' END AS error FROM documents",
    "archive_roundtrip": f"""WITH m AS (SELECT id, arg_max(relative_path, struct_pack(u := updated_at, h := file_hash)) AS relative_path FROM manuals GROUP BY id)
SELECT 'manuals' AS member, count(*) AS rows FROM m WHERE starts_with(relative_path, 'Tarvel OS/')
UNION ALL SELECT 'bookmarks', count(DISTINCT id) FROM bookmarks WHERE lower(manual_id) IN {_M}
UNION ALL SELECT 'figures', count(DISTINCT id) FROM figures WHERE lower(manual_id) IN {_M}
UNION ALL SELECT 'chunks', count(DISTINCT id) FROM chunks WHERE regexp_replace(lower(id), '_[^_]*$', '') IN {_M} AND len(embedding) > 0""",
}
