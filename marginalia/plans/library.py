"""Library, outline and chunking queries over the tables, each with its SQL counterpart."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.identifiers import id_key
from marginalia.operators import chunking as C
from marginalia.operators import library as L
from marginalia.operators import ordered as R
from marginalia.operators import outline as O
from marginalia.plans import sqltext as T
from marginalia.plans.search import chunk_rows, section_pairs
from marginalia.runtime import checkpoint_dir, cut, table
from marginalia.sources.chunk_store import ChunkStore
from marginalia.sources.manifest import united

c = F.col
QUERIES: dict = {}
SQL: dict[str, str] = {}
GLOBS = ["Tarvel*/V?R[1-4]/*.pdf", "Ilmaru Tools/*"]
NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"  # fixed value: the DNS namespace of RFC 4122


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


# Base tables, one row per record, and the same in SQL.
def manuals(s, d) -> DataFrame:
    return L.latest(table(s, d, "manuals").withColumn("_o", c("updated_at")), "id", "_o", "file_hash").drop("_o")


def marks(s, d) -> DataFrame:
    return table(s, d, "bookmarks").dropDuplicates(["id"])


def figures(s, d) -> DataFrame:
    return table(s, d, "figures").drop("image", "created_at").distinct()


def items(s, d) -> DataFrame:
    """Chunks read as layout items, in their order within the manual."""
    seq = F.regexp_extract("id", "_([0-9]+)$", 1).cast("int")
    r = chunk_rows(s, d).select("manual_id", seq.alias("seq"), "kind", c("document").alias("text"), "page")
    label = F.when(c("kind") == "table", "table").when(c("kind") == "figure", "picture").when(F.length("text") < 60, "section_header").otherwise("text")
    return r.select(
        "manual_id", "seq", label.alias("label"), "text", F.coalesce("page", c("seq") + 1).alias("page"), (700.0 - (c("seq") * 37) % 700).alias("top"),
        F.lit(None).cast("string").alias("caption"), F.lit(None).cast("string").alias("labels"), c("text").alias("description"),
    )


M = """m AS (SELECT id, r.* FROM (SELECT id, arg_max(struct_pack(file_name := file_name, document_title := document_title, relative_path := relative_path, file_hash := file_hash,
  page_count := page_count, updated_at := updated_at, converted_at := converted_at), struct_pack(u := updated_at, h := file_hash)) AS r FROM manuals GROUP BY id))"""
B = "b AS (SELECT DISTINCT * FROM bookmarks)"
FG = "f AS (SELECT DISTINCT * EXCLUDE (image, created_at) FROM figures)"
IT = f"""{T.CHUNKS.strip()}, it AS (SELECT manual_id, regexp_extract(id, '_([0-9]+)$', 1)::INT AS seq,
  CASE WHEN kind = 'table' THEN 'table' WHEN kind = 'figure' THEN 'picture' WHEN length(document) < 60 THEN 'section_header' ELSE 'text' END AS label, document AS text,
  coalesce(page, regexp_extract(id, '_([0-9]+)$', 1)::INT + 1) AS page, (700.0 - (regexp_extract(id, '_([0-9]+)$', 1)::INT * 37) % 700)::DOUBLE AS top FROM c)"""


@query()
def scan_files(s, d):
    """Files below a folder, without reading their content."""
    return s.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(d).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


@query(f"WITH {M} SELECT id, relative_path FROM m WHERE regexp_full_match(relative_path, 'Tarvel.*/V.R[1-4]/.*[.]pdf') OR relative_path LIKE 'Ilmaru Tools/%'")
def include_globs(s, d):
    return manuals(s, d).filter(L.include(c("relative_path"), GLOBS)).select("id", "relative_path")


@query("SELECT doc_id, sha256(text) AS hash FROM documents WHERE text IS NOT NULL")
def content_hash(s, d):
    return table(s, d, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("hash"))


@query("SELECT id, arg_min(file_hash, struct_pack(u := updated_at, h := file_hash)) AS old, arg_max(file_hash, struct_pack(u := updated_at, h := file_hash)) AS new FROM manuals WHERE file_hash IS NOT NULL GROUP BY id HAVING count(DISTINCT file_hash) > 1")
def changed_files(s, d):
    """Manuals whose hash changed at any sync, with the first and the last one."""
    return L.changed(table(s, d, "manuals"), "id", "file_hash", "updated_at")


SYNC = """k AS (SELECT relative_path, min(file_hash) AS old FROM (SELECT relative_path, file_hash FROM manuals WHERE updated_at < TIMESTAMPTZ '2025-01-01 00:00:00+00') GROUP BY 1),
n AS (SELECT relative_path, max(file_hash) AS new FROM manuals WHERE page_count < 100 GROUP BY 1)"""


def _sync(s, d):
    m = table(s, d, "manuals").filter("relative_path is not null")
    known = m.filter(c("updated_at") < F.lit("2025-01-01").cast("timestamp")).groupBy("relative_path").agg(F.min("file_hash").alias("file_hash"))
    return L.sync_actions(known, m.filter("page_count < 100").groupBy("relative_path").agg(F.max("file_hash").alias("file_hash")))


@query(f"WITH {SYNC} SELECT relative_path, CASE WHEN new IS NULL THEN 'delete' WHEN old IS NULL THEN 'add' WHEN old = new THEN 'keep' ELSE 'replace' END AS action FROM k FULL JOIN n USING (relative_path) WHERE relative_path IS NOT NULL")
def sync_diff(s, d):
    return _sync(s, d)


@query(f"WITH {SYNC} SELECT relative_path FROM k WHERE relative_path IS NOT NULL AND relative_path NOT IN (SELECT relative_path FROM n WHERE relative_path IS NOT NULL)")
def deleted_paths(s, d):
    return _sync(s, d).filter("action = 'delete'").select("relative_path")


def _two_syncs(s, d):
    """The manuals as stored before 2025, and those that were synced since."""
    m = table(s, d, "manuals")
    day = F.lit("2025-01-01").cast("timestamp")
    one = lambda rows: L.latest(rows.withColumn("_o", c("updated_at")), "id", "_o", "file_hash").drop("_o")
    return one(m.filter(c("updated_at") < day)), one(m.filter(c("updated_at") >= day))


TWO = """s AS (SELECT id, arg_max(struct_pack(p := relative_path, h := file_hash), struct_pack(u := updated_at, h := file_hash)) AS r FROM manuals WHERE updated_at < TIMESTAMPTZ '2025-01-01 00:00:00+00' GROUP BY 1),
i AS (SELECT id, arg_max(struct_pack(p := relative_path, h := file_hash), struct_pack(u := updated_at, h := file_hash)) AS r FROM manuals WHERE updated_at >= TIMESTAMPTZ '2025-01-01 00:00:00+00' GROUP BY 1),
y AS (SELECT id, CASE WHEN i.r IS NULL THEN 'rest' WHEN s.r IS NULL THEN 'insert' WHEN s.r.h IS NOT DISTINCT FROM i.r.h THEN 'keep' ELSE 'rewrite' END AS action, s.r AS sr, i.r AS ir FROM s FULL JOIN i USING (id))"""


@query(f"WITH {M} SELECT id, relative_path, file_hash, page_count FROM m WHERE updated_at IS NOT NULL")
def upsert_manuals(s, d):
    """The stored manuals with those of the later syncs written over them."""
    return L.upsert(*_two_syncs(s, d), "id").select("id", "relative_path", "file_hash", "page_count")


@query(f"WITH {TWO} SELECT id, action, CASE WHEN action IN ('keep', 'rest') THEN sr.p ELSE ir.p END AS relative_path FROM y")
def sync_manuals(s, d):
    """Manuals after a sync, gated by their hashes: a manual with the same hash stays untouched."""
    return L.sync_manuals(*_two_syncs(s, d)).select("id", "action", "relative_path")


@query(f"WITH {TWO}, g AS (SELECT {T.key('id')} AS k FROM y WHERE action = 'rewrite') SELECT 'bookmarks' AS table_name, count(DISTINCT id) AS rows FROM bookmarks WHERE {T.key('manual_id')} IS NULL OR {T.key('manual_id')} NOT IN (SELECT k FROM g) UNION ALL SELECT 'figures', count(DISTINCT id) FROM figures WHERE {T.key('manual_id')} IS NULL OR {T.key('manual_id')} NOT IN (SELECT k FROM g)")
def sync_children(s, d):
    """Bookmarks and figures that stay when the files of rewritten manuals are read anew."""
    gone = L.sync_manuals(*_two_syncs(s, d)).filter("action = 'rewrite'").select(id_key(c("id")).alias("manual_key"))
    left = L.without({t: table(s, d, t).select("id", id_key(c("manual_id")).alias("manual_key")) for t in ("bookmarks", "figures")}, gone)
    counts = [r.agg(F.countDistinct("id").alias("rows")).select(F.lit(t).alias("table_name"), "rows") for t, r in left.items()]
    return counts[0].unionByName(counts[1])


_GONE = f"g AS (SELECT {T.key('id')} AS k FROM m WHERE starts_with(relative_path, 'Tarvel OS/'))"
_CHILD = {"bookmarks": T.key("manual_id"), "figures": T.key("manual_id"), "chunks": T.core("regexp_replace(id, '_[^_]*$', '')"), "chunks_fts": T.core("regexp_replace(chunk_id, '_[^_]*$', '')")}


@query(f"WITH {M}, {_GONE} SELECT 'manuals' AS table_name, count(*) AS rows FROM m WHERE {T.key('id')} NOT IN (SELECT k FROM g)" + "".join(f" UNION ALL SELECT '{t}', count(DISTINCT {'chunk_id' if t == 'chunks_fts' else 'id'}) FROM {t} WHERE coalesce({k}, '') NOT IN (SELECT k FROM g)" for t, k in _CHILD.items()))
def delete_cascade(s, d):
    """What stays of every table when all manuals under a folder are deleted with all that belongs to them."""
    m = manuals(s, d).withColumn("manual_key", id_key(c("id")))
    child = lambda col: id_key(F.regexp_replace(col, "_[^_]*$", ""))
    tables = {
        "manuals": m.select("id", "manual_key"), "bookmarks": marks(s, d).select("id", id_key(c("manual_id")).alias("manual_key")), "figures": figures(s, d).select("id", id_key(c("manual_id")).alias("manual_key")),
        "chunks": chunk_rows(s, d).select("id", child("id").alias("manual_key")), "chunks_fts": table(s, d, "chunks_fts").select(c("chunk_id").alias("id"), child("chunk_id").alias("manual_key")),
    }
    left = L.without(tables, m.filter(c("relative_path").startswith("Tarvel OS/")))
    return united([r.agg(F.countDistinct("id").alias("rows")).select(F.lit(t).alias("table_name"), "rows") for t, r in left.items()])


@query(f"WITH {T.CHUNKS} SELECT id, kind, length(document) AS n_chars FROM c WHERE (page % 2 = 0 OR kind = 'text') AND replace(manual_id, '-', '') NOT IN (SELECT {T.core('target_id')} FROM removed_keys WHERE target_table = 'manuals')")
def chunk_store(s, d):
    """A store filled twice, the second time over some of the first, without the manuals of the deletion log, optimised."""
    store = ChunkStore(s, f"{checkpoint_dir(s)}/chunks-{os.urandom(8).hex()}")
    rows = chunk_rows(s, d)
    store.reset("model")
    store.add(rows.filter("page % 2 = 0").withColumn("document", F.concat("document", F.lit(" as it was"))), "model")
    store.add(rows.filter("page % 2 = 0 or kind = 'text'"), "model")
    gone = table(s, d, "removed_keys").filter("target_table = 'manuals'").select(id_key(c("target_id")).alias("k")).distinct()
    store.delete(rows.select("manual_id").distinct().join(gone, F.regexp_replace("manual_id", "-", "") == c("k"), "left_semi"))
    store.optimize()
    store.vacuum()
    return store.scroll().select("id", "kind", F.length("document").alias("n_chars"))


@query("SELECT DISTINCT id, md5(image) AS image_md5, octet_length(image) AS image_bytes FROM figures")
def figure_images(s, d):
    """Images of all figures, as their digests and lengths."""
    return table(s, d, "figures").select("id", F.md5("image").alias("image_md5"), F.octet_length("image").cast("bigint").alias("image_bytes")).distinct()


_CELL = r"'| ' || replace(regexp_replace(coalesce(title, ''), '\s*[\r\n]+\s*', ' ', 'g'), '|', '\|') || ' | ' || coalesce(page_num::VARCHAR, '') || ' |'"


@query(f"WITH {B} SELECT manual_id, '| Title | Page |' || chr(10) || '| --- | --- |' || chr(10) || string_agg({_CELL}, chr(10) ORDER BY ordering, id) AS markdown FROM b WHERE level = 1 AND manual_id IS NOT NULL GROUP BY 1")
def table_markdown(s, d):
    """The top level of every manual's outline as a Markdown table."""
    rows = marks(s, d).filter("level = 1 and manual_id is not null").groupBy("manual_id").agg(F.array_sort(F.collect_list(F.struct("ordering", "id", "title", "page_num"))).alias("r"))
    cells = F.concat(F.array(F.array(F.lit("Title"), F.lit("Page"))), F.transform("r", lambda x: F.array(x["title"], x["page_num"].cast("string"))))
    return rows.select("manual_id", C.table_markdown(cells).alias("markdown"))


@query("SELECT chunk_id AS id, arg_max(content, struct_pack(i := coalesce(indexed_at, TIMESTAMPTZ '1970-01-01 00:00:00+00'), c := content)) AS content FROM chunks_fts GROUP BY 1")
def upsert_chunks(s, d):
    """Index rows with one id overwrite each other: the last one stays."""
    r = table(s, d, "chunks_fts").select(c("chunk_id").alias("id"), "content", F.coalesce("indexed_at", F.lit("1970-01-01").cast("timestamp")).alias("at"), c("content").alias("same"))
    return L.latest(r, "id", "at", "same").select("id", "content")


@query(f"WITH {M} SELECT id, relative_path FROM m WHERE NOT starts_with(relative_path, 'Tarvel OS/')")
def delete_prefix(s, d):
    return manuals(s, d).filter(~c("relative_path").startswith("Tarvel OS/")).select("id", "relative_path")


@query(f"WITH {M} SELECT id, relative_path FROM m WHERE starts_with(relative_path, 'Tarvel OS/')")
def prefix_select(s, d):
    return manuals(s, d).filter(c("relative_path").startswith("Tarvel OS/")).select("id", "relative_path")


@query(f"WITH {T.CHUNKS} SELECT id FROM c WHERE replace(manual_id, '-', '') NOT IN (SELECT {T.core('target_id')} FROM removed_keys WHERE target_table = 'manuals')")
def delete_manual(s, d):
    """Chunks that stay when the manuals of the deletion log are deleted."""
    gone = table(s, d, "removed_keys").filter("target_table = 'manuals'").select(id_key(c("target_id")).alias("k")).distinct()
    return chunk_rows(s, d).select("id", F.regexp_replace("manual_id", "-", "").alias("k")).join(gone, "k", "left_anti").select("id")


@query(f"WITH {M} SELECT id, page_count BETWEEN 10 AND 200 AS inside FROM m")
def page_range(s, d):
    return manuals(s, d).select("id", c("page_count").between(10, 200).alias("inside"))


@query(f"WITH {M} SELECT id, CASE WHEN NOT page_count >= 10 THEN 'defer' WHEN updated_at <= converted_at THEN 'skip' ELSE 'convert' END AS action FROM m")
def resume_plan(s, d):
    m = manuals(s, d).withColumn("changed", F.coalesce(c("updated_at") > c("converted_at"), F.lit(False)))
    return L.resume_actions(m, min_pages=10).select("id", "action")


@query(f"WITH {M} SELECT id FROM m WHERE regexp_full_match(replace(relative_path, '\\', '/'), 'Tarvel OS/V.*R2/.*')")
def path_pattern(s, d):
    return manuals(s, d).filter(L.manual_pattern("Tarvel OS/V*R2/*")).select("id")


@query(f"WITH {M} SELECT id, replace(relative_path, '\\', '/') AS path, regexp_replace(relative_path, '^.*/', '') AS base FROM m")
def path_norm(s, d):
    p = L.path_norm(c("relative_path"))
    return manuals(s, d).select("id", p.alias("path"), F.element_at(F.split(p, "/"), -1).alias("base"))


@query(f"WITH {M} SELECT id, CASE WHEN starts_with(relative_path, 'Tarvel OS/') THEN substr(relative_path, 11) ELSE regexp_replace(relative_path, '^.*/', '') END AS path FROM m")
def relative_path(s, d):
    """Path below a root, else the file's own name."""
    p = c("relative_path")
    return manuals(s, d).select("id", F.when(p.startswith("Tarvel OS/"), F.substring(p, 11, 1 << 30)).otherwise(F.element_at(F.split(p, "/"), -1)).alias("path"))


@query(f"WITH {M}, r AS (SELECT id, file_name, substr(relative_path, 11) AS rest FROM m WHERE starts_with(relative_path, 'Tarvel OS/')) SELECT false AS is_manual, split_part(rest, '/', 1) AS name, count(*) AS manuals, NULL::VARCHAR AS id FROM r WHERE contains(rest, '/') GROUP BY 2 UNION ALL SELECT true, file_name, NULL, id FROM r WHERE NOT contains(rest, '/')")
def list_folder(s, d):
    return L.list_folder(manuals(s, d), "Tarvel OS")


@query(f"WITH {M} SELECT m.id, relative_path, page_count, count(f.id) AS figures FROM m LEFT JOIN (SELECT DISTINCT id, {T.key('manual_id')} AS k FROM figures) f ON f.k = replace(m.id, '-', '') GROUP BY ALL")
def list_manuals_cli(s, d):
    n = figures(s, d).groupBy(id_key(c("manual_id")).alias("k")).agg(F.countDistinct("id").alias("n"))
    m = manuals(s, d).withColumn("k", id_key(c("id")))
    return m.join(n, "k", "left").select("id", "relative_path", "page_count", F.coalesce("n", F.lit(0)).alias("figures"))


@query("SELECT (SELECT count(DISTINCT id) FROM manuals) AS manuals, (SELECT count(DISTINCT id) FROM chunks) AS chunks, (SELECT count(DISTINCT id) FROM bookmarks) AS bookmarks, 'ok' AS status")
def health_counts(s, d):
    n = [table(s, d, t).agg(F.countDistinct("id").alias(t)) for t in ("manuals", "chunks", "bookmarks")]
    return n[0].crossJoin(n[1]).crossJoin(n[2]).withColumn("status", F.when((c("manuals") > 0) & (c("chunks") > 0), "ok").otherwise("degraded"))


@query(f"WITH {M}, {T.CHUNKS.strip()} SELECT c.id, document, embedding IS NULL AS no_vector FROM c WHERE manual_id IN (SELECT id FROM m WHERE starts_with(relative_path, 'Tarvel OS/'))")
def export_rows(s, d):
    chosen = prefix_select(s, d).select(c("id").alias("manual_id"))
    return chunk_rows(s, d).join(chosen, "manual_id", "left_semi").select("id", "document", c("embedding").isNull().alias("no_vector"))


@query(f"WITH {M} SELECT id, strftime(updated_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS updated_at, relative_path, page_count FROM m")
def serialize_manuals(s, d):
    return manuals(s, d).select("id", F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("updated_at"), "relative_path", "page_count")


@query(f"WITH {M} SELECT id, epoch_us(updated_at) AS micros FROM m")
def iso_roundtrip(s, d):
    text = F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    return manuals(s, d).select("id", F.unix_micros(F.to_timestamp(text)).alias("micros"))


@query(f"WITH {T.CHUNKS}, old AS (SELECT DISTINCT lower(id) AS id FROM manuals WHERE page_count < 50), new AS (SELECT DISTINCT lower(id) AS id FROM manuals WHERE lower(id) NOT IN (SELECT id FROM old)) SELECT c.id FROM c WHERE manual_id IN (SELECT id FROM new) AND len(embedding) > 0")
def import_accept(s, d):
    """Archived chunks that an import keeps: of manuals that are not here yet, with an embedding."""
    m = table(s, d, "manuals").select(F.lower("id").alias("manual_id"), "page_count")
    new = m.select("manual_id").distinct().join(m.filter("page_count < 50").select("manual_id").distinct(), "manual_id", "left_anti")
    return chunk_rows(s, d).filter(c("embedding").isNotNull() & (F.size("embedding") > 0)).join(new, "manual_id", "left_semi").select("id")


@query("SELECT id, i AS n, string_split(title, ' ')[i + 1] AS word, CASE WHEN i % 3 > 0 THEN i END AS extra FROM (SELECT id, title, unnest(range(0, len(string_split(title, ' ')))) AS i FROM (SELECT DISTINCT id, title FROM bookmarks))")
def legacy_zip(s, d):
    """Parallel arrays to rows; a shorter array gives nulls."""
    words = F.split("title", " ")
    extra = F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.when(i % 3 > 0, i))
    r = table(s, d, "bookmarks").select("id", "title").distinct().select("id", F.posexplode(F.arrays_zip(words.alias("w"), extra.alias("e"))).alias("n", "x"))
    return r.select("id", "n", c("x.w").alias("word"), c("x.e").alias("extra"))


@query(f"WITH {M}, s AS (SELECT relative_path, greatest(coalesce(page_count, 1), 1) AS p, ceil(greatest(coalesce(page_count, 1), 1) / 250.0)::INT AS n FROM m), q AS (SELECT *, unnest(range(0, n))::INT AS part FROM s) SELECT relative_path, part, part * (p // n) + least(part, p % n) + 1 AS start_page, part * (p // n) + least(part, p % n) + p // n + CASE WHEN part < p % n THEN 1 ELSE 0 END AS end_page FROM q")
def plan_parts(s, d):
    return L.plan_parts(manuals(s, d), 250)


@query(f"WITH {FG}, p AS (SELECT {T.key('manual_id')} AS doc, page AS start_page, count(*) AS n_pictures FROM f GROUP BY ALL) SELECT *, coalesce(sum(n_pictures) OVER (PARTITION BY doc ORDER BY start_page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM p")
def merge_parts(s, d):
    return L.merge_parts(figures(s, d).groupBy(id_key(c("manual_id")).alias("doc"), c("page").alias("start_page")).agg(F.count(F.lit(1)).alias("n_pictures")))


@query(f"WITH {M} SELECT id, page_count, ntile(8) OVER (ORDER BY page_count DESC, id) AS wave FROM m")
def lpt_order(s, d):
    """Longest first: eight waves of files by size."""
    return L.waves(manuals(s, d).select("id", "page_count"), cut, 8, F.desc_nulls_first("page_count"), c("id"))


@query(f"SELECT id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM (SELECT id, sha1(unhex('{NAMESPACE}') || encode(id)) AS h FROM (SELECT DISTINCT id FROM chunks))")
def point_id(s, d):
    return table(s, d, "chunks").select("id").distinct().withColumn("point_id", L.point_id(c("id"), NAMESPACE))


@query("SELECT event_id, CASE WHEN value < 0 THEN '' WHEN value * 60 >= 3600 THEN printf('%d:%02d:%02d', floor(value * 60)::BIGINT // 3600, (floor(value * 60)::BIGINT % 3600) // 60, floor(value * 60)::BIGINT % 60) ELSE printf('%d:%02d', floor(value * 60)::BIGINT // 60, floor(value * 60)::BIGINT % 60) END AS duration FROM events")
def format_duration(s, d):
    return table(s, d, "events").select("event_id", L.format_duration(c("value") * 60).alias("duration"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS snippet FROM documents")
def snippet(s, d):
    return table(s, d, "documents").select("doc_id", L.snippet(c("text"), 200).alias("snippet"))


@query(f"WITH {FG} SELECT id, page, bbox_l, bbox_t, caption, width, height FROM f")
def figure_info(s, d):
    return figures(s, d).select("id", "page", "bbox_l", "bbox_t", "caption", "width", "height")


@query(f"WITH {FG} SELECT count(*) FILTER (coalesce(description, '') = '') AS missing, count(*) AS total FROM f")
def missing_descriptions(s, d):
    return figures(s, d).agg(F.count_if(F.coalesce("description", F.lit("")) == "").alias("missing"), F.count(F.lit(1)).alias("total"))


@query(f"WITH {FG} SELECT {T.key('manual_id')} AS doc, picture_index, id FROM f WHERE width > 0 AND page IS NOT NULL")
def figure_extract(s, d):
    return figures(s, d).filter("width > 0 and page is not null").select(id_key(c("manual_id")).alias("doc"), "picture_index", "id")


def _named(s, d):
    return chunk_rows(s, d).filter("figure_id is not null").select(c("figure_id").alias("k"), c("id").alias("chunk_id"))


@query(f"WITH {FG}, {T.CHUNKS.strip()} SELECT f.id, min(c.id) AS first_chunk, count(*) AS chunks FROM f JOIN c ON c.figure_id = {T.key('f.id')} GROUP BY 1")
def figure_link(s, d):
    """Figures with the chunks that show them: the first chunk makes the row, later ones reuse it."""
    f = figures(s, d).select("id", id_key(c("id")).alias("k"))
    return f.join(_named(s, d), "k").groupBy("id").agg(F.min("chunk_id").alias("first_chunk"), F.count(F.lit(1)).alias("chunks"))


@query(f"WITH {FG}, {T.CHUNKS.strip()} SELECT DISTINCT f.id FROM f WHERE {T.key('f.id')} NOT IN (SELECT figure_id FROM c WHERE figure_id IS NOT NULL)")
def figure_leftover(s, d):
    return figures(s, d).select("id", id_key(c("id")).alias("k")).distinct().join(_named(s, d), "k", "left_anti").select("id")


@query(f"WITH {FG}, x AS (SELECT id, caption, unnest(string_split(labels, ', ')) AS w, unnest(range(0, len(string_split(labels, ', ')))) AS n FROM f WHERE labels IS NOT NULL) SELECT id, string_agg(w, ', ' ORDER BY n) AS labels FROM x WHERE w <> '' AND w IS DISTINCT FROM caption GROUP BY id")
def figure_labels(s, d):
    w = F.filter(F.split("labels", ", "), lambda x: (x != "") & ~x.eqNullSafe(c("caption")))
    return figures(s, d).filter("labels is not null").select("id", F.array_join(w, ", ").alias("labels")).filter("labels <> ''")


@query(f"WITH {T.CHUNKS} SELECT id, row_number() OVER (PARTITION BY manual_id ORDER BY coalesce(chunk_index, regexp_extract(id, '_([0-9]+)$', 1)::DOUBLE, 0), id) - 1 AS n FROM c")
def section_order(s, d):
    """Chunks of a manual in order: by chunk_index, else by the number in the id."""
    at = F.coalesce("chunk_index", F.nullif(F.regexp_extract("id", "_([0-9]+)$", 1), F.lit("")).try_cast("double"), F.lit(0.0))
    return R.numbered(chunk_rows(s, d).select("id", "manual_id", at.alias("at")), ["manual_id"], "at", ["id"], "n").select("id", "n")


@query(f"WITH {IT} SELECT manual_id || '_' || (row_number() OVER (PARTITION BY manual_id ORDER BY seq) - 1) AS chunk_id, seq FROM it")
def chunk_ids(s, d):
    return R.numbered(items(s, d).select("manual_id", "seq"), ["manual_id"], "seq", [], "n").select(F.concat_ws("_", "manual_id", "n").alias("chunk_id"), "seq")


PARENT = f"WITH {B}, p AS (SELECT a.id, a.level, arg_max(struct_pack(i := q.id, l := q.level), struct_pack(o := q.ordering, i := q.id)) FILTER (q.id IS NOT NULL) AS r FROM b a LEFT JOIN b q ON q.manual_id = a.manual_id AND (q.ordering, q.id) < (a.ordering, a.id) AND q.level < a.level GROUP BY 1, 2)"


@query(PARENT + " SELECT id, r.i AS parent FROM p")
def outline_parent(s, d):
    return O.parents_from_levels(marks(s, d))


@query(PARENT + " SELECT id, CASE WHEN r.l = level - 1 THEN r.i END AS parent FROM p")
def outline_parent_strict(s, d):
    return O.parents_from_levels(marks(s, d), strict=True)


@query(f"WITH {B} SELECT id, manual_id, ordering, level, title, page_num FROM b")
def outline_flatten(s, d):
    return marks(s, d).select("id", "manual_id", "ordering", "level", "title", "page_num")


@query(f"WITH {B}, n AS (SELECT id, manual_id, {T.key('id')} AS k, {T.key('parent_id')} AS p, ordering, title FROM b) SELECT a.id, q.id AS parent, a.ordering, a.title FROM n a LEFT JOIN n q ON q.k = a.p WHERE a.p IS NULL OR q.k IS NOT NULL")
def toc(s, d):
    """Table of contents: bookmarks under their parents; one whose parent is missing is dropped."""
    b = marks(s, d).select("id", id_key(c("id")).alias("k"), id_key(c("parent_id")).alias("p"), "ordering", "title")
    up = b.select(c("k").alias("p"), c("id").alias("parent"))
    return b.join(up, "p", "left").filter(c("p").isNull() | c("parent").isNotNull()).select("id", "parent", "ordering", "title")


@query(f"WITH {B} SELECT a.id, count(DISTINCT q.id) AS n, coalesce(max(q.level), 0) AS deepest FROM b a LEFT JOIN b q ON q.manual_id = a.manual_id AND q.ordering >= a.ordering AND q.ordering < coalesce((SELECT min(z.ordering) FROM b z WHERE z.manual_id = a.manual_id AND (z.ordering, z.id) > (a.ordering, a.id) AND z.level <= a.level), 2147483647) GROUP BY 1")
def subtree(s, d):
    """Size and depth of every bookmark's subtree, the bookmark included."""
    return O.subtrees(marks(s, d)).select("id", "n", "deepest")


@query(f"WITH RECURSIVE {B}, n AS (SELECT {T.key('id')} AS k, {T.key('parent_id')} AS p, title, id FROM b), up(k, cur, h, way) AS (SELECT k, k, 1, [k] FROM n UNION ALL SELECT up.k, q.k, h + 1, list_append(way, q.k) FROM up JOIN n x ON x.k = up.cur JOIN n q ON q.k = x.p WHERE NOT list_contains(way, q.k)), ends AS (SELECT up.k FROM up JOIN n ON n.k = up.cur WHERE n.p IS NULL OR n.p NOT IN (SELECT k FROM n)) SELECT n.id, string_agg(t.title, ' > ' ORDER BY up.h DESC) AS path FROM up JOIN ends USING (k) JOIN n t ON t.k = up.cur JOIN n ON n.k = up.k GROUP BY n.id")
def bookmark_path(s, d):
    """Titles from the root down to every bookmark that has a root."""
    from marginalia.operators import hierarchy as H

    b = marks(s, d)
    nodes = H.nodes_of(b, id_key(c("id")), c("id"), id_key(c("parent_id")), id_key(c("manual_id")), c("ordering"), c("level"))
    titled = nodes.join(b.select("id", "title"), "id")
    # Titles, not ids, make the paths: they travel with the expansion.
    return H.solve(H.edge_rows(titled, True, "title"), cut).filter("kind <> 'loop'").select("id", F.array_join("path", " > ").alias("path"))


NORM = r"regexp_replace(trim(regexp_replace(regexp_replace(lower(trim(coalesce(X, ''), W)), '^(?:\d+(?:[.\-]\d+)*[.)]?|[ivxlcdm]+[.)]|[a-z][.)])[\s\x{A0}\x{202F}\x{3000}]+', ''), '[\s\x{A0}\x{202F}\x{3000}]+', ' ', 'g'), ENDS), '^$', '')"


def _norm(x: str) -> str:
    ends = "'" + O.TITLE_ENDS.replace("'", "''") + "'"
    return NORM.replace("X", x, 1).replace("W", "' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(8239) || chr(12288)", 1).replace("ENDS", ends)


@query(f"WITH {B} SELECT id, {_norm('title')} AS normal FROM b")
def normalize_title(s, d):
    return marks(s, d).select("id", O.normalize_title(c("title")).alias("normal"))


@query(f"WITH {B}, h AS (SELECT manual_id, page_num AS page, id AS item_id, {_norm("(ordering || '. ' || upper(title) || ':')")} AS t FROM b), u AS (SELECT *, {_norm('title')} AS u FROM b) SELECT item_id, arg_min(id, struct_pack(x := t <> u, o := ordering, i := id)) AS bookmark_id FROM h JOIN u ON u.manual_id = h.manual_id AND u.page_num = h.page WHERE t <> '' AND u <> '' AND (t = u OR (least(length(t), length(u)) >= 3 AND (contains(t, u) OR contains(u, t)))) GROUP BY 1")
def heading_match(s, d):
    """Headings that spell bookmark titles another way (numbered, in capitals, with a colon) find their bookmarks."""
    b = marks(s, d)
    h = b.select("manual_id", c("page_num").alias("page"), c("id").alias("item_id"), F.concat(c("ordering").cast("string"), F.lit(". "), F.upper("title"), F.lit(":")).alias("text"))
    return O.heading_match(h, b)


@query(f"WITH {B}, {IT} SELECT it.manual_id || '_' || seq AS item_id, arg_min(b.id, struct_pack(t := coalesce(page_top, -1), o := -ordering, i := b.id)) AS bookmark_id FROM it JOIN b ON b.manual_id = it.manual_id AND b.page_num = it.page WHERE top < coalesce(page_top, -1) + 10 GROUP BY 1")
def asof_bookmark(s, d):
    return O.asof_bookmark(items(s, d).select("manual_id", "page", F.concat_ws("_", "manual_id", "seq").alias("item_id"), "top"), marks(s, d))


@query(f"WITH {B}, it AS (SELECT manual_id, page_num AS page, ordering AS seq, 'See ' || title AS text, 700.0::DOUBLE - ordering AS top FROM b) SELECT b.id AS bookmark_id, arg_min(top, seq) AS page_top FROM it JOIN b ON b.manual_id = it.manual_id AND b.page_num = it.page WHERE b.page_top IS NULL AND contains(lower(text), lower(title)) GROUP BY 1")
def resolve_top(s, d):
    b = marks(s, d)
    texts = b.select("manual_id", c("page_num").alias("page"), c("ordering").alias("seq"), F.concat(F.lit("See "), "title").alias("text"), (F.lit(700.0) - c("ordering")).alias("top"))
    return O.resolve_tops(texts, b)


@query(f"WITH {IT} SELECT manual_id, seq, last_value(CASE WHEN label = 'section_header' THEN text END IGNORE NULLS) OVER (PARTITION BY manual_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM it")
def carry_bookmark(s, d):
    r = items(s, d).withColumn("head", F.when(c("label") == "section_header", c("text")))
    return R.carry_forward(r, "head", ["manual_id"], "seq", []).select("manual_id", "seq", "carried")


RUNS = f"WITH {IT}, z AS (SELECT *, CASE WHEN lag(label) OVER w IS NOT NULL AND lag(label) OVER w IS DISTINCT FROM label THEN 1 ELSE 0 END AS ch FROM it WINDOW w AS (PARTITION BY manual_id ORDER BY seq)), r AS (SELECT *, sum(ch) OVER (PARTITION BY manual_id ORDER BY seq)::BIGINT AS run FROM z)"


@query(RUNS + " SELECT manual_id, seq, run FROM r")
def section_runs(s, d):
    return R.runs(items(s, d), ["label"], ["manual_id"], "seq", []).select("manual_id", "seq", "run")


@query(RUNS + " SELECT manual_id, run, string_agg(text, chr(10) || chr(10) ORDER BY seq) AS text FROM r WHERE label = 'text' GROUP BY 1, 2")
def section_text(s, d):
    r = R.runs(items(s, d), ["label"], ["manual_id"], "seq", []).filter("label = 'text'")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n\n")
    return r.groupBy("manual_id", "run").agg(whole.alias("text"))


@query(f"WITH {FG}, z AS (SELECT {T.key('manual_id')} AS manual_id, round_even(12.5 + width % 3, 0)::INT AS w, round_even(8.5 + height % 2, 0)::INT AS h, (12.5 + width % 3) * (8.5 + height % 2) AS area FROM f) SELECT manual_id, w, h, count(*) AS n FROM z WHERE area > 0 AND area <= 675 GROUP BY 1, 2, 3 HAVING count(*) >= 10")
def marker_shapes(s, d):
    """Shapes that repeat; the tables' pictures are large, so remainders of their sizes stand for those of markers."""
    return C.marker_shapes(figures(s, d).select(id_key(c("manual_id")).alias("manual_id"), (c("width") % 3 + 12.5).alias("w"), (c("height") % 2 + 8.5).alias("h")))


@query(f"WITH {IT}, g AS (SELECT manual_id, seq, label = 'picture' AS k, text, sum(CASE WHEN label = 'picture' THEN 0 ELSE 1 END) OVER (PARTITION BY manual_id ORDER BY seq DESC)::BIGINT AS isl FROM it) SELECT manual_id, 0 AS run, max(seq) AS seq, string_agg(CASE WHEN k THEN '[' || text || ']' ELSE text END, ' ' ORDER BY seq) AS text FROM g GROUP BY manual_id, isl")
def marker_attach(s, d):
    r = items(s, d).select("manual_id", F.lit(0).alias("run"), "seq", (c("label") == "picture").alias("is_marker"), "text")
    return C.attach_markers(r)


@query(f"WITH {FG} SELECT id, CASE WHEN t = '' THEN 'Figure on page ' || page ELSE t END AS text FROM (SELECT id, page, concat_ws(chr(10) || chr(10), nullif(caption, ''), 'Labels: ' || nullif(labels, ''), nullif(description, '')) AS t FROM f)")
def figure_text(s, d):
    return figures(s, d).select("id", C.figure_text(c("caption"), c("labels"), c("description"), c("page")).alias("text"))


@query(f"WITH {FG} SELECT id, nullif(concat_ws(chr(10) || chr(10), nullif(caption, ''), nullif(description, '')), '') AS text FROM f")
def table_text(s, d):
    return figures(s, d).select("id", C.table_text(c("caption"), c("description")).alias("text"))


@query(f"WITH {FG} SELECT id, coalesce(try_cast(nullif(regexp_extract(CASE WHEN picture_index % 2 = 0 THEN '#/pictures/' || picture_index ELSE 'x' END, '(?:^|/)([0-9]+)$', 1), '') AS INT), -1) AS n FROM f")
def picture_index(s, d):
    ref = F.when(c("picture_index") % 2 == 0, F.concat(F.lit("#/pictures/"), "picture_index")).otherwise("x")
    return figures(s, d).select("id", C.picture_index(ref, F.lit(-1)).alias("n"))


@query()
def split_text(s, d):
    return C.split_texts(chunk_rows(s, d).select("id", c("document").alias("text")))


@query(f"WITH {T.CHUNKS} SELECT id, length(document) > 2000 AS split FROM c")
def split_if_long(s, d):
    return chunk_rows(s, d).select("id", (F.length("document") > C.SIZE).alias("split"))


def _merged(texts: str) -> str:
    """DuckDB expression that merges a list of texts as ``chunking.merge_list`` does."""
    shared = "coalesce(list_max(list_filter(range(1, least(length(a), length(x), 300) + 1), lambda k: right(a, k) = left(x, k))), 0)"
    return f"list_reduce({texts}, lambda a, x: a || CASE WHEN {shared} = 0 THEN chr(10) || chr(10) || x ELSE substr(x, {shared} + 1) END)"


@query(f"WITH {T.CHUNKS}, p AS (SELECT id, document, lag(document) OVER (PARTITION BY manual_id ORDER BY regexp_extract(id, '_([0-9]+)$', 1)::INT, id) AS before FROM c WHERE document <> '') SELECT id, {_merged('[before, document]')} AS merged FROM p WHERE before IS NOT NULL")
def merge_overlap(s, d):
    """Every chunk merged with the one before it in its manual."""
    seq = F.regexp_extract("id", "_([0-9]+)$", 1).cast("int")
    before = F.lag("document").over(Window.partitionBy("manual_id").orderBy(seq, "id"))
    p = chunk_rows(s, d).filter("document <> ''").select("id", F.array(before, c("document")).alias("t"))
    return C.merge_rows(p.filter(c("t")[0].isNotNull()), "t", "merged")


@query(
    f"WITH {T.CHUNKS},{T.SECTIONS}, own AS (SELECT k, sub FROM sec UNION SELECT bookmark_id, bookmark_id FROM c WHERE bookmark_id IS NOT NULL), "
    "r AS (SELECT own.k, regexp_extract(id, '_([0-9]+)$', 1)::INT AS seq, id, kind = 'figure' AS fig, document, figure_id, page FROM c JOIN own ON c.bookmark_id = own.sub WHERE document <> ''), "
    "z AS (SELECT *, CASE WHEN lag(fig) OVER w IS NOT NULL AND lag(fig) OVER w IS DISTINCT FROM fig THEN 1 ELSE 0 END AS ch FROM r WINDOW w AS (PARTITION BY k ORDER BY seq, id)), "
    "y AS (SELECT *, sum(ch) OVER (PARTITION BY k ORDER BY seq, id) AS run FROM z), "
    "texts AS (SELECT k, min(struct_pack(s := seq, i := id)) AS pos, list(document ORDER BY seq, id) AS t FROM y WHERE NOT coalesce(fig, false) GROUP BY k, run), "
    "blocks AS (SELECT k, pos, " + _merged("t") + " AS text FROM texts UNION ALL "
    "SELECT k, struct_pack(s := seq, i := id), CASE WHEN figure_id IS NULL THEN '[Figure (page ' ELSE '[Figure: ' || figure_id || ' (page ' END || coalesce(page::VARCHAR, 'None') || ')]' || chr(10) || chr(10) || document FROM y WHERE fig) "
    "SELECT k AS bookmark_id, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS markdown FROM blocks GROUP BY k"
)
def section_markdown(s, d):
    """Text of the chunks of every bookmark and of those below it, in order, overlaps merged, figures as blocks of their own."""
    chunks = chunk_rows(s, d).filter("bookmark_id is not null and document <> ''").withColumnRenamed("bookmark_id", "sub")
    # Chunks of a bookmark without a row are still its own.
    inside = section_pairs(s, d).unionByName(chunks.select(c("sub").alias("bookmark_id"), "sub")).distinct()
    seq = F.regexp_extract("id", "_([0-9]+)$", 1).cast("int")
    r = chunks.select("id", "sub", seq.alias("seq"), F.coalesce(c("kind") == "figure", F.lit(False)).alias("fig"), "document", "figure_id", "page").join(inside, "sub")
    r = cut(r)  # read for the blocks and for their summaries
    flagged = R.runs(r, ["fig"], ["bookmark_id"], "seq", ["id"])
    at = F.struct("seq", "id")
    texts = flagged.filter("not fig").groupBy("bookmark_id", "run").agg(F.min(at).alias("at"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "id", "document"))), lambda x: x["document"]).alias("t"))
    head = F.when(c("figure_id").isNull(), "[Figure (page ").otherwise(F.concat(F.lit("[Figure: "), "figure_id", F.lit(" (page ")))
    shown = F.concat(head, F.coalesce(c("page").cast("string"), F.lit("None")), F.lit(")]\n\n"), "document")
    blocks = C.merge_rows(texts.drop("run"), "t", "text").unionByName(flagged.filter("fig").select("bookmark_id", at.alias("at"), shown.alias("text")))
    return blocks.groupBy("bookmark_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n\n").alias("markdown"))


_OWN = """h AS (SELECT manual_id, seq, page, {H} AS t FROM it WHERE label = 'section_header'), u AS (SELECT *, {U} AS u FROM b),
named AS (SELECT h.manual_id, seq, arg_min(id, struct_pack(x := t <> u, o := ordering, i := id)) AS bm FROM h JOIN u ON u.manual_id = h.manual_id AND u.page_num = h.page
  WHERE t <> '' AND u <> '' AND (t = u OR (least(length(t), length(u)) >= 3 AND (contains(t, u) OR contains(u, t)))) GROUP BY 1, 2),
placed AS (SELECT it.manual_id, seq, arg_min(b.id, struct_pack(t := coalesce(page_top, -1), o := -ordering, i := b.id)) AS bm FROM it JOIN b ON b.manual_id = it.manual_id AND b.page_num = it.page
  WHERE top < coalesce(page_top, -1) + 10 GROUP BY 1, 2),
ca AS (SELECT it.*, last_value(coalesce(named.bm, placed.bm) IGNORE NULLS) OVER (PARTITION BY it.manual_id ORDER BY it.seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bm
  FROM it LEFT JOIN named USING (manual_id, seq) LEFT JOIN placed USING (manual_id, seq)),
la AS (SELECT *, row_number() OVER w AS n, lag(bm) OVER w AS bm0, CASE WHEN label IN ('table', 'picture') THEN seq END AS bl, lag(CASE WHEN label IN ('table', 'picture') THEN seq END) OVER w AS bl0 FROM ca WINDOW w AS (PARTITION BY manual_id ORDER BY seq)),
ru AS (SELECT *, sum(CASE WHEN n > 1 AND (bm IS DISTINCT FROM bm0 OR bl IS DISTINCT FROM bl0) THEN 1 ELSE 0 END) OVER (PARTITION BY manual_id ORDER BY seq)::BIGINT AS run FROM la),
sp AS (SELECT manual_id, run, seq, bm, page, CASE label WHEN 'picture' THEN 'figure' WHEN 'table' THEN 'table' ELSE 'text' END AS kind,
  CASE WHEN label = 'picture' THEN coalesce(nullif(text, ''), 'Figure on page ' || page) WHEN label = 'table' THEN nullif(text, '') ELSE trim(text, ' ') END AS text FROM ru)"""


@query(f"WITH {B}, {IT}, " + _OWN.replace("{H}", _norm("text")).replace("{U}", _norm("title")) + " SELECT manual_id, any_value(bm) AS bookmark_id, any_value(kind) AS kind, min(page) AS page, min(seq) AS seq, run, string_agg(text, chr(10) || chr(10) ORDER BY seq) AS text FROM sp WHERE text <> '' GROUP BY manual_id, run")
def chunk_buffers(s, d):
    """Chunks before the long ones are split: texts under the bookmark in effect, tables and pictures apart."""
    return C.chunk_buffers(items(s, d), marks(s, d), cut)


@query(f"WITH {T.CHUNKS} SELECT id, true AS bounded, true AS ends_kept, true AS covered FROM c WHERE regexp_matches(document, '[^\\s\\x{{A0}}\\x{{202F}}\\x{{3000}}]')".replace("\\\\", "\\"))
def split_checks(s, d):
    """What must hold of every split text: no piece over the size, the first and last piece are its ends, and pieces leave nothing out."""
    size = 400
    rows = chunk_rows(s, d).select("id", c("document").alias("text"))
    pieces = C.split_texts(rows, size, 40).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("piece", "piece_text"))).alias("p"))
    text = F.regexp_replace("text", f"^[{O.SPACE}]+|[{O.SPACE}]+$", "")
    bare = lambda x: F.regexp_replace(x, f"[{O.SPACE}]", "")
    texts = F.transform("p", lambda x: x["piece_text"])
    both = pieces.join(rows, "id")
    # Every piece stands in the text, and together they have at least its characters.
    inside = F.forall(texts, lambda x: text.contains(x))
    return both.select(
        "id", F.forall(texts, lambda x: F.length(x) <= size).alias("bounded"), (text.startswith(texts[0]) & text.endswith(F.element_at(texts, -1))).alias("ends_kept"),
        (inside & (F.length(bare(F.array_join(texts, ""))) >= F.length(bare(text)))).alias("covered"),
    )


@query()
def chunk_document(s, d):
    return C.chunk_items(items(s, d), marks(s, d), cut)


@query("SELECT id, json_extract_string(j, '$.type') AS type, json_extract_string(j, '$.page') AS page FROM (SELECT DISTINCT id, to_json(struct_pack(\"type\" := metadata.\"type\", page := metadata.page)) AS j FROM chunks)")
def strip_reserved(s, d):
    """Payloads without the keys that the store reserves."""
    m = F.map_filter(F.create_map(F.lit("chunk_id"), c("id"), F.lit("document"), c("document"), F.lit("type"), c("kind"), F.lit("page"), c("page").cast("string")), lambda k, v: ~k.isin("chunk_id", "document"))
    r = chunk_rows(s, d).select("id", m.alias("m"))
    return r.select("id", c("m")["type"].alias("type"), c("m")["page"].alias("page"))


@query()
def ingest_pipeline(s, d):
    """Items to chunks with ids and postings, and the commit marker per manual: what a build writes, in that order."""
    from marginalia.operators import lexical

    chunks = R.numbered(C.chunk_items(items(s, d), marks(s, d), cut), ["manual_id"], "seq", ["piece"], "n")
    named = chunks.select(F.concat_ws("_", "manual_id", "n").alias("chunk_id"), "manual_id", c("text").alias("content"))
    return lexical.postings(named).groupBy("manual_id").agg(F.countDistinct("chunk_id").alias("chunks"), F.sum("tf").alias("tokens"))
