"""DuckDB counterparts of the search plans."""

from __future__ import annotations

#: White space of the data model for DuckDB classes.
WS = r" \t\r\n\x{A0}\x{202F}\x{3000}"


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def core(x: str) -> str:
    return rf"lower(replace(regexp_replace({x}, '^[{WS}{{}}]+|[{WS}{{}}]+$', '', 'g'), '-', ''))"


def key(x: str) -> str:
    return f"CASE WHEN lower({trim(x)}) NOT IN ('', 'none', 'null') THEN {core(x)} END"


CHUNKS = f"""
c AS (SELECT id, any_value(document) AS document, any_value(embedding) AS embedding, any_value(regexp_replace(lower(id), '_[^_]*$', '')) AS manual_id,
  any_value({key("metadata.bookmark_id")}) AS bookmark_id, any_value(metadata."type") AS kind, any_value(metadata.page) AS page, any_value({key("metadata.figure_id")}) AS figure_id,
  any_value(metadata.chunk_index) AS chunk_index FROM chunks GROUP BY id)"""
MANUALS = """
m AS (SELECT lower(id) AS manual_id, arg_max(struct_pack(p := relative_path, t := document_title, f := file_name, n := page_count, h := file_hash), struct_pack(u := updated_at, h := file_hash)) AS r FROM manuals GROUP BY 1)"""


#: Bookmarks by key, and every bookmark (k) with itself and all below it by levels (sub).
SECTIONS = f"""
bk AS (SELECT DISTINCT id, manual_id, ordering, level, {key("id")} AS k FROM bookmarks),
sec AS (SELECT k, k AS sub FROM bk UNION ALL SELECT a.k, q.k FROM bk a JOIN bk q ON q.manual_id = a.manual_id AND q.level > a.level AND (q.ordering, q.id) > (a.ordering, a.id)
  AND NOT EXISTS (SELECT 1 FROM bk z WHERE z.manual_id = a.manual_id AND z.level <= a.level AND (z.ordering, z.id) > (a.ordering, a.id) AND (z.ordering, z.id) < (q.ordering, q.id)))"""


def search_sql(terms: list[str], ratio: float, marked: str, plain: str) -> dict[str, str]:
    def tok(x: str) -> str:
        return rf"list_filter(string_split_regex(translate(lower(coalesce({x}, '')), '{marked}', '{plain}'), '[^\p{{L}}\p{{N}}\p{{Co}}]+'), lambda t: t <> '')"

    names = ", ".join(f"'{t}'" for t in terms)
    index = f"""WITH {CHUNKS},
tk AS (SELECT id AS chunk_id, manual_id, {tok("document")} AS t FROM c),
one AS (SELECT chunk_id, manual_id, len(t) AS dl, unnest(t) AS term FROM tk),
post AS (SELECT chunk_id, manual_id, term, dl, count(*) AS tf FROM one GROUP BY ALL),
cs AS (SELECT count(*) AS n_docs, coalesce(sum(len(t)), 0)::BIGINT AS total_tokens FROM tk),
ts AS (SELECT term, count(*) AS df FROM post GROUP BY term),
gate AS (SELECT term, df FROM ts, cs WHERE term IN ({names}) AND df <= greatest(25, floor(n_docs * {ratio}))),
scope AS (SELECT DISTINCT lower(id) AS id FROM manuals WHERE relative_path LIKE 'Tarvel%'),
part AS (SELECT chunk_id, manual_id, (CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - df + 0.5) / (df + 0.5)) END)
  * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (total_tokens / n_docs))) AS s FROM post JOIN gate USING (term), cs),
score AS (SELECT chunk_id, round(sum(s), 6) AS score FROM part GROUP BY chunk_id),
lex AS (SELECT * FROM score ORDER BY score DESC, chunk_id LIMIT 20),
qv AS (SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1),
fin AS (SELECT id, manual_id, bookmark_id, embedding::DOUBLE[] AS e FROM c WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
sim AS (SELECT id, manual_id, bookmark_id, round(list_inner_product(e, q) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(q, q))), 6) AS score FROM fin, qv WHERE list_inner_product(e, e) > 0),
dense AS (SELECT id, score FROM sim ORDER BY score DESC, id LIMIT 20),
lists AS (SELECT 0 AS l, id, row_number() OVER (ORDER BY score DESC, id) AS r, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, id)) AS p FROM dense
  UNION ALL SELECT 1, chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id), 0.3::DOUBLE / (5 + row_number() OVER (ORDER BY score DESC, chunk_id)) FROM lex),
fused AS (SELECT id, round(sum(p), 9) AS score, min(struct_pack(l := l, r := r)) AS f, bool_or(l = 0) AS d, bool_or(l = 1) AS x FROM lists GROUP BY id)
"""
    def hybrid(where: str, more: str = "") -> str:
        """The best five among the chunks that ``where`` allows."""
        return index.rstrip() + f""",{MANUALS}{more},
ok AS (SELECT id FROM c LEFT JOIN m USING (manual_id) WHERE {where}),
lex2 AS (SELECT chunk_id, score FROM score WHERE chunk_id IN (SELECT id FROM ok) ORDER BY score DESC, chunk_id LIMIT 20),
dense2 AS (SELECT id, score FROM sim WHERE id IN (SELECT id FROM ok) ORDER BY score DESC, id LIMIT 20),
lists2 AS (SELECT 0 AS l, id, row_number() OVER (ORDER BY score DESC, id) AS r, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, id)) AS p FROM dense2
  UNION ALL SELECT 1, chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id), 0.3::DOUBLE / (5 + row_number() OVER (ORDER BY score DESC, chunk_id)) FROM lex2),
fused2 AS (SELECT id, round(sum(p), 9) AS score, min(struct_pack(l := l, r := r)) AS f, bool_or(l = 0) AS d, bool_or(l = 1) AS x FROM lists2 GROUP BY id),
best2 AS (SELECT * FROM fused2 ORDER BY score DESC, f.l, f.r LIMIT 5)
SELECT best2.id, best2.score AS fused, {tag} AS retrieval, dense2.score AS dense_score, m.r.p AS relative_path FROM best2 LEFT JOIN dense2 USING (id) LEFT JOIN m ON m.manual_id = regexp_replace(lower(best2.id), '_[^_]*$', '')"""

    tag = "CASE WHEN d AND x THEN 'both' WHEN d THEN 'dense' ELSE 'lexical' END"
    chunks = f"WITH {CHUNKS}"
    return {
        "build_postings": index + "SELECT * FROM post",
        "doc_freq": index + "SELECT * FROM ts",
        "corpus_stats": index + "SELECT * FROM cs",
        "reindex_lexical": index + "SELECT manual_id, count(*) AS postings, count(DISTINCT chunk_id) AS chunks FROM post GROUP BY 1",
        "delete_lexical": index
        + f"SELECT term, count(*) AS df FROM post WHERE replace(manual_id, '-', '') NOT IN (SELECT {core('target_id')} FROM removed_keys WHERE target_table = 'manuals') GROUP BY 1",
        "rarity_gate": index + "SELECT * FROM gate",
        "bm25_search": index + "SELECT * FROM lex",
        "bm25_scoped": index + "SELECT chunk_id, round(sum(s), 6) AS score FROM part WHERE manual_id IN (SELECT id FROM scope) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
        "dense_topk": index + "SELECT * FROM dense",
        "dense_topk_filtered": index + "SELECT id, score FROM sim WHERE manual_id IN (SELECT id FROM scope) ORDER BY score DESC, id LIMIT 20",
        "chunk_filter": index + "SELECT id, manual_id, kind FROM c WHERE manual_id IN (SELECT id FROM scope)",
        "rrf_fuse": index + "SELECT id, score, f.l AS first_list, f.r AS first_rank FROM fused",
        "retrieval_tag": index + f"SELECT id, {tag} AS retrieval FROM fused",
        "hybrid_search": hybrid("TRUE"),
        "hybrid_scoped": hybrid("starts_with(replace(r.p, '\\', '/'), 'Tarvel OS/')"),
        "hybrid_in_section": hybrid(
            "bookmark_id IN (SELECT sub FROM sec WHERE k = (SELECT k FROM top1))",
            f""",{SECTIONS}, wide AS (SELECT k FROM sec WHERE sub IN (SELECT bookmark_id FROM c WHERE bookmark_id IS NOT NULL) GROUP BY k HAVING count(*) >= 5),
top1 AS (SELECT arg_min(k, id) AS k FROM bk WHERE level = 1 AND k IN (SELECT k FROM wide))""",
        ),
        "stored_postings": index + "SELECT * FROM post",
        "stored_after_delete": index
        + f"SELECT term, count(*) AS df FROM post WHERE replace(manual_id, '-', '') NOT IN (SELECT {core('target_id')} FROM removed_keys WHERE target_table = 'manuals') GROUP BY 1",
        "hits_with_manual": f"WITH {CHUNKS},{MANUALS} SELECT c.id, r.p AS relative_path, r.t AS document_title FROM c LEFT JOIN m USING (manual_id)",
        "hits_with_figure": f"WITH {CHUNKS}, f AS (SELECT DISTINCT {key('id')} AS figure_id, page, caption FROM figures) "
        + "SELECT c.id, f.page AS figure_page, caption, c.figure_id IS NOT NULL AND f.page IS NULL AS figure_missing FROM c LEFT JOIN f USING (figure_id) WHERE kind = 'figure'",
        "lexical_in_section": index.rstrip()
        + f",{SECTIONS}, named AS (SELECT DISTINCT bookmark_id FROM c JOIN dense USING (id) WHERE bookmark_id IS NOT NULL) "
        + "SELECT * FROM score WHERE chunk_id IN (SELECT id FROM c WHERE bookmark_id IN (SELECT bookmark_id FROM named UNION ALL SELECT sub FROM sec WHERE k IN (SELECT bookmark_id FROM named)))",
        "get_by_ids": chunks + " SELECT id, length(document) AS n_chars, kind FROM c WHERE id IN (SELECT chunk_id FROM chunks_fts)",
        "scroll_filtered": chunks + " SELECT id, document FROM c WHERE kind = 'table'",
        "count_chunks": "SELECT count(DISTINCT id) AS chunks FROM chunks",
        "query_terms": "SELECT doc_id, array_to_string(list_filter(list_transform(range(1, len(t) + 1), lambda i: CASE WHEN list_position(t, t[i]) = i THEN t[i] END), lambda x: x IS NOT NULL), ' ') AS terms FROM "
        + "(SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9]{2,}') AS t FROM documents WHERE text IS NOT NULL)",
        "match_query": "SELECT item_id, CASE WHEN len(t) > 0 THEN array_to_string(list_transform(list_filter(list_transform(range(1, len(t) + 1), lambda i: CASE WHEN list_position(t, t[i]) = i THEN t[i] END), "
        + "lambda x: x IS NOT NULL), lambda x: '\"' || x || '\"'), ' OR ') END AS match FROM (SELECT item_id, regexp_extract_all(text, '[A-Za-z0-9]{2,}') AS t FROM eval_items)",
        "tokenize": f"SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {tok('text')} AS t FROM documents)",
        "l2_normalize": "SELECT vec_id, round(sqrt(list_inner_product(u, u)), 6) AS length, array_to_string(list_transform(u, lambda x: round(x * 1000000)::BIGINT::VARCHAR), ' ') AS millionths FROM "
        + "(SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings)",
        "cosine": "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS similarity FROM embeddings, q",
        "embed_hash": chunks
        + ", g AS (SELECT id, unnest(list_transform(range(1, length(document) - 1), lambda i: substr(lower(document), i, 3))) AS g FROM c WHERE length(document) >= 3), "
        + "n AS (SELECT id, strpos('0123456789abcdef', substr(md5(g), 1, 1)) AS b, count(*) AS k FROM g GROUP BY ALL), "
        + "v AS (SELECT id, map_from_entries(list((b, k))) AS m, sqrt(sum(k * k)) AS l FROM n GROUP BY id) "
        + "SELECT id, array_to_string(list_transform(range(1, 17), lambda b: round(coalesce(m[b], 0) / l * 1000000)::BIGINT::VARCHAR), ' ') AS millionths FROM v",
        "embed_chunks": chunks + " SELECT id, 64 AS dimension, CASE WHEN length(coalesce(document, '')) >= 3 THEN 1.0 ELSE 0.0 END::DOUBLE AS length FROM c",
    }
