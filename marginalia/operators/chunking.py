"""From layout items to chunks: markers, figure and table texts, splitting, and merging overlaps back.

Items: manual_id, seq (reading order), label, text, page, top, w, h, caption, labels, description, self_ref.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.operators import ordered, outline

SIZE, OVERLAP, MARGIN = 2000, 200, 100
MARKER_AREA, MARKER_REPEATS = 675.0, 10

#: Where a text may be cut, best first.
_CUTS = [re.compile(p) for p in (r"\n(?=#{1,6} )", r"\n\n+", r"\n", r"[。！？]|[.!?](?=\s)", r"[ \t 　]")]


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Pieces of at most ``size`` characters that share up to ``overlap``; cuts fall on the best boundary in a window's second half."""
    text = text.strip()
    pieces, start = [], 0
    while len(text) - start > size:
        lo, hi = start + size // 2, start + size
        cut = next((max(m.end() for m in found) for p in _CUTS if (found := list(p.finditer(text, lo, hi)))), hi)
        pieces.append(text[start:cut].strip())
        back = max(cut - overlap, start + 1)
        soft = re.search(r"\s\S", text[back:cut])
        start = back + soft.start() + 1 if soft else back
    pieces.append(text[start:].strip())
    return [p for p in pieces if p]


def split_texts(rows: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``rows`` (id, text) to id, piece, piece_text.  Only texts over ``size`` leave the JVM; texts of white space give nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out += [(id_, n, p) for n, p in enumerate(split_text(text, size, overlap))]
            cols = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string()))], ["id", "piece", "piece_text"])

    full = rows.select(F.col("id").cast("string").alias("id"), "text").filter(F.col("text").isNotNull() & F.col("text").rlike(f"[^{outline.SPACE}]"))
    short = full.filter(F.length("text") <= size).select("id", F.lit(0).alias("piece"), F.regexp_replace("text", f"^[{outline.SPACE}]+|[{outline.SPACE}]+$", "").alias("piece_text"))
    return short.unionByName(full.filter(F.length("text") > size).mapInArrow(run, "id string, piece int, piece_text string"))


def merge_list(texts: list[str], window: int = OVERLAP + MARGIN) -> str:
    """Texts in order as one: where a text begins with the end of what is before it, that is dropped; else a blank line joins them."""
    parts, tail = [], ""
    for n, text in enumerate(texts):
        shared = next((k for k in range(min(len(tail), len(text), window), 0, -1) if tail.endswith(text[:k])), 0)
        added = text[shared:] if shared or not n else "\n\n" + text
        parts.append(added)
        tail = (tail + added)[-window:]
    return "".join(parts)


def merge_rows(rows: DataFrame, texts: str, into: str, window: int = OVERLAP + MARGIN) -> DataFrame:
    """``rows`` with the array column ``texts`` merged to the text column ``into``, in one pass of Arrow batches; null texts count as absent."""
    kept = [c for c in rows.columns if c != texts]
    schema = T.StructType([rows.schema[c] for c in kept] + [T.StructField(into, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged = [None if t is None else merge_list([x for x in t if x is not None], window) for t in batch.column(texts).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(merged, pa.string())], [*kept, into])

    return rows.mapInArrow(run, schema)


def figure_text(caption: Column, labels: Column, description: Column, page: Column) -> Column:
    """Caption, labels and description in paragraphs; ``Figure on page N`` if all are empty."""
    empty = F.lit("")
    joined = F.concat_ws("\n\n", F.nullif(caption, empty), F.when(F.nullif(labels, empty).isNotNull(), F.concat(F.lit("Labels: "), labels)), F.nullif(description, empty))
    return F.when(joined == "", F.concat(F.lit("Figure on page "), page.cast("string"))).otherwise(joined)


def table_text(caption: Column, markdown: Column) -> Column:
    """Caption and table in paragraphs; null if both are empty."""
    return F.nullif(F.concat_ws("\n\n", F.nullif(caption, F.lit("")), F.nullif(markdown, F.lit(""))), F.lit(""))


def table_markdown(cells: Column) -> Column:
    """A table (array of rows, each an array of texts) as Markdown, the first row its head; null for a table without rows.

    Bars are escaped, line breaks become blanks, missing cells are empty, and short rows are filled up to the head's width.
    """
    width = F.size(cells[0])
    flat = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"\s*[\r\n]+\s*", " ")
    clean = lambda x: F.replace(flat(x), F.lit("|"), F.lit("\\|"))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.concat(r, F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0)))), clean), " | "), F.lit(" |"))
    lines = F.transform(cells, line)
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width))
    return F.when(F.size(cells) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))), "\n"))


def described(items: DataFrame) -> DataFrame:
    """Pictures and tables with the caption that refers to them: items (manual_id, seq, label, text, self_ref, parent_ref, ...).

    An item's own caption stays; else it gets the texts of the caption items whose parent_ref is its self_ref, in order.
    Those caption items are left out, as they would be said twice; captions that refer to nothing stay as texts.
    """
    owners = items.filter(F.col("label").isin("picture", "table") & F.col("self_ref").isNotNull())
    told = items.filter((F.col("label") == "caption") & F.col("parent_ref").isNotNull()).select("manual_id", F.col("parent_ref").alias("self_ref"), F.col("seq").alias("_s"), F.col("text").alias("_t"))
    spoken = told.groupBy("manual_id", "self_ref").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_s", "_t"))), lambda x: x["_t"]), " ").alias("_caption"))
    used = items.join(owners.select("manual_id", F.col("self_ref").alias("parent_ref")).distinct(), ["manual_id", "parent_ref"], "left_semi").filter(F.col("label") == "caption").select("manual_id", "seq")
    left = items.join(used, ["manual_id", "seq"], "left_anti").join(spoken, ["manual_id", "self_ref"], "left")
    return left.withColumn("caption", F.coalesce(F.nullif("caption", F.lit("")), F.when(F.col("label").isin("picture", "table"), F.col("_caption")))).select(*items.columns)


def picture_index(self_ref: Column, fallback: Column) -> Column:
    """The number after the last ``/`` of a reference, else the running count."""
    return F.coalesce(F.nullif(F.regexp_extract(self_ref, "(?:^|/)([0-9]+)$", 1), F.lit("")).try_cast("int"), fallback)


def marker_shapes(pictures: DataFrame) -> DataFrame:
    """Shapes (manual_id, w, h, rounded half to even) of small pictures that repeat in a manual: inline markers."""
    sized = pictures.select("manual_id", F.bround("w").cast("int").alias("w"), F.bround("h").cast("int").alias("h"), (F.col("w") * F.col("h")).alias("area"))
    small = sized.filter((F.col("area") > 0) & (F.col("area") <= MARKER_AREA))
    return small.groupBy("manual_id", "w", "h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MARKER_REPEATS)


def attach_markers(items: DataFrame) -> DataFrame:
    """Texts of one run (manual_id, run, seq, is_marker, text) with the markers before them: ``[a] [b] text``.

    Markers that no text of their run follows stand alone at its end.
    """
    # A text and the markers before it have the same number of texts before them.
    island = ordered.running_sum(items, F.when(F.col("is_marker"), 0).otherwise(1), ["manual_id", "run"], "seq", [], "island")
    listed = island.groupBy("manual_id", "run", "island").agg(F.max("seq").alias("seq"), F.array_sort(F.collect_list(F.struct("seq", "is_marker", "text"))).alias("x"))
    return listed.select(
        "manual_id", "run", "seq", F.array_join(F.transform("x", lambda e: F.when(e["is_marker"], F.concat(F.lit("["), e["text"], F.lit("]"))).otherwise(e["text"])), " ").alias("text")
    )


def chunk_buffers(items: DataFrame, marks: DataFrame, cut) -> DataFrame:
    """Items to buffers in reading order: manual_id, bookmark_id, kind, page, seq, run, text.

    The bookmark in effect comes from a heading's title, else from the position, else from the item before.  Runs of text
    under one bookmark are one buffer, cut by tables and pictures, which are buffers of their own.
    """
    located = items.filter(F.col("page").isNotNull()).select("manual_id", "page", F.struct("manual_id", "seq").alias("item_id"), "top", "text", "label")
    named = outline.heading_match(located.filter(F.col("label").isin("section_header", "title")), marks).select("item_id", F.col("bookmark_id").alias("by_title"))
    placed = outline.asof_bookmark(located.select("manual_id", "page", "item_id", "top"), marks).select("item_id", F.col("bookmark_id").alias("by_place"))
    keyed = items.withColumn("item_id", F.struct("manual_id", "seq")).join(named, "item_id", "left").join(placed, "item_id", "left")
    # Written once: blocks and their summaries read it, and carrying and counting would each double the work before them.
    own = cut(keyed.withColumn("own", F.coalesce("by_title", "by_place")).drop("item_id", "by_title", "by_place"))
    carried = ordered.carry_forward(own, "own", ["manual_id"], "seq", [])
    block = F.when(F.col("label").isin("table", "picture"), F.col("seq")).otherwise(F.lit(None).cast("int"))
    flagged = ordered.runs(carried.withColumn("block", block), ["carried", "block"], ["manual_id"], "seq", [])
    own = F.when(F.col("label") == "picture", figure_text(F.col("caption"), F.col("labels"), F.col("description"), F.col("page"))).when(
        F.col("label") == "table", table_text(F.col("caption"), F.col("text"))
    ).otherwise(F.trim("text"))
    kind = F.when(F.col("label") == "picture", "figure").when(F.col("label") == "table", "table").otherwise("text")
    spoken = flagged.select("manual_id", "run", "seq", F.col("carried").alias("bookmark_id"), kind.alias("kind"), "page", own.alias("text")).filter("text <> ''")
    buffers = spoken.groupBy("manual_id", "run").agg(
        F.first("bookmark_id").alias("bookmark_id"), F.first("kind").alias("kind"), F.min("page").alias("page"), F.min("seq").alias("seq"), F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("x")
    )
    return buffers.withColumn("text", F.array_join(F.transform("x", lambda e: e["text"]), "\n\n")).drop("x")


def chunk_items(items: DataFrame, marks: DataFrame, cut) -> DataFrame:
    """Items to chunks in reading order: manual_id, bookmark_id, kind, page, seq, piece, text: buffers, the long ones split."""
    whole = cut(chunk_buffers(items, marks, cut).withColumn("id", F.concat_ws(" ", "manual_id", "run")))
    pieces = split_texts(whole)
    return whole.select("id", "manual_id", "bookmark_id", "kind", "page", "seq").join(pieces, "id").select("manual_id", "bookmark_id", "kind", "page", "seq", "piece", F.col("piece_text").alias("text"))
