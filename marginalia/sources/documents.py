"""Sources: files to fingerprints and layout items through a pluggable parser, archives, and batches for an embedder.

Parsing needs Python, so it runs in ``mapInPandas`` over partitions; a file that can't be parsed becomes a row with an
error, never a failed job.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "path string, seq int, label string, text string, page int, top double, error string"
FINGERPRINT = "path string, file_hash string, title string, page_count int, outline array<struct<title:string,level:int,page_num:int>>, error string"


class DocumentParser(Protocol):
    """Bytes to a title, a number of pages, an outline and layout items."""

    def parse(self, content: bytes) -> dict: ...


class MarkdownParser:
    """Plain text and Markdown: headings make the outline, form feeds the pages, blank lines the items."""

    def parse(self, content: bytes) -> dict:
        items, outline = [], []
        pages = content.decode("utf-8").split("\f")
        for n, page in enumerate(pages, 1):
            for k, block in enumerate(b for b in re.split(r"\n[ \t]*\n", page) if b.strip()):
                m = re.match(r"(#{1,6})\s+(.*)", block.strip())
                label = "section_header" if m else "table" if block.lstrip().startswith("|") else "text"
                if m:
                    outline.append({"title": m.group(2), "level": len(m.group(1)), "page_num": n})
                items.append({"label": label, "text": m.group(2) if m else block.strip(), "page": n, "top": 800.0 - 10.0 * k})
        return {"title": outline[0]["title"] if outline else None, "page_count": len(pages), "outline": outline, "items": items}


def files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Regular files below ``folder``; their content is only read if a plan uses it."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)


def _safe(parser: DocumentParser, content: bytes | None) -> tuple[dict, str | None]:
    try:
        if content is None:
            raise ValueError("no content")
        return parser.parse(bytes(content)), None
    except Exception as e:  # the error is a column
        return {"title": None, "page_count": None, "outline": [], "items": []}, f"{type(e).__name__}: {e}"


def fingerprints(contents: DataFrame, parser: DocumentParser) -> DataFrame:
    """``contents`` (path, content) to hash, title, number of pages and outline, or an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"]):
                doc, error = _safe(parser, content)
                rows.append((path, None if content is None else hashlib.sha256(bytes(content)).hexdigest(), doc["title"], doc["page_count"], doc["outline"], error))
            yield pd.DataFrame(rows, columns=["path", "file_hash", "title", "page_count", "outline", "error"]).astype({"page_count": "Int32"})

    return contents.select("path", "content").mapInPandas(run, FINGERPRINT)


def parse_items(contents: DataFrame, parser: DocumentParser) -> DataFrame:
    """``contents`` (path, content) to layout items in reading order; a failed file gives one row with the error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"]):
                doc, error = _safe(parser, content)
                rows += [(path, n, i["label"], i["text"], i["page"], i["top"], None) for n, i in enumerate(doc["items"])]
                if error:
                    rows.append((path, None, None, None, None, None, error))
            yield pd.DataFrame(rows, columns=["path", "seq", "label", "text", "page", "top", "error"]).astype({"seq": "Int32", "page": "Int32"})

    return contents.select("path", "content").mapInPandas(run, ITEM)


def write_markdown(items: DataFrame, folder: str) -> None:
    """``items`` (path, seq, label, text) as one Markdown text per path, in a folder ``path=...`` each; failed files have none."""
    shown = F.when(F.col("label") == "section_header", F.concat(F.lit("# "), "text")).otherwise(F.col("text"))
    told = items.filter(F.col("text").isNotNull()).select("path", "seq", shown.alias("value"))
    # A blank line behind each; rows of a path lie together, in order.
    lines = told.withColumn("value", F.concat("value", F.lit("\n"))).repartition("path").sortWithinPartitions("path", "seq")
    lines.select("path", "value").write.partitionBy("path").text(folder)


def plan_batches(lengths: Sequence[int], budget: int) -> list[list[int]]:
    """Positions in batches whose longest text times their number stays within ``budget``; longest first, every position once.

    A text over the budget is a batch of its own.
    """
    batches: list[list[int]] = []
    width = 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        if not batches or (len(batches[-1]) + 1) * width > budget:
            batches.append([])
            width = max(lengths[i], 1)
        batches[-1].append(i)
    return batches


def batched(rows: DataFrame, budget: int) -> DataFrame:
    """``rows`` (id, length) to id and the number of its embedding batch within its Arrow batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for k, f in enumerate(frames):
            plan = plan_batches(f["length"].tolist(), budget)
            at = {i: b for b, members in enumerate(plan) for i in members}
            yield pd.DataFrame({"id": f["id"], "length": f["length"], "frame": k, "batch": [at[i] for i in range(len(f))]})

    return rows.select("id", "length").mapInPandas(run, "id string, length int, frame int, batch int")


class ArchiveError(ValueError):
    """An archive that can't be imported here."""


def write_archive(folder: str, manuals: DataFrame, bookmarks: DataFrame, figures: DataFrame, chunks: DataFrame, model: str) -> None:
    """The chosen manuals and all that belongs to them as a folder of JSON lines; the manifest is written last.

    Nothing is collected: every member is a distributed write, and children are chosen by a semi-join.
    """
    keys = manuals.select(F.col("id").alias("manual_id"))
    manuals.write.option("compression", "gzip").json(f"{folder}/manuals")
    for name, rows in (("bookmarks", bookmarks), ("figures", figures), ("chunks", chunks)):
        rows.join(keys, "manual_id", "left_semi").write.option("compression", "gzip").json(f"{folder}/{name}")
    manifest = json.dumps({"format_version": 4, "embedding_model": model})
    manuals.sparkSession.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{folder}/manifest")


def _lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Files compressed with zstandard to their lines, a few at a time."""
    import io

    import zstandard

    for f in frames:
        for content in f["content"]:
            held: list[str] = []
            with zstandard.ZstdDecompressor().stream_reader(bytes(content), read_across_frames=True) as raw:
                for line in io.TextIOWrapper(raw, encoding="utf-8"):
                    held.append(line)
                    if len(held) >= 1000:
                        yield pd.DataFrame({"value": held})
                        held = []
            yield pd.DataFrame({"value": held})


def chunk_source(spark: SparkSession, folder: str) -> DataFrame:
    """Archived chunks of any published form: id, document, embedding and metadata (a map).

    Taken in this order: JSON lines compressed with zstandard, plain or gzipped JSON lines, one legacy JSON document of
    parallel arrays (shorter arrays give nulls); else ``ArchiveError``.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(f.getPath().getName() for f in fs.listStatus(path(folder))) if fs.exists(path(folder)) else []
    row = "id string, document string, embedding array<float>, metadata map<string,string>"
    if any(n.endswith(".jsonl.zst") for n in names):
        lines = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl.zst").load(folder).select("content").mapInPandas(_lines, "value string")
    elif any(n.endswith((".jsonl", ".jsonl.gz")) for n in names):
        lines = spark.read.option("pathGlobFilter", "*.jsonl*").text(folder)
    elif "chunks.json" in names:
        legacy = "ids array<string>, documents array<string>, embeddings array<array<float>>, metadatas array<map<string,string>>"
        whole = spark.read.schema(legacy).option("multiLine", True).json(f"{folder}/chunks.json")
        empty = lambda c, t: F.coalesce(c, F.array().cast(t))
        zipped = F.arrays_zip(
            empty(F.col("ids"), "array<string>").alias("id"), empty(F.col("documents"), "array<string>").alias("document"),
            empty(F.col("embeddings"), "array<array<float>>").alias("embedding"), empty(F.col("metadatas"), "array<map<string,string>>").alias("metadata"),
        )
        return whole.select(F.explode(zipped).alias("r")).select("r.id", "r.document", "r.embedding", "r.metadata").filter("id is not null")
    else:
        raise ArchiveError(f"no chunks in {folder}")
    return lines.filter(F.trim("value") != "").select(F.from_json("value", row).alias("r")).select("r.*").filter("id is not null")


def read_archive(spark: SparkSession, folder: str, stored: DataFrame, model: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """An archive's rows that an import accepts: of manuals whose id isn't stored; chunks only with an embedding.

    An archive without manifest is incomplete; one made with another embedding model is refused.
    """
    try:
        manifest = json.loads(spark.read.text(f"{folder}/manifest").first()[0])
    except Exception as e:
        raise ArchiveError(f"no manifest in {folder}") from e
    if manifest.get("embedding_model") not in (None, model):
        raise ArchiveError(f"made with {manifest['embedding_model']}, not {model}")
    read = {n: spark.read.schema(s).json(f"{folder}/{n}") for n, s in schemas.items()}
    manuals = read["manuals"].join(stored.select("id"), "id", "left_anti")
    keys = manuals.select(F.col("id").alias("manual_id"))
    out = {"manuals": manuals} | {n: r.join(keys, "manual_id", "left_semi") for n, r in read.items() if n != "manuals"}
    if "chunks" in out:
        out["chunks"] = out["chunks"].filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    return out
