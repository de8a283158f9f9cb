"""The library: paths, folders, synchronisation, upserts, deletions and archives.  All joins are on full keys."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class LibraryError(ValueError):
    """kind is ``invalid`` or ``not_found``."""

    def __init__(self, kind: str, message: str) -> None:
        super().__init__(message)
        self.kind = kind


def path_norm(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def glob_regex(pattern: str) -> str:
    """A case-sensitive glob as a regular expression over the whole path; ``*`` and ``?`` cross folders."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (j := pattern.find("]", i + 1)) > 0:
            body, i = pattern[i:j], j + 1
            out.append("[" + ("^" + body[1:] if body[:1] == "!" else body).replace("\\", "\\\\") + "]")
        else:
            out.append(re.escape(c))
    return f"(?s)^(?:{''.join(out)})\\z"


def include(path: Column, globs: Sequence[str] | None) -> Column:
    """Whether any glob matches; no globs at all include everything."""
    cond = F.lit(not globs)
    for g in globs or ():
        cond = cond | path.rlike(glob_regex(g))
    return cond


def manual_pattern(pattern: str) -> Column | None:
    """The manuals that a path pattern names; None for ``*``, the whole corpus.  Only ``*`` is special."""
    clean = pattern.replace("\\", "/").strip().strip("/")
    if clean in ("", "."):
        raise LibraryError("invalid", f"no manual path: {pattern!r}")
    if clean == "*":
        return None
    body = ".*".join(re.escape(x) for x in clean.split("*"))
    return path_norm(F.col("relative_path")).rlike(f"(?s)^(?:{body})\\z")


def folder_prefix(folder: str) -> str:
    clean = folder.replace("\\", "/").strip().strip("/")
    return "" if clean in ("", ".") else clean + "/"


def list_folder(manuals: DataFrame, folder: str) -> DataFrame:
    """Immediate subfolders with their numbers of manuals at any depth, then the manuals: is_manual, name, manuals, id."""
    prefix = folder_prefix(folder)
    path = path_norm(F.col("relative_path"))
    inside = manuals.filter(path.startswith(prefix)).withColumn("rest", F.substring(path, len(prefix) + 1, 1 << 30))
    folders = inside.filter(F.col("rest").contains("/")).groupBy(F.split_part("rest", F.lit("/"), F.lit(1)).alias("name")).agg(F.count(F.lit(1)).alias("manuals"))
    files = inside.filter(~F.col("rest").contains("/")).select(F.lit(True).alias("is_manual"), F.col("file_name").alias("name"), F.lit(None).cast("bigint").alias("manuals"), "id")
    dirs = folders.select(F.lit(False).alias("is_manual"), "name", "manuals", F.lit(None).cast("string").alias("id"))
    return dirs.unionByName(files)


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of every key.  An aggregate, not a window: it combines before it shuffles and never sorts a hot key."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("r")).select(key, "r.*")


def sync_actions(known: DataFrame, found: DataFrame) -> DataFrame:
    """``known`` and ``found`` (relative_path, file_hash) to relative_path and action: add, replace, keep or delete.

    A found file whose hash is null could not be read; like a missing one it is deleted.
    """
    k, f = known.select("relative_path", F.col("file_hash").alias("old")), found.select("relative_path", F.col("file_hash").alias("new"))
    action = (
        F.when(F.col("new").isNull(), "delete").when(F.col("old").isNull(), "add").when(F.col("old") == F.col("new"), "keep").otherwise("replace")
    )
    both = k.withColumn("k", F.lit(1)).join(f.withColumn("f", F.lit(1)), "relative_path", "full_outer")
    return both.filter(~(F.col("k").isNull() & F.col("new").isNull())).select("relative_path", action.alias("action"))


def upsert(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """``stored`` with the rows of ``incoming`` in place of those with the same key."""
    return stored.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def sync_manuals(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """``stored`` and ``incoming`` (id, file_hash, ...; same columns) to the manuals after a sync, each with an action.

    keep: the hash is the same, the stored row stays as it is; rewrite: another hash, the incoming row replaces it, and
    what was read from the old file must go (see ``without``); insert: new; rest: stored and not incoming.
    """
    others = [c for c in stored.columns if c != "id"]
    left, right = stored.select("id", F.struct(*others).alias("s")), incoming.select("id", F.struct(*others).alias("i"))
    both = left.join(right, "id", "full_outer")
    action = F.when(F.col("i").isNull(), "rest").when(F.col("s").isNull(), "insert").when(F.col("s.file_hash").eqNullSafe(F.col("i.file_hash")), "keep").otherwise("rewrite")
    row = F.when(F.col("action").isin("keep", "rest"), F.col("s")).otherwise(F.col("i"))
    return both.withColumn("action", action).withColumn("r", row).select("id", "r.*", "action")


def without(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table (each with a manual_key) without the rows of the manuals that are ``gone`` (manual_key)."""
    keys = gone.select("manual_key").filter(F.col("manual_key").isNotNull()).distinct()
    return {name: rows.join(keys, "manual_key", "left_anti") for name, rows in tables.items()}


def figure(figures: DataFrame, figure_id: str, key) -> tuple[dict, bytes | None]:
    """One figure's row, and its image apart; raises ``not_found``.  Ids are compared by ``key``."""
    found = figures.filter(key(F.col("id")) == key(F.lit(figure_id))).limit(1).collect()
    if not found:
        raise LibraryError("not_found", f"no figure {figure_id!r}")
    row = found[0].asDict()
    image = row.pop("image", None)
    return row, None if image is None else bytes(image)


def resume_actions(files: DataFrame, reset: bool = False, min_pages: int | None = None, max_pages: int | None = None) -> DataFrame:
    """``files`` with changed, converted_at and page_count to an action: defer (outside the page range), skip or convert."""
    low = F.lit(True) if min_pages is None else F.col("page_count") >= min_pages
    high = F.lit(True) if max_pages is None else F.col("page_count") <= max_pages
    done = ~F.col("changed") & F.lit(not reset) & F.col("converted_at").isNotNull()
    return files.withColumn("action", F.when(~(low & high), "defer").when(done, "skip").otherwise("convert"))


def plan_parts(files: DataFrame, split_pages: int) -> DataFrame:
    """Even page ranges per file: path, part, start_page, end_page.  Parts differ by at most a page."""
    pages = F.greatest(F.coalesce("page_count", F.lit(1)), F.lit(1))
    n = F.when(F.lit(split_pages) <= 0, F.lit(1)).otherwise(F.ceil(pages / F.lit(max(split_pages, 1)))).cast("int")
    sized = files.select("relative_path", pages.alias("pages"), n.alias("n")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    base, extra = F.floor(F.col("pages") / F.col("n")), F.col("pages") % F.col("n")
    start = F.col("part") * base + F.least("part", extra) + 1
    return sized.select("relative_path", "part", start.alias("start_page"), (start + base + F.when(F.col("part") < extra, 1).otherwise(0) - 1).alias("end_page"))


def numbered(rows: DataFrame, cut, *order) -> DataFrame:
    """``rows`` with ``n``, their place (from 1) in the order, by ranges: no task ever sorts more than its own range."""
    ranged = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    # One row per partition.
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_p", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return ranged.join(F.broadcast(starts), "_p").withColumn("n", F.col("_start") + F.col("_i") - F.col("_first") + 1).drop("_p", "_i", "_first", "_start")


def waves(rows: DataFrame, cut, count: int, *order) -> DataFrame:
    """``rows`` in ``count`` waves of even size in the order: the first ones have one more where they don't divide."""
    placed = numbered(rows, cut, *order)
    total = rows.count()
    size, more = divmod(total, count)
    # The first ``more`` waves have size + 1 rows.
    wave = F.when(F.col("n") <= more * (size + 1), F.ceil(F.col("n") / (size + 1))).otherwise(more + F.ceil((F.col("n") - more * (size + 1)) / max(size, 1)))
    return placed.withColumn("wave", wave.cast("int")).drop("n")


def changed(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """Keys whose ``value`` isn't the same in all rows, with its first and last: key, old, new.  Aggregates only."""
    at = F.struct(*order, value)
    g = rows.filter(F.col(value).isNotNull()).groupBy(key).agg(F.min_by(value, at).alias("old"), F.max_by(value, at).alias("new"), F.min(value).alias("_a"), F.max(value).alias("_b"))
    return g.filter("_a <> _b").drop("_a", "_b")


def merge_parts(parts: DataFrame) -> DataFrame:
    """Picture offsets of parts (doc, start_page, n_pictures): pictures in all earlier parts of the document."""
    before = Window.partitionBy("doc").orderBy("start_page").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("offset", F.coalesce(F.sum("n_pictures").over(before), F.lit(0)))


def point_id(text: Column, namespace_hex: str) -> Column:
    """UUID version 5 of ``text`` in a namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(text, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def format_duration(seconds: Column) -> Column:
    """``m:ss`` or ``h:mm:ss``; empty for null and negative values."""
    s = F.floor(seconds)
    h, m, r = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    return F.when(seconds.isNull() | (seconds < 0), "").when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def snippet(text: Column, size: int) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)
