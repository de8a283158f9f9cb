"""Outlines: parents from levels, subtrees as intervals, positions of items among bookmarks, runs of text.

An outline belongs to one manual and is bounded by what a document holds, so windows are partitioned by manual; every
window here has a plain running frame that needs no buffering of the partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = 10.0


def _levels(marks: DataFrame) -> list[int]:
    """The levels that occur, ascending."""
    return [r[0] for r in marks.select("level").filter("level is not null").distinct().orderBy("level").collect()]


def parents_from_levels(marks: DataFrame, strict: bool = False) -> DataFrame:
    """id and parent: the nearest earlier bookmark of a smaller level.

    ``strict`` takes it only if its level is exactly one less.  One running maximum per level that occurs: no self-join.
    """
    before = Window.partitionBy("manual_id").orderBy("ordering", "id").rowsBetween(Window.unboundedPreceding, -1)
    lasts = [F.max(F.when(F.col("level") == n, F.struct("ordering", "id", F.lit(n).alias("lv")))).over(before) for n in _levels(marks)]
    none = F.lit(None).cast("struct<ordering:int,id:string,lv:int>")
    seen = marks.select("id", F.col("level").alias("lv"), F.array(*(lasts or [none])).alias("lasts"))
    best = F.array_max(F.filter("lasts", lambda x: x["lv"] < F.col("lv")))
    found = seen.select("id", best.alias("b"), "lv")
    parent = F.col("b.id") if not strict else F.when(F.col("b.lv") == F.col("lv") - 1, F.col("b.id"))
    return found.select("id", parent.alias("parent"))


def ancestors(marks: DataFrame) -> DataFrame:
    """id and ancestor: every bookmark with each one above it by levels.  As many rows as there are, no join.

    Above a bookmark stands, of every smaller level, the last one before it, unless a bookmark of a still smaller level
    came after that.
    """
    before = Window.partitionBy("manual_id").orderBy("ordering", "id").rowsBetween(Window.unboundedPreceding, -1)
    lasts = [F.max(F.when(F.col("level") == n, F.struct("ordering", "id", F.lit(n).alias("lv")))).over(before) for n in _levels(marks)]
    none = F.lit(None).cast("struct<ordering:int,id:string,lv:int>")
    seen = marks.select("id", F.col("level").alias("lv"), F.array(*(lasts or [none])).alias("lasts"))
    known = seen.select("id", F.filter("lasts", lambda x: x.isNotNull() & (x["lv"] < F.col("lv"))).alias("lasts"))
    later = lambda x: F.exists("lasts", lambda y: (y["lv"] < x["lv"]) & (F.struct(y["ordering"], y["id"]) > F.struct(x["ordering"], x["id"])))
    return known.select("id", F.explode(F.filter("lasts", lambda x: ~later(x))).alias("a")).select("id", F.col("a.id").alias("ancestor"))


def subtrees(marks: DataFrame) -> DataFrame:
    """id, manual_id, lo, hi, n and deepest: the subtree of a bookmark is lo <= ordering < hi (hi null: to the end).

    hi is the first later ordering of the same or a smaller level; n counts the subtree's bookmarks and deepest is its
    greatest level (null levels aside), both 0 where the subtree is empty because the next bookmark has the same ordering.
    Everything is running aggregates over a manual's bookmarks, read backwards: nothing is joined.
    """
    backwards = Window.partitionBy("manual_id").orderBy(F.desc("ordering"), F.desc("id"))
    later = backwards.rowsBetween(Window.unboundedPreceding, -1)
    from_here = Window.partitionBy("manual_id").orderBy(F.desc("ordering")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = marks.select("id", "manual_id", "level", "ordering", F.count(F.lit(1)).over(from_here).alias("behind"))
    # Read backwards, the nearest later mark of a level is the last one seen: its ordering is the minimum.
    levels = _levels(marks)
    nexts = [F.struct(F.lit(n).alias("lv"), F.min(F.when(F.col("level") == n, F.struct("ordering", "behind"))).over(later).alias("at")) for n in levels]
    # First ordering of each level from the own ordering on, bookmarks at the same ordering included.
    first = [F.struct(F.lit(n).alias("lv"), F.min(F.when(F.col("level") == n, F.col("ordering"))).over(from_here).alias("o")) for n in levels]
    none = F.lit(None).cast("struct<lv:int,at:struct<ordering:int,behind:bigint>>")
    seen = counted.select("id", "manual_id", "level", "behind", F.col("ordering").alias("lo"), F.array(*(nexts or [none])).alias("nexts"), F.array(*(first or [F.lit(None).cast("struct<lv:int,o:int>")])).alias("first"))
    reach = F.array_min(F.transform(F.filter("nexts", lambda x: x["lv"] <= F.col("level")), lambda x: x["at"]))
    bounded = seen.withColumn("end", reach).withColumn("hi", F.col("end.ordering"))
    inside = F.filter("first", lambda x: (x["o"] >= F.col("lo")) & (F.col("hi").isNull() | (x["o"] < F.col("hi"))))
    n = F.col("behind") - F.coalesce(F.col("end.behind"), F.lit(0))
    return bounded.select(
        "id", "manual_id", "lo", "hi", F.greatest(n, F.lit(0)).alias("n"), F.coalesce(F.array_max(F.transform(inside, lambda x: x["lv"])), F.lit(0)).alias("deepest")
    )


def subtree_bounds(marks: DataFrame) -> DataFrame:
    """id, manual_id, lo and hi of every bookmark: see ``subtrees``."""
    return subtrees(marks).select("id", "manual_id", "lo", "hi")


# Section numbers before a title, and what is trimmed from its ends.
NUMBERING = r"^(?:\d+(?:[.\-]\d+)*[.)]?|[ivxlcdm]+[.)]|[a-z][.)])\s+"
TITLE_ENDS = " \t.,:;!?-–—_()[]{}<>\"'`*#|/\\、。，．：；・"
#: White space by Unicode's rules, for classes of Java expressions.
SPACE = r"\s\x1c-\x1f\x85\u00A0\u1680\u2000-\u200a\u2028\u2029\u202F\u205F\u3000"


def normalize_title(title: Column) -> Column:
    """Lower-cased title without section number, with single blanks and no punctuation at its ends; null becomes empty."""
    t = F.lower(F.regexp_replace(F.coalesce(title, F.lit("")), f"^[{SPACE}]+|[{SPACE}]+$", ""))
    t = F.regexp_replace(F.regexp_replace(t, NUMBERING.replace(r"\s", f"[{SPACE}]"), ""), f"[{SPACE}]+", " ")
    return F.btrim(t, F.lit(TITLE_ENDS))


def asof_bookmark(items: DataFrame, marks: DataFrame) -> DataFrame:
    """The bookmark in effect at an item by position: on its page, the lowest of those that start above it, give or take 10 points.

    ``items`` (manual_id, page, item_id, top) and ``marks`` (manual_id, page_num, id, page_top, ordering).  An unknown top
    counts as -1.  An as-of join by one sort: items and bookmarks of a page are read downwards together, and an item takes the
    last bookmark seen; no pairs are made, however full a page is.
    """
    none = F.lit(None)
    seen = marks.select(
        "manual_id", F.col("page_num").alias("page"), F.coalesce("page_top", F.lit(-1.0)).alias("at"), F.lit(1).alias("is_mark"), F.col("ordering").cast("bigint").alias("o"),
        F.col("id").alias("bookmark_id"), none.alias("item_id"),
    )
    asked = items.filter(F.col("top").isNotNull()).select(
        "manual_id", "page", (F.col("top") - TOLERANCE).alias("at"), F.lit(0).alias("is_mark"), none.cast("bigint").alias("o"), none.cast("string").alias("bookmark_id"), "item_id"
    )
    # At equal heights an item comes first, as a bookmark must start above it; of equal bookmarks the last in order counts.
    down = Window.partitionBy("manual_id", "page").orderBy(F.desc("at"), "is_mark", "o", F.desc("bookmark_id")).rowsBetween(Window.unboundedPreceding, 0)
    both = asked.unionByName(seen).filter(F.col("manual_id").isNotNull() & F.col("page").isNotNull())
    carried = both.withColumn("carried", F.last("bookmark_id", ignorenulls=True).over(down))
    return carried.filter(F.col("is_mark") == 0).filter(F.col("carried").isNotNull()).select("item_id", F.col("carried").alias("bookmark_id"))


def heading_match(items: DataFrame, marks: DataFrame) -> DataFrame:
    """The bookmark whose title a heading names: on its page, an equal normalised title before one that contains or is contained.

    Containment needs three characters.  ``items`` (manual_id, page, item_id, text).
    """
    h = items.select("manual_id", "page", "item_id", normalize_title(F.col("text")).alias("t"))
    b = marks.select("manual_id", F.col("page_num").alias("page"), F.col("id").alias("bookmark_id"), normalize_title(F.col("title")).alias("u"), "ordering")
    exact = F.col("t") == F.col("u")
    part = (F.least(F.length("t"), F.length("u")) >= 3) & (F.col("t").contains(F.col("u")) | F.col("u").contains(F.col("t")))
    near = h.join(b, ["manual_id", "page"]).filter((F.length("t") > 0) & (F.length("u") > 0) & (exact | part))
    pick = F.min(F.struct((~exact).alias("x"), "ordering", "bookmark_id"))
    return near.groupBy("item_id").agg(pick.alias("p")).select("item_id", F.col("p.bookmark_id").alias("bookmark_id"))


def resolve_tops(items: DataFrame, marks: DataFrame) -> DataFrame:
    """Tops of bookmarks without one: of the first text item on their page whose text contains the title."""
    m = marks.filter("page_top is null").select("manual_id", F.col("page_num").alias("page"), F.col("id").alias("bookmark_id"), F.lower("title").alias("t"))
    near = items.join(m, ["manual_id", "page"]).filter(F.lower("text").contains(F.col("t")))
    return near.groupBy("bookmark_id").agg(F.min_by("top", "seq").alias("page_top"))
