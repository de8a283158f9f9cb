"""References to records that do not exist.

Method: a skew-aware split.  References are pre-aggregated per target key and calendar month; the groups carry the
verdicts.  Keys that hold many references, counted and small enough to broadcast, meet the target states in a broadcast
join; the remaining keys go through a shuffled anti-join, which finds the missing ones, and a join with the states of
the known ones; both parts are united.  A target state says whether a key has rows, when it was first and last written,
and when it was last removed.

Counts come from the groups.  Rows come from joining the broken groups, and only them, back to the references: by
broadcast if they are small, else heavy groups by broadcast and the others by shuffle.

A key is heavy from ``min_heavy`` references on, however many references there are.  Heavy keys are broadcast only if
they take up no more than ``BROADCAST_BYTES``, by their measured length; beyond that, references and groups are salted
over ``SALTS`` parts of a key, so that no key goes to one task as a whole.

Defined results: null or blank references yield nothing; a null date satisfies no date comparison; repeated rows of a
record count once; empty tables give empty results (references to an empty table are all missing); columns besides
the named ones are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most bytes of keys that are broadcast.
BROADCAST_BYTES = 32 << 20
#: Parts of a key where heavy keys are too many to broadcast.
SALTS = 32

_KEY = ["target_table", "key"]
_REF = ["table_name", "ref_field", *_KEY]


@dataclass(frozen=True)
class Reference:
    """One kind of reference: where it stands, what it names and when the referring record was written."""

    table_name: str
    rows: DataFrame
    record_id: Column
    ref_field: str
    target_table: str
    key: Column
    date: Column | None


@dataclass(frozen=True)
class Target:
    """One table that is referred to."""

    target_table: str
    rows: DataFrame
    key: Column
    date: Column | None


def _ts(col: Column | None) -> Column:
    return (F.lit(None) if col is None else col).cast("timestamp")


def reference_rows(references: list[Reference]) -> DataFrame:
    """One row per referring record and field, with the record's first date (null if none or not comparable)."""
    parts = [
        r.rows.select(
            F.lit(r.table_name).alias("table_name"),
            F.lit(r.ref_field).alias("ref_field"),
            F.lit(r.target_table).alias("target_table"),
            r.key.alias("key"),
            r.record_id.alias("record_id"),
            _ts(r.date).alias("date"),
        ).filter(F.col("key").isNotNull() & F.col("record_id").isNotNull())
        for r in references
    ]
    united = parts[0]
    for p in parts[1:]:
        united = united.unionByName(p)
    return united.groupBy(*_REF, "record_id").agg(F.min("date").alias("first_date"))


def target_states(targets: list[Target], removed: DataFrame) -> DataFrame:
    """One row per key that has rows or was removed.

    ``removed`` has target_table, key, removed_at.  ``gone``: the last removal is not before the last date; a target
    without any date that was ever removed is gone.
    """
    none = F.lit(None).cast("timestamp")
    parts = [
        t.rows.select(
            F.lit(t.target_table).alias("target_table"),
            t.key.alias("key"),
            F.lit(1).alias("present"),
            F.lit(0).alias("removed"),
            _ts(t.date).alias("date"),
            none.alias("removed_at"),
        )
        for t in targets
    ] + [
        removed.select(
            "target_table", "key", F.lit(0).alias("present"), F.lit(1).alias("removed"), none.alias("date"), _ts(F.col("removed_at")).alias("removed_at")
        )
    ]
    united = parts[0]
    for p in parts[1:]:
        united = united.unionByName(p)
    agg = (
        united.filter(F.col("key").isNotNull())
        .groupBy(*_KEY)
        .agg(
            F.max("present").alias("present"),
            F.max("removed").alias("removed"),
            F.min("date").alias("target_first"),
            F.max("date").alias("target_last"),
            F.max("removed_at").alias("removed_last"),
        )
    )
    gone = (F.col("removed") == 1) & F.coalesce(F.col("target_last").isNull() | (F.col("removed_last") >= F.col("target_last")), F.lit(False))
    return agg.select(*_KEY, (F.col("present") == 1).alias("present"), gone.alias("gone"), "target_first")


def reference_groups(refs: DataFrame) -> DataFrame:
    """References pre-aggregated per key and calendar month (``yyyy-MM``; null without date): n, and first and last date."""
    return refs.groupBy(*_REF, F.date_format("first_date", "yyyy-MM").alias("period")).agg(
        F.count(F.lit(1)).alias("n"), F.min("first_date").alias("lo"), F.max("first_date").alias("hi")
    )


def _bytes(rows: DataFrame) -> int:
    """Length of ``rows`` of keys, as they would be broadcast."""
    return rows.agg(F.sum(F.octet_length("key") + 100)).first()[0] or 0


def heavy_keys(groups: DataFrame, min_heavy: int) -> DataFrame:
    """Keys with at least ``min_heavy`` references."""
    return groups.groupBy(*_KEY).agg(F.sum("n").alias("n")).filter(F.col("n") >= min_heavy).select(*_KEY)


def judged(groups: DataFrame, states: DataFrame, heavy: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broken groups with reason and target_first.

    reason is ``missing`` (no row), ``removed``, ``early`` (all of the group's records are older than their target) or
    ``part`` (some are).
    """
    known = states.filter("present")

    def found(part: DataFrame, small: bool) -> DataFrame:
        right = F.broadcast(known.join(F.broadcast(heavy), _KEY, "left_semi")) if small else known
        absent = part.join(right, _KEY, "left_anti").select(*part.columns, F.lit("missing").alias("reason"), F.lit(None).cast("timestamp").alias("target_first"))
        reason = F.when(F.col("gone"), "removed").when(F.col("hi") < F.col("target_first"), "early").when(F.col("lo") < F.col("target_first"), "part")
        # A null verdict is a sound group.
        return absent.unionByName(part.join(right, _KEY).select(*part.columns, reason.alias("reason"), "target_first").filter(F.col("reason").isNotNull()))

    size = _bytes(heavy)
    if not 0 < size <= broadcast_bytes:
        # No heavy keys, or too many: groups hold one row per key, field and month, so nothing is skewed here.
        return found(groups, False)
    hot = F.broadcast(heavy)
    return found(groups.join(hot, _KEY, "left_semi"), True).unionByName(found(groups.join(hot, _KEY, "left_anti"), False))


def _broken_groups(refs: DataFrame, states: DataFrame, cut, min_heavy: int, broadcast_bytes: int) -> DataFrame:
    groups = cut(reference_groups(refs))
    return cut(judged(groups, states, cut(heavy_keys(groups, min_heavy)), broadcast_bytes))


def members(refs: DataFrame, broken: DataFrame, min_heavy: int, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The references of ``broken`` groups, with the group's reason; of groups broken in part only those that are older than the target."""
    on = [*_REF, "month"]
    left = refs.withColumn("month", _month(F.col("first_date")))
    right = broken.select(*_REF, F.coalesce("period", F.lit("")).alias("month"), "n", "reason", "target_first")
    if _bytes(right) <= broadcast_bytes:
        joined = left.join(F.broadcast(right.drop("n")), on)
    else:
        heavy = right.filter(F.col("n") >= min_heavy)
        if _bytes(heavy) <= broadcast_bytes:
            hot = F.broadcast(heavy.drop("n"))
            light = left.join(F.broadcast(heavy.select(*on)), on, "left_anti")
            joined = left.join(hot, on).unionByName(light.join(right.filter(F.col("n") < min_heavy).drop("n"), on))
        else:
            salted = left.withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int"))
            copies = right.drop("n").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            joined = salted.join(copies, [*on, "salt"]).drop("salt")
    return joined.filter((F.col("reason") != "part") | F.coalesce(F.col("first_date") < F.col("target_first"), F.lit(False)))


def _month(date: Column) -> Column:
    return F.coalesce(F.date_format(date, "yyyy-MM"), F.lit(""))


def orphan_rows(references: list[Reference], targets: list[Target], removed: DataFrame, cut, min_heavy: int = 100_000, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Every broken reference: table_name, record_id, ref_field, period, reason (missing, removed or early)."""
    refs, states = reference_rows(references), target_states(targets, removed)
    broken = _broken_groups(refs, states, cut, min_heavy, broadcast_bytes)
    period = F.nullif("month", F.lit("")).alias("period")
    reason = F.when(F.col("reason") == "part", "early").otherwise(F.col("reason")).alias("reason")
    return members(refs, broken, min_heavy, broadcast_bytes).select("table_name", "record_id", "ref_field", period, reason)


def orphan_counts(references: list[Reference], targets: list[Target], removed: DataFrame, cut, min_heavy: int = 100_000, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broken references per table_name, ref_field and calendar month.

    Only groups whose month is the very month in which the target first appeared can be broken in part; their records
    are compared one by one.
    """
    refs, states = reference_rows(references), target_states(targets, removed)
    broken = _broken_groups(refs, states, cut, min_heavy, broadcast_bytes)
    whole = broken.filter("reason <> 'part'").select("table_name", "ref_field", "period", "n")
    partly = members(refs, broken.filter("reason = 'part'"), min_heavy, broadcast_bytes).select(
        "table_name", "ref_field", F.nullif("month", F.lit("")).alias("period"), F.lit(1).cast("bigint").alias("n")
    )
    return whole.unionByName(partly).groupBy("table_name", "ref_field", "period").agg(F.sum("n").alias("orphans"))
