"""Progress of a build from its event log, in batch and as a stream.

Events: seq, ts, event, path, stage, part, parts, pages, pages_done, error.  The fold is order-dependent, yet it is written
with aggregates only: what counts is decided by positions (the last reset, the first failure after it, the event by which
all parts have been converted), so a file's events are combined before they are shuffled and never gathered in one task.

Rules: queued and skipped start over; failed stays until then; converted counts only once all parts have reported; page
counts of a part only move forward, and queued forgets them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STAGES = ["queued", "skipped", "deferred", "converting", "converted", "embedding", "ingesting", "done", "failed", "unknown"]
STALE_AFTER = 900.0
TRUNCATE = 400

EVENT = T.StructType(
    [T.StructField(n, t) for n, t in (("seq", T.LongType()), ("ts", T.DoubleType()), ("event", T.StringType()), ("path", T.StringType()), ("stage", T.StringType()), ("part", T.IntegerType()), ("parts", T.IntegerType()), ("pages", T.IntegerType()), ("pages_done", T.IntegerType()), ("error", T.StringType()))]
)


def parse(lines: DataFrame) -> DataFrame:
    """``lines`` (value) to events; blank lines, broken JSON and values that aren't objects are dropped."""
    line = F.trim("value")
    parsed = lines.filter(line.startswith("{")).select(F.from_json(line, T.StructType([*EVENT.fields, T.StructField("_bad", T.StringType())]), {"columnNameOfCorruptRecord": "_bad"}).alias("e"))
    return parsed.select("e.*").filter(F.col("_bad").isNull()).drop("_bad")


def sanitize(text: Column, size: int = TRUNCATE) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def _at(stages: tuple[str, ...], what: str = "seq") -> Column:
    return F.max(F.when(F.col("stage").isin(*stages), F.col(what)))


def file_states(events: DataFrame) -> DataFrame:
    """Per path: stage, failed_seq, pages, pages_done."""
    none = F.lit(-1).cast("bigint")
    resets = events.groupBy("path").agg(F.coalesce(_at(("queued", "skipped")), none).alias("reset"), F.coalesce(_at(("queued",)), none).alias("queued"))
    # Positions, not joins on hot keys: one small row per path, joined back; AQE splits a path that holds many rows.
    e = events.join(resets, "path")
    parts = (
        e.filter((F.col("stage") == "converted") & (F.col("seq") > F.col("queued")) & F.col("part").isNotNull())
        .groupBy("path", "part")
        .agg(F.min("seq").alias("first"))
        .groupBy("path")
        .agg(F.array_sort(F.collect_list("first")).alias("firsts"))
    )
    known = events.groupBy("path").agg(F.max_by("parts", F.when(F.col("parts").isNotNull(), F.col("seq"))).alias("n_parts"), F.max_by("pages", F.when(F.col("pages").isNotNull(), F.col("seq"))).alias("pages"))
    opens = known.join(parts, "path", "left").select(
        "path", "pages", F.when(F.coalesce(F.col("n_parts"), F.lit(0)) == 0, none).otherwise(F.coalesce(F.try_element_at("firsts", F.col("n_parts")), F.lit(2**62))).alias("open")
    )
    after = e.filter((F.col("seq") >= F.col("reset")) & F.col("stage").isNotNull()).join(opens, "path")
    counted = after.filter((F.col("stage") != "converted") | (F.col("seq") >= F.col("open")))
    last = counted.groupBy("path").agg(F.max_by("stage", "seq").alias("last"), F.min(F.when(F.col("stage") == "failed", F.col("seq"))).alias("failed_seq"))
    pages = part_pages(events).groupBy("path").agg(F.sum("pages_done").alias("pages_done"))
    return (
        opens.join(last, "path", "left")
        .join(pages, "path", "left")
        .select("path", F.when(F.col("failed_seq").isNotNull(), "failed").otherwise(F.coalesce("last", F.lit("unknown"))).alias("stage"), "failed_seq", "pages", F.coalesce("pages_done", F.lit(0)).alias("pages_done"))
    )


def part_pages(events: DataFrame) -> DataFrame:
    """Most pages reported per path and part since the path was last queued."""
    queued = events.groupBy("path").agg(F.coalesce(_at(("queued",)), F.lit(-1)).alias("queued"))
    return (
        events.filter(F.col("pages_done").isNotNull())
        .join(queued, "path")
        .filter(F.col("seq") > F.col("queued"))
        .groupBy("path", F.coalesce("part", F.lit(0)).alias("part"))
        .agg(F.max("pages_done").alias("pages_done"))
    )


def stage_counts(states: DataFrame) -> DataFrame:
    """Files per stage, zero for stages without files."""
    all_stages = states.sparkSession.createDataFrame([(s,) for s in STAGES], "stage string")
    return F.broadcast(all_stages).join(states.groupBy("stage").agg(F.count(F.lit(1)).alias("n")), "stage", "left").select("stage", F.coalesce("n", F.lit(0)).alias("files"))


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """The event log as a stream: a folder of JSON-lines files, one per batch of events."""
    return spark.readStream.schema(EVENT).json(folder)


def stream_pages(events: DataFrame) -> DataFrame:
    """Running page counts of a stream: the maximum is commutative, so late and repeated events change nothing."""
    return events.filter(F.col("pages_done").isNotNull()).groupBy("path", F.coalesce("part", F.lit(0)).alias("part")).agg(F.max("pages_done").alias("pages_done"))


_STATE = "last string, failed_seq bigint, n_parts int, pages int, converted array<int>, done map<int, int>"
_FOLDED = "path string, stage string, failed_seq bigint, pages int, pages_done bigint"


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The rules of ``file_states``, event by event, on what the state remembers of a path."""
    last, failed, n_parts, pages, converted, done = state.get if state.exists else (None, None, None, None, [], {})
    converted, done = set(converted), dict(done)
    events = pd.concat(list(frames)).sort_values("seq", kind="stable")
    known = lambda x: not pd.isna(x)
    for seq, stage, part, parts, total, pages_done in events[["seq", "stage", "part", "parts", "pages", "pages_done"]].itertuples(index=False):
        n_parts = int(parts) if known(parts) else n_parts
        pages = int(total) if known(total) else pages
        if stage == "queued":
            failed, converted, done = None, set(), {}
        if stage == "skipped":
            failed = None
        if stage == "failed" and failed is None:
            failed = int(seq)
        if stage == "converted":
            if known(part):
                converted.add(int(part))
            if len(converted) >= (n_parts or 0):
                last = stage
        elif known(stage):
            last = stage
        if known(pages_done):
            at = int(part) if known(part) else 0
            done[at] = max(done.get(at, 0), int(pages_done))
    state.update((last, failed, n_parts, pages, sorted(converted), done))
    stage = "failed" if failed is not None else last or "unknown"
    yield pd.DataFrame({"path": [key[0]], "stage": [stage], "failed_seq": [-1 if failed is None else failed], "pages": [-1 if pages is None else pages], "pages_done": [sum(done.values())]})


def stream_states(events: DataFrame) -> DataFrame:
    """Running state of every path of a stream, told anew whenever events of it arrive: see ``file_states``.

    The state of a path is a few numbers per part.  Events of a micro-batch are ordered by seq; a log is appended to in
    order, so no event comes in a later batch than one that follows it.
    """
    told = events.groupBy("path").applyInPandasWithState(_fold, _FOLDED, _STATE, "update", GroupStateTimeout.NoTimeout)
    return told.select("path", "stage", F.nullif("failed_seq", F.lit(-1)).alias("failed_seq"), F.nullif("pages", F.lit(-1)).alias("pages"), "pages_done")


def tail(spark: SparkSession, log: str, state: dict | None = None, most: int = 8 << 20) -> tuple[list[str], dict]:
    """New whole lines of an append-only file since ``state``, at most ``most`` bytes of them, and the state after.

    A line without its end is held back.  A file that became shorter, or whose head changed, is read from its start.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(log)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    state = state or {"offset": 0, "head": ""}
    if not fs.exists(path):
        return [], {"offset": 0, "head": ""}
    size = fs.getFileStatus(path).getLen()
    stream = fs.open(path)
    try:
        head = bytes(stream.readNBytes(min(size, 1024))).hex()
        offset = state["offset"] if size >= state["offset"] and head.startswith(state["head"]) else 0
        stream.seek(offset)
        data = bytes(stream.readNBytes(min(size - offset, most)))
    finally:
        stream.close()
    whole = data.rfind(b"\n") + 1
    return data[:whole].decode("utf-8", "replace").splitlines(), {"offset": offset + whole, "head": head}


def feed(spark: SparkSession, log: str, folder: str, state: dict | None = None) -> dict:
    """Moves what is new in ``log`` into ``folder`` as a file of its own, for ``read_log``; the state after."""
    lines, after = tail(spark, log, state)
    while lines:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_{after['offset']:015d}")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        stream = fs.create(path, True)
        stream.write("".join(f"{x}\n" for x in lines).encode("utf-8"))
        stream.close()
        # Sources don't see names with an underscore: a file appears when it is whole.
        fs.rename(path, spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{after['offset']:015d}-{len(lines)}.json"))
        lines, after = tail(spark, log, after)
    return after
