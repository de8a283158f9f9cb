"""The event table read as a build's event log, each query with its SQL counterpart."""

from __future__ import annotations


import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators import library as L
from marginalia.runtime import checkpoint_dir, table
from marginalia.streaming import progress as P

c = F.col
QUERIES: dict = {}
SQL: dict[str, str] = {}
#: How the event table's types are read as stages.
READ_AS = {"signup": "queued", "view": "converting", "click": "converted", "purchase": "done", "error": "failed"}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def events(s, d) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    stage = F.coalesce(*[F.when(c("event_type") == a, b) for a, b in READ_AS.items()], F.lit("unknown"))
    return table(s, d, "events").select(
        c("event_id").alias("seq"), c("ts"), F.concat(F.lit("user/"), c("user_id").cast("string")).alias("path"), stage.alias("stage"), (k % 4).alias("part"), F.lit(4).alias("parts"), F.lit(120).alias("pages"),
        F.when(stage == "converting", k).alias("pages_done"), F.when(stage == "failed", F.concat(F.lit("error "), k.cast("string"))).alias("error"), c("value"), c("user_id"),
    )


_CASE = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in READ_AS.items()) + " END"
E = f"""e AS (SELECT event_id AS seq, ts, 'user/' || user_id AS path, {_CASE} AS stage, (json_extract_string(props, '$.k')::INT % 4) AS part, value, user_id,
  CASE WHEN event_type = 'view' THEN json_extract_string(props, '$.k')::INT END AS pages_done FROM events),
q AS (SELECT path, coalesce(max(seq) FILTER (stage = 'queued'), -1) AS q FROM e GROUP BY 1),
cv AS (SELECT path, part, min(seq) AS f FROM e JOIN q USING (path) WHERE stage = 'converted' AND seq > q GROUP BY 1, 2),
op AS (SELECT q.path, q, coalesce(list_sort(list(f) FILTER (f IS NOT NULL))[4], 4611686018427387904) AS o FROM q LEFT JOIN cv USING (path) GROUP BY 1, 2),
l AS (SELECT path, arg_max(stage, seq) AS last, min(seq) FILTER (stage = 'failed') AS failed_seq FROM e JOIN op USING (path) WHERE seq >= q AND (stage <> 'converted' OR seq >= o) GROUP BY 1),
pp AS (SELECT path, part, max(pages_done) AS pages_done FROM e JOIN q USING (path) WHERE pages_done IS NOT NULL AND seq > q GROUP BY 1, 2),
st AS (SELECT op.path, CASE WHEN failed_seq IS NOT NULL THEN 'failed' ELSE coalesce(last, 'unknown') END AS stage, failed_seq, 120 AS pages, coalesce((SELECT sum(pages_done) FROM pp WHERE pp.path = op.path), 0)::BIGINT AS pages_done
  FROM op LEFT JOIN l USING (path))"""


@query(f"WITH {E} SELECT * FROM st")
def file_state(s, d):
    return P.file_states(events(s, d))


@query(f"WITH {E} SELECT * FROM pp")
def part_pages(s, d):
    return P.part_pages(events(s, d))


@query(f"WITH {E} SELECT s.stage, (SELECT count(*) FROM st WHERE st.stage = s.stage) AS files FROM (SELECT unnest({P.STAGES}) AS stage) s")
def stage_counts(s, d):
    return P.stage_counts(file_state(s, d))


@query(f"WITH {E} SELECT sum(CASE WHEN stage IN ('done', 'converted', 'ingesting') THEN pages WHEN stage = 'converting' THEN least(pages_done, pages) ELSE 0 END)::BIGINT AS done, sum(CASE WHEN stage <> 'skipped' THEN pages ELSE 0 END)::BIGINT AS total FROM st")
def pages_progress(s, d):
    done = F.when(c("stage").isin("done", "converted", "ingesting"), c("pages")).when(c("stage") == "converting", F.least("pages_done", "pages")).otherwise(0)
    return file_state(s, d).agg(F.sum(done).alias("done"), F.sum(F.when(c("stage") != "skipped", c("pages")).otherwise(0)).alias("total"))


@query(f"WITH {E} SELECT path, CASE WHEN pages_done > 0 THEN round(least(1.0, pages_done / 120.0), 6) END AS fraction FROM st")
def fraction(s, d):
    return file_state(s, d).select("path", F.when(c("pages_done") > 0, F.round(F.least(F.lit(1.0), c("pages_done") / 120.0), 6)).alias("fraction"))


@query(f"WITH {E} SELECT path, repeat('█', floor(least(1.0, pages_done / 120.0) * 20)::INT) || repeat('░', 20 - floor(least(1.0, pages_done / 120.0) * 20)::INT) AS bar FROM st")
def progress_bar(s, d):
    full = F.floor(F.least(F.lit(1.0), c("pages_done") / 120.0) * 20).cast("int")
    return file_state(s, d).select("path", F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(20) - full)).alias("bar"))


@query(f"WITH {E} SELECT path, stage FROM st WHERE stage NOT IN ('done', 'failed', 'skipped')")
def stage_filter(s, d):
    """Files that are not finished."""
    return file_state(s, d).filter(~c("stage").isin("done", "failed", "skipped")).select("path", "stage")


@query(f"WITH {E} SELECT count(*) AS found, count(*) FILTER (stage = 'done') AS converted, count(*) FILTER (stage = 'failed') AS failed, count(*) FILTER (stage = 'skipped') AS skipped FROM st")
def build_summary(s, d):
    n = lambda x: F.count_if(c("stage") == x).alias({"done": "converted"}.get(x, x))
    return file_state(s, d).agg(F.count(F.lit(1)).alias("found"), n("done"), n("failed"), n("skipped"))


@query(
    f"WITH {E}, r AS (SELECT min(ts) FILTER (stage = 'converting') AS started, sum(pages_done) / (epoch_us(max(ts)) - epoch_us(min(ts) FILTER (stage = 'converting'))) * 6e7 AS rate FROM e), "
    "left_ AS (SELECT sum(greatest(pages - pages_done, 0)) FILTER (stage NOT IN ('done', 'failed', 'skipped')) AS pages_left FROM st) "
    "SELECT started, round(rate, 6) AS pages_per_minute, coalesce(pages_left, 0)::BIGINT AS pages_left, CASE WHEN rate > 0 THEN round(coalesce(pages_left, 0) / rate, 4) END AS minutes_left FROM r, left_"
)
def throughput(s, d):
    """Earliest conversion, pages a minute since, pages of the files that aren't finished, and the minutes they will take."""
    began = F.min(F.when(c("stage") == "converting", c("ts")))
    micros = F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(began.cast("timestamp"))
    rate = events(s, d).agg(began.alias("started"), (F.sum("pages_done") / micros * 6e7).alias("rate"))
    open_ = file_state(s, d).filter(~c("stage").isin("done", "failed", "skipped"))
    left = open_.agg(F.coalesce(F.sum(F.greatest(c("pages") - c("pages_done"), F.lit(0))), F.lit(0)).cast("bigint").alias("pages_left"))
    # One row each.
    both = rate.crossJoin(F.broadcast(left))
    return both.select("started", F.round("rate", 6).alias("pages_per_minute"), "pages_left", F.when(c("rate") > 0, F.round(c("pages_left") / c("rate"), 4)).alias("minutes_left"))


@query(f"WITH {E} SELECT user_id % 8 AS owner, arg_max(path, seq) AS path, max(seq) AS since FROM e GROUP BY 1 HAVING arg_max(stage, seq) NOT IN ('done', 'failed')")
def active_slots(s, d):
    """The last event per worker, unless it ended the worker's job."""
    g = events(s, d).groupBy((c("user_id") % 8).alias("owner")).agg(F.max_by("path", "seq").alias("path"), F.max("seq").alias("since"), F.max_by("stage", "seq").alias("last"))
    return g.filter(~c("last").isin("done", "failed")).drop("last")


@query(f"WITH {E} SELECT arg_min(path, seq) AS first_path, arg_max(path, seq) AS last_path, count(DISTINCT path) AS files, count(*) AS events FROM e")
def run_meta(s, d):
    return events(s, d).agg(F.min_by("path", "seq").alias("first_path"), F.max_by("path", "seq").alias("last_path"), F.count_distinct("path").alias("files"), F.count(F.lit(1)).alias("events"))


@query(f"WITH {E}, z AS (SELECT max(ts) AS now FROM e) SELECT path, epoch_us((SELECT now FROM z)) - epoch_us(max(ts)) > 900000000 AND arg_max(stage, seq) <> 'done' AS stalled FROM e GROUP BY path")
def stalled(s, d):
    """Files without an event in the 900 seconds before the log's end."""
    e = events(s, d)
    last = e.groupBy("path").agg(F.max("ts").alias("ts"), F.max_by("stage", "seq").alias("stage"))
    now = last.agg(F.max("ts").alias("now"))
    late = F.unix_micros(c("now").cast("timestamp")) - F.unix_micros(c("ts").cast("timestamp")) > int(P.STALE_AFTER * 1e6)
    return last.crossJoin(F.broadcast(now)).select("path", (late & (c("stage") != "done")).alias("stalled"))


@query(f"WITH {E} SELECT seq, CASE WHEN stage IN ('converting', 'converted') THEN printf('%d:%02d', floor(value)::BIGINT // 60, floor(value)::BIGINT % 60) ELSE '' END AS elapsed FROM e")
def file_elapsed(s, d):
    timed = F.when(c("stage").isin("converting", "converted"), c("value"))
    return events(s, d).select("seq", L.format_duration(timed).alias("elapsed"))


@query("SELECT id, CASE WHEN p IS NULL THEN '' ELSE format('{:,}', p::BIGINT) || '-' || format('{:,}', (p * 7)::BIGINT) END AS label FROM (SELECT DISTINCT id, page_count AS p FROM manuals)")
def page_range_label(s, d):
    p = table(s, d, "manuals").select("id", c("page_count").alias("p")).distinct()
    return p.select("id", F.when(c("p").isNull(), "").otherwise(F.concat(F.format_number("p", 0), F.lit("-"), F.format_number(c("p") * 7, 0))).alias("label"))


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events WHERE event_id % 5 <> 0")
def parse_events(s, d):
    """JSON lines to events; here a fifth of the lines is cut off in the middle, and those are dropped."""
    line = F.to_json(F.struct(c("event_id").cast("double").alias("ts"), F.get_json_object("props", "$.k").cast("int").alias("pages_done")))
    raw = table(s, d, "events").select(F.when(c("event_id") % 5 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value"))
    return P.parse(raw).select(c("ts").cast("bigint").alias("event_id"), c("pages_done").alias("k"))


@query("SELECT doc_id, CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || '...' ELSE text END AS error FROM documents")
def sanitize_events(s, d):
    return table(s, d, "documents").select("doc_id", P.sanitize(c("text")).alias("error"))


@query(f"WITH {E} SELECT path, part, max(pages_done) AS pages_done FROM e WHERE pages_done IS NOT NULL GROUP BY 1, 2")
def stream_progress(s, d):
    """The log written as files and read back as a stream, to its end: the running page counts."""
    base = os.path.join(checkpoint_dir(s), "stream", s.sparkContext.applicationId, os.urandom(6).hex())
    rows = events(s, d).select(c("seq").cast("double").alias("ts"), F.lit("page").alias("event"), "path", "stage", "part", "parts", "pages", "pages_done", "error")
    rows.write.json(f"{base}/log")
    name = f"pages_{os.urandom(6).hex()}"
    sink = P.stream_pages(P.read_log(s, f"{base}/log"))

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/{name}")

    run = sink.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    run.awaitTermination()
    return s.read.parquet(f"{base}/{name}")


@query(f"WITH {E} SELECT path, stage, failed_seq, pages, pages_done FROM st")
def stream_states(s, d):
    """The log written in three portions, each folded by the stream into the states that the ones before it left."""
    base = os.path.join(checkpoint_dir(s), "stream", s.sparkContext.applicationId, os.urandom(6).hex())
    rows = events(s, d).select("seq", c("seq").cast("double").alias("ts"), F.lit("file").alias("event"), "path", "stage", "part", "parts", "pages", "pages_done", "error")
    last = rows.agg(F.max("seq")).first()[0] or 0
    out = os.path.join(base, "states")
    for k in range(3):
        rows.filter((c("seq") > last * k // 3 if k else F.lit(True)) & (c("seq") <= last * (k + 1) // 3)).write.mode("append").json(f"{base}/log")

        def keep(batch: DataFrame, n: int, k: int = k) -> None:
            batch.withColumn("at", F.lit(k * 1_000_000 + n)).write.mode("append").parquet(out)

        folded = P.stream_states(P.read_log(s, f"{base}/log"))
        folded.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    told = s.read.parquet(out)
    return L.latest(told, "path", "at").select("path", "stage", "failed_seq", "pages", "pages_done")


@query("SELECT DISTINCT id, length(document) AS n_chars FROM chunks")
def read_chunks_jsonl(s, d):
    """Chunks written as JSON lines (gzip) and read back."""
    base = os.path.join(checkpoint_dir(s), "jsonl", os.urandom(6).hex())
    table(s, d, "chunks").select("id", "document").distinct().write.option("compression", "gzip").json(base)
    return s.read.schema("id string, document string").json(base).select("id", F.length("document").alias("n_chars"))



