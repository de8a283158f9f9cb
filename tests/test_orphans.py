from datetime import datetime

from pyspark.sql import functions as F

from marginalia.functions.identifiers import chunk_key, chunk_manual_key, id_key
from marginalia.operators.orphans import Reference, Target, orphan_counts, orphan_rows
from marginalia.runtime import cut

A, B, G = "0f1e2d3c-0000-4000-8000-00000000000a", "0f1e2d3c-0000-4000-8000-00000000000b", "0f1e2d3c-0000-4000-8000-0000000000ff"


def day(n):
    return datetime(2024, 1 + n // 28, 1 + n % 28)


def test_spellings(spark):
    rows = [(A,), (A.upper(),), ("{" + A + "}\t",), (A.replace("-", ""),), ("   " + A,)]
    keys = spark.createDataFrame(rows, "r string").select(id_key(F.col("r"))).distinct().collect()
    assert [k[0] for k in keys] == [A.replace("-", "")]
    none = spark.createDataFrame([(None,), ("",), (" \t",), ("None",), (" NULL ",)], "r string")
    assert none.filter(id_key(F.col("r")).isNotNull()).count() == 0
    c = spark.createDataFrame([("{" + A.upper() + "}_7\t",), (A + "_7",)], "r string")
    assert {tuple(r) for r in c.select(chunk_key(F.col("r")), chunk_manual_key(F.col("r"))).collect()} == {(A.replace("-", "") + "_7", A.replace("-", ""))}


def _case(spark, refs):
    r = spark.createDataFrame(refs, "id string, ref string, at timestamp, key string")
    t = spark.createDataFrame([(A, day(10), "x"), (A, day(40), "x"), (B, None, "x")], "id string, at timestamp, key string")
    gone = spark.createDataFrame([("t", B, day(1)), ("t", A, day(39))], "target_table string, key string, removed_at timestamp")
    gone = gone.withColumn("key", id_key(F.col("key")))
    return [Reference("r", r, F.col("id"), "ref", "t", id_key(F.col("ref")), F.col("at"))], [Target("t", t, id_key(F.col("id")), F.col("at"))], gone


def test_reasons_heavy_and_light(spark):
    refs = [
        ("early", A, day(9), "k"), ("fine", A, day(10), "k"), ("undated", A, None, "k"), ("missing", G, day(3), "k"), ("removed", "{" + B + "}", day(3), "k"),
        ("none", None, day(3), "k"), ("blank", " ", day(3), "k"), ("twice", A, day(50), "k"), ("twice", A, day(5), "k"), (None, G, day(5), "k"),
    ]
    want = {("early", "early"), ("missing", "missing"), ("removed", "removed"), ("twice", "early")}
    for heavy, size in ((1, 1 << 20), (5000, 1 << 20), (1, 0), (5000, 0), (3, 250)):
        got = {(r.record_id, r.reason) for r in orphan_rows(*_case(spark, refs), cut, min_heavy=heavy, broadcast_bytes=size).collect()}
        assert got == want
        counts = {r.period: r.orphans for r in orphan_counts(*_case(spark, refs), cut, min_heavy=heavy, broadcast_bytes=size).collect()}
        assert counts == {"2024-01": 4}


def test_a_key_that_holds_most_references(spark):
    """One key holds 300,000 of 400,000 references: every way of joining gives the same counts, and rows to match."""
    n = spark.range(400_000)
    date = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 40)
    refs = n.select(F.col("id").cast("string").alias("id"), F.when(F.col("id") < 300_000, A).otherwise(F.md5(F.col("id").cast("string"))).alias("ref"), date.alias("at"), F.lit("x").alias("key"))
    known = spark.createDataFrame([(A,)], "id string").withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000 + 40 * 100_000)))
    gone = spark.createDataFrame([], "target_table string, key string, removed_at timestamp")
    args = [Reference("r", refs, F.col("id"), "ref", "t", id_key(F.col("ref")), F.col("at"))], [Target("t", known, id_key(F.col("id")), F.col("at"))], gone
    for heavy, size in ((100_000, 1 << 20), (10**9, 1 << 20), (1000, 0)):
        assert orphan_counts(*args, cut, min_heavy=heavy, broadcast_bytes=size).agg(F.sum("orphans")).first()[0] == 200_000
    rows = orphan_rows(*args, cut, broadcast_bytes=0).groupBy("reason").count().collect()
    assert {tuple(r) for r in rows} == {("early", 100_000), ("missing", 100_000)}


def test_empty(spark):
    args = _case(spark, [])
    assert orphan_rows(*args, cut).count() == 0 and orphan_counts(*args, cut).count() == 0
