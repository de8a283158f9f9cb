import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators import hierarchy as H
from marginalia.runtime import cut

SCHEMA = "node string, id string, parent string, grp string, ordering bigint, level bigint"


def brute(rows):
    by = {r[0]: r for r in rows}
    out = {}
    for r in rows:
        path, at = [], r[0]
        while at in by and at not in path:
            path.append(at)
            at = by[at][2]
        if at is None:
            out[r[0]] = ("root", path[-1], len(path), path[::-1])
        elif at not in by:
            out[r[0]] = ("cut", path[-1], len(path), path[::-1])
        else:
            out[r[0]] = ("loop", min(path[path.index(at) :]), None, None)
    return out


def forest(seed, n=60):
    rnd = random.Random(seed)
    ids = [f"n{i:03d}" for i in range(n)]
    rows = []
    for i, x in enumerate(ids):
        roll = rnd.random()
        parent = None if roll < 0.1 else "gone" if roll < 0.15 else rnd.choice(ids) if roll < 0.3 else ids[max(0, i - rnd.randint(0, 2))]
        rows.append((x, x, parent, f"g{i // 20}", i, rnd.choice([1, 2, 3, None])))
    return rows


@pytest.mark.parametrize("seed,local_rows,block", [(1, 1000, 4096), (2, 7, 4), (3, 3, 1), (4, 1, 1)])
def test_against_walk(spark, seed, local_rows, block):
    rows = forest(seed)
    nodes = spark.createDataFrame(rows, SCHEMA)
    answer = H.solve(H.edge_rows(nodes, True), cut, local_rows=local_rows, block=block)
    got = {r.node: (r.kind, r.ref, r.total if r.kind != "loop" else None, list(r.path) if r.kind != "loop" else None) for r in answer.collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("local_rows", [1000, 5])
def test_descendants_are_counted_upwards(spark, local_rows):
    for seed in (11, 12):
        rows = forest(seed, 80)
        want = brute(rows)
        below = {r[0]: sum(w[3] is not None and r[0] in w[3] for w in want.values()) - 1 for r in rows if want[r[0]][0] != "loop"}
        got = H.hierarchy(spark.createDataFrame(rows, SCHEMA), cut, local_rows=local_rows, block=2).collect()
        assert {r.id: r.n_descendants for r in got if r.kind != "loop"} == below


def test_deep_chains_without_group(spark):
    """No locality at all: a long chain, a loop, and their rows spread everywhere; rounds end by mating."""
    rows = [(f"d{i:04d}", f"d{i:04d}", f"d{i - 1:04d}" if i else None, None, None, i + 1) for i in range(400)]
    rows += [(f"l{i:03d}", f"l{i:03d}", f"l{(i + 1) % 90:03d}", None, 7, 1) for i in range(90)]
    nodes = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {tuple(r) for r in H.unsound(nodes, cut, local_rows=60, block=1).collect()}
    assert got == {(f"l{i:03d}", "loop", "l000") for i in range(90)}
    h = {r.id: r for r in H.hierarchy(nodes, cut, local_rows=60, block=1).collect()}
    assert all((h[f"d{i:04d}"].depth, h[f"d{i:04d}"].n_descendants, len(h[f"d{i:04d}"].path)) == (i + 1, 399 - i, i + 1) for i in range(400))


def test_many_rows_without_group_stay_in_bounds(spark, monkeypatch):
    """300,000 rows without manual id and a chain 20,000 deep: no piece holds more than its bound and one batch."""
    n = spark.range(320_000)
    key = lambda c: F.concat(F.lit("n"), F.lpad(c.cast("string"), 7, "0"))
    chain = F.when(F.col("id") == 0, None).when(F.col("id") < 20_000, key(F.col("id") - 1)).otherwise(key(F.pmod(F.xxhash64("id"), F.lit(20_000))))
    level = F.when(F.col("id") < 20_000, F.col("id") + 1).otherwise(F.pmod(F.xxhash64("id"), F.lit(20_000)) + 2)
    nodes = n.select(key(F.col("id")).alias("node"), key(F.col("id")).alias("id"), chain.alias("parent"), F.lit(None).cast("string").alias("grp"), F.lit(3).cast("bigint").alias("ordering"), level.alias("level"))
    first = H.contracted(H.edge_rows(nodes, False), cut, local_rows=25_000)[0][0]
    assert first.groupBy("piece").count().agg(F.max("count")).first()[0] <= 25_000 + 10_000
    assert H.unsound(nodes, cut, local_rows=25_000).count() == 0


def test_unsound_and_hierarchy(spark):
    rows = [
        ("a", "a", None, "m", 0, 1), ("b", "b", "a", "m", 1, 2), ("c", "c", "b", "m", 1, 9), ("d", "d", "x", "m", 4, 1), ("e", "e", "e", "m", 5, 1), ("f", "f", "e", "m", 6, 1),
        ("g", "g", "a", "other", -1, 2), ("h", "h", None, None, None, None),
    ]
    for local in (100, 1):
        nodes = spark.createDataFrame(rows, SCHEMA)
        got = {tuple(r) for r in H.unsound(nodes, cut, local_rows=local, block=1).collect()}
        assert got == {("c", "depth", "a"), ("c", "order", "b"), ("d", "cut", "d"), ("e", "loop", "e"), ("f", "loop", "e"), ("h", "depth", "h")}
    h = {r.id: r for r in H.hierarchy(nodes, cut).collect()}
    assert (h["c"].path, h["c"].depth, h["c"].root_id, h["a"].n_descendants) == (["a", "b", "c"], 3, "a", 3)
    assert (h["e"].path, h["e"].loop_id, h["e"].root_id) == (None, "e", None)
    assert {tuple(r) for r in H.descendants(nodes, cut).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("a", "g", 1)}


def test_empty_and_repeated(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert H.unsound(empty, cut).count() == 0 and H.hierarchy(empty, cut).count() == 0
    raw = spark.createDataFrame([("a", None, 1), ("a", None, 1), (None, "a", 2)], "i string, p string, l int").withColumn("node", F.lit("clash"))
    nodes = H.nodes_of(raw, F.col("i"), F.col("i"), F.col("p"), F.lit("g"), F.lit(0), F.col("l"))
    assert nodes.count() == 1
