import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators import ordered as R

COLS = "k string, pos int, tie string, v string, n int, _x int"


def rows(seed, n=120):
    rnd = random.Random(seed)
    return [(rnd.choice(["a", "a", "a", "b", None]), rnd.choice([None, *range(-20, 40)]), f"t{i:03d}", rnd.choice([None, None, "x", "y", "z"]), rnd.choice([0, 1, 5]), 0) for i in range(n)]


def sequences(data):
    out = {}
    for r in sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("size", [1, 7, 4096])
def test_blocks_equal_whole_windows(spark, size):
    data = rows(size)
    df = spark.createDataFrame(data, COLS)
    total, place, carried, run = {}, {}, {}, {}
    for seq in sequences(data).values():
        s, last, before, turns = 0, None, None, 0
        for i, r in enumerate(seq):
            total[r[2]], place[r[2]] = s, i
            s += r[4]
            last = carried[r[2]] = r[3] if r[3] is not None else last
            turns += i > 0 and (r[3], r[4]) != before
            before, run[r[2]] = (r[3], r[4]), turns
    get = lambda out, c: {r.tie: r[c] for r in out.collect()}
    assert get(R.running_sum(df, F.col("n"), ["k"], "pos", ["tie"], "s", size), "s") == total
    assert get(R.numbered(df, ["k"], "pos", ["tie"], "i", size), "i") == place
    assert get(R.carry_forward(df, "v", ["k"], "pos", ["tie"], "c", size), "c") == carried
    assert get(R.runs(df, ["v", "n"], ["k"], "pos", ["tie"], "r", size), "r") == run
    empty = df.filter("false")
    assert R.runs(empty, ["v"], ["k"], "pos", ["tie"]).count() == 0 and R.carry_forward(empty, "v", ["k"], "pos", ["tie"]).count() == 0
    assert R.numbered(df, ["k"], "pos", ["tie"], "i").columns == [*df.columns, "i"]
