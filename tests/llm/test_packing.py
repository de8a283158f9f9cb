import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import packing as P
from marginalia.runtime import cut

#: As many containers to a shard as in production: shards of a few items can't be filled well by any method.
HOW = P.Packing(capacity=128, shard_tokens=128 * 146)
pytestmark = pytest.mark.skipif(not os.path.exists(os.path.join(HOW.tokenizers, HOW.vocabulary)), reason="no vocabulary files")


def test_round_trip_and_fill(spark):
    rnd = random.Random(1)
    words = "valve rotor flange encoder queue lever ledger shaft".split()
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 90)))) for i in range(1500)]
    docs += [(9000, None), (9001, ""), (9002, "very long " * 300), (9003, "   ")]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "id bigint, text string, part string")
    got = P.pack(df, cut, HOW).collect()
    enc = P.encoder(HOW)
    want = {i: len(P.token_ids(t or "", enc)) for i, t in docs}
    have, boxes = dict.fromkeys(want, 0), {}
    for r in got:
        have[r.id] += r.tokens
        assert (r.container_id is None) == (r.tokens == 0)
        if r.container_id is not None:
            boxes[r.container_id] = boxes.get(r.container_id, 0) + r.tokens
            assert r.n_parts == max(1, -(-want[r.id] // HOW.capacity))
    assert have == want and max(boxes.values()) <= HOW.capacity
    assert sum(boxes.values()) / (len(boxes) * HOW.capacity) > 0.97
    assert all(boxes[r.container_id] == r.container_tokens for r in got if r.container_id)
    assert len({(r.id, r.part) for r in got}) == len(got)


def test_neighbours_first():
    idf = np.ones(1 << 16)
    a, b = np.arange(10, 50, dtype=np.uint16), np.arange(100, 140, dtype=np.uint16)
    terms = [a, b, a[:30], b[:30], a[:20], b[:20]]
    got = P.fill(np.array([len(t) for t in terms]), terms, idf, 30.0, P.Packing(capacity=90))
    assert sorted(map(sorted, got)) == [[0, 2, 4], [1, 3, 5]]


def test_empty(spark):
    assert P.pack(spark.createDataFrame([], "id bigint, text string"), cut, HOW).count() == 0


def test_long_texts_have_the_tokens_of_the_whole():
    enc = P.encoder(HOW)
    rnd = random.Random(3)
    long = "".join(rnd.choice(["word", " ", "  ", "\n", "\n\n", "12", "'s", "日本", ".", "\t", " -", "\u00a0", "é"]) for _ in range(130_000))
    assert len(long) > P._RUN and P.token_ids(long, enc) == enc.encode_ordinary(long)
    assert P.token_ids("x" * 1000 + " ", enc) == enc.encode_ordinary("x" * 1000 + " ")
    assert len(P.token_ids("word " * 100_000, enc)) == pytest.approx(100_000, rel=0.01)


def test_a_crowd_of_copies_is_split(spark):
    """Most texts are the same: ranges split inside the crowd, and no shard takes more than its share."""
    df = spark.createDataFrame([(i, "the same short text of a notice" if i % 3 else f"other {i} words") for i in range(3000)], "id bigint, text string")
    how = P.Packing(capacity=128, shard_tokens=2000)
    got = P.pack(df, cut, how)
    assert got.count() == 3000 and got.filter("container_tokens > 128").count() == 0
    shards = got.filter("container_id like 'r0%'").groupBy(F.regexp_extract("container_id", "^(r0-[0-9]+-[0-9]+)-", 1).alias("shard")).agg(F.sum("tokens").alias("t"))
    assert shards.count() >= 5 and shards.agg(F.max("t")).first()[0] <= 3000


def test_alike_items_share_shards(spark):
    """Three kinds of text in turn: where the ranges of one term fill shards, these hold one kind each, but for the borders."""
    kinds = ["valve rotor flange encoder", "ledger account invoice balance", "galaxy nebula quasar comet"]
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choice(kinds[i % 3].split()) for _ in range(rnd.randint(5, 40)))) for i in range(1800)]
    got = P.pack(spark.createDataFrame(rows, "id bigint, text string"), cut, P.Packing(capacity=128, shard_tokens=1000)).filter("container_id like 'r0%'")
    shard = F.regexp_extract("container_id", "^(r0-[0-9]+-[0-9]+)-", 1).alias("shard")
    counts = got.groupBy(shard, (F.col("id") % 3).alias("kind")).count().groupBy("shard").agg(F.sum("count").alias("n"), F.max("count").alias("main")).collect()
    assert len(counts) >= 8 and sum(r.main for r in counts) / sum(r.n for r in counts) > 0.9
