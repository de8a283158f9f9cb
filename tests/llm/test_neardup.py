import random

import numpy as np
import pytest

from marginalia.llm import neardup as N
from marginalia.llm import shingles as S
from marginalia.runtime import cut

SCHEMA = "id string, text string, cls string, bucket int"


def sets_of(text, how):
    flat, _ = S.word_shingles([text], how.words, how.least, S.WordHashes())
    return set(flat.tolist())


def corpus(seed, n=40):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        base = [rnd.choice(words) for _ in range(rnd.randint(20, 120))]
        rows.append((f"d{i:03d}", " ".join(base)))
        for e in range(rnd.randint(0, 4)):
            edited = list(base)
            for _ in range(rnd.randint(0, 4)):
                edited[rnd.randrange(len(edited))] = rnd.choice(words)
            rows.append((f"d{i:03d}-{e}", " ".join(edited)))
    return rows


def brute(rows, how):
    sets = {i: sets_of(t, how) for i, t in rows if t}
    ids = sorted(i for i in sets if sets[i])
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) >= how.threshold * len(sets[a] | sets[b])}


@pytest.mark.parametrize("seed,hot,block", [(1, 500, 50_000), (2, 1, 50_000), (3, 2, 50_000), (4, 1, 7), (5, 2, 1000)])
def test_pairs_equal_brute_force(spark, seed, hot, block):
    """hot=1 sends every bucket through the exact prefix filter; small blocks thin buckets before the shuffle."""
    how = N.Likeness(threshold=0.7, words=3, least=20, hot=hot, block=block)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)
    got = {tuple(r) for r in N.similar_records(df, how, cut).collect()}
    assert got == brute(rows, how)


def test_nulls_copies_and_hot_classes(spark):
    how = N.Likeness(threshold=0.8, words=5, spelled_out=3)
    same = " ".join(f"a{i}" for i in range(30))
    rows = [(f"c{i}", same) for i in range(5)] + [("n", None), ("e", ""), ("s", "too short"), (None, same), ("c0", same), ("z", same + " b")]
    df = spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA)
    got = {tuple(r) for r in N.similar_records(df, how, cut).collect()}
    assert got == {("c0", f"c{i}") for i in range(1, 5)} | {("c0", "z")}
    g = {r.id: (r.group_id, r.links, r.copies) for r in N.groups(df, how, cut).collect()}
    assert g == {**{f"c{i}": ("c0", 1, 4) for i in range(5)}, "z": ("c0", 1, 0)}
    empty = spark.createDataFrame([], SCHEMA)
    assert N.similar_records(empty, how, cut).count() == 0 and N.groups(empty, how, cut).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 2**63, 100, dtype=np.uint64)])
    flat = np.concatenate([a, b])
    sig = S.signatures(flat, np.array([0, 400]), 336)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.09


def test_words():
    assert S.WORD.findall("カナ漢字 abc-1 x_y") == ["カ", "ナ", "漢", "字", "abc", "1", "x", "y"]
    long = "word " * 200_000
    flat, owner = S.word_shingles([long, "a b c d"], 3, 3, S.WordHashes())
    assert (owner == 0).sum() == 1 and (owner == 1).sum() == 2


def test_a_crowded_bucket_never_meets_in_one_task(spark):
    """A third of all classes shares much boilerplate: no task gets more of a bucket than its blocks let through."""
    rnd = random.Random(6)
    notice = [f"n{i}" for i in range(60)]
    rows = [(f"h{i:04d}", " ".join(notice + [f"own{i}x{k}" for k in range(18)])) for i in range(400)]
    rows += [(f"o{i:04d}", " ".join(rnd.choice("abcdefghij") + str(rnd.randrange(900)) for _ in range(40))) for i in range(800)]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)
    how = N.Likeness(threshold=0.7, words=3, least=20, hot=20, block=600)
    sketched = N.sketches(df, how, "bands").coalesce(1)
    thinned = sketched.select("cls", "n", "bands").mapInArrow(N._thinned(how), "bucket bigint, cls bigint, n int")
    largest = thinned.filter("bucket is not null").groupBy("bucket").count().agg({"count": "max"}).first()[0]
    assert largest <= 2 * (how.hot + 1) < thinned.filter("bucket is null").count()
    got = {tuple(r) for r in N.similar_records(df, how, cut).collect()}
    assert got == brute(rows, how)


def test_forty_copies_equal_the_sql(spark, tmp_path):
    import duckdb

    from marginalia.llm import queries as Q

    text = " ".join(f"a{i}" for i in range(30))
    chunks = [(f"m_{i:02d}", text) for i in range(40)] + [("m_x", text + " more"), ("m_y", "other " * 25), ("m_z", None)]
    spark.createDataFrame(chunks, "id string, document string").write.parquet(str(tmp_path / "chunks.parquet"))
    spark.createDataFrame([("k", "A/b.pdf"), ("l", "a\\b.pdf"), ("n", None)], "id string, relative_path string").write.parquet(str(tmp_path / "manuals.parquet"))
    con = duckdb.connect()
    for t in ("chunks", "manuals"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = {tuple(r) for r in Q.p2_found(spark, str(tmp_path)).collect()}
    assert got == set(con.execute(Q.SQL["p2_found"]).fetchall())
    assert got == {("chunks", "m_00", f"m_{i:02d}") for i in range(1, 40)} | {("chunks", "m_00", "m_x"), ("manuals", "k", "l")}
    groups = Q.p2_groups(spark, str(tmp_path))
    assert {tuple(r) for r in groups.select("id", "group_id", "links", "copies").collect()} == set(con.execute(Q.SQL["p2_groups"]).fetchall())
