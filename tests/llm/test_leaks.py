import random

import pytest

from marginalia.llm import leaks as L

SCHEMA = "id bigint, text string, item_id string, hash int"


def texts(seed):
    rnd = random.Random(seed)
    letter = lambda n: "".join(rnd.choice("abcdefgh ,.") for _ in range(n))
    items = [(i, letter(rnd.randint(60, 200))) for i in range(8)] + [(90, None), (91, ""), (92, "short"), (0, None)]
    docs = []
    for d in range(60):
        i, t = items[rnd.randrange(8)]
        a = rnd.randint(0, 20)
        part = t[a : a + rnd.randint(30, 90)]
        if d % 3 == 0:
            part = part.upper().replace(" ", "  \n")
        docs.append((d, letter(rnd.randint(0, 300)) + part + letter(rnd.randint(0, 300))))
    return docs + [(900, None), (901, ""), (902, " \n")], items


def brute(docs, items, run):
    norm = {i: L.letters(t) for i, t in items if t}
    out = set()
    for d, t in docs:
        x = L.letters(t) if t else ""
        grams = {x[k : k + run] for k in range(len(x) - run + 1)}
        out |= {(d, i) for i, y in norm.items() if any(y[k : k + run] in grams for k in range(len(y) - run + 1))}
    return out


@pytest.mark.parametrize("bound", [2_000_000, 0])
def test_exact_runs_equal_brute_force(spark, bound):
    """bound=0 takes the shuffled join instead of the broadcast one."""
    docs, items = texts(3)
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], SCHEMA)
    i = spark.createDataFrame([(*r, "x", 1) for r in items], SCHEMA)
    how = L.Seeds(broadcast_windows=bound)
    got = {(r.doc_id, r.item_id) for r in L.leaks(d, i, how).filter("exact_chars >= 40").collect()}
    assert got == brute(docs, items, 40)
    assert L.leaks(d.filter("false"), i, how).count() == 0 and L.leaks(d, i.filter("false"), how).count() == 0


def test_substitutions_are_tolerated(spark):
    rnd = random.Random(5)
    item = "".join(rnd.choice("abcdefghijklmnop") for _ in range(160))
    broken = list(item)
    for k in range(15, 160, 30):
        broken[k] = "z"
    d = spark.createDataFrame([(1, "q" * 50 + "".join(broken) + "q" * 50, "", 0)], SCHEMA)
    i = spark.createDataFrame([(7, item, "", 0)], SCHEMA)
    r = L.leaks(d, i).first()
    assert (r.doc_id, r.item_id) == (1, 7) and r.exact_chars < 40 and r.near_chars >= 140


def test_letters():
    assert L.letters("Ａ-b ①②_ﬁ\n") == "ab12fi"


def near_brute(docs, items, how):
    """The longest stretch with the share on any diagonal, by trying all of them."""
    out = {}
    for d, x in docs:
        for i, y in items:
            best = 0
            for k in range(-len(x) + 1, len(y)):
                lo, hi = max(0, -k), min(len(x), len(y) - k)
                sums = [0]
                for p in range(lo, hi):
                    sums.append(sums[-1] + (x[p] == y[p + k]))
                if sums[-1] < how.similar * how.near_run - 1e-9:
                    continue
                for n in range(hi - lo, max(best, how.near_run - 1), -1):
                    if any(sums[s + n] - sums[s] >= how.similar * n - 1e-9 for s in range(hi - lo - n + 1)):
                        best = n
                        break
            if best:
                out[d, i] = best
    return out


@pytest.mark.parametrize("bound", [2_000_000, 0])
def test_near_overlaps_equal_brute_force(spark, bound):
    """Overlaps of 60 to 100 characters with up to a tenth substituted, anywhere: none may be missed."""
    rnd = random.Random(11)
    word = lambda n: "".join(rnd.choice("abcdefghijklmnop") for _ in range(n))
    items = [(i, word(rnd.randint(60, 130))) for i in range(6)]
    docs = []
    for d in range(60):
        t = list(items[d % 6][1])
        n = min(rnd.choice([60, 60, 70, 80, 100]), len(t))
        a = rnd.randint(0, len(t) - n)
        part = t[a : a + n]
        for k in rnd.sample(range(n), n // 10) if d % 2 else range(4, 10 * (n // 10), 10):
            part[k] = "z"
        docs.append((d, word(rnd.randint(0, 60)) + "".join(part) + word(rnd.randint(0, 60))))
    # A short common run on the same diagonal, before the overlap proper.
    y = items[0][1]
    docs.append((99, y[:30] + "z" * 8 + y[38:]))
    how = L.Seeds(broadcast_windows=bound)
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], SCHEMA)
    i = spark.createDataFrame([(*r, "x", 1) for r in items], SCHEMA)
    got = {(r.doc_id, r.item_id): r.near_chars for r in L.leaks(d, i, how).filter("near_chars >= 60").collect()}
    assert got == near_brute(docs, items, how) and len(got) >= 60


def test_masks_hit_every_overlap():
    """Every placing of whole blocks that the worst overlap allows has two within reach of a mask."""
    how = L.Seeds()
    assert how.step == 6 and [len(m) for m in how.masks] == [12, 18, 24, 30]
    rnd = random.Random(2)
    for _ in range(3000):
        n, shift = rnd.randint(60, 119), rnd.randrange(how.step)
        wrong = set(rnd.sample(range(n), n // 10))
        whole = [s for s in range(shift, n - how.step + 1, how.step) if not wrong & set(range(s, s + how.step))]
        assert any(b - a <= how.step * len(how.masks) for a, b in zip(whole, whole[1:]))


@pytest.mark.parametrize("bound", [2_000_000, 0])
def test_an_item_id_with_two_texts(spark, bound):
    """Each of an id's texts counts; items too short for a mask match nothing and never travel."""
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("abcdefghijklmnop") for _ in range(n))
    a, b = word(80), word(90)
    docs = [(1, word(30) + a + word(9), "", 0), (2, word(7) + b, "", 0), (3, "abc", "", 0)]
    items = [(5, a, "", 0), (5, b, "", 0), (6, "abc", "", 0), (7, None, "", 0), (8, "  ", "", 0)]
    got = L.leaks(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, SCHEMA), L.Seeds(broadcast_windows=bound)).collect()
    assert {(r.doc_id, r.item_id, r.exact_chars) for r in got} == {(1, 5, 80), (2, 5, 90)}
