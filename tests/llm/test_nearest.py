import numpy as np
import pytest

from marginalia.llm import nearest as K
from marginalia.runtime import cut

SCHEMA = "id string, embedding array<float>, query boolean, cls string, file int"


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 8, dim))
    x = centres[rng.integers(0, len(centres), n)] + 0.15 * rng.normal(size=(n, dim))
    return x.astype(np.float32)


def brute(x, k):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return np.argsort(-s, axis=1, kind="stable")[:, :k], s


@pytest.mark.parametrize("file_rows", [4096, 20])
def test_recall_and_blocks(spark, file_rows):
    x = clustered(600, 16, 1)
    rows = [(f"v{i:04d}", x[i].tolist(), i % 20 == 0, "clash", 0) for i in range(len(x))]
    how = K.Index(dim=16, k=5, posts=8, visits=8, order=8, shortlist=64, file_rows=file_rows)
    got = {}
    for r in K.most_similar(spark.createDataFrame(rows, SCHEMA), how, cut).collect():
        got.setdefault(r.id, []).append((r["rank"], r.other, r.sim))
    want, s = brute(x, 5)
    assert set(got) == {f"v{i:04d}" for i in range(0, 600, 20)}
    hit = sum(len({o for _, o, _ in got[f"v{i:04d}"]} & {f"v{j:04d}" for j in want[i]}) for i in range(0, 600, 20))
    assert hit / (5 * 30) >= 0.9
    for i in range(0, 600, 20):
        for _, o, sim in got[f"v{i:04d}"]:
            assert sim == pytest.approx(s[i, int(o[1:])], abs=1e-9)


def test_ties_copies_and_dirt(spark):
    e = [1.0, 0.0]
    rows = [(f"c{i}", e, True, None, None) for i in range(8)] + [
        ("c0", e, True, None, None), ("scaled", [2.0, 0.0], True, None, None), ("null", None, True, None, None), ("zero", [0.0, 0.0], True, None, None), ("inf", [float("inf"), 1.0], True, None, None),
        ("nan", [float("nan"), 1.0], True, None, None), ("short", [1.0], True, None, None), ("far", [0.0, 1.0], True, None, None), ("mute", [0.6, 0.8], None, None, None),
    ]
    how = K.Index(dim=2, k=5, least=0.5)
    got = {}
    for r in K.most_similar(spark.createDataFrame(rows, SCHEMA), how, cut).collect():
        got.setdefault(r.id, []).append((r["rank"], r.other))
    assert [o for _, o in sorted(got["c7"])] == ["c0", "c1", "c2", "c3", "c4"]
    assert [o for _, o in sorted(got["scaled"])] == ["c0", "c1", "c2", "c3", "c4"]
    assert got["far"] == [(1, "mute")]
    assert not {"null", "zero", "inf", "nan", "short", "mute"} & set(got)
    assert K.most_similar(spark.createDataFrame([], SCHEMA), how, cut).count() == 0


def test_footrule_order():
    a, b = np.array([[1, 2, 3]]), np.array([[1, 2, 3], [2, 1, 3], [3, 2, 1], [7, 8, 9]])
    close = K._Orders(b).closeness(a)[0]

    def distance(p, q):
        place = lambda o, x: list(o).index(x) if x in o else 3
        return sum(abs(place(p, x) - place(q, x)) for x in {*p, *q})

    assert [12 - 2 * c for c in close] == [distance(a[0], r) for r in b]


@pytest.mark.parametrize("cosine, file_rows", [(0.92, 4096), (0.97, 300)])
def test_dense_group(spark, cosine, file_rows):
    """A third of the vectors lie around one direction: their best five are found all the same."""
    rng = np.random.default_rng(3)
    n, dim = 4500, 64
    x = rng.normal(size=(n, dim))
    hot = n // 3
    side = rng.normal(size=(hot, dim))
    side[:, 0] = 0
    side /= np.linalg.norm(side, axis=1)[:, None]
    x[:hot] = np.sqrt(1 - cosine) * side
    x[:hot, 0] = np.sqrt(cosine)
    x = x.astype(np.float32)
    rows = [(f"v{i:04d}", x[i].tolist(), True, "clash", 0) for i in range(n)]
    how = K.Index(k=5, posts=5, visits=5, least=0.9, file_rows=file_rows)
    got = {(r.id, r.other) for r in K.most_similar(spark.createDataFrame(rows, SCHEMA), how, cut).select("id", "other").collect()}
    want, s = brute(x, 5)
    true = {(f"v{i:04d}", f"v{j:04d}") for i in range(n) for j in want[i] if s[i, j] >= 0.9}
    assert len(true) > 5 * hot * 0.99
    assert len(got & true) / len(true) >= 0.999


def _answers(spark, rows, how):
    return {tuple(r) for r in K.most_similar(spark.createDataFrame(rows, SCHEMA), how, cut).collect()}


@pytest.mark.parametrize("how", [K.Index(dim=16, k=5, shortlist=8), K.Index(dim=16, k=5, shortlist=8, max_pivots=16, file_rows=40)])
def test_row_order_changes_nothing(spark, how):
    x = clustered(900, 16, 2)
    rows = [(f"v{i:04d}", x[i].tolist(), i % 3 == 0, "clash", 0) for i in range(len(x))]
    shuffled = [rows[i] for i in np.random.default_rng(8).permutation(len(rows))]
    assert _answers(spark, rows, how) == _answers(spark, shuffled, how)


def test_long_files_are_split_by_pairs(spark):
    """With few pivots every file is long: postings stay bounded, near neighbours still meet."""
    x = clustered(3000, 16, 5)
    rows = [(f"v{i:04d}", x[i].tolist(), True, "clash", 0) for i in range(len(x))]
    how = K.Index(dim=16, k=5, posts=5, visits=5, least=0.9, max_pivots=32, file_rows=64)
    got = {r[:1] + r[2:3] for r in _answers(spark, rows, how)}
    want, s = brute(x, 5)
    true = {(f"v{i:04d}", f"v{j:04d}") for i in range(len(x)) for j in want[i] if s[i, j] >= 0.9}
    assert len(got & true) / len(true) >= 0.95


def test_pairs_of_long_files():
    files, long = np.array([[3, 1, 2], [0, 1, 0], [0, 0, 0]]), np.array([False, True, True, True])
    rows, low, high, kind = K._pairs_of_long(files, K._first(files), long, 2, 3)
    assert sorted(zip(rows.tolist(), low.tolist(), high.tolist(), kind.tolist())) == [(0, 1, 2, 2), (0, 1, 3, 3), (0, 2, 3, 2), (1, 1, 1, 1), (1, 1, 1, 2)]


@pytest.mark.parametrize("least, block_rows", [(-1.0, 16_384), (-1.0, 70), (0.9, 16_384), (0.9, 70)])
def test_what_the_index_drops_is_found(spark, least, block_rows):
    """One file, one visit and a shortlist of one: the index gives next to nothing, the result is that of brute force."""
    x = clustered(700, 64, 6)
    x[500:] = x[0] + 0.3 * x[500:]  # and a dense group
    query = [i % 3 == 0 for i in range(len(x))]
    rows = [(f"v{i:04d}", x[i].tolist(), query[i], "clash", 0) for i in range(len(x))]
    how = K.Index(k=5, posts=1, visits=1, order=2, shortlist=1, least=least, max_pivots=64, dense=2.0, file_rows=32, block_rows=block_rows)
    want, s = brute(x, 5)
    true = {(f"v{i:04d}", r + 1, f"v{j:04d}") for i in range(len(x)) if query[i] for r, j in enumerate(want[i]) if s[i, j] >= least}
    assert {r[:3] for r in _answers(spark, rows, how)} == true
