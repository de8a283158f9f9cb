import uuid

import pytest
from pyspark.sql import functions as F

from marginalia.operators import chunking as C
from marginalia.operators import library as L
from marginalia.operators import outline as O
from marginalia.runtime import cut

PATHS = ["Looms/Mk2/weft.pdf", "Looms/Mk2/warp.pdf", "Looms/Mk5/shed.pdf", "Dyes for Looms/b7/madder.pdf", "index.pdf"]


@pytest.fixture(scope="module")
def manuals(spark):
    return spark.createDataFrame([(str(i), p, p.split("/")[-1]) for i, p in enumerate(PATHS)], "id string, relative_path string, file_name string")


def test_folder_and_patterns(manuals):
    rows = [(r.is_manual, r.name, r.manuals) for r in L.list_folder(manuals, "").orderBy("is_manual", "name").collect()]
    assert rows == [(False, "Dyes for Looms", 1), (False, "Looms", 3), (True, "index.pdf", None)]
    assert manuals.filter(L.manual_pattern("Looms/*")).count() == 3 and manuals.filter(L.manual_pattern("looms/*")).count() == 0
    assert L.manual_pattern("*") is None
    with pytest.raises(L.LibraryError):
        L.manual_pattern(" / ")
    assert manuals.filter(L.include(F.col("relative_path"), ["*.pdf"])).count() == 5 and manuals.filter(L.include(F.col("relative_path"), [])).count() == 5
    assert manuals.filter(L.include(F.col("relative_path"), ["Looms/M[km][25]/*", "nothing"])).count() == 3


def test_sync_and_upsert(spark):
    known = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("e", "1")], "relative_path string, file_hash string")
    found = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1"), ("e", None), ("x", None)], "relative_path string, file_hash string")
    assert dict(map(tuple, L.sync_actions(known, found).collect())) == {"a": "keep", "b": "replace", "c": "delete", "d": "add", "e": "delete"}
    assert dict(map(tuple, L.upsert(known, found.filter("relative_path = 'b'"), "relative_path").collect()))["b"] == "2"


@pytest.mark.parametrize("pages,split,parts", [(200, 250, 1), (1246, 250, 5), (2900, 250, 12), (0, 250, 1), (700, 0, 1)])
def test_plan_parts(spark, pages, split, parts):
    got = L.plan_parts(spark.createDataFrame([("f", pages)], "relative_path string, page_count int"), split).orderBy("part").collect()
    sizes = [r.end_page - r.start_page + 1 for r in got]
    assert len(got) == parts and sum(sizes) == max(pages, 1) and max(sizes) - min(sizes) <= 1
    assert [r.start_page for r in got[1:]] == [r.end_page + 1 for r in got[:-1]]


def test_scalars(spark):
    ids = ["m1_0", "ü・1", ""]
    got = spark.createDataFrame([(x,) for x in ids], "x string").select(L.point_id(F.col("x"), uuid.NAMESPACE_DNS.hex)).collect()
    assert [r[0] for r in got] == [str(uuid.uuid5(uuid.NAMESPACE_DNS, x)) for x in ids]
    times = [(0, "0:00"), (7, "0:07"), (125, "2:05"), (3540, "59:00"), (7205, "2:00:05"), (86399, "23:59:59"), (None, ""), (-3, "")]
    df = spark.createDataFrame(times, "s int, want string")
    assert df.filter(L.format_duration(F.col("s")) != F.col("want")).count() == 0
    titles = [("7 Threading", "threading"), ("4.12  Beam  tension", "beam tension"), ("5-2 Reeds", "reeds"), ("XII. Heddles", "heddles"), ("C. Tables:", "tables"), ("A loose thread", "a loose thread"), (None, "")]
    df = spark.createDataFrame(titles, "t string, want string")
    assert df.filter(O.normalize_title(F.col("t")) != F.col("want")).count() == 0


def test_merge(spark):
    cases = [([], ""), (["weft"], "weft"), (["pull the shuttle", "tle back and forth"], "pull the shuttle back and forth"), (["red", "blue"], "red\n\nblue"), (["ab", "b", "bc"], "abc"), (["x", None, "y"], "x\n\ny"), (None, None)]
    df = spark.createDataFrame([(n, t, "clash") for n, (t, _) in enumerate(cases)], "n int, t array<string>, text string").drop("text")
    assert [r["merged"] for r in C.merge_rows(df, "t", "merged").orderBy("n").collect()] == [w for _, w in cases]
    # A text is looked at against all that was merged before it, and no more than the window of it.
    assert C.merge_list(["abc", "c", "bcd"]) == "abcd" and C.merge_list(["a" * 400, "a" * 400], 300) == "a" * 500


def test_split():
    a, b = C.split_text("P" * 2500)
    assert (len(a), len(b)) == (2000, 700)
    text = "\n\n".join(f"Paragraph {i} " + "word " * 60 for i in range(30))
    pieces = C.split_text(text)
    assert all(len(p) <= 2000 for p in pieces) and len(pieces) > 3
    assert C.split_text(" \n") == []


def test_parents_and_subtrees(spark):
    rows = [("a", "m", 0, 1), ("b", "m", 1, 2), ("c", "m", 2, 4), ("d", "m", 3, 2), ("e", "m", 4, 1), ("x", "n", 0, 3)]
    marks = spark.createDataFrame(rows, "id string, manual_id string, ordering int, level int")
    assert dict(map(tuple, O.parents_from_levels(marks).collect())) == {"a": None, "b": "a", "c": "b", "d": "a", "e": None, "x": None}
    assert dict(map(tuple, O.parents_from_levels(marks, strict=True).collect()))["c"] is None
    assert {r.id: (r.lo, r.hi) for r in O.subtree_bounds(marks).collect()} == {"a": (0, 4), "b": (1, 3), "c": (2, 3), "d": (3, 4), "e": (4, None), "x": (0, None)}


def test_markers_and_asof(spark):
    pics = spark.createDataFrame([("m", 14.2, 8.0)] * 10 + [("m", 100.0, 90.0)] * 12 + [("n", 14.0, 8.0)] * 9, "manual_id string, w double, h double")
    assert [tuple(r) for r in C.marker_shapes(pics).collect()] == [("m", 14, 8, 10)]
    rows = [("m", 0, 1, True, "6.2"), ("m", 0, 2, True, "7"), ("m", 0, 3, False, "text"), ("m", 0, 4, True, "9")]
    got = C.attach_markers(spark.createDataFrame(rows, "manual_id string, run int, seq int, is_marker boolean, text string")).orderBy("seq").collect()
    assert [r.text for r in got] == ["[6.2] [7] text", "[9]"]
    marks = spark.createDataFrame([("m", 1, "hi", 500.0, 0), ("m", 1, "lo", 300.0, 1), ("m", 1, "tie", 300.0, 2), ("m", 2, "none", None, 3)], "manual_id string, page_num int, id string, page_top double, ordering int")
    items = spark.createDataFrame([("m", 1, "i1", 505.0), ("m", 1, "i2", 100.0), ("m", 1, "i3", 600.0), ("m", 2, "i4", 5.0)], "manual_id string, page int, item_id string, top double")
    got = dict(map(tuple, O.asof_bookmark(items, marks).collect()))
    assert got == {"i1": "hi", "i2": "tie", "i4": "none"}


def test_chunk_items(spark):
    cols = "manual_id string, seq int, label string, text string, page int, top double, caption string, labels string, description string"
    rows = [
        ("m", 0, "section_header", "1 Start", 1, 700.0, None, None, None), ("m", 1, "text", "alpha", 1, 650.0, None, None, None), ("m", 2, "text", "floating", None, None, None, None, None),
        ("m", 3, "picture", None, 1, 600.0, "Fig", "Pump, Valve", ""), ("m", 4, "picture", None, 1, 590.0, None, None, None), ("m", 5, "table", "|a|", 1, 580.0, "Cap", None, None),
        ("m", 6, "text", "P" * 2500, 2, 700.0, None, None, None),
    ]
    marks = spark.createDataFrame([("m", 1, "b1", 710.0, 0, "Start"), ("m", 2, "b2", 720.0, 1, "Next")], "manual_id string, page_num int, id string, page_top double, ordering int, title string")
    got = [(r.bookmark_id, r.kind, len(r.text), r.text[:30]) for r in C.chunk_items(spark.createDataFrame(rows, cols), marks, cut).orderBy("seq", "piece").collect()]
    assert got == [
        ("b1", "text", 24, "1 Start\n\nalpha\n\nfloating"), ("b1", "figure", 24, "Fig\n\nLabels: Pump, Valve"), ("b1", "figure", 16, "Figure on page 1"), ("b1", "table", 8, "Cap\n\n|a|"),
        ("b2", "text", 2000, "P" * 30), ("b2", "text", 700, "P" * 30),
    ]


def test_outline_of_any_depth(spark):
    """Levels over 32 and under 0 are levels like any other."""
    levels = list(range(-2, 41)) + [36, 40, 33]
    rows = [(f"b{n:02d}", "m", n, x) for n, x in enumerate(levels)]
    marks = spark.createDataFrame(rows, "id string, manual_id string, ordering int, level int")
    want, bounds = {}, {}
    for n, x in enumerate(levels):
        want[f"b{n:02d}"] = next((f"b{k:02d}" for k in range(n - 1, -1, -1) if levels[k] < x), None)
        bounds[f"b{n:02d}"] = next((k for k in range(n + 1, len(levels)) if levels[k] <= x), None)
    assert {r.id: r.parent for r in O.parents_from_levels(marks).collect()} == want
    strict = {i: p if p and levels[int(p[1:])] == levels[int(i[1:])] - 1 else None for i, p in want.items()}
    assert {r.id: r.parent for r in O.parents_from_levels(marks, strict=True).collect()} == strict
    assert {r.id: r.hi for r in O.subtree_bounds(marks).collect()} == bounds
    assert O.parents_from_levels(marks.filter("false")).count() == 0 and O.subtree_bounds(marks.filter("false")).count() == 0


def test_sections_hold_what_is_below_them(spark, tmp_path):
    """A nested outline, with chunks only below the root and in its grandchild."""
    from marginalia.plans import library, search

    uid = lambda n: f"00000000-0000-0000-0000-{n:012d}"
    m, d = uid(900), str(tmp_path)
    marks = [(uid(1), m, 0, 0), (uid(2), m, 1, 1), (uid(3), m, 2, 2), (uid(4), m, 3, 0)]
    spark.createDataFrame(marks, "id string, manual_id string, ordering int, level int").write.parquet(f"{d}/bookmarks.parquet")
    chunks = [(f"{m}_{n}", t, [1.0, float(n)], (uid(b), "text", 1, None, float(n))) for n, (t, b) in enumerate([("rotor one", 2), ("rotor two", 3), ("rotor three", 4)])]
    meta = "struct<bookmark_id:string,type:string,page:int,figure_id:string,chunk_index:double>"
    spark.createDataFrame(chunks, f"id string, document string, embedding array<float>, metadata {meta}").write.parquet(f"{d}/chunks.parquet")
    got = {r.bookmark_id[-1]: r.markdown for r in library.section_markdown(spark, d).collect()}
    assert got == {"1": "rotor one\n\nrotor two", "2": "rotor one\n\nrotor two", "3": "rotor two", "4": "rotor three"}
    pairs = {(r.bookmark_id[-1], r.sub[-1]) for r in search.section_pairs(spark, d).collect()}
    assert pairs == {("1", "1"), ("1", "2"), ("1", "3"), ("2", "2"), ("2", "3"), ("3", "3"), ("4", "4")}


def test_subtrees_are_counted(spark):
    """Sizes, depths and ancestors of dirty outlines equal brute force: repeated orderings, null levels."""
    import random

    rnd = random.Random(5)
    rows = [(f"{m}{n:02d}", m, rnd.randrange(25), rnd.choice([1, 2, 3, 4, 7, None])) for m in "mno" for n in range(30)]
    marks = spark.createDataFrame(rows, "id string, manual_id string, ordering int, level int")
    got = {r.id: (r.n, r.deepest) for r in O.subtrees(marks).collect()}
    above = {}
    for r in O.ancestors(marks).collect():
        above.setdefault(r.id, set()).add(r.ancestor)
    for i, m, o, lv in rows:
        mine = [r for r in rows if r[1] == m]
        ends = [z[2] for z in mine if (z[2], z[0]) > (o, i) and z[3] is not None and lv is not None and z[3] <= lv]
        inside = [q for q in mine if q[2] >= o and (not ends or q[2] < min(ends))]
        assert got[i] == (len(inside), max([q[3] for q in inside if q[3] is not None], default=0))
        want = {a for a, _, ao, al in mine if al is not None and lv is not None and al < lv and (ao, a) < (o, i) and not any(z[3] is not None and z[3] <= al and (ao, a) < (z[2], z[0]) < (o, i) for z in mine)}
        assert above.get(i, set()) == want


def test_waves_and_changes(spark):
    rows = [(f"f{n:03d}", (n * 37) % 50 if n % 11 else None) for n in range(103)]
    df = spark.createDataFrame(rows, "id string, page_count int")
    got = {r.id: r.wave for r in L.waves(df, cut, 8, F.desc_nulls_first("page_count"), F.col("id")).collect()}
    ordered = sorted(rows, key=lambda r: (r[1] is not None, -(r[1] or 0), r[0]))
    sizes = [13] * 7 + [12]
    want = {r[0]: w for r, w in zip(ordered, [w for w, k in enumerate(sizes, 1) for _ in range(k)])}
    assert got == want
    assert L.waves(df.filter("false"), cut, 8, F.col("id")).count() == 0
    h = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("b", 1, "x"), ("b", 2, None), ("c", None, "q"), ("c", 5, "p")], "id string, at int, h string")
    assert {tuple(r) for r in L.changed(h, "id", "h", "at").collect()} == {("a", "x", "y"), ("c", "q", "p")}
