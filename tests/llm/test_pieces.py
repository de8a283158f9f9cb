import re

from hypothesis import given, seed, settings
from hypothesis import strategies as st

from marginalia.functions.identifiers import WS_CHARS
from marginalia.llm import pieces as C


def check(text, limit, overlap):
    got = C.bisect(text, limit, overlap)
    covered = 0
    for n, p in enumerate(got):
        assert 0 < len(p.text) <= limit and p.end > p.own
        assert not text[covered : p.own].strip(WS_CHARS)
        assert p.text.endswith(text[p.own : p.end])
        before = got[n - 1].text if n else ""
        gap = p.own - covered if n else 0
        room = limit - (p.end - p.own) - min(1, gap)
        assert p.overlap == max(0, min(overlap, len(before), room))
        assert p.text.startswith(before[len(before) - p.overlap :])
        # What stands between the two is white space of the text, whole if it fits.
        between = p.text[p.overlap : len(p.text) - (p.end - p.own)]
        assert len(between) == min(gap, limit - (p.end - p.own) - p.overlap) and not between.strip(WS_CHARS)
        covered = p.end
    assert not text[covered:].strip(WS_CHARS)
    longest = max(map(len, re.split(f"[{re.escape(WS_CHARS)}。！？]", text)))
    assert any(p.hard for p in got) == (longest > limit)


TEXTS = st.text(alphabet="ab .,。！\n\r\t　、!?", min_size=1, max_size=400)


def invariants(text, limit):
    text = text.strip(WS_CHARS)
    if text:
        check(text, limit, limit // 10)
        check(text, limit, limit // 3)


@seed(1)
@settings(max_examples=300, deadline=None, database=None)
@given(TEXTS, st.integers(8, 60))
def test_invariants(text, limit):
    invariants(text, limit)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(8, 60))
def test_invariants_of_any_seed(text, limit):
    invariants(text, limit)


def test_blanks_and_marks():
    check("??????   ?", 10, 1)
    check("a" * 5 + " " * 40 + "b" * 9, 10, 2)
    check("ab " * 3 + "\n" * 30 + "c d", 8, 4)


def test_every_joint_has_its_overlap():
    text = " ".join(f"Word{i} and more, it says." for i in range(900))
    got = C.bisect(text, 2000, 200)
    assert len(got) > 10 and all(p.overlap == 200 for p in got[1:])
    crumbs = "abc\n\n" + "x" * 1790 + " " + "word " * 500
    assert all(p.end - p.own > 3 for p in C.bisect(crumbs, 2000, 200)[1:])


def test_runs_at_the_edge():
    for n in (1799, 1800, 1801, 1999, 2000, 2001, 2500, 9000):
        check("x" * n, 2000, 200)
        check("x" * n + "。" + "y" * 500, 2000, 200)
        check("a b " * 300 + "x" * n, 2000, 200)
    check("word " * 400_00, 2000, 200)


def test_boundaries_are_natural():
    text = "First paragraph here.\n\n" + "Second one. " * 6 + "\n\nThird paragraph."
    got = C.bisect(text, 60, 6)
    assert got[0].text == "First paragraph here."


def test_table(spark):
    rows = [("a", "x " * 80, 1), ("a", "x " * 80, 1), ("b", None, 1), ("c", "", 1), ("d", "  short ", 1), ("e", "y" * 200, 1)]
    df = spark.createDataFrame(rows, "id string, text string, piece int")
    got = C.split(df, 50, 5).collect()
    assert {r.id for r in got} == {"a", "c", "d", "e"}
    assert [r.piece_text for r in got if r.id == "d"] == ["short"] and [r.piece_text for r in got if r.id == "c"] == [""]
    for r in got:
        assert len(r.piece_text) <= 50
    a = sorted((r.piece, r.n_pieces) for r in got if r.id == "a")
    assert [p for p, _ in a] == list(range(a[0][1]))
    assert dict(map(tuple, C.cut_kinds(df, 50, 5).collect())) == {"a": "soft", "e": "hard"}
    assert C.split(df.filter("false"), 50, 5).count() == 0
