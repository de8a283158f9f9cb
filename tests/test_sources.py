import pytest
from pyspark.sql import functions as F

from marginalia.sources import documents as D

TEXT = "# Start\n\nalpha\n\n| a |\n|---|\f## Next\n\nbeta"


def test_parser_and_errors(spark):
    c = spark.createDataFrame([("a.md", bytearray(TEXT.encode())), ("bad.md", bytearray(b"\xff\xfe")), ("none.md", None)], "path string, content binary")
    f = {r.path: r for r in D.fingerprints(c, D.MarkdownParser()).collect()}
    assert (f["a.md"].title, f["a.md"].page_count, [(o.title, o.level, o.page_num) for o in f["a.md"].outline]) == ("Start", 2, [("Start", 1, 1), ("Next", 2, 2)])
    assert f["bad.md"].error.startswith("UnicodeDecodeError") and f["none.md"].file_hash is None
    items = [(r.seq, r.label, r.text, r.page) for r in D.parse_items(c, D.MarkdownParser()).filter("error is null").orderBy("seq").collect()]
    assert items == [(0, "section_header", "Start", 1), (1, "text", "alpha", 1), (2, "table", "| a |\n|---|", 1), (3, "section_header", "Next", 2), (4, "text", "beta", 2)]


@pytest.mark.parametrize("budget", [1, 100, 4096, 24576, 10**6])
def test_batches(budget):
    lengths = [5, 300, 20, 20, 1000, 0, 77, 4096]
    plan = D.plan_batches(lengths, budget)
    assert sorted(i for b in plan for i in b) == list(range(len(lengths)))
    assert all(len(b) == 1 or len(b) * max(lengths[i] for i in b) <= budget for b in plan)
    assert D.plan_batches([], budget) == []


def test_archive(spark, tmp_path):
    m = spark.createDataFrame([("m1", "p"), ("m2", "q")], "id string, relative_path string")
    b = spark.createDataFrame([("b1", "m1"), ("b2", "zz")], "id string, manual_id string")
    c = spark.createDataFrame([("m1_0", "m1", [1.0]), ("m1_1", "m1", None), ("m2_0", "m2", [2.0])], "id string, manual_id string, embedding array<double>")
    path = str(tmp_path / "a")
    D.write_archive(path, m, b, b, c, "model")
    schemas = {"manuals": "id string, relative_path string", "bookmarks": "id string, manual_id string", "chunks": "id string, manual_id string, embedding array<double>"}
    got = D.read_archive(spark, path, m.filter("id = 'm2'"), "model", schemas)
    assert [r.id for r in got["manuals"].collect()] == ["m1"] and [r.id for r in got["chunks"].collect()] == ["m1_0"] and [r.id for r in got["bookmarks"].collect()] == ["b1"]
    with pytest.raises(D.ArchiveError):
        D.read_archive(spark, path, m, "other", schemas)
    with pytest.raises(D.ArchiveError):
        D.read_archive(spark, str(tmp_path / "none"), m, "model", schemas)


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.pdf").write_bytes(b"abc")
    (tmp_path / "y.txt").write_bytes(b"abc")
    assert [r.length for r in D.files(spark, str(tmp_path), "*.pdf").select("length").collect()] == [3]
    assert D.files(spark, str(tmp_path), "*.pdf").select(F.sha2("content", 256)).count() == 1


def test_markdown_dump(spark, tmp_path):
    rows = [("a.md", 1, "text", "body"), ("a.md", 0, "section_header", "Head"), ("b.md", 0, "text", "other"), ("c.md", None, None, None)]
    D.write_markdown(spark.createDataFrame(rows, "path string, seq int, label string, text string"), str(tmp_path / "md"))
    got = {p.parent.name: p.read_text() for p in (tmp_path / "md").glob("*/*.txt")}
    assert got == {"path=a.md": "# Head\n\nbody\n\n", "path=b.md": "other\n\n"}
