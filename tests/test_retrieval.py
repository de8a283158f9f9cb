import math

import pytest
from pyspark.sql import functions as F

from marginalia.functions.identifiers import id_key
from marginalia.operators import fusion, lexical, library, search, vectors
from marginalia.sources.lexical_store import LexicalStore

TEXTS = [
    ("a1", "p", "QX7731 spindle stalled. A spindle guard stopped the carriage."), ("a2", "p", "QX7732 tells of a carriage that starts anew."),
    ("a3", "p", "Before you grease a bearing, clean the bearing seat."), ("a4", "q", "`grease_gun()` opens the lower bearing."),
    ("a5", "q", "Set UV/IR by the LAMP chart."), ("a6", "q", "織機の点検手順について"), ("a7", "q", None),
] + [(f"z{i}", "r", f"Every carriage and every guard has its own spindle, number {i}.") for i in range(60)]


@pytest.fixture(scope="module")
def index(spark):
    chunks = spark.createDataFrame(TEXTS, "chunk_id string, manual_id string, content string")
    return lexical.postings(chunks), lexical.corpus_stats(chunks)


def hits(index, terms, **kw):
    return [r.chunk_id for r in lexical.top(lexical.bm25(*index, terms, **kw), 20).collect()]


def test_bm25_and_gate(index):
    assert hits(index, ["why", "carriage", "QX7731", "spindle"])[0] == "a1"
    assert hits(index, ["qx7732"], ratio=1.0) == ["a2"]
    assert hits(index, ["grease", "bearing"], manuals=["p"], ratio=1.0) == ["a3"]
    assert hits(index, ["grease", "bearing"], manuals=["q"], ratio=1.0) == ["a4"]
    assert hits(index, ["UV", "IR", "lamp"], ratio=1.0)[0] == "a5"
    assert hits(index, ["carriage", "guard", "spindle"], ratio=0.05) == []
    assert hits(index, [], ratio=1.0) == [] and hits(index, ["grease"], manuals=[], ratio=1.0) == []


def test_score_formula(index):
    n, total = index[1].first()
    row = lexical.bm25(*index, ["QX7731", "qx7731"], ratio=1.0).first()
    dl = len("QX7731 spindle stalled A spindle guard stopped the carriage".split())
    idf = math.log((n - 1 + 0.5) / 1.5)
    assert row.score == pytest.approx(2 * idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * dl / (total / n))), abs=1e-5)


def test_stored_index(spark, tmp_path):
    """Every change of the stored index equals an index made anew from what is left."""
    cols = "chunk_id string, manual_id string, content string, bucket string"
    rows = [(*r, "clash") for r in TEXTS]
    df = spark.createDataFrame([*rows, (None, "p", "no id", None), rows[0]], cols)
    store = LexicalStore(spark, str(tmp_path / "index"), buckets=4)
    assert not store.exists()
    with pytest.raises(library.LibraryError) as e:
        store.postings()
    assert e.value.kind == "not_found"
    store.create(df)
    with pytest.raises(library.LibraryError):
        store.create(df)

    def equals(kept):
        fresh = spark.createDataFrame(kept, cols)
        posts, stats = lexical.postings(fresh), lexical.corpus_stats(fresh)
        bag = lambda x: sorted(map(tuple, x.select("chunk_id", "manual_id", "term", "dl", "tf").collect()))
        assert bag(store.postings()) == bag(posts)
        assert store.corpus_stats().first() == stats.first()
        assert sorted(map(tuple, store.term_stats().collect())) == sorted(map(tuple, lexical.term_stats(posts).collect()))
        for terms in (["spindle", "QX7731"], ["grease", "bearing", "grease"], []):
            got, want = store.search(terms, ratio=1.0), lexical.bm25(posts, stats, terms, ratio=1.0)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))

    equals(rows)
    store.delete(spark.createDataFrame([("q",), (None,), ("unknown",)], "manual_id string"))
    left = [r for r in rows if r[1] != "q"]
    equals(left)
    new = [("b1", "p", "A new spindle for p", ""), ("b2", "s", "spindle and UV", "")]
    store.add(spark.createDataFrame(new, cols))
    left = [r for r in left if r[1] != "p"] + new
    equals(left)
    store.optimize()
    equals(left)
    store.vacuum()
    equals(left)
    scan = store.postings(["uv"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "bucket" in scan.split("PartitionFilters: [")[1].split("]")[0]
    # A second writer that read the same state fails.
    manifest = store._read()
    store._write(dict(manifest))
    with pytest.raises(library.LibraryError):
        store._write(dict(manifest))
    store.drop()
    assert not store.exists()
    empty = LexicalStore(spark, str(tmp_path / "empty"))
    empty.create(df.filter("false"))
    assert empty.search(["spindle"]).count() == 0 and empty.corpus_stats().first() == (0, 0)


def test_requests(spark, tmp_path):
    """Scopes, sections with all below them, and refused requests."""
    uid = lambda n: f"00000000-0000-0000-0000-{n:012d}"
    m, o = uid(800), uid(801)
    marks = spark.createDataFrame([(uid(1), m, 0, 1), (uid(2), m, 1, 2), (uid(3), m, 2, 1), (uid(4), o, 0, 1)], "id string, manual_id string, ordering int, level int")
    manuals = spark.createDataFrame([(m, "Looms/a.pdf"), (o, "Dyes/b.pdf")], "manual_id string, relative_path string")
    rows = [(f"{m}_0", m, uid(1), "spindle one", [1.0, 0.0]), (f"{m}_1", m, uid(2), "spindle two", [0.9, 0.1]), (f"{m}_2", m, uid(3), "spindle three", [0.8, 0.2]), (f"{o}_0", o, uid(4), "madder", [1.0, 0.1]), (f"{o}_1", o, None, None, None)]
    chunks = spark.createDataFrame(rows, "id string, manual_id string, bookmark_id string, content string, embedding array<float>").withColumn("bookmark_id", id_key(F.col("bookmark_id")))
    store = LexicalStore(spark, str(tmp_path / "index"))
    store.create(chunks.withColumnRenamed("id", "chunk_id"))

    def ask(text="spindle", limit=5, **kw):
        return {r.id[-5:] for r in search.hybrid(search.Request(text, [1.0, 0.0], limit, ratio=1.0, **kw), chunks, store, manuals, marks, id_key).collect()}

    assert ask() == {"800_0", "800_1", "800_2", "801_0"} and len(ask(limit=2)) == 2
    assert ask(manual_path="Dyes/*") == {"801_0"} and ask(manual_path="*") == ask()
    assert ask(section=uid(1)) == {"800_0", "800_1"} and ask(section="{" + uid(3).upper() + "}") == {"800_2"}
    assert ask(section=uid(4), manual_path="Looms/*") == set() and ask("。") == ask()
    for kind, kw in (("invalid", {"text": " "}), ("invalid", {"limit": 0}), ("invalid", {"limit": 51}), ("invalid", {"manual_path": "/"}), ("not_found", {"manual_path": "Nothing/*"}), ("not_found", {"section": uid(9)})):
        with pytest.raises(library.LibraryError) as e:
            ask(**kw)
        assert e.value.kind == kind


def test_tokens(spark):
    t = spark.createDataFrame([("Café naïve ß x² ½ a_b カ・キ",)], "x string").select(lexical.tokens(F.col("x")), lexical.match_query(F.col("x"))).first()
    assert t[0] == ["cafe", "naive", "ß", "x²", "½", "a", "b", "カ", "キ"]
    assert t[1] == '"Caf" OR "na" OR "ve"'


def ranks(spark, ids):
    return spark.createDataFrame([(x, 1.0 - i / 100) for i, x in enumerate(ids)], "id string, score double")


def order(df):
    return [r.id for r in df.orderBy(F.desc("score"), "first_list", "first_rank").collect()]


def test_fusion(spark):
    both = [(ranks(spark, "abc"), 1.0, 60), (ranks(spark, "cda"), 1.0, 60)]
    assert order(fusion.rrf_fuse(both))[0] == "a"
    empty = spark.createDataFrame([], "id string, score double")
    dense = [f"d{i:02d}" for i in range(1, 21)]
    assert order(fusion.rrf_fuse([(ranks(spark, dense), 1.0, 60), (empty, 0.3, 5)])) == dense
    lex = [f"y{i:02d}" for i in range(1, 21)]
    fused = order(fusion.rrf_fuse([(ranks(spark, dense), 1.0, 60), (ranks(spark, lex), 0.3, 5)]))
    assert fused.index("d01") < fused.index("y20")
    tags = {r.id: r.retrieval for r in fusion.hybrid(ranks(spark, "ab"), ranks(spark, "bc"), 5).collect()}
    assert tags == {"a": "dense", "b": "both", "c": "lexical"}


def test_vectors(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0], "m"), ("b", [0.6, 0.8], "n"), ("z", [0.0, 0.0], "m"), ("n", None, "m"), ("f", [float("nan"), 1.0], "m"), ("s", [1.0], "m")], "id string, embedding array<float>, manual_id string")
    assert [(r.id, r.score) for r in vectors.dense_top(v, [1.0, 0.0], 5).collect()] == [("a", 1.0), ("b", 0.6)]
    assert [r.id for r in vectors.dense_top(v, [1.0, 0.0], 5, vectors.chunk_filter(manual_ids=["n"])).collect()] == ["b"]
    assert v.filter(vectors.chunk_filter(manual_ids=[])).count() == 0 and v.filter(vectors.chunk_filter()).count() == 6
    assert v.filter("id = 'z'").select(vectors.l2_normalize(F.col("embedding"))).first()[0] == [0.0, 0.0]


def test_scope_holds_all_manuals(spark, tmp_path):
    """A pattern's scope is all its manuals, however many."""
    from marginalia.plans import search as plans

    d, uid = str(tmp_path), lambda n: f"00000000-0000-0000-0000-{n:012d}"
    manuals = [(uid(n), f"{'Tarvel' if n < 9 else 'Other'} OS/{n}.pdf") for n in range(12)]
    spark.createDataFrame(manuals, "id string, relative_path string").write.parquet(f"{d}/manuals.parquet")
    meta = "struct<bookmark_id:string,type:string,page:int,figure_id:string,chunk_index:double>"
    chunks = [(f"{uid(n)}_0", "rotor purges", [1.0, float(n)], (None, "text", 1, None, 0.0)) for n in range(12)]
    spark.createDataFrame(chunks, f"id string, document string, embedding array<float>, metadata {meta}").write.parquet(f"{d}/chunks.parquet")
    spark.createDataFrame([("v0", [1.0, 0.0])], "vec_id string, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    want = {f"{uid(n)}_0" for n in range(9)}
    assert {r.id for r in plans.chunk_filter(spark, d).collect()} == want
    assert {r.id for r in plans.dense_topk_filtered(spark, d).collect()} == want
    assert {r.chunk_id for r in plans.bm25_scoped(spark, d).collect()} == want
