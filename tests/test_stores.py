import json

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from marginalia.functions.identifiers import id_key
from marginalia.operators import chunking as C
from marginalia.operators import library as L
from marginalia.runtime import cut
from marginalia.sources import documents as D
from marginalia.sources import embedders as E
from marginalia.sources.chunk_store import CHUNK, ChunkStore, add_missing_columns, check_model
from marginalia.streaming import progress as P


def ids(df):
    return sorted(r.id for r in df.collect())


def test_chunk_store(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "chunks"))
    with pytest.raises(L.LibraryError):
        store.scroll()
    store.reset("m1")
    assert store.recorded_model() == "m1" and store.count() == 0
    cols = "id string, manual_id string, document string, embedding array<float>, extra int"
    first = spark.createDataFrame([("a_0", "a", "one", [1.0, 0.0], 1), ("a_1", "a", None, None, 1), ("b_0", "b", "two", [0.0, 1.0], 1), (None, "b", "x", None, 1), ("a_0", "a", "one", [1.0, 0.0], 2)], cols)
    store.add(first, "m1")
    assert ids(store.scroll()) == ["a_0", "a_1", "b_0"]
    store.add(spark.createDataFrame([("a_0", "a", "new", [0.6, 0.8], 0), ("c_0", "c", "", [1.0, 1.0], 0)], cols))
    assert {r.id: r.document for r in store.scroll().collect()} == {"a_0": "new", "a_1": None, "b_0": "two", "c_0": ""}
    assert [(r.id, r.place) for r in store.get(["c_0", "nope", "a_0", "c_0"]).orderBy("place").collect()] == [("c_0", 0), ("a_0", 2)]
    assert ids(store.get(spark.createDataFrame([("b_0",), (None,)], "id string"))) == ["b_0"] and store.get([]).count() == 0
    assert [r.id for r in store.search([0.0, 1.0], 2, model="m1").collect()] == ["b_0", "a_0"]
    assert [r.id for r in store.search([0.0, 1.0], 2, F.col("manual_id") == "c").collect()] == ["c_0"]
    with pytest.raises(L.LibraryError):
        store.search([1.0, 0.0], 1, model="m2")
    with pytest.raises(L.LibraryError):
        store.add(first, "m2")
    store.delete(spark.createDataFrame([("a",), (None,)], "manual_id string"))
    assert ids(store.scroll()) == ["b_0", "c_0"]
    store.optimize()
    store.vacuum()
    assert ids(store.scroll()) == ["b_0", "c_0"] and store.count(F.col("manual_id") == "b") == 1
    store.add(first)
    assert store.count() == 4
    once = add_missing_columns(first)
    assert once.schema.names == CHUNK.names and add_missing_columns(once).collect() == once.collect()
    check_model("m", "m")
    with pytest.raises(L.LibraryError):
        check_model(None, "m")


def test_hash_embedder_and_rows(spark):
    e = E.make("hash", dimension=32)
    v = e.embed_documents(["Spindle guard", "spindle GUARD", "", "ab"])
    assert v.shape == (4, 32) and np.allclose(v[0], v[1]) and np.allclose(np.linalg.norm(v, axis=1), [1, 1, 0, 0])
    assert np.allclose(E.make("hash", dimension=32, prefix="q: ").embed_query("x y"), e.embed_documents(["q: x y"])[0])
    df = spark.createDataFrame([("a", "Spindle guard", 0), ("b", None, 0), ("c", "", 0)], "id string, text string, embedding int").drop("embedding")
    got = {r.id: r.embedding for r in E.embed_rows(df, "hash", dimension=32, budget=3).collect()}
    assert np.allclose(got["a"], v[0]) and got["b"] is None and not any(got["c"])
    assert E.embed_rows(df.filter("false"), "hash").count() == 0
    assert E.query_prefix("", {"query": "find: "}) == "" and E.query_prefix(None, {"query": "find: "}) == "find: " and E.query_prefix(None) == ""
    with pytest.raises(L.LibraryError):
        E.make("oracle")
    with pytest.raises(L.LibraryError):
        E.normalized(np.array([[float("nan"), 1.0]]))


def test_remote_embedder():
    asked, pauses = [], []

    def server(url, body, headers, timeout):
        asked.append(json.loads(body)["input"])
        if len(asked) in (1, 2):
            raise OSError("busy")
        data = [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(asked[-1])]
        return json.dumps({"data": data[::-1]}).encode()

    e = E.RemoteEmbedder("http://h/v1/", "m", batch=2, post=server, pause=pauses.append, prefix="p:")
    v = e.embed_documents(["a", "bb", "ccc"])
    assert pauses == [1.0, 2.0] and [len(x) for x in asked] == [2, 2, 2, 1]
    assert np.allclose(v, E.normalized(np.array([[1.0, 1], [2, 1], [3, 1]]))) and e.dimension == 2
    assert np.allclose(e.embed_query("q"), E.normalized(np.array([[3.0, 1]]))[0]) and asked[-1] == ["p:q"]
    short = E.RemoteEmbedder("http://h", "m", post=lambda *a: b'{"data": []}', pause=pauses.append)
    with pytest.raises(L.LibraryError):
        short.embed_documents(["a"])
    down = E.RemoteEmbedder("http://h", "m", attempts=2, post=lambda *a: (_ for _ in ()).throw(OSError("down")), pause=pauses.append)
    with pytest.raises(OSError):
        down.embed_documents(["a"])
    assert down.attempts == 2 and pauses[-1] == 1.0


def test_archive_forms(spark, tmp_path):
    rows = [{"id": "a", "document": "one", "embedding": [1.0], "metadata": {"page": "1"}}, {"id": "b", "document": None, "embedding": None, "metadata": None}]
    text = "\n".join(map(json.dumps, rows)) + "\n\n"
    for name, content in (("z/chunks.jsonl.zst", zstandard.compress(text.encode())), ("j/chunks.jsonl", text.encode()), ("l/chunks.json", json.dumps({"ids": ["a", "b"], "documents": ["one"], "embeddings": [[1.0]], "metadatas": [{"page": "1"}]}).encode())):
        (tmp_path / name).parent.mkdir()
        (tmp_path / name).write_bytes(content)
        got = {r.id: (r.document, r.embedding, r.metadata) for r in D.chunk_source(spark, str((tmp_path / name).parent)).collect()}
        assert got == {"a": ("one", [1.0], {"page": "1"}), "b": (None, None, None)}
    for folder in ("none", "."):
        with pytest.raises(D.ArchiveError):
            D.chunk_source(spark, str(tmp_path / folder))


def test_sync_and_cascade(spark):
    cols = "id string, relative_path string, file_hash string"
    stored = spark.createDataFrame([("a", "old/a", "1"), ("b", "old/b", "1"), ("c", "old/c", "1"), ("n", "old/n", None)], cols)
    incoming = spark.createDataFrame([("a", "new/a", "1"), ("b", "new/b", "2"), ("d", "new/d", "1"), ("n", "new/n", None)], cols)
    got = {r.id: (r.action, r.relative_path) for r in L.sync_manuals(stored, incoming).collect()}
    assert got == {"a": ("keep", "old/a"), "b": ("rewrite", "new/b"), "c": ("rest", "old/c"), "d": ("insert", "new/d"), "n": ("keep", "old/n")}
    t = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", None)], "id string, manual_key string")
    left = L.without({"x": t, "y": t.filter("false")}, spark.createDataFrame([("b",), (None,)], "manual_key string"))
    assert ids(left["x"]) == ["1", "3"] and left["y"].count() == 0
    figs = spark.createDataFrame([("0a-1", bytearray(b"png"), 3)], "id string, image binary, page int")
    row, image = L.figure(figs, "{0A1}", id_key)
    assert row == {"id": "0a-1", "page": 3} and image == b"png"
    with pytest.raises(L.LibraryError) as e:
        L.figure(figs, "2", id_key)
    assert e.value.kind == "not_found"


def test_tables_and_captions(spark):
    df = spark.createDataFrame([(1, [["a", "b"], ["x|y", "line\n break"], [None], []]), (2, []), (3, None)], "n int, cells array<array<string>>")
    got = {r.n: r.m for r in df.select("n", C.table_markdown(F.col("cells")).alias("m")).collect()}
    assert got == {1: "| a | b |\n| --- | --- |\n| x\\|y | line break |\n|  |  |\n|  |  |", 2: None, 3: None}
    cols = "manual_id string, seq int, label string, text string, caption string, self_ref string, parent_ref string"
    rows = [
        ("m", 0, "picture", None, None, "#/p/0", None), ("m", 1, "caption", "Fig. 1", None, None, "#/p/0"), ("m", 2, "caption", "more", None, None, "#/p/0"), ("m", 3, "table", "|x|", "own", "#/t/0", None),
        ("m", 4, "caption", "Tab.", None, None, "#/t/0"), ("m", 5, "caption", "alone", None, None, "#/p/9"), ("m", 6, "text", "words", None, None, None), ("o", 0, "picture", None, None, "#/p/0", None),
    ]
    got = {(r.manual_id, r.seq): r.caption for r in C.described(spark.createDataFrame(rows, cols)).collect()}
    assert got == {("m", 0): "Fig. 1 more", ("m", 3): "own", ("m", 5): None, ("m", 6): None, ("o", 0): None}


def test_tail_and_stream(spark, tmp_path):
    log, folder = tmp_path / "log.jsonl", tmp_path / "in"
    line = lambda **e: json.dumps(e) + "\n"
    assert P.tail(spark, str(log)) == ([], {"offset": 0, "head": ""})
    log.write_text(line(seq=1, path="a", stage="queued", parts=2, pages=9) + line(seq=2, path="a", stage="converted", part=0) + '{"seq": 3, "pa')
    lines, state = P.tail(spark, str(log))
    assert len(lines) == 2 and P.tail(spark, str(log), state)[0] == []
    with log.open("a") as f:
        f.write('th": "a", "stage": "converting", "pages_done": 4, "part": 1}\n')
    lines, after = P.tail(spark, str(log), state)
    assert [json.loads(x)["seq"] for x in lines] == [3]
    assert [len(P.tail(spark, str(log), after, most=10)[0]), len(P.tail(spark, str(log), None, most=70)[0])] == [0, 1]
    folder.mkdir()
    state = P.feed(spark, str(log), str(folder))
    with log.open("a") as f:
        f.write(line(seq=4, path="a", stage="converted", part=1) + line(seq=5, path="b", stage="failed") + line(seq=6, path="b", stage="done"))
    state = P.feed(spark, str(log), str(folder), state)
    told = {}

    def keep(batch, _):
        told.update({r.path: (r.stage, r.failed_seq, r.pages, r.pages_done) for r in batch.collect()})

    run = lambda: P.stream_states(P.read_log(spark, str(folder))).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    run()
    assert told == {"a": ("converted", None, 9, 4), "b": ("failed", 5, None, 0)}
    log.write_text(line(seq=7, path="b", stage="queued"))  # a new, shorter log
    P.feed(spark, str(log), str(folder), state)
    run()
    assert told["b"] == ("queued", None, None, 0)
