"""Filling fixed-capacity containers with items.

Method: lexical retrieval packing.  Texts are tokenised once; their token ids are also the terms of a BM25 inverted index,
which is sharded: every shard of some ``shard_tokens`` tokens indexes its own items, with document frequencies and lengths
of the whole corpus (at most 65,536 numbers, as the vocabulary is bounded).  Shards are made of items alike: items are
ranged by their three terms of most weight, so a seed's neighbours in the whole corpus tend to lie in its own shard.  Ranges
split wherever they must, also inside a crowd of copies, and a task fills one shard after the other.

In a shard the longest unused item is the seed of a container; the index returns its best unused neighbours, and every one
that fits is put in, the longest first, as short items are what fills gaps later.  What room is left goes to the longest
unused items that fit, so little stays empty.  A seed asks with its ``query_terms`` terms of most weight and gets its
``neighbours`` best answers: those are the top of a ranking, and no item is lost by them, as all others remain to be seeds,
neighbours or fillings.  Containers that a shard leaves under ``full`` are taken apart again and packed in a next round
over fewer shards, until one shard is left.

An item over the capacity is cut into parts of exactly the capacity, which fill containers of their own, and a rest.

Defined results: null texts and texts without tokens get a row with 0 tokens and no container; repeated ids are items of
their own, numbered by ``part`` only within their text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import os
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Packing:
    capacity: int = 4096
    tokenizers: str = "/opt/tokenizers"  #: folder of the public vocabulary files
    vocabulary: str = "byte_bpe_50k.tiktoken"
    shard_tokens: int = 600_000
    query_terms: int = 48  #: the seed's terms of most weight that make its query
    neighbours: int = 32  #: best neighbours of a seed, of which the longest that fit are put in first
    partitions: int = 20_000  #: most tasks of a round; each fills as many shards as its range has
    full: float = 0.97
    k1: float = 1.2
    b: float = 0.75


#: The split pattern that the vocabulary was made with (a fixed value of the public tokenizer).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODERS: dict[str, object] = {}
#: Characters after which a longer text may be cut for tokenising, which keeps the time linear.
_RUN = 200_000
#: No token of the pattern spans the place between another character and white space, and none depends on what lies beyond it.
_BREAK = re.compile(r"(?<=\S)(?=\s)")


def encoder(how: Packing):
    """The tokenizer, loaded once per worker."""
    path = os.path.join(how.tokenizers, how.vocabulary)
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding(how.vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_ids(text: str, enc) -> list[int]:
    """Tokens of the whole text; long ones are cut only where no token can be cut."""
    out: list[int] = []
    start = 0
    while len(text) - start > _RUN and (m := _BREAK.search(text, start + _RUN)):
        out += enc.encode_ordinary(text[start : m.start()])
        start = m.start()
    return out + enc.encode_ordinary(text[start:] if start else text)


_ITEM = "id bigint, part int, n_parts int, tokens int, terms binary"


def _tokenised(how: Packing):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(how)
        for batch in batches:
            cols: list[list] = [[] for _ in range(5)]
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array(token_ids(text or "", enc), np.uint16)
                n = max(1, -(-len(ids) // how.capacity))
                for p in range(n):
                    part = ids[p * how.capacity : (p + 1) * how.capacity]
                    for col, v in zip(cols, (id_, p, n, len(part), part.tobytes())):
                        col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["id", "part", "n_parts", "tokens", "terms"]
            )

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for raw in batch.column(0):
            df[np.unique(np.frombuffer(raw.as_buffer(), np.uint16))] += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["term", "df"])


def fill(sizes: np.ndarray, terms: list[np.ndarray], idf: np.ndarray, mean: float, how: Packing) -> list[list[int]]:
    """Positions of the items of one shard, container by container."""
    n = len(sizes)
    uniq, counts = zip(*(np.unique(t, return_counts=True) for t in terms)) if n else ((), ())
    length = np.array([len(u) for u in uniq])
    doc = np.repeat(np.arange(n), length)
    term = np.concatenate(uniq) if n else np.zeros(0, np.uint16)
    tf = np.concatenate(counts).astype(float) if n else np.zeros(0)
    norm = how.k1 * (1 - how.b + how.b * sizes[doc] / max(mean, 1e-9))
    weight = idf[term] * tf * (how.k1 + 1) / (tf + norm)
    by_term = np.argsort(term, kind="stable")
    post_doc, post_weight = doc[by_term], weight[by_term]
    bounds = np.searchsorted(term[by_term], np.arange(len(idf) + 1))
    ends = np.concatenate([[0], np.cumsum(length)])
    order = np.lexsort((np.arange(n), sizes))
    alive = [(int(sizes[i]), int(i)) for i in order]  # unused items, shortest first
    used = np.zeros(n, bool)
    containers: list[list[int]] = []

    def take(k: int) -> int:
        size, i = alive.pop(k)
        used[i] = True
        return i

    while alive:
        seed = take(len(alive) - 1)
        held, room = [seed], how.capacity - int(sizes[seed])
        if alive and room >= alive[0][0]:
            mine = slice(ends[seed], ends[seed + 1])
            query = term[mine][np.argsort(-weight[mine], kind="stable")[: how.query_terms]]
            score = np.zeros(n)
            for t in query:
                score[post_doc[bounds[t] : bounds[t + 1]]] += post_weight[bounds[t] : bounds[t + 1]]
            score[used | (sizes > room)] = 0
            near = np.flatnonzero(score > 0)
            near = near[np.argsort(-score[near], kind="stable")[: how.neighbours]]
            for i in near[np.argsort(-sizes[near], kind="stable")]:
                size = int(sizes[i])
                if size <= room:
                    take(bisect_right(alive, (size, int(i))) - 1)
                    held.append(int(i))
                    room -= size
                    if not alive or room < alive[0][0]:
                        break
        while alive and room >= alive[0][0]:
            i = take(bisect_right(alive, (room, n)) - 1)
            held.append(i)
            room -= int(sizes[i])
        containers.append(held)
    return containers


def _likeness(how: Packing, stats):
    """Items with their three terms of most weight, most first, as a key: what is alike is near in its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, mean = stats.value
        for batch in batches:
            keys = []
            for raw in batch.column("terms").to_pylist():
                term, tf = np.unique(np.frombuffer(raw, np.uint16), return_counts=True)
                weight = idf[term] * tf * (how.k1 + 1) / (tf + how.k1 * (1 - how.b + how.b * len(raw) / 2 / max(mean, 1e-9)))
                keys.append(term[np.argsort(-weight, kind="stable")[:3]].astype(">u2").tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "part", "n_parts", "tokens", "terms")), pa.array(keys, pa.binary())], ["id", "part", "n_parts", "tokens", "terms", "near"])

    return run


_PLACED = "container_id string, container_tokens int, id bigint, part int, n_parts int, tokens int, terms binary"


def _packed(how: Packing, stats, name: str, last: bool):
    """Ranges of items to placed items, shard by shard; underfilled containers have no id unless ``last``."""

    def shard(k: str, held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        idf, mean = stats.value
        t = pa.Table.from_batches(held)
        sizes = t.column("tokens").to_numpy()
        terms = [np.frombuffer(x, np.uint16) for x in t.column("terms").to_pylist()]
        order, label, total = [], [], []
        for c, one in enumerate(fill(sizes, terms, idf, mean, how)):
            tokens = int(sizes[one].sum())
            done = last or tokens >= how.full * how.capacity
            order += one
            label += [f"{name}-{k}-{c}" if done else None] * len(one)
            total += [tokens] * len(one)
        rows = t.take(pa.array(order, pa.int64()))
        done = np.array([x is not None for x in label], bool)
        kept = pa.array([None if d else x for d, x in zip(done, rows.column("terms").to_pylist())], pa.binary())
        cols = [pa.array(label, pa.string()), pa.array(total, pa.int32())] + [rows.column(c).combine_chunks() for c in ("id", "part", "n_parts", "tokens")] + [kept]
        return pa.Table.from_arrays(cols, ["container_id", "container_tokens", "id", "part", "n_parts", "tokens", "terms"]).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        task, k, tokens = context.partitionId() if context else 0, 0, 0
        held: list[pa.RecordBatch] = []
        # A range that is little over a shard stays one.
        most = how.shard_tokens + how.shard_tokens // 2
        for batch in batches:
            sums = np.cumsum(batch.column("tokens").to_numpy().astype(np.int64))
            start = 0
            while start < batch.num_rows:
                done = int(sums[start - 1]) if start else 0
                stop = max(start + (not held), int(np.searchsorted(sums, most - tokens + done, "right")))
                if stop > start:
                    held.append(batch.slice(start, stop - start))
                    tokens += int(sums[stop - 1]) - done
                if stop < batch.num_rows:
                    yield from shard(f"{task}-{k}", held)
                    held, tokens, k = [], 0, k + 1
                start = stop
        if held:
            yield from shard(f"{task}-{k}", held)

    return run


def pack(documents: DataFrame, cut, how: Packing = Packing(), rounds: int = 6) -> DataFrame:
    """``documents`` (id, text) to container_id, container_tokens, id, part, n_parts, tokens."""
    spark = documents.sparkSession
    items = cut(documents.select(F.col("id").cast("bigint"), "text").mapInArrow(_tokenised(how), _ITEM))
    columns = ["container_id", "container_tokens", "id", "part", "n_parts", "tokens"]
    empty = items.filter("tokens = 0").select(F.lit(None).cast("string").alias("container_id"), F.lit(0).alias("container_tokens"), "id", "part", "n_parts", "tokens")
    whole = items.filter(F.col("tokens") == how.capacity).select(
        F.concat(F.lit("whole-"), "id", F.lit("-"), "part").alias("container_id"), F.col("tokens").alias("container_tokens"), "id", "part", "n_parts", "tokens"
    )
    rest = items.filter((F.col("tokens") > 0) & (F.col("tokens") < how.capacity))
    done = empty.unionByName(whole)
    n, total = rest.agg(F.count(F.lit(1)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    if not n:
        return done
    df = np.zeros(1 << 16)
    for r in rest.select("terms").mapInArrow(_frequencies, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    stats = spark.sparkContext.broadcast((np.log1p((n - df + 0.5) / (df + 0.5)), total / n))
    for r in range(rounds):
        shards = max(1, -(-total // how.shard_tokens))
        last = shards == 1 or r == rounds - 1
        keyed = rest.mapInArrow(_likeness(how, stats), f"{_ITEM}, near binary")
        if shards > 1:
            keyed = keyed.repartitionByRange(int(min(shards, how.partitions)), "near", F.xxhash64("id", "part"), "id", "part")
        else:
            keyed = keyed.coalesce(1)
        placed = keyed.sortWithinPartitions("near", F.xxhash64("id", "part"), "id", "part").drop("near")
        placed = cut(placed.mapInArrow(_packed(how, stats, f"r{r}", last), _PLACED))
        done = done.unionByName(placed.filter(F.col("container_id").isNotNull()).select(*columns))
        if last:
            break
        rest = placed.filter(F.col("container_id").isNull()).select("id", "part", "n_parts", "tokens", "terms")
        n, total = rest.agg(F.count(F.lit(1)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
        if not n:
            break
    return done
