"""Near-duplicate records with small edits.

Method: circulant MinHash.  Two permutations, the second one circularly shifted once per coordinate, give the whole
signature; signatures are cut into bands, records that share a band are candidates, and every candidate pair is verified
by the exact Jaccard similarity of its shingle sets.

Equal sets are one class: only classes are banded, joined and verified, copies come back through a membership table.
Texts are sketched once; the sketches are written, and the only texts read again are those of candidates.

A bucket with more than ``hot`` classes is not paired off: its classes go through an exact prefix filter (two sets of
similarity t share one of their rarest ``n - ceil(t n) + 1`` shingles), so no bucket is capped or dropped.  Hot buckets
are thinned where they are made: of the classes that one task's block of ``block`` sketches has in a bucket, all but
``hot + 1`` leave as members of the crowd at once, and those left tell the receiving task that the bucket is hot.  So a
bucket that holds a third of all classes never meets in one task.

Defined results: null texts, texts under ``least`` words and texts without shingle take no part; repeated rows count
once; an id whose rows hold different texts takes part with each; empty tables give empty results; other columns are
ignored.  With 56 bands of 6 coordinates a pair of similarity 0.7 is missed with a probability of 0.0009,
one of 0.75 with 0.00001.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm import shingles as S


@dataclass(frozen=True)
class Likeness:
    """What is compared and how alike two records must be."""

    threshold: float = 0.8
    words: int = 5  #: words in a shingle; 0: shingles of ``chars`` characters
    chars: int = 3
    least: int = 5  #: words a text must have
    bands: int = 56
    rows: int = 6
    hot: int = 500  #: classes in a bucket beyond which the prefix filter takes over
    block: int = 50_000  #: sketches whose buckets are counted together before the shuffle
    spelled_out: int = 32  #: members up to which a class of copies is spelled out in pairs of records

    def sets(self) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
        """Texts to the distinct shingle hashes of each, in order, and the position of the text each belongs to."""
        if self.words:
            cache = S.WordHashes()
            return lambda texts: S.word_shingles(texts, self.words, self.least, cache)
        return lambda texts: S.char_shingles(texts, self.chars)


def _lists(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.ascontiguousarray(flat).view(np.int64).reshape(-1)))


def _sketching(how: Likeness, what: str):
    """Batches (id, text) to id, cls, number and band keys (``bands``) or to cls and shingles (``sets``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = how.sets()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in S.passes(texts):
                flat, owner = sets(texts[lo:hi])
                if not len(flat):
                    continue
                starts = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1])
                keys = pa.array(S.set_keys(flat, starts).view(np.int64))
                if what == "bands":
                    b = S.bands(S.signatures(flat, starts, how.bands * how.rows), how.rows)
                    n = pa.array(np.diff(np.append(starts, len(flat))).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[starts] + lo)), keys, n, _lists(b, np.arange(len(b) + 1) * how.bands)], ["id", "cls", "n", "bands"])
                else:
                    yield pa.RecordBatch.from_arrays([keys, _lists(flat, np.append(starts, len(flat)))], ["cls", "shingles"])

    return run


_SKETCH = {"bands": "id string, cls bigint, n int, bands array<bigint>", "sets": "cls bigint, shingles array<bigint>"}


def sketches(records: DataFrame, how: Likeness, what: str) -> DataFrame:
    """``records`` (id, text) to what ``what`` names: see ``_sketching``.  cls is the key of a text's shingle set."""
    return records.select(F.col("id").cast("string").alias("id"), "text").dropna().mapInArrow(_sketching(how, what), _SKETCH[what])


def _thinned(how: Likeness):
    """Sketches (cls, n, bands) to rows (bucket, cls, n); a bucket's classes beyond ``hot + 1`` in a block have no bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            cls = np.concatenate([b.column(0).to_numpy() for b in held])
            n = np.concatenate([b.column(1).to_numpy() for b in held])
            keys = np.concatenate([b.column(2).flatten().to_numpy() for b in held])
            # Copies in one block need to be told only once.
            _, first = np.unique(cls, return_index=True)
            keys = keys.reshape(len(cls), how.bands)[first].reshape(-1)
            cls, n = np.repeat(cls[first], how.bands), np.repeat(n[first], how.bands)
            order = np.argsort(keys, kind="stable")
            ordered = keys[order]
            starts = np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1])
            sizes = np.diff(np.append(starts, len(ordered)))
            place = np.empty(len(keys), np.int64)
            place[order] = np.arange(len(ordered)) - np.repeat(starts, sizes)
            return pa.RecordBatch.from_arrays([pa.array(keys, mask=place > how.hot), pa.array(cls), pa.array(n)], ["bucket", "cls", "n"])

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= how.block:
                yield block(held)
                held, rows = [], 0
        if rows:
            yield block(held)

    return run


class _Pairs:
    """Turns sorted (bucket, cls, n) rows, batch by batch, into candidate pairs, or into the members of hot buckets."""

    def __init__(self, how: Likeness) -> None:
        self.how, self.open_hot = how, None
        self.held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]

    def take(self, rows: list[np.ndarray], last: bool) -> pa.RecordBatch | None:
        """Pairs of all buckets that are complete; the open one is kept, unless it is hot: then its members are passed on."""
        b, c, n = (np.concatenate(x) for x in zip(self.held, rows))
        if len(b):
            # Copies from different tasks are neighbours here.
            new = np.concatenate([[True], (b[1:] != b[:-1]) | (c[1:] != c[:-1])])
            b, c, n = b[new], c[new], n[new]
        left, right, members = [], [], []
        if len(b):
            starts = np.concatenate([[0], np.flatnonzero(b[1:] != b[:-1]) + 1])
            sizes = np.diff(np.append(starts, len(b)))
            done = len(starts) if last else len(starts) - 1
            several = np.flatnonzero(sizes[:done] > 1)
            if done and self.open_hot is not None and b[0] == self.open_hot:
                several = np.union1d([0], several)
            for s, k in zip(starts[several], sizes[several]):
                if k > self.how.hot or (self.open_hot is not None and b[s] == self.open_hot):
                    members.append(c[s : s + k])
                    continue
                i, j = np.triu_indices(k, 1)
                # Sets whose sizes differ too much can't be alike.
                near = np.minimum(n[s + i], n[s + j]) >= self.how.threshold * np.maximum(n[s + i], n[s + j])
                left.append(c[s + i[near]])
                right.append(c[s + j[near]])
            if not last:
                s = starts[-1]
                if sizes[-1] > self.how.hot or (self.open_hot is not None and b[s] == self.open_hot):
                    self.open_hot = b[s]
                    members.append(c[s:])
                    s = len(b)
                b, c, n = b[s:], c[s:], n[s:]
        self.held = [b, c, n]
        if not left and not members:
            return None
        lo = np.concatenate(left + members)
        hi = np.concatenate(right) if right else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(lo), pa.concat_arrays([pa.array(hi), pa.nulls(len(lo) - len(hi), pa.int64())])], ["a", "b"])


def _paired(how: Likeness):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Pairs(how)
        for batch in batches:
            if (got := state.take([batch.column(k).to_numpy() for k in range(3)], False)) is not None:
                yield got
        if (got := state.take([x[:0] for x in state.held], True)) is not None:
            yield got

    return run


def _candidates(sketched: DataFrame, how: Likeness) -> DataFrame:
    """Sketches (cls, n, bands) to pairs a < b of one bucket, or (member, null) for members of a hot one."""
    rows = sketched.select("cls", "n", "bands").mapInArrow(_thinned(how), "bucket bigint, cls bigint, n int")
    once = rows.filter("bucket is not null").repartition("bucket").sortWithinPartitions("bucket", "cls")
    crowd = rows.filter("bucket is null").select(F.col("cls").alias("a"), F.lit(None).cast("bigint").alias("b"))
    return once.mapInArrow(_paired(how), "a bigint, b bigint").unionByName(crowd).distinct()


def _verified(how: Likeness):
    """Rows (a, ta, b, tb) to a, b and the exact Jaccard similarity of the texts' sets, if it is enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = how.sets()
        for batch in batches:
            texts = list(dict.fromkeys(batch.column("ta").to_pylist() + batch.column("tb").to_pylist()))
            found: dict[str, np.ndarray] = {}
            for lo, hi in S.passes(texts):
                flat, owner = sets(texts[lo:hi])
                edges = np.searchsorted(owner, np.arange(hi - lo + 1))
                found |= {t: flat[x:y] for t, x, y in zip(texts[lo:hi], edges, edges[1:])}
            keys = dict(zip(found, S.set_keys(np.concatenate([*found.values()]), np.cumsum([0, *map(len, found.values())])[:-1]).view(np.int64).tolist())) if found else {}
            rows = []
            for a, ta, b, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "ta", "b", "tb"))):
                if keys[ta] == a and keys[tb] == b:  # an id with several texts brings them all
                    sa, sb = found[ta], found[tb]
                    both = len(np.intersect1d(sa, sb, assume_unique=True))
                    if both >= how.threshold * (len(sa) + len(sb) - both):
                        rows.append((a, b, both / (len(sa) + len(sb) - both)))
            cols = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "jaccard"])

    return run


def _prefix_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """Exact candidates among ``sets`` (cls, shingles): pairs of near sizes that share one of their rarest shingles."""
    single = sets.select("cls", F.explode("shingles").alias("s"))
    df = single.groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    n = F.size("ranked")
    ranked = single.join(df, "s").groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("ranked"))
    rare = F.slice("ranked", 1, n - F.ceil(F.lit(threshold) * n).cast("int") + 1)
    # Shingles that no other set has join nothing.
    prefix = ranked.select("cls", n.alias("n"), F.explode(F.filter(rare, lambda r: r["df"] > 1)).alias("r")).select("cls", "n", F.col("r.s").alias("bucket"))
    other = prefix.select(F.col("cls").alias("b"), F.col("n").alias("m"), "bucket")
    near = (F.col("a") < F.col("b")) & (F.least("n", "m") >= threshold * F.greatest("n", "m"))
    return prefix.select(F.col("cls").alias("a"), "n", "bucket").join(other, "bucket").filter(near).select("a", "b").distinct()


def similar_classes(records: DataFrame, how: Likeness, cut) -> tuple[DataFrame, DataFrame]:
    """``records`` (id, text) to the membership table (cls, id) and the verified pairs of classes (a, b, jaccard), a < b."""
    sketched = cut(sketches(records, how, "bands"))
    members = sketched.select("cls", "id").distinct()
    candidates = cut(_candidates(sketched, how))
    heads = members.groupBy("cls").agg(F.min("id").alias("id"))
    texts = records.select(F.col("id").cast("string").alias("id"), "text").dropna()
    if candidates.filter("b is null").limit(1).count():
        crowd = candidates.filter("b is null").select(F.col("a").alias("cls")).distinct()
        crowded = sketches(texts.join(heads.join(crowd, "cls", "left_semi").select("id"), "id", "left_semi"), how, "sets")
        crowded = cut(crowded.join(crowd, "cls", "left_semi").dropDuplicates(["cls"]))
        candidates = cut(candidates.filter("b is not null").unionByName(_prefix_pairs(crowded, how.threshold)).distinct())
    wanted = candidates.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    # Texts travel, not sets: they compress.
    worded = cut(texts.join(heads.join(wanted, "cls", "left_semi"), "id").select("cls", "text"))
    left, right = worded.select(F.col("cls").alias("a"), F.col("text").alias("ta")), worded.select(F.col("cls").alias("b"), F.col("text").alias("tb"))
    pairs = candidates.join(left, "a").join(right, "b").select("a", "ta", "b", "tb").mapInArrow(_verified(how), "a bigint, b bigint, jaccard double")
    return members, cut(pairs.distinct())


def similar_records(records: DataFrame, how: Likeness, cut) -> DataFrame:
    """Pairs of records id_a < id_b.

    A class of up to ``spelled_out`` copies is spelled out: every pair inside it and with every member of a similar class.
    A larger class is given by its smallest id: one pair with each other member, and that id for pairs with other classes.
    """
    members, pairs = similar_classes(records, how, cut)
    sized = members.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("head"))
    several = sized.filter("n > 1")
    large = several.filter(F.col("n") > how.spelled_out)
    stars = members.join(large, "cls").filter("id <> head").select(F.col("head").alias("x"), F.col("id").alias("y"))
    shown = members.join(large.select("cls"), "cls", "left_anti").unionByName(large.select("cls", F.col("head").alias("id")))
    small = members.join(several.filter(F.col("n") <= how.spelled_out).select("cls"), "cls", "left_semi")
    inside = small.select("cls", F.col("id").alias("x")).join(small.select("cls", F.col("id").alias("y")), "cls").filter("x < y").select("x", "y")
    across = pairs.join(shown.select(F.col("cls").alias("a"), F.col("id").alias("x")), "a").join(shown.select(F.col("cls").alias("b"), F.col("id").alias("y")), "b").select("x", "y")
    return (
        stars.unionByName(inside)
        .unionByName(across)
        .filter("x <> y")
        .select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
        .distinct()
    )


def groups(records: DataFrame, how: Likeness, cut, rounds: int = 60) -> DataFrame:
    """One row per record: id, group_id (smallest id of all records linked to it, directly or not), links, copies.

    links counts the similar classes of the record's class, copies its other members.  Groups are found by minimum
    label propagation with shortcuts over classes; every round is written out, and the rounds end when nothing changes.
    """
    members, pairs = similar_classes(records, how, cut)
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    heads = members.groupBy("cls").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n"))
    named = cut(both.groupBy("a").agg(F.count(F.lit(1)).alias("links"), F.least(F.col("a"), F.min("b")).alias("label")))
    labels = named.select("a", "label")
    for _ in range(rounds):
        # The neighbours' least label, then the label's own label: chains halve in every round.
        near = both.join(labels.select(F.col("a").alias("b"), F.col("label").alias("l")), "b").groupBy("a").agg(F.min("l").alias("l"))
        step = labels.join(near, "a").select("a", F.least("label", "l").alias("new"), "label")
        jump = step.select(F.col("a").alias("new"), F.col("new").alias("far"))
        after = cut(step.join(jump, "new", "left").select("a", F.least("new", "far").alias("new"), "label"))
        labels = after.select("a", F.col("new").alias("label"))
        if not after.filter("new <> label").limit(1).count():
            break
    else:
        raise RuntimeError("groups didn't settle; raise rounds")
    whole = heads.join(labels.select(F.col("a").alias("cls"), "label"), "cls", "left").select("cls", "head", "n", F.coalesce("label", "cls").alias("label"))
    first = whole.groupBy("label").agg(F.min("head").alias("group_id"))
    per_class = whole.join(first, "label").join(named.select(F.col("a").alias("cls"), "links"), "cls", "left")
    return members.join(per_class, "cls").groupBy("id").agg(
        F.min("group_id").alias("group_id"), F.sum(F.coalesce("links", F.lit(0))).alias("links"), F.sum(F.col("n") - 1).alias("copies")
    )
