"""Evaluation texts that leak into training text.

Method: spaced-seed hashing.  Texts and items are reduced to their letters and numbers.  A mask compares two blocks of
characters and ignores those between them.  Items are hashed at every position, texts at every ``step``-th, where a block
is one step long: an overlap then holds whole blocks of the text, substitutions spoil one each, and so many stay whole that
two of them are at most ``len(masks)`` blocks apart.  ``Seeds`` derives block and masks from the lengths and the share, so
every overlap, exact or near, is hit; none is left to chance.  Hashes are joined, and every diagonal with a hit is
verified over its whole length: exactly for common runs, and with a tolerance for substitutions for near ones.

The items' windows are counted.  Up to ``broadcast_windows`` of them the items that have any are broadcast, which bounds
their letters as well, and the join takes place inside the scan: no hash of the corpus is ever shuffled.  Beyond that
both sides are joined by a shuffle on the hash, and only hits are joined with their texts.

Defined results: null or blank texts and items match nothing; items shorter than ``run`` letters match nothing exactly;
copies of a document are documents of their own; repeated rows count once; an item id with several texts holds each of
them; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.shingles import mix64

_REST = re.compile(r"[\W_]+")


@dataclass(frozen=True)
class Seeds:
    """Lengths and share, and the masks that follow from them.  A mask is a string of 1 (compared) and 0 (ignored)."""

    run: int = 40  #: characters of an exact overlap
    similar: float = 0.9  #: share of equal characters in a substitution-tolerant overlap
    near_run: int = 60  #: characters of a substitution-tolerant overlap
    broadcast_windows: int = 2_000_000

    def _gap(self, block: int) -> int:
        """Blocks from one whole block to the next in the worst overlap; 0 if one may hold less than two whole blocks.

        Overlaps of twice ``near_run`` and more hold a shorter one: a half of theirs has the share, too.
        """
        gap = 1
        for length, wrong in [(self.run, 0)] + [(n, int((1 - self.similar) * n + 1e-9)) for n in range(self.near_run, 2 * self.near_run)]:
            blocks = (length - block + 1) // block
            if blocks - wrong < 2:
                return 0
            gap = max(gap, (blocks - 1) // (blocks - wrong - 1))
        return gap

    @cached_property
    def step(self) -> int:
        """Characters of a block: as many as always leave two whole."""
        for block in range(self.run, 0, -1):
            if self._gap(block):
                return block
        raise ValueError("no two blocks stay whole in an overlap of these lengths and this share")

    @cached_property
    def masks(self) -> tuple[str, ...]:
        return tuple("1" * self.step + "0" * (self.step * (d - 1)) + "1" * self.step for d in range(1, self._gap(self.step) + 1))

    @property
    def span(self) -> int:
        """Characters of the shortest mask."""
        return 2 * self.step


def letters(text: str) -> str:
    """``text`` after compatibility normalisation and lower-casing, without anything but letters and numbers."""
    return _REST.sub("", unicodedata.normalize("NFKC", text).lower())


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


def hashes(codes: np.ndarray, at: np.ndarray, ends: np.ndarray, how: Seeds) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all masks at the positions ``at``, whose texts end at ``ends``, and for each the number of its position in ``at``.

    A mask that would leave its text gives none.  A block must end within ``codes``.
    """
    wide = codes.astype(np.uint64)

    def block(start: np.ndarray) -> np.ndarray:
        h = np.zeros(len(start), np.uint64)
        for i in range(how.step):
            h = h * np.uint64(0x9E3779B97F4A7C15) + wide[start + i]
            h ^= h >> np.uint64(29)
        return h

    first, out, where = block(at), [], []
    for m, mask in enumerate(how.masks):
        fits = np.flatnonzero(at + len(mask) <= ends)
        second = block(at[fits] + len(mask) - how.step)
        out.append(mix64((first[fits] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(m + 1)) ^ mix64(second)))
        where.append(fits)
    return np.concatenate(out), np.concatenate(where)


def _windows(rows: DataFrame, how: Seeds, step: int) -> DataFrame:
    """``rows`` (id, text) to id, pos and hash of every ``step``-th window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                codes = _codes(letters(text.as_py()))
                at = np.arange(0, len(codes) - how.span + 1, step)
                if len(at):
                    h, where = hashes(codes, at, np.full(len(at), len(codes)), how)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), id_)), pa.array(at[where].astype(np.int32)), pa.array(h.view(np.int64))], ["id", "pos", "hash"])

    return rows.select("id", "text").dropna().mapInArrow(run, "id bigint, pos int, hash bigint")


def _spoken(how: Seeds):
    """Rows (id, text) to id and letters of those that are long enough for a mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spoken = [letters(t) for t in batch.column(1).to_pylist()]
            keep = [i for i, s in enumerate(spoken) if len(s) >= how.span]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array([spoken[i] for i in keep], pa.string())], ["id", "letters"])

    return run


def _index(texts: list[np.ndarray], how: Seeds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of ``texts``, sorted by hash: hashes, numbers of the texts, positions."""
    parts = []
    for n, codes in enumerate(texts):
        at = np.arange(len(codes) - how.span + 1)
        h, where = hashes(codes, at, np.full(len(at), len(codes)), how)
        parts.append((h, np.full(len(h), n), at[where]))
    keys, owner, place = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    order = np.argsort(keys, kind="stable")
    return keys[order], owner[order], place[order]


def _exact_length(same: np.ndarray) -> int:
    """Length of the longest run of equal characters on a diagonal."""
    edges = np.concatenate([[-1], np.flatnonzero(~same), [len(same)]])
    return int(np.diff(edges).max() - 1)


def _near_length(same: np.ndarray, share: float) -> int:
    """Length of the longest stretch of a diagonal in which ``share`` of the characters agree."""
    total = np.concatenate([[0.0], np.cumsum(np.where(same, 1 - share, -share))])
    # From every start to the last end that isn't below it: the greatest total from an end on never rises.
    rest = np.maximum.accumulate(total[::-1])[::-1]
    ends = np.searchsorted(-rest, -total + 1e-9, "right") - 1
    return int((ends - np.arange(len(total))).max())


def overlaps(text: np.ndarray, at: np.ndarray, hit_items: np.ndarray, hit_pos: np.ndarray, items: dict[int, np.ndarray], how: Seeds) -> list[tuple[int, int, int]]:
    """Verified hits of one text as (item, longest exact run, longest near run); every diagonal is verified once, as a whole."""
    found: dict[int, list[int]] = {}
    for item, d in set(zip(hit_items.tolist(), (hit_pos - at).tolist())):
        other = items[item]
        lo, hi = max(0, -d), min(len(text), len(other) - d)
        if hi - lo < min(how.run, how.near_run):
            continue
        same = text[lo:hi] == other[lo + d : hi + d]
        best = found.setdefault(item, [0, 0])
        best[0] = max(best[0], _exact_length(same))
        best[1] = max(best[1], _near_length(same, how.similar))
    return [(item, e, n) for item, (e, n) in found.items() if e >= how.run or n >= how.near_run]


_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("exact_chars", pa.int32()), ("near_chars", pa.int32())])


def _scan(shared, how: Seeds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owner, place, items, names = shared.value
        # The first 24 bits of all keys: most hashes need no search.
        known = np.zeros(1 << 24, bool)
        known[(keys >> np.uint64(40)).astype(np.int64)] = True
        for batch in batches:
            ids, texts = [], []
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = letters(text)
                if len(s) >= how.span:
                    ids.append(id_)
                    texts.append(s)
            if not ids:
                continue
            # All texts of the batch are hashed together; windows never cross from one text into the next.
            codes = _codes("".join(texts))
            sizes = np.array([len(t) for t in texts])
            base = np.cumsum(sizes) - sizes
            counts = (sizes - how.span) // how.step + 1
            doc = np.repeat(np.arange(len(texts)), counts)
            at = base[doc] + how.step * (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts))
            h, where = hashes(codes, at, (base + sizes)[doc], how)
            rows = []
            hit = np.flatnonzero(known[(h >> np.uint64(40)).astype(np.int64)])
            h, where = h[hit], where[hit]
            lo, hi = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
            n = hi - lo
            pick = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            where = np.repeat(where, n)
            order = np.argsort(doc[where], kind="stable")
            where, pick = where[order], pick[order]
            cuts = np.flatnonzero(np.diff(doc[where])) + 1 if len(where) else []
            for part, sel in zip(np.split(where, cuts), np.split(pick, cuts)):
                if len(part):
                    d = int(doc[part[0]])
                    own = codes[base[d] : base[d] + sizes[d]]
                    rows += [(ids[d], names[r[0]], *r[1:]) for r in overlaps(own, at[part] - base[d], owner[sel], place[sel], items, how)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _OUT.types)], schema=_OUT)

    return run


def _verify(how: Seeds):
    """Rows (doc_id, item_id, text, item, at: array of pos and item pos) to verified overlaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                text, item = _codes(letters(r["text"])), _codes(letters(r["item"]))
                hits = np.array([(x["pos"], x["item_pos"]) for x in r["hits"]])
                for _, e, n in overlaps(text, hits[:, 0], np.zeros(len(hits), int), hits[:, 1], {0: item}, how):
                    rows.append((r["doc_id"], r["item_id"], e, n))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _OUT.types)], schema=_OUT)

    return run


def leaks(documents: DataFrame, items: DataFrame, how: Seeds = Seeds()) -> DataFrame:
    """``documents`` and ``items`` (id, text) to doc_id, item_id, exact_chars and near_chars: the longest common run, and the
    longest overlap of which a share of ``how.similar`` agrees, of every pair with one of them long enough."""
    spark = documents.sparkSession
    docs = documents.select(F.col("id").cast("bigint"), "text").dropna()
    tests = items.select(F.col("id").cast("bigint"), "text").dropna().distinct()
    schema = "doc_id bigint, item_id bigint, exact_chars int, near_chars int"
    spoken = tests.mapInArrow(_spoken(how), "id bigint, letters string").distinct()
    count = spoken.agg(F.sum((F.length("letters") - how.span + 1) * len(how.masks))).first()[0] or 0
    if count <= how.broadcast_windows:
        # Every item here has a window for each letter but the last ones of the shortest mask: the count bounds the letters.
        rows = spoken.collect()
        texts = [_codes(r["letters"]) for r in rows]
        keys, owner, place = _index(texts, how)
        shared = spark.sparkContext.broadcast((keys, owner, place, dict(enumerate(texts)), [r["id"] for r in rows]))
        found = docs.mapInArrow(_scan(shared, how), schema)
        return found.groupBy("doc_id", "item_id").agg(F.max("exact_chars").alias("exact_chars"), F.max("near_chars").alias("near_chars"))
    hashed = _windows(tests, how, 1)
    test_hits = hashed.select(F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), "hash")
    hits = _windows(docs, how, how.step).join(test_hits, "hash")
    # One hit per diagonal is enough to verify it.
    diagonals = hits.groupBy("id", "item_id", (F.col("item_pos") - F.col("pos")).alias("d")).agg(F.min(F.struct("pos", "item_pos")).alias("hit"))
    pairs = diagonals.groupBy(F.col("id").alias("doc_id"), "item_id").agg(F.collect_list("hit").alias("hits"))
    full = pairs.join(docs.select(F.col("id").alias("doc_id"), "text"), "doc_id").join(tests.select(F.col("id").alias("item_id"), F.col("text").alias("item")), "item_id")
    return full.mapInArrow(_verify(how), schema).groupBy("doc_id", "item_id").agg(F.max("exact_chars").alias("exact_chars"), F.max("near_chars").alias("near_chars"))
