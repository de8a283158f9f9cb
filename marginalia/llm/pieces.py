"""Splitting oversized items at natural boundaries.

Method: recursive bisection.  A text over the limit is cut at the strongest boundary near its midpoint; halves that still
exceed the limit minus the overlap are cut again; then every piece but the first is given the end of the one before.

Boundaries, from strong to weak: blank line, line break, sentence end (。！？ or . ! ? before white space), clause mark,
white space, and the place before 。！？.  Only a run without any boundary is cut hard.

Every joint repeats exactly the stated number of characters, with two exceptions: a piece that is shorter is repeated as
a whole, and a run longer than the limit minus the overlap but not than the limit stays whole beside what room that
leaves.  White space between pieces counts towards the limit and is shortened where it alone would exceed it.

Defined results: null texts give nothing; white space at both ends never counts; texts within the limit are one piece;
empty texts are one empty piece; repeated rows of an id count once per distinct text; other columns are ignored.
Positions are in code points of the text without the white space at its ends.  Crumbs of under an eighth of the room join a
neighbour they fit beside.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.identifiers import WS_CHARS, ws_trim

_WS = re.escape(WS_CHARS)
#: Boundary patterns with their strength; a cut falls at the end of the match.
_BOUNDARIES = [
    (re.compile("\\n[^\\S\\n]*\\n\\s*"), 6),
    (re.compile("\\r?\\n"), 5),
    (re.compile(f"[.!?][)\\]\"'”’»]*(?=[{_WS}])|[。！？]+[」』）”]*"), 4),
    (re.compile(f"[,;:][{_WS}]|[、，；：]"), 3),
    (re.compile(f"[{_WS}]+"), 2),
]
_BEFORE_MARK = re.compile("(?=[。！？])")
_SOFT = re.compile(f"[{_WS}。！？]")
#: A boundary this much weaker loses against one this share of the length farther from the midpoint.
_REACH = 0.5
#: Own texts under this part of the room are crumbs.
_CRUMB = 8


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which ``text`` may be cut, and the strength of each."""
    strength: dict[int, int] = {m.start(): 1 for m in _BEFORE_MARK.finditer(text)}
    for pattern, s in reversed(_BOUNDARIES):
        for m in pattern.finditer(text):
            # Clause and other marks that stand inside a run of letters are only natural if white space or a final mark is near.
            if s != 3 or _SOFT.match(text[m.end() - 1]):
                strength[m.end()] = s
            if s == 2:
                strength.setdefault(m.start(), 2)
    at = np.array(sorted(k for k in strength if 0 < k < len(text)), np.int64)
    return at, np.array([strength[int(k)] for k in at], np.int64)


def _trimmed(text: str, lo: int, hi: int) -> tuple[int, int]:
    while lo < hi and text[lo] in WS_CHARS:
        lo += 1
    while hi > lo and text[hi - 1] in WS_CHARS:
        hi -= 1
    return lo, hi


@dataclass(frozen=True)
class Piece:
    """One piece: its own text stands from ``own`` to ``end``; before it, ``overlap`` characters repeat the end of the piece before."""

    own: int
    end: int
    overlap: int
    hard: bool  #: whether its own text begins at a hard cut
    text: str


def _spans(text: str, limit: int, room: int) -> list[tuple[int, int, bool]]:
    """Own texts of the pieces as (start, end, whether the start is a hard cut), in order, by recursive bisection."""
    at, strength = boundaries(text)
    spans: list[tuple[int, int, bool]] = []
    todo = [(0, len(text), False)]
    while todo:
        lo, hi, hard = todo.pop()
        lo, hi = _trimmed(text, lo, hi)
        if hi - lo <= room:
            if hi > lo or not text:
                spans.append((lo, hi, hard))
            continue
        i, j = np.searchsorted(at, [lo + 1, hi])
        if i == j:
            if hi - lo <= limit:
                spans.append((lo, hi, hard))
                continue
            # Nothing to cut at: even pieces of the room that there is.
            parts = -(-(hi - lo) // room)
            edges = [lo + (hi - lo) * k // parts for k in range(parts + 1)]
            todo += [(a, b, k > 0 or hard) for k, (a, b) in reversed(list(enumerate(zip(edges, edges[1:]))))]
            continue
        middle = (lo + hi) / 2
        far = np.abs(at[i:j] - middle) / (hi - lo)
        score = strength[i:j] / 6 - far / _REACH * np.where(far > 0.25, 2.0, 1.0)
        k = int(at[i + int(np.argmax(score))])
        todo += [(k, hi, False), (lo, k, hard)]
    return spans


def _joined(spans: list[tuple[int, int, bool]], room: int) -> list[tuple[int, int, bool]]:
    """Bisection leaves crumbs beside long runs; a crumb joins the neighbour with which it fits best, if there is one."""
    out: list[tuple[int, int, bool]] = []
    for n, (lo, hi, hard) in enumerate(spans):
        if out and not hard and hi - out[-1][0] <= room and min(hi - lo, out[-1][1] - out[-1][0]) < room // _CRUMB:
            # The one behind may fit more tightly, if this one is the crumb.
            behind = spans[n + 1][1] - lo if n + 1 < len(spans) and not spans[n + 1][2] else room + 1
            if hi - lo >= room // _CRUMB or behind > room or hi - out[-1][0] >= behind:
                out[-1] = (out[-1][0], hi, out[-1][2])
                continue
        out.append((lo, hi, hard))
    return out


def bisect(text: str, limit: int, overlap: int) -> list[Piece]:
    """Pieces of a trimmed text, in order.

    A piece repeats the last ``overlap`` characters of the one before, or all of that if it is shorter, or what room the
    limit leaves beside a run that stays whole.
    """
    room = max(1, limit - overlap - 1)  # one place is for a blank between overlap and own text
    out: list[Piece] = []
    for lo, hi, hard in _joined(_spans(text, limit, room), room):
        if not out:
            out.append(Piece(lo, hi, 0, hard, text[lo:hi]))
            continue
        gap, free = lo - out[-1].end, limit - (hi - lo)
        back = max(0, min(overlap, len(out[-1].text), free - min(1, gap)))
        # Long blanks between the pieces are shortened from the left.
        before = out[-1].text[len(out[-1].text) - back :]
        out.append(Piece(lo, hi, back, hard, before + text[lo - min(gap, free - back) : hi]))
    return out


def split(records: DataFrame, limit: int, overlap: int) -> DataFrame:
    """``records`` (id, text) to pieces: id, piece (from 0), own_start, end, overlap, hard_cut, n_pieces, piece_text.

    own_start to end is what the pieces before don't hold; overlap counts the characters repeated before it.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    texts = records.select(F.col("id").cast("string"), ws_trim(F.col("text")).alias("text")).filter(F.col("text").isNotNull())
    short = texts.filter(F.length("text") <= limit).select(
        "id",
        F.lit(0).alias("piece"),
        F.lit(0).alias("own_start"),
        F.length("text").alias("end"),
        F.lit(0).alias("overlap"),
        F.lit(False).alias("hard_cut"),
        F.lit(1).alias("n_pieces"),
        F.col("text").alias("piece_text"),
    )
    return short.unionByName(oversized(records, limit, overlap)).distinct()


def oversized(records: DataFrame, limit: int, overlap: int) -> DataFrame:
    """The pieces of only those ``records`` that are over the limit; the others never leave the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in _NAMES]
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pieces = bisect(text, limit, overlap)
                for n, p in enumerate(pieces):
                    for col, v in zip(cols, (id_, n, p.own, p.end, p.overlap, p.hard, len(pieces), p.text)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], names=_NAMES)

    texts = records.select(F.col("id").cast("string"), ws_trim(F.col("text")).alias("text")).filter(F.length("text") > limit)
    return texts.mapInArrow(run, "id string, piece int, own_start int, end int, overlap int, hard_cut boolean, n_pieces int, piece_text string")


_NAMES = ["id", "piece", "own_start", "end", "overlap", "hard_cut", "n_pieces", "piece_text"]
_TYPES = [pa.string(), *[pa.int32()] * 4, pa.bool_(), pa.int32(), pa.string()]


def cut_kinds(records: DataFrame, limit: int, overlap: int) -> DataFrame:
    """Per record over the limit: id and cut_kind, ``hard`` if bisection had to cut inside a run, else ``soft``."""
    return (
        oversized(records, limit, overlap)
        .groupBy("id")
        .agg(F.max("hard_cut").alias("hard"))
        .select("id", F.when(F.col("hard"), "hard").otherwise("soft").alias("cut_kind"))
    )
