"""Hybrid search of one request: checked arguments, a scope of manuals or of a section, dense and lexical hits fused.

Defined results: a scope that names nothing raises ``not_found``; a blank text or a limit out of range raises ``invalid``;
a text without searchable terms is searched by vector alone; chunks without usable embedding are found by their text alone.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators import fusion, lexical, library, outline, vectors
from marginalia.sources.lexical_store import LexicalStore

MAX_LIMIT = 50
_TERM = re.compile("[A-Za-z0-9]{2,}")


@dataclass(frozen=True)
class Request:
    """What is asked for: a text and its vector, how many hits, and at most one manual path pattern and one section."""

    text: str
    vector: Sequence[float]
    limit: int = 5
    manual_path: str | None = None
    section: str | None = None  #: id of a bookmark; it is meant with all bookmarks below it
    ratio: float = lexical.MAX_DF_RATIO

    def checked(self) -> Request:
        if not self.text.strip():
            raise library.LibraryError("invalid", "the text to search for is empty")
        if not 1 <= self.limit <= MAX_LIMIT:
            raise library.LibraryError("invalid", f"the limit must be from 1 to {MAX_LIMIT}, not {self.limit}")
        return self

    def terms(self) -> list[str]:
        """Distinct terms in order of first appearance."""
        return list(dict.fromkeys(_TERM.findall(self.text)))


def _candidates(limit: int) -> int:
    return max(fusion.CANDIDATES, limit)


def manual_scope(manuals: DataFrame, pattern: str) -> DataFrame | None:
    """manual_id of the manuals that a path pattern names; None for the whole corpus."""
    named = library.manual_pattern(pattern)
    if named is None:
        return None
    scope = manuals.filter(named).select("manual_id").distinct()
    if not scope.limit(1).count():
        raise library.LibraryError("not_found", f"no manual under {pattern!r}")
    return scope


def section_scope(marks: DataFrame, section: str, key) -> DataFrame:
    """Keys (bookmark_id) of a bookmark and of all below it."""
    own = marks.filter(key(F.col("id")) == key(F.lit(section))).select("id", "manual_id")
    if not own.limit(1).count():
        raise library.LibraryError("not_found", f"no section {section!r}")
    # Only the section's own manual is read.
    near = marks.join(F.broadcast(own.select("manual_id").distinct()), "manual_id", "left_semi")
    below = outline.ancestors(near).join(F.broadcast(own.select(F.col("id").alias("ancestor"))), "ancestor", "left_semi").select("id")
    return own.select("id").unionByName(below).select(key(F.col("id")).alias("bookmark_id")).distinct()


def hybrid(request: Request, chunks: DataFrame, index: LexicalStore, manuals: DataFrame, marks: DataFrame, key) -> DataFrame:
    """The best hits: id, fused, retrieval, dense_score and the manual's relative_path.

    ``chunks`` has id, manual_id, bookmark_id (a key) and embedding; ``manuals`` manual_id and relative_path; ``marks`` id,
    manual_id, ordering and level; ``key`` maps ids to keys.
    """
    request = request.checked()
    scope = None if request.manual_path is None else manual_scope(manuals, request.manual_path)
    inside = chunks if scope is None else chunks.join(scope, "manual_id", "left_semi")
    terms = request.terms()
    scored = index.search(terms, scope, request.ratio).withColumnRenamed("chunk_id", "id") if terms else None
    if request.section is not None:
        sub = section_scope(marks, request.section, key)
        inside = inside.join(sub, "bookmark_id", "left_semi")
        scored = scored if scored is None else scored.join(inside.select("id"), "id", "left_semi")
    k = _candidates(request.limit)
    dense = vectors.dense_top(inside, request.vector, k)
    none = dense.filter(F.lit(False))
    lex = none if scored is None else scored.orderBy(F.desc("score"), "id").limit(k)
    hits = fusion.hybrid(dense, lex, request.limit).withColumn("manual_id", F.regexp_replace(F.lower("id"), "_[^_]*$", ""))
    return hits.join(manuals.select("manual_id", "relative_path"), "manual_id", "left").select("id", "fused", "retrieval", "dense_score", "relative_path")
