"""Spellings of record ids.

A reference may spell an id in upper case, in braces, without hyphens or with white space around it.
``id_key`` maps every spelling to one key; ``chunk_key`` does so for ``<manual id>_<n>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the data model, as the inside of a regular-expression class.
WS_CLASS = " \\t\\r\\n\\u00A0\\u202F\\u3000"
#: The same characters as a Python string.
WS_CHARS = " \t\r\n  　"


def ws_trim(col: Column) -> Column:
    """``col`` without white space at both ends."""
    return F.regexp_replace(col, f"^[{WS_CLASS}]+|[{WS_CLASS}]+$", "")


def has_reference(col: Column) -> Column:
    """False for null, blank, ``none`` and ``null`` in any case: those refer to nothing."""
    return F.coalesce(~F.lower(ws_trim(col)).isin("", "none", "null"), F.lit(False))


def _core(col: Column) -> Column:
    bare = F.regexp_replace(col, f"^[{WS_CLASS}{{}}]+|[{WS_CLASS}{{}}]+$", "")
    return F.lower(F.regexp_replace(bare, "-", ""))


def id_key(col: Column) -> Column:
    """One key for all spellings of an id; null where the text is no reference."""
    return F.when(has_reference(col), _core(col))


def chunk_manual_key(col: Column) -> Column:
    """Key of the manual named by a chunk id: the part before the last underscore; null without one."""
    return F.when(has_reference(col) & col.contains("_"), _core(F.regexp_extract(col, "(?s)^(.*)_[^_]*$", 1)))


def chunk_key(col: Column) -> Column:
    """One key for all spellings of a chunk id; an id without underscore is keyed as a plain id."""
    number = _core(F.regexp_extract(col, "(?s)_([^_]*)$", 1))
    return F.when(
        has_reference(col),
        F.when(col.contains("_"), F.concat(chunk_manual_key(col), F.lit("_"), number)).otherwise(_core(col)),
    )
