"""Small column helpers shared by the operators of this subpackage."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space of every contract here: space, tab, LF, VT, FF, CR.
WS_CHARS = " \t\n\x0b\x0c\r"
WS_RUN = r"[\x20\x09-\x0D]+"


def text_or_empty(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def spaced(text: Column | str) -> Column:
    """The text with every run of white space replaced by one space; null counts as empty."""
    return F.regexp_replace(text_or_empty(text), WS_RUN, " ")


def words(text: Column | str) -> Column:
    """The maximal runs of characters that are not white space, in order."""
    return F.filter(F.split(text_or_empty(text), WS_RUN, -1), lambda w: w != "")


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def id_hash_mod(id_col: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n (null ids hash as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(n))


def tidy(run):
    """A mapInArrow function that gives Arrow's unused memory back when its task ends: Python workers
    live on from stage to stage and would keep it."""
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
    return tidied


def each(column):
    """The values of an Arrow column one at a time, so that only one text is a Python object."""
    return (x.as_py() for x in column)
