"""Small helpers that the text operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.storage import materialize

_HELD: dict[str, dict] = {}


def held(operator: str) -> dict:
    """The store that one operator keeps in a Python worker from task to task. A worker serves many stages, so asking for
    one store empties those of all other operators and gives the freed memory back to the system."""
    if others := [k for k in _HELD if k != operator]:
        for k in others:
            del _HELD[k]
        trim()
    return _HELD.setdefault(operator, {})


def trim() -> None:
    """Gives memory that large arrays left free back to the system, where the C library can."""
    gc.collect()
    if sys.platform == "linux":
        with contextlib.suppress(AttributeError, OSError):
            ctypes.CDLL(None).malloc_trim(0)


#: Text bytes that one pass of a helper holds as Python objects.
BATCH_BYTES = 8 << 20


def whole_text(df: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """Only the id and the text, a null text as the empty one; other columns, whatever their names, stay behind."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def spare(df: DataFrame, *names: str) -> list[str]:
    """The given names, each with as many underscores in front as it takes to be none of the frame's columns."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found


def column(name: str) -> Column:
    """A column of exactly this name, dots and all."""
    return F.col(f"`{name}`")


def unique_ids(df: DataFrame, id_col: str) -> bool:
    """Whether ids tell rows apart: none is null or stands in two rows."""
    return df.filter(F.col(id_col).isNull()).isEmpty() and df.groupBy(id_col).count().filter("count > 1").isEmpty()


def keyed(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """``row`` (unique), ``doc_id`` and ``text``, and whether ids serve as rows, as they do where they are unique and not
    null; else rows are numbered in a written table, so that each pass sees the same numbers."""
    if unique_ids(df, id_col):
        return whole_text(df, id_col, text_col, F.col(id_col).cast("long").alias("row")), True
    return materialize(whole_text(df, id_col, text_col, F.monotonically_increasing_id().alias("row")), "numbered"), False


def slices(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts an Arrow batch so that the text of each piece stays under ``limit``, single longer texts apart."""
    sizes = pc.binary_length(batch.column(column)).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + (size or 0) > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size or 0
    if start < len(sizes):
        yield batch.slice(start)


class Memo(dict):
    """What a chunk of text gives, computed on its first sight. A worker keeps it from task to task; it is emptied when
    it holds ``most`` chunks, and chunks of more than ``long`` characters are never kept."""

    def __init__(self, compute: Callable[[str], object], most: int = 1_500_000, long: int = 48):
        super().__init__()
        self.compute, self.most, self.long = compute, most, long

    def __missing__(self, chunk: str):
        value = self.compute(chunk)
        if len(chunk) <= self.long:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = value
        return value
