"""Word rules and Arrow plumbing that several operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A-Z to a-z, every other byte as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: As LOWER; bytes outside ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` become a space, so ``split()`` gives its words.
ALNUM = bytes(c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in LOWER)
#: The word class behind ALNUM, for regular expressions of Spark and DuckDB.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER_AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def alnum_words(raw: bytes | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 text; null has none."""
    return raw.translate(ALNUM).split() if raw else []


def space_words(raw: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 text, unchanged; null has none."""
    return raw.split() if raw else []


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. ``lower`` does just that on pure ASCII, and faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER_AZ, LOWER_AZ))


#: Bytes of text that Arrow functions work on at once; one longer text is a slice of its own.
SLICE_BYTES = 1 << 18


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of a string or binary array with about ``most`` bytes, or one long text."""
    lo, size = 0, 0
    for i, n in enumerate(pa.compute.binary_length(texts).to_pylist()):
        if size and size + (n or 0) > most:
            yield lo, i
            lo, size = i, 0
        size += (n or 0) + 16
    if lo < len(texts):
        yield lo, len(texts)


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for a Python worker that other tasks use after it: what the task took goes back to the system at its end.

    Workers live on between tasks, and what their allocators keep counts against the executor's memory.
    """

    def call(batches: Iterator) -> Iterator:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            gc.collect()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # not glibc: nothing to give back by hand
                pass

    return call


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict[str, list]]], by: str = "text") -> DataFrame:
    """``mapInArrow`` by slices of batches. ``make()`` runs once in each task and returns a function from a slice to columns.

    A slice has about SLICE_BYTES of column ``by``, or one row, so a task holds few texts as Python objects.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for lo, hi in slices(batch.column(by)):
                columns = step(batch.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([pa.array(columns[n], type=kinds[n]) for n in names], names=names)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = {f.name: f.type for f in to_arrow_schema(StructType.fromDDL(schema))}
    names = list(kinds)
    return df.mapInArrow(frugal(run), schema)


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return batch.column(name).cast(pa.binary()).to_pylist()
