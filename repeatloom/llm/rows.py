"""Small shared helpers: word splitting on bytes, row maps over Arrow batches, free column names."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORD = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: Lower-cases A-Z and turns what is no digit, letter or non-ASCII byte into a space.
WORD_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c in _WORD else 0x20 for c in range(256))
#: Lower-cases A-Z only.
LOWER_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def plain_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.

    Every byte of a non-ASCII character is 0x80 or more, so bytes give the same words as characters.
    """
    return text.translate(WORD_TABLE).split()


def space_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: ``bytes.split`` knows exactly these separators."""
    return text.split()


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have; names are compared without case, as Spark does."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


#: Bytes of text whose rows leave a task in one batch.
SLICE = 4 << 20


def map_texts(
    df: DataFrame, columns: Sequence[str], schema: T.StructType,
    start: Callable[[], Callable[..., Iterable[tuple]]], done: Callable[[], None] = lambda: None,
) -> DataFrame:
    """Maps rows to rows; the output leaves in batches of the rows of ``SLICE`` bytes of text, or of one longer text.

    ``start()`` runs once in each task and returns a function of the given columns' values (strings come
    as UTF-8 bytes, null as None) that gives the output rows of one input row.  ``done()`` runs at the end of the
    task: worker processes live on, and what they keep counts against the next stage.
    """
    arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = start()
        for batch in batches:
            out, size = [], 0
            for row_in in zip(*[_values(c) for c in batch.columns]):
                out += each(*row_in)
                size += sum(len(v) for v in row_in if isinstance(v, bytes))
                if size >= SLICE and out:
                    yield _rows(out, arrow)
                    out, size = [], 0
            if out:
                yield _rows(out, arrow)
        done()
        release()

    return df.select(*[quoted(c) for c in columns]).mapInArrow(run, schema)


def _rows(out: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)


def release() -> None:
    """Gives memory that Arrow and the C library keep for later back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries keep their own rules
        pass


def _values(column: pa.Array) -> Iterator:
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
    return (v.as_py() for v in column)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    kinds = {
        T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64(),
        T.FloatType(): pa.float32(), T.StringType(): pa.string(), T.BinaryType(): pa.binary(),
        T.BooleanType(): pa.bool_(),
    }

    def kind(t: T.DataType) -> pa.DataType:
        return pa.list_(kind(t.elementType)) if isinstance(t, T.ArrayType) else kinds[t]

    return pa.schema([pa.field(f.name, kind(f.dataType)) for f in schema.fields])
