"""Helpers shared by the training-data operators: Arrow row maps, word rules, digests."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Rows handled at once inside a task: bounds the Python objects alive at any time.
SLICE_ROWS = 256

#: The ASCII white space that ends a word in the white-space word rule.
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"

#: Bytes 0x80-0xBF continue a UTF-8 character: without them, bytes count code points.
CONTINUATION = bytes(range(0x80, 0xC0))

#: Letters, digits and all non-ASCII bytes stay (A-Z lowered); everything else ends a word.
WORD_BYTES = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)


def letter_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; null has none."""
    return text.translate(WORD_BYTES).split() if text else []


def code_points(text: bytes) -> int:
    return len(text.translate(None, CONTINUATION))


def sha256_hex(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary()).to_pylist()


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_slices(
    df: DataFrame,
    schema: str,
    make: Callable[[], Callable[[pa.RecordBatch], Iterable[dict]]],
) -> DataFrame:
    """Map slices of Arrow batches to columns (dicts of lists or arrays) of ``schema``.

    ``make`` runs once per task and returns the slice function, so that tables and caches
    live as long as the task does.
    """
    target = _arrow_schema(df, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for part in slices(batches):
            for columns in step(part):
                yield pa.RecordBatch.from_arrays(
                    [_as_array(columns[f.name], f.type) for f in target], schema=target
                )

    return df.mapInArrow(run, schema)


def map_documents(
    docs: DataFrame,
    carry: list[str],
    own: str,
    make: Callable[[], Callable[[list[bytes | None], pa.RecordBatch], dict]],
) -> DataFrame:
    """Per document: a struct ``row`` of the carried columns and the ``own`` columns.

    The carried columns stay inside the struct, so that no name of a table can clash with
    a column computed here. The step gets the texts as UTF-8 and the whole slice.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")
    inside = "text" in carry
    chosen = docs.select(row) if inside else docs.select(row, F.col("text").cast("string").alias("text"))
    kind = chosen.schema["row"].dataType.simpleString()

    def make_slices():
        step = make()

        def run(part: pa.RecordBatch):
            column = part.column(0).field("text") if inside else part.column(1)
            yield {"row": part.column(0)} | step(utf8(column), part)

        return run

    return map_slices(chosen, f"row {kind}, {own}", make_slices)


def _as_array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def _arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def id_text(doc_id: str | Column) -> Column:
    """A document id as text; null as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(column.cast("string"), F.lit(""))


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id's text modulo ``folds``; a null id counts as the empty text."""
    return (F.crc32(id_text(doc_id).cast("binary")) % folds).cast("int")


#: A-Z lowered in DuckDB, for the SQL equivalents.
LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
