"""What the operators of this folder share: table access, staging, word rules and packed arrays."""

from __future__ import annotations

from typing import Iterable, Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from courtlens.session import TIDY, delete, tidy  # noqa: F401  (TIDY is read by tests)
from courtlens.sources.tables import shared_folder

#: Bits of a bit map, whatever the input, and bits handled in one row.
MARKS, BLOCK = 1 << 27, 1 << 16
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Folders of the tables that ``stage`` wrote.
_places: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the cluster's shared folder and read back: later jobs reuse the rows and
    a lost executor costs nothing, since no shuffle file is needed any more."""
    place = shared_folder(df.sparkSession, name)
    with tidy(df.sparkSession):
        df.write.parquet(place)
    table = df.sparkSession.read.schema(df.schema).parquet(place)
    _places[table] = place
    return table


def stage_parts(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """One staged table of several of one schema, each written before the next one is asked for."""
    place = None
    for df in parts:
        place = place or shared_folder(df.sparkSession, name)
        with tidy(df.sparkSession):
            df.write.mode("append").parquet(place)
    table = df.sparkSession.read.schema(df.schema).parquet(place)
    _places[table] = place
    return table


def unstage(*tables: DataFrame) -> None:
    """Deletes the files of staged tables that no later job reads."""
    for table in tables:
        delete(table.sparkSession, [_places.pop(table)])


def merged(df: DataFrame) -> DataFrame:
    """``df`` as one side of a join that sorts both: neither is sent whole through the driver. Spark sizes what comes
    out of an explode or a Python step by what goes in, so that a table many times its threshold looks small."""
    return df.hint("merge")


def remainder(doc_id: Column | str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; 0 for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % by, F.lit(0))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def words_of(text: str | None) -> list[bytes]:
    """Words without blanks or \\t\\n\\v\\f\\r, A-Z lower-cased, as UTF-8: what bytes.lower/split do."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def by_bytes(texts: pa.Array, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """(first, number) of runs of rows whose texts hold ``most`` bytes at most; a longer one is alone.
    Memory that the run before it used is handed back."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        held = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, held + most, side="right")))
        yield at, stop - at
        at = stop
        pa.default_memory_pool().release_unused()


def sliced(batches: Iterable[pa.RecordBatch], text_column: str = "text", most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few megabytes of text."""
    for batch in batches:
        for at, n in by_bytes(batch.column(batch.schema.names.index(text_column)), most):
            yield batch.slice(at, n)


def pack(values) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def table(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def bit_map(hashes: DataFrame, marks: int | None = None) -> np.ndarray:
    """A map in which the bit of every 64-bit hash of the one column is set; others may share it.

    What comes to the driver, and may be broadcast, is ``marks`` bits at any input: a filter ahead
    of a join that is exact by itself.
    """
    marks = marks or MARKS
    bit = F.col(hashes.columns[0]).bitwiseAND(F.lit(marks - 1))
    blocks = hashes.select(F.floor(bit / BLOCK).cast("int").alias("block"), (bit % BLOCK).cast("int").alias("bit")).groupBy("block").agg(
        F.collect_set("bit").alias("bits"))  # BLOCK bits at most

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for bits in batch.column("bits"):
                row = np.zeros(BLOCK, np.uint8)
                row[bits.values.to_numpy(zero_copy_only=False)] = 1
                made.append(np.packbits(row, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(made, pa.binary())], ["block", "raw"])

    out = np.zeros(marks // 8, np.uint8)
    with tidy(hashes.sparkSession):
        rows = blocks.mapInArrow(packed, "block int, raw binary").collect()
    for r in rows:
        out[r["block"] * (BLOCK // 8):(r["block"] + 1) * (BLOCK // 8)] = np.frombuffer(r["raw"], np.uint8)
    return out


def is_set(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes.view(np.int64) & (len(bits) * 8 - 1)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
