"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python tasks find this package, and keep Arrow batches small enough for long texts.

    Where the package is not installed on the executors, its folder joins their search path.
    The batch size is lowered only from Spark's default.
    """
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, known) if p)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


_HELD: list = []


def hold(name: str, release: Callable[[], None]) -> None:
    """Say that an operator keeps something in this Python worker, and how to let go of it.

    Workers serve one stage after another; what another operator kept is released first, and
    the memory goes back to the system.
    """
    if _HELD and _HELD[0] != name:
        _HELD[1]()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)
    _HELD[:] = [name, release]


def nothing_kept() -> None:
    """For operators that keep nothing themselves."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: Iterable[str], base: str) -> str:
    """``base``, or ``base`` with underscores added until no column has that name in any case."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def two_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, text)`` alone, under these names, whatever else the table holds."""
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def bytes_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """UTF-8 bytes of a string column, not decoded."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def batch_of(columns: dict[str, tuple[list | pa.Array, pa.DataType]]) -> pa.RecordBatch:
    """A record batch from values and types by column name."""
    arrays = [v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


PARTS_BITS = 16


def least_hashed(rows: DataFrame, place_col: str, most: int) -> DataFrame:
    """The rows of the least values of a 64-bit hash: ``most`` of them, or all, and few more.

    Rows are counted by leading bits of the hash, at most 65,536 sums, which say where to cut; so no
    task sends rows to a sort but those that may be taken.
    """
    part = F.shiftright(F.col(place_col), 64 - PARTS_BITS)
    total, last = 0, None
    for row in sorted(rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["part"]):
        total, last = total + row["n"], row["part"]
        if total >= most:
            break
    return rows.where(F.lit(False) if last is None else part <= last)


LEVELS = 8


def _level(count: Column) -> Column:
    return F.floor(F.log2(count.cast("double")) * LEVELS)


def most_frequent(counts: DataFrame, count_col: str, most: int) -> DataFrame:
    """The rows of the highest counts, as many levels of them as together have ``most`` rows at most.

    A level is an eighth of a doubling, so a few hundred sums say where to cut, and no task sorts rows.
    """
    held = counts.groupBy(_level(F.col(count_col)).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    total, least = 0, None
    for row in sorted(held.where("level is not null").collect(), key=lambda r: -r["level"]):
        total += row["n"]
        if total > most:
            break
        least = row["level"]
    return counts.where(F.lit(False) if least is None else _level(F.col(count_col)) >= least)
