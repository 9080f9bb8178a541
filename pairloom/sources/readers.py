"""Readers for preference data."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType

from pairloom.functions.fixed_values import MISSPELLED_REJECTED
from pairloom.sources.json_array import as_json_lines
from pairloom.sources.saved import exists, is_saved, read_saved, saved_schema, saved_splits


# What a writer says of its splits, beside them; readers of the files pass over the name.
MANIFEST = "_manifest"


class WrongCount(ValueError):
    """A split does not have the rows its writer counted."""


class MissingColumns(ValueError):
    """A table lacks columns its declared schema names."""


def require_columns_named(found: list[str], columns: Iterable[str]) -> None:
    if missing := [c for c in columns if c not in found]:
        raise MissingColumns(f"missing columns {missing}; found {found}")


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    require_columns_named(df.columns, columns)
    return df


def canonical_names(df: DataFrame) -> DataFrame:
    """Dashes to underscores, and names of published prepared tables to this package's."""
    names = {c: _canonical(c) for c in df.columns}
    return df.withColumnsRenamed({old: new for old, new in names.items() if old != new})


# Published prepared tables name some columns differently; fixed values.
RENAMED = {MISSPELLED_REJECTED: "rejected_response", "chosen_length": "chosen_response_length", "rejected_length": "rejected_response_length"}


def _canonical(name: str) -> str:
    return RENAMED.get(name, name.replace("-", "_"))


def read_examples(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Read a table, choosing the format by suffix.

    ``.jsonl`` is one record a line; ``.json`` may also be one array of records, which many tasks
    cut into lines first;
    ``.parquet`` is Parquet, and so is anything else but a saved dataset folder, of which no
    more than the schema's columns are decoded. Malformed JSON fails. Names are made canonical first; a table that then lacks a column of ``schema``
    is refused, and only the schema's columns are returned.
    """
    if not path.endswith((".json", ".jsonl", ".parquet")) and is_saved(spark, path):
        return _of_schema(canonical_names(_read_saved(spark, path, schema)), schema)
    if not path.endswith((".json", ".jsonl")):
        return _of_schema(canonical_names(spark.read.parquet(path)), schema)
    if _is_array(spark, path):
        path = as_json_lines(spark, path)
    options = {"mode": "FAILFAST"}
    if schema is None:
        return canonical_names(spark.read.json(path, **options))
    # Every name the schema's columns may have: which of them occur is known from the data.
    names = {f.name: f for f in schema.fields}
    old = {new: name for name, new in RENAMED.items()}
    asked = [*schema.fields]
    for f in schema.fields:
        for name in (_canonical(f.name), old.get(_canonical(f.name))):
            if name and name not in names:
                names[name] = T.StructField(name, f.dataType)
                asked.append(names[name])
    df = spark.read.schema(T.StructType(asked)).json(path, **options)
    # A file without records has no columns to miss.
    present = df.agg(F.count(F.lit(1)), *[F.max(F.col(f"`{f.name}`").isNotNull()) for f in asked]).first()
    used = [f.name for f, there in zip(asked, present[1:]) if there or (not present[0] and f in schema.fields)]
    return _of_schema(canonical_names(df.select(*[f"`{n}`" for n in used])), schema)


def _of_schema(df: DataFrame, schema: StructType | None) -> DataFrame:
    if schema is None:
        return df
    names = [_canonical(n) for n in schema.fieldNames()]
    return require_columns(df, names).select(*[f"`{n}`" for n in names])


def _read_saved(spark: SparkSession, path: str, schema: StructType | None) -> DataFrame:
    if schema is None or saved_splits(spark, path):
        return read_saved(spark, path)
    asked = {_canonical(n) for n in schema.fieldNames()}
    found = [n for n in saved_schema(spark, path).names if _canonical(n) in asked]
    require_columns_named([_canonical(n) for n in found], asked)
    return read_saved(spark, path, found)


def _is_array(spark: SparkSession, path: str) -> bool:
    """Whether a ``.json`` file opens with ``[``. JSON Lines stay splittable across tasks.

    Only the first character that is not blank comes to the driver.
    """
    if not path.endswith(".json"):
        return False
    blank = " \t\r\ufeff"
    opening = spark.read.text(path).select(F.substring(F.ltrim(F.col("value"), F.lit(blank)), 1, 1).alias("c"))
    first = opening.where(F.col("c") != "").limit(1).first()
    return first is not None and first["c"] == "["


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One named split of a saved dataset; only its files are read.

    A folder of saved datasets has a folder for each; else ``split`` is a partition column. Where
    the writer left its counts, a split with other rows is refused; file footers tell how many there are.
    """
    path = path.rstrip("/")
    if is_saved(spark, f"{path}/{split}"):
        return canonical_names(read_saved(spark, f"{path}/{split}"))
    if names := saved_splits(spark, path):
        raise ValueError(f"no split {split!r}; one of {names}")
    df = require_columns(spark.read.parquet(path), ["split"])
    own = df.where(df["split"] == split).drop("split")
    if exists(spark, f"{path}/{MANIFEST}"):
        told = json.loads(spark.read.text(f"{path}/{MANIFEST}").first()["value"])["splits"].get(split, {}).get("num_examples", 0)
        if (found := own.count()) != told:
            raise WrongCount(f"split {split!r} of {path} has {found} rows; {told} were written")
    return canonical_names(own)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition a scan by ``key`` when it has fewer tasks than the cluster has cores.

    A few unsplittable files would otherwise keep all but a few cores idle through the
    tokenizing that follows, and regrouping by ``key`` later reuses the partitioning. A
    table of many files is left as it is. Meant for plain scans: counting the tasks of a
    plan with shuffles would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
