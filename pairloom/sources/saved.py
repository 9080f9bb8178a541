"""Saved dataset folders: Arrow stream files named by a descriptor.

A folder holds ``state.json`` (the data files, in order, and the split's name),
``dataset_info.json`` (the columns' types, rows and bytes) and the files. A folder of such
folders names them in ``dataset_dict.json``.

Files are read by a Python data source with one partition a file, batch by batch, so a task
never holds a file; only the wanted columns are decoded. Descriptors are read through
Spark, data files through Arrow's file systems: paths without a scheme, ``file:``, and
the object stores Arrow knows.

The writer makes one or more files a task. What a task that was run again has left behind
is in no descriptor, so it is never read.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_schema

FORMAT = "pairloom_saved"
STATE, INFO, SPLITS = "state.json", "dataset_info.json", "dataset_dict.json"
SHARD_BYTES = 500_000_000
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# Names of value types in a descriptor; fixed values.
VALUES = {
    "string": T.StringType(), "large_string": T.StringType(), "bool": T.BooleanType(), "binary": T.BinaryType(),
    "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "float32": T.FloatType(), "float64": T.DoubleType(), "date32": T.DateType(),
}
NAMES = {type(kind): name for name, kind in VALUES.items() if name != "large_string"}


class BadDataset(ValueError):
    """A saved dataset lacks a file, or its files do not have the declared columns."""


def feature_type(feature) -> T.DataType:
    """The Spark type of a descriptor's feature."""
    if isinstance(feature, list) and len(feature) == 1:
        return T.ArrayType(feature_type(feature[0]))
    kind = feature.get("_type") if isinstance(feature, dict) else None
    if isinstance(feature, dict) and not isinstance(kind, str):
        return T.StructType([T.StructField(name, feature_type(f)) for name, f in feature.items()])
    if kind == "Value" and feature.get("dtype") in VALUES:
        return VALUES[feature["dtype"]]
    if kind == "ClassLabel":
        return T.LongType()
    if kind in ("Sequence", "List", "LargeList") and "feature" in feature:
        inner = feature["feature"]
        if kind == "Sequence" and isinstance(inner, dict) and not isinstance(inner.get("_type"), str):
            # A sequence of records is stored as a record of sequences.
            return T.StructType([T.StructField(name, T.ArrayType(feature_type(f))) for name, f in inner.items()])
        return T.ArrayType(feature_type(inner))
    raise BadDataset(f"a feature this reader does not know: {json.dumps(feature)[:200]}")


def type_feature(kind: T.DataType):
    """The descriptor's feature of a Spark type."""
    if isinstance(kind, T.StructType):
        return {f.name: type_feature(f.dataType) for f in kind}
    if isinstance(kind, T.ArrayType):
        return [type_feature(kind.elementType)]
    if type(kind) not in NAMES:
        raise BadDataset(f"{kind.simpleString()} has no feature")
    return {"dtype": NAMES[type(kind)], "_type": "Value"}


def _location(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _same_type(found: pa.DataType, declared: T.DataType) -> bool:
    """Whether a file's column holds what is declared; how strings and lists are laid out does not matter."""
    if isinstance(declared, T.ArrayType):
        return (pa.types.is_list(found) or pa.types.is_large_list(found)) and _same_type(found.value_type, declared.elementType)
    if isinstance(declared, T.StructType):
        if not pa.types.is_struct(found) or found.num_fields != len(declared):
            return False
        names = {found.field(i).name: found.field(i).type for i in range(found.num_fields)}
        return all(f.name in names and _same_type(names[f.name], f.dataType) for f in declared)
    try:
        return from_arrow_type(found) == declared
    except Exception:
        return False


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class SavedReader(DataSourceReader):
    def __init__(self, schema: T.StructType, folder: str, files: Sequence[str]):
        self.schema, self.folder, self.files = schema, folder, files

    def partitions(self) -> list[_File]:
        return [_File(f"{self.folder}/{name}") for name in self.files]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        system, path = _location(partition.path)
        with system.open_input_stream(path) as stream:
            found = pa.ipc.open_stream(stream).schema
        for field in self.schema:
            at = found.get_all_field_indices(field.name)
            if len(at) != 1 or not _same_type(found.field(at[0]).type, field.dataType):
                raise BadDataset(f"{partition.path} has no column {field.name} of {field.dataType.simpleString()}; it has {found}")
        asked = to_arrow_schema(self.schema)
        # Fields that are left out are skipped over, not decoded.
        options = pa.ipc.IpcReadOptions(included_fields=[found.get_field_index(f.name) for f in self.schema])
        with system.open_input_stream(path) as stream:
            for batch in pa.ipc.open_stream(stream, options=options):
                yield pa.Table.from_batches([batch]).select(asked.names).cast(asked).combine_chunks().to_batches()[0] if batch.num_rows else pa.RecordBatch.from_pylist([], asked)


class _Written(WriterCommitMessage):
    def __init__(self, partition: int, files: list[tuple[str, int, int]]):
        self.partition, self.files = partition, files


class SavedWriter(DataSourceArrowWriter):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.folder, self.split = schema, options["path"], options["split"]
        self.shard_bytes = int(options["shardbytes"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        part = TaskContext.get().partitionId()
        system, folder = _location(self.folder)
        files: list[tuple[str, int, int]] = []
        writer = stream = None
        for batch in iterator:
            if not batch.num_rows:
                continue
            if writer is None:
                name = f"data-{part:05d}-{len(files):05d}-{uuid.uuid4().hex}.arrow"
                stream = system.open_output_stream(f"{folder}/{name}")
                writer = pa.ipc.new_stream(stream, batch.schema)
                files.append((name, 0, 0))
            writer.write_batch(batch)
            name, rows, size = files[-1]
            files[-1] = (name, rows + batch.num_rows, size + batch.nbytes)
            if files[-1][2] >= self.shard_bytes:
                writer.close()
                stream.close()
                writer = None
        if writer is not None:
            writer.close()
            stream.close()
        return _Written(part, files)

    def commit(self, messages: list[_Written | None]) -> None:
        done = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        files = [f for m in done for f in m.files]
        rows, size = sum(f[1] for f in files), sum(f[2] for f in files)
        split = {"name": self.split, "num_bytes": size, "num_examples": rows, "dataset_name": None}
        told = {
            INFO: {"features": {f.name: type_feature(f.dataType) for f in self.schema}, "dataset_size": size, "splits": {self.split: split}},
            # The state comes last: a folder without it is not a dataset.
            STATE: {"_data_files": [{"filename": f[0]} for f in files], "_split": self.split},
        }
        system, folder = _location(self.folder)
        for name, value in told.items():
            with system.open_output_stream(f"{folder}/{name}") as out:
                out.write(json.dumps(value, indent=2).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        system, folder = _location(self.folder)
        for name, _, _ in (f for m in messages if m is not None for f in m.files):
            system.delete_file(f"{folder}/{name}")


class SavedDataset(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def reader(self, schema: T.StructType) -> SavedReader:
        return SavedReader(schema, self.options["path"], json.loads(self.options["files"]))

    def writer(self, schema: T.StructType, overwrite: bool) -> SavedWriter:
        return SavedWriter(schema, dict(self.options))


def _register(spark: SparkSession) -> None:
    """Where the package is not installed on the executors, its folder joins their search path."""
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, known) if p)
    spark.dataSource.register(SavedDataset)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _names_in(spark: SparkSession, folder: str) -> set[str]:
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return {s.getPath().getName() for s in target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(target)}


def _told(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def is_saved(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path}/{STATE}") or exists(spark, f"{path}/{SPLITS}")


def saved_splits(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders that a folder of datasets holds; none for a single dataset."""
    return _told(spark, f"{path}/{SPLITS}")["splits"] if exists(spark, f"{path}/{SPLITS}") else []


def saved_schema(spark: SparkSession, path: str) -> T.StructType:
    """The declared columns; nothing but the descriptor is read."""
    features = _told(spark, f"{path}/{INFO}").get("features") if exists(spark, f"{path}/{INFO}") else None
    if not features:
        raise BadDataset(f"{path}/{INFO} declares no columns")
    return T.StructType([T.StructField(name, feature_type(f)) for name, f in features.items()])


def saved_rows(spark: SparkSession, path: str) -> int | None:
    """The number of rows the descriptor tells, if it does."""
    info = _told(spark, f"{path}/{INFO}") if exists(spark, f"{path}/{INFO}") else {}
    own = (info.get("splits") or {}).get(_told(spark, f"{path}/{STATE}").get("_split"))
    return own.get("num_examples") if own else None


def read_saved(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A saved dataset, or all splits of a folder of them with a ``split`` column.

    ``columns`` are decoded, all by default. A listed file that is missing, an unknown type, an indices mapping and
    a file of other columns than declared are refused.
    """
    path = path.rstrip("/")
    if splits := saved_splits(spark, path):
        parts = [read_saved(spark, f"{path}/{name}", columns).withColumn("split", F.lit(name)) for name in splits]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole
    if not exists(spark, f"{path}/{STATE}"):
        raise BadDataset(f"{path} has no {STATE}")
    state = _told(spark, f"{path}/{STATE}")
    if state.get("_indices_data_files"):
        raise BadDataset(f"{path} is a selection of rows by an indices mapping; save it flattened")
    files = [f["filename"] for f in state["_data_files"]]
    if missing := sorted(set(files) - _names_in(spark, path)):
        raise BadDataset(f"{path} lacks {missing[:5]}")
    schema = saved_schema(spark, path)
    if columns is not None:
        if unknown := [c for c in columns if c not in schema.names]:
            raise BadDataset(f"{path} has no columns {unknown}; it has {schema.names}")
        schema = T.StructType([schema[c] for c in columns])
    if not files:
        return spark.createDataFrame([], schema)
    _register(spark)
    return spark.read.format(FORMAT).schema(schema).option("files", json.dumps(files)).load(path)


def write_saved(df: DataFrame, path: str, split: str = "train", shard_bytes: int = SHARD_BYTES) -> None:
    """Save a table as a dataset folder; counts and bytes in its descriptor come from the job that writes it."""
    spark, path = df.sparkSession, path.rstrip("/")
    if exists(spark, path):
        raise FileExistsError(path)
    for field in df.schema:
        type_feature(field.dataType)
    system, folder = _location(path)
    system.create_dir(folder, recursive=True)
    _register(spark)
    df.write.format(FORMAT).mode("append").option("split", split).option("shardBytes", str(shard_bytes)).save(path)


def write_saved_splits(df: DataFrame, path: str, splits: Sequence[str] = ("rm", "ppo", "test")) -> None:
    """One dataset folder for each split of a labelled table, and the file that names them."""
    path = path.rstrip("/")
    for name in splits:
        write_saved(df.where(F.col("split") == name).drop("split"), f"{path}/{name}", name)
    system, folder = _location(path)
    with system.open_output_stream(f"{folder}/{SPLITS}") as out:
        out.write(json.dumps({"splits": list(splits)}).encode())
