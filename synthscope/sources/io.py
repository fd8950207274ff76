"""Reading and writing tables."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import signature


def load_csv(spark: SparkSession, path: str, nrows: int | None = None, schema: str | T.StructType | None = None, **options) -> DataFrame:
    """A CSV file with a header; types are inferred unless a schema is given."""
    reader = spark.read.options(header=True, **options)
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    return df.limit(nrows) if nrows is not None else df


def load_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def load_flat_table(spark: SparkSession, path: str, nrows: int | None = None, exclude_cols: Sequence[str] = ()) -> DataFrame:
    """A CSV file without the listed columns, as far as it has them."""
    return load_csv(spark, path, nrows).drop(*exclude_cols)


def read_eav_files(spark: SparkSession, glob: str, id_parameter: str = "RecordID") -> DataFrame:
    """(entity_id, time, parameter, value) from many small files ``Time,Parameter,Value``.

    All files are one scan, whose rows are stored: a small file is opened once. The id of a file is the value of its
    ``id_parameter`` row, found by one small aggregate per file and joined back on the file's path. ``glob`` may be a folder, whose
    files, at any depth, are then listed by many tasks; a pattern is looked up by the driver alone.
    """
    reader = spark.read.option("header", True).schema("Time string, Parameter string, Value string")
    rows = (reader if any(c in glob for c in "*?[{") else reader.option("recursiveFileLookup", True)).csv(glob)
    return eav_with_ids(kept(rows.select(F.col("_metadata.file_path").alias("file"), "Time", "Parameter", "Value")), id_parameter)


def eav_with_ids(rows: DataFrame, id_parameter: str) -> DataFrame:
    """Rows (file, Time, Parameter, Value) with the id that a row of each file carries."""
    value = F.col("Value").cast("string").try_cast("double")
    ids = rows.groupBy("file").agg(F.max(F.when(F.col("Parameter") == id_parameter, value)).cast("long").alias("entity_id"))
    return rows.where(F.col("Parameter") != id_parameter).join(ids, "file").select("entity_id", F.col("Time").alias("time"), F.col("Parameter").alias("parameter"), value.alias("value"))


def scratch_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under ``spark.checkpoint.dir``, else in the warehouse."""
    return f"{(spark.conf.get('spark.checkpoint.dir', None) or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to a scratch folder and read again: computed once, however often it is used. The folder goes when the session's JVM ends."""
    spark, path = df.sparkSession, scratch_folder(df.sparkSession)
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def count_rows(df: DataFrame) -> int:
    return df.count()


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Parquet, CSV (with header) or JSON."""
    writer = df.write.mode(mode)
    {"parquet": writer.parquet, "json": writer.json, "csv": lambda p: writer.option("header", True).csv(p)}[fmt](path)


def append_results(df: DataFrame, path: str, schema: T.StructType, keys: Sequence[str] = ()) -> None:
    """Rows appended under a fixed schema; absent columns are null. With ``keys``, rows whose keys the
    table has already are left out, so an append that is tried again writes nothing twice."""
    rows = migrate_schema(df, schema)
    if keys and _exists(df.sparkSession, path):
        rows = rows.join(df.sparkSession.read.schema(schema).parquet(path).select(*keys), list(keys), "left_anti").select(*schema.names)
    rows.write.mode("append").parquet(path)


def folder_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, changed) of the files in a folder and the folders below it, as Spark lists them; nothing is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.unix_millis("_metadata.file_modification_time").alias("changed"))


def file_signature(spark: SparkSession, path: str) -> dict[str, object]:
    """Path, size, number and time of the last change of a file or of all files below a folder, for ``cached_by_signature``."""
    row = folder_files(spark, path).agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*"), F.coalesce(F.max("changed"), F.lit(0))).first()
    return {"path": path, "size": row[0], "files": row[1], "mtime": row[2]}


#: Partitions that a task writes side by side. A read task has fewer files, as each counts as 4 MB of its 128 at least.
WRITERS = 64


@contextmanager
def _unsorted_writes(spark: SparkSession) -> Iterator[None]:
    """Tasks write their partitions' rows as they come, instead of sorting them all, with their partitions' long names, in memory first."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, max(WRITERS, int(before)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def refreshed(spark: SparkSession, source: str, target: str, build: Callable[[list[str]], DataFrame]) -> DataFrame:
    """The table at ``target``, brought up to date with the files below ``source``.

    The table has a partition a file, and a manifest of the files' sizes and times is stored beside it. Files that are new or
    have changed are built again, by ``build`` of their paths (rows with the path in ``file``); the partitions of files
    that are gone are deleted; the others stay as they are. What comes to the driver are the files' names.
    """
    table, manifest = f"{target}/rows", f"{target}/manifest"
    now = folder_files(spark, source)
    was = spark.read.schema(now.schema).parquet(manifest) if _exists(spark, f"{manifest}/_SUCCESS") else now.limit(0)
    rows, before = [tuple(r) for r in now.collect()], {tuple(r) for r in was.collect()}
    part = lambda file: hashlib.md5(file.encode()).hexdigest()
    gone = {r[0] for r in before} - {r[0] for r in rows}
    for file in gone:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/part={part(file)}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    changed = sorted(r[0] for r in rows if r not in before)
    if changed:
        built = build(changed).withColumn("part", F.md5("file"))
        with _unsorted_writes(spark):
            built.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(table)
    if changed or gone:
        spark.createDataFrame(rows, now.schema).coalesce(1).write.mode("overwrite").parquet(manifest)
    return spark.read.parquet(table).drop("part")


def migrate_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order: missing ones null, others dropped."""
    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def cast_like(df: DataFrame, target: DataFrame) -> DataFrame:
    """Columns that the target has, cast to its types."""
    kinds = {f.name: f.dataType for f in target.schema}
    return df.select(*[(F.col(f"`{n}`").cast(kinds[n]) if n in kinds else F.col(f"`{n}`")).alias(n) for n in df.columns])


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def reuse_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], reset: bool = False) -> DataFrame:
    """A stored table, built first where it is missing or a reset is asked for."""
    if reset or not _exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def cached_by_signature(spark: SparkSession, path: str, parts: dict[str, object], build: Callable[[], DataFrame]) -> DataFrame:
    """A stored table that is built anew when any named part of its signature has changed."""
    sign = spark.range(1).select(signature([F.lit(f"{k}={parts[k]}") for k in sorted(parts)]).alias("signature"))
    now = sign.first()["signature"]
    known = spark.read.parquet(f"{path}/signature").first()["signature"] if _exists(spark, f"{path}/signature/_SUCCESS") else None
    if known != now:
        build().write.mode("overwrite").parquet(f"{path}/data")
        sign.coalesce(1).write.mode("overwrite").parquet(f"{path}/signature")
    return spark.read.parquet(f"{path}/data")


def write_json_report(df: DataFrame, path: str) -> None:
    """Each row as one JSON document."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def parse_path_numbers(path: F.Column, *names: str) -> list[F.Column]:
    """Numbers that a file name gives after each name, as in ``model_nt3_noise8``."""
    return [F.regexp_extract(path, rf"{n}_?(\d+)", 1).try_cast("int").alias(n) for n in names]
