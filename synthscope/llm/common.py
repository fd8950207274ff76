"""Helpers shared by the text operators: shared-storage tables, id handling, word counts."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are runs of anything but ASCII whitespace; ``bytes.split()`` cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.

    Cuts the lineage, so a lost executor costs the running tasks only, and gives the
    planner true sizes. The table goes when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared storage that nothing reads any more."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nothing refers to any more."""
    for _ in range(2):  # the first finds what the driver holds, the second what that held
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


#: Slots of a filter; what is sent to the driver and to executors is 2 ** SLOT_BITS / 8 bytes at most.
SLOT_BITS = 23


def id_slots(c: Column) -> Column:
    """The slot of an id in a filter."""
    return F.pmod(F.xxhash64(c), F.lit(1 << SLOT_BITS)).cast("int")


def slot_filter(slots: DataFrame, bits: int = SLOT_BITS) -> np.ndarray:
    """A bitmap, as bytes, of the slots (below 2 ** bits) in column ``slot``. It has the same size however many there
    are: rows whose slot is not set can be passed over, the others need an exact test."""
    bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    words = slots.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return out.astype("<i8").view(np.uint8)


def fresh(name: str, taken: Iterable[str]) -> str:
    """A column name that no column has, whatever the case."""
    lower = {c.lower() for c in taken}
    while any(c == name or c.startswith(f"{name}_") for c in lower):
        name = f"_{name}"
    return name


def _named_again(batches, fn, names: list[str]):
    """``fn`` over batches that have their own names; its results by position."""
    for b in fn(pa.RecordBatch.from_arrays(b.columns, names) for b in batches):
        yield pa.RecordBatch.from_arrays(b.columns, [f"c{i}" for i in range(b.num_columns)])


def mapped(df: DataFrame, fn: Callable, schema: T.StructType) -> DataFrame:
    """``df.mapInArrow(fn, schema)`` whatever the columns' names: a dot in a name would be read as a field's."""
    by_place = lambda names: [f"c{i}" for i in range(len(names))]
    out = T.StructType([T.StructField(n, f.dataType, f.nullable) for n, f in zip(by_place(schema.names), schema.fields, strict=True)])
    return df.toDF(*by_place(df.columns)).mapInArrow(partial(_named_again, fn=fn, names=df.columns), out).toDF(*schema.names)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def n_words(c: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")
