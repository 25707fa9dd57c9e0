"""What the operators of this subpackage share: tables, the shared folder, lineage cuts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

import lodeseek.llm

# Workers get these modules' functions by value, so that an executor without the repository on its path can run them.
cloudpickle.register_pickle_by_value(lodeseek.llm)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """The column of exactly this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text)"""
    return docs.select(col(id_col).alias("id"), col(text_col).alias("text"))


def boxed(docs: DataFrame) -> DataFrame:
    """(row): all columns in one struct, which takes any names along."""
    return docs.select(F.struct(*map(col, docs.columns)).alias("row"))


def fields(first: StructField, more: str) -> StructType:
    """A schema of a known field and of fields in DDL."""
    return StructType([StructField(first.name, first.dataType), *_parse_datatype_string(more).fields])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); local sessions without one get a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or _jvm_dir(spark)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lodeseek-")
        spark.sparkContext.setCheckpointDir(found)
        found = _jvm_dir(spark) or found
    elif not _jvm_dir(spark):
        spark.sparkContext.setCheckpointDir(found)
    return found


def _jvm_dir(spark: SparkSession) -> str | None:
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get() if found.isDefined() else None


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df as a table written in the shared folder: its lineage ends there, so a lost executor costs no recomputation.

    A checkpoint would end it too, but keeps the optimizer's guess of df's size, which every join multiplies: in a loop the guess grows
    to millions of digits. A table has its true size.
    """
    path = new_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def released() -> None:
    """Gives freed memory back to the system: workers are reused, and would go on holding it beside the JVM."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `most` bytes of text, or of one row."""
    for batch in batches:
        column = batch.column(text)
        if column.nbytes <= most or batch.num_rows <= 1:
            yield batch
            continue
        rows = max(1, batch.num_rows * most // column.nbytes)
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    released()
