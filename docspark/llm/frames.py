"""Small helpers shared by the operators that run numpy code over Arrow batches."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from docspark.llm.words import give_back, slices


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only where that is unset and all runs on one machine (as in tests), a folder below the
    warehouse is used; on a cluster that is an error.  A path without a scheme
    lies in the cluster's default file system.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
    if "://" not in top and not top.startswith("file:"):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)
        top = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def free_name(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of the frame has it (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def set_aside(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """The frame with columns of these names (in any case) renamed, and how to name them back."""
    wanted = {n.lower() for n in names}
    back = {f"{c}-{uuid.uuid4().hex}": c for c in df.columns if c.lower() in wanted}
    return df.withColumnsRenamed({c: n for n, c in back.items()}), back


def local_uri(uri: str) -> str:
    """`file:/x` as `file:///x`, which pyarrow understands; others unchanged."""
    return "file:///" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else uri


#: Rows that Spark hands to Python at once.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stored(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """The frame written to the shared folder and read again: it cuts lineage and survives lost executors.

    `batch` bounds the rows that Python gets at once while it is written, for
    frames whose rows are large.
    """
    spark = df.sparkSession
    path, before = shared_folder(spark, name), spark.conf.get(BATCH_ROWS)
    try:
        if batch:
            spark.conf.set(BATCH_ROWS, batch)
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


def add_columns(df: DataFrame, text: str, fields: str, make: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """The rows of df with columns that `make` computes from slices of about a megabyte of text.

    `fields` is a DDL list of the new columns; columns of df with these names
    are replaced.  No row is dropped, moved or shuffled.
    """
    new = T.StructType.fromDDL(fields)
    df = df.drop(*(c for c in new.names if c != text))
    schema = T.StructType([*(f for f in df.schema.fields if f.name not in new.names), *new.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            give_back()
            for part in slices(batch, text):
                made = make(part)
                kept = [(n, part.column(i)) for i, n in enumerate(part.schema.names) if n not in new.names]
                yield pa.RecordBatch.from_arrays([*(c for _, c in kept), *made], names=[*(n for n, _ in kept), *new.names])

    return df.mapInArrow(run, schema)
