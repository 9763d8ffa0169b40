"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, StructType

#: Open scopes of ``scratch``, innermost last: the folders that each has to delete.
_SCOPES: list[list[DataFrame]] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder is set if driver and executors are one process;
    a cluster has to name one.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-checkpoints-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it again.

    This cuts the lineage: a lost executor costs a reread, never a recomputation.  Inside
    ``scratch`` the folder goes when the scope ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared one, if it is there."""
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Deletes what ``materialise`` wrote for ``df``."""
    remove(df.sparkSession, df._scratch_path)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Deletes at its end what ``materialise`` wrote inside, but for the tables that were
    appended to the yielded list; the scope around it takes those over."""
    kept: list[DataFrame] = []
    _SCOPES.append([])
    try:
        yield kept
    finally:
        for df in _SCOPES.pop():
            if not any(df is k for k in kept):
                discard(df)
            elif _SCOPES:
                _SCOPES[-1].append(df)


def extended(schema: StructType, more: str) -> StructType:
    """``schema`` with the fields of a DDL string after its own."""
    return StructType([*schema.fields, *DataType.fromDDL(more).fields])
