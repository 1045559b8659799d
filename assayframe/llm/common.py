"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Words are runs of characters other than the blank and the five controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


#: Folders that the tables of each enclosing ``passing`` block lie in.
_passing: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only a local session that names none (a test) gets a temporary one: on a
    cluster every machine would write to a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="assayframe-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets; it goes when the session's JVM ends, or the ``passing`` block."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files, where = _file_system(spark, path)
    files.deleteOnExit(where)
    for held in _passing[-1:]:
        held.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    files, where = _file_system(spark, path)
    files.delete(where, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored inside go at the end; what is read from them has to be written elsewhere by then."""
    _passing.append([])
    try:
        yield
    finally:
        for path in _passing.pop():
            remove(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet into the shared folder and reads it back.

    Unlike ``localCheckpoint`` it survives the loss of any executor, and the
    re-read table has a known size for the planner.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(taken: list[str], name: str) -> str:
    """``name``, or with a number behind it, so that no column has it (names are compared without case)."""
    held = {c.lower() for c in taken}
    return next(x for x in (name, *(f"{name}_{k}" for k in range(len(held) + 1))) if x not in held)


def _from_files(df: DataFrame) -> bool:
    """Whether rows are those of files: a scan, or what selects columns or rows of one."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    told = node.metadataOutput()
    return node.nodeName() == "LogicalRelation" and any(told.apply(i).name() == "_metadata" for i in range(told.size()))


def with_row_key(docs: DataFrame, name: str = "row") -> tuple[DataFrame, str]:
    """``docs`` with a column, named so that it clashes with none, that tells its rows apart, and that name.

    The key is a row's place in its files (file and number), so that it is the
    same whenever the table is read; rows that come from no file are stored first.
    Keys of one file, and of files by name, are in the order of the rows.
    """
    if not _from_files(docs):
        docs = stored(docs, "rows")
    name = free_name(docs.columns, name)
    file = F.col("_metadata.file_path")
    key = F.concat(F.element_at(F.split(file, "/"), -1), F.lit("#"), F.lpad(F.col("_metadata.row_index").cast("string"), 12, "0"), F.lit("#"), F.substring(F.md5(file), 1, 16))
    return docs.select("*", key.alias(name)), name


def lower_ascii(text: Column) -> Column:
    """A-Z become a-z; no other character changes."""
    return F.translate(text, UPPER, LOWER)


def row_mark(text: Column, *keys: Column) -> Column:
    """16 bytes that rows share exactly if their text and their keys are equal; null is a key of its own, a null text counts as empty."""
    named = F.to_json(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]))
    return F.unhex(F.md5(F.concat(named, F.coalesce(text.cast("string"), F.lit(""))).cast("binary")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
