"""Shared storage, table access and text helpers of the corpus operators."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamlode.llm import tokens

#: Rows to a file of a staged table whose size is known.
FILE_ROWS = 200_000


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where the session names none, a local session (as in tests) makes one; on a cluster,
    whose executors would each see another folder, that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="seamlode-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str, rows: int | None = None, apart: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts the lineage.

    rows: a bound on its rows where one is known; a small table then has few files. apart: rows cost much to make,
    so they are made in all tasks and then moved into those files.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    if rows is not None:
        files = max(1, -(-rows // FILE_ROWS))
        df = df.repartition(files) if apart else df.coalesce(files)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(*tables: DataFrame) -> None:
    """Delete the files of staged tables that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(conf).delete(path, True)


def give_back() -> None:
    """Hand freed memory to the system; Arrow's and C's allocators would keep it for as long as the process lives."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, which leaves no freed memory with its Python worker: workers outlive tasks and stages.

    What an earlier stage's encoder keeps of words is dropped first.
    """

    @functools.wraps(run)
    def leaner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return leaner


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def numbered(docs: DataFrame) -> DataFrame:
    """The same columns as c0, c1 and so on, so that no name of theirs can clash with another."""
    return docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % n


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Schemes of Hadoop's connectors -> those of Arrow for the same store.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "wasb": "abfs"}


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a file as executors open it outside Spark; credentials come from their environment."""
    if uri.startswith("dbfs:/"):
        uri = "file:///dbfs/" + uri[len("dbfs:/") :].lstrip("/")
    elif uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    scheme, sep, rest = uri.partition("://")
    if sep:
        uri = f"{_SCHEMES.get(scheme, scheme)}://{rest}"
    else:
        uri = f"file://{uri}"
    return pafs.FileSystem.from_uri(uri)
