"""What the corpus operators share: inputs, the shared folder, cut lineage, Arrow batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch are worked on in runs of about so many characters.
BATCH_CHARS = 2_000_000
#: Bytes of one Arrow batch that goes to Python, where a Cut asks for it and the session sets nothing.
BATCH_BYTES, _BATCH_CONF = 5_000_000, "spark.sql.execution.arrow.maxBytesPerBatch"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset (tests, one machine), an own one. On a
    cluster an unset one is an error: executors wouldn't see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corpus-")
        atexit.register(shutil.rmtree, found.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs meanwhile sends batches of about BATCH_BYTES to Python: Spark's own 10,000 rows of
    texts are tens of MB, held by the JVM's Arrow buffers and by the worker at once."""
    if spark.conf.get(_BATCH_CONF, None) is not None:
        yield
        return
    spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH_CONF)


class Cut:
    """Tables written to the shared folder to end a lineage; they outlive lost executors. small: they
    are made with small_batches."""

    def __init__(self, spark: SparkSession, name: str, small: bool = False):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.batches = small_batches if small else nullcontext
        fs, where = _fs(spark, self.root)
        fs.deleteOnExit(where)

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        with self.batches(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._cut_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Removes tables that nothing reads any more."""
        for df in frames:
            fs, where = _fs(self.spark, df._cut_path)
            fs.delete(where, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, whatever their letters' case."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def text_of(name: str = "text"):
    """The text column with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def runs(texts: list[str], limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `limit` characters together, one row at least."""
    at = 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) <= limit:
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def appended(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])
