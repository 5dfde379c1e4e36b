"""What several operators of this subpackage share: reading tables, cutting lineage, the shared folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the contracts name: U+0020 and U+0009 to U+000D.
ASCII_SPACE = "[\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session, or the context's checkpoint folder.

    Only on a local master (as in tests) is a folder of our own chosen where both are unset, once for each context.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    context = spark.sparkContext
    set_ = context._jsc.sc().getCheckpointDir()
    if set_.isDefined():
        return set_.get().rstrip("/")
    if not getattr(context, "_quire_shared", None):
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context._quire_shared = f"file://{tempfile.mkdtemp(prefix='quire-')}"
    return context._quire_shared


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, where the loss of an executor does not reach it."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nobody else uses."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, with_path: bool = False, options: dict[str, int] | None = None) -> DataFrame | tuple[DataFrame, str]:
    """As cut(), as a Parquet table, of the writer's options: columns that are not asked for are not read again. With its path, if asked for."""
    path = new_path(df.sparkSession, what)
    df.write.options(**(options or {})).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._quire_path = path
    return (back, path) if with_path else back


def deleted(spark: SparkSession, path: str) -> None:
    """Removes a table that written() made, once nothing reads it any more."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def over(*tables: DataFrame) -> None:
    """Removes tables as written() returned them, once all that reads them is written itself."""
    for t in tables:
        deleted(t.sparkSession, t._quire_path)


def slots(spark: SparkSession) -> int:
    """Partitions to aim for where work is heavy and data are small: three for each core the cluster offers."""
    return max(8, 3 * spark.sparkContext.defaultParallelism)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded bytes, so that a worker holds a few MB of text however long the rows are.

    These are settings of the session, as Spark reads them when a plan runs; they are only ever made smaller.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2000), ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)):
        now = spark.conf.get(key, None) or ""
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def clashing(df: DataFrame, names: list[str]) -> DataFrame:
    """df without those of its columns that an operator is about to add."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])


def text_of(df: DataFrame):
    """The text column, null as the empty text."""
    return F.coalesce(df["text"], F.lit(""))


_MADE: dict[str, object] = {}


def once(key: str, make):
    """make()'s result, the same for all tasks of a worker that ask by this key; of a worker's results one is kept."""
    if key not in _MADE:
        let_go()
        _MADE[key] = make()
    return _MADE[key]


def let_go() -> None:
    """Frees what once() and Arrow keep in this worker: workers go on from one step to the next, and steps without a table of their own call it."""
    if _MADE:
        _MADE.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
