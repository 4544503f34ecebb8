"""Driver-side control of iterations: stages are cut by tables in the shared checkpoint folder, so lineage stays short and lost executors cost one round."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

#: Tables in the shared folder: by path the session, and a weak reference to the file index that every plan over the table holds.
_tables: dict[str, tuple[SparkSession, JavaObject]] = {}


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: columns take a fraction of the bytes of a checkpoint's rows, and the table is a new
    relation, which a union or join with what it came from can't confuse. It goes when, at a later call, no plan uses it any more; what is left at the end goes then."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or _own_folder(sc.master))
    _sweep()
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if not _tables:
        atexit.register(_clear)
    _tables[path] = spark, spark._jvm.java.lang.ref.WeakReference(out._jdf.queryExecution().analyzed().relation().location())
    return out


def is_table(df: DataFrame) -> bool:
    """Whether df is files as they are, such as what checkpointed gives, so that it costs little to read it again."""
    return df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"


def _delete(path: str) -> None:
    spark, _ = _tables.pop(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _sweep() -> None:
    for path, (spark, held) in list(_tables.items()):
        if spark.sparkContext._jsc is None:  # the session has ended; the folder's owner clears it
            _tables.pop(path)
        elif held.get() is None:
            _delete(path)


def _clear() -> None:
    for path in list(_tables):
        try:
            _delete(path)
        except Exception:  # as above
            return


def _own_folder(master: str) -> str:
    """A temporary folder, which only local mode may use: elsewhere executors couldn't see each other's files."""
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="tidegraph-")


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int = 10_000) -> DataFrame:
    """step over and over, until the number of rows stays."""
    now = checkpointed(start)
    n = now.count()
    for _ in range(rounds):
        now = checkpointed(step(now))
        m = now.count()
        if m == n:
            break
        n = m
    return now
