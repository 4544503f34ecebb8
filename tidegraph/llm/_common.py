"""What the operators share: column helpers, and tables written to the cluster's shared folder."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that parts words: space, and U+0009 to U+000D.
BLANKS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. An all-ASCII text takes the fast path, where lower() does just that."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column, gaps: str = BLANKS) -> Column:
    """The words between runs of `gaps`; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), gaps), "")


def let(value: Column, body) -> Column:
    """body(value), with value worked out once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local mode, where that is unset (tests), a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidegraph-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get()
    return found


#: Tables in the shared folder: by path the session, and a weak reference to the file index that every plan over the table holds.
_tables: dict[str, tuple[SparkSession, JavaObject]] = {}


def written(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: later jobs neither repeat its work nor depend on the executors that did it.

    The table goes when `drop` or `alone` says so, or when, at a later call, no plan uses it any more; what is left at the end goes then."""
    spark = df.sparkSession
    _sweep()
    path = f"{shared_dir(spark)}/tidegraph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if not _tables:
        atexit.register(_clear)
    _tables[path] = spark, spark._jvm.java.lang.ref.WeakReference(out._jdf.queryExecution().analyzed().relation().location())
    out._written_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that `written` gave and nothing needs any more."""
    _delete(*[t._written_at for t in tables])


def alone(make: Callable[[], DataFrame]) -> DataFrame:
    """make(), written; all tables that were written on the way are deleted."""
    before = set(_tables)
    out = written(make())
    _delete(*set(_tables) - before - {out._written_at})
    return out


def _delete(*paths: str) -> None:
    for path in paths:
        spark, _ = _tables.pop(path, (None, None))
        if spark is not None:
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


#: Rows of a table of keys that may be broadcast, and how many rows of a key make it a hub.
MAX_BROADCAST, HUB, MAX_HUBS = 1_000_000, 1000, 100_000


def beside(rows: DataFrame, few: DataFrame, on: Column, how: str, most: int | None = None) -> DataFrame:
    """A join of rows with a table of keys: broadcast, if it has MAX_BROADCAST rows at most, so that the rows' texts aren't shuffled; else by merging."""
    most = MAX_BROADCAST if most is None else most
    return rows.join(F.broadcast(few) if few.limit(most + 1).count() <= most else few.hint("merge"), on, how)


def hubs_apart(rows: DataFrame, counted: DataFrame, keys: list[str], total: int, hub: int = HUB) -> DataFrame:
    """rows joined with counted (keys, n: each key's number of rows): keys with over `hub` rows, of `total`, are broadcast, so their rows don't meet in one
    task. The limit rises with the total, so that at most MAX_HUBS keys are above it."""
    limit = max(hub, -(-total // MAX_HUBS))
    hubs = F.broadcast(counted.filter(F.col("n") > limit))
    others = rows.join(hubs.select(*keys), keys, "left_anti").join(counted.filter(F.col("n") <= limit).hint("merge"), keys)
    return rows.join(hubs, keys).unionByName(others)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
