"""Whitespace-separated text: edge lists, triples, METIS graphs, partition files. Parsers take lines, readers files."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import weight
from ..options import Weights

_INT = r"([+-]?\d+)"


def _ints(names: list[str], kinds: list[str], after: str = "") -> list[Column]:
    pattern = r"^\s*" + r"\s+".join([_INT] * len(names)) + after
    return [F.expr(f"try_cast(nullif(regexp_extract(value, r'{pattern}', {i + 1}), '') as {k})").alias(n) for i, (n, k) in enumerate(zip(names, kinds, strict=True))]


def parse_edges(lines: DataFrame, cap: int | None = None, order: str = "n") -> DataFrame:
    """Lines (value) that begin with five integers; others are left out, what follows the fifth is ignored. cap keeps the first so many valid lines by `order`."""
    names = ["src", "dest", "likes", "shares", "comments"]
    keep = [order] if cap is not None else []
    out = lines.select(*keep, *_ints(names, ["bigint", "bigint", "int", "int", "int"])).dropna(subset=names)
    if cap is not None:
        out = out.orderBy(order).limit(cap)  # the feature is a cap
    return out.select(names)


def parse_weighted(lines: DataFrame, parts: DataFrame, w: Weights) -> DataFrame:
    """Valid lines with an end in a part, and their weight."""
    from ..operators.edges import subgraph, with_occ

    return subgraph(with_occ(parse_edges(lines)), parts).select("part", "src", "dest", weight(w).alias("w"))


def parse_triples(lines: DataFrame) -> DataFrame:
    """One `src dest weight` a line; malformed lines are left out."""
    out = lines.select(*_ints(["src", "dest"], ["bigint", "bigint"], r"\s+[+-]?[0-9.]"), F.expr(r"try_cast(nullif(regexp_extract(value, r'^\s*\S+\s+\S+\s+(\S+)', 1), '') as double)").alias("w"))
    return out.dropna()


def parse_metis(lines: DataFrame, order: str = "n") -> DataFrame:
    """Header `vertices edges`, then line i lists the 1-based neighbours of vertex i; gives 0-based (src, dest). order: line numbers from 0."""
    body = lines.filter(F.col(order) > 0).select((F.col(order) - 1).cast("bigint").alias("src"), F.explode(F.split(F.trim("value"), r"\s+")).alias("x"))
    return body.select("src", (F.expr("try_cast(x as bigint)") - 1).alias("dest")).dropna()


def check_metis(lines: DataFrame, order: str = "n") -> DataFrame:
    """One row: vertices and edges by the header, lines, sum of degrees, and whether both agree."""
    head = lines.filter(F.col(order) == 0).select(*_ints(["n_vertices", "n_edges"], ["bigint", "bigint"]))
    body = lines.filter(F.col(order) > 0).agg(F.count(F.lit(1)).alias("n_lines"))
    deg = parse_metis(lines, order).agg(F.count(F.lit(1)).alias("degrees"))
    ok = (F.col("n_lines") >= F.col("n_vertices")) & (F.col("degrees") == 2 * F.col("n_edges"))
    return head.crossJoin(F.broadcast(body)).crossJoin(F.broadcast(deg)).withColumn("consistent", ok)  # a row each


def parse_parts(lines: DataFrame, name: str = "file") -> DataFrame:
    """Lines of files that end in `<part>.txt`: distinct (part, node)."""
    part = F.expr(f"try_cast(regexp_extract({name}, r'(\\d+)\\.txt$', 1) as int)").alias("part")
    return lines.select(part, *_ints(["node"], ["bigint"])).dropna().distinct()


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, n (from 0 in file order) and file: counted by blocks of files first, so that a file's lines needn't meet in one task."""
    raw = lines_of(spark, path, F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"))
    sizes = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("lines"))
    first = sizes.select("file", "block", (F.sum("lines").over(Window.partitionBy("file").orderBy("block")) - F.col("lines")).alias("first"))
    own = F.row_number().over(Window.partitionBy("file", "block").orderBy("m"))
    return raw.withColumn("own", own).join(first, ["file", "block"]).select("value", (F.col("first") + F.col("own") - 1).alias("n"), "file")


def lines_of(spark: SparkSession, path: str, *more: Column) -> DataFrame:
    """value and file of all lines under path; a path that isn't there is an error, which names it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    if found is None or not len(found):
        raise FileNotFoundError(f"nothing at {path}")
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), *more)


def read_edges(spark: SparkSession, path: str, cap: int | None = None, seen: Observation | None = None) -> DataFrame:
    """The valid lines; none, if there are none. seen gets their number, n_edges, once an action has run."""
    out = parse_edges(numbered_lines(spark, path), cap) if cap is not None else parse_edges(lines_of(spark, path))
    return out.observe(seen, F.count(F.lit(1)).alias("n_edges")) if seen is not None else out


def read_metis(spark: SparkSession, path: str) -> DataFrame:
    """A METIS graph as (src, dest). A file without a header, or with fewer lines than it says, is an error; a wrong number of edges a warning."""
    lines = numbered_lines(spark, path)
    head = check_metis(lines).first()
    if head is None or head["n_vertices"] is None or head["n_edges"] is None:
        raise ValueError(f"no header `vertices edges` in {path}")
    if head["n_lines"] < head["n_vertices"]:
        raise ValueError(f"{path} has {head['n_lines']} adjacency lines for {head['n_vertices']} vertices")
    if not head["consistent"]:
        warnings.warn(f"{path}: {2 * head['n_edges']} ends expected, {head['degrees']} found", stacklevel=2)
    return parse_metis(lines.filter(F.col("n") <= head["n_vertices"]))


def read_parts(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    out = parse_parts(lines_of(spark, path))
    if strict and out.isEmpty():
        raise ValueError(f"no partition members under {path}")
    return out


def write_parts(parts: DataFrame, path: str) -> None:
    """One folder per part, one id a line, as partition_<part>.txt/."""
    rows = parts.select(F.concat(F.lit("partition_"), F.col("part").cast("string"), F.lit(".txt")).alias("file"), F.col("node").cast("string").alias("value"), "node")
    rows.repartition("file", F.pmod("node", F.lit(16))).sortWithinPartitions("file", "node").select("file", "value").write.partitionBy("file").mode("overwrite").text(path)


def read_written_parts(spark: SparkSession, path: str) -> DataFrame:
    return parse_parts(spark.read.option("basePath", path).text(path))
