"""Mixing sources to target weights: words are summed per source, repetition rates follow from the targets, and each document is
emitted floor(rate) times plus one more time with a probability equal to the fraction, as hash-seeded coins say.

Targets share the total size by weight, each stopped at `cap` times its source's size, the excess shared again by weight until
none is above: a few rounds of sums over the table of sources, of which only the level comes to the driver.

Coins are dealt so that a source's words come near its target, however few or large its documents: they aren't independent. A source's
documents are laid out by size class (the root of the size), and class by class systematic steps of the fraction, from a start that
hashes give the source, say how many copies a class gets: at any size, the documents counted up to there are less than one off. Within a class the
documents of the least coins get them; a coin is a hash of id, text and, among rows that share both, a running number. So every
document's probability is the fraction, and a source's words differ from the target by about its largest document at most.

Sizes are summed with partial aggregation, so a hot source costs no more than others. Classes are counted by BINS ranges of coins, so no
task sorts the documents of one. The tables of sources and of classes are broadcast only up to `max_broadcast` rows, else joined.

Cases: null text counts as size 0 and is taken 0 words; a null source is a source of its own, ordered last; a source without
words has target 0; a null id has the coins of the text "null"; rows that repeat an id have coins of their own; an empty table gives an
empty mix; no column of the input is renamed, and names that clash with the added ones are replaced by them.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranks import placed
from ._common import BLANKS, drop, hubs_apart, table, words_of, written

WEIGHTS, CAP, SEED, MAX_BROADCAST, BINS = (5, 2, 1), 3, 42, 100_000, 2**20


def word_count(text: Column) -> Column:
    return F.size(words_of(text, BLANKS)).cast("bigint")


def digits(text: Column, n: int) -> Column:
    """The first n hexadecimal digits of a text's MD5, as a number."""
    return F.conv(F.substring(F.md5(text), 1, n), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """From rows (source, size): one row per source with source_size and target; written. Weights repeat over sources by code point, null last."""
    per = placed(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), F.col("source").asc_nulls_last(), cut=written)
    per = written(per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")).cast("bigint")))
    wide = lambda c: (F.col(c) if isinstance(c, str) else F.lit(Decimal(c))).cast("decimal(38,0)")
    capped, level = F.lit(False), None
    while True:  # sources above their cap stop there, and the others share what is left
        free = F.when(~capped, F.col("weight")).otherwise(0)
        stopped = F.when(capped, cap * F.col("source_size")).otherwise(0)
        now = tuple(int(x or 0) for x in per.agg(F.sum("source_size") - F.sum(stopped), F.sum(free)).first())
        if now == level:
            break
        level = words, weight = now
        capped = wide("weight") * wide(words) > wide("source_size") * wide(cap * weight)
    share = (F.col("weight") * F.lit(words)).cast("double") / F.lit(float(weight or 1))
    return per.select("source", "source_size", F.least(share, (cap * F.col("source_size")).cast("double")).alias("target"))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with occ, a running number from 0 among those of one key: counted per task first, so that no task gathers a key's rows."""
    often = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    total = often.agg(F.sum("n")).first()[0]
    if total is None:
        return rows.withColumn("occ", F.lit(0).cast("bigint"))
    some = written(hubs_apart(rows, often, ["key"], total).drop("n").withColumn("_task", F.spark_partition_id()))
    per = some.groupBy("key", "_task").agg(F.count(F.lit(1)).alias("n"))
    first = per.select("key", "_task", (F.sum("n").over(Window.partitionBy("key").orderBy("_task")) - F.col("n")).alias("_first"))
    own = F.row_number().over(Window.partitionBy("key", "_task").orderBy("size"))
    some = some.withColumn("_own", own).join(first.hint("merge"), ["key", "_task"]).select(*rows.columns, (F.col("_first") + F.col("_own") - 1).alias("occ"))
    return rows.join(often.select("key").hint("merge"), "key", "left_anti").select(*rows.columns, F.lit(0).cast("bigint").alias("occ")).unionByName(some)


def _cuts(thin: DataFrame, per: DataFrame, seed: int) -> DataFrame:
    """For each source and size class its rate, source_size, target, and the coin up to which documents get one copy more; written."""
    bins = thin.groupBy("source", "class", "bin").agg(F.count(F.lit(1)).alias("m"))
    bins = written(bins.select("source", "class", "bin", F.sum("m").over(Window.partitionBy("source", "class").orderBy("bin")).alias("upto")))
    sums = bins.groupBy("source", "class").agg(F.max("upto").alias("n"))
    sums = sums.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("class")) - F.col("n"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = digits(F.concat(F.lit(f"{seed}|"), F.coalesce(F.concat(F.lit("source "), F.col("source")), F.lit("null"))), 12) / F.lit(float(2**48))
    sums = sums.join(per.hint("merge").withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("rate", rate).withColumn("start", start)
    part = F.col("rate") - F.floor("rate")
    sums = sums.withColumn("k", F.floor(F.col("start") + (F.col("before") + F.col("n")) * part) - F.floor(F.col("start") + F.col("before") * part))
    of = bins.alias("b").join(sums.hint("merge").alias("s"), F.col("b.source").eqNullSafe(F.col("s.source")) & (F.col("b.class") == F.col("s.class")))
    cut = of.groupBy("s.source", "s.class").agg(F.max(F.when(F.col("upto") <= F.col("k"), F.col("bin"))).alias("cut"), *[F.first(c).alias(c) for c in ("rate", "source_size", "target")])
    out = written(cut)
    drop(bins)
    return out


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: Sequence[str] | None = None, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """docs' columns (or those in keep) with size, source_size, target and copies, how often the mix has the document."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("size", "source_size", "target", "copies")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_doc"), F.col(source_col).alias("source"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.md5(text).alias("sum"), word_count(text).alias("size"))
    rows = rows.select("_doc", "source", "size", F.floor(F.sqrt("size")).alias("class"), F.concat_ws("|", F.lit(str(seed)), "id", "sum").alias("said"), F.xxhash64("id", "source", "sum").alias("key"))
    small = text_col not in keep and not any(docs.schema[c].dataType.typeName() == "struct" for c in keep)
    thin = written(rows if small else rows.drop("_doc"))  # small rows: texts are read once, or if rows travel with theirs, twice
    with_bin = lambda x: _numbered(x).withColumn("bin", digits(F.concat_ws("|", "said", "occ"), 5))
    per = source_targets(thin.select("source", "size"), weights, cap)
    tossed = with_bin(thin)
    cuts = _cuts(tossed, per, seed).withColumnsRenamed({"source": "_s", "class": "_c"})
    tossed = tossed if small else with_bin(rows)
    joined = tossed.join(F.broadcast(cuts) if cuts.limit(max_broadcast + 1).count() <= max_broadcast else cuts.hint("merge"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("class") == F.col("_c")), "left")
    copies = F.floor("rate") + F.coalesce(F.col("bin") <= F.col("cut"), F.lit(False)).cast("bigint")
    return joined.select("_doc.*", "size", "source_size", "target", copies.alias("copies"))


def emit(docs: DataFrame, **options) -> DataFrame:
    """docs, each row as many times as the mix takes it, columns as they were."""
    out = mix(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[F.col(options.get(k, d)).alias(k) for k, d in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))]), **options | {"id_col": "id_col", "text_col": "text_col", "source_col": "source_col", "keep": ["_row"]})
    return out.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def sql(documents: str = "documents") -> str:
    """doc_id, size, source_size, target and copies."""
    return rf"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
           coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || md5(coalesce(text, '')) AS said FROM {documents}),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM d GROUP BY source),
r AS (SELECT *, 3 * source_size / weight AS ratio FROM s),
l AS (SELECT *, sum(source_size) OVER () - coalesce(3 * sum(source_size) OVER o, 0) AS lw, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS lg, row_number() OVER (ORDER BY ratio, source NULLS LAST) AS k
      FROM r WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT lw, lg FROM l WHERE weight * lw <= 3 * source_size * lg ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, least(CAST(weight * f.lw AS DOUBLE) / CAST(f.lg AS DOUBLE), CAST(3 * source_size AS DOUBLE)) AS target FROM l, f),
c AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate, CAST(floor(sqrt(size)) AS BIGINT) AS class,
      CAST('0x' || substr(md5('42|' || said || '|' || (row_number() OVER (PARTITION BY said, d.source) - 1)), 1, 5) AS BIGINT) AS bin,
      CAST(CAST('0x' || substr(md5('42|' || coalesce('source ' || d.source, 'null')), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, rate - floor(rate) AS part, count(*) OVER (PARTITION BY source ORDER BY class) AS upto_class, count(*) OVER (PARTITION BY source, class) AS n, count(*) OVER (PARTITION BY source, class ORDER BY bin) AS upto FROM c)
SELECT doc_id, size, source_size, target, CAST(floor(rate) + CASE WHEN upto <= floor(u + upto_class * part) - floor(u + (upto_class - n) * part) THEN 1 ELSE 0 END AS BIGINT) AS copies FROM p
"""


SQL = f"SELECT doc_id, size, source_size, target, size * copies AS taken FROM ({sql()})"
