"""Sharding by a Feistel permutation over global row numbers.

Rows are numbered 0 to n-1 by their content alone: equal rows are counted together, the distinct ones dealt into a fixed number of
hash buckets, numbered in each bucket by a running sum, and the buckets' totals give every bucket its first number. A balanced
Feistel network over the next even number of bits, walked along its cycle until it comes back below n, permutes the numbers; row p
of the permuted order lies in shard p mod shards, at slot p div shards. So shard sizes differ by one at most, slots have no gaps,
any place is computable from its number and the reverse (`place_of`, `number_at`), and a rerun gives the same.

Law: `rows`. Equal rows are aggregated before the shuffle and buckets mix all sources, so no group is collected anywhere.

Cases: a null text has size 16 and the CRC of the empty text; a null id is a value as any other; repeated rows get a place each,
and are told apart only by it; an empty table gives an empty result; carried columns may have any names but those added.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import table, written

DIGITS, ROUNDS, SEED = 3, 6, 42  # 16**DIGITS buckets


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit mixing function of x and key (multiply and shift, three times)."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64(key)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _keys(seed: int, rounds: int) -> list[int]:
    return [int(k) for k in _mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15 & (2**64 - 1)), seed & (2**64 - 1))]


def _network(x: np.ndarray, half: int, keys: Sequence[int], back: bool) -> np.ndarray:
    mask, h = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> h, x & mask
    for key in reversed(keys) if back else keys:
        if back:
            left, right = right ^ (_mix(left, key) & mask), left
        else:
            left, right = right, left ^ (_mix(right, key) & mask)
    return (left << h) | right


def permuted(numbers: np.ndarray, n: int, seed: int = SEED, rounds: int = ROUNDS, back: bool = False) -> np.ndarray:
    """Each number's place in the permutation of 0 to n-1; with back, the number at each place. Below 4n values, so 4 walks on average at most."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    keys = _keys(seed, rounds)
    x = _network(np.asarray(numbers, dtype=np.uint64), half, keys, back)
    while (out := x >= np.uint64(n)).any():
        x[out] = _network(x[out], half, keys, back)
    return x.astype(np.int64)


def place_of(number: int, n: int, shards: int, seed: int = SEED) -> tuple[int, int]:
    """Shard and slot of a row number."""
    p = int(permuted(np.array([number]), n, seed)[0])
    return p % shards, p // shards


def number_at(shard: int, slot: int, n: int, shards: int, seed: int = SEED) -> int:
    """The row number at a shard's slot."""
    return int(permuted(np.array([slot * shards + shard]), n, seed, back=True)[0])


def numbered(docs: DataFrame, carry: Sequence[str], text_col: str = "text") -> tuple[DataFrame, int]:
    """Rows of carry, size and text_crc32 with their global row number; and how many there are."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.octet_length(text).cast("bigint") + 16
    own = [*carry, "size", "text_crc32"]
    alike = docs.select(*[F.col(f"`{c}`") for c in carry], size.alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")).groupBy(*[f"`{c}`" for c in own]).agg(F.count(F.lit(1)).alias("_n"))
    alike = alike.withColumn("_bucket", F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null")) for c in own])), 1, DIGITS), 16, 10).cast("int"))
    upto = Window.partitionBy("_bucket").orderBy(*[f"`{c}`" for c in own])
    alike = written(alike.withColumn("_end", F.sum("_n").over(upto.rowsBetween(Window.unboundedPreceding, 0))))
    per = alike.groupBy("_bucket").agg(F.sum("_n").alias("_all"))  # a row a bucket
    per = written(per.select(F.col("_bucket").alias("_b"), "_all", (F.sum("_all").over(Window.orderBy("_bucket")) - F.col("_all")).alias("_first")))
    n = per.agg(F.coalesce(F.sum("_all"), F.lit(0))).first()[0]
    # Copies are listed in two steps, so that no array grows with them all.
    from_, step = F.col("_first") + F.col("_end") - F.col("_n"), 1 << 16
    some = alike.join(F.broadcast(per), F.col("_bucket") == F.col("_b")).select(*[f"`{c}`" for c in own], (F.col("_first") + F.col("_end")).alias("_to"), F.explode(F.sequence(from_, F.col("_first") + F.col("_end") - 1, F.lit(step).cast("bigint"))).alias("_from"))
    return some.select(*[f"`{c}`" for c in own], F.explode(F.sequence("_from", F.least(F.col("_from") + step, F.col("_to")) - 1)).alias("number")), n


def sharded(docs: DataFrame, shards: int = 40, seed: int = SEED, carry: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """carry's columns, size (UTF-8 bytes and 16), text_crc32, number, shard and slot. carry takes what can be grouped by, the text too."""
    rows, n = numbered(docs, carry, text_col)

    @F.pandas_udf("bigint")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(permuted(numbers.to_numpy(), n, seed))

    rows = rows.withColumn("_p", place("number"))
    return rows.select(*[c for c in rows.columns if c != "_p"], (F.col("_p") % shards).cast("int").alias("shard"), F.expr(f"_p div {shards}").alias("slot"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharded(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sql(documents: str = "documents", shards: int = 40, seed: int = SEED) -> str:
    """doc_id, size, text_crc32, shard and slot: CRC-32 bit by bit, the network over its whole domain as a table, walked by recursion."""
    step = lambda x, shift, factor: f"CAST(xor({x}, {x} >> {shift})::UHUGEINT * {factor}::UHUGEINT % 18446744073709551616::UHUGEINT AS UBIGINT)"
    rounds = ""
    for k, key in enumerate(_keys(seed, ROUNDS)):
        rounds += f"""a{k} AS (SELECT *, xor(r, {key}::UBIGINT) AS a FROM n{k}), b{k} AS (SELECT *, {step("a", 30, 13787848793156543929)} AS b FROM a{k}), c{k} AS (SELECT *, {step("b", 27, 10723151780598845931)} AS c FROM b{k}),
n{k + 1} AS (SELECT x, half, mask, r AS l, xor(c{k}.l, xor(c, c >> 31) & mask) AS r FROM c{k}),
"""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, string_split(trim(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1 ', 'g')), ' ') AS bytes FROM {documents}),
own AS (SELECT doc_id, size, CASE WHEN size = 16 THEN 0 ELSE CAST(xor(list_reduce([4294967295::UBIGINT] || flatten(list_transform(bytes, lambda h: list_transform([0, 1, 2, 3, 4, 5, 6, 7], lambda k: (('0x' || h)::UBIGINT >> k) & 1))),
  lambda c, x: xor(c >> 1, CASE WHEN c & 1 <> x THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)), 4294967295::UBIGINT) AS BIGINT) END AS text_crc32 FROM d),
numbered AS (SELECT *, row_number() OVER (ORDER BY substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || size || '|' || text_crc32), 1, {DIGITS}), doc_id NULLS FIRST, size, text_crc32) - 1 AS number, count(*) OVER () AS n FROM own),
dims AS (SELECT n, greatest(1, (length(bin(greatest(n - 1, 1))) + 1) // 2) AS half FROM (SELECT count(*) AS n FROM own)),
n0 AS (SELECT x, half, ((1::UBIGINT << half) - 1)::UBIGINT AS mask, x::UBIGINT >> half AS l, x::UBIGINT & ((1::UBIGINT << half) - 1)::UBIGINT AS r FROM (SELECT half, unnest(range(0, CAST(1::BIGINT << (2 * half) AS BIGINT))) AS x FROM dims)),
{rounds}net AS (SELECT x, CAST((l << half) | r AS BIGINT) AS y FROM n{ROUNDS}),
walk(number, y) AS (SELECT x, y FROM net, dims WHERE x < n UNION ALL SELECT walk.number, net.y FROM walk JOIN net ON net.x = walk.y, dims WHERE walk.y >= dims.n)
SELECT doc_id, size, text_crc32, CAST(y % {shards} AS INTEGER) AS shard, CAST(y // {shards} AS BIGINT) AS slot FROM numbered JOIN walk USING (number) WHERE y < n
"""


SQL = f"SELECT doc_id, size, text_crc32, 'rows' AS law, shard, slot, CAST(NULL AS INTEGER) AS grown_shard FROM ({sql()})"
