"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams, scanned by the documents' word windows.

Words are runs of digits, letters a to z (A-Z are lower-cased) and all characters beyond ASCII. A benchmark item of `n` words or
more gives each of its n-word windows; a shorter one, if not empty, is one window. The scan looks each document word up among
the windows' longest words, hashes the token windows placed by those it finds, looks them up in the hash set, and verifies each hit
word by word, so a hash collision can't count. All of it runs in generated code, without a lambda per word.

At most `max_broadcast` windows (about 250 bytes each) are broadcast at a time; a larger set is dealt into blocks by hash, and the
documents are scanned once for each.

Cases: a null or empty text has no words and no hits; null or repeated document ids are kept, row by row (rows aren't merged by id);
null or empty items give no windows; repeated items count once by id; items without an id count as the id "null"; an empty
benchmark hits nothing; other columns, whatever their names, travel in one struct and can't clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import beside, let, lower_ascii, table, words_of, written

GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
MAX_BROADCAST = 1_000_000


def norm_words(text: Column) -> Column:
    return words_of(lower_ascii(text), GAPS)


def item_windows(bench: DataFrame, n: int = 13, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per distinct window: its hash w_hash, length w_len, words w_words and the sorted ids of its items w_items."""
    items = bench.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), norm_words(F.col(text_col)).alias("ws")).filter(F.size("ws") > 0)
    spans = F.when(F.size("ws") < n, F.array("ws")).otherwise(F.transform(F.sequence(F.lit(1), F.size("ws") - n + 1), lambda i: F.slice("ws", i, n)))
    return (
        items.select("item", F.explode(spans).alias("w_words"))
        .groupBy("w_words")
        .agg(F.array_sort(F.collect_set("item")).alias("w_items"))
        .select(F.xxhash64("w_words").alias("w_hash"), F.size("w_words").alias("w_len"), "w_words", "w_items")
    )


def _hits(base: DataFrame, windows: DataFrame, own_rows: bool) -> DataFrame:
    """A row per hit (rid, span, w_items), and with own_rows one for each document (rid, doc, n_words). Only those of the latter carry the document."""
    # Only windows that hold some benchmark window's longest word, at its place there, can hit; so only they are hashed.
    longest = F.array_max(F.transform("w_words", lambda w, i: F.struct(F.char_length(w).alias("long"), w.alias("w"), i.alias("i"))))
    anchors = windows.select(longest.alias("a"), "w_len").groupBy(F.xxhash64("a.w").alias("a_hash")).agg(F.collect_set(F.struct(F.col("a.i").alias("off"), F.col("w_len").alias("len"))).alias("a_at"))
    # One more element, empty and at place 0, stands for the document itself, so that one scan gives both the hits and every document.
    rows = base.select("doc", "rid", norm_words(F.col("text")).alias("ws"))
    rows = rows.select("doc", "ws", "rid", F.posexplode(F.concat(F.array(F.lit("")), "ws")).alias("place", "word")).withColumn("k", F.xxhash64("word"))
    own = F.col("place") == 0
    rows = rows.join(F.broadcast(anchors), F.col("k") == F.col("a_hash"), "left").filter((own if own_rows else F.lit(False)) | (~own & F.col("a_hash").isNotNull()))
    rows = rows.select("doc", "ws", "rid", "place", F.explode(F.when(own, F.array(F.struct(F.lit(0).alias("off"), F.lit(0).alias("len")))).otherwise(F.col("a_at"))).alias("a"))
    rows = rows.select("doc", "ws", "rid", "place", (F.col("place") - 1 - F.col("a.off")).alias("at"), F.col("a.len").alias("len"))
    rows = rows.filter(own | ((F.col("at") >= 0) & (F.col("at") + F.col("len") <= F.size("ws"))))
    rows = rows.withColumn("h", F.when(~own, F.xxhash64(F.slice("ws", F.greatest(F.col("at"), F.lit(0)) + 1, F.col("len")))))
    same = F.slice("ws", F.greatest(F.col("at"), F.lit(0)) + 1, F.col("len")) == F.col("w_words")
    found = rows.join(F.broadcast(windows), F.col("h") == F.col("w_hash"), "left").filter(own | (F.col("w_hash").isNotNull() & same))
    return found.select("rid", F.when(own, F.col("doc")).alias("doc"), F.when(own, F.size("ws")).alias("n_words"), F.when(~own, F.struct("at", "len")).alias("span"), F.when(~own, F.col("w_items")).alias("w_items"))


def contamination(docs: DataFrame, bench: DataFrame, n: int = 13, text_col: str = "text", bench_id: str = "item_id", bench_text: str = "text", max_broadcast: int = MAX_BROADCAST, carry: Sequence[str] | None = None) -> DataFrame:
    """One row per document row: doc (a struct of its columns, or of those in carry), n_words, n_hit (words within a hit), items (sorted ids of the items hit) and spans (sorted first word, from 0, and length of each hit)."""
    windows = written(item_windows(bench, n, bench_id, bench_text))
    blocks = max(1, -(-windows.count() // max_broadcast))
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]).alias("doc"), F.col(f"`{text_col}`").alias("text"), F.monotonically_increasing_id().alias("rid"))
    base = written(base) if blocks > 1 else base
    found = None
    for b in range(blocks):
        part = _hits(base, windows if blocks == 1 else windows.filter(F.pmod("w_hash", F.lit(blocks)) == b), b == 0)
        found = part if found is None else found.unionByName(part)
    merged = found.groupBy("rid").agg(
        F.max_by("doc", F.when(F.col("n_words").isNotNull(), F.lit(1))).alias("doc"),
        F.max("n_words").cast("bigint").alias("n_words"),
        F.array_sort(F.collect_set("span")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("w_items")))).alias("items"),
    )
    step = lambda acc, s: F.struct(F.greatest(acc["end"], s["at"] + s["len"]).alias("end"), (acc["hit"] + F.greatest(s["at"] + s["len"] - F.greatest(acc["end"], s["at"]), F.lit(0))).alias("hit"))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit"))
    return merged.select("doc", "n_words", F.aggregate("spans", start, step, lambda acc: acc["hit"]).cast("bigint").alias("n_hit"), "items", "spans")


def is_contaminated(n_hit: Column, n_words: Column, share_of: int = 20) -> Column:
    """At least a word is hit, and at least one in share_of."""
    return (n_hit > 0) & (share_of * n_hit >= n_words)


def remove_documents(docs: DataFrame, bench: DataFrame, share_of: int = 20, **options) -> DataFrame:
    """docs without the contaminated rows, columns as they were. Only hashes of texts and counts are gathered, and whole rows are shuffled only if very many
    different texts go (`beside`)."""
    text = docs[f"`{options.get('text_col', 'text')}`"]
    key = F.unhex(F.sha2(text, 256))  # equal texts are judged alike
    found = contamination(docs.select(key.alias("key"), text.alias("text")), bench, **options | {"carry": ["key"], "text_col": "text"})
    gone = written(found.filter(is_contaminated(F.col("n_hit"), F.col("n_words"), share_of)).select("doc.key").distinct())
    return beside(docs, gone, key == gone["key"], "left_anti")


def remove_spans(docs: DataFrame, bench: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs with every hit word, and what parts it from the word before it, cut from the text; other columns as they were."""
    found = contamination(docs, bench, text_col=text_col, **options)
    text = F.col("doc").getField(text_col)
    pieces = F.regexp_extract_all(text, F.lit(f"[^0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]*{WORD}"), F.lit(0))
    tail = F.regexp_extract(text, r"[^0-9A-Za-z\x{80}-\x{10FFFF}]*$", 0)
    # Neighbouring hits become one stretch, and what is left are slices between stretches, so that cost doesn't grow with hits times words.
    empty = F.array().cast("array<struct<a:int,b:int>>")
    grow = lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["b"] >= s["at"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], s["at"] + s["len"]).alias("b"))))).otherwise(F.concat(acc, F.array(F.struct(s["at"].alias("a"), (s["at"] + s["len"]).alias("b")))))
    left = lambda ps: let(F.aggregate("spans", empty, grow), lambda m: F.flatten(F.zip_with(F.concat(F.array(F.lit(0)), F.transform(m, lambda x: x["b"])), F.concat(F.transform(m, lambda x: x["a"]), F.array(F.size(ps))), lambda a, b: F.slice(ps, a + 1, b - a))))
    cut = F.when(F.col("n_hit") > 0, F.concat(F.array_join(let(pieces, left), ""), tail)).otherwise(text)
    return found.select(F.col("doc").withField(f"`{text_col}`", cut).alias("doc")).select("doc.*")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select(
        F.col("doc.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def sql(documents: str = "documents") -> str:
    return rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM {documents}),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS w, least(13, len(ws)) AS k
       FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS w FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, ks WHERE len(ws) >= k)),
hits AS (SELECT DISTINCT doc_id, dw.k, i, item_id FROM dw JOIN bw ON dw.w = bw.w AND dw.k = bw.k),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""


SQL = sql()
