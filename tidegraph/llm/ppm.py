"""Language-model scoring by prediction by partial matching: a byte-context trie, escapes estimated by method C, symbol exclusion.

Texts are bytes with A-Z lower-cased, then one end symbol (0xFF, which UTF-8 never has; it also fills the context before the first
byte). The trie holds, for every context of up to ORDER bytes in the training texts, how often each symbol follows. A symbol is
coded in the longest known context: found, with probability count / (total + distinct); else by an escape, distinct / (total +
distinct), to the next shorter one, where symbols of the context left are excluded from both sums; below order 0 all symbols
not yet seen are alike. As the training is over before the scoring, a context's sums under exclusion depend on it and its one
longer context only and are worked out once, for all of the trie at a time.

Counts come from all training texts: summed in each task, then by key. The order is the same at every size. A trie of up to MAX_NODES
strings goes to the workers whole. A larger one stays distributed, and scores are the same: texts are dealt into blocks of BLOCK bytes,
each block's distinct strings meet the part of the trie that holds their contexts (by the context's last 3 bytes; orders up to LOW, of
2**24 entries at most, are broadcast), and every block's texts then meet their own strings' probabilities.
Word counts of the base score are broadcast up to MAX_WORDS distinct words, and joined on the word's hash beyond.

`adaptive` is the other mode: a text's code length under a trie that starts empty and learns from the text as it goes.

Cases: a null text is the empty one, of one end token; without training texts all words are unknown and all bytes alike; a null id
counts as the empty text in the split; repeated rows are scored each, and counted each in training; carried columns of the added names
are replaced by them; a text over CHUNK bytes is looked at in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _vec as V
from ._common import table, written
from .language import split_number

ORDER, MAX_NODES, MAX_WORDS, END = 5, 6_000_000, 8_000_000, 0xFF
LOW = 2  # the orders that are broadcast at any size
PART = 1_000_000  # strings of a distributed trie in one task
BLOCK = 32_000_000  # bytes of text whose distinct strings are looked up together
CHUNK = 400_000  # bytes looked at together
ROW_BITS = 14  # rows of a batch, beside 6 bytes in a sort key of 63 bits
ADDED = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
END_WORD = -1  # the end token's key among the words' hashes


def grams(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol with its `order` predecessors, packed oldest first, and its text; every text has its end symbol."""
    n, rows = len(data), len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(offsets) + 1)
    own = np.full(n + rows, END, dtype=np.int64)
    own[np.arange(n) + np.repeat(np.arange(rows), np.diff(offsets))] = V.LOWER[data]
    place = np.arange(n + rows) - (offsets[:-1] + np.arange(rows))[row]
    out = own.copy()
    for k in range(1, order + 1):
        before = np.full(n + rows, END, dtype=np.int64)
        before[k:] = own[:-k]
        out |= np.where(place >= k, before, END) << (8 * k)
    return out, row


def looked_at(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What `grams` gives for a chunk's texts; for a single very long one, piece by piece."""
    if len(offsets) > 2 or len(data) <= 2 * CHUNK:
        yield grams(data, offsets, order)
        return
    for at in range(0, len(data), CHUNK):
        own = data[max(at - order, 0) : at + CHUNK]
        g, row = grams(own, np.array([0, len(own)]), order)
        kept = slice(min(at, order), None if at + CHUNK >= len(data) else -1)  # not its first context, nor an end symbol before the end
        yield g[kept], row[kept]


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([np.zeros(0, np.int64), *(p[0] for p in parts)])
    n = np.concatenate([np.zeros(0, np.int64), *(p[1] for p in parts)])
    by = np.argsort(keys, kind="stable")
    keys, n = keys[by], n[by]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind (0 words, 1 grams), key and n, summed within the task."""
    parts: list[list] = [[], []]

    def flush(kind: int) -> pa.RecordBatch:
        keys, n = merged(parts[kind])
        parts[kind] = []
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(n)], names=["kind", "key", "n"])

    texts = 0
    for batch in batches:
        texts += batch.num_rows
        for _, _, data, offsets in V.chunks(batch.column("text"), CHUNK):
            parts[0].append(runs(V.word_hashes(data, offsets)[0].view(np.int64)))
            parts[1].extend(runs(g) for g, _ in looked_at(data, offsets))
            for kind in (0, 1):
                if sum(len(p[0]) for p in parts[kind]) > 1_000_000:
                    parts[kind] = [merged(parts[kind])]
                    if len(parts[kind][0][0]) > 500_000:
                        yield flush(kind)
    parts[0].append((np.array([END_WORD]), np.array([texts])))
    yield flush(0)
    yield flush(1)


class Trie:
    """From counts of (ORDER + 1)-byte strings: per order the known strings with counts, and per context its sums with and without exclusion.

    below: a trie of lower order whose levels are taken as they are; keys are then all strings of the contexts they have."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, order: int, below: Trie | None = None):
        self.order, self.levels = order, list(below.levels) if below else []
        lower: dict | None = self.levels[-1] if below else None
        for k in range(len(self.levels), order + 1):
            own, counts = merged([(keys & ((1 << 8 * (k + 1)) - 1), n)])
            ctx, first = np.unique(own >> 8, return_index=True)
            many = np.diff(np.append(first, len(own)))
            level = {"keys": own, "n": counts, "ctx": ctx, "total": np.add.reduceat(counts, first) if len(first) else counts, "distinct": many}
            if lower is not None:  # what is left of the shorter context's sums once this one's symbols are excluded
                at = np.searchsorted(lower["keys"], own & ((1 << 8 * k) - 1))
                up = np.searchsorted(lower["ctx"], ctx & ((1 << 8 * (k - 1)) - 1))
                level["left_total"] = lower["total"][up].astype(np.int64) - (np.add.reduceat(lower["n"][at].astype(np.int64), first) if len(first) else 0)
                level["left_distinct"] = lower["distinct"][up] - many
            self.levels.append(lower := {name: self._narrow(name, x) for name, x in level.items()})

    @staticmethod
    def _narrow(name: str, x: np.ndarray) -> np.ndarray:
        """Counts in as few bytes as hold them: workers keep a trie each."""
        if name in ("keys", "ctx"):
            return x
        return x.astype(np.int16 if "distinct" in name else np.uint32 if x.max(initial=0) < 2**32 else np.int64)

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 probabilities of each gram's last byte after those before it."""
        out, open_ = np.zeros(len(grams)), np.arange(len(grams))
        longer = np.full(len(grams), -1)  # the context escaped from
        for k in range(self.order, -1, -1):
            level = self.levels[k]
            if not len(level["ctx"]) or not len(open_):
                continue
            key = grams[open_] & ((1 << 8 * (k + 1)) - 1)
            c = np.minimum(np.searchsorted(level["ctx"], key >> 8), len(level["ctx"]) - 1)
            known = level["ctx"][c] == key >> 8
            total, distinct = level["total"][c].astype(float), level["distinct"][c].astype(float)
            if k < self.order and "left_total" in (above := self.levels[k + 1]):
                cut = longer[open_] >= 0
                total[cut], distinct[cut] = above["left_total"][longer[open_][cut]], above["left_distinct"][longer[open_][cut]]
            s = np.minimum(np.searchsorted(level["keys"], key), len(level["keys"]) - 1)
            found = known & (level["keys"][s] == key)
            whole = np.log10(np.maximum(total + distinct, 1))
            out[open_[found]] += np.log10(level["n"][s[found]]) - whole[found]
            escapes = known & ~found & (distinct > 0)
            out[open_[escapes]] += np.log10(distinct[escapes]) - whole[escapes]
            longer[open_] = np.where(known, c, -1)
            open_ = open_[~found]
        seen = len(self.levels[0]["keys"])
        out[open_] -= np.log10(max(256 - seen, 1))
        return out


def adaptive(text: str | None, order: int = ORDER) -> float:
    """log10 probability of a text under a trie that starts empty and counts each symbol in all its contexts after coding it."""
    data = (text or "").encode().translate(bytes(V.LOWER)) + bytes([END])
    trie: dict[bytes, dict[int, int]] = {}
    out = 0.0
    for i, symbol in enumerate(data):
        excluded: set[int] = set()
        for k in range(min(order, i), -1, -1):
            seen = trie.get(data[i - k : i])
            if seen:
                left = {s: c for s, c in seen.items() if s not in excluded}
                whole = sum(left.values()) + len(left)
                if symbol in left:
                    out += np.log10(left[symbol] / whole)
                    break
                if left:
                    out += np.log10(len(left) / whole)
                excluded |= seen.keys()
        else:
            out -= np.log10(256 - len(excluded))
        for k in range(min(order, i) + 1):
            seen = trie.setdefault(data[i - k : i], {})
            seen[symbol] = seen.get(symbol, 0) + 1
    return float(out)


def train(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """kind (0: words, 1: byte strings of ORDER + 1), key and n over all of docs; written to the shared folder."""
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return written(rows.mapInArrow(_counted, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).filter("n > 0"))


def level_of(counts: DataFrame, order: int) -> DataFrame:
    """key and n of the strings of order + 1 bytes."""
    return counts.filter("kind = 1").groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1)).alias("key")).agg(F.sum("n").alias("n"))


def trie_of(level: DataFrame, order: int) -> Trie:
    found = level.toArrow()
    return Trie(found.column("key").to_numpy(), found.column("n").to_numpy(), order)


def _known(keys: np.ndarray, p: np.ndarray):
    """The probabilities of a block's own strings, given in order of key."""
    return lambda g: p[np.searchsorted(keys, g)]


def _blocked(size: int):
    """Each row with its block: consecutive texts of a task, of about `size` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, done = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
            block = first + (done + np.cumsum(sizes)) // size
            done += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([pa.array(block), batch.column("row"), batch.column("text")], names=["block", "row", "text"])

    return run


def _of_blocks(order: int):
    """block and key: the distinct strings of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, now = [], None

        def flush() -> Iterator[pa.RecordBatch]:
            if parts:
                keys = np.unique(np.concatenate(parts))
                for k in range(0, len(keys), 200_000):
                    own = keys[k : k + 200_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), now)), pa.array(own)], names=["block", "key"])
            parts.clear()

        for batch in batches:
            block = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)] if len(block) else [0]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if block[a] != now:
                    yield from flush()
                    now = int(block[a])
                for _, _, data, offsets in V.chunks(batch.column("text").slice(a, b - a), CHUNK):
                    parts.extend(np.unique(g & ((1 << 8 * (order + 1)) - 1)) for g, _ in looked_at(data, offsets))
                if sum(map(len, parts)) > 4_000_000:
                    parts[:] = [np.unique(np.concatenate(parts))]
        yield from flush()

    return run


def _looked_up(below, order: int):
    """block, key and p of rows of a block, from the trie's rows (block null), which a task has first, for all contexts of its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, trie = [], None
        for batch in batches:
            of_trie = batch.filter(pc.is_null(batch.column("block")))
            if of_trie.num_rows:
                parts.append((of_trie.column("key").to_numpy(), of_trie.column("n").to_numpy()))
            asked = batch.filter(pc.is_valid(batch.column("block")))
            if asked.num_rows:
                if trie is None:
                    trie, parts = Trie(*merged(parts), order, below.value), []
                yield pa.RecordBatch.from_arrays([asked.column("block"), asked.column("key"), pa.array(trie.log10(asked.column("key").to_numpy()))], names=["block", "key", "p"])

    return run


def score(
    docs: DataFrame, counts: DataFrame, keep: list[str | Column], text_col: str = "text", order: int = ORDER, max_nodes: int | None = None, max_words: int = MAX_WORDS, max_held: int = MAX_NODES
) -> DataFrame:
    """keep's columns, n_tokens, n_known, train_tokens, base_score (words, add-one) and score (the trie's log10 probability).

    max_nodes, if given, lowers the order, to 2 at least, until the trie has so many entries; a trie of over max_held stays distributed."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    words = counts.filter("kind = 0").select("key", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    denominator = float(np.log10(total + distinct + 1))
    small = distinct <= max_words
    level = level_of(counts, order)
    nodes = level.count()
    while max_nodes is not None and order > 2 and nodes > max_nodes:
        order -= 1
        level = level_of(counts, order)
        nodes = level.count()
    whole = order <= LOW or nodes <= max_held
    trie = sc.broadcast(trie_of(level, order) if whole else trie_of(level_of(counts, LOW), LOW))
    vocabulary = None
    if small:
        held = words.toArrow()
        key, n = held.column("key").to_numpy(), held.column("n").to_numpy()
        by = np.argsort(key)
        vocabulary = sc.broadcast((key[by], n[by].astype(np.float32 if n.max(initial=0) < 2**24 else np.float64)))

    def scored(given: pa.Array, texts: pa.Array, log10) -> pa.RecordBatch:
        made: list[list] = [[], [], [], []]
        listed, bounds = [], [0]
        for at, end, data, offsets in (c for k in range(0, len(texts), 1 << ROW_BITS) for c in V.chunks(texts.slice(k, 1 << ROW_BITS), CHUNK)):
            rows = end - at
            made[3].append(np.zeros(rows))
            for g, row in looked_at(data, offsets):
                g &= (1 << 8 * (order + 1)) - 1
                by = np.sort((g << ROW_BITS) | row)
                g, row = by >> ROW_BITS, by & ((1 << ROW_BITS) - 1)
                first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
                each = np.repeat(log10(g[first]), np.diff(np.append(first, len(g))))
                made[3][-1] += np.bincount(row, weights=each, minlength=rows)
            hashed, row = V.word_hashes(data, offsets)
            hashed = np.concatenate([hashed.view(np.int64), np.full(rows, END_WORD)])
            row = np.concatenate([row, np.arange(rows)])
            made[0].append(np.bincount(row, minlength=rows))
            if vocabulary is not None:
                own, where = np.unique(hashed, return_inverse=True)
                key, n = vocabulary.value
                p = np.minimum(np.searchsorted(key, own), max(len(key) - 1, 0))
                c = np.where(key[p] == own, n[p], 0).astype(float) if len(key) else np.zeros(len(own))
                made[1].append(np.bincount(row, weights=(c > 0)[where], minlength=rows))
                made[2].append(np.bincount(row, weights=(np.log10(c + 1) - denominator)[where], minlength=rows))
            else:
                by = np.argsort(row, kind="stable")
                listed.append(hashed[by])
                bounds += (bounds[-1] + np.cumsum(made[0][-1])).tolist()
        joined = [np.concatenate([np.zeros(0), *m]) for m in made]
        cols = [given, pa.array(joined[0].astype(np.int64)), pa.array(joined[3])]
        if vocabulary is not None:
            cols += [pa.array(joined[1].astype(np.int64)), pa.array(joined[2])]
        else:
            cols += [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *listed])))]
        return pa.RecordBatch.from_arrays(cols, names=["row", "n_tokens", "score", *(("n_known", "base_score") if vocabulary is not None else ("words",))])

    def by_trie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield scored(batch.column("row"), batch.column("text"), trie.value.log10)

    def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each block its strings, in order, then its texts."""
        now, keys, p, log10 = None, [], [], None
        for batch in batches:
            block = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)] if len(block) else [0]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if block[a] != now:
                    now, keys, p, log10 = block[a], [], [], None
                part = batch.slice(a, b - a)
                strings = part.filter(pc.is_valid(part.column("key")))
                if strings.num_rows:
                    keys.append(strings.column("key").to_numpy())
                    p.append(strings.column("p").to_numpy())
                texts = part.filter(pc.is_null(part.column("key")))
                if texts.num_rows:
                    log10 = log10 or _known(np.concatenate(keys), np.concatenate(p))
                    yield scored(texts.column("row"), texts.column("text"), log10)

    keep = [c for c in keep if not isinstance(c, str) or c not in ADDED]
    rows = docs.select(F.struct(*keep).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    given = rows.schema["row"].dataType.simpleString()
    kind = f"row {given}, n_tokens long, score double, " + ("n_known long, base_score double" if small else "words array<bigint>")
    if whole:
        out = rows.mapInArrow(by_trie, kind)
    else:
        rows = written(rows.mapInArrow(_blocked(BLOCK), f"block long, row {given}, text string"))
        asked = rows.mapInArrow(_of_blocks(order), "block long, key long").select("block", "key", F.lit(None).cast("bigint").alias("n"))
        both = level.select(F.lit(None).cast("bigint").alias("block"), "key", "n").unionByName(asked)
        context = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 24) - 1))
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-nodes // PART))
        found = both.repartition(tasks, context).sortWithinPartitions(F.col("block").asc_nulls_first()).mapInArrow(_looked_up(trie, order), "block long, key long, p double")
        found = found.select("block", "key", "p", F.lit(None).cast(rows.schema["row"].dataType).alias("row"), F.lit(None).cast("string").alias("text"))
        texts = rows.select("block", F.lit(None).cast("bigint").alias("key"), F.lit(None).cast("double").alias("p"), "row", "text")
        out = found.unionByName(texts).repartition("block").sortWithinPartitions("block", F.col("key").asc_nulls_last()).mapInArrow(by_block, kind)
    if not small:
        out = written(out).withColumn("_r", F.monotonically_increasing_id())
        out = written(out)
        found = out.select("_r", F.explode("words").alias("key")).groupBy("_r", "key").agg(F.count(F.lit(1)).alias("tf")).join(words, "key", "left")
        found = found.groupBy("_r").agg(F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("n_known"), F.sum(F.col("tf") * (F.log10(F.coalesce("n", F.lit(0)) + 1) - denominator)).alias("base_score"))
        out = out.join(found, "_r")
    return out.select("row.*", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score")


def op10_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = split_number(F.col("doc_id"), 7) == 2
    out = score(docs, train(docs.filter(~held_out)), ["doc_id", held_out.alias("held_out")])
    return out.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})  # sums of many logarithms; what lies beyond depends on their order


def _sql(order: int = ORDER) -> str:
    """The query for a table whose ids are there and differ: counts of all strings of up to order + 1 bytes as tables, and each distinct string's path of escapes."""
    byte_list = "list_transform(string_split(trim(regexp_replace(hex(encode({0})), '(..)', '\\1 ', 'g')), ' '), lambda h: ('0x' || h)::{1})"
    bits = byte_list.format("CAST(doc_id AS VARCHAR)", "UBIGINT")
    crc = f"xor(list_reduce([4294967295::UBIGINT] || flatten(list_transform({bits}, lambda b: list_transform([0, 1, 2, 3, 4, 5, 6, 7], lambda k: (b >> k) & 1))), lambda c, x: xor(c >> 1, CASE WHEN c & 1 <> x THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)), 4294967295::UBIGINT)"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    packed = " | ".join(f"(cs[i - {k}] << {8 * k})" for k in range(order + 1))
    mask = "((1::BIGINT << (8 * ({0}))) - 1)"
    return rf"""
WITH d AS (SELECT doc_id, {crc} % 7 = 2 AS held_out, {low} AS t FROM documents),
words AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') || [chr(0) || ' end']) AS w FROM d),
known AS (SELECT w, count(*) AS c FROM words JOIN d USING (doc_id) WHERE NOT held_out GROUP BY w),
whole AS (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS n, count(*) AS v FROM known),
base AS (SELECT doc_id, count(*) AS n_tokens, count(known.w) AS n_known, any_value(whole.n) AS train_tokens, sum(log10(CAST(coalesce(c, 0) + 1 AS DOUBLE)) - log10(CAST(whole.n + v + 1 AS DOUBLE))) AS base_score FROM words LEFT JOIN known USING (w), whole GROUP BY doc_id),
symbols AS (SELECT doc_id, held_out, {[255] * order}::BIGINT[] || (CASE WHEN t = '' THEN []::BIGINT[] ELSE {byte_list.format("t", "BIGINT")} END) || [255::BIGINT] AS cs FROM d),
grams AS (SELECT doc_id, held_out, {packed} AS g, count(*) AS n FROM (SELECT doc_id, held_out, cs, unnest(range({order + 1}, len(cs) + 1)) AS i FROM symbols) GROUP BY ALL),
orders AS (SELECT CAST(unnest(range(0, {order + 1})) AS BIGINT) AS k),
level AS (SELECT k, g & {mask.format("k + 1")} AS g, CAST(sum(n) AS BIGINT) AS n FROM grams, orders WHERE NOT held_out GROUP BY ALL),
ctx AS (SELECT k, g >> 8 AS c, CAST(sum(n) AS BIGINT) AS total, count(*) AS kinds FROM level GROUP BY ALL),
-- What a context's symbols leave of the sums of the next shorter one.
gone AS (SELECT a.k - 1 AS k, a.g >> 8 AS c, CAST(sum(b.n) AS BIGINT) AS total, count(*) AS kinds FROM level a JOIN level b ON b.k = a.k - 1 AND b.g = a.g & {mask.format("a.k")} GROUP BY ALL),
each AS (SELECT DISTINCT g FROM grams),
steps AS (SELECT e.g, o.k, level.n, ctx.total - coalesce(gone.total, 0) AS total, ctx.kinds - coalesce(gone.kinds, 0) AS kinds FROM each e CROSS JOIN orders o
  JOIN ctx ON ctx.k = o.k AND ctx.c = (e.g & {mask.format("o.k + 1")}) >> 8
  LEFT JOIN level ON level.k = o.k AND level.g = e.g & {mask.format("o.k + 1")}
  LEFT JOIN gone ON gone.k = o.k AND gone.c = (e.g & {mask.format("o.k + 2")}) >> 8 AND o.k < {order}),
last AS (SELECT g, max(CASE WHEN n IS NOT NULL THEN k END) AS f FROM steps GROUP BY g),
told AS (SELECT each.g, coalesce(sum(CASE WHEN k = f THEN log10(CAST(n AS DOUBLE)) - log10(CAST(total + kinds AS DOUBLE)) WHEN k > coalesce(f, -1) AND kinds > 0 THEN log10(CAST(kinds AS DOUBLE)) - log10(CAST(total + kinds AS DOUBLE)) END), 0)
  - CASE WHEN any_value(f) IS NULL THEN log10(CAST(greatest(256 - (SELECT count(*) FROM level WHERE k = 0), 1) AS DOUBLE)) ELSE 0 END AS p FROM each LEFT JOIN steps USING (g) LEFT JOIN last ON last.g = each.g GROUP BY each.g),
scores AS (SELECT doc_id, sum(n * p) AS score FROM grams JOIN told USING (g) GROUP BY doc_id)
SELECT doc_id, held_out, n_tokens, n_known, train_tokens, round(base_score, 6) AS base_score, round(score, 6) AS score FROM d JOIN base USING (doc_id) JOIN scores USING (doc_id)
"""


SQL = _sql()
