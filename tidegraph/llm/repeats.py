"""Removal of long repeated byte strings, found with run-length compressed indexes over what can repeat.

A byte goes if a string of LENGTH bytes that covers it starts anywhere else too, in the same text or another. The steps:

1. Every LENGTH-byte window has an anchor, the leftmost of its K-byte strings of the least hash; equal windows have equal anchors
   at equal places. Neighbouring windows that share one are a run, and the bytes they cover a context, so every window is in one
   context, just once.
2. Contexts are counted by content (map-side first, so groups of copies cost little). One that is there twice is repeated as a whole.
   Of the others, those whose anchor's bytes occur in another context too have to be compared; all else is done.
3. Contexts of an anchor, one for each content, meet in a task. There they form blocks of about BLOCK bytes; over each a run-compressed
   Burrows-Wheeler transform is built, with samples at both ends of every run, and the matching statistics of the block's contexts
   against all others of it are streamed by walking back through the runs (`RunLengthIndex`). Windows whose length is LENGTH or
   more are repeated. Contexts none of whose windows' hashes is found twice stay out of the index. Anchors with over HOT contexts aren't gathered: their windows' hashes are counted by key instead, by the same rule.
4. Per text, repeated windows become spans. Texts with an equal one elsewhere go as a whole; others with any span are joined to
   theirs and cut; texts without any aren't moved.

Keys that many rows share (a common passage's anchor or context) aren't dealt to one task: those with over HUB rows, a limit that rises
with the rows so that at most MAX_HUBS keys are above it, are broadcast to the rows. Lists of texts are broadcast up to MAX_BROADCAST rows.

Cases: null is the empty text; texts under LENGTH bytes have no windows; matches never cross texts; equal texts are known by their
MD5, so repeated rows and ids, null ids included, are each cut alike; very long texts are looked at in pieces; an empty table gives an
empty result; carried columns of the added names are replaced by them. Compared hashes have 64 bits, beside an equal 64-bit anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _vec as V
from ._common import beside, drop, hubs_apart, table, written

LENGTH, K, BLOCK, HOT, CHUNK, PIECE = 400, 128, 1_000_000, 1500, 250_000, 2_000_000
ADDED = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]


class RunLengthIndex:
    """The run-compressed BWT of a collection of byte strings: where each run starts, its length, the row that its first one leads to (LF), and sampled at
    both ends of each run, how many bytes the suffix that the end leads to has in common with its neighbour beyond the run."""

    def __init__(self, parts: list[bytes]):
        m = len(parts)
        self.sizes = np.array([len(p) for p in parts])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes + 1)])[:-1]
        text = np.empty(int(self.sizes.sum()) + m, dtype=np.int64)  # each part, then a separator of its own
        inside = np.ones(len(text), dtype=bool)
        inside[self.starts + self.sizes] = False
        text[inside] = np.frombuffer(b"".join(parts), dtype=np.uint8).astype(np.int64) + m
        text[~inside] = np.arange(m)
        order, levels = self._suffixes(text)
        last = text[order - 1]  # of the text before the first byte: the last separator
        self.heads = np.flatnonzero(np.concatenate([[True], last[1:] != last[:-1]]))
        self.lengths = np.diff(np.append(self.heads, len(last)))
        by = np.argsort(last[self.heads], kind="stable")
        self.leads = np.empty_like(self.heads)
        self.leads[by] = np.cumsum(self.lengths[by]) - self.lengths[by]
        self.n, ends = len(text), self.leads + self.lengths - 1
        self.above = self._common(text, levels, order[self.leads], np.where(self.leads > 0, order[self.leads - 1], -1))
        self.below = self._common(text, levels, order[ends], np.where(ends < self.n - 1, order[np.minimum(ends + 1, self.n - 1)], -1))

    @staticmethod
    def _suffixes(text: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Suffix positions in order, by doubling, where only groups of several are sorted again; and the ranks by the first k symbols, for k = 3, 6, 12 and so on.
        Separators are all different, so it ends at the longest part."""
        n = len(text)
        wide = np.concatenate([text + 1, [0, 0]])
        key, k = (wide[:n] << 42) | (wide[1 : n + 1] << 21) | wide[2 : n + 2], 3
        order = np.argsort(key)
        own = key[order]
        head = np.concatenate([[True], own[1:] != own[:-1]])
        rank = np.zeros(n + 1, dtype=np.int64)  # the place of the group's first in order, from 1; 0 beyond the end
        rank[order] = np.maximum.accumulate(np.where(head, np.arange(1, n + 1), 0))
        levels = [(k, rank.astype(np.int32))]
        while len(open_ := np.flatnonzero(~(head & np.append(head[1:], True)))):
            at = order[open_]
            key = (rank[at] << 32) | rank[np.minimum(at + k, n)]
            by = np.argsort(key)
            at, key = at[by], key[by]
            order[open_] = at
            first = np.concatenate([[True], key[1:] != key[:-1]])
            head[open_] = first
            rank[at] = np.maximum.accumulate(np.where(first, open_ + 1, 0))
            k *= 2
            levels.append((k, rank.astype(np.int32)))
        return order, levels

    @staticmethod
    def _common(text: np.ndarray, levels: list[tuple[int, np.ndarray]], at: np.ndarray, other: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at both places have in common, by their ranks; 0 without another."""
        n, there = len(text), other >= 0
        out, other = np.zeros(len(at), dtype=np.int64), np.maximum(other, 0)
        for k, rank in reversed(levels):
            p, q = np.minimum(at + out, n), np.minimum(other + out, n)
            out += np.where(there & (p < n) & (rank[p] == rank[q]), k, 0)
        for _ in range(2):
            p, q = at + out, other + out
            same = there & (p < n) & (q < n)
            same[same] = text[p[same]] == text[q[same]]
            there = same
            out += same
        return out

    def statistics(self) -> np.ndarray:
        """For every position, separators included, how many bytes from it also start at another position. All parts are walked back from their ends at a time:
        inside a run both neighbours come along and share a byte more with each step, at its ends the samples tell."""
        out = np.zeros(self.n, dtype=np.int64)
        by = np.argsort(-self.sizes, kind="stable")
        sizes, row = self.sizes[by], by.copy()  # the i-th separator's suffix is the i-th
        place, up, down = (self.starts + self.sizes)[by], np.zeros(len(by), np.int64), np.zeros(len(by), np.int64)
        for step in range(int(sizes.max(initial=0))):
            live = int(np.searchsorted(-sizes, -step, "left"))  # the parts of over `step` bytes
            run = np.searchsorted(self.heads, row[:live], "right") - 1
            off = row[:live] - self.heads[run]
            up = np.where(off == 0, self.above[run], up[:live] + 1)
            down = np.where(off == self.lengths[run] - 1, self.below[run], down[:live] + 1)
            row, place = self.leads[run] + off, place[:live] - 1
            out[place] = np.maximum(up, down)
        return out

    def repeated(self, length: int = LENGTH) -> Iterator[np.ndarray]:
        """For each part, whether its window at each place is found elsewhere in the collection."""
        long = self.statistics() >= length
        for a, b in zip(self.starts, self.starts + self.sizes, strict=True):
            yield long[a : max(a, b - length + 1)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the K bytes from each place, joined from those of half as many, from 8 bytes on."""
    n = len(data) - K + 1
    h, k = V.blocks_of(data)[: len(data) - 7] ^ V.SEED, 8
    while k < K:
        h = h[:-k] * np.uint64(V.BASE) + (h[k:] ^ (h[k:] >> np.uint64(29)))
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        k *= 2
    return V.mixed(h)[:n]


def joined_hashes(grams: np.ndarray, starts: np.ndarray, sizes: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Hashes of the strings of `sizes` bytes (K or more) at starts, from those of K bytes that cover them; start: what each begins with."""
    out, last = V.mixed(sizes.astype(np.uint64) * np.uint64(V.BASE) + start.astype(np.uint64)), starts + sizes - K
    for at in range(0, int(sizes.max(initial=0)), K):
        more = np.flatnonzero(sizes > at)
        out[more] = V.mixed(out[more] * np.uint64(V.BASE) + grams[np.minimum(starts[more] + at, last[more])])
    return out


def windows_least(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by running minima from both ends of blocks."""
    n = len(key)
    blocks = -(-n // width)
    own = np.full(blocks * width, 2**64 - 1, dtype=np.uint64)
    own[:n] = key
    own = own.reshape(blocks, width)
    fore = np.minimum.accumulate(own, axis=1).ravel()
    back = np.minimum.accumulate(own[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], fore[width - 1 : n])


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> dict[str, np.ndarray]:
    """The runs of windows of a chunk's texts: text row, anchor hash, anchor place in the text, places of the first and last window before it, and the context's hash."""
    made = np.maximum(np.diff(offsets) - length + 1, 0)
    row = np.repeat(np.arange(len(offsets) - 1), made)
    if not len(row):
        return {k: np.zeros(0, np.int64) for k in ("row", "anchor", "at", "lo", "hi", "ctx")}
    grams = gram_hashes(data)
    n = len(grams)
    mask = np.uint64((1 << max(1, n.bit_length())) - 1)
    best = (windows_least((grams & ~mask) | np.arange(n, dtype=np.uint64), length - K + 1) & mask).astype(np.int64)
    start = np.arange(len(row)) - np.repeat(np.cumsum(made) - made, made) + offsets[row]
    anchor = best[start]
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]))
    end = np.append(first[1:], len(row)) - 1
    a, row = anchor[first], row[first]
    lo, hi = start[first], start[end]
    ctx = joined_hashes(grams, lo, hi + length - lo, a - lo)
    return {"row": row, "anchor": grams[a].view(np.int64), "at": a - offsets[row], "lo": a - lo, "hi": a - hi, "ctx": ctx.view(np.int64)}


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, cls = batch.column("text"), batch.column("cls")
        for at, end, data, offsets in V.chunks(texts, CHUNK):
            # A very long text is taken in pieces that overlap, each with the windows that start in it.
            pieces = [(0, data, offsets)] if len(data) <= PIECE + LENGTH else [(p, own := data[p : p + PIECE + LENGTH - 1], np.array([0, len(own)])) for p in range(0, len(data), PIECE)]
            for begun, data_, offsets_ in pieces:
                r = runs_of(data_, offsets_)
                r["at"] = r["at"] + begun
                yield pa.RecordBatch.from_arrays([cls.slice(at, end - at).take(pa.array(r["row"])), *(pa.array(r[k], pa.int64()) for k in ("anchor", "ctx")), *(pa.array(r[k].astype(np.int32)) for k in ("at", "lo", "hi"))], names=["cls", "anchor", "ctx", "at", "lo", "hi"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the listed contexts of each text."""
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for text, runs in zip(batch.column("text"), batch.column("runs").to_pylist(), strict=True):
            data = text.as_buffer().to_pybytes()
            for r in runs:
                out[0].append(r["anchor"])
                out[1].append(r["ctx"])
                out[2].append(data[r["at"] - r["lo"] : r["at"] - r["hi"] + LENGTH])
                out[3].append(r["hot"])
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.bool_())], names=["anchor", "ctx", "bytes", "hot"])


def _stretches(marks: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()


_MARKS = "anchor long, ctx long, froms array<int>, tos array<int>"


def _maybe_repeated(parts: list[bytes]) -> np.ndarray:
    """Which contexts have a window whose hash another window has too: the others have nothing for an index to find."""
    size = np.array([len(p) for p in parts], dtype=np.int64)
    if not len(size):
        return np.zeros(0, dtype=bool)
    n = size - LENGTH + 1
    of = np.repeat(np.arange(len(parts)), n)
    place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(np.cumsum(size) - size, n)
    h = joined_hashes(gram_hashes(np.frombuffer(b"".join(parts), np.uint8)), place, np.full(len(of), LENGTH), np.zeros(len(of)))
    by = np.argsort(h)
    same = h[by][1:] == h[by][:-1]
    twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    return np.bincount(of[by[twice]], minlength=len(parts)) > 0


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of contexts sorted by anchor: for each with any, the stretches of its windows found elsewhere."""
    held: list[tuple[int, int, bytes]] = []

    def index() -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        held[:] = [h for h, maybe in zip(held, _maybe_repeated([h[2] for h in held]), strict=True) if maybe]
        if held:
            for (anchor, ctx, _), marks in zip(held, RunLengthIndex([h[2] for h in held]).repeated(), strict=True):
                if marks.any():
                    froms, tos = _stretches(marks)
                    for o, x in zip(out, (anchor, ctx, froms, tos), strict=True):
                        o.append(x)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), *(pa.array(x, pa.list_(pa.int32())) for x in out[2:])], names=["anchor", "ctx", "froms", "tos"])

    size, group = 0, 0
    for batch in batches:
        for x in zip(batch.column("anchor").to_pylist(), batch.column("ctx").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
            if held and x[0] != held[-1][0]:
                if size > BLOCK:
                    yield index()
                    size = 0
            held.append(x)
            size += len(x[2])
    yield index()


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for anchor, ctx, data in zip(batch.column("anchor").to_pylist(), batch.column("ctx").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
            own = np.frombuffer(data, dtype=np.uint8)
            n = len(own) - LENGTH + 1
            h = joined_hashes(gram_hashes(own), np.arange(n), np.full(n, LENGTH), np.zeros(n)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, anchor)), pa.array(np.full(n, ctx)), pa.array(h), pa.array(np.arange(n, dtype=np.int32))], names=["anchor", "ctx", "h", "w"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], [], [], []]
        for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
            data = text.as_buffer().to_pybytes()
            ends: list[list[int]] = []
            for a, b in sorted((s["a"], s["b"]) for s in spans):
                if ends and a <= ends[-1][1]:
                    ends[-1][1] = max(ends[-1][1], b)
                else:
                    ends.append([a, b])
            at, kept = 0, []
            for a, b in ends:
                kept.append(data[at:a])
                at = b
            left = b"".join([*kept, data[at:]])
            for o, x in zip(out, (len(data), len(data) - len(left), len(ends), hashlib.sha256(left).hexdigest(), left, [{"a": a, "b": b} for a, b in ends]), strict=True):
                o.append(x)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))]
        yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(o, k) for o, k in zip(out, kinds, strict=True))], names=["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])


def repeated_spans(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The text's MD5 and its repeated spans (a, b in bytes, perhaps overlapping), a row for each; written to the shared folder. And the same as one row per MD5."""
    keyed = docs.select(F.unhex(F.md5(F.col(text_col))).alias("cls"), F.col(text_col).alias("text")).filter(F.octet_length("text") >= LENGTH)
    runs = written(keyed.mapInArrow(_found, "cls binary, anchor long, ctx long, at int, lo int, hi int"))
    often = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    total = runs.count()
    twice = written(hubs_apart(runs, often, ["anchor"], total).drop("n"))
    drop(runs)
    alike = written(twice.groupBy("anchor", "ctx").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("cls", "at", "lo", "hi")).alias("r")))
    kinds = alike.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    open_ = written(hubs_apart(alike, kinds, ["anchor"], total).withColumnRenamed("n", "kinds"))
    spans_of = lambda rows, first, last: rows.select("cls", (F.col("at") - F.col("lo") + first).alias("a"), (F.col("at") - F.col("lo") + last + LENGTH - 1).alias("b"))
    whole = spans_of(hubs_apart(twice, alike.filter("c > 1").select("anchor", "ctx", F.col("c").alias("n")), ["anchor", "ctx"], total), F.lit(0), F.col("lo") - F.col("hi") + 1).distinct()
    # Each content that has to be compared comes from one text that holds it.
    listed = open_.groupBy("r.cls").agg(F.collect_list(F.struct("anchor", "ctx", F.col("r.at").alias("at"), F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"), (F.col("kinds") > HOT).alias("hot"))).alias("runs"))
    holders = written(open_.select("r.cls").distinct())
    fetched = beside(keyed, holders, keyed["cls"] == holders["cls"], "left_semi").join(listed.hint("merge"), "cls").select("text", "runs")
    met = written(fetched.mapInArrow(_contexts, "anchor long, ctx long, bytes binary, hot boolean").dropDuplicates(["anchor", "ctx"]))
    marks = met.filter("not hot").drop("hot").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compared, _MARKS)
    hashes = written(met.filter("hot").mapInArrow(_window_hashes, "anchor long, ctx long, h long, w int"))
    counted = hashes.groupBy("anchor", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    hot = hubs_apart(hashes, counted, ["anchor", "h"], total).select("anchor", "ctx", F.col("w").alias("f"), (F.col("w") + 1).alias("t"))
    each = marks.select("anchor", "ctx", F.inline(F.arrays_zip(F.col("froms").alias("f"), F.col("tos").alias("t")))).unionByName(hot)
    # A content found once is in one text; found more often it counts as a whole already.
    once = open_.filter("c = 1").select("anchor", "ctx", "r.*")
    part = spans_of(once.join(each, ["anchor", "ctx"]), F.col("f"), F.col("t"))
    spans = written(whole.unionByName(part))
    drop(twice, alike, open_, holders, met, hashes)
    return spans, spans.groupBy("cls").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def remove_repeats(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep's columns, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left; a cut may split a character) and spans."""
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep if c not in ADDED]).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spans, per = repeated_spans(docs)
    size, keyed = F.octet_length("text").cast("bigint"), docs.withColumn("cls", F.unhex(F.md5("text")))
    copied = written(keyed.filter(size >= LENGTH).groupBy("cls").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("cls"))
    hit = written(spans.select("cls").distinct().join(copied.hint("merge"), "cls", "left_anti"))
    join = lambda few, how: beside(keyed, few, keyed["cls"] == few["cls"], how)
    zero, kind = F.lit(0).cast("bigint"), "array<struct<a:int,b:int>>"
    of = lambda rows, removed, n, kept, held: rows.select("row", size.alias("n_bytes"), removed.alias("n_removed"), n.alias("n_spans"), F.sha2(kept, 256).alias("kept_sha256"), kept.alias("kept"), held.cast(kind).alias("spans"))
    gone = of(join(copied, "left_semi"), size, F.lit(1).cast("bigint"), F.lit(b""), F.array(F.struct(F.lit(0).alias("a"), size.cast("int").alias("b"))))
    rest = join(copied, "left_anti")
    free = of(beside(rest, hit, rest["cls"] == hit["cls"], "left_anti"), zero, zero, F.encode("text", "UTF-8"), F.array())
    own = beside(rest, hit, rest["cls"] == hit["cls"], "left_semi").join(per.hint("merge"), "cls")
    cut = own.select("row", "text", "spans").mapInArrow(_cut, f"row {docs.schema['row'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans {kind}")
    return free.unionByName(gone).unionByName(cut).select("row.*", *ADDED)


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), ["doc_id"]).drop("kept", "spans")


#: For a table whose ids are there and differ: windows by their MD5, spans where neighbouring ones begin at most LENGTH bytes apart.
SQL = f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, md5(b[i + 1:i + {LENGTH}]) AS m FROM (SELECT doc_id, b, unnest(range(0, octet_length(b) - {LENGTH - 1})) AS i FROM d WHERE octet_length(b) >= {LENGTH})),
found AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY m) AS c FROM w) WHERE c > 1),
runs AS (SELECT doc_id, i, sum(CASE WHEN i <= p + {LENGTH} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM found)),
spans AS (SELECT doc_id, k, min(i) AS a, max(i) + {LENGTH} AS z FROM runs GROUP BY doc_id, k),
pieces AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY k), 0) AS y FROM spans),
cut AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(z - a) AS BIGINT) AS n_removed, string_agg(hex(b[y + 1:a]), '' ORDER BY k) || hex(any_value(b)[max(z) + 1:octet_length(any_value(b))]) AS kept FROM pieces JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, hex(b)))) AS kept_sha256 FROM d LEFT JOIN cut USING (doc_id)
"""
