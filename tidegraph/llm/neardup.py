"""MinHash near-duplicates with odd sketches.

A text's set is its distinct 5-word shingles (A-Z lower-cased; a shorter text is one shingle; no words: the empty set, linked with
nothing). Texts are linked if 100 * intersection >= threshold * union. The steps:

1. Each text gets BANDS x ROWS MinHash values, a key per band, and an odd sketch: every (place, value) sample flips one bit of a
   512-bit map, so the population count of two maps' XOR estimates their similarity, sharply where it is high.
2. Equal sets are one class from here on, however many copies there are; a class is known by a 128-bit hash of its set.
3. Classes that share a band key are candidates. Each bucket is compared by sketches within a task, which emits only a spanning
   forest of pairs estimated at no more than SLACK below the threshold: never all pairs. Buckets of many members are dealt out as
   pairs of blocks. The forests' components are clusters.
4. Each cluster's texts (one per class) meet in a task, or as pairs of blocks in several, where full sets are compared exactly, and
   again a spanning forest of the links is emitted. Its components are the result.

A link of the least similarity is missed by 25 bands of 5 rows with probability 5e-5 at 80 in 100, 4e-7 at 85, and by the sketch
filter with less than 1e-6; nothing else is lost. 64-bit hashes, mixed after every 8 bytes of a word and every word, stand for shingles.

Texts travel only to step 4, and only those of clusters: the list of them is broadcast if `beside` finds it short.

Cases: null ids are carried along, and only represent a component if it has no other id; repeated rows are members like any other;
an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _vec as V
from ._common import beside, drop, table, written
from ._components import components

THRESHOLD, BANDS, ROWS, BITS, SLACK, N = 80, 25, 5, 512, 0.2, 5
BUCKET_BLOCK, CLUSTER_BLOCK = 16_384, 1_500_000
_rng = np.random.default_rng(20240608)
_XOR = _rng.integers(1, 2**64 - 1, BANDS * ROWS, dtype=np.uint64)
_MUL = _rng.integers(1, 2**64 - 1, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: pa.Array, n: int = N) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    for at, end, data, offsets in V.chunks(texts):
        words, row = V.word_hashes(data, offsets)
        made, bounds = V.shingles(words, row, end - at, n)
        for i in range(end - at):
            yield np.unique(made[bounds[i] : bounds[i + 1]])


def minhash(own: np.ndarray) -> np.ndarray:
    out = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(own), 2048):
        block = own[at : at + 2048, None] ^ _XOR
        block *= _MUL
        np.minimum(out, block.min(0), out=out)
    return out


def odd_sketch(mins: np.ndarray) -> np.ndarray:
    """The samples' parity bitmap, as BITS / 64 words; mins: rows of MinHash values."""
    bit = (V.mixed(mins ^ (_MUL >> np.uint64(1))) >> np.uint64(40)).astype(np.int64) % BITS
    odd = np.zeros((len(mins), BITS), dtype=np.uint8)
    np.add.at(odd, (np.arange(len(mins))[:, None], bit), 1)
    return np.packbits(odd & 1, axis=1).view(np.uint64)


def _most_differing(sure: float) -> int:
    """Bits in which sketches of similarity `sure` differ, on average."""
    return int(BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * BANDS * ROWS * (1 - sure))))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, sigs, mins, full = [], [], [], []
        for own in shingle_sets(batch.column("text")):
            size.append(len(own))
            one, two = (int(x) for x in (V.mixed(own).sum(), V.mixed(own ^ np.uint64(V.BASE)).sum()))
            sigs.append(one.to_bytes(8, "big") + two.to_bytes(8, "big") if len(own) else None)
            full.append(len(own) > 0)
            if len(own):
                mins.append(minhash(own))
        mins = np.array(mins, dtype=np.uint64).reshape(-1, BANDS * ROWS)
        keys = V.mixed((mins.reshape(-1, BANDS, ROWS) * _MUL[: BANDS * ROWS].reshape(BANDS, ROWS)).sum(2)).view(np.int64)
        sketch, at = odd_sketch(mins), np.cumsum([0, *full])
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("th"), pa.array(size, pa.int64()), pa.array(sigs, pa.binary()), pa.ListArray.from_arrays(pa.array(at * BANDS, pa.int32()), pa.array(keys.ravel())), pa.array([sketch[at[i]].tobytes() if f else None for i, f in enumerate(full)], pa.binary())],
            names=["id", "th", "n_shingles", "sig", "keys", "sketch"],
        )


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal keys in sorted batches."""
    held: list[pa.Table] = []
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        k = t.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and held[0].column(key)[0].as_py() != k[a]:
                yield pa.concat_tables(held)
                held = []
            held.append(t.slice(a, b - a))
    if held:
        yield pa.concat_tables(held)


def _edges(us: list, vs: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], names=["u", "v"])


def _by_sketch(threshold: int):
    """Of each bucket, or pair of blocks of one, a spanning forest of its pairs that sketches find similar."""
    return lambda batches: _sketched(batches, _most_differing(threshold / 100 - SLACK))


def _sketched(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    us, vs, done = [], [], set()
    for t in _groups(batches, "g"):
        sigs = t.column("sig").to_pylist()
        if len(sigs) < 2 or (mark := tuple(sigs) if len(sigs) < 9 else None) in done:
            continue
        if mark and len(done) < 200_000:  # other bands gave the same members
            done.add(mark)
        maps = np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype=np.uint64).reshape(len(sigs), -1)
        own = np.arange(len(sigs))  # which members are joined already; those of one's own tree aren't looked at again
        for i in range(len(sigs) - 1):
            rest = np.flatnonzero(own[i + 1 :] != own[i]) + i + 1
            for j in rest[np.bitwise_count(maps[rest] ^ maps[i]).sum(1, dtype=np.int64) <= most].tolist():
                if own[j] != own[i]:
                    own[own == own[j]] = own[i]
                    us.append(sigs[i])
                    vs.append(sigs[j])
        if len(us) > 20_000:
            yield _edges(us, vs)
            us, vs = [], []
    yield _edges(us, vs)


def _by_set(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs = [], []
        for t in _groups(batches, "g"):
            sigs = t.column("sig").to_pylist()
            if len(sigs) < 2:
                continue
            sets = list(shingle_sets(t.column("text").combine_chunks()))
            sizes = np.array([len(s) for s in sets])
            order = np.argsort(sizes, kind="stable")
            flat, codes = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
            sizes, at, own = sizes[order], np.concatenate([[0], np.cumsum(sizes[order])]), np.arange(len(sigs))
            seen = np.zeros(len(flat), dtype=np.uint8)
            for i in range(len(sigs) - 1):
                last = int(np.searchsorted(sizes * threshold, 100 * sizes[i], "right"))  # larger sets can't be that similar
                if (own[i + 1 : last] == own[i]).all():  # none, or all joined already
                    continue
                seen[codes[at[i] : at[i + 1]]] = 1
                both = np.add.reduceat(seen[codes[at[i + 1] : at[last]]], at[i + 1 : last] - at[i + 1], dtype=np.int64)
                seen[codes[at[i] : at[i + 1]]] = 0
                for j in (np.flatnonzero(100 * both >= threshold * (sizes[i] + sizes[i + 1 : last] - both)) + i + 1).tolist():
                    if own[j] != own[i]:
                        own[own == own[j]] = own[i]
                        us.append(sigs[order[i]])
                        vs.append(sigs[order[j]])
            if len(us) > 20_000:
                yield _edges(us, vs)
                us, vs = [], []
        yield _edges(us, vs)

    return run


def _in_blocks(rows: DataFrame, blocks: str, *keys: str) -> DataFrame:
    """rows, dealt out by key, or if a key has several blocks, once for each pair of them that has the row's block; sorted by group g."""
    own = F.pmod(F.xxhash64("sig", F.lit(7)), F.col(blocks)).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1), lambda k: F.struct(F.least(F.col("_own"), k).alias("p"), F.greatest(F.col("_own"), k).alias("q")))
    out = rows.withColumn("_own", own).withColumn("_pair", F.explode(pairs)).withColumn("g", F.xxhash64(*keys, "_pair"))
    return out.drop("_own", "_pair", blocks, *keys).repartition("g").sortWithinPartitions("g", "sig")


def _judged(docs: DataFrame, threshold: int) -> DataFrame:
    """Of rows (id, th, text): id, th, n_shingles, and of those with words rep, the (none, id, th) that represents their component. Written."""
    kind = docs.schema["id"].dataType.simpleString()
    made = written(docs.mapInArrow(_featured, f"id {kind}, th long, n_shingles long, sig binary, keys array<long>, sketch binary"))
    full = made.filter(F.col("sig").isNotNull())
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("rep")
    classes = written(full.groupBy("sig").agg(least, F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")))
    thin = written(made.select("id", "th", "n_shingles", "sig"))
    drop(made)
    keyed = classes.select("sig", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key", F.ceil(F.col("c") / BUCKET_BLOCK).alias("blocks"))
    members = keyed.join(shared.hint("merge"), "key").join(classes.select("sig", "sketch").hint("merge"), "sig")
    likely = _in_blocks(members.select("sig", "sketch", "key", "blocks"), "blocks", "key").mapInArrow(_by_sketch(threshold), "u binary, v binary")
    clusters = written(components(likely).withColumnsRenamed({"node": "sig", "root": "cluster"}).join(classes.select("sig", "rep", "n").hint("merge"), "sig"))
    blocks = clusters.groupBy("cluster").agg(F.ceil(F.sum("n") / CLUSTER_BLOCK).alias("blocks"))
    wanted = written(clusters.join(blocks, "cluster").select("sig", "cluster", "blocks", F.col("rep.id").alias("rid"), F.col("rep.th").alias("rth")))
    texts = beside(docs, wanted, docs["id"].eqNullSafe(F.col("rid")) & (docs["th"] == F.col("rth")), "inner").select("sig", "text", "cluster", "blocks")
    links = _in_blocks(texts, "blocks", "cluster").mapInArrow(_by_set(threshold), "u binary, v binary")
    roots = components(links)
    named = classes.select("sig", "rep").join(roots.hint("merge"), F.col("sig") == F.col("node"), "left").select("sig", F.coalesce("root", "sig").alias("root"), "rep")
    own = named.groupBy("root").agg(F.min("rep").alias("rep"))
    of = named.select("sig", "root").join(own.hint("merge"), "root").select("sig", "rep")
    out = written(thin.join(of.hint("merge"), "sig", "left").select("id", "th", "n_shingles", "rep"))
    drop(classes, thin, clusters, wanted)
    return out


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (the smallest id linked, over any number of links) and kept, one row per row of docs."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    component = F.when(F.col("rep").isNull(), F.col("id")).otherwise(F.col("rep.id"))
    return _judged(rows, threshold).select("id", "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def deduplicate(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component, that of the smallest id (null ids last; of equal ids, any one of those whose text has the least hash), columns as they were."""
    id_, text = docs[f"`{id_col}`"], docs[f"`{text_col}`"]  # of these docs, whatever other columns are called
    th = F.xxhash64(text)
    judged = _judged(docs.select(id_.alias("id"), th.alias("th"), text.alias("text")), threshold)
    stays = F.col("rep").isNull() | (F.col("id").eqNullSafe(F.col("rep.id")) & (F.col("th") == F.col("rep.th")))
    gone = written(judged.filter(~stays).select("id", "th").distinct())
    on = lambda few: id_.eqNullSafe(few["id"]) & (th == few["th"])
    left = beside(docs, gone, on(gone), "left_anti")
    # Rows of one id and text: one of them stays.
    twice = written(judged.filter(stays & F.col("rep").isNotNull()).groupBy("id", "th").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("id", "th"))
    if twice.isEmpty():
        return left
    some = beside(left, twice, on(twice), "left_semi").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), id_.alias("id"), th.alias("th"))
    one = some.groupBy("id", "th").agg(F.first("row").alias("row")).select("row.*")
    return beside(left, twice, on(twice), "left_anti").unionByName(one)


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 85).withColumnRenamed("id", "doc_id")


def sql(documents: str = "documents", threshold: int = 85) -> str:
    """The same for a table whose ids are there and differ: pairs that share shingles, and components by search."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM {documents}),
shingles AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= {threshold} * (p.n + q.n - c)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached(doc_id, other) AS (SELECT x, x FROM ways UNION SELECT r.doc_id, w.y FROM reached r JOIN ways w ON r.other = w.x),
least AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""


SQL = sql()
