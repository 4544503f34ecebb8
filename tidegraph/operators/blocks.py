"""Graphs too large for a task: edges as arrays of vertices' places, in blocks by the vertex they go to. A step sends a vector of all vertices to the
workers, and each block gives the values of its own vertices back, so that nothing is shuffled once the blocks are made.

The driver and each worker hold some vectors of at most MAX_VERTICES values, or the workers alone, where vectors go in pieces (Pieces, PiecedNames); edges stay on the workers, EDGES or so in a block, but for a vertex
with more than that many different neighbours, which are in one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .iterate import checkpointed

MAX_VERTICES, EDGES = 32_000_000, 1_000_000


class Names:
    """Vertices (part, id), those of a part together and in order; a vertex's place is its row."""

    def __init__(self, part: np.ndarray, ids: np.ndarray):
        order = np.lexsort((ids, part))
        self.ids, part = ids[order], part[order]
        self.parts, starts, self.of = np.unique(part, return_index=True, return_inverse=True)
        self.ends = np.append(starts, len(part))

    def __len__(self) -> int:
        return len(self.ids)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "of"}

    def places(self, part: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of vertices, and which are there."""
        at, known = np.zeros(len(ids), dtype=np.int32), np.zeros(len(ids), dtype=bool)
        for i, p in enumerate(self.parts):
            own = slice(None) if len(self.parts) == 1 and (part == p).all() else np.flatnonzero(part == p)
            names = self.ids[self.ends[i] : self.ends[i + 1]]
            found = np.minimum(np.searchsorted(names, ids[own]), len(names) - 1)
            at[own], known[own] = found + self.ends[i], names[found] == ids[own]
        return at, known


def names_of(nodes: DataFrame, most: int = MAX_VERTICES) -> Names | None:
    """Of distinct (part, id), if there are `most` at most."""
    nodes = checkpointed(nodes.select(F.col("part").cast("bigint").alias("part"), F.col("id").cast("bigint").alias("id")))
    if nodes.count() > most:
        return None
    got = nodes.toArrow()
    return Names(got["part"].to_numpy(), got["id"].to_numpy())


#: Bytes that the driver holds at once of a vector that it passes on in pieces.
PIECE = 1 << 24


def relayed(rows: DataFrame) -> list[Broadcast]:
    """rows of a table, binary columns as bytes, sent to the workers in lists of PIECE bytes or so; the driver holds one list and one partition at a time."""
    sc, out, kept, size = rows.sparkSession.sparkContext, [], [], 0
    for row in rows.toLocalIterator():
        kept.append(tuple(bytes(x) if isinstance(x, bytearray) else x for x in row))
        size += sum(len(x) for x in kept[-1] if isinstance(x, bytes))
        if size >= PIECE:
            out.append(sc.broadcast(kept))
            kept, size = [], 0
    return [*out, sc.broadcast(kept)] if kept else out


class _Kept:
    """What a worker puts together of pieces: once for each task, and never sent."""

    @property
    def value(self):
        if "_value" not in self.__dict__:
            self._value = self._made()
        return self._value

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_value"}

    def destroy(self) -> None:
        for piece in self.pieces:
            piece.destroy()


class Pieces(_Kept):
    """A vector of which each block's row (block, v) gives the values of its vertices, and base, by part, those of the vertices of other blocks."""

    def __init__(self, rows: DataFrame | None, base: np.ndarray, ends: np.ndarray, count: int):
        self.pieces, self.base, self.ends, self.count = relayed(rows) if rows is not None else [], base, ends, count

    def _made(self) -> np.ndarray:
        out = np.repeat(self.base, np.diff(self.ends))
        for piece in self.pieces:
            for block, v in piece.value:
                out[block :: self.count] = np.frombuffer(v)
        return out


class PiecedNames(_Kept):
    """Names that only the workers hold: sorted there, and sent in pieces. The driver knows where each part ends."""

    def __init__(self, nodes: DataFrame):
        nodes = nodes.select(F.col("part").cast("bigint").alias("part"), F.col("id").cast("bigint").alias("id"))
        count = nodes.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").toArrow()
        self.parts, self.ends = count["part"].to_numpy(), np.append(0, np.cumsum(count["n"].to_numpy()))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept, size = [], 0
            for batch in batches:
                kept.append((_column(batch, "part"), _column(batch, "id")))
                size += batch.num_rows
                if size >= EDGES:
                    yield runs(kept)
                    kept, size = [], 0
            if size:
                yield runs(kept)

        def runs(kept: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            part, ids = (np.concatenate(c) for c in zip(*kept, strict=True))
            at = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            return pa.RecordBatch.from_pydict({"part": pa.array(part[at]), "low": pa.array(ids[at]), "ids": pa.array([x.tobytes() for x in np.split(ids, at[1:])], pa.binary())})

        self.pieces = relayed(checkpointed(nodes.orderBy("part", "id").mapInArrow(pack, "part long, low long, ids binary")))

    def __len__(self) -> int:
        return int(self.ends[-1])

    def _made(self) -> Names:
        out = Names.__new__(Names)
        rows = sorted((row for piece in self.pieces for row in piece.value), key=lambda row: row[:2])
        out.ids, out.parts, out.ends = np.concatenate([np.frombuffer(row[2], np.int64) for row in rows]), self.parts, self.ends
        return out


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _arrays(batches: Iterator[pa.RecordBatch], **types: type) -> Iterator[tuple]:
    """block, and the arrays of each row."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column(0)[i].as_py(), *[np.frombuffer(batch.column(batch.schema.get_field_index(c))[i].as_buffer(), dtype=t) for c, t in types.items()]


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({c: pa.array(v, pa.int32() if c == "block" else pa.binary()) for c, v in columns.items()})


class Blocks:
    """edges (part, src, dest and what value reads) between vertices of names, others left out; of parallel edges one is left, whose value merge makes of theirs."""

    def __init__(self, edges: DataFrame, names: Names | PiecedNames, value: Callable[[pa.RecordBatch], np.ndarray] | None = None, merge: np.ufunc = np.maximum, dtype: type = np.uint8, back: bool = False):
        self.spark, self.names, self.n, self.dtype = edges.sparkSession, names, len(names), np.dtype(dtype)
        self.held = names if isinstance(names, PiecedNames) else self.spark.sparkContext.broadcast(names)
        self.count = nb = max(1, -(-edges.count() // EDGES))
        held, n, ends = self.held, self.n, ("dest", "src") if back else ("src", "dest")

        def once(kept: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
            """Parallel edges that carry no value go before the shuffle, so that many copies of one edge don't meet in a block."""
            if value:
                return kept
            s, d, x = (np.concatenate(c) for c in zip(*kept, strict=True))
            first = np.unique(d.astype(np.int64) * n + s, return_index=True)[1]
            return [(s[first], d[first], x[first])]

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept, size = [], 0
            for batch in batches:
                part = _column(batch, "part")
                (s, a), (d, b) = (held.value.places(part, _column(batch, c)) for c in ends)
                ok = a & b
                kept.append((s[ok], d[ok], (value(batch) if value else np.ones(len(part))).astype(dtype)[ok]))
                size += len(kept[-1][0])
                if size >= EDGES:
                    yield from _dealt(once(kept), nb)
                    kept, size = [], 0
            if size:
                yield from _dealt(once(kept), nb)

        self._made(edges.mapInArrow(deal, _DEALT), merge)

    def _made(self, dealt: DataFrame, merge: np.ufunc) -> None:
        nb, n, dtype = self.count, self.n, self.dtype

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, s, d, x in _gathered(batches, dtype):
                key = d.astype(np.int64) // nb * n + s
                order = np.argsort(key, kind="stable")
                key = key[order]
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                at, start = np.unique(key[first] // n, return_index=True)
                yield _batch(block=[block], s=[s[order][first].tobytes()], at=[at.astype(np.int32).tobytes()], start=[start.tobytes()], x=[merge.reduceat(x[order], first).astype(dtype).tobytes()])

        rows = dealt.repartition(nb, "block").mapInArrow(pack, "block int, s binary, at binary, start binary, x binary")
        self.rows = checkpointed(rows)

    def each(self, make: Callable[..., Iterator[pa.RecordBatch]], schema: str, *vectors: np.ndarray) -> DataFrame:
        """make(own, s, first, x, *vectors) for each block: own places, the places that they are reached from, where each one's begin, and values."""
        held, nb, dtype = self.spark.sparkContext.broadcast(vectors), self.count, self.dtype

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, s, at, first, x in _arrays(batches, s=np.int32, at=np.int32, start=np.int64, x=dtype):
                yield from make(at * nb + block, s, first, x, *held.value)

        out = self.rows.mapInArrow(run, schema)
        out._held = held
        return out

    def step(self, make: Callable[..., tuple[np.ndarray, np.ndarray]], *vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, values) that make gives for each block, of all blocks."""

        def run(*args) -> Iterator[pa.RecordBatch]:
            at, value = make(*args)
            yield _batch(block=[0], at=[at.astype(np.int32).tobytes()], v=[np.ascontiguousarray(value).tobytes()])

        like = make(*[np.zeros(0, np.int32)] * 2, np.zeros(0, np.int64), np.zeros(0, self.dtype), *[v[:0] for v in vectors])[1]
        out = self.each(run, "block int, at binary, v binary", *vectors)
        got = out.toArrow()
        out._held.destroy()
        at = [np.frombuffer(x.as_buffer(), np.int32) for x in got["at"]]
        value = [np.frombuffer(x.as_buffer(), like.dtype) for x in got["v"]]
        return (np.concatenate(at), np.concatenate(value)) if at else (np.zeros(0, np.int32), np.zeros(0, like.dtype))

    def sums_of_sources(self) -> DataFrame:
        """(block, v): every vertex's values, summed over the edges that leave it."""
        nb, n, dtype = self.count, self.n, self.dtype

        def turn(own, s, first, x) -> Iterator[pa.RecordBatch]:
            yield from _dealt([(np.zeros(len(s), np.int32), s, x)], nb)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, _, d, x in _gathered(batches, dtype):
                yield _batch(block=[block], v=[np.bincount(d // nb, weights=x, minlength=len(range(block, n, nb))).tobytes()])

        return checkpointed(self.each(turn, _DEALT).repartition(nb, "block").mapInArrow(add, "block int, v binary"))

    def spread(self, start: np.ndarray, masked: bool = False) -> Iterator[np.ndarray]:
        """Bits (whole numbers, one a vertex) that move along the edges, masked by the edges' values if so told: what is new, step by step."""

        def run(own, s, first, x, seen, front):
            if not len(s):
                return own, np.zeros(0, seen.dtype)
            got = np.bitwise_or.reduceat(front[s] & x if masked else front[s], first) & ~seen[own]
            new = np.flatnonzero(got)
            return own[new], got[new]

        seen = front = start
        while True:
            at, bits = self.step(run, seen, front)
            if not len(at):
                return
            front = np.zeros_like(seen)
            front[at] = bits
            seen = seen | front
            yield front


_DEALT = "block int, s binary, d binary, x binary"


def _dealt(kept: list[tuple[np.ndarray, ...]], nb: int) -> Iterator[pa.RecordBatch]:
    s, d, x = (np.concatenate(c) for c in zip(*kept, strict=True))
    block = d % nb
    order = np.argsort(block, kind="stable")
    s, d, x, block = s[order], d[order], x[order], block[order]
    cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, np.int64)
    for a, b in zip(cuts, np.append(cuts[1:], len(block))):
        yield _batch(block=[int(block[a])], s=[s[a:b].tobytes()], d=[d[a:b].tobytes()], x=[x[a:b].tobytes()])


def _gathered(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> Iterator[tuple]:
    by: dict[int, list] = {}
    for block, *arrays in _arrays(batches, s=np.int32, d=np.int32, x=dtype):
        by.setdefault(block, []).append([a.copy() for a in arrays])
    for block in list(by):
        yield block, *[np.concatenate(c) for c in zip(*by.pop(block), strict=True)]


def table(spark: SparkSession, schema: str, **columns: np.ndarray) -> DataFrame:
    """Arrays of one length as a table that the workers make of ranges of them."""
    held, n, size = spark.sparkContext.broadcast(columns), len(next(iter(columns.values()))), 100_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({c: pa.array(v[i * size : (i + 1) * size]) for c, v in held.value.items()})

    parts = max(1, -(-n // size))
    return spark.range(0, parts, 1, min(parts, 256)).mapInArrow(run, schema)
