"""Token counts by prefix dynamic programming over a byte-level BPE.

An encoding is the one that BPE gives just if each pair of neighbouring tokens is what BPE makes of their joined bytes, so a
prefix's last token is the one vocabulary entry ending there that fits the last token of what stands before it. One pass over a
piece (the pattern splits text into pieces first) thus gives, at every prefix, its last token and its exact token count. A text's
table joins its pieces' tables; any truncation or budget question is then a lookup, without encoding anew. Where a cut changes the
split itself (inside white space or a contraction), the table holds what the cut text gives.

Pieces recur, so their tables are kept per worker, CACHE of them at most before starting afresh.

Cases: a null or empty text has 0 tokens; the special token's string inside a text is one token, as is the library's default; rows
are counted one by one, so repeated rows, ids and hot groups change nothing; other columns are left alone.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

LIMIT, CACHE = 512, 400_000
_HEAD = r"'s|'t|'re|'ve|'m|'ll|'d"
_ANY = regex.compile(_HEAD + r"| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
_ASCII = re.compile(_HEAD + r"| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
_BLANK = regex.compile(r"\p{White_Space}+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter(dict):
    """Piece -> its token count; see prefixes() and table() for every prefix's."""

    def __init__(self, path: str):
        super().__init__()
        spec = json.load(open(path, encoding="utf-8"))
        byte = _byte_of_char()
        to_bytes = lambda s: bytes(byte[c] for c in s)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.split = re.compile("|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True))) if self.specials else None
        self.ids = {to_bytes(t): i for t, i in spec["model"]["vocab"].items() if t not in self.specials}
        self.bytes_of = {i: b for b, i in self.ids.items()}
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.merges = {}
        for rank, (a, b) in enumerate(merges):
            a, b = to_bytes(a), to_bytes(b)
            self.merges[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        self.longest = max(map(len, self.ids))
        self.fits: dict[tuple[int, int], bool] = {}

    def bpe(self, data: bytes) -> list[int]:
        """Plain BPE: joins the leftmost pair of the lowest rank, again and again."""
        ids = [self.ids[data[i : i + 1]] for i in range(len(data))]
        while len(ids) > 1:
            found = min(((self.merges[p][0], i) for i, p in enumerate(itertools.pairwise(ids)) if p in self.merges), default=None)
            if found is None:
                break
            rank, new = self.merges[ids[found[1]], ids[found[1] + 1]]
            out, i = [], 0
            while i < len(ids):  # every pair of that rank, from the left
                if i + 1 < len(ids) and (m := self.merges.get((ids[i], ids[i + 1]))) and m[0] == rank:
                    out.append(new)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def fit(self, a: int, b: int) -> bool:
        """Whether BPE keeps b after a; a is -1 where b begins the piece."""
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > 4 * CACHE:
                self.fits.clear()
            known = self.fits[a, b] = self.bpe((self.bytes_of[a] if a >= 0 else b"") + self.bytes_of[b]) == ([a, b] if a >= 0 else [b])
        return known

    def prefixes(self, data: bytes) -> list[int]:
        """The token count of every prefix of a piece, the empty one first."""
        last, count, ids, fits = [-1], [0], self.ids, self.fits
        for end in range(1, len(data) + 1):
            for start in range(max(0, end - self.longest), end):
                token = ids.get(data[start:end])
                if token is not None:
                    known = fits.get((last[start], token))
                    if known or known is None and self.fit(last[start], token):
                        last.append(token)
                        count.append(count[start] + 1)
                        break
        return count

    def __missing__(self, piece: str) -> int:
        if len(self) > CACHE:
            self.clear()
        out = self[piece] = self.prefixes(piece.encode())[-1]
        return out

    def parts(self, text: str) -> tuple[list[str], int]:
        """The text between special tokens, and the number of those."""
        if self.split is None or not any(s in text for s in self.specials):
            return [text], 0
        found = self.split.split(text)
        return found, len(found) - 1

    def count(self, text: str) -> int:
        parts, total = self.parts(text)
        for part in parts:
            total += sum(map(self.__getitem__, (_ASCII if part.isascii() else _ANY).findall(part)))
        return total

    def table(self, text: str) -> np.ndarray:
        """The token count of text[:i], for every i from 0 to len(text)."""
        out = np.zeros(len(text) + 1, dtype=np.int64)
        at, base = 0, 0
        specials = [*(self.split.finditer(text) if self.split else ())]
        for start, end, special in [*((m.start(), m.end(), True) for m in specials), (len(text), len(text), False)]:
            base = self._fill(text, at, start, base, out)
            if special:  # a cut inside it is ordinary text, joined to what stands before it
                for i in range(start + 1, end):
                    out[i] = out[at] + self.count(text[at:i])
                base += 1
                out[end] = base
            at = end
        return out

    def _fill(self, text: str, at: int, end: int, base: int, out: np.ndarray) -> int:
        part = text[at:end]
        for m in (_ASCII if part.isascii() else _ANY).finditer(part):
            piece, start = m.group(), at + m.start()
            steps = self.prefixes(piece.encode())
            ends = np.cumsum([len(c.encode()) for c in piece])
            out[start + 1 : start + 1 + len(ends)] = base + np.array(steps)[ends]
            if len(piece) == 3 and piece in ("'re", "'ve", "'ll"):
                out[start + 2] = base + self["'"] + self[piece[1]]
            base += steps[-1]
        for m in _BLANK.finditer(part):  # cut inside white space, all of the run so far is one piece
            steps, ends = self.prefixes(m.group().encode()), np.cumsum([len(c.encode()) for c in m.group()])
            out[at + m.start() + 1 : at + m.end() + 1] = out[at + m.start()] + np.array(steps)[ends]
        return base

    def truncate(self, text: str, budget: int) -> str:
        """The longest prefix of at most `budget` tokens."""
        return text[: int(np.flatnonzero(self.table(text) <= budget)[-1])]


_held: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _held:
        _held[path] = PrefixCounter(path)
    return _held[path]


def _pieces(texts: pa.Array, rows: int = 200) -> Iterator[str]:
    for at in range(0, len(texts), rows):  # few texts at a time as Python strings
        yield from texts.slice(at, rows).to_pylist()


def token_counts(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """docs without its text, with n_bytes (UTF-8) and n_tokens."""
    path = tokenizer or default_tokenizer()
    rest = [c for c in docs.columns if c not in (text_col, "n_bytes", "n_tokens")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            texts = batch.column("text")
            yield pa.RecordBatch.from_arrays([batch.column("row"), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(map(count, _pieces(texts)), pa.int64())], names=["row", "n_bytes", "n_tokens"])

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, n_bytes long, n_tokens long").select("row.*", "n_bytes", "n_tokens")


def token_prefixes(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """docs with `prefixes`: element i is the token count of the text's first i characters, stored once for all later questions."""
    path = tokenizer or default_tokenizer()

    @F.pandas_udf("array<int>")
    def tables(texts):
        return texts.fillna("").map(lambda t: counter(path).table(t).astype(np.int32))

    return docs.withColumn("prefixes", tables(F.col(text_col)))


def within(prefixes: Column, budget: Column | int) -> Column:
    """How many characters the longest prefix of at most `budget` tokens has."""
    return F.array_max(F.transform(prefixes, lambda n, i: F.when(n <= budget, i)))


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumn("over_limit", F.col("n_tokens") > LIMIT)
