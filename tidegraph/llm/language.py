"""Language identification by rank-order profiles (Cavnar and Trenkle, 1994).

Texts are lower-cased, runs of other characters than letters become one boundary, and 1- to 3-grams are counted. A language's
profile is its TOP most frequent n-grams in order, over all training texts; a text's language is that whose profile has the least
out-of-place distance to the text's own TOP, an absent n-gram being TOP places off. Training counts are summed within each task
and then by key, so a hot language costs its distinct n-grams only. Profiles come to the driver, TOP rows a language, for LANGUAGES languages
at a time, and go to the workers; with more languages, texts are compared block by block, each keeping the best so far.

Score: 1 - distance / (TOP x number of the text's n-grams compared).

Cases: a null text, or one without letters, is `und` with score 0; so is every text if nothing was learned; ties go to the first
language by code point; a null id counts as the empty text in the split; repeated rows are predicted each; carried columns named
lang_pred or score are replaced by those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import table, written

TOP, LANGUAGES = 400, 200
_EDGE = np.uint32(1)
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((not 0xD800 <= i < 0xE000 and chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def ngrams(text: str) -> np.ndarray:
    """Codes of the 1- to 3-grams; of an n-gram, n times 21 bits. Empty without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = letters()[codes]
    if not is_letter.any():
        return np.zeros(0, dtype=np.int64)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first character after a word stands for all up to the next
    c = np.concatenate([[_EDGE], np.where(is_letter, codes, _EDGE)[keep], [_EDGE]]).astype(np.int64)
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    return np.concatenate([c[c != 1], two[(c[:-1] != 1) | (c[1:] != 1)], three[c[1:-1] != 1]])


def counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    grams = np.sort(grams)
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, dtype=np.int64)
    return grams[first], np.diff(np.append(first, len(grams)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, list] = {}

    def flush() -> pa.RecordBatch:
        langs, grams, ns = [], [], []
        for lang, parts in sums.items():
            keys, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            langs += [lang] * len(keys)
            grams.append(keys)
            ns.append(np.bincount(where, weights=np.concatenate([p[1] for p in parts])).astype(np.int64))
        sums.clear()
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate([*grams, np.zeros(0, np.int64)])), pa.array(np.concatenate([*ns, np.zeros(0, np.int64)]))], names=["lang", "gram", "n"])

    held = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 400):
            part = batch.slice(at, 400)
            of: dict[str, list] = {}
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                of.setdefault(lang, []).append(ngrams(text))
            for lang, grams in of.items():
                sums.setdefault(lang, []).append(counted(np.concatenate(grams)))
                held += len(sums[lang][-1][0])
        if held > 3_000_000:
            yield flush()
            held = 0
    yield flush()


def learned(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", top: int = TOP) -> DataFrame:
    """lang, gram and place (from 1): each language's most frequent n-grams, from all rows that have a text and a language; written."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    sums = rows.mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return written(sums.withColumn("place", place).filter(F.col("place") <= top).select("lang", "gram", "place"))


def blocks(rows: DataFrame, languages: int | None = None) -> Iterator[dict[str, np.ndarray]]:
    """What `learned` gave, as language -> n-grams in order, for so many languages at a time, by code point."""
    after = F.lit(True)
    while True:
        names = [r.lang for r in rows.filter(after).select("lang").distinct().orderBy("lang").limit(languages or LANGUAGES).collect()]
        if not names:
            return
        found = rows.filter(after & (F.col("lang") <= names[-1])).toPandas()
        yield {lang: part.sort_values("place").gram.to_numpy() for lang, part in sorted(found.groupby("lang"))}
        after = F.col("lang") > names[-1]


def profiles(docs: DataFrame, **options) -> dict[str, np.ndarray]:
    """Language -> its most frequent n-grams, most frequent first: for a number of languages that the driver holds."""
    return {k: v for of in blocks(learned(docs, **options)) for k, v in of.items()}


class Profiles:
    def __init__(self, of: dict[str, np.ndarray], top: int = TOP):
        self.langs, self.top = list(of), top
        self.grams = np.unique(np.concatenate([*of.values(), np.zeros(0, np.int64)]))
        self.places = np.full((len(of), len(self.grams) + 1), -1, dtype=np.int32)
        for i, grams in enumerate(of.values()):
            self.places[i, np.searchsorted(self.grams, grams)] = np.arange(len(grams))

    def predict(self, text: str | None) -> tuple[str, float]:
        grams, n = counted(ngrams(text or ""))
        if not len(grams) or not self.langs:
            return "und", 0.0
        own = grams[np.argsort(-n, kind="stable")[: self.top]]  # ties by code
        at = np.searchsorted(self.grams, own)
        at[self.grams[np.minimum(at, len(self.grams) - 1)] != own] = len(self.grams)
        places = self.places[:, at]
        off = np.where(places < 0, self.top, np.abs(places - np.arange(len(own)))).sum(1)
        best = int(off.argmin())
        return self.langs[best], 1.0 - float(off[best]) / (self.top * len(own))


def predict(docs: DataFrame, of: dict[str, np.ndarray] | DataFrame, keep: list[str | Column], text_col: str = "text") -> DataFrame:
    """keep's columns, lang_pred and score; nothing but the text is looked at. of: profiles, or what `learned` gave."""
    if isinstance(of, dict):
        names = sorted(of)
        given: Iterator[dict] = ({k: of[k] for k in names[at : at + LANGUAGES]} for at in range(0, len(names), LANGUAGES))
    else:
        given = blocks(of)
    keep = [c for c in keep if not isinstance(c, str) or c not in ("lang_pred", "score")]
    rows = docs.select(F.struct(*keep).alias("row"), F.col(text_col).alias("text"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    part = next(given, None)
    while part is not None:
        held, part = docs.sparkSession.sparkContext.broadcast(Profiles(part)), next(given, None)
        rest = [] if part is None else ["text"]  # for the next block

        def run(batches: Iterator[pa.RecordBatch], held=held, rest=rest) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column("text")
                said = (held.value.predict(t) for at in range(0, len(texts), 200) for t in texts.slice(at, 200).to_pylist())
                before = zip(batch.column("lang_pred").to_pylist(), batch.column("score").to_pylist(), strict=True)
                best = [(new, s) if old == "und" or s > t else (old, t) for (new, s), (old, t) in zip(said, before, strict=True)]
                cols = [pa.array([x[0] for x in best], pa.string()), pa.array([x[1] for x in best], pa.float64())]
                yield pa.RecordBatch.from_arrays([batch.column("row"), *(batch.column(c) for c in rest), *cols], names=["row", *rest, "lang_pred", "score"])

        rows = rows.mapInArrow(run, rows.select("row", *rest, "lang_pred", "score").schema)
    return rows.select("row.*", "lang_pred", "score")


def split_number(key: Column, parts: int) -> Column:
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % parts


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = split_number(F.col("doc_id"), 3) == 1
    return predict(docs, learned(docs.filter(~held_out)), ["doc_id", held_out.alias("held_out")])


#: The query for a table whose ids are there and differ: n-grams as numbers, 21 bits a character, a boundary being 1. CRC-32 of ids bit by bit.
SQL = f"""
WITH d AS (SELECT doc_id, lang, text, CAST(doc_id AS VARCHAR) AS id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}]+', ' ', 'g')), ' ') AS ws FROM documents),
crc AS (SELECT doc_id, xor(list_reduce([4294967295::UBIGINT] || flatten(list_transform(string_split(trim(regexp_replace(hex(encode(id)), '(..)', '\\1 ', 'g')), ' '), lambda h: list_transform([0, 1, 2, 3, 4, 5, 6, 7], lambda k: (('0x' || h)::UBIGINT >> k) & 1))),
  lambda c, x: xor(c >> 1, CASE WHEN c & 1 <> x THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)), 4294967295::UBIGINT) AS c FROM d),
letters AS (SELECT doc_id, flatten([[1]] || list_transform(list_filter(ws, lambda w: w <> ''), lambda w: list_transform(string_split(w, ''), lambda x: ord(x)) || [1])) AS cs FROM d),
places AS (SELECT doc_id, cs, unnest(range(1, len(cs) + 1)) AS i FROM letters WHERE len(cs) > 1),
grams AS (SELECT doc_id, cs[i]::BIGINT AS g FROM places WHERE cs[i] <> 1 UNION ALL SELECT doc_id, (cs[i]::BIGINT << 21) | cs[i + 1] FROM places WHERE i < len(cs)
  UNION ALL SELECT doc_id, (cs[i]::BIGINT << 42) | (cs[i + 1]::BIGINT << 21) | cs[i + 2] FROM places WHERE i < len(cs) - 1 AND cs[i + 1] <> 1),
counts AS (SELECT doc_id, g, count(*) AS n FROM grams GROUP BY ALL),
profiles AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, g) - 1 AS place FROM counts JOIN d USING (doc_id) JOIN crc USING (doc_id) WHERE lang IS NOT NULL AND text IS NOT NULL AND c % 3 <> 1 GROUP BY lang, g QUALIFY place < {TOP}),
own AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, g) - 1 AS place, least(count(*) OVER (PARTITION BY doc_id), {TOP}) AS m FROM counts QUALIFY place < {TOP}),
off AS (SELECT doc_id, l.lang, any_value(m) AS m, sum(coalesce(abs(p.place - own.place), {TOP})) AS o FROM own CROSS JOIN (SELECT DISTINCT lang FROM profiles) l LEFT JOIN profiles p ON p.lang = l.lang AND p.g = own.g GROUP BY ALL),
best AS (SELECT doc_id, lang, 1.0::DOUBLE - CAST(o AS DOUBLE) / CAST({TOP} * m AS DOUBLE) AS score FROM off QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY o, lang) = 1)
SELECT d.doc_id, c % 3 = 1 AS held_out, coalesce(best.lang, 'und') AS lang_pred, coalesce(score, 0.0::DOUBLE) AS score FROM d JOIN crc USING (doc_id) LEFT JOIN best ON best.doc_id = d.doc_id
"""
