"""Every operator against a brute-force version, on odd inputs: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegraph.llm import _common as C
from tidegraph.llm import _vec as V
from tidegraph.llm import decontaminate as D
from tidegraph.llm import language, licenses, mixing, neardup, ppm, quality, registry, repeats, sharding, tokens
from tidegraph.llm._components import components

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = {i: i + 32 for i in range(65, 91)}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Null texts and ids, empty, blank, very long, repeated rows, and columns named as those the operators add."""
    prose = " ".join(f"word{i} É{i % 7} x" for i in range(40))
    rows = [
        (1, None, "en", "a", 7, "s"), (2, "", "en", "a", 7, "s"), (3, " \t\n", None, None, 7, "s"), (4, prose, "en", "b", 7, "s"), (4, prose, "en", "b", 7, "s"), (None, prose, "de", "b", 7, "s"),
        (None, None, None, None, 7, "s"), (5, "Wort " * 60_000, "de", "a", 7, "s"), (6, "one two", "en", "a", 7, "s"), (7, prose + " end", "en", "a", 7, "s"), (8, "日本語 テキスト 🎉\x00", "ja", "c", 7, "s"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int, row string")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def duck(sql, **views):
    con = duckdb.connect()
    for name, path in views.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con.sql(sql).df()


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, name):
    got = registry.QUERIES[name](spark, DATA).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = duck(registry.SQL[name], documents=f"{DATA}/documents.parquet", benchmark=f"{DATA}/benchmark.parquet", labels=f"{DATA}/labels.parquet").sort_values("doc_id").reset_index(drop=True)
    said = lambda df: df.astype(object).where(df.notna(), None).astype(str)
    assert said(got).equals(said(want[list(got.columns)]))


def test_decontamination_odd(spark, odd, none):
    bench = spark.createDataFrame([(3, "wort " * 40), (1, "word1 É1 X word2 É2 x word3 É3 x word4 É4 x word5"), (2, None), (3, ""), (10, "Two"), (None, "one TWO"), (10, "two")], "item_id long, text string")
    for limit in (10**6, 2):  # one block and several
        got = D.contamination(odd, bench, max_broadcast=limit).select("doc.doc_id", "n_words", "n_hit", "items").collect()
        assert len(got) == odd.count()
        by = {r.doc_id: r for r in got}
        assert by[6].n_hit == 2 and by[6]["items"] == ["10", "null"] and by[1].n_words == 0 and by[7].n_hit == 13 and by[5].n_hit == 60_000
    assert D.contamination(none, bench).count() == 0 and D.contamination(odd, bench.limit(0)).filter("n_hit > 0").count() == 0
    cut = {r.doc_id: r for r in D.remove_spans(odd, bench).collect()}
    assert cut[6].text == "" and cut[5].text == " " and cut[4].text.startswith("word0 É0 x É5 x word6")
    assert cut[6].size == 7 and D.remove_documents(odd, bench).columns == odd.columns
    assert D.remove_documents(odd, bench).filter("doc_id = 6").count() == 0


def brute_components(ids, texts, threshold=85):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(ASCII))
        sets.append(set(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(ids)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= threshold * len(a | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[root(i)] = min(least.get(root(i), x), x)
    return [(x, len(s), least.get(root(i))) for i, (x, s) in enumerate(zip(ids, sets, strict=True))]


def test_near_duplicates(spark, docs, odd, none):
    random.seed(5)
    base = " ".join(f"t{i}" for i in range(120)).split()
    near = []
    for i in range(60):  # one large group at all distances, compared in one block or in several
        w = list(base)
        for _ in range(random.randrange(1, 9)):
            w[random.randrange(120)] = f"u{random.randrange(10**6)}"
        near.append((1000 + i, " ".join(w)))
    frame = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(spark.createDataFrame(near, "doc_id long, text string")).cache()
    rows = frame.collect()
    held = neardup.BUCKET_BLOCK, neardup.CLUSTER_BLOCK, C.MAX_BROADCAST
    for threshold, neardup.BUCKET_BLOCK, neardup.CLUSTER_BLOCK, C.MAX_BROADCAST in ((85, *held), (80, 8, 1500, 3)):
        want = Counter(brute_components([r.doc_id for r in rows], [r.text for r in rows], threshold))
        got = neardup.near_duplicates(frame, threshold).collect()
        assert Counter((r.id, r.n_shingles, r.component_id) for r in got) == want
        assert all(r.kept == (r.id == r.component_id) for r in got)
        kept = neardup.deduplicate(odd, threshold)
        assert kept.columns == odd.columns and Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 4, None, 5, 6, 8])
    neardup.BUCKET_BLOCK, neardup.CLUSTER_BLOCK, C.MAX_BROADCAST = held
    assert neardup.near_duplicates(none).count() == 0 and neardup.deduplicate(none).count() == 0


def test_hashes_tell_thue_morse_words_apart(spark):
    """Words that collide under every polynomial modulo 2**64 aren't linked, as words, in shingles or beyond LONG bytes."""
    texts = []
    for size in (64, 512, 1024, 4096):
        word = "a"
        while len(word) < size:
            word += word.translate({97: 98, 98: 97})
        texts += [word, word.translate({97: 98, 98: 97}), f"one two {word} three four", f"one two {word.translate({97: 98, 98: 97})} three four"]
    out = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    assert all(r.kept for r in out)


def test_odd_sketch_estimates(spark):
    rng = np.random.default_rng(1)
    for share in (0.6, 0.85, 0.95):
        off = []
        for _ in range(60):
            own = rng.integers(0, 2**63, 400, dtype=np.uint64)
            other = own.copy()
            n = round(400 * (1 - share) / (1 + share))
            other[:n] = rng.integers(0, 2**63, n, dtype=np.uint64)
            m = neardup.odd_sketch(np.stack([neardup.minhash(own), neardup.minhash(other)]))
            bits = int(np.bitwise_count(m[0] ^ m[1]).sum())
            off.append(1 - math.log(1 - 2 * bits / neardup.BITS) / math.log(1 - 2 / neardup.BITS) / 2 / (neardup.BANDS * neardup.ROWS) - share)
        assert abs(np.mean(off)) < 0.02


def test_components(spark):
    random.seed(2)
    edges = [(random.randrange(200), random.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(500, i) for i in range(501, 540)]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    for hub in (1000, 3):  # without hubs, and with
        got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long"), hub=hub).collect()}
        assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_written_tables_go(spark):
    """Tables are deleted once no plan uses them, or when told; those of a block leave only its result."""
    import gc
    import os

    there = lambda df: os.path.exists(df._written_at.removeprefix("file:"))
    first, second = C.written(spark.range(3)), C.written(spark.range(4))
    path, use = first._written_at.removeprefix("file:"), second.selectExpr("id + 1 as x")
    C.drop(second)
    assert os.path.exists(path) and not os.path.exists(second._written_at.removeprefix("file:"))
    del first, use
    for _ in range(20):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        C.drop(C.written(spark.range(1)))  # which looks for such tables, too
        if not os.path.exists(path):
            break
    assert not os.path.exists(path)
    inner = []
    out = C.alone(lambda: inner.append(C.written(spark.range(5))) or inner[0].selectExpr("id * 2 as x"))
    assert there(out) and not there(inner[0]) and out.count() == 5


def test_tokens(spark, docs, odd, none, texts):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(tokens.default_tokenizer())
    length = lambda t: len(known.encode(t, add_special_tokens=False).ids)
    got = {r.doc_id: r for r in tokens.op3_tokens(spark, DATA).collect()}
    assert all(got[i].n_tokens == length(t) and got[i].n_bytes == len(t.encode()) and got[i].over_limit == (length(t) > 512) for i, t in texts.items())
    count = tokens.counter(tokens.default_tokenizer())
    random.seed(3)
    letters = "abcthe 'srevl \n\t\r\x0b\x1c\x85\xa0éß中文ก็🎉́0١²_-!<|>﻿​\x00"
    for i in range(400):
        t = "".join(random.choice(letters) for _ in range(random.randrange(30)))
        t = t[:9] + "<|endoftext|>" + t[9:] if i % 5 == 0 else t
        assert count.table(t).tolist() == [length(t[:k]) for k in range(len(t) + 1)]
        assert count.count(t) == length(t)
    long = texts[0]
    cut = count.truncate(long, 100)
    assert length(cut) <= 100 and all(length(long[:k]) > 100 for k in range(len(cut) + 1, len(cut) + 40))
    out = {r.doc_id: r for r in tokens.token_counts(odd).collect()}
    assert out[1].n_tokens == out[2].n_tokens == 0 and out[8].n_tokens == length("日本語 テキスト 🎉\x00") and out[6].size == 7 and len(tokens.token_counts(odd).collect()) == odd.count()
    assert tokens.token_counts(none).count() == 0
    row = tokens.token_prefixes(docs.limit(1)).select("text", tokens.within(F.col("prefixes"), 50).alias("k")).first()
    assert row.k == len(count.truncate(row.text, 50))


def test_sharding(spark, docs, odd, none):
    got = sharding.op4_sharding(spark, DATA).toPandas()
    n = len(got)
    assert n == docs.count() and got.groupby("shard").slot.apply(lambda s: sorted(s) == list(range(len(s)))).all()
    sizes = got.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and len(sizes) == 40
    of = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.size == len(of[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(of[r.doc_id].encode()) for r in got.itertuples())
    again = sharding.sharded(docs.repartition(7), 40).toPandas()
    assert Counter(map(tuple, again[["doc_id", "shard", "slot"]].values)) == Counter(map(tuple, got[["doc_id", "shard", "slot"]].values))
    for m in (1, 2, 3, 5, 17, 1000, 65537):
        p = sharding.permuted(np.arange(m), m)
        assert sorted(p) == list(range(m)) and (sharding.permuted(p, m, back=True) == np.arange(m)).all()
    row = sharding.sharded(docs, 40).first()
    assert sharding.place_of(row.number, n, 40) == (row.shard, row.slot) and sharding.number_at(row.shard, row.slot, n, 40) == row.number
    alike = sharding.sharded(spark.range(140_000).select(F.lit(1).alias("doc_id"), F.lit("x").alias("text")), 7)
    assert alike.agg(F.count(F.lit(1)), F.countDistinct("shard", "slot"), F.max("slot")).first()[:] == (140_000, 140_000, 19_999)
    few = sharding.sharded(odd, 3).toPandas()
    assert len(few) == odd.count() and sorted(few.groupby("shard").size()) == [3, 4, 4] and sharding.sharded(none).count() == 0


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        left = bytes(np.frombuffer(d, np.uint8)[~gone])
        out.append((len(d), len(d) - len(left), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return out


def test_repeats(spark, docs, odd, none, monkeypatch):
    random.seed(7)
    shared = "".join(random.choice("abcde ") for _ in range(1500))
    noise = lambda n: "".join(random.choice("vwxyz ") for _ in range(n))
    made = [(2000 + i, noise(random.randrange(500)) + shared[(a := random.randrange(900)) : a + random.randrange(390, 600)] + noise(random.randrange(500))) for i in range(40)]
    frame = docs.select("doc_id", "text").unionByName(odd.filter("doc_id is null or doc_id <> 5").select("doc_id", "text")).unionByName(spark.createDataFrame([*made, (3000, "ab" * 600), (3001, "x" * 399), (3002, "x" * 400), (3003, "y" * 401)], "doc_id long, text string")).cache()
    rows = frame.collect()
    want = Counter((r.doc_id, *x) for r, x in zip(rows, brute_repeats([r.text for r in rows], 400), strict=True))
    for hot in (repeats.HOT, 3):  # gathered, and counted by hash
        monkeypatch.setattr(repeats, "HOT", hot)
        got = repeats.remove_repeats(frame, ["doc_id"]).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert repeats.remove_repeats(none, ["doc_id"]).count() == 0
    clash = repeats.remove_repeats(odd.withColumnRenamed("size", "n_bytes").withColumn("spans", F.lit(1)), ["doc_id", "n_bytes", "spans"])
    assert clash.columns == ["doc_id", *repeats.ADDED] and clash.count() == odd.count()


def test_repeats_in_very_long_texts(spark, monkeypatch):
    """Texts looked at in pieces, with keys dealt as hubs, give the same."""
    random.seed(8)
    noise = lambda n: "".join(random.choice("stuvwxyz ") for _ in range(n))
    common = noise(700)
    texts = [noise(9000) + common + noise(20_000) + common[:450] + noise(3000), common[100:620] + noise(50), "Wort " * 4000, *(noise(random.randrange(80)) + common + noise(random.randrange(80)) for _ in range(30)), common, common, noise(500)]
    for name, value in (("CHUNK", 1000), ("PIECE", 1500)):
        monkeypatch.setattr(repeats, name, value)
    monkeypatch.setattr(repeats, "hubs_apart", lambda *a: C.hubs_apart(*a, hub=2))
    # Workers take the module's own values; the pieces are tested here on the driver.
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = Counter((i, *x) for i, x in enumerate(brute_repeats(texts, 400)))
    got = repeats.remove_repeats(frame, ["doc_id"]).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([t.encode()[:16] for t in texts]), pa.array(texts)], names=["cls", "text"])
    seen = Counter()
    for part in repeats._found(iter([batch])):
        for r in part.to_pylist():
            for w in range(r["at"] - r["lo"], r["at"] - r["hi"] + 1):
                seen[r["cls"], w] += 1
    assert seen == Counter((t.encode()[:16], w) for t in texts for w in range(len(t) - 399))


def test_hashes_of_repeats():
    """Equal strings have equal hashes wherever they stand, and Thue-Morse strings different ones."""
    word = "a"
    while len(word) < 1024:
        word += word.translate({97: 98, 98: 97})
    data = np.frombuffer((word + word.translate({97: 98, 98: 97}) + "xyz" + word).encode(), np.uint8)
    g = repeats.gram_hashes(data)
    own = {}
    for i in range(len(g)):
        own.setdefault(data[i : i + repeats.K].tobytes(), set()).add(int(g[i]))
    assert all(len(x) == 1 for x in own.values()) and len({x for v in own.values() for x in v}) == len(own)
    at, sizes = np.array([0, 1024, 2051, 0]), np.array([1024, 1024, 1024, 700])
    h = repeats.joined_hashes(g, at, sizes, np.zeros(4))
    assert h[0] == h[2] == repeats.joined_hashes(g, at[:1], sizes[:1], np.zeros(1))[0] and len(set(h.tolist())) == 3


def test_run_length_index():
    random.seed(1)
    for _ in range(200):
        parts = [bytes(random.choice(b"ab") for _ in range(random.randint(1, 40))) for _ in range(random.randint(1, 6))]
        n = random.randint(1, 8)
        c = Counter(p[i : i + n] for p in parts for i in range(len(p) - n + 1))
        assert [m.tolist() for m in repeats.RunLengthIndex(parts).repeated(n)] == [[c[p[i : i + n]] > 1 for i in range(max(0, len(p) - n + 1))] for p in parts]


def test_language(spark, docs, odd, none):
    got = language.op6_language(spark, DATA).toPandas().merge(docs.toPandas()[["doc_id", "lang"]], on="doc_id")
    held = got[got.held_out]
    assert (held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all() and (held.lang_pred == held.lang).mean() >= 0.9 and got.score.between(0, 1).all()
    of = language.profiles(docs)
    grams = Counter()
    for t in docs.filter("lang = 'de'").collect():
        grams.update(language.ngrams(t.text).tolist())
    assert of["de"].tolist() == [g for g, _ in sorted(grams.items(), key=lambda x: (-x[1], x[0]))[: language.TOP]]
    said = language.predict(odd, of, ["doc_id", "text"]).collect()
    assert {(r.lang_pred, r.score) for r in said if not any(c.isalpha() for c in r.text or "")} == {("und", 0.0)} and len(said) == odd.count()
    assert language.predict(odd, language.profiles(none), ["doc_id"]).select("lang_pred").distinct().collect()[0][0] == "und"
    assert language.predict(none, of, ["doc_id"]).count() == 0
    assert language.predict(odd.withColumn("score", F.lit("x")), of, ["doc_id", "score"]).columns == ["doc_id", "lang_pred", "score"]


def plain_language(text, of):
    """Distances by plain dictionaries, from the definition."""
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    joined = f"_{'_'.join(words)}_"
    grams = Counter(joined[i : i + n] for n in (1, 2, 3) for i in range(len(joined) + 1 - n)) if words else Counter()
    grams = {g: c for g, c in grams.items() if g != "_" and g != "__" and not (len(g) == 3 and g[1] == "_")}
    if not grams or not of:
        return "und", 0.0
    code = lambda g: sum((1 if c == "_" else ord(c)) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    own = sorted(grams, key=lambda g: (-grams[g], code(g)))[: language.TOP]
    off = {k: sum(abs(p[code(g)] - i) if code(g) in p else language.TOP for i, g in enumerate(own)) for k, p in of.items()}
    best = min(sorted(off), key=lambda k: off[k])
    return best, 1 - off[best] / (language.TOP * len(own))


def test_language_distances(spark, docs, odd, monkeypatch):
    """Predictions and scores against the definition, in one block of languages and in several."""
    of = language.profiles(docs)
    places = {k: {int(g): i for i, g in enumerate(v)} for k, v in of.items()}
    rows = docs.limit(60).select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    want = Counter((r.doc_id, *(lambda x: (x[0], round(x[1], 12)))(plain_language(r.text, places))) for r in rows.collect())
    for many in (200, 1, 3):
        monkeypatch.setattr(language, "LANGUAGES", many)
        for given in (of, language.learned(docs)):
            assert Counter((r.doc_id, r.lang_pred, round(r.score, 12)) for r in language.predict(rows, given, ["doc_id"]).collect()) == want


def test_mixing_repeated_ids(spark):
    """Rows of one id, null or not, and of one text have coins of their own; words come near the target."""
    rows = [(None, "w " * 100, "a")] * 1000 + [(7, "v " * 90, "b")] * 500 + [(i, "u " * (5 + i % 60), "c") for i in range(900)] + [(3, f"x{i} " * 20, "d") for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    for limit in (10**6, 0):
        per = mixing.mix(frame, max_broadcast=limit).groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("k"), F.count(F.lit(1)).alias("n")).collect()
        assert sum(r.n for r in per) == len(rows) and all(abs(r.k - r.t) <= 200 for r in per)
    emitted = mixing.emit(frame).groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("k")).collect()
    assert {r.source: r.k for r in emitted} == {r.source: r.k for r in per}


def test_mixing(spark, docs, odd, none):
    out = mixing.mix(docs).toPandas()
    per = out.groupby("source").agg(t=("target", "first"), s=("source_size", "first"))
    assert math.isclose(per.t.sum(), per.s.sum(), rel_tol=1e-9) and (per.t <= 3 * per.s + 1e-6).all() and (out.copies <= 3).all()
    assert Counter(r.doc_id for r in mixing.emit(docs).collect()) == Counter({r.doc_id: r.copies for r in out.itertuples() if r.copies})
    sizes = spark.createDataFrame([("a", 1), ("b", 50), ("c", 1000), (None, 2), ("d", 0)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    left, want, weights = 1053.0, {}, {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}
    size = {r.source: r.size for r in sizes.collect()}
    while True:  # stop, share again, until none is above
        open_ = [s for s in weights if s not in want]
        share = {s: weights[s] * left / sum(weights[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * size[s]]
        if not over:
            want |= share
            break
        want |= {s: 3.0 * size[s] for s in over}
        left = 1053.0 - sum(want.values())
    assert got == pytest.approx(want)
    few = mixing.mix(odd, keep=["doc_id", "row"], max_broadcast=0).collect()
    assert len(few) == odd.count() and {r["size"] for r in few if r.doc_id in (1, 2, 3)} == {0} and mixing.emit(odd).columns == odd.columns
    assert mixing.mix(none).count() == 0 and mixing.emit(none).count() == 0


def test_license_cosines(spark, docs):
    """The best header of each text against plain TF-IDF cosines of all lines and windows, without anchors."""
    words = lambda x: re.findall("[a-z0-9]+", x.lower())
    notices = [(k, words(x)) for k, t in sorted(licenses.TEMPLATES.items()) for x in t.split("\n")]
    df = Counter(w for _, ws in notices for w in set(ws))
    idf = lambda w: math.log((1 + len(notices)) / (1 + df[w])) + 1
    vector = lambda ws: {w: n * idf(w) for w, n in Counter(ws).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    cos = lambda a, b: sum(x * b.get(w, 0) for w, x in a.items()) / (norm(a) * norm(b)) if a and b else 0.0
    of = [(k, len(ws), vector(ws)) for k, ws in notices]
    texts = [r.text for r in docs.collect() if len(r.text) < 1500]
    texts = [t for t in texts if re.search("(?i)licen|rights|permission|creative", t)][:25] + texts[:10] + [f"line\n# {t.splitlines()[-1]}\nmore" for t in licenses.TEMPLATES.values()]
    got = {r.id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), F.lit("a")).collect()}
    hits = 0
    for i, text in enumerate(texts):
        lines = [words(x) for x in text.split("\n")]
        flat, line_of = [w for ws in lines for w in ws], [k for k, ws in enumerate(lines) for _ in ws]
        found = [(-round(c, 9), span, a, k) for span in range(1, 5) for a in range(len(lines) - span + 1) for k, _, v in of if (c := cos(vector([w for ws in lines[a : a + span] for w in ws]), v)) >= licenses.THRESHOLD]
        for k, n, v in of:
            m = min(n, len(flat))
            found += [(-round(c, 9), line_of[a + m - 1] - line_of[a] + 1, line_of[a], k) for a in range(len(flat) - m + 1) if m and (c := cos(vector(flat[a : a + m]), v)) >= licenses.THRESHOLD]
        if found:
            best = min(found)
            hits += 1
            assert (got[i].own_license, got[i].line) == (best[3].removesuffix("-text"), best[2]) and got[i].cosine == pytest.approx(-best[0], abs=1e-8)
        else:
            assert got[i].cosine in (0.0, 1.0)  # none, or a title
    assert hits > 15


def test_license_headers_anywhere(spark, docs):
    """Real headers, wrapped or not, inline notices and titles; and no window of words that anchors miss."""
    known = licenses.Templates(licenses.TEMPLATES)
    gnu = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version {} of the License, or\n(at your option) any later version."
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."
    cases = {
        gnu.format(3): "GPL-3.0", gnu.format(2): "GPL-2.0", gnu.format(3).replace("\n", " "): "GPL-3.0", "a\nAll rights reserved.\nb": "Proprietary", "Some rights reserved.": None, "License: MIT": "MIT",
        "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007": "GPL-3.0", "Apache License\nVersion 2.0, January 2004": "Apache-2.0", "Mozilla Public License Version 2.0": "MPL-2.0", mit: "MIT",
        "Copyright A. All rights reserved. " + mit: "MIT", "Some prose before it. Released under the MIT License, as it was for years, and more prose after it on one line": "MIT", "prose alone": None,
    }
    frame = spark.createDataFrame(list(enumerate(cases)), "id int, text string")
    assert {r.id: r.own_license for r in licenses.scan(frame, F.lit("a")).collect()} == dict(enumerate(cases.values()))
    every = licenses.Templates(licenses.TEMPLATES)
    every.near = {t: range(len(every.sizes)) for r in docs.collect() for t in licenses._TERM.findall(r.text.lower())}
    for text in [*cases, *[r.text for r in docs.limit(60).collect() if len(r.text) < 3000]]:
        terms = licenses._TERM.findall(text.lower())
        assert {(i, n, k, round(c, 9)) for c, i, n, k in known.windows(terms)} == {(i, n, k, round(c, 9)) for c, i, n, k in every.windows(terms)}
    lines = docs.filter("text rlike 'All rights reserved'").select("doc_id", "text")
    assert lines.count() > 0 and licenses.scan(lines, F.lit("a")).filter("own_license is null").count() == 0


def test_licenses(spark, docs, odd, none):
    known = licenses.Templates(licenses.TEMPLATES)
    everything = licenses.Templates(licenses.TEMPLATES)
    everything.anchors = {t for r in docs.collect() for t in licenses._TERM.findall(r.text.lower())}
    got = {r.doc_id: r for r in licenses.scan(docs, F.concat_ws("/", "source", "doc_id")).collect()}
    for r in docs.collect():
        name, cos, line, whole = everything.header(r.text)
        assert (got[r.doc_id].own_license, got[r.doc_id].cosine, got[r.doc_id].line) == (name, pytest.approx(cos), line)
    for name, text in licenses.TEMPLATES.items():
        assert known.header(f"some code\n// {text}\nmore code here")[0] == name.removesuffix("-text")
    files = [("a/LICENSE", "Released under the MIT License."), ("a/b/c/x.py", "code"), ("a/b/COPYING.txt", "Licensed under the Apache License, Version 2.0."), ("a/y.py", None), ("z.py", "nothing"), (None, "nothing"), ("a/b/own.py", "Licensed under CC BY-NC 4.0."), ("a/b/c/x.py", "code")]
    out = licenses.inherit(licenses.scan(spark.createDataFrame(files, "p string, text string"), F.col("p"))).collect()
    assert Counter((r.path, r.license, r.how) for r in out) == Counter([("a/LICENSE", "MIT", "own"), ("a/b/c/x.py", "Apache-2.0", "inherited"), ("a/b/c/x.py", "Apache-2.0", "inherited"), ("a/b/COPYING.txt", "Apache-2.0", "own"), ("a/y.py", "MIT", "inherited"), ("z.py", None, None), (None, None, None), ("a/b/own.py", "CC-BY-NC-4.0", "own")])
    assert licenses.inherit(licenses.scan(odd, F.col("row"))).count() == odd.count() and licenses.inherit(licenses.scan(none, F.col("row"))).count() == 0
    assert len(licenses.op8_licenses(spark, DATA).collect()) == docs.count()


def brute_features(text):
    text = text or ""
    w = WORD.findall(text)
    c = Counter(zip(w, w[1:], w[2:], strict=False))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(text.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len({i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}))


def test_quality(spark, docs, odd, none, texts):
    got = {r.doc_id: r for r in quality.op9_quality(spark, DATA).collect()}
    for i, t in texts.items():
        want = brute_features(t)
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == want
        assert got[i].base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (got[i].kept and got[i].base_failed)
    random.seed(4)
    for t in [" ".join(random.choice("abc") for _ in range(n)) for n in (1, 2, 3, 4, 5, 40, 700)]:
        row = quality.features(spark.createDataFrame([(t,)], "text string"), []if False else [F.lit(1).alias("i")]).first()
        assert row.n_repeat_words == brute_features(t)[4]
    labels = spark.createDataFrame([(4, 1), (4, None), (None, 0), (99, 1)], "doc_id long, quality int")
    assert quality.judge(odd, labels).count() == odd.count() and quality.judge(none, labels).count() == 0 and quality.judge(odd, labels.limit(0)).count() == odd.count()
    assert quality.keep_good(odd, labels).columns == odd.columns


def test_sql_where_rules_are_certified(spark, tmp_path):
    """With labels enough to certify cutoffs, for three languages and none, the query is what the SQL says, and rules reject what base rules don't."""
    random.seed(6)
    rows, labels = [], []
    for i in range(6000):
        lang, bad = random.choice(["en", "en", "de", None]), random.random() < 0.2
        words = [f"w{random.randrange(10**6)}" for _ in range(60)]
        kind = random.choice(["symbols", "shouting", "exclaiming"])
        if bad:
            words = [w.upper() for w in words] if kind == "shouting" else words + (["#" * 90] if kind == "symbols" else ["!" * 90])
        rows.append((i, " ".join(words), lang))
        if i % 5 or bad:
            labels.append((i, int(not bad)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = quality.op9_quality(spark, str(tmp_path)).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = duck(quality.SQL, documents=f"{tmp_path}/documents.parquet/*.parquet", labels=f"{tmp_path}/labels.parquet/*.parquet").sort_values("doc_id").reset_index(drop=True)
    assert got.astype(str).equals(want[list(got.columns)].astype(str))
    assert ((~got.base_failed) & (~got.kept)).sum() > 300


def test_risk_control(spark):
    tail = lambda k, n, p: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    cases = [(0, 10, 0.01), (3, 900, 0.01), (5, 900, 0.01), (12, 4000, 0.01), (40, 4000, 0.01)]
    for k, n, p in cases:
        got = spark.range(1).select(quality.binomial_tail(F.lit(k).cast("bigint"), F.lit(n).cast("bigint"), p).alias("x")).first().x
        assert got == pytest.approx(tail(k, n, p) if k < n * p else 1.0, rel=1e-9)
    rules = {"r": ("x", (0.9, 0.5, 0.1))}
    rows = [("s", True, 0.0)] * 2000 + [("s", True, 0.3)] * 30 + [("s", False, 0.7)] * 50 + [("t", True, 0.0)] * 20 + [("t", False, 0.7)] * 50
    held = spark.createDataFrame(rows, "stratum string, good boolean, x double")
    cuts = quality.cutoffs(held, 0.01, 0.05, rules).collect()
    assert [(r.stratum, r.rule, r.cutoff, r.n, r.rejected_good, r.rejected_bad) for r in cuts] == [("s", "r", 0.5, 2030, 0, 50)]  # 0.1 loses good ones; t has too few labels


def test_scoring(spark, docs, odd, none, texts):
    got = {r.doc_id: r for r in ppm.op10_ppm(spark, DATA).collect()}
    split = {i: zlib.crc32(str(i).encode()) % 7 for i in texts}
    words = lambda t: [*WORD.findall((t or "").translate(ASCII)), None]
    c = Counter(w for i, t in texts.items() if split[i] != 2 for w in words(t))
    n, v = sum(c.values()), len(c)
    for i, t in texts.items():
        w = words(t)
        assert got[i].held_out == (split[i] == 2) and (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), abs=1e-5)
    # The trie against a plain version, and that its probabilities sum to 1.
    few = ["abracadabra", "abrakadabra", "", "cad"]
    g = [ppm.grams(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), 2)[0] for t in few]
    trie = ppm.Trie(*ppm.runs(np.concatenate(g)), 2)
    for context in (b"ab", b"\xff\xffa"[:2], b"zz", b"ra", b"\xffa"):
        p = 10 ** trie.log10(np.array([(context[0] << 16) | (context[1] << 8) | s for s in range(256)]))
        assert p.sum() == pytest.approx(1)
    many = ppm.score(docs, counts := ppm.train(docs), ["doc_id"]).toPandas().sort_values("doc_id")
    joined = ppm.score(docs, counts, ["doc_id"], max_words=10).toPandas().sort_values("doc_id")
    assert np.allclose(many.base_score, joined.base_score) and (many.n_known.values == joined.n_known.values).all() and np.allclose(many.score, joined.score)
    low = ppm.score(docs, counts, ["doc_id"], max_nodes=10)
    assert low.agg(F.sum("score")).first()[0] < many.score.sum()
    out = ppm.score(odd, counts, ["doc_id", "size"]).collect()
    assert len(out) == odd.count() and all(r.n_tokens == 1 for r in out if r.doc_id in (1, 2, 3)) and all(np.isfinite(r.score) for r in out)
    assert ppm.score(none, counts, ["doc_id"]).count() == 0
    bare = ppm.score(odd, ppm.train(none), ["doc_id"]).filter("doc_id = 6").first()
    assert bare.train_tokens == 0 and bare.n_known == 0 and bare.score == pytest.approx(-8 * math.log10(256))
    assert ppm.adaptive("abababababababab") > -16 * math.log10(256) / 2 and ppm.adaptive(None) == pytest.approx(-math.log10(256))


def plain_ppm(text, counts, order):
    """log10 probability by prediction by partial matching, from the definition: context -> Counter of what follows."""
    data = (text or "").encode().translate(bytes(V.LOWER)) + b"\xff"
    data, out = b"\xff" * order + data, 0.0
    for i in range(order, len(data)):
        excluded = set()
        for k in range(order, -1, -1):
            seen = counts.get(data[i - k : i])
            if not seen:
                continue
            left = {s: c for s, c in seen.items() if s not in excluded}
            if data[i] in left:
                out += math.log10(left[data[i]] / (sum(left.values()) + len(left)))
                break
            if left:
                out += math.log10(len(left) / (sum(left.values()) + len(left)))
            excluded |= seen.keys()
        else:
            out -= math.log10(max(256 - len(excluded), 1))
    return out


def test_scores_by_definition(spark, docs, odd, monkeypatch):
    """The model's score of texts in and out of the training, against a plain version; long texts in pieces too."""
    train = docs.orderBy("doc_id").limit(40)
    counts = {}
    for r in train.collect():
        data = b"\xff" * ppm.ORDER + r.text.encode().translate(bytes(V.LOWER)) + b"\xff"
        for i in range(ppm.ORDER, len(data)):
            for k in range(ppm.ORDER + 1):
                counts.setdefault(data[i - k : i], Counter())[data[i]] += 1
    rows = docs.filter("length(text) < 3000").limit(60).select("doc_id", "text").unionByName(odd.filter("doc_id is null or doc_id <> 5").select("doc_id", "text"))
    want = sorted((r.doc_id or -1, plain_ppm(r.text, counts, ppm.ORDER)) for r in rows.collect())
    got = sorted((r.doc_id or -1, r.score) for r in ppm.score(rows, ppm.train(train), ["doc_id"]).collect())
    assert len(got) == len(want) and all(g[0] == w[0] and g[1] == pytest.approx(w[1], rel=1e-9) for g, w in zip(got, want, strict=True))
    assert ppm.score(odd, ppm.train(train), ["doc_id", "score"] if "score" in odd.columns else ["doc_id"]).count() == odd.count()
    monkeypatch.setattr(ppm, "CHUNK", 50)
    text = np.frombuffer(("Abra cadabra " * 60).encode(), np.uint8)
    whole = ppm.grams(text, np.array([0, len(text)]))[0]
    pieces = list(ppm.looked_at(text, np.array([0, len(text)])))
    assert len(pieces) > 5 and np.array_equal(np.concatenate([g for g, _ in pieces]), whole)


def test_large_tries_keep_their_order(spark, docs, odd, monkeypatch):
    """A trie too large to be held whole gives the same scores, of the same order, whatever the blocks."""
    counts = ppm.train(docs)
    rows = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    key = lambda df: sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.base_score, r.score) for r in df.collect())
    want = key(ppm.score(rows, counts, ["doc_id"], max_held=10**9))
    for block, part in ((20_000, 5_000), (ppm.BLOCK, ppm.PART)):
        monkeypatch.setattr(ppm, "BLOCK", block)
        monkeypatch.setattr(ppm, "PART", part)
        got = key(ppm.score(rows, counts, ["doc_id"], max_held=10))
        assert len(got) == len(want)
        for g, w in zip(got, want, strict=True):
            assert g[:3] == w[:3] and g[3:] == pytest.approx(w[3:])
    assert len(key(ppm.score(odd.limit(0), counts, ["doc_id"], max_held=10))) == 0


def test_vectorised_words(docs):
    import pyarrow as pa

    texts = [r.text for r in docs.limit(50).collect()] + ["", None, " a  b ", "É é"]
    seen = {}
    at = 0
    for a, b, data, offsets in V.chunks(pa.array(texts), 3000):
        h, row = V.word_hashes(data, offsets)
        for i in range(b - a):
            want = WORD.findall((texts[a + i] or "").translate(ASCII))
            own = h[row == i].tolist()
            assert len(own) == len(want) and all(seen.setdefault(w, x) == x for w, x in zip(want, own, strict=True))
        at = b
    assert at == len(texts) and len(set(seen.values())) == len(seen)
