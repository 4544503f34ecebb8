"""The pipeline's stages, each against a plain version over its own input."""

import re
from collections import Counter

import corpus_pipeline as pipeline
from test_operators import brute_components, brute_features

from tidegraph.llm._common import written

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, held = docs.columns, {}
    for name, stage in pipeline.STAGES:
        before = docs.collect()
        docs = written(stage(spark, docs, DATA))
        held[name] = (before, docs.collect())
        assert name == "sharding" or docs.columns == columns
    before, after = held["quality"]
    ok = lambda f: f[0] >= 50 and 100 * f[4] <= 50 * f[0]
    assert {r.doc_id for r in after} <= {r.doc_id for r in before if ok(brute_features(r.text))}
    before, after = held["near_duplicates"]
    want = {x for x, _, c in brute_components([r.doc_id for r in before], [r.text for r in before], 80) if x == c}
    assert {r.doc_id for r in after} == want
    before, after = held["decontamination"]
    words = lambda t: [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({i: i + 32 for i in range(65, 91)})) if w]
    items = [words(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    grams = {tuple(w[i : i + 13]) for w in items if w for i in range(max(1, len(w) - 12))}

    def clean(text):
        w = words(text)
        hit = {i + k for g in {len(g) for g in grams} for i in range(len(w) - g + 1) if tuple(w[i : i + g]) in grams for k in range(g)}
        return not hit or 20 * len(hit) < len(w)

    assert {r.doc_id for r in after} == {r.doc_id for r in before if clean(r.text)}
    before, after = held["mixing"]
    assert {r.doc_id for r in after} <= {r.doc_id for r in before} and max(Counter(r.doc_id for r in after).values()) <= 3
    total = lambda rows: sum(len(r.text.split()) for r in rows)
    assert abs(total(after) - total(before)) < 0.3 * total(before)
    before, after = held["sharding"]
    assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before)
    sizes = Counter(r.shard for r in after)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(pipeline.SHARDS)) <= 1
    again = pipeline.run(spark, DATA).collect()
    assert Counter(again) == Counter(after)


def test_links_at_80(spark):
    """Texts of similarity 0.80 to 0.85 are linked by default, as in the stage, and not at 85."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows, kept = docs.collect(), {}
    for threshold, out in ((80, pipeline.neardup.deduplicate(docs)), (85, pipeline.neardup.deduplicate(docs, 85))):
        kept[threshold] = {r.doc_id for r in out.collect()}
        assert kept[threshold] == {x for x, _, c in brute_components([r.doc_id for r in rows], [r.text for r in rows], threshold) if x == c}
    assert kept[80] < kept[85]


def _tables(spark, path, docs, labels, bench):
    for name, frame in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        frame.write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_odd_tables(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows and ids, and columns named as those that stages add: every stage gives the columns of documents."""
    prose = lambda seed, n=70: " ".join(f"w{seed}x{i * i}" for i in range(n))
    near = prose(3).replace("w3x0 ", "other ")
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, prose(1)), (4, prose(1)), (4, prose(2)), (None, prose(3)), (None, prose(3)), (5, near), (6, "Wort " * 60_000), (None, None), (7, prose(4, 9000)), (8, prose(5) + " " + prose(6)), (9, prose(5, 60))]
    extra = "size int, row string, th long, rep string, key string, copies int, shard int, slot int, n int, kept boolean, id string, `a.b` int"
    docs = spark.createDataFrame([(*r, "en", "s", 7, "r", 1, "p", "k", 2, 3, 4, 5, True, "i", 6) for r in rows] + [(10, prose(7), *[None] * 14)], f"doc_id long, text string, lang string, source string, {extra}")
    labels = spark.createDataFrame([(4, 1), (None, 0), (5, None)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, prose(5, 60)), (2, None), (None, "")], "item_id long, text string")
    sf_dir, held = _tables(spark, tmp_path / "odd", docs, labels, bench), []
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in pipeline.STAGES:
        frame = written(stage(spark, frame, sf_dir))
        assert name == "sharding" or frame.columns == docs.columns
        held.append(Counter((r.doc_id, r.text) for r in frame.collect()) if name != "sharding" else Counter(r.doc_id for r in frame.collect()))
    quality, near_dup, clean, mixed, sharded = held
    good = [(4, prose(1)), (4, prose(1)), (4, prose(2)), (None, prose(3)), (None, prose(3)), (5, near), (7, prose(4, 9000)), (8, prose(5) + " " + prose(6)), (9, prose(5, 60)), (10, prose(7))]
    assert quality == Counter(good)
    assert near_dup == Counter([(4, prose(1)), (4, prose(2)), (5, near), (7, prose(4, 9000)), (8, prose(5) + " " + prose(6)), (9, prose(5, 60)), (10, prose(7))])
    assert clean == near_dup - Counter([(8, prose(5) + " " + prose(6)), (9, prose(5, 60))])
    assert set(mixed) <= set(clean) and max(mixed.values()) <= 3
    assert sharded == Counter(x for (x, _), n in mixed.items() for _ in range(n))
    assert Counter(r.doc_id for r in pipeline.run(spark, sf_dir).collect()) == sharded


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    sf_dir = _tables(spark, tmp_path / "none", docs, spark.createDataFrame([], "doc_id long, quality int"), spark.createDataFrame([], "item_id long, text string"))
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0 and (name == "sharding" or out.columns == docs.columns)
    assert pipeline.run(spark, sf_dir).count() == 0


def test_run_leaves_one_table(spark):
    """What stages write on the way is gone by the time run() returns, but for the last one's input and what it reads."""
    from tidegraph.llm import _common as C

    before = set(C._tables)
    out = pipeline.run(spark, DATA)
    left = set(C._tables) - before
    assert len(left) <= 3 and out.count() > 0


def test_sql(spark):
    from test_operators import duck

    got = Counter(tuple(r) for r in pipeline.run(spark, DATA).collect())
    want = duck(pipeline.ORACLE_SQL, documents=f"{DATA}/documents.parquet", benchmark=f"{DATA}/benchmark.parquet", labels=f"{DATA}/labels.parquet")
    assert got == Counter(want[["doc_id", "size", "text_crc32", "shard", "slot"]].itertuples(index=False, name=None))
