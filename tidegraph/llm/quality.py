"""Quality rules with risk-controlled thresholds.

Every document gets counts from its whole text (see `features`). Base rules have fixed limits. Each further rule rejects documents
whose rate is above a cutoff that labelled holdouts have to certify, per stratum: with n good labelled documents in the stratum, k
of which the cutoff rejects, the exact (Clopper-Pearson) upper bound on the share of good documents rejected must be at most
alpha / number of rules, which is so just if P(Binomial(n, alpha / rules) <= k) <= delta / (strata x rules x cutoffs), the
Bonferroni correction over all tests made. So with confidence 1 - delta no stratum loses over alpha of its good documents to
these rules. Of the certified cutoffs the one that rejects most bad documents, a rejected good one counting as ten kept bad ones,
is taken; the most lenient on ties. A rule without a certified cutoff of use rejects nothing in that stratum.

Cases: a null or empty text has no words, and fails the base rule; a null stratum is a stratum of its own; rows that repeat an id share
its label; documents without a label, labels without a document, and null labels take no part in calibration; contradicting
labels of one id count as bad; without labels only the base rules act; other columns travel in one struct, whatever their names.
Rows of an equal id are judged each by its own text.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import BLANKS, let, table, words_of, written

ALPHA, DELTA, MAX_BROADCAST = 0.05, 0.05, 100_000
#: rule: (its rate in SQL, cutoffs from lenient to strict)
RULES = {
    "symbols": ("n_symbols / n_words", (1.0, 0.75, 0.5, 0.35, 0.25, 0.15, 0.1, 0.05)),
    "repeats": ("n_repeat_words / n_words", (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "lines": ("n_dup_lines / n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2)),
    "shouting": ("n_upper / word_chars", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2)),
    "exclaiming": ("n_bangs / n_words", (2.0, 1.5, 1.0, 0.75, 0.5, 0.35, 0.2, 0.1)),
}


def _repeated_words(tri: Column) -> Column:
    """How many words lie in windows (tri: their hashes, in order) that are found twice or more."""

    def flagged(s: Column) -> Column:  # s: (hash, place), sorted
        same = F.zip_with(F.slice(s, 2, F.size(s) - 1), F.slice(s, 1, F.size(s) - 1), lambda a, b: a["h"] == b["h"])
        return let(same, lambda eq: F.zip_with(s, F.zip_with(F.concat(F.array(F.lit(False)), eq), F.concat(eq, F.array(F.lit(False))), lambda a, b: a | b), lambda x, f: F.when(f, x["i"])))

    def covered(at: Column) -> Column:  # at: places, rising
        return F.aggregate(F.zip_with(F.slice(at, 2, F.size(at) - 1), F.slice(at, 1, F.size(at) - 1), lambda b, a: F.least(b - a, F.lit(3))), F.lit(3), lambda acc, x: acc + x)

    def found(places: Column) -> Column:
        return let(F.sort_array(F.array_compact(places)), lambda at: F.when(F.size(at) > 0, covered(at)).otherwise(0))

    def by_sort(tri: Column) -> Column:
        return let(F.sort_array(F.transform(tri, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), lambda s: let(flagged(s), found))

    def by_list(twice: Column) -> Column:  # a few hashes: looked for one by one, which is quicker than sorting places
        return F.when(F.size(twice) <= 24, found(F.transform(tri, lambda h, i: F.when(F.array_contains(twice, h), i)))).otherwise(by_sort(tri))

    def twice(s: Column) -> Column:  # s: the hashes, sorted
        return F.array_distinct(F.array_compact(F.zip_with(F.slice(s, 2, F.size(s) - 1), F.slice(s, 1, F.size(s) - 1), lambda a, b: F.when(a == b, a))))

    return F.when(F.size(F.array_distinct(tri)) == F.size(tri), F.lit(0)).otherwise(let(F.sort_array(tri), lambda s: let(twice(s), by_list)))


def features(docs: DataFrame, carry: Sequence[Column | str], text_col: str = "text") -> DataFrame:
    """carry, and of each whole text (longs): n_words; word_chars, the characters in words; n_symbols, of #*$%&|<>; n_lines, lines
    with a word; n_dup_lines, those equal to an earlier one; n_repeat_words, words in 3-word windows found twice or more;
    n_upper, A to Z; n_bangs. Windows are compared by a 64-bit hash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.struct(*carry).alias("c"), text.alias("t")).select("c", "t", words_of(F.col("t"), BLANKS).alias("ws"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("ls"))
    counts = {
        "n_words": F.size("ws"),
        "word_chars": F.char_length(F.array_join("ws", "")),
        "n_symbols": F.regexp_count("t", F.lit(r"[#*$%&|<>]")),
        "n_lines": F.size("ls"),
        "n_dup_lines": F.size("ls") - F.size(F.array_distinct("ls")),
        "n_upper": F.regexp_count("t", F.lit("[A-Z]")),
        "n_bangs": F.char_length("t") - F.char_length(F.replace("t", F.lit("!"), F.lit(""))),
    }
    # From here on only hashes go from step to step: of words, of pairs, of triples. zip_with pads at the end; the pads are cut.
    out = out.select("c", *[v.cast("bigint").alias(k) for k, v in counts.items()], F.transform("ws", lambda w: F.xxhash64(w)).alias("h"))
    for _ in range(2):
        out = out.withColumn("h", F.zip_with("h", F.slice("h", 2, 2**30), lambda a, b: F.xxhash64(a, b)))
    out = out.withColumn("h", F.slice("h", 1, F.greatest(F.col("n_words") - 2, F.lit(0)).cast("int")))
    return out.select("c.*", *counts, _repeated_words(F.col("h")).cast("bigint").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ln_factorial(n: Column) -> Column:
    """ln n!, by a table up to 20 and Stirling's series above (error under 1e-12)."""
    x = n.cast("double")
    series = (x + 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n <= 20, F.get(F.array(*[F.lit(math.lgamma(i + 1)) for i in range(21)]), F.least(n, F.lit(20)).cast("int"))).otherwise(series)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k); 1 without working it out where k is at least the mean."""
    term = lambda i: F.exp(ln_factorial(n) - ln_factorial(i) - ln_factorial(n - i) + i * math.log(p) + (n - i) * math.log1p(-p))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.aggregate(F.sequence(F.lit(0).cast("bigint"), k), F.lit(0.0), lambda acc, i: acc + term(i)))


def cutoffs(held: DataFrame, alpha: float = ALPHA, delta: float = DELTA, rules: dict = RULES) -> DataFrame:
    """From labelled rows (stratum, good, and what the rules' rates use): per stratum and rule the cutoff taken, with n, rejected_good, rejected_bad and the tail probability that certifies it."""
    kept_by = lambda rate, cuts: F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c >= rate))
    places = [F.struct(F.lit(name).alias("rule"), kept_by(F.expr(rate), cuts).alias("kept_by")) for name, (rate, cuts) in rules.items()]
    rows = held.select("stratum", "good", F.inline(F.array(*places)))
    counted = rows.groupBy("stratum", "rule", "kept_by").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    # A row that the first kept_by cutoffs keep is rejected by each later one: running sums over the cutoffs.
    grid = F.create_map(*[x for name, (_, cuts) in rules.items() for x in (F.lit(name), F.array(*[F.struct(F.lit(i).alias("k"), F.lit(c).alias("cutoff")) for i, c in enumerate(cuts)]))])
    own = Window.partitionBy("stratum", "rule")
    counted = counted.withColumns({"n": F.sum("g").over(own), "hist": F.collect_list(F.struct("kept_by", "g", "b")).over(own)}).dropDuplicates(["stratum", "rule"])
    tests = counted.select("stratum", "rule", "n", "hist", F.inline(grid[F.col("rule")]))
    below = lambda what: F.aggregate("hist", F.lit(0).cast("bigint"), lambda acc, h: acc + F.when(h["kept_by"] <= F.col("k"), h[what]).otherwise(0))
    tests = tests.select("stratum", "rule", "n", "cutoff", below("g").alias("rejected_good"), below("b").alias("rejected_bad"))
    tests = tests.withColumn("tail", binomial_tail(F.col("rejected_good"), F.col("n"), alpha / len(rules)))
    made = F.count(F.lit(1)).over(Window.partitionBy())
    worth = F.col("rejected_bad") - 10 * F.col("rejected_good")
    best = F.row_number().over(Window.partitionBy("stratum", "rule").orderBy(worth.desc(), F.col("cutoff").desc()))
    return tests.withColumn("tests", made).filter((F.col("tail") <= delta / F.col("tests")) & (worth > 0)).withColumn("best", best).filter("best = 1").drop("best", "tests")


def judge(docs: DataFrame, labels: DataFrame, stratum: Column | None = None, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, delta: float = DELTA, rules: dict = RULES, keep_row: bool = False) -> DataFrame:
    """id, the counts of features(), base_failed, rejected_by (the calibrated rules that reject the row) and kept; with keep_row also row, a struct of the row's columns.

    labels: (id, quality 0 or 1). Counts are written once, so texts are read once."""
    stratum = F.col("lang") if stratum is None else stratum
    carry = [F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("="), stratum.cast("string")), F.lit("null")).alias("stratum")]
    if keep_row:
        carry.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = written(features(docs, carry, text_col).withColumn("base_failed", base_failed()))
    marked = labels.filter(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.min("quality") == 1).alias("good"))
    held = found.drop("row").filter(~F.col("base_failed")).join(marked, F.col("id") == F.col("_id"))
    cuts = written(cutoffs(held, alpha, delta, rules).groupBy(F.col("stratum").alias("_s")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cuts")))
    joined = found.join(F.broadcast(cuts) if cuts.count() <= MAX_BROADCAST else cuts, F.col("stratum") == F.col("_s"), "left")
    said = [F.when((F.col("n_words") > 0) & (F.expr(rate) > F.col("_cuts")[name]), F.lit(name)) for name, (rate, _) in rules.items()]
    out = joined.withColumn("rejected_by", F.array_compact(F.array(*said))).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
    return out.drop("_s", "_cuts", "stratum")


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without the rejected rows, columns as they were."""
    return judge(docs, labels, keep_row=True, **options).filter("kept").select("row.*")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def sql(documents: str = "documents", alpha: float = ALPHA, delta: float = DELTA, rules: dict = RULES) -> str:
    cast = lambda rate: " / ".join(f"CAST({x} AS DOUBLE)" for x in rate.split(" / "))
    rates = " UNION ALL ".join(f"SELECT doc_id, '{name}' AS rule, {cast(rate)} AS rate FROM f WHERE n_words > 0" for name, (rate, _) in rules.items())
    cuts = ", ".join(f"('{name}', CAST({c} AS DOUBLE))" for name, (_, values) in rules.items() for c in values)
    p = f"CAST({alpha / len(rules)!r} AS DOUBLE)"
    return rf"""
WITH d AS (SELECT doc_id, coalesce('=' || lang, 'null') AS stratum, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM {documents}),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) >= 3)),
dup AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS r FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY doc_id),
f0 AS (SELECT doc_id, stratum, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  len(ls) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^!]', '', 'g')) AS n_bangs
  FROM d LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f0),
rates AS ({rates}),
cuts(rule, cutoff) AS (VALUES {cuts}),
held AS (SELECT doc_id, stratum, good FROM f JOIN (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) USING (doc_id) WHERE NOT base_failed),
tests AS (SELECT stratum, rule, cutoff, count(*) FILTER (good) AS n, count(*) FILTER (good AND rate > cutoff) AS k, count(*) FILTER (NOT good AND rate > cutoff) AS b FROM held JOIN rates USING (doc_id) JOIN cuts USING (rule) GROUP BY ALL),
tails AS (SELECT *, count(*) OVER () AS made, CASE WHEN k >= n * {p} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p})))) END AS tail FROM tests),
best AS (SELECT stratum, rule, cutoff FROM tails WHERE tail <= {delta} / made AND b > 10 * k QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY b - 10 * k DESC, cutoff DESC) = 1),
gone AS (SELECT DISTINCT f.doc_id FROM f JOIN best USING (stratum) JOIN rates ON rates.doc_id = f.doc_id AND rates.rule = best.rule WHERE rate > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM gone WHERE doc_id IS NOT NULL) AS kept FROM f
"""


SQL = sql()
