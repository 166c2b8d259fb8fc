"""Quality rules with risk-controlled thresholds, all in DataFrame and SQL functions.

A rule rejects a text whose statistic exceeds a cutoff. Per stratum (size class of the text) and rule a grid of cutoffs is
tested on labelled good texts: with k of n rejected, a cutoff is safe when an exact binomial test at the
corrected level rules out a false-rejection rate above ``risk``. The lowest safe cutoff is used; without a
safe one the rule is off in that stratum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

# Fixed values of the base statistics.
BLANKS = "\t\n\x0b\x0c\r "
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words

#: Highest allowed rate of rejected good texts per stratum over all rules, and the risk that it is exceeded anywhere.
RISK = 0.05
DELTA = 0.05
#: Cutoffs tested per rule, as shares; the same grid for each.
GRID = [i / 20 for i in range(1, 21)]
RULES = ("symbols", "dup_lines", "repeats", "long_words")
#: Lower bounds (in words) of the strata.
STRATA = (0, 50, 100, 200, 400, 800, 1600)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Number of words inside 3-word windows that occur at least twice in the array of words.

    Windows are sorted with their places as (w1, w2, w3, place) structs; equal neighbours are repeats. Each
    repeated window covers the words from its place to the next repeated window's place, three at most.
    """
    places = F.sequence(F.lit(0), F.size(words) - 3)
    windows = F.transform(places, lambda p: F.struct(F.concat_ws(" ", F.slice(words, p + 1, F.lit(3))).alias("w"), p.alias("p")))

    def repeats(s: Column) -> Column:
        last = F.size(s) - 1
        hit = F.filter(
            s, lambda x, i: ((i > 0) & (x["w"] == F.get(s, i - 1)["w"])) | ((i < last) & (x["w"] == F.get(s, i + 1)["w"]))
        )
        return F.sort_array(F.transform(hit, lambda x: x["p"]))

    def covered(at: Column) -> Column:
        return F.aggregate(
            at,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
            lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(a["end"], p)).alias("n"), (p + 3).alias("end")),
            lambda a: a["n"],
        )

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(
        let(F.sort_array(windows), lambda s: let(repeats(s), covered))
    )


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_long_words) of every whole
    text. Null text: nothing in it, so all are 0."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), words.alias("words"), lines.alias("lines"))
    return rows.select(
        F.col("id").alias(id_col),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("words", lambda w: F.length(w) > 20)).cast("long").alias("n_long_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def stratum() -> Column:
    out = F.lit(0)
    for i, least in enumerate(STRATA[1:], 1):
        out = F.when(F.col("n_words") >= least, F.lit(i)).otherwise(out)
    return out


def shares() -> dict[str, Column]:
    """The rules' statistics, as shares."""
    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    return {
        "symbols": share("n_symbols", "word_chars"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "long_words": share("n_long_words", "n_words"),
    }


def log_factorial(n: Column) -> Column:
    """Stirling's series at n + 8, carried back; exact to about 1e-13."""
    x = n + 8.0
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5)))
    product = F.lit(1.0)
    for i in range(1, 9):
        product = product * (n + i)
    return series - F.log(product)


def tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial with n trials: the term at k, then downwards. Terms further than 40 standard
    deviations below the mean are below 1e-300 and left out, so the sum's length is bounded by sqrt(n)."""
    k, n = k.cast("double"), n.cast("double")
    top = F.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p))
    terms = F.least(k, F.ceil(40 * F.sqrt(n) + 40)).cast("int")
    odds = (1 - p) / p
    total = F.aggregate(
        F.sequence(F.lit(0), terms),
        F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s")),
        lambda a, j: F.struct((a["t"] * F.greatest(k - j, F.lit(0.0)) / (n - k + j + 1) * odds).alias("t"), (a["s"] + a["t"]).alias("s")),
        lambda a: a["s"],
    )
    return F.when(k >= n, 1.0).otherwise(F.least(top * total, F.lit(1.0)))


def cutoffs(labelled: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, one column per rule with its cutoff or null) from statistics of good labelled texts.

    One aggregation counts, per stratum, the texts above every cutoff of every rule; the risk is shared
    among the rules (a text is rejected if any rule does) and the level among all strata, rules and
    cutoffs (Bonferroni).
    """
    share = shares()
    above = [F.count_if(share[r] > c).alias(f"{r}_{i}") for r in RULES for i, c in enumerate(GRID)]
    counted = labelled.groupBy(stratum().alias("stratum")).agg(F.count(F.lit(1)).alias("n"), *above)
    level = delta / (len(STRATA) * len(RULES) * len(GRID))
    limit = risk / len(RULES)
    tests = counted.select(
        "stratum",
        "n",
        F.explode(
            F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cut"), F.col(f"{r}_{i}").alias("k")) for r in RULES for i, c in enumerate(GRID)])
        ).alias("t"),
    ).select("stratum", "t.rule", "t.cut", (tail(F.col("t.k"), F.col("n"), limit) <= level).alias("safe"))
    return tests.groupBy("stratum").agg(*[F.min(F.when(F.col("safe") & (F.col("rule") == r), F.col("cut"))).alias(r) for r in RULES])


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The statistics of every document with ``base_failed``, the ``rules`` that reject it and ``kept``.

    ``labels`` (id, 1 for good) name the holdout texts; several labels of an id count it once, as good if one is. The statistics are written to the
    shared folder once, as calibration and verdict both read them. The cutoffs are one row per
    stratum, at most ``len(STRATA)``. Without safe cutoffs (no or few labels) only the base rules
    reject. Null ids and repeated rows keep their rows; other columns are not read.
    """
    stats = cut_lineage(statistics(docs, id_col, text_col), "statistics")
    good = labels.filter(F.col(label_col) == 1).select(id_col).distinct()
    # Texts that the base rules reject are outside what the other rules decide.
    found = cutoffs(stats.filter(~base_failed()).join(good, id_col, "left_semi"))
    share = shares()
    numbered = stats.withColumn("stratum", stratum())
    joined = numbered.join(F.broadcast(found.select(F.col("stratum").alias("s"), *[F.col(r).alias(f"cut_{r}") for r in RULES])), F.col("stratum") == F.col("s"), "left")
    hits = F.array_compact(F.array(*[F.when(share[r] > F.col(f"cut_{r}"), F.lit(r)) for r in RULES]))
    verdict = joined.withColumn("rules", hits).withColumn("base_failed", base_failed())
    return verdict.select(*stats.columns, "stratum", "base_failed", "rules", (~F.col("base_failed") & (F.size("rules") == 0)).alias("kept"))
