"""Quality rules with risk-controlled cutoffs.

A rule rejects a document whose share exceeds a cutoff. Cutoffs come from a fixed
grid; a labelled holdout decides which of them are safe. For a stratum with ``n``
good labelled documents of which a cutoff rejects ``k``, the hypothesis "its false
rejection rate is above ``alpha``" is refused when the exact binomial tail
``P(Bin(n, alpha) <= k)`` is at most the allowed error, which is the same as an exact
upper confidence bound at or below ``alpha``. Within a rule the grid is tested from
the loosest cutoff to the strictest and stops at the first failure (fixed-sequence
testing needs no further correction there); the error ``delta`` is divided by the
number of rules times strata, and ``alpha`` by the number of rules, so that with
probability ``1 - delta`` no stratum loses more than ``alpha`` of its good documents
to all rules together. Of the safe cutoffs a rule takes the one that catches most bad
labelled documents, and of equals the loosest. A rule without a safe cutoff is off in
that stratum.

Everything is column expressions; no text is shuffled.

Null or empty text: no words, every count 0, fails the base rule. A null language is a
stratum of its own. Labels with a null quality or an unknown document are ignored; a
document labelled both ways counts as good. Repeated rows are each judged alone.
Empty tables give an empty result; without labels only the base rule acts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewise.functions.binding import let
from sitewise.llm.common import checkpointed, lookup_join

SPACE = r"[\x20\x09-\x0D]"
WINDOW = 5
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHARES = {"symbol_share": ("n_symbols", "word_chars"), "upper_share": ("n_upper", "word_chars"),
          "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words")}


@dataclass(frozen=True)
class RuleParams:
    """``cutoffs``: the grid, fixed before any label is seen; ``alpha``: allowed false rejection per stratum;
    ``delta``: allowed chance that any stratum exceeds it."""

    alpha: float = 0.02
    delta: float = 0.05
    cutoffs: tuple[float, ...] = (0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05, 0.03)


def with_metrics(df: DataFrame, text: str) -> DataFrame:
    """Add the counts of ``BASE`` plus ``n_upper`` and ``n_lines``, all long.

    The projections are kept apart on purpose: each array is made once per row and
    dropped with the row. A repeated window is found by 64-bit hashes of words; arrays
    are only sorted for texts in which some window does repeat.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("_body", body) \
        .withColumn("_trim", F.btrim(F.col("_body"), F.lit(" \t\n\x0b\f\r"))) \
        .withColumn("_words", F.when(F.col("_trim") != "", F.split("_trim", SPACE + "+")).otherwise(F.array().cast("array<string>"))) \
        .withColumn("_hash", F.transform("_words", lambda w: F.xxhash64(w))) \
        .withColumn("_lines", F.filter(F.split("_body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("_words")
    # The array is bound once: an optimiser that merges projections must not make it anew for each element.
    runs = let(F.col("_hash"), lambda a: F.transform(
        F.slice(a, F.lit(1), F.greatest(F.size(a) - (WINDOW - 1), F.lit(0))),
        lambda h, i: F.xxhash64(h, *[F.get(a, i + d) for d in range(1, WINDOW)])))
    out = out.withColumn("_windows", F.when(n >= WINDOW, runs).otherwise(F.array().cast("array<bigint>")))
    counts = {
        "n_words": n,
        "word_chars": F.char_length("_body") - F.regexp_count("_body", F.lit(SPACE)),
        "n_symbols": F.regexp_count("_body", F.lit(r"[#*$%&|<>]")),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.when(F.size(F.array_distinct("_windows")) == F.size("_windows"), 0).otherwise(_covered("_windows")),
        "n_upper": F.regexp_count("_body", F.lit(r"\p{Lu}")),
        "n_lines": F.size("_lines"),
    }
    return out.select(*df.columns, *[c.cast("long").alias(name) for name, c in counts.items()])


def _covered(windows: str) -> Column:
    """Words under windows that occur twice or more: sort (hash, place), keep equal neighbours, add up the gaps."""
    def repeated(pairs: Column) -> Column:
        same = F.filter(pairs, lambda p, i: (p["h"] == F.get(pairs, i - 1)["h"]) | (p["h"] == F.get(pairs, i + 1)["h"]))
        return F.array_sort(F.transform(same, lambda p: p["i"]))

    def total(places: Column) -> Column:
        steps = F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(let(pairs, repeated), total)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def with_shares(df: DataFrame) -> DataFrame:
    return df.withColumns({s: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0)) for s, (a, b) in SHARES.items()})


def log_factorial(n: Column) -> Column:
    """ln n!, exact up to 20 and by Stirling's series beyond (error below 1e-15)."""
    x = F.greatest(n.cast("double"), F.lit(20.0))
    series = x * F.log(x) - x + 0.5 * F.log(2 * F.pi() * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, 5))
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")))).otherwise(series)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k); 1 where k is at or above the mean, which no test would pass.

    Terms fall from k downwards; those beyond 40 standard deviations are below any double.
    """
    top = F.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    steps = F.least(k, F.ceil(40 * F.sqrt(n * F.lit(p)) + 40)).cast("int")
    zero = F.struct(F.lit(1.0).alias("total"), F.lit(1.0).alias("term"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] * (k - i + 1) * F.lit(1 - p) / ((n - k + i) * F.lit(p))
        return F.struct((acc["total"] + term).alias("total"), term.alias("term"))

    walk = F.aggregate(F.when(steps > 0, F.sequence(F.lit(1), F.greatest(steps, F.lit(1)))).otherwise(F.array().cast("array<int>")),
                       zero, add, lambda acc: acc["total"])
    return F.when(k >= n * F.lit(p), 1.0).otherwise(top * walk)


def safe_cutoffs(labelled: DataFrame, stratum: str, params: RuleParams) -> DataFrame:
    """``stratum, rule, cutoff, n, k, caught, p_value, safe, chosen`` for every rule and cutoff.

    ``labelled`` has the shares, ``good`` (boolean) and the stratum. One aggregate with
    a sum per rule and cutoff, so hot strata combine before the shuffle.
    """
    grid = [(r, c) for r in SHARES for c in sorted(params.cutoffs, reverse=True)]
    hit = [(F.col(r) > F.lit(float(c))) for r, c in grid]
    sums = labelled.groupBy(stratum).agg(
        F.count_if("good").alias("n"),
        *[F.count_if(F.col("good") & h).alias(f"_k{i}") for i, h in enumerate(hit)],
        *[F.count_if(~F.col("good") & h).alias(f"_b{i}") for i, h in enumerate(hit)])
    strata = max(1, sums.count())
    long = sums.select(stratum, "n", F.inline(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(float(c)).alias("cutoff"), F.lit(i).alias("step"), F.col(f"_k{i}").alias("k"), F.col(f"_b{i}").alias("caught"))
        for i, (r, c) in enumerate(grid)])))
    tested = long.withColumn("p_value", F.when(F.col("n") > 0, binomial_tail(F.col("k"), F.col("n"), params.alpha / len(SHARES))).otherwise(1.0))
    passed = F.col("p_value") <= F.lit(params.delta / (len(SHARES) * strata))
    # One window row per grid cutoff: the windows hold a few rows each.
    rule = Window.partitionBy(stratum, "rule")
    looser = rule.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    safe = tested.withColumn("safe", F.min(passed).over(looser))
    best = F.max_by("step", F.when(F.col("safe"), F.struct("caught", "cutoff"))).over(rule)
    return safe.withColumn("chosen", F.coalesce(F.col("safe") & (F.col("step") == best), F.lit(False))).drop("step")


def chosen_cutoffs(report: DataFrame, stratum: str) -> DataFrame:
    """One row per stratum: ``<rule>_cutoff``, null where the rule is off."""
    return report.groupBy(stratum).agg(*[F.max(F.when(F.col("chosen") & (F.col("rule") == r), F.col("cutoff"))).alias(f"{r}_cutoff") for r in SHARES])


def good_labels(labels: DataFrame) -> DataFrame:
    """``_doc, good``: one row per labelled document."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    return known.groupBy(F.col("doc_id").alias("_doc")).agg((F.max("quality") > 0).alias("good"))


def fit_cutoffs(measured: DataFrame, labels: DataFrame, params: RuleParams = RuleParams()) -> DataFrame:
    """Cutoffs per language from measured documents (``doc_id, lang``, counts) and their labels."""
    labelled = measured.join(good_labels(labels), F.col("doc_id") == F.col("_doc"))
    return chosen_cutoffs(safe_cutoffs(with_shares(labelled), "lang", params), "lang")


def verdict(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Add ``base_failed`` and ``kept``; ``measured`` has ``lang`` and the counts."""
    judged = lookup_join(with_shares(measured), cutoffs, ["lang"])
    over = reduce(lambda a, b: a | b, [F.coalesce(F.col(r) > F.col(f"{r}_cutoff"), F.lit(False)) for r in SHARES])
    return judged.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~over)


def checkpointed_metrics(docs: DataFrame) -> DataFrame:
    """``doc_id, lang`` and the counts, written once: a few dozen bytes a document, read by both fitting and judging."""
    return checkpointed(with_metrics(docs.select("doc_id", "lang", "text"), "text").drop("text"))
