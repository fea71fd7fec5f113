"""Mixing sources to target weights by Poisson replication.

A source with target share w of a budget of B characters and m characters of its own
is repeated at the rate B * w / m. Each document draws a Poisson count with that mean by
inverting the distribution at a uniform number hashed from seed and document, so a lost
task draws the same counts again. Documents are exploded by their counts and put into
one global order by a hash of document and copy.

Only column expressions. Source totals combine before the shuffle; rates are joined by
broadcast after their rows are counted. The final range sort is on a hash, so neither a
hot source nor a document of many copies lands in one partition.

A null source is a source of its own. A source without characters, or without a target,
has the rate 0: none of its documents appear. Null text has no characters but is
repeated like its source's others. Rows equal in seed and document id draw the same
count, each for itself. Empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.llm.common import lookup_join

UNIT = 2.0**52
MOST = 500


def hashed_uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of the parts, a null written as ``~``."""
    text = F.concat_ws("|", *[F.coalesce((F.lit(p) if isinstance(p, str) else p).cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / UNIT


def poisson_count(rate: Column, uniform: Column) -> Column:
    """A Poisson count: the smallest k whose distribution function exceeds ``uniform``.

    Beyond ``MOST`` the term at 0 nears the smallest double. Such a rate is drawn as the sum of as many equal
    parts as bring each to ``MOST`` at most, which has the same law. The first part inverts at ``uniform``, each
    other at a number hashed from it and the part.
    """
    parts = F.greatest(F.ceil(rate / MOST), F.lit(1)).cast("int")
    each = rate / parts

    def inverted(at: Column) -> Column:
        last = F.ceil(each + 12 * F.sqrt(each) + 20).cast("int")
        start = F.struct(F.exp(-each).alias("term"), F.exp(-each).alias("upto"), F.lit(0).alias("n"))

        def add(acc: Column, k: Column) -> Column:
            term = acc["term"] * each / k
            return F.struct(term.alias("term"), (acc["upto"] + term).alias("upto"),
                            (acc["n"] + F.when(acc["upto"] <= at, 1).otherwise(0)).alias("n"))

        return F.aggregate(F.sequence(F.lit(1), last), start, add, lambda acc: acc["n"])

    others = F.aggregate(F.sequence(F.lit(2), parts), F.lit(0), lambda n, part: n + inverted(hashed_uniform(uniform, part)))
    drawn = inverted(uniform) + F.when(parts > 1, others).otherwise(0)
    return F.when(rate > 0, drawn.cast("int")).otherwise(0)


def source_mass(docs: DataFrame) -> DataFrame:
    """``source, mass``: characters per source."""
    return docs.groupBy("source").agg(F.sum(F.coalesce(F.char_length("text"), F.lit(0))).cast("long").alias("mass"))


def tempered_targets(mass: DataFrame, exponent: float = 0.5) -> DataFrame:
    """Target weight ``mass ** exponent`` per source: below 1 lifts small sources."""
    return mass.select("source", F.pow(F.col("mass").cast("double"), F.lit(exponent)).alias("weight"))


def repetition_rates(mass: DataFrame, targets: DataFrame, epochs: float = 1.0) -> DataFrame:
    """``source, rate`` such that the expected mix has the targets' shares and ``epochs`` times the mass in all."""
    t = targets.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("_w"))
    both = mass.join(t, mass["source"].eqNullSafe(t["_s"]), "left").select("source", "mass", F.coalesce("_w", F.lit(0.0)).alias("_w"))
    total = both.where("mass > 0").agg(F.sum("mass").cast("double").alias("mass"), F.sum("_w").alias("w")).first()
    if not total["w"]:
        return both.select("source", F.lit(0.0).alias("rate"))
    budget = float(epochs) * total["mass"] / total["w"]
    return both.select("source", F.when(F.col("mass") > 0, F.lit(budget) * F.col("_w") / F.col("mass")).otherwise(0.0).alias("rate"))


def mix(docs: DataFrame, rates: DataFrame, seed: int = 17) -> DataFrame:
    """``docs`` repeated and shuffled; adds ``_copy`` (from 1) and ``_order`` (the shuffle key).

    The caller drops the two columns or keeps them; ``docs`` may not have columns of these names.
    """
    rated = lookup_join(docs, rates.withColumnRenamed("rate", "_rate"), ["source"])
    counted = rated.withColumn("_n", poisson_count(F.coalesce("_rate", F.lit(0.0)), hashed_uniform(str(seed), F.col("doc_id")))).where("_n > 0")
    copies = counted.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n", "_rate")
    keyed = copies.withColumn("_order", hashed_uniform(f"{seed}/order", F.col("doc_id"), F.col("_copy")))
    return keyed.repartitionByRange("_order", "doc_id").sortWithinPartitions("_order", "doc_id")
