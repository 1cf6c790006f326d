"""Mixing sources to target weights, with DataFrame functions only.

Cases: a null text has size 0; a null source is a source of its own, ordered last; sources of size 0 get
target 0 and take nothing; repeated rows are documents of their own with the same draw; an empty table gives an
empty result; columns beside doc_id, text and source are ignored (`mix_report`) or passed on (`mix`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import with_running
from .common import WORD_CLASS, written

#: Sources get these weights in turn, by code point order.
WEIGHTS = 3
#: A source's target is at most so many times its size.
MAX_REPEATS = 3
#: A table of source rates of at most so many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_SOURCES = 50_000
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_CLASS)).cast("long")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the seed and the document only (52 bits of MD5)."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(16**13))


def source_rates(sizes: DataFrame) -> DataFrame:
    """source, source_size, target, rate from rows (source, size).

    Targets share the total by weight; those above MAX_REPEATS times their source's size stop there and the rest
    is shared again. In order of cap / weight the stopped sources are a prefix, so running sums find the level. These are
    taken in ranges of sources, so that no task holds them all; the driver gets two rows of totals.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")).withColumn("unnamed", F.col("source").isNull())
    per = with_running(per, ["unnamed", "source"], "number", {})
    per = per.withColumn("weight", ((F.col("number") - 1) % WEIGHTS + 1).cast("long")).withColumn("cap", F.col("source_size") * MAX_REPEATS)
    per = with_running(per.withColumn("fill", F.col("cap") / F.col("weight")), ["fill", "unnamed", "source"], "place", {"caps": "cap", "weights": "weight"})
    per = written(per, "mix-sources")
    total, weights = (x or 0 for x in per.agg(F.sum("source_size"), F.sum("weight")).first())
    before = F.col("weights") - F.col("weight")
    level = (F.lit(total) - (F.col("caps") - F.col("cap"))).cast("double") / (F.lit(weights) - before).cast("double")
    stopped = level * F.col("weight") > F.col("cap")
    last = per.where(~stopped).agg(F.min_by(level, before)).first()[0]
    cap = F.col("cap").cast("double")
    target = F.when(stopped, cap).otherwise(F.least(F.lit(last).cast("double") * F.col("weight"), cap))
    return per.select("source", "source_size", target.alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    )


def _with_rates(rows: DataFrame, rates: DataFrame) -> DataFrame:
    rates = written(rates, "mix-rates")
    bounded = rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    right = rates.select(F.col("source").alias("__source"), "source_size", "target", "rate")
    right = F.broadcast(right) if bounded else right
    return rows.join(right, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")


def copies() -> Column:
    """floor(rate) copies and one more with probability rate - floor(rate)."""
    whole = F.floor("rate")
    return (whole + F.when(draw(F.col("doc_id")) < F.col("rate") - whole, 1).otherwise(0)).cast("long")


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words that the mix takes of the document) and copies."""
    sizes = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    out = _with_rates(sizes, source_rates(sizes)).withColumn("copies", copies())
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The documents, each as often as the mix takes it, with the columns of `docs`."""
    rates = source_rates(docs.select("source", word_count(F.col("text")).alias("size")))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "source", "doc_id")
    out = _with_rates(held, rates).withColumn("copies", copies())
    return out.select("row", F.explode(F.sequence(F.lit(1), F.when(F.col("copies") > 0, F.col("copies")).cast("int"))).alias("copy")).select("row.*")
