"""Mixing sources to target weights.

Tokens are summed per source before any shuffle; a source's repetition rate is
its target over its size, and every document is taken ``floor(rate)`` times plus
once more when a hash of its id falls below the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialake.llm.texts import WORD, without
from medialake.operators.ordered import stage

OUT = ["size", "source_size", "target", "copies"]


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) that depends on the key and the seed alone."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(16**13))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """``source, source_size, target`` from ``source, size``.

    Sources by code point, null last, take the weights in turn and share all of
    the tokens. No target exceeds ``cap`` times its source; what is cut goes to
    the others by weight. With the sources in the order of cap over weight the
    full ones are a prefix, so the fixed point is one running sum and no loop.
    The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((turn - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("__w", weight).withColumn("__cap", F.col("source_size") * cap)
    filling = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last())
    before, after = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.coalesce(F.sum("__cap").over(before), F.lit(0))
    per = per.withColumn("__level", left / F.sum("__w").over(after))
    per = per.withColumn("__full", F.col("__level") * F.col("__w") >= F.col("__cap"))
    level = F.max(F.when(~F.col("__full"), F.col("__level"))).over(everything)
    target = F.when(F.col("__full"), F.col("__cap").cast("double")).otherwise(level * F.col("__w"))
    return per.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: str = "mix", text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """Every row with ``size, source_size, target`` and ``copies``, the times the mix takes it (0 or more).

    A row of no words has size 0; a null source is a source of its own; with no
    words at all every target is 0 and nothing is taken. Rows with one key (equal
    rows, or null keys) get the same draw. Columns of these names in the input are replaced.
    """
    sized = without(docs, OUT).withColumn("size", n_words(F.col(text)))
    plan = stage(source_targets(sized.select(F.col(source).alias("source"), "size"), weights, cap)).withColumnRenamed("source", "__source")
    # the staged plan has one row per source: Spark broadcasts it while its file is below the session's threshold and splits skewed keys beyond it
    joined = sized.join(plan, F.col(source).eqNullSafe(F.col("__source")), "left").drop("__source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor(rate) + (draw(F.col(key), seed) < rate - F.floor(rate)).cast("long")
    return joined.withColumn("copies", copies)


def emit(mixed: DataFrame) -> DataFrame:
    """One row for each copy taken, with the columns the documents had before :func:`mix`."""
    taken = mixed.where(F.col("copies") > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return taken.drop("__copy", *OUT)
