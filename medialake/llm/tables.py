"""Small helpers on DataFrames: broadcasts behind a size check, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake.operators.ordered import stage

BROADCAST_ROWS = 400_000


def tight(df: DataFrame) -> DataFrame:
    """``df`` staged by an eighth as many tasks as its last shuffle has partitions, or two a core if that is more.

    A task then works through several partitions one after another, which takes no
    more memory, and a small table does not become a file for each partition. The
    number follows ``spark.sql.shuffle.partitions``, which follows the size of the data.
    """
    spark = df.sparkSession
    return stage(df.coalesce(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)))


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, staged, with a broadcast hint if it has at most ``rows`` narrow rows; beyond that Spark plans the join."""
    return hinted(tight(df), rows)


def hinted(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The same for what is read from staged tables already."""
    return F.broadcast(table) if table.count() <= rows else table


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of the links ``a, b``: the smallest node that can be reached.

    Labels spread over links and then jump to the label of their label, so the
    rounds grow with the logarithm of a chain. Every round is written as a table;
    nothing is collected but the number of labels that still change.
    """
    both = tight(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    labels = tight(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        labels = hinted(labels)
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        roots = labels.select(F.col("node").alias("near"), F.col("label").alias("root"))
        # a node's own label is among its neighbours' nearest, or smaller than all of them
        step = near.join(labels, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("near")).join(roots, "near")
        step = tight(step.select("node", "old", F.least("near", "root").alias("label")))
        labels = step.select("node", "label")
        if step.where("label <> old").isEmpty():
            return labels


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """``doc_id, text, label`` of at most ``rows`` labelled documents, those with the lowest hashes of their ids.

    ``labels`` holds what may be learned from; null labels are left out and the
    largest stands for several. The sample is written once, so learning reads the
    whole corpus no more than that.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    # a top-k by hash: every task keeps ``rows`` ids at most
    chosen = stage(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    return stage(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
