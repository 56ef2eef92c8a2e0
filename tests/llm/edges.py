"""Rows that every text operator has to take: nulls, empty and very long texts, repeated rows, clashing names."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType()),
                     *[StructField(c, StringType()) for c in ("Score", "size", "shard", "spans", "kept", "length", "__x")], StructField("copies", DoubleType())])
BASE = "the quick brown fox jumps over the lazy dog near the old river bank while seven small birds sing in tall trees all day long"
LONG = " ".join(f"word{i % 700} and" for i in range(30_000))
TEXTS = [None, "", " \t\n ", BASE, BASE, BASE + " today", BASE.upper(), "one", "one", "two words", "éclair naïve 東京 Привет мир", LONG, "12 34 !!", "x" * 50_000, "a\nb\na\nb\n\n\na", "password=abcdefghijkl12 ok"]


def docs(spark, rows=None):
    rows = [(i + 10, t) for i, t in enumerate(TEXTS)] if rows is None else rows
    made = [(i, t, None if i is None or i % 3 == 0 else "en", None if i is None or i % 4 == 0 else f"s{i % 3}", None, *["mine"] * 7, 1.5) for i, t in rows]
    return spark.createDataFrame(made, SCHEMA)


def with_repeats(spark):
    """The edge texts, two of them as equal rows, and rows without an id."""
    rows = [(i + 10, t) for i, t in enumerate(TEXTS)]
    return docs(spark, [*rows, rows[3], rows[3], rows[7], (None, BASE), (None, None)])
