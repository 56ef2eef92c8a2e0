"""Folds whose next state depends on accepting the row: streamed over sorted partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def fold_sorted(df: DataFrame, keys: list[str], order: list[str], step: Callable, schema: str) -> DataFrame:
    """Run ``step(state, row) -> (state, output tuple or None)`` over each key's rows in order.

    Spark shuffles by key and sorts (spilling as needed); the task then streams
    its rows batch by batch and keeps one state, so memory does not grow with a
    key. ``state`` is None on a key's first row.
    """
    columns = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        names = [c.strip().split(" ")[0] for c in schema.split(",")]
        key_at = [columns.index(k) for k in keys]
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                key = tuple(row[i] for i in key_at)
                if key != current:
                    current, state = key, None
                state, produced = step(state, dict(zip(columns, row)))
                if produced is not None:
                    out.append(produced)
            if out:
                yield pd.DataFrame(out, columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
