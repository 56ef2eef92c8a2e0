"""A pull callback as a streaming source of live objects."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from medialake.schemas import LIVE_OBJECT


class _Range(InputPartition):
    def __init__(self, start: int, stop: int):
        super().__init__((start, stop))
        self.start, self.stop = start, stop


def pulled_source(name: str, latest: Callable[[dict], int], pull: Callable[[dict, int, int], Iterator[tuple]],
                  rows_per_partition: int = 10000) -> type[DataSource]:
    """A data source class over ``pull(options, start, stop)``, which yields rows start..stop-1 of the live-object schema.

    ``latest(options)`` is the number of rows that exist so far. Ranges are read
    by separate tasks and may be read again after a failure, so ``pull`` must
    give the same rows for the same range.
    """

    class Reader(DataSourceStreamReader):
        def __init__(self, options: dict):
            self.options = options

        def initialOffset(self) -> dict:
            return {"rows": 0}

        def latestOffset(self) -> dict:
            return {"rows": latest(self.options)}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            a, b = start["rows"], end["rows"]
            return [_Range(i, min(i + rows_per_partition, b)) for i in range(a, b, rows_per_partition)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            return pull(self.options, partition.start, partition.stop)

        def commit(self, end: dict) -> None:
            pass

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self):
            return LIVE_OBJECT

        def streamReader(self, schema) -> DataSourceStreamReader:
            return Reader(dict(self.options))

    return Source


def read_pulled(spark: SparkSession, source: type[DataSource], **options: str) -> DataFrame:
    spark.dataSource.register(source)
    return spark.readStream.format(source.name()).options(**options).load()
