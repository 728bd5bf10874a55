"""Time as a stream: consecutive half-open intervals, for sources that can only be scanned.

The stream has one row (low, high) in each batch: from where the last batch ended to now. Offsets are the ends of the
intervals and live in the checkpoint, so a query that is started again goes on where it was, and a batch that was not
finished is run again with the very interval that it had.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


class _Interval(InputPartition):
    def __init__(self, low: str, high: str):
        self.low, self.high = low, high


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.since, self.until = options["since"], options.get("until")

    def initialOffset(self) -> dict:
        return {"at": self.since}

    def latestOffset(self) -> dict:
        now = max(datetime.now(timezone.utc), datetime.fromisoformat(self.since))
        return {"at": (now if self.until is None else min(now, datetime.fromisoformat(self.until))).isoformat()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Interval(start["at"], end["at"])] if datetime.fromisoformat(start["at"]) < datetime.fromisoformat(end["at"]) else []

    def read(self, partition: _Interval) -> Iterator[tuple]:
        yield datetime.fromisoformat(partition.low), datetime.fromisoformat(partition.high)


class IntervalSource(DataSource):
    """Options `since` (where a new checkpoint starts) and `until` (where the stream ends), in ISO format with zone."""

    @classmethod
    def name(cls) -> str:
        return "tabiya_intervals"

    def schema(self) -> str:
        return "low timestamp, high timestamp"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options)


def interval_stream(spark: SparkSession, since: datetime, until: datetime | None = None) -> DataFrame:
    spark.dataSource.register(IntervalSource)
    reader = spark.readStream.format("tabiya_intervals").option("since", since.isoformat())
    return (reader if until is None else reader.option("until", until.isoformat())).load()
