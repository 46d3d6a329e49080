"""Records of a remote catalogue as a data source, for tables and streams."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "accession string, content string, error string"


class Provider(Protocol):
    """A catalogue of records in a fixed order, to whose end new ones may be added. It is called on executors."""

    def count(self) -> int: ...

    def names(self, start: int, end: int) -> list[str]: ...

    def fetch(self, names: list[str]) -> dict[str, str]: ...


@dataclass
class Batch(InputPartition):
    """The records from number ``start`` below ``end``, which are asked for at once."""

    start: int
    end: int


def asked(provider: Provider, batch: Batch, tries: int, wait: float, pause: float) -> Iterator[tuple]:
    """Rows (accession, content, error) of a batch.

    A failed request is repeated, after ``wait`` seconds more each time, and at last its rows carry the error; a record that the
    answer lacks has neither content nor error. ``pause`` seconds pass before each request but the first.
    """
    names, got, error = provider.names(batch.start, batch.end), {}, None
    time.sleep(pause if batch.start else 0)
    for n in range(1, tries + 1):
        try:
            got, error = provider.fetch(names), None
            break
        except Exception as e:  # noqa: BLE001
            error = f"{type(e).__name__}: {e}"
            time.sleep(wait * n if n < tries else 0)
    for name in names:
        yield name, got.get(name), error


def record_source(provider: Provider, name: str = "accession_records", size: int = 100, tries: int = 3, wait: float = 15.0, pause: float = 0.3) -> type[DataSource]:
    """A data source over a catalogue, to be registered with ``spark.dataSource.register``.

    Partitions are batches of ``size`` records, so that a request is a task and a lost one is asked for again alone. As a stream
    its offset is the number of records read, which Spark keeps in the checkpoint: a restart asks for the rest only.
    """
    settings = tries, wait, pause

    def batches(start: int, end: int) -> list[Batch]:
        return [Batch(a, min(a + size, end)) for a in range(start, end, size)]

    class Reader(DataSourceReader):
        def partitions(self):
            return batches(0, provider.count()) or [Batch(0, 0)]

        def read(self, partition):
            return asked(provider, partition, *settings)

    class Stream(DataSourceStreamReader):
        def initialOffset(self):
            return {"records": 0}

        def latestOffset(self, *_):
            return {"records": provider.count()}

        def partitions(self, start, end):
            return batches(start["records"], end["records"])

        def read(self, partition):
            return asked(provider, partition, *settings)

    class Records(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            return Reader()

        def streamReader(self, schema):
            return Stream()

    return Records


def read_records(spark: SparkSession, source: type[DataSource]) -> DataFrame:
    """All records of a source, which is registered under its name."""
    spark.dataSource.register(source)
    return spark.read.format(source.name()).load()


def fetch_new(spark: SparkSession, source: type[DataSource], out: str, checkpoint: str) -> DataFrame:
    """Append the records that the checkpoint doesn't know to the Parquet table at ``out``; returns the whole table."""
    spark.dataSource.register(source)
    q = spark.readStream.format(source.name()).load().writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(SCHEMA).parquet(out)
