"""A Python data source over JSON-lines record files, with pushdown-free batch reads."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class RecordSource(DataSource):
    """``spark.dataSource.register(RecordSource); spark.read.format("strataq_records").option("files", "a,b")``.

    Each file holds one JSON record a line; a line that is not valid JSON ends its file, as a torn write would.
    """

    @classmethod
    def name(cls) -> str:
        return "strataq_records"

    def schema(self) -> str:
        return "family string, id string, seq long, payload string"

    def reader(self, schema) -> DataSourceReader:
        return RecordReader([f for f in self.options.get("files", "").split(",") if f])


class RecordReader(DataSourceReader):
    def __init__(self, files: list[str]):
        self.files = files

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in self.files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, encoding="utf-8") as f:
            for line in f:
                try:
                    r = json.loads(line)
                except ValueError:
                    return
                yield r.get("family"), str(r.get("id")), int(r.get("seq", 0)), json.dumps(r.get("payload"))
