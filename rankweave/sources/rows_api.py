"""A paged JSON rows API as a Spark data source: one partition a page, retries with growing pauses.

    spark.dataSource.register(RowsApi)
    spark.read.format("rows_api").option("url", "https://host/rows?dataset=d").option("limit", "500").load()

Each page is fetched by ``offset`` and ``length``; an answer has ``rows`` of ``{"row": {...}}``.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rankweave.functions.text import redact

PAGE, RETRIES, MIN_CHARS = 20, 4, 400


class _Page(InputPartition):
    def __init__(self, offset: int, length: int):
        self.offset, self.length = offset, length


def fetch_page(url: str, offset: int, length: int, retries: int = RETRIES, pause: float = 2.0) -> list[dict]:
    address = f"{url}{'&' if '?' in url else '?'}offset={offset}&length={length}"
    for turn in range(1, retries + 1):
        try:
            with urllib.request.urlopen(address, timeout=60) as answer:
                return [r["row"] for r in json.load(answer)["rows"]]
        except (urllib.error.URLError, OSError, ValueError, KeyError):
            if turn == retries:
                raise
            time.sleep(pause * turn)
    return []


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.limit = options["url"], int(options.get("limit", 100))
        self.pause = float(options.get("pause", 2.0))

    def partitions(self) -> list[InputPartition]:
        return [_Page(at, min(PAGE, self.limit - at)) for at in range(0, self.limit, PAGE)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        for i, row in enumerate(fetch_page(self.url, partition.offset, partition.length, pause=self.pause)):
            yield str(row.get("id", partition.offset + i)), row.get("category") or row.get("Category"), row.get("text") or row.get("Text")


class RowsApi(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rows_api"

    def schema(self) -> str:
        return "id string, category string, text string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def clean(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Rows long enough, redacted."""
    return rows.filter(F.length("text") >= min_chars).withColumn("text", redact(F.col("text")))


def categories(rows: DataFrame, top: int = 12) -> DataFrame:
    return rows.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(top)


def load_category(rows: DataFrame, category: str, limit: int) -> DataFrame:
    return rows.filter(F.col("category") == category).orderBy("id").limit(limit)
