"""Shared column handling: operators pick their own columns by name and never clash with extra ones."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pick(frame: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns, cast: ``pick(df, doc_id="long", text="string")``."""
    return frame.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in wanted.items()])


def fresh(frame: DataFrame, stem: str) -> str:
    """A column name that ``frame`` doesn't have, compared as Spark compares names."""
    taken, name, n = {c.lower() for c in frame.columns}, stem, 0
    while name.lower() in taken:
        n += 1
        name = f"{stem}_{n}"
    return name


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """A column as Python strings, null as empty."""
    return [x if x is not None else "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]
