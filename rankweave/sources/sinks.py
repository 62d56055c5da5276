"""Results to files: CSV, JSON, Markdown, and the vector cache."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.functions.vectors import vector_key


def write_csv(frame: DataFrame, path: str, single: bool = False) -> None:
    """With a header. ``single`` is for reports: all rows in one file."""
    (frame.coalesce(1) if single else frame).write.mode("overwrite").option("header", True).csv(path)


def write_json(frame: DataFrame, path: str, append: bool = False) -> None:
    frame.write.mode("append" if append else "overwrite").json(path)


def signed(value: float | None) -> str:
    return "-" if value is None or value != value else f"{value:+.3f}"


def markdown_table(frame: DataFrame, title: str = "", limit: int = 1000) -> str:
    """A report's rows as a table; reports are aggregates, ``limit`` guards against anything else."""
    rows = frame.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"over {limit} rows are no report")
    shown = lambda v: signed(v) if isinstance(v, float) else "-" if v is None else str(v)
    out = [f"# {title}", ""] if title else []
    out += ["| " + " | ".join(frame.columns) + " |", "|" + " - |" * len(frame.columns)]
    return "\n".join(out + ["| " + " | ".join(map(shown, r)) + " |" for r in rows]) + "\n"


def write_markdown(frame: DataFrame, path: str | Path, title: str = "") -> None:
    Path(path).write_text(markdown_table(frame, title), encoding="utf-8")


def uncached(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Texts (text) whose vector the cache (key, vector) doesn't have, once each."""
    return texts.select("text").distinct().withColumn("key", vector_key(F.col("text"))).join(cache, "key", "left_anti")


def flush_vectors(vectors: DataFrame, path: str) -> None:
    """Append (key, vector) rows."""
    vectors.dropDuplicates(["key"]).select("key", "vector").write.mode("append").parquet(path)
