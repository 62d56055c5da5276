"""Texts to vectors through a store: a model is loaded once a worker, and only texts that the store doesn't have are encoded.

A text's key is a prefix of its SHA-256, so equal texts are encoded once, whatever table they come from. ``encode`` takes the
texts whose key the store lacks, has them encoded by the executors, appends the vectors, and joins all rows to the store. An append
is a folder named by a checksum of its keys: doing it again after a failure writes the same folder, not a second copy. Files that can't be
read count as missing, and their texts are encoded again.

Defined cases: a null text has a null vector and no key; empty texts are encoded like others by ``encode`` and are zero vectors in
``encode_documents``, as are texts without words; an empty frame encodes nothing; vectors of norm 0 stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.functions.vectors import chunk_text, mean_pool, vector_key
from rankweave.runtime import materialize, ship, work_path

#: Keys up to which what the store has is broadcast (33 bytes each), checked by a count.
BROADCAST_KEYS = 200_000
_STORED = "key string, vector array<{}>"


class Model(Protocol):
    """What a loader returns: texts to a matrix with a row for each."""

    def __call__(self, texts: list[str]) -> np.ndarray: ...


#: Models of this worker process, by name and device: tasks that follow in the same worker find theirs loaded.
_loaded: dict[tuple[str, str], Model] = {}


def _model(name: str, device: str, load: Callable[[str], Model]) -> Model:
    if (name, device) not in _loaded:
        _loaded[name, device] = load(device)
    return _loaded[name, device]


def load_letters(device: str) -> Model:
    """A stand-in for a model: how often each letter from a to z stands in the lower-case text."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    return lambda texts: np.array([[low.count(c) for c in letters] for low in (t.lower() for t in texts)], float).reshape(-1, len(letters))


@dataclass(frozen=True)
class Embedder:
    """``load`` is called with the device, once a worker; ``store`` is a folder that all executors reach (without one, vectors live in the
    session's working folder and go with it)."""

    name: str
    load: Callable[[str], Model]
    dims: int
    store: str | None = None
    batch: int = 64
    normalise: bool = True
    kind: str = "float"

    def device(self, spark: SparkSession) -> str:
        """What executors have, by the cluster's own settings."""
        return "cuda" if int(spark.conf.get("spark.executor.resource.gpu.amount", "0") or 0) > 0 else "cpu"

    def path(self, spark: SparkSession) -> str:
        known = spark.sparkContext.__dict__.setdefault("_rankweave_stores", {})
        if self.store is None and self.name not in known:
            known[self.name] = work_path(spark, "vectors")
        return f"{(self.store or known[self.name]).rstrip('/')}/{self.name}"

    def _appends(self, spark: SparkSession) -> list[str]:
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path(spark))
        files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        if not files.exists(path):
            return []
        return sorted(s.getPath().toString() for s in files.listStatus(path) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))

    def vectors(self, spark: SparkSession) -> DataFrame:
        """(key, vector) of all appends that were finished, a key once."""
        schema, found = _STORED.format(self.kind), self._appends(spark)
        if not found:
            return spark.createDataFrame([], schema)
        rows = spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(*found)
        return rows.dropDuplicates(["key"]) if len(found) > 1 else rows

    def missing(self, rows: DataFrame, text: Column) -> DataFrame:
        """(key, text): texts that the store doesn't have, once each."""
        spark = rows.sparkSession
        keyed = rows.select(vector_key(text).alias("key"), text.alias("text")).where("key IS NOT NULL")
        known = self.vectors(spark).select("key")
        known = F.broadcast(known) if known.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else known
        return keyed.join(known, "key", "left_anti").dropDuplicates(["key"])

    def _encoded(self, misses: DataFrame) -> DataFrame:
        name, load, device, size, unit, dims = self.name, self.load, self.device(misses.sparkSession), self.batch, self.normalise, self.dims
        kind = pa.float32() if self.kind == "float" else pa.float64()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = None
            for rows in batches:
                model = model or _model(name, device, load)  # a task without rows loads nothing
                for at in range(0, rows.num_rows, size):
                    part = rows.slice(at, size)
                    found = np.asarray(model(part.column(1).to_pylist()), dtype=float)
                    if found.shape != (part.num_rows, dims):
                        raise ValueError(f"{name} gave {found.shape} for {part.num_rows} texts, not {dims} numbers each")
                    if unit:
                        norm = np.linalg.norm(found, axis=1, keepdims=True)
                        found = np.divide(found, norm, out=found, where=norm > 0)
                    ends = pa.array(np.arange(0, (part.num_rows + 1) * dims, dims), pa.int32())
                    yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(ends, pa.array(found.ravel().astype(kind.to_pandas_dtype())))], names=["key", "vector"])

        return misses.mapInArrow(run, _STORED.format(self.kind))

    def fill(self, rows: DataFrame, text: Column) -> int:
        """Encode and append what the store lacks; how many texts that were."""
        spark = rows.sparkSession
        ship(spark)
        misses = materialize(self.missing(rows, text), "vector-misses")
        count, check = misses.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("key")), F.lit(0))).first()
        if count:
            append = f"{self.path(spark)}/append-{count}-{check & 0xFFFFFFFFFFFFFFFF:016x}"
            self._encoded(misses).write.mode("overwrite").parquet(append)
        return count

    def encode(self, rows: DataFrame, text: Column, out: str = "vector") -> DataFrame:
        """The rows with their texts' vectors."""
        self.fill(rows, text)
        stored = self.vectors(rows.sparkSession).select(F.col("key").alias("_key"), F.col("vector").alias(out))
        return rows.withColumn("_key", vector_key(text)).join(stored, "_key", "left").drop("_key")

    def encode_documents(self, rows: DataFrame, key: str, text: Column, out: str = "vector") -> DataFrame:
        """(key, out) of every row: its chunks encoded, pooled and brought to length 1; zeros without words."""
        chunks = rows.select(key, F.explode(chunk_text(text)).alias("chunk"))
        pooled = mean_pool(self.encode(chunks, F.col("chunk"), "_chunk_vector"), key, "_chunk_vector", out)
        zero = F.array_repeat(F.lit(0.0), self.dims)
        return rows.select(key).distinct().join(pooled, key, "left").withColumn(out, F.coalesce(out, zero))


_embedders: dict[str, Embedder] = {}


def get_embedder(name: str = "letters", load: Callable[[str], Model] = load_letters, dims: int = 26, **settings) -> Embedder:
    """The process's embedder of this name, made at the first call; settings of one's own make a new one each time."""
    if settings:
        return Embedder(name, load, dims, **settings)
    return _embedders.setdefault(name, Embedder(name, load, dims))
