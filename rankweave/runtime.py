"""Session helpers: the shared working folder, written tables that cut lineage, Arrow batch size."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch sent to Python: whole texts can be long, so batches are kept small.
ARROW_ROWS = 512
ARROW_BYTES = 16 << 20
#: Packed rows, which hold thousands of values each, of one batch.
PACKED_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a local master gets a temporary
    folder (one machine, so it is shared) and any other master a folder under the warehouse.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if (known := context.getCheckpointDir()) is not None:
        return known.rstrip("/")
    if context.master.startswith("local") and not context.master.startswith("local-cluster"):
        chosen = "file://" + tempfile.mkdtemp(prefix="rankweave-")
    else:
        chosen = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_rankweave"
    context.setCheckpointDir(chosen)
    return context.getCheckpointDir().rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses; ``clear`` deletes it."""
    path = f"{shared_dir(spark)}/rankweave/{name}-{uuid.uuid4().hex}"
    spark.sparkContext.__dict__.setdefault("_rankweave_paths", []).append(path)
    return path


def clear(spark: SparkSession) -> int:
    """Delete what this session wrote to the shared folder and say how many paths that were. Frames that read them can't be used any more."""
    paths, jvm = spark.sparkContext.__dict__.pop("_rankweave_paths", []), spark._jvm
    spark.sparkContext.__dict__.pop("_rankweave_stores", None)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    gone = 0
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        gone += path.getFileSystem(conf).delete(path, True)
    return gone


def drop(frame: DataFrame | None) -> None:
    """Delete the table behind a frame that ``materialize`` gave and that nothing reads any more."""
    if (name := getattr(frame, "_rankweave_path", None)) is None:
        return
    spark = frame.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def materialize(frame: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``frame`` to the shared folder and read it again: lineage ends, lost executors cost nothing."""
    path = work_path(frame.sparkSession, name)
    frame.write.parquet(path, compression=codec)
    written = frame.sparkSession.read.schema(frame.schema).parquet(path)
    written._rankweave_path = path
    return written


def numbered_rows(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` with ``row``, the partition and the place in it, written so that a row keeps its number."""
    return materialize(frame.withColumn("row", F.monotonically_increasing_id()), name, "zstd")


def packed_groups(rows: DataFrame, by: list[str], parts: int, each: Callable, schema: str) -> DataFrame:
    """``each(key, batches)`` over whole groups of few rows that hold many values in arrays; ``by`` are the first columns, and one alone gives a plain key.

    Rows are dealt to ``parts`` partitions by their key and sorted by it there; a task holds one group at a time.
    """
    small_batches(rows.sparkSession, PACKED_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(len(by))), strict=True))
            first = 0
            for i in range(1, len(keys) + 1):
                if i < len(keys) and keys[i] == keys[first]:
                    continue
                if held and keys[first] != last:
                    yield from each(last if len(by) > 1 else last[0], held)
                    held = []
                held.append(batch.slice(first, i - first))
                last, first = keys[first], i
        if held:
            yield from each(last if len(by) > 1 else last[0], held)

    return rows.repartition(parts, *by).sortWithinPartitions(*by).mapInArrow(run, schema)


def ship(spark: SparkSession) -> None:
    """Make this package importable for Python workers, once a context, unless PYTHONPATH does so already."""
    context, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    if getattr(context, "_rankweave_shipped", False) or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp()), "rankweave.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted((root / "rankweave").rglob("*")):
            if path.suffix in (".py", ".yaml"):
                out.write(path, path.relative_to(root))
    context.addPyFile(archive)  # Spark copies it to every executor
    context._rankweave_shipped = True


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """For operators that send whole texts to Python: workers get the package, and an Arrow batch is bounded."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    except Exception:  # a release without this setting still has the bound on rows
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame, rows: int | None = None) -> DataFrame:
    """A scan that arrives in fewer partitions than there are cores, with more than ``rows`` rows in one on average, or with over twice a core's share of all rows in one, dealt out to all; any other unchanged.

    For costly work a row on files of few row groups: a row group lies in one partition, however many a file is cut into. Only for plans without a shuffle, whose partitions are known before they run. Rows are counted from the files' footers.
    """
    cores, parts = scan.sparkSession.sparkContext.defaultParallelism, scan.rdd.getNumPartitions()
    if parts < cores and not rows:
        return scan.repartition(cores * 2)
    total, most = scan.groupBy(F.spark_partition_id()).count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    wanted = -(-total // rows) if rows else 0
    return scan.repartition(max(cores * 2, wanted, parts)) if parts < max(cores, wanted) or most * cores > 2 * total else scan
