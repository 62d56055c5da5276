"""WARC archives and the external merge of their capture indexes.

``write_archives`` writes records as ``.warc.gz`` files (WARC 1.1, a gzip member a record) into the shared
folder, new file after ``max_bytes``. Of equal payloads of ``REVISIT_FROM`` bytes or more, the record with
the smallest id is a response and the others are revisits of it, without a block. Tasks may be run again:
each attempt writes files of its own names, and only those in the manifest, itself a written table, are read.

``read_runs`` reads archives back, record by record, and gives each archive's captures as a run sorted by URL
key, timestamp and id: the runs are a written table. ``merge_runs`` cuts the key space into ranges by sampled
quantiles (a hot URL is cut by its timestamps), brings each range's slice of every run together, and merges
the slices with a loser tree: one comparison a level for each capture. Ranges are ordered and so are the rows
in them: the whole is one capture history. A range holds about ``range_rows`` index entries, so memory is bounded
whatever the archives' size; payloads never move in the merge.

Files are opened through pyarrow's file systems, by the shared folder's URI.

Defined cases: a null html is an empty payload; a null url has no target URI and the key ``-``; null ids never
become the original of a revisit; rows that repeat the smallest id of a payload are responses each; payloads
under 100 bytes are responses each; an empty table writes no archive; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm.columns import pick
from rankweave.runtime import materialize, small_batches, work_path

REVISIT_FROM = 100
MAX_BYTES = 64 << 20
LEVEL = 1
RANGE_ROWS = 200_000
_CHUNK = 1 << 18
_RUN = "run string, seq long, urlkey string, ts string, id long, uri string, type string, refers_to long, digest string, length long, offset long"
_KEYS = ("urlkey", "ts", "id")


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]+:", uri):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    return pafs.LocalFileSystem(), uri


def url_key(url: str | None) -> str:
    """The host's labels reversed, then the path: captures of a site sort together."""
    if not url:
        return "-"
    found = re.match(r"(?is)[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\d*\.)?([^/?#:]*)(:\d+)?([^#]*)", url)
    if not found:
        return url.lower()
    return ",".join(reversed(found[1].lower().split("."))) + (found[2] or "") + ")" + (found[3].lower() or "/")


def _safe(value: str) -> str:
    """A header value: control characters would end it."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(kind: str, record_id: int | None, refers_to: int | None, uri: str | None, date: str, digest: str, payload: bytes) -> bytes:
    name = lambda n: f"<urn:capture:{'null' if n is None else n}>"
    block = b""
    if kind == "response":
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(record_id)}", f"WARC-Date: {date}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {_safe(uri)}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}", f"X-Payload-Length: {len(payload)}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_records(stream: Any) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each gzip member of an open archive, one record in memory at a time."""
    offset, data = 0, b""
    while True:
        data = data or stream.read(_CHUNK)
        if not data:
            return
        member, parts, used = zlib.decompressobj(31), [], 0
        while not member.eof:
            data = data or stream.read(_CHUNK)
            if not data:
                raise ValueError("an archive is cut off")
            parts.append(member.decompress(data))
            used += len(data) - len(member.unused_data)
            data = member.unused_data
        whole = b"".join(parts)
        head, _, rest = whole.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
        size = int(headers["content-length"])
        if len(rest) != size + 4:
            raise ValueError("a record of another length than it says")
        yield offset, headers, rest[:size]
        offset += used


def mark_revisits(captures: DataFrame) -> DataFrame:
    """Captures (id, uri, ts, payload) with digest, type and refers_to."""
    hashed = captures.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    long_ones = hashed.filter(F.octet_length("payload") >= REVISIT_FROM).select("digest", "id")
    first = long_ones.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL").select("digest", "first")
    first = materialize(first, "originals")  # as a table of its own, so that a join on a hot digest can be split
    marked = hashed.join(first, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return marked.withColumn("type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("first")))


def write_archives(captures: DataFrame, folder: str, max_bytes: int = MAX_BYTES, level: int = LEVEL) -> DataFrame:
    """Write marked captures as archives under ``folder``; the manifest (path, n_records, n_bytes)."""
    small_batches(captures.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        out, name, n, size = None, "", 0, 0
        done = []
        try:
            for batch in batches:
                for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    kind, record_id, refers_to, uri, date, digest, payload = row
                    if out is None:
                        name, n, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = fs.open_output_stream(name, compression=None)
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    packed = packer.compress(record(kind, record_id, refers_to, uri, date, digest, (payload or "").encode("utf-8", "surrogatepass"))) + packer.flush()
                    out.write(packed)
                    n, size = n + 1, size + len(packed)
                    if size >= max_bytes:
                        out.close()
                        out = None
                        done.append((name, n, size))
            if out is not None:
                out.close()
                done.append((name, n, size))
                out = None
        finally:
            if out is not None:
                out.close()
        columns = list(zip(*done, strict=True)) if done else [()] * 3
        yield pa.record_batch({"path": pa.array(columns[0], pa.string()), "n_records": pa.array(columns[1], pa.int64()), "n_bytes": pa.array(columns[2], pa.int64())})

    rows = captures.select("type", "id", "refers_to", "uri", "ts", "digest", "payload")
    return materialize(rows.mapInArrow(run, "path string, n_records long, n_bytes long"), "manifest")


def _number(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:capture:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def read_runs(manifest: DataFrame, folder: str) -> DataFrame:
    """Every archive of the manifest as a run of captures, sorted by (urlkey, ts, id); a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(folder)
        for path in chain.from_iterable(b.column(0).to_pylist() for b in batches):
            rows = []
            with fs.open_input_stream(path, compression=None) as stream:
                for offset, headers, block in read_records(stream):
                    kind = headers["warc-type"]
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        digest, length = hashlib.sha256(payload).hexdigest(), len(payload)
                        if f"sha256:{digest}" != headers["warc-payload-digest"]:
                            raise ValueError(f"{path}: a payload isn't what its digest says")
                    else:
                        digest, length = headers["warc-payload-digest"].removeprefix("sha256:"), int(headers["x-payload-length"])
                    uri = headers.get("warc-target-uri")
                    rows.append((url_key(uri), headers["warc-date"], _number(headers["warc-record-id"]), uri, kind, _number(headers.get("warc-refers-to")), digest, length, offset))
            rows.sort(key=lambda r: (r[0], r[1], r[2] is None, r[2] or 0))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 9
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            name = path.rpartition("/")[2]
            yield pa.record_batch([pa.array([name] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=[f.split()[0] for f in _RUN.split(", ")])

    n = manifest.count()
    spread = manifest.select("path").repartition(max(1, min(n, 20_000)), "path")
    return materialize(spread.mapInArrow(run, _RUN), "runs")


class LoserTree:
    """k sorted runs merged by a tournament: each inner node keeps the loser, the root the winner."""

    def __init__(self, runs: Iterable[Iterable[tuple]]):
        self.sources = [iter(r) for r in runs]
        k = len(self.sources)
        self.heads: list[tuple | None] = [next(s, None) for s in self.sources]
        self.losers = [-1] * max(1, k)
        self.winner = self._play(1) if k else -1

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or x == y and a < b

    def _play(self, node: int) -> int:
        """The winner below ``node``: leaves k..2k-1 are runs, deeper nodes first, without recursion."""
        k = len(self.sources)
        if k == 1:
            return 0
        won = [-1] * k + list(range(k))
        for at in range(k - 1, node - 1, -1):
            a, b = won[2 * at], won[2 * at + 1]
            won[at], self.losers[at] = (a, b) if self._beats(a, b) else (b, a)
        return won[node]

    def __iter__(self) -> Iterator[tuple]:
        k = len(self.sources)
        while k and (head := self.heads[self.winner]) is not None:
            yield head
            now = self.winner
            self.heads[now] = next(self.sources[now], None)
            at = (now + k) // 2
            while at >= 1 and k > 1:
                other = self.losers[at]
                if self._beats(other, now):
                    self.losers[at], now = now, other
                at //= 2
            self.winner = now


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures in one global order: columns of the runs, and range_no and pos, which number that order."""
    spark: SparkSession = runs.sparkSession
    total = runs.count()
    n = max(1, -(-total // range_rows), min(spark.sparkContext.defaultParallelism, -(-total // 1000)))
    ranged = runs.repartitionByRange(n, "urlkey", "ts", F.col("id").asc_nulls_last())
    small_batches(spark, 8192)
    names = [f.split()[0] for f in _RUN.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        # A run's slice keeps its order by seq; the shuffle may deliver its pieces in any order.
        table = table.take(pa.compute.sort_indices(table, sort_keys=[("run", "ascending"), ("seq", "ascending")]))
        names_of_runs = table.column("run").combine_chunks()
        encoded = names_of_runs.dictionary_encode().indices.to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(encoded)) + 1).tolist(), len(encoded)]
        keys = [table.column(c).to_pylist() for c in _KEYS]

        def cursor(low: int, high: int) -> Iterator[tuple]:
            for i in range(low, high):
                yield keys[0][i], keys[1][i], keys[2][i] is None, keys[2][i] or 0, i

        order = [entry[-1] for entry in LoserTree(cursor(a, b) for a, b in zip(edges, edges[1:], strict=False))]
        merged = table.take(pa.array(order, pa.int64()))
        number = TaskContext.get().partitionId()
        merged = merged.append_column("range_no", pa.array([number] * len(order), pa.int64())).append_column("pos", pa.array(range(len(order)), pa.int64()))
        yield from merged.combine_chunks().to_batches(max_chunksize=8192)

    return ranged.select(*names).mapInArrow(run, _RUN + ", range_no long, pos long")


def capture_history(captures: DataFrame, max_bytes: int = MAX_BYTES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Captures (id long, uri, ts as a WARC date, payload) written, read back and merged into one history."""
    folder = work_path(captures.sparkSession, "warc")
    manifest = write_archives(mark_revisits(captures), folder, max_bytes)
    return merge_runs(read_runs(manifest, folder), range_rows)


def page_captures(pages: DataFrame) -> DataFrame:
    """Pages as captures. The table has no times: a page's is its id in seconds after the start of 2024."""
    rows = pick(pages, page_id="long", url="string", html="string")
    second = F.timestamp_seconds(F.lit(1704067200) + F.coalesce(F.pmod(F.col("page_id"), F.lit(3_000_000_000)), F.lit(0)))
    return rows.select(F.col("page_id").alias("id"), F.col("url").alias("uri"), F.date_format(second, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), F.coalesce("html", F.lit("")).alias("payload"))


#: The query's rows in DuckDB's SQL.
ORACLE = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
