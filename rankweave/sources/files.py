"""Documents from files, alone or in ZIP archives: TXT, MD, DOCX, and PDF where a PDF library is installed."""

from __future__ import annotations

import io
import re
import uuid
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.runtime import ARROW_BYTES, ARROW_ROWS, ship
from rankweave.schemas import WHITE

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_BLACK, _SIZE, _PAGE_SHARE = 0, 11.0, 0.9
_MIN_CHARS = 120
#: Files of one archive, and bytes of their contents past which a new one is begun.
ARCHIVE_FILES = 5_000
ARCHIVE_BYTES = 32 << 20
_PARSED = "path string, text string, source_format string, spans array<struct<text:string,page:int,font:string,size:double,color:int,flags:int,bbox:array<double>>>, page_count int, page_backgrounds array<int>, error string"


class ParsingError(ValueError):
    """A document that can't be read."""


def _tidy(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", text)).strip()


def _span(text: str, size: float, color: int, page: int = 0, font: str = "", flags: int = 0, bbox: list[float] | None = None) -> dict:
    return {"text": text, "page": page, "font": font, "size": size, "color": color, "flags": flags, "bbox": bbox}


def _document(kind: str, text: str, spans: list[dict], pages: int = 1, backgrounds: list[int] | None = None) -> dict:
    return {"text": _tidy(text), "source_format": kind, "spans": spans, "page_count": pages, "page_backgrounds": backgrounds or [WHITE]}


def parse_text(data: bytes) -> dict:
    text = data.decode("utf-8", errors="replace")
    return _document("txt", text, [_span(x, _SIZE, _BLACK) for x in text.splitlines() if x.strip()])


def _runs(paragraph: ET.Element) -> Iterator[dict]:
    for run in paragraph.iter(f"{_W}r"):
        text = "".join("\t" if e.tag == f"{_W}tab" else "\n" if e.tag in (f"{_W}br", f"{_W}cr") else e.text or "" for e in run if e.tag in (f"{_W}t", f"{_W}tab", f"{_W}br", f"{_W}cr"))
        if not text.strip():
            continue
        look = {e.tag.removeprefix(_W): e for e in run.find(f"{_W}rPr") or ()}
        value = lambda name, key="val": look[name].get(_W + key) if name in look else None  # noqa: B023, E731
        color = value("color") or ""
        yield _span(text, float(value("sz") or 0) / 2, int(color, 16) if re.fullmatch(r"[0-9A-Fa-f]{6}", color) else -1, font=value("rFonts", "ascii") or "")


def parse_docx(data: bytes) -> dict:
    """Body paragraphs, then the cells of tables, each run a span."""
    try:
        body = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ET.ParseError, OSError) as e:
        raise ParsingError(f"not a DOCX file: {e}") from e
    if body is None:
        raise ParsingError("a DOCX file without a body")
    spans, rows = [], []
    for paragraph in [*body.findall(f"{_W}p"), *[p for t in body.findall(f"{_W}tbl") for p in t.iter(f"{_W}p")]]:
        if runs := list(_runs(paragraph)):
            spans += runs
            rows.append("".join(r["text"] for r in runs))
    return _document("docx", "\n".join(rows), spans)


def page_background(drawings: Iterable[tuple[float, int | None]], page_area: float) -> int:
    """The fill of the first drawing (area, colour) that covers nine tenths of a page; white without one."""
    return next((c for area, c in drawings if c is not None and area >= _PAGE_SHARE * page_area), WHITE)


def parse_pdf(data: bytes) -> dict:
    try:
        import fitz
    except ImportError as e:
        raise ParsingError("reading PDF needs PyMuPDF, which isn't installed") from e
    try:
        pdf = fitz.open(stream=data, filetype="pdf")
    except Exception as e:
        raise ParsingError(f"not a PDF file: {e}") from e
    pack = lambda fill: None if not fill else sum(round(c * 255) << s for c, s in zip(fill, (16, 8, 0), strict=False))
    spans, pages, backgrounds = [], [], []
    for number, page in enumerate(pdf):
        backgrounds.append(page_background(((d["rect"].get_area(), pack(d.get("fill"))) for d in page.get_drawings()), page.rect.get_area()))
        rows = [line["spans"] for block in page.get_text("dict")["blocks"] for line in block.get("lines", ())]
        spans += [_span(s["text"], s["size"], s["color"], number, s["font"], s["flags"], list(s["bbox"])) for row in rows for s in row]
        pages.append("\n".join("".join(s["text"] for s in row) for row in rows))
    return _document("pdf", "\n\n".join(pages), spans, len(pages), backgrounds)


#: A suffix's parser; add to it to read more formats.
PARSERS: dict[str, Callable[[bytes], dict]] = {".pdf": parse_pdf, ".docx": parse_docx, ".txt": parse_text, ".md": parse_text}


def parse_bytes(data: bytes, filename: str) -> dict:
    suffix = re.search(r"\.[^./\\]*$", filename)
    if not suffix or suffix[0].lower() not in PARSERS:
        raise ParsingError(f"{filename}: no reader for this kind; there are {', '.join(sorted(PARSERS))}")
    return {"path": filename} | PARSERS[suffix[0].lower()](data)


def parse_frame(files: DataFrame) -> DataFrame:
    """(path, content) -> a document a row, or its error."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows.append(parse_bytes(bytes(content or b""), path) | {"error": None})
                except ParsingError as e:
                    rows.append({"path": path, "text": None, "source_format": None, "spans": None, "page_count": None, "page_backgrounds": None, "error": str(e)})
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in ("path", "text", "source_format", "spans", "page_count", "page_backgrounds", "error")]).astype({"page_count": "Int32"})

    return files.select("path", "content").mapInPandas(run, _PARSED)


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"^[a-z][a-z0-9+.-]*:/", uri):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    return pafs.LocalFileSystem(), uri


def write_archives(files: DataFrame, folder: str, most: int = ARCHIVE_FILES) -> int:
    """(path, content) as members of ZIP archives in ``folder``, which every executor reaches; says how many were written.

    Many small files are few large ones this way: a file system and its listing bear thousands of them, not millions. An archive is named by
    its partition and moved into place when it is whole, so a task that runs again writes the same ones over.
    """
    ship(files.sparkSession)
    fs, root = _file_system(folder)
    fs.create_dir(root, recursive=True)  # no task runs over no rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(folder)
        fs.create_dir(root, recursive=True)
        part, n, done, size = TaskContext.get().partitionId(), 0, 0, 0
        held: list[tuple[str, bytes]] = []

        def flush() -> None:
            name = f"{root}/_{uuid.uuid4().hex}"
            with fs.open_output_stream(name, compression=None) as stream, zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED) as archive:
                for path, content in held:
                    archive.writestr(zipfile.ZipInfo(path), content, zipfile.ZIP_DEFLATED)
            fs.move(name, f"{root}/part-{part:05d}-{n:05d}.zip")

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((path, content or b""))
                done, size = done + 1, size + len(held[-1][1])
                if len(held) >= most or size >= ARCHIVE_BYTES:
                    flush()
                    held, n, size = [], n + 1, 0
        if held:
            flush()
        yield pa.record_batch({"n": pa.array([done], pa.int64())})

    return files.select("path", "content").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def archived(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of every member of the ZIP archives in ``folder``."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                held, size = [], 0
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in archive.infolist():
                        if member.is_dir():
                            continue
                        held.append((member.filename, archive.read(member)))
                        size += len(held[-1][1])
                        if len(held) >= ARROW_ROWS or size >= ARROW_BYTES:
                            yield pa.record_batch([pa.array(c) for c in zip(*held, strict=True)], ["path", "content"])
                            held, size = [], 0
                if held:
                    yield pa.record_batch([pa.array(c) for c in zip(*held, strict=True)], ["path", "content"])

    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder)
    return read.select("content").mapInArrow(run, "path string, content binary")


def _split(parsed: DataFrame, skip_errors: bool) -> tuple[DataFrame, DataFrame]:
    failures = parsed.filter("error IS NOT NULL").select("path", "error")
    if not skip_errors and (first := failures.first()):
        raise ParsingError(f"{first.path}: {first.error}")
    return parsed.filter("error IS NULL").drop("error"), failures


def load_files(spark: SparkSession, paths: str | Sequence[str], pattern: str | None = None, skip_errors: bool = True) -> tuple[DataFrame, DataFrame]:
    """(documents, failures) of files or folders; a file that is missing raises."""
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return _split(parse_frame(reader.load(paths if isinstance(paths, str) else list(paths))), skip_errors)


def load_uploads(spark: SparkSession, uploads: Sequence[tuple[str, bytes]], skip_errors: bool = True) -> tuple[DataFrame, DataFrame]:
    """(documents, failures) of files in memory."""
    return _split(parse_frame(spark.createDataFrame(list(uploads), "path string, content binary")), skip_errors)


def stem(path: Column) -> Column:
    """The file's name without folders and suffix: a candidate's id."""
    name = F.regexp_replace(path, r"^.*[/\\]", "")
    return F.coalesce(F.nullif(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.lit("")), F.lit("candidate"))


def looks_scanned(source_format: Column, text: Column, page_count: Column, min_chars: int = _MIN_CHARS) -> Column:
    return (source_format == "pdf") & (F.length(F.coalesce(text, F.lit(""))) < min_chars * F.greatest(F.lit(1), page_count))


def upload_key(files: DataFrame) -> DataFrame:
    """One row: a hash of (name, size) of all files, whatever their order."""
    return files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "name", "size"))), "|").cast("binary"), 256).alias("key"))
