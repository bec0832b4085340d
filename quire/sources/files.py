"""Sources and sinks of the pipeline as Spark readers: JSON lines, office files, workbooks, matrices, state, JDBC."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The kinds of files that hold documents and workbooks.
DOCUMENTS, WORKBOOKS = ("pptx", "ppt", "pdf", "docx", "doc"), ("xlsx", "xlsm")
_A, _W, _S = (f"{{http://schemas.openxmlformats.org/{p}/2006/main}}" for p in ("drawingml", "wordprocessingml", "spreadsheetml"))
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def read_json_lines(spark: SparkSession, path: str, schema: StructType, strict: bool = True) -> DataFrame:
    """JSON lines of a fixed schema; blank lines are skipped, broken ones raise or, if not strict, are left out."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def _swap(spark: SparkSession, fresh: str, path: str) -> None:
    """Gives what was written under ``fresh`` the name ``path``; what stood there goes only then."""
    jvm = spark._jvm.org.apache.hadoop.fs
    new, place, old = jvm.Path(fresh), jvm.Path(path), jvm.Path(f"{path}._old")
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if fs.exists(place) and not fs.rename(place, old) or not fs.rename(new, place):
        raise OSError(f"{fresh} could not take the name {path}")
    fs.delete(old, True)


def write_json_lines(df: DataFrame, path: str) -> None:
    """JSON lines, written whole before they take the place of those that were there."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(f"{path}._writing")
    _swap(df.sparkSession, f"{path}._writing", path)


def files(spark: SparkSession, folder: str, kinds: tuple[str, ...]) -> DataFrame:
    """``(path, name, kind, length, modificationTime, content)`` of the files below a folder, without temporary ones."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    named = found.withColumn("name", name).withColumn("kind", F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)))
    return named.where(F.col("kind").isin(*kinds) & ~F.col("name").startswith("~$"))


def first_workbooks(found: DataFrame) -> DataFrame:
    """``(directory, path)``: the first workbook of each directory."""
    return found.groupBy(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("directory")).agg(F.min("path").alias("path"))


def file_signatures(found: DataFrame) -> DataFrame:
    return found.select("path", F.struct(F.col("length").alias("size"), F.unix_micros("modificationTime").alias("mtime")).alias("signature"))


def slide_texts(data: bytes) -> list[tuple[str, str]]:
    """``(page, text)`` of a PPTX: slides by number, counted from 1, their texts a line each."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        return [(str(k), "\n".join(t.text.strip() for t in ElementTree.fromstring(z.read(n)).iter(f"{_A}t") if t.text and t.text.strip())) for k, (_, n) in enumerate(slides, 1)]


def section_texts(data: bytes) -> list[tuple[str, str]]:
    """``(page, text)`` of a DOCX: a heading, or a short line with bold words, opens a section."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    sections: list[list[str]] = [[]]
    for p in body.iter(f"{_W}p"):
        text = "".join(t.text or "" for t in p.iter(f"{_W}t")).strip()
        if not text:
            continue
        style = p.find(f"{_W}pPr/{_W}pStyle")
        heading = style is not None and style.get(f"{_W}val", "").startswith("Heading")
        bold = len(text) < 100 and any(r.find(f"{_W}rPr/{_W}b") is not None for r in p.iter(f"{_W}r"))
        if (heading or bold) and sections[-1]:
            sections.append([])
        sections[-1].append(text)
    return [(str(k), "\n".join(s)) for k, s in enumerate((s for s in sections if s), 1)]


def sheet_rows(data: bytes) -> list[tuple[int, str, int, list[str]]]:
    """``(sheet, name, row, cells)`` of a workbook, sheets in order, rows numbered as in the sheet."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        strings = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for k, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")):
            target = targets[sheet.get(f"{_R}id")]
            for row in ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")).iter(f"{_S}row"):
                cells: list[str] = []
                for c in row.iter(f"{_S}c"):
                    at = 0
                    for ch in re.match(r"[A-Z]+", c.get("r", "A"))[0]:
                        at = at * 26 + ord(ch) - 64
                    value = c.find(f"{_S}v")
                    text = "".join(t.text or "" for t in c.iter(f"{_S}t")) if c.get("t") == "inlineStr" else "" if value is None else value.text or ""
                    cells += [""] * (at - len(cells))
                    cells[at - 1] = strings[int(text)] if c.get("t") == "s" and text else text
                out.append((k, sheet.get("name", ""), int(row.get("r", 0)), cells))
    return out


def _shape_text(shape: ElementTree.Element) -> str:
    return "\n".join(t for p in shape.iter(f"{_A}p") if (t := "".join(r.text or "" for r in p.iter(f"{_A}t")).strip()))


def slide_parts(data: bytes) -> list[tuple[int, str, int, list[list[str]], str]]:
    """``(page, kind, number, cells, text)`` of a PPTX: the tables of each slide, or, where it has none, its text blocks from top to bottom."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for page, (_, name) in enumerate(slides, 1):
            root = ElementTree.fromstring(z.read(name))
            tables = [[[_shape_text(c) for c in row.iter(f"{_A}tc")] for row in t.iter(f"{_A}tr")] for t in root.iter(f"{_A}tbl")]
            out += [(page, "table", k, cells, "") for k, cells in enumerate(tables, 1)]
            blocks = []
            for shape in () if tables else root.iter(f"{_P}sp"):
                text, off, ext = _shape_text(shape), shape.find(f".//{_A}off"), shape.find(f".//{_A}ext")
                number = lambda e, key: int(e.get(key, 0)) if e is not None else 0
                if text:
                    blocks.append((number(off, "y"), number(off, "x"), number(ext, "cx"), number(ext, "cy"), text))
            lines = [f"left={x} top={y} width={w} height={h} text={text}" for y, x, w, h, text in sorted(blocks, key=lambda b: b[:2])]
            if lines:
                out.append((page, "layout", 1, [], "\n".join(lines)))
    return out


def presentation_tables(found: DataFrame) -> DataFrame:
    """``(path, page_no, kind, number, cells, text)`` of PPTX files; a file that can't be read gives nothing."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, data in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    rows += [(path, *part) for part in slide_parts(data)]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError):
                    continue
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.list_(pa.string())), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["path", "page_no", "kind", "number", "cells", "text"])

    return found.where("kind = 'pptx'").select("path", "content").mapInArrow(read, "path string, page_no int, kind string, number int, cells array<array<string>>, text string")


def image_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from the head of a PNG or JPEG."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 < len(data):
        if data[at] != 0xFF:
            return None
        if 0xC0 <= data[at + 1] <= 0xCF and data[at + 1] not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


def image_sizes(found: DataFrame) -> DataFrame:
    """``(path, width, height)`` of image files; null where the head tells none."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [image_size(b or b"") or (None, None) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([s[k] for s in sizes], pa.int32()) for k in range(2))], names=["path", "width", "height"])

    return found.select("path", "content").mapInArrow(read, "path string, width int, height int")


def write_markdown(df: DataFrame, path: str) -> None:
    """A Markdown file per ``(name, text)``, each in a folder of its name."""
    df.select(F.col("text").alias("value"), "name").write.mode("overwrite").partitionBy("name").option("lineSep", "\n").text(path)


def document_pages(found: DataFrame) -> DataFrame:
    """``(path, page_no, text, error)``: the pages of PPTX and DOCX files; a file that can't be read gives one row with its error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path, kind, data in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    pages = slide_texts(data) if kind == "pptx" else section_texts(data) if kind == "docx" else None
                    out += [(path, p, t, None) for p, t in pages or []] or [(path, "1", "", None if pages is not None else f"no reader for {kind}")]
                except Exception as e:  # one broken file must not end the job
                    out.append((path, "1", "", str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in range(4)], names=["path", "page_no", "text", "error"])

    return found.select("path", "kind", "content").mapInArrow(read, "path string, page_no string, text string, error string")


def workbook_rows(found: DataFrame, name: str | None = None, least: int = 0) -> DataFrame:
    """``(path, sheet, sheet_name, row_index, cells)`` of workbooks without their header row and rows whose first cell is empty.

    Of one sheet only where its ``name`` is given. A workbook of less than ``least`` sheets is an error.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, data in zip(*(c.to_pylist() for c in batch.columns)):
                own = sheet_rows(data)
                if len({k for k, *_ in own}) < least:
                    raise ValueError(f"{path} has less than {least} sheets")
                rows += [(path, k, n, r, cells) for k, n, r, cells in own if r > 1 and cells and cells[0].strip() and name in (None, n)]
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["path", "sheet", "sheet_name", "row_index", "cells"])

    return found.select("path", "content").mapInArrow(read, "path string, sheet int, sheet_name string, row_index int, cells array<string>")


def matrix_rows(found: DataFrame) -> DataFrame:
    """``(path, row, embedding)`` of ``.npy`` matrices, each row of length 1; a zero row stays zero."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(*(c.to_pylist() for c in batch.columns)):
                m = np.load(io.BytesIO(data)).astype(np.float32)
                norm = np.linalg.norm(m, axis=1, keepdims=True)
                m = m / np.where(norm == 0, 1, norm)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(m)), pa.array(np.arange(len(m), dtype=np.int32)), pa.array(list(m), pa.list_(pa.float32()))], names=["path", "row", "embedding"])

    return found.select("path", "content").mapInArrow(read, "path string, row int, embedding array<float>")


def _decoded(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("gbk", "replace")


def text_files(found: DataFrame) -> DataFrame:
    """``(path, text)``: as UTF-8 where the bytes are valid, else as GBK, which Spark's own decoder doesn't know."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_decoded(b or b"") for b in batch.column(1).to_pylist()], pa.string())], names=["path", "text"])

    return found.select("path", "content").mapInArrow(read, "path string, text string")


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The whole versions of a state table, in order."""
    jvm = spark._jvm.org.apache.hadoop.fs
    root = jvm.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(root))
    return sorted(int(n[2:]) for n in names if re.fullmatch(r"v=\d+", n) and fs.exists(jvm.Path(f"{path}/{n}/_SUCCESS")))


def read_state(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The last whole version of a state table; an empty table where none was written yet. A version that can't be read is an error."""
    versions = _versions(spark, path)
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").parquet(f"{path}/v={versions[-1]}")


def write_state(df: DataFrame, path: str, version: int, keep: int = 2) -> None:
    """A new version of a table beside the old ones, of which the last ``keep`` stay.

    It is written under a name that no reader follows and takes its own by one rename, once whole: a job that ends in
    between leaves the version before. Writing a version that is there already is an error.
    """
    spark = df.sparkSession
    jvm = spark._jvm.org.apache.hadoop.fs
    fresh, place = jvm.Path(f"{path}/_writing-{version}"), jvm.Path(f"{path}/v={version}")
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(place):
        raise FileExistsError(f"{path} has a version {version}")
    df.write.mode("overwrite").parquet(fresh.toString())
    if not fs.rename(fresh, place):
        raise OSError(f"{fresh} could not take the name {place}")
    for old in _versions(spark, path)[:-keep]:
        fs.delete(jvm.Path(f"{path}/v={old}"), True)


def read_jdbc(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A database table in ranges of its key, so that tasks read it side by side."""
    return spark.read.jdbc(url, name, column=key, lowerBound=low, upperBound=high, numPartitions=parts)


def resolved_files(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """``(wanted_id, path)``: of each wanted id's candidate names, the first that exists. ``wanted (wanted_id, candidates)``."""
    options = wanted.select("wanted_id", F.posexplode("candidates").alias("priority", "name"))
    hits = options.join(found.groupBy("name").agg(F.min("path").alias("path")), "name")
    first = F.row_number().over(Window.partitionBy("wanted_id").orderBy("priority"))
    return hits.withColumn("n", first).where("n = 1").select("wanted_id", "path")


def manifest(df: DataFrame, key: str) -> str:
    """Counts of an index as JSON."""
    return json.dumps(df.agg(F.count("*").alias("rows"), F.countDistinct(key).alias("ids")).first().asDict(), ensure_ascii=False)
