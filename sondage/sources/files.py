"""Files, sidecars and labelled corpora as DataFrames, and the format parsers."""

from __future__ import annotations

import csv
import html.parser
import io
import os
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.errors import InvalidInput
from sondage.sources.pdf import pdf_text

MAX_BYTES = 10 << 20
ARCHIVE_ENTRIES, ARCHIVE_BYTES, ENTRY_BYTES = 10_000, 100 << 20, 10 << 20
TEXT = "md txt go py js ts swift java rs c cpp h json yaml yml toml html htm csv".split()
OFFICE = "pdf docx pptx xlsx odt ods odp".split()
KNOWN_UNSUPPORTED = "doc xls ppt rtf epub odg".split()
SKIPPED_DIRECTORIES = "node_modules dist vendor build target".split()


def extension(path: str = "path"):
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def crawl(spark: SparkSession, directory: str) -> DataFrame:
    """path, modificationTime, length, content, ext of the indexable files below a directory (or of one file)."""
    return indexable(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory), directory)


def indexable(files: DataFrame, directory: str) -> DataFrame:
    """Rows (path, length) of known kinds and sizes outside hidden and build folders below ``directory``, with their ext."""
    skipped = r"/(\.[^/]+|" + "|".join(SKIPPED_DIRECTORIES) + ")/"
    below = F.concat(F.lit("/"), F.regexp_replace("path", "^.*?" + re.escape(directory.rstrip("/")) + "/?", ""))
    return files.where(~below.rlike(skipped) & (F.col("length") <= MAX_BYTES)).withColumn("ext", extension()).where(F.col("ext").isin(*TEXT, *OFFICE))


def one_file(spark: SparkSession, path: str) -> DataFrame:
    """The row of one file, whatever folder it lies in; empty if it's too large or of another kind."""
    found = spark.read.format("binaryFile").load(path)
    return found.where(F.col("length") <= MAX_BYTES).withColumn("ext", extension()).where(F.col("ext").isin(*TEXT, *OFFICE))


def restrict_to(path: str, home: str) -> str:
    """The real path, if it lies in ``home`` with all links followed; else an error."""
    full = os.path.realpath(os.path.expanduser(path))
    root = os.path.realpath(home)
    if os.path.commonpath([full, root]) != root:
        raise InvalidInput(f"{path} lies outside {home}", "only files below the home folder can be indexed")
    return full


def unsupported(files: DataFrame) -> DataFrame:
    """path, message of files of known formats that can't be read."""
    kind = extension()
    return files.where(kind.isin(*KNOWN_UNSUPPORTED)).select("path", F.concat(F.lit("skipped "), F.col("path"), F.lit(": ."), kind, F.lit(" is not supported")).alias("message"))


def collapse(text: str) -> str:
    return re.sub("\n{3,}", "\n\n", text).strip()


class _Page(html.parser.HTMLParser):
    BREAK = frozenset("p div li tr h1 h2 h3 h4 h5 h6".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "head")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in self.BREAK and not self.hidden:
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.hidden and (data.strip() or "\n" not in data):
            self.out.append(data)


def parse_html(data: bytes) -> str:
    page = _Page()
    page.feed(data.decode("utf-8", "replace"))
    page.close()
    return collapse("".join(page.out))


def parse_csv(data: bytes) -> str:
    rows = []
    try:
        for row in csv.reader(io.StringIO(data.decode("utf-8", "replace"), newline=""), strict=True):
            rows.append("\t".join(row))
    except csv.Error:
        pass  # what stands before the first malformed record counts
    return "\n".join(rows).strip()


def _entries(data: bytes, wanted: Callable[[str], bool]) -> Iterator[bytes]:
    archive = zipfile.ZipFile(io.BytesIO(data))
    infos = archive.infolist()
    if len(infos) > ARCHIVE_ENTRIES or sum(i.file_size for i in infos) > ARCHIVE_BYTES:
        raise ValueError("archive is over its limits")
    for info in infos:
        if wanted(info.filename):
            with archive.open(info) as f:
                body = f.read(ENTRY_BYTES + 1)
            if len(body) > ENTRY_BYTES:
                raise ValueError("an archive entry is over its limit")
            yield body


def _walk(data: bytes, on: Callable[[str, str, dict], None]) -> None:
    """Events (start|end|text, local name or text, attributes); malformed XML ends them."""
    parser = expat.ParserCreate()
    local = lambda n: n.rpartition(":")[2]
    parser.StartElementHandler = lambda n, a: on("start", local(n), {local(k): v for k, v in a.items()})
    parser.EndElementHandler = lambda n: on("end", local(n), {})
    parser.CharacterDataHandler = lambda t: on("text", t, {})
    try:
        parser.Parse(data, True)
    except expat.ExpatError:
        pass


def _runs(data: bytes) -> str:
    out: list[str] = []
    inside = [0]

    def on(kind: str, name: str, attrs: dict) -> None:
        if kind == "text":
            if inside[0]:
                out.append(name)
        elif name == "t":
            inside[0] += 1 if kind == "start" else -1
        elif kind == "start":
            out.append({"br": "\n", "cr": "\n", "tab": "\t"}.get(name, ""))
        elif name in ("p", "sp"):
            out.append("\n\n")

    _walk(data, on)
    return collapse("".join(out))


def parse_docx(data: bytes) -> str:
    return "\n".join(map(_runs, _entries(data, lambda n: n == "word/document.xml")))


def parse_pptx(data: bytes) -> str:
    text = "\n".join(map(_runs, _entries(data, lambda n: re.fullmatch(r"ppt/slides/slide[^/]*\.xml", n) is not None)))
    if not text.strip():
        raise ValueError("no text")
    return text


def parse_opendocument(data: bytes) -> str:
    out: list[str] = []
    inside = [0]

    def on(kind: str, name: str, attrs: dict) -> None:
        if kind == "text":
            if inside[0]:
                out.append(name)
        elif name in ("p", "h", "value"):
            inside[0] += 1 if kind == "start" else -1
            if kind == "end":
                out.append("\n\n")
        elif kind == "start" and inside[0]:
            out.append({"tab": "\t", "line-break": "\n", "s": " " * int(attrs.get("c", 1) or 1) if name == "s" else ""}.get(name, ""))

    for body in _entries(data, lambda n: n == "content.xml"):
        _walk(body, on)
    return collapse("".join(out))


def parse_xlsx(data: bytes) -> str:
    shared: list[str] = []
    for body in _entries(data, lambda n: n == "xl/sharedStrings.xml"):
        state = {"t": False}

        def strings(kind: str, name: str, attrs: dict, state=state) -> None:
            if name == "si" and kind == "start":
                shared.append("")
            elif name == "t" and kind != "text":
                state["t"] = kind == "start"
            elif kind == "text" and state["t"] and shared:
                shared[-1] += name

        _walk(body, strings)
    sheets = []
    for body in _entries(data, lambda n: re.fullmatch(r"xl/worksheets/[^/]+\.xml", n) is not None):
        rows: list[str] = []
        cell = {"kind": "", "value": "", "on": False, "row": []}

        def cells(kind: str, name: str, attrs: dict, cell=cell, rows=rows) -> None:
            if kind == "text":
                if cell["on"]:
                    cell["value"] += name
            elif name == "row":
                if kind == "start":
                    cell["row"] = []
                else:
                    rows.append("\t".join(cell["row"]))
            elif name == "c":
                if kind == "start":
                    cell.update(kind=attrs.get("t", ""), value="")
                else:
                    v = cell["value"]
                    if cell["kind"] == "s":
                        v = shared[int(v)] if v.strip().isdigit() and int(v) < len(shared) else ""
                    cell["row"].append(v)
            elif name in ("v", "t"):
                cell["on"] = kind == "start"

        _walk(body, cells)
        sheets.append("\n".join(rows))
    return "\n".join(sheets).strip()


def parse_text(data: bytes) -> str:
    return data.decode("utf-8", "replace")


PARSERS: dict[str, Callable[[bytes], str]] = {
    "html": parse_html, "htm": parse_html, "csv": parse_csv, "docx": parse_docx, "pptx": parse_pptx, "xlsx": parse_xlsx,
    "odt": parse_opendocument, "ods": parse_opendocument, "odp": parse_opendocument, "pdf": pdf_text,
}


def parse(files: DataFrame) -> DataFrame:
    """path, hash of the bytes, content, error (null or the reason why a file has no content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for ext, data in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                try:
                    texts.append(PARSERS.get(ext, parse_text)(data or b""))
                    errors.append(None)
                except Exception as e:  # a bad file is reported and never ends the job
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["path", "hash", "content", "error"])

    return files.select("path", F.sha2("content", 256).alias("hash"), extension().alias("ext"), "content").mapInArrow(run, "path string, hash string, content string, error string")


SIDECAR = "field string, type string, value string, matched boolean, span struct<start:int,end:int,snippet:string>"


def sidecar(spark: SparkSession, path: str) -> DataFrame:
    """Grounded extractions of a JSON-lines file; the first bad line ends the read."""
    return sidecar_rows(spark.read.text(path))


def sidecar_rows(lines: DataFrame) -> DataFrame:
    """``sidecar`` of lines (value); blank lines are passed over."""
    row = F.from_json("value", SIDECAR, {"mode": "FAILFAST"}).alias("x")
    rows = lines.where(F.trim("value") != "").select(row).select("x.*")
    kind = F.coalesce(F.nullif("field", F.lit("")), "type")
    return rows.select(kind.alias("class"), "value", F.col("span.snippet").alias("evidence_text"), F.col("span.start").alias("span_start"), F.col("span.end").alias("span_end"), F.coalesce("matched", F.lit(False)).alias("matched"))


def text_source(spark: SparkSession, source: str, text: str) -> DataFrame:
    """One document from standard input or a fetched page."""
    if not text.strip():
        raise ValueError("empty input")
    return spark.createDataFrame([(source, text)], "path string, content string").withColumn("hash", F.sha2("content", 256))


def labelled_corpus(spark: SparkSession, directory: str) -> DataFrame:
    """doc (file stem), content of a folder of .txt files."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.txt").text(directory)
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("doc"), F.col("value").alias("content"))
