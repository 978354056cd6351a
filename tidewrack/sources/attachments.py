"""Text of attachments: a registry of extractors by file type over binaryFile rows."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def docx_text(data: bytes) -> str:
    """Paragraphs of a DOCX file, one a line."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as file:
        root = ElementTree.fromstring(file.read("word/document.xml"))
    return "\n".join(t for p in root.iter(f"{space}p") if (t := "".join(x.text or "" for x in p.iter(f"{space}t"))))


def xlsx_text(data: bytes) -> str:
    """Cells of an XLSX file, tabs between them and a line for each row, sheets in order."""
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as file:
        names = file.namelist()
        shared = [] if "xl/sharedStrings.xml" not in names else ["".join(t.text or "" for t in s.iter(f"{space}t")) for s in ElementTree.fromstring(file.read("xl/sharedStrings.xml")).iter(f"{space}si")]
        lines = []
        for name in sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n))):
            for row in ElementTree.fromstring(file.read(name)).iter(f"{space}row"):
                cells = []
                for c in row.iter(f"{space}c"):
                    value = c.find(f"{space}v")
                    if c.get("t") == "s" and value is not None:
                        cells.append(shared[int(value.text or 0)])
                    elif c.get("t") == "inlineStr":
                        cells.append("".join(t.text or "" for t in c.iter(f"{space}t")))
                    elif value is not None:
                        cells.append(value.text or "")
                if cells:
                    lines.append("\t".join(cells))
    return "\n".join(lines)


def pdf_text(data: bytes) -> str:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("PDF text needs the library pypdf, which isn't installed") from e
    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages)


#: Extractors by type; further ones are added here. doc and xls have none: their rows carry metadata only.
EXTRACTORS: dict[str, Callable[[bytes], str]] = {"docx": docx_text, "xlsx": xlsx_text, "pdf": pdf_text}


def extracted(files: DataFrame) -> DataFrame:
    """path, doc_type, length, attachment_text, problem of binaryFile rows; what can't be read has no text and says why."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, data in zip(batch["path"], batch["content"], strict=True):
                kind = path.rsplit(".", 1)[-1].lower()
                text, problem = None, None
                if kind not in EXTRACTORS:
                    problem = f"no extractor for {kind}"
                else:
                    try:
                        text = EXTRACTORS[kind](bytes(data))
                    except Exception as e:  # one broken file must not end the job
                        problem = f"{type(e).__name__}: {e}"
                rows.append((path, kind, len(data), text, problem))
            yield pd.DataFrame(rows, columns=["path", "doc_type", "length", "attachment_text", "problem"])

    return files.select("path", "content").mapInPandas(run, "path string, doc_type string, length long, attachment_text string, problem string")


def read_attachments(spark: SparkSession, folder: str) -> DataFrame:
    return extracted(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder))
