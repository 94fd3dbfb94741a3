"""Office files, PDF and media through ``binaryFile``, with stdlib parsers and optional hooks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

Part = tuple[str, dict[str, str]]


def _number(name: str) -> int:
    return int(re.search(r"(\d+)\.xml$", name)[1])


def docx_parts(data: bytes) -> list[Part]:
    """Paragraphs that are not blank, then table rows with their cells between bars."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    text = lambda p: "".join(t.text or "" for t in p.iter(f"{_W}t")).strip()
    paragraphs = body.findall(f"{_W}p")
    rows = []
    for row in body.iter(f"{_W}tr"):
        cells = [c for c in ("\n".join(text(p) for p in cell.iter(f"{_W}p")).strip() for cell in row.findall(f"{_W}tc")) if c]
        if cells:
            rows.append(" | ".join(cells))
    return [("\n".join([t for t in map(text, paragraphs) if t] + rows), {"file_type": "docx", "paragraph_count": str(len(paragraphs))})]


def pptx_parts(data: bytes) -> list[Part]:
    """One part a slide, blank ones too; notes at the end."""
    z = zipfile.ZipFile(io.BytesIO(data))
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=_number)

    def texts(name: str, body_only: bool) -> list[str]:
        out = []
        for shape in ElementTree.fromstring(z.read(name)).iter(f"{_P}sp"):
            kind = shape.find(f".//{_P}ph")
            if body_only and (kind is None or kind.get("type") != "body"):
                continue
            lines = ["".join(t.text or "" for t in p.iter(f"{_A}t")) for p in shape.iter(f"{_A}p")]
            if (t := "\n".join(lines).strip()):
                out.append(t)
        return out

    parts = []
    for i, name in enumerate(slides, 1):
        notes = f"ppt/notesSlides/notesSlide{_number(name)}.xml"
        said = "\n".join(texts(notes, True)) if notes in z.namelist() else ""
        parts.append(("\n".join(texts(name, False) + ([f"[Notes] {said}"] if said else [])), {"file_type": "pptx", "slide_number": str(i), "total_slides": str(len(slides)), "has_notes": str(bool(said)).lower()}))
    return parts


def xlsx_parts(data: bytes) -> list[Part]:
    """One part a sheet with rows: its name, its columns, and ``header: value`` lines."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
        target = targets[sheet.get(f"{_R}id")].lstrip("/")
        tree = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
        rows = []
        for row in tree.iter(f"{_S}row"):
            cells: dict[int, str] = {}
            for at, c in enumerate(row.findall(f"{_S}c")):
                letters = re.match(r"[A-Z]+", c.get("r") or "")
                place = at if not letters else sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters[0]))) - 1
                v, inline = c.find(f"{_S}v"), c.find(f"{_S}is")
                raw = "".join(t.text or "" for t in inline.iter(f"{_S}t")) if inline is not None else (v.text or "") if v is not None else ""
                cells[place] = shared[int(raw)] if c.get("t") == "s" and raw else raw
            rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
        if not rows:
            continue
        head, *body = rows
        lines = [f"Sheet: {sheet.get('name')}", f"Columns: {' | '.join(head)}"]
        lines += [" | ".join(f"{h}: {r[i] if i < len(r) else ''}" for i, h in enumerate(head)) for r in body]
        out.append(("\n".join(lines), {"file_type": "xlsx", "sheet_name": sheet.get("name"), "row_count": str(len(body)), "column_count": str(len(head)), "modality": "table"}))
    return out


def pdf_parts(data: bytes) -> list[Part]:
    """One part a page with text, pages from 1; the bytes as text where no PDF parser is installed or they are no PDF."""
    try:
        import pypdf
    except ImportError:
        pypdf = None
    if pypdf is not None and data[:5] == b"%PDF-":
        pages = pypdf.PdfReader(io.BytesIO(data)).pages
        return [(t, {"file_type": "pdf", "page_number": str(i), "total_pages": str(len(pages))}) for i, p in enumerate(pages, 1) if (t := (p.extract_text() or "").strip())]
    return [(data.decode("utf-8", "replace"), {"file_type": "txt", "page_number": "1", "total_pages": "1", "fallback": "true"})]


def media_parts(label: str, describe: Callable[[bytes], str] | None = None) -> Callable[[bytes, str], list[Part]]:
    """Text from a recogniser hook, or a placeholder with the file's name."""

    def parts(data: bytes, name: str) -> list[Part]:
        text = (describe(data) if describe else "").strip()
        return [(text or f"[{label}: {name}]", {"modality": label.lower(), "has_text": str(bool(text)).lower()})]

    return parts


PARSERS: dict[str, Callable[[bytes], list[Part]]] = {"docx": docx_parts, "pptx": pptx_parts, "excel": xlsx_parts, "pdf": pdf_parts}


def parsed(files: DataFrame, parser: Callable, named: bool = False) -> DataFrame:
    """(source, part, text, meta, error) of (path, content) rows; a file that cannot be parsed gives one row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    got = parser(data, path.rsplit("/", 1)[-1]) if named else parser(data)
                    rows += [(path, i, text, list(meta.items()), None) for i, (text, meta) in enumerate(got)]
                except Exception as e:  # noqa: BLE001 - kept as data, so that one bad file fails no job
                    rows.append((path, 0, None, [], f"{type(e).__name__}: {e}"[:200]))
            types = [pa.string(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["source", "part", "text", "meta", "error"])

    return files.select("path", "content").mapInArrow(run, "source string, part int, text string, meta map<string,string>, error string")


def read_binary(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(path)


def assets(files: DataFrame) -> DataFrame:
    """An asset row a file: stable id, name, size; pictures stay in the store, by path."""
    return files.select(F.substring(F.sha2("path", 256), 1, 32).alias("asset_id"), F.col("path").alias("file_path"), F.element_at(F.split("path", "/"), -1).alias("original_name"), F.col("length").alias("size"))
