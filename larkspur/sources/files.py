"""Document files as layout elements, and files of questions."""

from __future__ import annotations

import io
import os
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.sources import pdf as pdf_file

See = Callable[[bytes, str], str]

TYPES = {".pdf": "pdf", ".docx": "docx", ".pptx": "pptx"}
ELEMENT = "doc_id string, ord int, text string, element_type string, heading_level int, page int, style string, paragraph_index int, slide int, shape_index int, is_title boolean, font_size double, font string, error string"
_COLUMNS = [c.split()[0] for c in ELEMENT.split(", ")]
_ARROW = pa.schema([(c, {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}[t]) for c, t in (x.split() for x in ELEMENT.split(", "))])

#: Bytes that a picture in DOCX and PPTX files has at least to be described.
LEAST_PICTURE = 1000

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"


def file_type(name):
    """Type of a file by its suffix; null for unsupported ones."""
    kind = F.lit(None).cast("string")
    for suffix, t in TYPES.items():
        kind = F.when(T.file_extension(name) == suffix, t).otherwise(kind)
    return kind


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """Supported files of one folder, not of its subfolders: path, file_name, file_type, length, content.

    A missing folder or one without such files gives no rows. Content is read only by plans that use it.
    """
    schema = "path string, file_name string, file_type string, length long, content binary"
    local = folder.removeprefix("file://")
    if "://" not in folder and not os.path.isdir(local) or folder.startswith("file://") and not os.path.isdir(local):
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("file_name"), file_type(name).alias("file_type"), "length", "content").where(F.col("file_type").isNotNull())


def _related(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Targets of the relations of a part, by their ids."""
    folder, name = part.rsplit("/", 1)
    try:
        rows = ElementTree.fromstring(z.read(f"{folder}/_rels/{name}.rels"))
    except KeyError:
        return {}
    return {r.get("Id"): posixpath.normpath(t[1:] if (t := r.get("Target", "")).startswith("/") else posixpath.join(folder, t)) for r in rows}


def _pictures(z: zipfile.ZipFile, of: dict[str, str], node: ElementTree.Element) -> Iterator[bytes]:
    """Pictures that a node shows, but for small ones."""
    for blip in node.iter(f"{_A}blip"):
        target = of.get(next((v for k, v in blip.attrib.items() if k.endswith("embed")), ""))
        if target in z.NameToInfo and len(content := z.read(target)) >= LEAST_PICTURE:
            yield content


def docx_elements(content: bytes, see: See | None = None) -> list[dict]:
    """Paragraphs of a document's body (tables are left out) with heading levels from their styles, and its pictures."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        styles = ElementTree.fromstring(z.read("word/styles.xml")) if "word/styles.xml" in z.NameToInfo else ()
        names = {x.get(f"{_W}styleId"): n.get(f"{_W}val") for x in styles if (n := x.find(f"{_W}name")) is not None}
        of = _related(z, "word/document.xml")
        out: list[dict] = []
        for i, p in enumerate((p for p in (body if body is not None else ()) if p.tag == f"{_W}p"), 1):
            text = "".join("\t" if t.tag == f"{_W}tab" else "\n" if t.tag in (f"{_W}br", f"{_W}cr") else t.text or "" for t in p.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br", f"{_W}cr")).strip()
            s = p.find(f"{_W}pPr/{_W}pStyle")
            style = names.get(s.get(f"{_W}val"), s.get(f"{_W}val")) if s is not None else None
            m = re.fullmatch(r"heading\s*(\S*).*", style or "", re.I)
            head = m is not None or (style or "").lower() in ("title", "subtitle")
            level = (int(m[1]) if m[1].isdigit() else None) if m else 1 if head else None
            if text:
                out.append({"text": text, "element_type": "heading" if head else "paragraph", "heading_level": level, "style": style, "paragraph_index": i})
            for picture in _pictures(z, of, p) if see else ():
                if told := see(picture, "\n".join(e["text"] for e in out[-3:])):
                    out.append({"text": told, "element_type": "paragraph", "paragraph_index": i})
    return out


def _slides(z: zipfile.ZipFile) -> list[str]:
    """The parts of the slides in the order of the presentation, or of their numbers where it names none."""
    names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    if "ppt/presentation.xml" not in z.NameToInfo:
        return names
    of = _related(z, "ppt/presentation.xml")
    shown = [of.get(next((v for k, v in s.attrib.items() if k.endswith("}id")), "")) for s in ElementTree.fromstring(z.read("ppt/presentation.xml")).iter(f"{_P}sldId")]
    return [n for n in shown if n in z.NameToInfo] or names


def pptx_elements(content: bytes, see: See | None = None) -> list[dict]:
    """One element for each text shape and large picture of each slide; title placeholders are headings of level 1.

    Shapes inside groups belong to the group, which has no text of its own.
    """
    out: list[dict] = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for no, name in enumerate(_slides(z), 1):
            slide, of, said = ElementTree.fromstring(z.read(name)), _related(z, name), []
            tree = slide.find(f".//{_P}spTree")
            shapes = [s for s in (slide if tree is None else tree) if s.tag in {f"{_P}{t}" for t in ("sp", "pic", "graphicFrame", "grpSp", "cxnSp")}]
            for i, shape in enumerate(shapes, 1):
                if shape.tag == f"{_P}pic":
                    for picture in _pictures(z, of, shape) if see else ():
                        if told := see(picture, "\n".join(said)):
                            said.append(told)
                            out.append({"text": told, "element_type": "paragraph", "page": no, "slide": no, "shape_index": i})
                    continue
                lines = ["".join(t.text or "" for t in p.iter(f"{_A}t")) for p in shape.iter(f"{_A}p")] if shape.tag == f"{_P}sp" else []
                text = "\n".join(lines).strip()
                if not text:
                    continue
                said.append(text)
                ph = shape.find(f"{_P}nvSpPr/{_P}nvPr/{_P}ph")
                title = ph is not None and ph.get("type") in ("title", "ctrTitle")
                sizes = [int(r.get("sz")) / 100 for r in shape.iter(f"{_A}rPr") if r.get("sz")]
                out.append({"text": text, "element_type": "heading" if title else "paragraph", "heading_level": 1 if title else None, "page": no, "slide": no, "shape_index": i, "is_title": title, "font_size": max(sizes, default=None)})
    return out


def elements(files: DataFrame, pdf: Callable[[bytes, See | None], list[dict]] = pdf_file.elements, see: See | None = None) -> DataFrame:
    """Layout elements of files (doc_id, file_type, content); one file is parsed by one call and comes out as one batch.

    A file that can't be read or holds no text gives one row with ``error`` and nothing else, so that one bad file
    doesn't end the run. ``see`` describes pictures (bytes and the text before them) as an element's text.
    """
    readers = {"docx": docx_elements, "pptx": pptx_elements, "pdf": pdf}

    def read(kind: str | None, content: bytes | None) -> tuple[list[dict], str | None]:
        if kind not in readers:
            return [], f"no reader for files of type {kind}"
        try:
            found = readers[kind](content or b"", see)
        except Exception as e:  # whatever a damaged file leads to
            return [], f"{type(e).__name__}: {e}"
        return found, None if found else "no text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, kind, content in zip(b["doc_id"].to_pylist(), b["file_type"].to_pylist(), b["content"]):
                found, error = read(kind, content.as_py())
                rows = [{**dict.fromkeys(_COLUMNS), "doc_id": doc, "ord": i, **e} for i, e in enumerate(found or [{"error": error}])]
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return files.select("doc_id", "file_type", "content").mapInArrow(run, ELEMENT)


def full_text(parts: DataFrame) -> DataFrame:
    """Text of each document from its elements: lines of a slide or page by line ends, slides and pages by blank lines."""
    part = F.coalesce("slide", "page")
    listed = parts.where("text is not null").groupBy("doc_id", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("e"))
    joined = listed.select("doc_id", "part", F.concat_ws("\n", F.transform("e", lambda x: x["text"])).alias("text")).where("text <> ''")
    return joined.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("part", "text"))).alias("s")).select("doc_id", F.concat_ws("\n\n", F.transform("s", lambda x: x["text"])).alias("text"))


CASE = "id string, input string, expected_output string, source_documents array<string>, source_url string"


def text_questions(lines: DataFrame) -> DataFrame:
    """``lines``: line_no (from 1), value. Questions of a plain file: one a line, blank ones and comments skipped."""
    kept = lines.where((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    return kept.select(F.format_string("case-%d", F.col("line_no")).alias("id"), F.trim("value").alias("input"), F.lit(None).cast("string").alias("expected_output"), F.lit(None).cast("array<string>").alias("source_documents"), F.lit(None).cast("string").alias("source_url"))


def json_questions(lines: DataFrame) -> DataFrame:
    """``lines``: line_no, value. Cases of a file of JSON objects, blank lines and comments skipped.

    A line that isn't an object with a text ``input``, or whose expected_output is no text or source_documents no list of
    texts, is an error.
    """
    kept = lines.where((F.trim("value") != "") & ~F.startswith(F.ltrim("value"), F.lit("#")))
    whole = F.try_parse_json("value")
    kind = lambda f: F.schema_of_variant(F.try_variant_get(whole, f"$.{f}", "variant"))
    fits = lambda f, *kinds: F.coalesce(kind(f).isin(*kinds), F.lit(True))
    row = F.from_json("value", CASE)
    good = F.coalesce(kind("input") == "STRING", F.lit(False)) & (F.trim(row["input"]) != "") & fits("expected_output", "STRING") & fits("source_documents", "ARRAY<STRING>", "ARRAY<VOID>")
    refused = F.from_json(F.raise_error(F.format_string("line %d is no valid case", F.col("line_no"))).cast("string"), CASE)
    cases = kept.select("line_no", F.when(good, row).otherwise(refused).alias("c"))
    return cases.select(F.coalesce("c.id", F.format_string("case-%d", F.col("line_no"))).alias("id"), F.trim("c.input").alias("input"), "c.expected_output", "c.source_documents", "c.source_url")


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a question file: JSON objects in a .jsonl file, else one question a line. A file without any is an error."""
    lines = numbered_lines(spark, path)
    cases = json_questions(lines) if path.lower().endswith(".jsonl") else text_questions(lines)
    if cases.isEmpty():
        raise ValueError(f"{path} holds no question")
    return cases


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one small file with their physical numbers."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("i", "value")).select((F.col("i") + 1).alias("line_no"), "value")
