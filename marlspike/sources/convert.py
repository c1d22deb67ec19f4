"""Files of other formats to Markdown: a table of bytes in, a table of texts out, converted in Arrow batches.

Each converter is a small function of a file's bytes; formats that need outside tools (PDF text, OCR) take a function
from the caller. A file that can't be converted has a null text and the reason.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse
from ..functions import text as cleaning
from ..functions.text import clean_knowledge

TEXT_EXTENSIONS = ("md", "txt", "markdown", "rst", "asciidoc", "adoc", "json", "yaml", "yml", "toml", "csv", "tsv", "xml", "ini", "cfg", "conf", "properties", "env", "sh", "bash", "zsh", "fish", "ps1", "bat", "cmd", "log", "sql", "graphql", "proto")
Converter = Callable[[bytes], str]


class _Page(HTMLParser):
    """Title, and the text nodes of the body (scripts and styles included, as they are text nodes there)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.body, self.stack = "", [], []

    def handle_starttag(self, tag, attrs):
        if tag not in ("br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"):
            self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass

    def handle_data(self, data):
        if "title" in self.stack and "body" not in self.stack:
            self.title += data
        elif "body" in self.stack or "head" not in self.stack:
            self.body.append(data)


def html(data: bytes) -> str:
    page = _Page()
    page.feed(data.decode("utf-8", "replace"))
    page.close()
    body = " ".join(page.body).strip()
    return f"# {page.title.strip()}\n\n{body}" if page.title.strip() else body


def _visible(data: bytes) -> str:
    """Text outside of tags, scripts and styles."""
    page = _Page()
    page.feed(re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", " ", data.decode("utf-8", "replace")))
    page.close()
    return re.sub(r"\s+", " ", " ".join(page.body)).strip()


def _local(node: ElementTree.Element) -> str:
    return node.tag.rpartition("}")[2]


def _attribute(node: ElementTree.Element, name: str) -> str:
    return next((v for k, v in node.attrib.items() if k.rpartition("}")[2] == name), "")


def _all_text(node: ElementTree.Element, names: tuple[str, ...]) -> list[str]:
    return [n.text or "" for n in node.iter() if _local(n) in names]


def pipe_table(rows: list[list[str]]) -> str:
    """A Markdown table; the first row is its head, short rows are filled up."""
    width = max((len(r) for r in rows), default=0)
    full = [[c.replace("|", "\\|").replace("\n", " ") for c in r] + [""] * (width - len(r)) for r in rows]
    lines = [f"| {' | '.join(r)} |" for r in full]
    return "\n".join([lines[0], f"|{' --- |' * width}", *lines[1:]]) if lines else ""


def docx(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = next(n for n in ElementTree.fromstring(z.read("word/document.xml")) if _local(n) == "body")
    out = []
    for node in body:
        if _local(node) == "p":
            style = next((_attribute(n, "val") for n in node.iter() if _local(n) == "pStyle"), "")
            level = re.fullmatch(r"[Hh]eading\s?(\d+)", style)
            said = "".join(_all_text(node, ("t",)))
            images = [f"![{_attribute(n, 'name')}]()" for n in node.iter() if _local(n) == "docPr" and _attribute(n, "name")]
            text = (f"{'#' * min(int(level[1]), 6)} " if level and said else "") + " ".join([said, *images]).strip()
            out += [text] if text else []
        elif _local(node) == "tbl":
            rows = [["".join(_all_text(cell, ("t",))) for cell in row if _local(cell) == "tc"] for row in node if _local(row) == "tr"]
            out += [pipe_table(rows)] if rows else []
    return "\n\n".join(out)


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _number(value: str) -> str:
    """Whole numbers without decimals."""
    try:
        n = float(value)
    except ValueError:
        return value
    return str(int(n)) if n == int(n) and abs(n) < 1e15 else value


def xlsx(data: bytes) -> str:
    """One table per sheet; sheets with equal heads become one table with a column for the sheet."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = ["".join(_all_text(s, ("t",))) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        targets = {_attribute(r, "Id"): _attribute(r, "Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = []
        for sheet in (n for n in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(n) == "sheet"):
            path = "xl/" + targets[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))].removeprefix("/xl/")
            sheets.append((_attribute(sheet, "name"), _sheet_rows(ElementTree.fromstring(z.read(path)), shared)))
    sheets = [(name, rows) for name, rows in sheets if rows]
    if len(sheets) > 1 and all(rows[0] == sheets[0][1][0] for _, rows in sheets):
        return pipe_table([["Sheet", *sheets[0][1][0]], *([name, *row] for name, rows in sheets for row in rows[1:])])
    return "\n\n".join(f"## {name}\n\n{pipe_table(rows)}" for name, rows in sheets)


def _sheet_rows(root: ElementTree.Element, shared: list[str]) -> list[list[str]]:
    out = []
    for row in (n for n in root.iter() if _local(n) == "row"):
        cells: list[str] = []
        for cell in (n for n in row if _local(n) == "c"):
            at = _column(_attribute(cell, "r")) if _attribute(cell, "r") else len(cells)
            cells += [""] * (at + 1 - len(cells))
            value = next((n.text or "" for n in cell if _local(n) == "v"), "")
            kind = _attribute(cell, "t")
            cells[at] = shared[int(value)] if kind == "s" and value else "".join(_all_text(cell, ("t",))) if kind == "inlineStr" else _number(value) if value and not kind else value
        if any(c.strip() for c in cells):
            out.append(cells)
    return out


def pptx(data: bytes) -> str:
    """Slides in the order of their names, one line per run of text, notes quoted."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted(n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n))
        out = []
        for i, name in enumerate(slides, 1):
            lines = [t for t in _all_text(ElementTree.fromstring(z.read(name)), ("t",)) if t.strip()]
            note = name.replace("slides/slide", "notesSlides/notesSlide")
            notes = [f"> {t}" for t in _all_text(ElementTree.fromstring(z.read(note)), ("t",)) if t.strip()] if note in z.namelist() else []
            out.append("\n".join([f"## Slide {i}", "", *lines, *notes]))
    return "\n\n".join(out)


def epub(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        parts = [_visible(z.read(n)) for n in sorted(z.namelist()) if n.lower().endswith((".xhtml", ".html", ".htm"))]
    return "\n\n".join(p for p in parts if p)


def open_document(data: bytes) -> str:
    """Headings, paragraphs and tables of ODT, ODS and ODP."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("content.xml"))
    return "\n\n".join(_open_parts(root))


def _open_parts(node: ElementTree.Element) -> Iterator[str]:
    for child in node:
        kind, said = _local(child), "".join(child.itertext()).strip()
        if kind == "table":
            rows = [["".join(c.itertext()).strip() for c in r if _local(c) == "table-cell"] for r in child.iter() if _local(r) == "table-row"]
            rows = [r for r in rows if any(r)]
            if rows:
                yield pipe_table(rows)
        elif kind == "h" and said:
            yield f"{'#' * min(int(_attribute(child, 'outline-level') or 1), 6)} {said}"
        elif kind == "p":
            if said:
                yield said
        else:
            yield from _open_parts(child)


def rtf(data: bytes) -> str:
    """Text without control words; \\par and \\line are line feeds, destinations such as font tables are left out."""
    source, out, skip, depth, at = data.decode("latin-1"), [], 0, 0, 0
    token = re.compile(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-f]{2})|\\(.)|([{}])|([^\\{}]+)", re.S)
    while m := token.match(source, at):
        at = m.end()
        word, number, byte, sign, brace, plain = m.groups()
        if brace:
            depth += 1 if brace == "{" else -1
            skip = 0 if depth < skip else skip
        elif word in ("fonttbl", "colortbl", "stylesheet", "info", "pict") or sign == "*":
            skip = skip or depth
        elif not skip:
            if word in ("par", "line"):
                out.append("\n")
            elif word == "tab":
                out.append("\t")
            elif word == "u" and number:
                out.append(chr(int(number) % 65536))
            elif byte:
                out.append(bytes.fromhex(byte).decode("cp1252", "replace"))
            elif sign in ("\\", "{", "}"):
                out.append(sign)
            elif plain:
                out.append(plain.replace("\r", "").replace("\n", ""))
    return "".join(out).strip()


# What marks a run of characters in an old file as no text of its author.
DOC_NOISE = (
    "<?xml", "<", "PK", "[Content_Types]", "_rels/", "theme/", "drs/", "slideLayout", "slideMaster", "xmlns", "w:rPr", "w:pPr", "w:body", "w:document", "w:settings", "w:styles", "w:fontTable", "w:numbering",
    "mc:", "w:", "r:", "a:", "v:", "o:", "w10:", "w14:", "w15:", "MSWordDoc", "Word.Document", "Normal", "datastoreItem", "schemaRef", "KSOProductBuildVer", "Microsoft Office Word", "Microsoft",
    "cHRM", "tEXtSoftware", "IDAT", "IHDR", "PLTE", "gAMA", "sRGB", "JFIF", "Exif", "ICC_PROFILE", "PNG", "GIF89", "GIF87", "RIFF", "WEBP", "BM", "GIF", "Root Entry", "CompObj", "Ole", "ObjInfo", "㰢", "㰔", "㰕", "㰖", "㰗", "㰘",
)
PPT_NOISE = (
    "<?xml", "<", "PK", "[Content_Types]", "_rels/", "theme/", "drs/", "slideLayout", "slideMaster", "xmlns", "a:", "r:", "p:", "PowerPoint", "PP97_DUALSTORAGE", "Current User", "Persistent Directory",
    "DocumentSummaryInformation", "SummaryInformation", "cHRM", "tEXtSoftware", "IDAT", "IHDR", "PLTE", "gAMA", "sRGB", "JFIF", "Exif", "ICC_PROFILE", "PNG", "GIF89", "GIF87", "RIFF", "WEBP", "BM", "GIF", "Root Entry", "CompObj", "Ole", "ObjInfo",
)


def legacy(data: bytes, modern: Converter) -> str:
    """Files of old offices: those that are ZIP files inside are read as such, of others runs of more than four characters stay, a line each (see :func:`without_noise`)."""
    if data[:4] == b"PK\x03\x04":
        return modern(data)
    wide = [r for r in re.findall(rb"(?:[\x20-\x7e]\x00|[\x00-\xff][\x30\x4e-\x9f]){5,}", data) if r.count(b"\x00") >= 5]
    runs = []
    for run in re.findall(rb"[\x20-\x7e\x80-\xff]{5,}", data):
        try:
            runs.append(run.decode())
        except UnicodeDecodeError:
            continue
    runs += [r.decode("utf-16-le", "ignore") for r in wide]
    return "\n".join(t for r in runs if (t := r.strip()))


def without_noise(raw: Column, noise: tuple[str, ...], between: str) -> Column:
    """The lines that are no noise, no binary garbage and longer than two bytes; null if none is left."""

    def kept(line: Column) -> Column:
        marked = F.lit(False)
        for n in noise:
            marked = marked | line.contains(n)
        return (F.octet_length(line) > 2) & ~marked & ~cleaning.is_binary_garbage(line)

    text = F.array_join(F.filter(F.split(raw, "\n"), kept), between)
    return F.when(cleaning.trim(text) != "", cleaning.trim_trailing(cleaning.compress_blank_lines(text)))


def pdf(data: bytes, extractors: list[Converter], readable: Callable[[str], bool], least: int = 50) -> str:
    """The first extractor's text that is readable and long enough, else the longest readable one."""
    found = []
    for extract in extractors:
        try:
            text = extract(data)
        except Exception:
            continue
        if readable(text):
            if len(re.sub(r"\s", "", text)) >= least:
                return text
            found.append(text)
    if not found:
        raise ValueError("no extractor finds readable text")
    return max(found, key=len)


def pdf_texts(files: DataFrame, extractors: list[Converter], ocr: Converter | None = None, least: int = 50) -> DataFrame:
    """path, text and error of PDF files (path, content), by the caller's extractors in their order.

    The first text that is readable and has at least so many visible characters is taken. Only files without one are
    read again for ``ocr``; what it finds is merged with the first extractor's text. Then the longest readable text is
    taken, and without any the file has an error.
    """

    def tried(extract: Converter, data: bytes) -> str:
        try:
            return extract(data) or ""
        except Exception:  # of any broken file
            return ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "found": [[tried(e, d or b"") for e in extractors] for d in batch["content"]]})

    def read_again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "scanned": [tried(ocr, d or b"") for d in batch["content"]]})

    found = files.select("path", "content").mapInPandas(run, "path string, found array<string>")
    texts = found.select("path", F.transform("found", cleaning.clean_pdf_lines).alias("found"))
    visible = lambda t: F.char_length(F.regexp_replace(t, rf"[{cleaning.SPACE}\n]", ""))
    good = F.filter("found", lambda t: (visible(t) >= least) & cleaning.is_readable(t))
    some = F.filter("found", cleaning.is_readable)
    longest = F.array_max(F.transform(some, lambda t: F.struct(visible(t).alias("n"), t.alias("t"))))["t"]
    rows = texts.select("path", F.get(good, F.lit(0)).alias("good"), F.get("found", F.lit(0)).alias("first"), longest.alias("longest"))
    scanned = F.lit(None).cast("string").alias("scanned")
    if ocr:
        asked = files.join(rows.where("good IS NULL").select("path"), "path", "left_semi").select("path", "content").mapInPandas(read_again, "path string, scanned string")
        rows = rows.join(asked.select("path", F.when(cleaning.trim(F.col("scanned")) != "", cleaning.clean_pdf_lines(F.col("scanned"))).alias("scanned")), "path", "left")
    else:
        rows = rows.withColumn("scanned", scanned)
    merged = F.when(F.col("scanned").isNotNull(), cleaning.merge_texts(F.coalesce("first", F.lit("")), F.col("scanned")))
    text = F.coalesce("good", merged, "longest")
    return rows.select("path", text.alias("text"), F.when(text.isNull(), "no extractor finds readable text").alias("error"))


CONVERTERS: dict[str, Converter] = {
    "html": html, "htm": html, "mhtml": html, "mht": html, "docx": docx, "xlsx": xlsx, "pptx": pptx, "epub": epub, "odt": open_document, "ods": open_document, "odp": open_document, "rtf": rtf,
    "doc": lambda data: legacy(data, docx), "ppt": lambda data: legacy(data, pptx), "xls": lambda data: legacy(data, xlsx),
}


def plain(data: bytes) -> str:
    """Strict UTF-8."""
    return data.decode("utf-8")


def convert(files: DataFrame, more: dict[str, Converter] | None = None) -> DataFrame:
    """Files (path, content) to path, text, error; converted texts are cleaned, plain ones stay as they are."""
    known = {**CONVERTERS, **{e: plain for e in TEXT_EXTENSIONS}, **(more or {})}

    def one(extension: str, data: bytes) -> tuple[str | None, str | None]:
        if extension not in known:
            return None, f"no converter for {extension!r}"
        try:
            return known[extension](data or b""), None
        except Exception as e:  # of any broken file
            return None, f"{type(e).__name__}: {e}"[:200]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [one(e, d) for e, d in zip(batch["extension"], batch["content"])]
            yield pd.DataFrame({"path": batch["path"], "extension": batch["extension"], "raw": [t for t, _ in got], "error": [e for _, e in got]})

    zipped = F.coalesce(F.hex(F.substring("content", 1, 4)) == "504B0304", F.lit(False))
    old = F.when(zipped, F.concat(parse.extension(F.col("path")), F.lit("x"))).otherwise(parse.extension(F.col("path")))  # what it is inside
    kinds = F.when(parse.extension(F.col("path")).isin("doc", "ppt", "xls"), old).otherwise(parse.extension(F.col("path")))
    found = files.select("path", kinds.alias("extension"), "content").mapInPandas(run, "path string, extension string, raw string, error string")
    raw, kind = F.col("raw"), F.col("extension")
    plain_ = F.when(kind == "ppt", without_noise(raw, PPT_NOISE, " ")).when(kind.isin("doc", "xls"), without_noise(raw, DOC_NOISE, "\n")).otherwise(raw)
    text = F.when(kind.isin(*TEXT_EXTENSIONS), raw).otherwise(clean_knowledge(plain_))
    error = F.when(F.col("error").isNull() & text.isNull(), "no readable text").otherwise(F.col("error"))
    return found.select("path", text.alias("text"), error.alias("error"))


def scan(spark, *roots: str) -> DataFrame:
    """Supported files below the roots (path, content, length, modificationTime), without hidden folders and files that are too large."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(roots))
    wanted = parse.is_supported_file(F.col("path")) & ~parse.in_hidden_folder(F.col("path"))
    return files.where(wanted & (F.col("length") <= parse.MOST_FILE_BYTES))


def changed_since(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that a manifest (path, modificationTime) doesn't have in this state."""
    return files.join(manifest.select("path", "modificationTime"), ["path", "modificationTime"], "left_anti")


def cache_path(path, root: str = "cache"):
    """Where a file's conversion is kept: without the drive, with .md for its extension."""
    return F.concat(F.lit(f"{root}/"), F.regexp_replace(F.regexp_replace(path, r"^(?:[A-Za-z]:)?[/\\]*", ""), r"\.[^./\\]*$", ""), F.lit(".md"))


def html_frame(pages: DataFrame) -> DataFrame:
    """page_id and the page's text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"page_id": batch["page_id"], "text": [html((h or "").encode()) for h in batch["html"]]})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, text string")
