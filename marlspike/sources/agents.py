"""What agents keep on disk, as memories: title and content, with the layouts' own rules."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parse
from ..functions.text import trim
from ..operators.exchange import section_memories

MOST_SCANNED_BYTES = 5000
SCANNED_EXTENSIONS = ("md", "txt", "markdown", "rst", "json", "yaml", "yml", "toml", "csv", "xml", "html", "log")


def section_files(files: DataFrame, category: str) -> DataFrame:
    """Files (path, value) of sections between § signs."""
    return section_memories(files.select(F.col("path").alias("id"), F.col("value").alias("content")), category)


def markdown_files(files: DataFrame) -> DataFrame:
    """Files (path, value): a memory each, named by the file."""
    return files.where(parse.extension(F.col("path")) == "md").select("path", parse.stem(F.col("path")).alias("title"), F.col("value").alias("content"))


def summary_files(files: DataFrame) -> DataFrame:
    """Files (path, value) of JSON with a title and a summary; those without a summary are left out."""
    found = files.select("path", F.from_json("value", "title string, summary string").alias("j"))
    return found.where("trim(j.summary) <> ''").select("path", F.coalesce("j.title", parse.stem(F.col("path"))).alias("title"), F.col("j.summary").alias("content"))


def sqlite_files(files: DataFrame) -> DataFrame:
    """SQLite databases (path, content): rows of chunks whose source is memory, else of memory that isn't deleted."""

    def rows(data: bytes) -> list[tuple[str, str]]:
        con = sqlite3.connect(":memory:")
        try:
            con.deserialize(data)
            tables = {r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
            if "chunks" in tables:
                return con.execute("SELECT CAST(id AS TEXT), text FROM chunks WHERE source = 'memory'").fetchall()
            return con.execute("SELECT title, content FROM memory WHERE deleted = 0").fetchall() if "memory" in tables else []
        except sqlite3.Error:
            return []
        finally:
            con.close()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [(p, t, c) for p, d in zip(batch["path"], batch["content"]) for t, c in rows(d) if c and c.strip()]
            yield pd.DataFrame(got, columns=["path", "title", "content"])

    return files.select("path", "content").mapInPandas(run, "path string, title string, content string")


def data_source_scan(files: DataFrame, doc: DataFrame) -> DataFrame:
    """Files (path, value) that are not known yet, as documents: blank ones are left out, long ones cut at a whole character."""
    wanted = files.where(parse.extension(F.col("path")).isin(*SCANNED_EXTENSIONS) & (trim(F.col("value")) != ""))
    new = wanted.join(doc.select(F.col("source_path").alias("path")).distinct(), "path", "left_anti")
    cut = F.when(F.octet_length("value") > MOST_SCANNED_BYTES, F.concat(parse.utf8_prefix(F.col("value"), MOST_SCANNED_BYTES), F.lit("..."))).otherwise(F.col("value"))
    return new.select("path", parse.stem(F.col("path")).alias("title"), cut.alias("content"), F.lit("scan_triggered").alias("event_type"))


def listing(entries: DataFrame) -> DataFrame:
    """A folder's entries (name, is_dir): hidden ones and build folders are left out, folders come first."""
    shown = entries.where(~F.col("name").startswith(".") & ~F.col("name").isin("node_modules", "__pycache__"))
    return shown.orderBy(F.desc("is_dir"), "name")
