"""Chunks and tools as table functions for lateral joins: Arrow in, Arrow out, for texts of any row.

``register(spark)`` makes them known to SQL::

    SELECT d.id, c.place, c.chunk FROM doc AS d, LATERAL chunk_fixed(d.content, 500, 50) AS c
    SELECT d.id, c.place, c.chunk FROM doc AS d, LATERAL chunk_paragraphs(d.content, 800) AS c
    SELECT d.id, t.tag FROM doc AS d, LATERAL tags_of(d.metadata) AS t
    SELECT d.id, s.place, s.heading, s.body FROM doc AS d, LATERAL sections_of(d.content) AS s
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class FixedChunks:
    """Chunks of so many characters, each beginning ``overlap`` characters before the last one's end; none for null and empty texts."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
        if not 0 <= overlap < size:
            raise ValueError("overlap must be at least 0 and less than size")
        if text:
            for place, start in enumerate(range(0, max(1, len(text) - overlap), size - overlap)):
                yield place, text[start : start + size]


class ParagraphChunks:
    """Paragraphs put together while their bytes fit; a longer one is a chunk of its own."""

    def eval(self, text: str, size: int) -> Iterator[tuple[int, str]]:
        place, now, used = 0, "", 0
        for part in (text or "").split("\n\n"):
            bytes_ = len(part.encode())
            if not now:
                now, used = part, bytes_
            elif used + bytes_ <= size:
                now, used = f"{now}\n\n{part}", used + 2 + bytes_
            else:
                yield place, now.strip()
                place, now, used = place + 1, part, bytes_
        if now.strip():
            yield place, now.strip()


class Tags:
    """The texts of a JSON list; none for anything else."""

    def eval(self, metadata: str) -> Iterator[tuple[str]]:
        try:
            found = json.loads(metadata or "[]")
        except ValueError:
            return
        if isinstance(found, list):
            for tag in found:
                if isinstance(tag, str):
                    yield (tag,)


class Sections:
    """What lies under each Markdown heading; what comes before the first one has an empty heading."""

    def eval(self, text: str) -> Iterator[tuple[int, str, str]]:
        heading, body, place = "", [], 0
        for line in (text or "").split("\n"):
            found = re.match(r"#{1,6}\s+(.*)", line)
            if not found:
                body.append(line)
                continue
            if heading or "".join(body).strip():
                yield place, heading, "\n".join(body).strip()
                place += 1
            heading, body = found.group(1).strip(), []
        if heading or "".join(body).strip():
            yield place, heading, "\n".join(body).strip()


FUNCTIONS = {
    "chunk_fixed": (FixedChunks, "place int, chunk string"), "chunk_paragraphs": (ParagraphChunks, "place int, chunk string"),
    "tags_of": (Tags, "tag string"), "sections_of": (Sections, "place int, heading string, body string"),
}


def register(spark: SparkSession) -> None:
    """Make the table functions known to a session."""
    for name, (handler, kind) in FUNCTIONS.items():
        spark.udtf.register(name, udtf(handler, returnType=kind, useArrow=True))
