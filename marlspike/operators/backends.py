"""Pluggable embedding and keyword back-ends, run over Arrow batches, with a cache by the text's hash."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parse import is_vectorized, utf8_prefix
from .search import expanded


class EmbeddingBackend(Protocol):
    """Texts to vectors, in the order given."""

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class KeywordBackend(Protocol):
    """Title and content to comma-separated key words."""

    def __call__(self, title: str, content: str) -> str: ...


class SummaryBackend(Protocol):
    """A text to its summary of at most so many characters."""

    def __call__(self, text: str, most: int) -> str: ...


def summarize(doc: DataFrame, backend: SummaryBackend, most: int = 300, most_bytes: int = 5000) -> DataFrame:
    """id and summary of documents with content, of which the back-end sees so many bytes, cut after a whole character; empty answers stay out."""
    rows = doc.where("content <> ''").select("id", utf8_prefix(F.col("content"), most_bytes).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            said = [(backend(t, most) or "").strip()[:most] for t in part["text"]]
            yield pd.DataFrame({"id": part["id"], "summary": said})[[bool(s) for s in said]]

    return rows.mapInPandas(run, "id string, summary string")


def frequent_words(title: str, content: str, most: int = 5) -> str:
    """The default: the most frequent words of at least four letters, ties by the alphabet."""
    count = Counter(re.findall(r"[^\W\d_]{4,}", f"{title} {content}".lower()))
    return ", ".join(w for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:most])


def embed(texts: DataFrame, backend: EmbeddingBackend, cache: DataFrame | None = None, batch: int = 100) -> DataFrame:
    """id, text to id, text_hash, embedding. Texts in the cache (text_hash, embedding) aren't sent; equal texts are sent once."""
    hashed = texts.select("id", "text", F.sha2("text", 256).alias("text_hash"))
    wanted = hashed.select("text_hash", "text").dropDuplicates(["text_hash"])
    if cache is not None:
        wanted = wanted.join(cache.select("text_hash"), "text_hash", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), batch):
                some = rows.iloc[at : at + batch]
                yield pd.DataFrame({"text_hash": some["text_hash"], "embedding": backend(some["text"].tolist())})

    fresh = wanted.mapInPandas(run, "text_hash string, embedding array<float>")
    known = fresh if cache is None else fresh.unionByName(cache.select("text_hash", "embedding"))
    return hashed.select("id", "text_hash").join(known, "text_hash", "left")


def light_embed(doc: DataFrame, backend: KeywordBackend = frequent_words, kind: str | None = None) -> DataFrame:
    """Active rows without tags, of a type or a source if one is given, get those that the back-end gives. Rows it gives none stay out. How many requests run at once is the back-end's to bound."""
    pending = doc.where((F.col("status") == "active") & expanded(kind) & ~is_vectorized(F.col("metadata"))).select("id", "title", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            tags = [[t.strip() for t in backend(title, content).split(",") if t.strip()] for title, content in zip(rows["title"].fillna(""), rows["content"].fillna(""))]
            yield pd.DataFrame({"id": rows["id"], "tags": tags})[[bool(t) for t in tags]]

    found = pending.mapInPandas(run, "id string, tags array<string>")
    return found.select("id", F.to_json("tags").alias("metadata"))
