"""Hybrid retrieval: keyword and vector rankings fused, near-equal hits passed over, texts compressed, and a budget of tokens kept.

Only the rankings run over the corpus, each as a top-k. What follows works on at most ``DEPTH`` rows per ranking,
whatever the size of the corpus.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as cleaning
from ..functions import vector
from . import search

DEPTH = 200
#: The constant of reciprocal-rank fusion.
FUSION = 60
#: Bytes of a text that count as a token.
BYTES_A_TOKEN = 4


def _placed(top: DataFrame, *order: Column) -> DataFrame:
    """id and rank from 1 of a few rows."""
    return top.select("id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).alias("rank"))


def keyword_ranks(doc: DataFrame, query: str, depth: int = DEPTH) -> DataFrame:
    """id and rank of the active documents that hold most words of the query in title, content or tags; the newer, then the smaller id first."""
    words = sorted(set(query.split()))
    if not words:
        return doc.select("id", F.lit(0).alias("rank")).limit(0)
    held = reduce(lambda a, b: a + b, (search.matches(w, "title", "content", "metadata").cast("int") for w in words))
    order = (F.desc("held"), F.desc("updated_at"), F.col("id"))
    top = doc.where("status = 'active'").select("id", "updated_at", held.alias("held")).where("held > 0").orderBy(*order).limit(depth)
    return _placed(top, *order)


def vector_ranks(vectors: DataFrame, wanted: list[float], depth: int = DEPTH) -> DataFrame:
    """id and rank of the vectors (id, embedding) most similar to the wanted one."""
    top = vector.top_k(vectors, wanted, depth, "id")
    return _placed(top, F.desc("similarity"), F.col("id"))


def fused(rankings: dict[str, DataFrame], constant: int = FUSION) -> DataFrame:
    """id, the rank in each ranking (null where it has none) and the score: the sum of 1 / (constant + rank)."""
    both = reduce(DataFrame.unionByName, (r.select("id", "rank", F.lit(name).alias("ranking")) for name, r in rankings.items()))
    ranks = [F.min(F.when(F.col("ranking") == name, F.col("rank"))).alias(f"{name}_rank") for name in rankings]
    score = reduce(lambda a, b: a + b, (F.coalesce(1.0 / (constant + F.col(f"{name}_rank")), F.lit(0.0)) for name in rankings))
    return both.groupBy("id").agg(*ranks).withColumn("score", score)


def one_per_path(hits: DataFrame) -> DataFrame:
    """Of the hits (score, id, source_path) with one path the best; hits without a path stay."""
    place = F.row_number().over(Window.partitionBy("source_path").orderBy(F.desc("score"), "id"))
    return hits.withColumn("place", place).where((F.coalesce("source_path", F.lit("")) == "") | (F.col("place") == 1)).drop("place")


def compressed(content: Column, most: int = 500) -> Column:
    """The text without blank lines, repeated lines and runs of spaces, cut to so many characters."""
    return F.substring(cleaning.compress_spaces(cleaning.dedup_adjacent_lines(cleaning.compress_blank_lines(F.coalesce(content, F.lit(""))))), 1, most)


def tokens(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / BYTES_A_TOKEN).cast("long")


def chosen(scores: np.ndarray, vectors: list, sizes: np.ndarray, budget: int, most: int, balance: float) -> list[int]:
    """Places of the hits taken, in order: each time the one with the highest balance * score - (1 - balance) * its largest cosine with those taken.

    Scores count relative to the highest. A hit that is larger than what is left of the budget is passed over; of equal
    ones the earlier place is taken. Hits without a usable vector resemble nothing.
    """
    dim = max((len(v) for v in vectors if v is not None), default=1)
    unit = np.zeros((len(scores), max(1, dim)))
    for i, v in enumerate(vectors):
        row = np.array([] if v is None else v, float)
        if len(row) == dim and np.isfinite(row).all() and np.linalg.norm(row) > 0:
            unit[i] = row / np.linalg.norm(row)
    relative = scores / scores.max() if len(scores) and scores.max() > 0 else np.zeros(len(scores))
    near, free, taken = np.zeros(len(scores)), np.ones(len(scores), bool), []
    while len(taken) < most:
        free &= sizes <= budget
        if not free.any():
            break
        value = np.where(free, balance * relative - (1 - balance) * near, -np.inf)
        best = int(value.argmax())
        taken.append(best)
        free[best] = False
        budget -= int(sizes[best])
        near = np.maximum(near, unit @ unit[best])
    return taken


def diverse(hits: DataFrame, budget: int, most: int = 10, balance: float = 0.7, by: str | None = None) -> DataFrame:
    """The hits (id, score, embedding, tokens) that :func:`chosen` takes, with their place from 1; per value of ``by`` if given.

    A group is a bounded set of candidates, as fused() gives them for one request.
    """
    kind = hits.drop("embedding").schema.add("place", "integer")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["score", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        taken = chosen(group["score"].to_numpy(float), list(group["embedding"]), group["tokens"].to_numpy(), budget, most, balance)
        return group.iloc[taken].drop(columns="embedding").assign(place=range(1, len(taken) + 1))

    grouped = hits.groupBy(by) if by else hits.repartition(1).groupBy()
    return grouped.applyInPandas(run, kind)


def hybrid(doc: DataFrame, vectors: DataFrame, query: str, wanted: list[float] | None, budget: int, most: int = 10, balance: float = 0.7, depth: int = DEPTH) -> DataFrame:
    """The pack for a request: place, id, title, preview, tokens and score of diverse hits whose previews fit into the budget together."""
    rankings = {"keyword": keyword_ranks(doc, query, depth)} | ({"vector": vector_ranks(vectors, wanted, depth)} if wanted else {})
    hits = F.broadcast(fused(rankings).select("id", "score"))  # depth rows per ranking at most
    rows = doc.where("status = 'active'").join(hits, "id").select("id", "title", "source_path", "score", compressed(F.col("content")).alias("preview"))
    rows = one_per_path(rows).withColumn("tokens", tokens(F.col("preview")))
    some = vectors.join(hits.select("id"), "id", "left_semi").groupBy("id").agg(F.first("embedding").alias("embedding"))
    return diverse(rows.drop("source_path").join(some, "id", "left"), budget, most, balance).select("place", "id", "title", "preview", "tokens", "score")
