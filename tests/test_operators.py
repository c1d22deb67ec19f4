"""Retrieval, entity folds, schemas and table functions against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlspike.functions import parse
from marlspike.operators import entities, retrieval, schemas, tables
from marlspike.plans import retrieval as queries
from marlspike.sources import frames

DATA = "/root/testdata/sf0.001"


def greedy(hits, budget, most, balance):
    """Straight from the definition, over (id, score, vector, tokens)."""
    hits = sorted(hits, key=lambda h: (-h[1], h[0]))
    cos = lambda a, b: 0.0 if not a or not b else sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))
    top, out = max((h[1] for h in hits), default=0), []
    while len(out) < most:
        free = [h for h in hits if h not in out and h[3] <= budget - sum(o[3] for o in out)]
        if not free:
            break
        out.append(max(free, key=lambda h: (round(balance * (h[1] / top if top else 0) - (1 - balance) * max([0.0] + [cos(h[2], o[2]) for o in out]), 9), -hits.index(h))))
    return [h[0] for h in out]


def test_diverse_against_brute_force(spark):
    rnd = random.Random(4)
    rows = []
    for group in range(4):
        base = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(5)]
        rows += [(group, f"{group}-{i}", round(rnd.random(), 3), [x + rnd.gauss(0, 0.1) for x in base[i % 5]] if i % 7 else None, rnd.randrange(1, 60)) for i in range(30)]
    hits = spark.createDataFrame(rows, "query int, id string, score double, embedding array<double>, tokens long")
    for budget, most, balance in ((150, 8, 0.5), (10**6, 30, 0.9), (0, 5, 0.5)):
        got = {}
        for r in retrieval.diverse(hits, budget, most, balance, by="query").orderBy("query", "place").collect():
            got.setdefault(r["query"], []).append(r.id)
        want = {g: greedy([r[1:] for r in rows if r[0] == g], budget, most, balance) for g in range(4)}
        assert got == {g: ids for g, ids in want.items() if ids}


def test_hits_without_vectors_or_scores():
    none = np.zeros(0)
    assert retrieval.chosen(none, [], none, 10, 3, 0.5) == []
    assert retrieval.chosen(np.zeros(3), [None, [], [math.nan, 1.0]], np.array([1, 1, 1]), 2, 3, 0.5) == [0, 1]


def test_pack_keeps_its_budget(spark):
    rows = queries.hybrid_pack(spark, DATA).collect()
    assert 0 < len(rows) <= 10 and sum(r.tokens for r in rows) <= 600
    assert [r.place for r in sorted(rows, key=lambda r: r.place)] == list(range(1, len(rows) + 1))
    doc, vectors = frames.doc(spark, DATA), frames.table(spark, DATA, "embeddings").select(F.expr("concat('k', vec_id)").alias("id"), "embedding")
    assert retrieval.hybrid(doc, vectors, "zzqq qqzz", None, 100).count() == 0
    assert retrieval.hybrid(doc, vectors, "", [0.0] * 64, 100, depth=5).count() <= 5


CHANGES = "id string, at timestamp_ntz, seq long, op string, given array<string>, a string, b long"


def test_folds_do_not_depend_on_the_order(spark):
    import datetime

    day = lambda n: datetime.datetime(2024, 1, n)
    changes = [("x", day(1), 1, "set", ["a", "b"], "one", 1), ("x", day(2), 2, "set", ["a"], None, None), ("x", day(2), 3, "set", ["b"], None, 5), ("y", day(1), 1, "set", ["a"], "gone", None), ("y", day(2), 1, "delete", [], None, None), ("z", day(1), 1, "delete", [], None, None), ("z", day(1), 2, "set", ["b"], None, 7), ("z", day(1), 0, "set", ["a"], "before", None)]
    want = {("x", None, 5, True), ("y", None, None, False), ("z", None, 7, True)}
    old = spark.createDataFrame([("x", "old", 0, day(1)), ("x", "twice", 0, day(1)), ("y", "o", 0, day(1)), ("z", "o", 0, day(1)), ("q", "o", 0, day(1))], "id string, a string, b long, updated_at timestamp_ntz")
    for order in itertools.islice(itertools.permutations(changes), 0, 40320, 13000):
        rows = spark.createDataFrame(list(order), CHANGES)
        assert {(r.id, r.a, r.b, r.lives) for r in entities.fold(rows, ["a", "b"]).collect()} == want
        after = sorted((r.id, r.a, r.b, r.updated_at.day) for r in entities.patched(old, rows, ["a", "b"]).collect())
        assert after == [("q", "o", 0, 1), ("x", None, 5, 2), ("x", None, 5, 2), ("z", None, 7, 1)]


def test_artifacts_go_with_their_workspace(spark):
    kind = "id string, workspace_id string, lives boolean, deleted_at string"
    children = spark.createDataFrame([("a", "w1", True, None), ("b", "w2", True, None), ("c", None, True, None), ("d", "w2", False, "1"), ("e", "unknown", True, None)], kind)
    parents = spark.createDataFrame([("w1", True, None), ("w2", False, "2")], "id string, lives boolean, deleted_at string")
    got = {r.id: (r.lives, r.deleted_at) for r in entities.cascaded(children, parents, "workspace_id").collect()}
    assert got == {"a": (True, None), "b": (False, "2"), "c": (True, None), "d": (False, "1"), "e": (True, None)}


SCHEMA = {
    "type": "object", "required": ["name", "parts"], "properties": {"name": {"type": "string", "minLength": 1, "maxLength": 3}, "parts": {"type": "array", "items": {"$ref": "#/$defs/part"}}, "n": {"type": "integer", "minimum": 0, "maximum": 9}, "on": {"type": "boolean"}},
    "$defs": {"part": {"type": "object", "required": ["id"], "properties": {"id": {"type": "string", "format": "uuid"}, "at": {"type": ["string", "null"], "format": "date-time"}, "kind": {"enum": ["a", "b"]}, "key": {"type": "string", "pattern": "^k[0-9]+$"}}}},
}


@pytest.mark.parametrize(("text", "wrong"), [
    ('{"name":"x","parts":[]}', []), ('{"name":"x","parts":[{"id":"123e4567-e89b-12d3-a456-426614174000","at":null,"kind":"a","key":"k1"}],"n":9,"on":true}', []), ("no", ["$: no JSON"]), (None, ["$: no JSON"]), ("[]", ["$: not object"]),
    ('{"name":"","n":10,"on":"yes"}', ["$.parts: missing", "$.name: shorter than 1", "$.n: more than 9", "$.on: not boolean"]), ('{"name":"xyzä","parts":{},"n":-1}', ["$.name: longer than 3", "$.parts: not array", "$.n: less than 0"]),
    ('{"name":1,"parts":[{"id":"x"},{"at":"today","kind":"c","key":"1"}],"n":1.5}', ["$.name: not string", "$.parts[]: no uuid"]), ('{"name":"x","parts":[],"n":3.0}', []),
])
def test_schemas_say_what_is_wrong(spark, text, wrong):
    got = spark.createDataFrame([(text,)], "t string").select(schemas.violations(F.col("t"), SCHEMA).alias("v")).first().v
    if "today" in (text or ""):
        assert got == ["$.name: not string", "$.parts[].id: no uuid", "$.parts[].id: missing", "$.parts[].at: no date-time", "$.parts[].kind: not one of a, b", "$.parts[].key: doesn't match ^k[0-9]+$", "$.n: not integer"]
    else:
        assert got == wrong


def test_table_functions_give_what_the_columns_give(spark):
    tables.register(spark)
    docs = frames.table(spark, DATA, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "\n\n  \n\n"), (-4, "é" * 30 + "\n\n" + "x" * 5)], "doc_id long, text string"))
    for call, column in (("chunk_fixed(d.text, 300, 30)", parse.fixed_chunks(F.col("text"), 300, 30)), ("chunk_paragraphs(d.text, 200)", parse.paragraph_chunks(F.col("text"), 200))):
        lateral = spark.sql(f"SELECT d.doc_id, c.place, c.chunk FROM {{docs}} AS d, LATERAL {call} AS c", docs=docs)
        whole = docs.select("doc_id", F.posexplode(column).alias("place", "chunk"))
        assert sorted(map(tuple, lateral.collect())) == sorted(map(tuple, whole.collect()))


def test_sections_of_a_text(spark):
    tables.register(spark)
    rows = spark.createDataFrame([(1, "before\n# One\nbody\n\n## Two\n# Three\nx"), (2, None), (3, "")], "id int, t string")
    got = [tuple(r)[1:] for r in spark.sql("SELECT r.id, s.* FROM {rows} AS r, LATERAL sections_of(r.t) AS s ORDER BY 1, 2", rows=rows).collect()]
    assert got == [(0, "", "before"), (1, "One", "body"), (2, "Two", ""), (3, "Three", "x")]
