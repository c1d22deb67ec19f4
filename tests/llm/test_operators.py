"""The ten operators against brute force, exact round trips and held-out labels, and their edge cases."""

import gzip
import hashlib
import math
import random
import re
import time
import tracemalloc
import weakref
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlspike.llm import archives, brown, common, decontamination, lines, minhash, packing, pii, quality, queries, toxicity, vectors
from marlspike.llm.common import Scratch, broadcast_if_small, connected_components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# ---------------------------------------------------------------- shared


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 30)] + [(1, 1)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 7 for i in range(7, 30)}}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).collect() == []


def test_a_worker_lets_go_of_its_object_when_no_task_follows(monkeypatch):
    class Held:
        pass

    batch = pa.RecordBatch.from_pydict({"x": list(range(5))})
    monkeypatch.setattr(common, "IDLE", 0.3)
    first = weakref.ref(common.held_by_worker("a", Held))
    for _ in range(4):
        assert [b.num_rows for b in common.slices([batch], 2)] == [2, 2, 1]
        time.sleep(0.1)
        assert common.held_by_worker("a", Held) is first()
    running = common.slices([batch], 2)
    next(running)
    time.sleep(0.6)
    assert first() is not None
    assert len(list(running)) == 2
    time.sleep(1)
    assert first() is None
    second = weakref.ref(common.held_by_worker("a", Held))
    common.held_by_worker("b", Held)
    assert second() is None


def test_broadcast_is_checked(spark):
    df = spark.range(10)
    assert "broadcast" in broadcast_if_small(df, 10)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in broadcast_if_small(df, 9)._jdf.queryExecution().logical().toString().lower()


# ---------------------------------------------------------------- 1 vectors


def brute_vectors(rows, cosine):
    ok = {i: np.array(v, float) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links = {i: {j for j in ok if j != i and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / np.linalg.norm(ok[i]) / np.linalg.norm(ok[j]) >= cosine} for i in ok}
    out = {}
    for i, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(links.get(i, ())), min(seen), i == min(seen))
    return out


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + rng.normal(size=8) * rng.choice([0.05, 0.3, 1])).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(5)] + [(2000, [0.0] * 8), (2001, None), (2002, []), (2003, [1.0, None] + [0.0] * 6), (2004, [float("nan")] * 8), (2005, [float("inf")] + [1.0] * 7), (2006, [1.0, 2.0]), (2007, [2.0, 4.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, h1 string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df, 0.9, block=24, tile=3).collect()}
    assert got == brute_vectors(rows, 0.9)


def test_repeated_vectors_and_ties_at_the_threshold(spark):
    exact = [1.0] + [0.0] * 3
    rows = [(1, exact), (1, exact), (2, [3.0, 4.0, 0.0, 0.0]), (3, [2.99, 4.01, 0.0, 0.0]), (4, [3.0, 0.0, 0.0, 0.0]), (4, [3.0, 0.0, 0.0, 0.0])]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.6).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 3, 1), (3, 1, 1), (4, 2, 1), (4, 2, 1)]


def test_vectors_without_an_id(spark):
    v, w = [1.0, 2.0, 3.0], [3.0, -1.0, 0.0]
    rows = spark.createDataFrame([(None, v), (3, v), (None, None), (5, v), (9, w), (None, w)], "vec_id long, embedding array<float>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(rows).collect()), key=repr)
    assert got == sorted([(None, 0, None, True)] * 3 + [(3, 1, 3, True), (5, 1, 3, False), (9, 0, 9, True)], key=repr)


def test_no_vectors(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


# ---------------------------------------------------------------- 2 minhash


def brute_near(texts, percent=85):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = [i for i, _ in texts]
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def near_texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    out = ["", None, " \t", "one two", "ONE two", "one two three four five", "é É é"]
    for k in range(70):  # a large group of near copies, some beyond the threshold
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 6, 10])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if k % 9 == 0:
            words = words[: 150 - rng.randrange(40)]
        out.append(" ".join(words))
    out += [out[9]] * 5 + [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(3, 60))) for _ in range(40)]
    return list(enumerate(out))


def test_near_duplicates_against_brute_force(spark):
    texts = near_texts()
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, n_shingles int")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, small_bucket=4).collect()}
    assert got == brute_near(texts)


def several_families():
    """One large group: families around a common text, near misses between them, and links that only rare changes make."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for family in range(4):
        own = list(base)
        for at in rng.sample(range(120), 6):
            own[at] = f"f{family}x{at}"
        for k in range(12):
            words = list(own)
            for at in rng.sample(range(120), rng.choice([0, 1, 2, 3])):
                words[at] = f"r{rng.randrange(3)}"
            texts.append(" ".join(words[: 120 - rng.choice([0, 0, 4, 12])]))
    for k in range(10):
        words = [w if rng.random() > 0.06 else f"n{k}{i}" for i, w in enumerate(base)]
        texts += [" ".join(words), " ".join(words[:50] + ["same"] + words[51:])]
    return list(enumerate(texts))


@pytest.mark.parametrize("common", [2, 64])
def test_components_within_one_large_bucket(spark, monkeypatch, common):
    texts = several_families()
    monkeypatch.setattr(minhash, "_rest", lambda *a, rest=minhash._rest: rest(*a, common=common))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = brute_near(texts)
    assert len({c for _, c, _ in want.values()}) > 5
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, small_bucket=3).collect()} == want


def test_near_duplicates_of_long_and_repeated_texts(spark):
    long_ = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long_), (1, long_), (2, long_ + " end"), (3, "a b c d e f"), (3, long_ + " other"), (4, "a b c d e f"), (None, "x y z")]
    rows += [(None, "a b c d e f"), (None, "p q r s t u"), (9, "x y z")]
    got = sorted({(r.doc_id or 0, r.component_id or 0, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()})
    assert got == [(0, 0, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 1, False), (9, 9, True)]


def test_every_pair_within_the_distance_shares_a_key():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = rng.integers(0, 2**16, minhash.HASHES).astype(np.uint16)
        b = a.copy()
        b[rng.choice(minhash.HASHES, minhash.MOST_APART, replace=False)] ^= 1
        assert set(minhash.keys(a[None])[0]) & set(minhash.keys(b[None])[0])


def test_deduplicate_keeps_columns_and_one_of_each(spark):
    df = docs_of(spark, ["a b c d e f g", "a b c d e f g", "x y z", None, None])
    kept = minhash.deduplicate(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4]
    assert minhash.deduplicate(df.limit(0)).collect() == []


def shuffled_records(spark):
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("shipped", [minhash.MOST_SHIPPED, 0])
def test_all_keys_are_shuffled_once_to_be_counted_and_once_to_meet(spark, monkeypatch, shipped):
    """The second look goes at members of large buckets, not at every key again; signatures are stored once where few texts are copies."""
    texts = several_families()
    many = 1_500
    texts += [(len(texts) + i, " ".join(f"d{i}w{j}" for j in range(9))) for i in range(many)] + [(len(texts) + many, texts[0][1]), (len(texts) + many + 1, "")]
    kept, keep = [], minhash.Scratch.keep
    monkeypatch.setattr(minhash.Scratch, "keep", lambda self, df, name: kept.append((name, df.columns)) or keep(self, df, name))
    monkeypatch.setattr(minhash, "MOST_SHIPPED", shipped)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        records = shuffled_records(spark)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), small_bucket=3).collect()}
        records = shuffled_records(spark) - records
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == brute_near(texts)
    assert records < 3 * minhash.HASHES * len(texts)
    assert sum("keys" in columns for _, columns in kept) == (1 if shipped else 2)


def test_distance_follows_from_the_threshold():
    assert (minhash.distance(85), minhash.chunks(21)) == (21, 11)
    rng = np.random.default_rng(2)
    for percent in (50, 80, 90):
        apart = minhash.distance(percent)
        tail = lambda m: sum(math.comb(64, i) * (1 - percent / 100) ** i * (percent / 100) ** (64 - i) for i in range(m + 1, 65))
        assert tail(apart) <= 1e-4 < tail(apart - 1)
        for _ in range(100):
            a = rng.integers(0, 2**16, minhash.HASHES).astype(np.uint16)
            b = a.copy()
            b[rng.choice(minhash.HASHES, apart, replace=False)] ^= 1
            n = minhash.chunks(apart)
            assert set(minhash.keys(a[None], n)[0]) & set(minhash.keys(b[None], n)[0])


def test_the_stage_drops_copies_from_80_percent_on(spark):
    rng = random.Random(8)
    texts, gone = [], set()
    for k in range(120):  # pairs of equally long texts with a changed end: n - c of n + c shingles are common
        n, c = rng.choice([(90, 10), (99, 10), (120, 12), (180, 20), (110, 13), (80, 10)])
        words = [f"p{k}w{i}" for i in range(n + 4)]
        texts += [" ".join(words), " ".join(words[: n + 4 - c] + [f"q{k}x{i}" for i in range(c)])]
        if 100 * (n - c) >= 80 * (n + c):
            gone.add(2 * k + 1)
    assert 60 < len(gone) < 120
    assert {r.doc_id for r in minhash.deduplicate(docs_of(spark, texts)).collect()} == set(range(240)) - gone
    assert minhash.deduplicate(docs_of(spark, texts), percent=85).count() == 240


# ---------------------------------------------------------------- 3 lines


def test_recurring_templates_are_dropped(spark):
    passage = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    texts = [
        f"own first line of one\n{passage}\nPage 1 of the long report", f"{passage}\nown second line of two here", "Page 27 of the long report\nown third line of three",
        "the quick brown fox jumps over one lazy dog today\nkeep me here alone", "the quick brown fox jumps over two lazy dog today", "short line\nshort line", None, "", passage,
    ]
    df = docs_of(spark, texts)
    got = {r.doc_id: r.text for r in lines.dedup(df).collect()}
    assert lines.dedup(df).columns == df.columns
    assert got[0] == texts[0] and got[1] == "own second line of two here" and got[2] == "own third line of three"
    assert got[3] == texts[3] and got[5] == texts[5] and got[6] is None and got[7] == ""
    assert 4 not in got and 8 not in got  # a variable field apart, and a whole copy


def test_lines_edges(spark):
    assert lines.dedup(docs_of(spark, ["a b c d e"]).limit(0)).collect() == []
    twice = docs_of(spark, ["one and the same line\none and the same line"])
    assert lines.dedup(twice.unionByName(twice)).count() == 2  # one document, twice: nothing recurs across documents
    clash = spark.createDataFrame([(1, "a b c d e", 1, 2), (2, "a b c d e", 3, 4)], "doc_id long, text string, dropped int, row int")
    assert [tuple(r) for r in lines.dedup(clash).collect()] == [(1, "a b c d e", 1, 2)]


def test_a_leaf_has_several_templates(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    one = lambda: f"in the same order {word()} was sent by post to our house".split()
    two = lambda: f"in the same week {word()} came back from school with a cold".split()
    natural = [["in", "the", "same"] + [rng.choice(["order", "of", "was", "to", word()])] + [rng.choice([word(), word(), "of", "to"]) for _ in range(len(one()) - 4)] for _ in range(60)]
    assert len(one()) == len(two())
    texts = [" ".join(f()) + "\n" + " ".join(n) for f, n in zip([one, two] * 4 + [lambda: ["x"]] * 52, natural)]
    got = {r.doc_id: r.dropped for r in lines.recurring_lines(docs_of(spark, texts)).collect()}
    assert got == {i: [0] for i in range(2, 8)}  # the first line of each template stays, and all natural lines


def test_lines_against_their_sql_on_crowded_leaves(spark, tmp_path):
    """Many templates in few leaves, groups of equal size, lines far over a page: the query's SQL has the same rows."""
    import duckdb

    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    heads = ["once upon a", "at the end"]
    bodies = [[word(1) for _ in range(rng.choice([6, 6, 7, 9]))] for _ in range(25)]
    line = lambda: " ".join([rng.choice(heads), *(w if rng.random() < 0.85 else word(2) for w in rng.choice(bodies))])
    texts = ["\n".join(line() + (f" {rng.randrange(9)}x" if rng.random() < 0.2 else "") for _ in range(rng.randrange(12))) for _ in range(150)]
    texts += ["\n".join(line() for _ in range(300)), texts[0], texts[1], "a\tb  c d e\r\na b c d e", "very long " + "word " * 30_000 + "\nvery long " + "word " * 30_000, None, ""]
    docs = docs_of(spark, texts)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.dropped) for r in queries.op3_lines(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(con.execute(queries.OP3_SQL).fetchall())
    found = {i: d for i, _, _, d in got}
    assert found[151] == ",".join(map(str, range(len(texts[0].split("\n"))))) and found[153] == ""


# ---------------------------------------------------------------- 4 personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((kind, *m.span()))
    return out


def test_base_patterns_are_the_plain_ones():
    rng = random.Random(2)
    for _ in range(20_000):
        text = "".join(rng.choice("0123456789..@@--++ ()ab%Z\n") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == brute_pii(text)
    assert pii.emails("a" * 100_000 + "@" + "1." * 100_000) == [(0, 300_000)]


def test_field_learns_its_table_and_adds_other_forms():
    field = pii.default_field()
    found = lambda t: [(k, t[s:e]) for k, s, e in pii.spans_of([t], field)[0][1]]
    assert found("Reach me at (312) 555-7788 tonight") == [("phone", "(312) 555-7788")]
    assert found("write to kate dot moss at example dot org today") == [("email", "kate dot moss at example dot org")]
    assert found("Host 10[.]20[.]30[.]40 was down") == [("ip", "10[.]20[.]30[.]40")]
    assert found("The year 1998 and 2004, version 3.2.1, page 12-19") == []
    text = "mail a.b@c.org or +1 (988) 555-2485 now"
    base, added = pii.spans_of([text], field)[0]
    assert [k for k, _, _ in base] == ["email", "phone"] and not added


def test_field_likelihood_gradient_is_exact_enough():
    field = pii.default_field()
    wrong = 0
    for line in pii.LABELLED.strip().splitlines():
        text, spans = pii.unmarked(line)
        tokens = pii.tokens_of(text)
        wrong += pii._labelled_spans(tokens, field.decode([pii.Stretch(tokens)])[0]) != spans
    assert wrong == 0


#: Forms and names that aren't in the module's tables.
UNSEEN = """
{w} {w} [email|{n}.{n} at {d} dot {t}] {w} {w}
{w} [email|{n} (AT) {d} (DOT) {t}] {w}
{w} {w} [email|{n}{q} at {d} dot {d} dot {t}], {w}
{w} [email|{n}-{n} at {d}-{d} dot {t}] {w} {w}
{w}: [email|{n} [at] {d}.{t}] {w}
{w} [email|{n} arobase {d}-{d} point {t}] {w}
{w} {w} [email|{n} punkt {n} at {d} punkt {t}] {w}
{w} {w} call us on [phone|(0{q}) {qqq} {qqqq}] {w}
{w} phone [phone|{qqq}.{qqq}.{qqqq}] {w} {w}
{w} [phone|({qqq}){qqq}-{qqqq}] {w} {w}
{w} Tel. [phone|0{qqqq}/{qqqq}{qq}] {w}
{w} téléphone [phone|0{q}-{qq}-{qq}-{qq}-{qq}] {w}
{w} [phone|+1 ({qqq}) {qqq}-{qqqq}] {qqqq} {qq} {w}
{w} [ip|{qq}[.]{qq}[.]1{qq}[.]{q}] {w}
{w} ssn {qqq}-{qq}-{qqqq} {w} {w}
{w} order {qqq} {qqq} {qqqq} {w}
{w} invoice {qqqq}-{qqq} of 20{qq}-0{q}-1{q} {w}
{w} {w} at {w}. {w} {w} dot {w}
{w} at {w} and {qq} {w} of {qqq}
{w} {qqqq} {qqqq} {w} {q}.{q}.{q} {w}
"""


def unseen(rng):
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9)))
    for form in UNSEEN.strip().splitlines():
        line = re.sub(r"\{(q+)\}", lambda m: "".join(rng.choice("123456789") for _ in m[1]), form)
        yield pii.unmarked(re.sub(r"\{([wndt])\}", lambda m: rng.choice(["com", "org", "net", "de", "fr"]) if m[1] == "t" else word(), line))


def test_the_field_on_forms_outside_its_table():
    rng, field = random.Random(3), pii.default_field()
    lines = [x for _ in range(40) for x in unseen(rng)]
    filler = "and then they walked on to the town, where nothing was said of it. "
    texts = [filler * 3 + t + " " + filler for t, _ in lines]
    found = [{s for s in a if s[1] >= len(filler) * 3} for (_, a), _ in zip(pii.spans_of(texts, field), texts)]
    shift = len(filler) * 3
    want = [{(k, s + shift, e + shift) for k, s, e in spans} for _, spans in lines]
    hit, said, true = (sum(len(x) for x in y) for y in ([f & w for f, w in zip(found, want)], found, want))
    assert hit / true >= 0.9 and hit / said >= 0.9, (hit, said, true)


def test_stretches_decode_as_whole_lines_do():
    """Labels of whole lines under the rule equal those of the stretches, and everything else is O."""
    rng, field = random.Random(4), pii.default_field()
    text = " ".join(t + " " + " ".join("so it went on for a while".split() * rng.randint(0, 9)) for _ in range(6) for t, _ in unseen(rng))
    tokens = pii.tokens_of(text)
    whole = field.decode([pii.Stretch(tokens, free=pii.free(tokens))])[0]
    parts = pii.stretches(text)
    found = {t: y for s, labels in zip(parts, field.decode(parts)) for t, y in zip(s.tokens, labels.tolist()) if y}
    assert len(parts) > 20 and sum(len(s.tokens) for s in parts) < len(tokens)
    assert found == {t: y for t, y in zip(tokens, whole.tolist()) if y}


#: Lines that no row of the field's tables gives, and what is to be found in them.
HELD_OUT = [
    ("bob at example dot com", "email|bob at example dot com"), ("jane punkt doe at firma punkt de", "email|jane punkt doe at firma punkt de"), ("r.lee [at] uni-bonn [dot] de", "email|r.lee [at] uni-bonn [dot] de"),
    ("k dot meyer at t-online dot de", "email|k dot meyer at t-online dot de"), ("reach me on 030/4455667", "phone|030/4455667"), ("tel 0171 2345678", "phone|0171 2345678"), ("pat_at_example_dot_com", "email|pat_at_example_dot_com"),
    ("please ring 0341 998877 today", "phone|0341 998877"), ("ruf an: 0221-4455-66 bitte", "phone|0221-4455-66"), ("lee (at) t-online (dot) de", "email|lee (at) t-online (dot) de"), ("handy 0160/1234567", "phone|0160/1234567"),
    ("Fon 06221 54 12 34", "phone|06221 54 12 34"), ("tel: 01 44 55 66 77", "phone|01 44 55 66 77"), ("ask x_y at mail dot net or wait", "email|x_y at mail dot net"), ("fax: 089 1234-567", "phone|089 1234-567"),
    ("card 4012 / 8888 / 8888 / 1881 here", "card|4012 / 8888 / 8888 / 1881"), ("contact sue {at} acme {dot} org", "email|sue {at} acme {dot} org"), ("my number is 0151 23 45 67 89", "phone|0151 23 45 67 89"), ("host 192 . 168 . 1 . 4 is down", "ip|192 . 168 . 1 . 4"),
    *((t, "") for t in (
        "the 12 of 300 people at the dot of 5", "in 2019 we sold 3000 at 20.5 per cent", "order 123 456 7890 and invoice 2020-11", "at 10:30 on 12.05.2017 in room 42", "look at this dot it is small", "lines 100-200 and 300-400 of the file",
        "ratio 3/4 and 030/44 of it", "he was at the office at 9 dot on time", "isbn 978-3-16-148410-0", "http://a.com/2020/05/17/12345.html", "2024-01-31T12:00:00", "12 34 56 78 90 numbers of the lottery",
    )),
]


def test_spans_planted_among_documents(spark):
    """Where no field finds anything by itself, planted spans are found with their bounds, and nothing else."""
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").orderBy("doc_id").collect()][:300]
    field = pii.default_field()
    before = [a for _, a in pii.spans_of(docs, field)]
    planted = [f"{t}\n{line}\n{t[:200]}" for t, (line, _) in zip(docs, HELD_OUT * 10) if t]
    wanted = [(len(t) + 1 + line.find(w.partition("|")[2]), w) for t, (line, w) in zip(docs, HELD_OUT * 10) if t]
    hits = wrong = 0
    for (at, w), text, (_, added) in zip(wanted, planted, pii.spans_of(planted, field)):
        found = {(k, s, e) for k, s, e in added}
        kind, _, inner = w.partition("|")
        hits += bool(w) and (kind, at, at + len(inner)) in found
        wrong += len(found - {(kind, at, at + len(inner))})
    true = sum(1 for _, w in wanted if w)
    assert hits >= 0.95 * true and wrong <= 0.02 * true, (hits, wrong, true)
    assert sum(map(len, before)) <= 0.01 * len(docs)


def test_long_lines_take_little_memory():
    import tracemalloc

    numbers, table = " ".join(str(i * 7919 % 100_000) for i in range(60_000)), ",".join(f"{i},{i * 31 % 997}.{i % 10},x{i % 7}" for i in range(20_000))
    field = pii.default_field()
    for text in (numbers, table):
        assert len(text) > 250_000 and "\n" not in text
        tracemalloc.start()
        pii.spans_of([text, "call 0171 2345678"], field)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 600 * len(text), peak / len(text)


def test_pii_rows(spark):
    rows = pii.find(docs_of(spark, [None, "", "x@y.zz 1.2.3.4", "x@y.zz 1.2.3.4"])).collect()
    assert [(r.n_email, r.n_ip, r.n_card, r.n_phone) for r in rows] == [(0, 0, 0, 0)] * 2 + [(1, 1, 0, 0)] * 2
    assert rows[0].base_sha256 == hashlib.sha256(b"").hexdigest() and rows[2].spans == "email:0:6,ip:7:14"
    assert rows[2].base_sha256 == hashlib.sha256(b"email:0:6,ip:7:14").hexdigest()
    assert pii.find(docs_of(spark, ["x"]).limit(0)).collect() == []


# ---------------------------------------------------------------- 5 and 9 classifiers


@pytest.mark.parametrize(("kind", "least"), [("quality", 0.95), ("toxic", 0.9)])
def test_held_out_labels(spark, kind, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score(docs, quality.fit(docs, labels)) if kind == "quality" else toxicity.score(docs, toxicity.fit(docs, labels))
    rows = quality.predictions(scored, 0.3 if kind == "quality" else 0.5).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 30 and sum(r.predicted == r[kind] for r in rows) / len(rows) >= least
    assert all(0 <= r.score <= 1 for r in rows)


def test_prior_estimate():
    rng = np.random.default_rng(0)
    positive = np.hstack([rng.normal(3, 1, (2000, 2)), np.ones((2000, 1))])
    other = np.hstack([np.where(rng.random((4000, 1)) < 0.7, rng.normal(3, 1, (4000, 2)), rng.normal(-3, 1, (4000, 2))), np.ones((4000, 1))])
    assert abs(quality.estimate_prior(positive, lambda w: quality.sums(other, w)) - 0.7) < 0.07


def test_unlabelled_sums(spark):
    """What Spark sums up over the features of all texts, against numpy."""
    texts = ["a b c", None, "", "Some more words, and some more!", "a b c", "| x | y |\n" * 50, "word " * 30_000]
    table = quality._measured(docs_of(spark, texts).repartition(3))
    x = np.array([quality.features((t or "").encode()) for t in texts])
    rows = quality.Unlabelled(table)
    n, total, squares = rows.moments()
    assert n == len(texts) and np.allclose(total, x.sum(0)) and np.allclose(squares, (x * x).sum(0))
    w = np.linspace(-1, 1, x.shape[1])
    assert np.allclose(rows.sums(lambda x: x, w), quality.sums(x, w))
    assert quality.Unlabelled(table.limit(0)).moments()[0] == 0


def test_gradient_of_the_risk():
    """The gradients that Newton's steps follow, against differences of the risk."""
    rng = np.random.default_rng(1)
    positive, other = rng.normal(1, 1, (50, 3)), rng.normal(0, 1, (80, 3))
    seen = []
    quality_newton, quality.newton = quality.newton, lambda objective, size: seen.append(objective)
    try:
        quality.least_risk(positive, lambda w: quality.sums(other, w), 0.6, 1e-3)
    finally:
        quality.newton = quality_newton
    for w in (np.zeros(3), rng.normal(0, 1, 3), np.full(3, 2.0)):
        value, gradient, second = seen[0](w)
        moved = [(seen[0](w + d)[0] - seen[0](w - d)[0]) / 2e-6 for d in np.eye(3) * 1e-6]
        assert np.allclose(moved, gradient, atol=1e-5) and np.linalg.eigvalsh(second).min() > 0


def test_classifiers_without_labels(spark):
    docs, none = docs_of(spark, ["a b", None, ""]), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality.score(docs, quality.fit(docs, none)).collect()] == [quality.DEFAULT_PRIOR] * 3
    assert [r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()] == [0.0] * 3
    assert toxicity.clean(docs, toxicity.fit(docs, none)).count() == 3


def test_restoring_obfuscated_words():
    count = Counter()
    for w in "idiot moron loser stupid trash the and of you are such a complete".split() * 5:
        full = f"\x02\x02{w}\x03"
        count.update(map("".join, zip(full, full[1:], full[2:])))
    model = toxicity.CharacterModel(count)
    typed = {"1d10t": "idiot", "m0r0n": "moron", "l0s3r": "loser", "st*u*p*i*d": "stupid", "idiooooot": "idiot", "tr@sh": "trash", "$tup!d": "stupid", "4nd": "and"}
    assert {t: toxicity.restore(t, model) for t in typed} == typed
    assert "idiot" in toxicity.tokens("you i d i o t you") and "stupid" in toxicity.tokens("s.t.u.p.i.d!")


def test_restoring_spaced_joined_and_long_words():
    count = Counter()
    for w in "idiot moron loser stupid trash the and of you are such a a a complete person".split() * 5:
        full = f"\x02\x02{w}\x03"
        count.update(map("".join, zip(full, full[1:], full[2:])))
    read = toxicity.Reader(toxicity.CharacterModel(count))
    typed = {
        "you are a s t u p i d person": "stupid", "y o u i d i o t": "idiot", "1 d 1 o t": "idiot", "$ t u p 1 d": "stupid", "you i d ! o t !": "idiot",
        "id" + "i" * 60 + "ot": "idiot", "such,a/complete.idiot,you;are-such/a/complete,moron/you.person": "moron", "m o r o n": "moron",
        "the/m0r0n/of": "moron", "the-" * 5_000 + "l0ser": "loser",
    }
    assert {t for t, w in typed.items() if not any(w in words for words in read.words(t))} == set()
    assert all("idiot" not in words for t in ("i d o 1 2 3", "a b c d e f") for words in read.words(t))


def test_separable_labels_do_not_break_the_fit():
    model = toxicity.Model(toxicity.CharacterModel({}), {}, 1, 1)
    y = (np.arange(20_000) % 10 == 0).astype(float)
    x = np.column_stack([np.ones(20_000), 9 * y, 3 * y, 2 * y])
    model.fit(x, y)
    p = 1 / (1 + np.exp(-x @ model.coefficients))
    assert model.fitted and p[y == 1].min() > 0.95 and p[y == 0].max() < 0.05


def test_obfuscated_documents_are_caught(spark):
    rng = random.Random(1)
    plain = "the and of with from house river garden winter summer people morning stone letter".split()
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(30)]
        if i % 4 == 0:
            words[rng.randrange(30)] = rng.choice(["idiot", "moron", "scum"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    hidden = ["the house 1d10t of river", "the m o r o n of winter", "people are scuuuum in summer", "the garden of winter 12 and 3 people"]
    docs = spark.createDataFrame(rows + list(enumerate(hidden, 1000)), "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.score(docs, model).where("doc_id >= 1000").collect()}
    assert got == {1000: True, 1001: True, 1002: True, 1003: False}


def test_all_labelled_rows_are_learned_from(spark, monkeypatch):
    words = "array('idiot', 'm0ron', 'winter', 'house', 'Garden,', 'river', 'of')"
    docs = spark.range(30_000).selectExpr("id AS doc_id", f"concat_ws(' ', element_at({words}, int(crc32(string(id)) % 7) + 1), element_at({words}, int(id % 5) + 3), 'w' || id % 11) AS text")
    labels = docs.selectExpr("doc_id", "int(text LIKE '%idiot%' OR text LIKE '%m0ron%') AS toxic")
    rows = {r.doc_id: (r.text, r.toxic) for r in docs.join(labels, "doc_id").where("crc32(string(doc_id)) % 5 <> 0").collect()}
    model = toxicity.fit(docs, labels)
    assert len(rows) > 23_000 and (model.toxic, model.other) == (sum(t for _, t in rows.values()), sum(1 - t for _, t in rows.values()))
    read, grams, held = toxicity.Reader(model.characters), Counter(), {0: Counter(), 1: Counter()}
    for text, toxic in rows.values():
        for word in {w.strip(",") for w in text.lower().split()}:
            if word.isalpha():
                grams.update(f"\x02\x02{word}\x03"[k : k + 3] for k in range(len(word) + 1))
        held[toxic].update(set().union(*read.words(text)))
    assert model.characters.three == grams
    assert model.counts and all((held[1][w], held[0][w]) == n for w, n in model.counts.items())
    inputs = lambda text, toxic: [model.token_weight(read(t), toxic) for t in set(toxicity.tokens(text))]
    local = toxicity.Model(model.characters, model.counts, model.toxic, model.other)
    local.fit(np.array([local.inputs(inputs(*r)) for r in rows.values()]), np.array([float(t) for _, t in rows.values()]))
    assert np.allclose(local.coefficients, model.coefficients, atol=1e-5)
    monkeypatch.setattr(toxicity, "MOST_BROADCAST", 0)
    shuffled = toxicity.fit(docs, labels)
    assert shuffled.counts == model.counts and np.allclose(shuffled.coefficients, model.coefficients, atol=1e-5)


def test_trigrams_of_many_words_take_little_memory():
    rng = random.Random(5)
    count = Counter({"".join(rng.choices("abcdefgh", k=12)): i % 3 + 1 for i in range(100_000)})
    count["w0rd"] = 4
    plain = Counter()
    for word, n in count.items():
        if word.isalpha():
            for k in range(len(word) + 1):
                plain[f"\x02\x02{word}\x03"[k : k + 3]] += n
    got = Counter()
    tracemalloc.start()
    for batch in toxicity._trigrams(count):
        for gram, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            got[gram] += n
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == plain
    assert most < 40e6
    assert not list(toxicity._trigrams(Counter()))


# ---------------------------------------------------------------- 6 decontamination


@pytest.mark.parametrize("limit", [decontamination.SHARD_BYTES, 60])
def test_clean_sends_texts_once_and_drops_what_any_shard_hits(spark, limit):
    items = [(f"i{k}", " ".join(f"b{k}x{j}" for j in range(12))) for k in range(6)]
    texts = [f"before {text.upper()} after" for _, text in items] + [" ".join(items[0][1].split()[:9]), "", None, "own words only"]
    docs = docs_of(spark, texts).selectExpr("*", "'mine' AS items", "doc_id AS n_hit")
    kept = decontamination.clean(docs, spark.createDataFrame(items, "item_id string, text string"), limit=limit)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    assert {(r.doc_id, r.text, r.items, r.n_hit) for r in kept.collect()} == {(i, t, "mine", i) for i, t in enumerate(texts) if i > 5}
    assert "struct(" not in kept._jdf.queryExecution().analyzed().toString()


def brute_hits(text, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        for at in range(max(1, len(w) - n + 1) if w else 0):
            window = w[at : at + n]
            for i in range(len(own) - len(window) + 1):
                if own[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    found.add(item)
    return len(own), len(hit), sorted(found)


@pytest.mark.parametrize("limit", [1 << 20, 60])
def test_decontamination_against_brute_force(spark, limit):
    rng = random.Random(4)
    vocabulary = ["a", "b", "c", "É", "é", "d1"]
    items = [(str(i), " ".join(rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 12, 15])))) for i in range(8)] + [("9", None), ("10", "..."), ("11", "A,b;C!d1")]
    texts = [", ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60))) for _ in range(40)] + [None, "", items[2][1], "x" + items[2][1]]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, items int")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontamination.find(df, bench, limit=limit).collect()}
    assert got == {i: brute_hits(t, items) for i, t in enumerate(texts)}
    for r in decontamination.find(df, bench, limit=limit).where("n_hit > 0").collect():
        text = texts[r.doc_id]
        assert sum(len(decontamination.words(text[s.start : s.end])) for s in r.spans) == r.n_hit
    clean = decontamination.clean(df, bench)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {i for i, t in enumerate(texts) if not brute_hits(t, items)[1]}


def test_empty_benchmark(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontamination.find(docs_of(spark, ["a b"]), none).collect()] == [0]


def test_symbols_of_two_characters_find_the_same():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(str(i), " ".join(rng.choices(vocabulary, k=rng.randint(1, 14)))) for i in range(60)]
    one, two = (decontamination.Automaton(items, 4, most) for most in (1000, 10))
    assert (one.width, two.width) == (1, 2)
    for _ in range(200):
        text = decontamination.words(" ".join(rng.choices([*vocabulary, "foreign"], k=30) + rng.choice(items)[1].split()))
        assert one.hits(text) == two.hits(text)
    some = [two._symbol(i) for i in (0, 1, 0x3FFF, 0x4000, 1_200_000, 4_000_000)]
    assert len(set(some)) == 6 and all(len(x) == 2 and x.encode() for x in some)


# ---------------------------------------------------------------- 7 archives


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    payloads = [b"", b"<p>\r\n\r\nWARC/1.0\nx</p>", "é€".encode() * 50, b"\xff\x00binary"]
    data = archives.arc_file([(i, f"http://a/{i}", p) for i, p in enumerate(payloads)], version, "20240131120000", "f.arc")
    got = list(archives.read_arc(data))
    assert [g["arc_type"] for g in got] == ["warcinfo"] + ["response"] * 4 and [g["payload"] for g in got[1:]] == payloads
    assert got[1]["date"] == "2024-01-31T12:00:00Z" and [g["page_id"] for g in got[1:]] == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        list(archives.read_arc(data[:-5]))
    warc = b"".join(archives.warc_record(g, None) + b"\r\n\r\n" for g in got)
    back = list(archives.read_warc(warc))
    assert [b["payload"] for b in back[1:]] == payloads and back[1]["record_id"] == list(archives.read_warc(warc))[1]["record_id"]
    assert [b["payload_digest"] for b in back[1:]] == [hashlib.sha1(p).hexdigest() for p in payloads]


def test_warc_files_have_a_member_a_record_and_name_what_revisits_refer_to(spark, tmp_path):
    import zlib as z

    pages = [(i, f"http://a/{i}", "x" * 1200 if i % 3 else f"y{i}" * 700) for i in range(30)] + [(40, "http://a/short", "s"), (41, "http://a/short2", "s")]
    rows = archives.arc_records(archives.arc_files(spark.createDataFrame(pages, "page_id long, url string, html string")))
    archives.to_warc(rows, str(tmp_path / "w"), Scratch(spark, "t"))
    ids, named, members = {}, [], 0
    for file in (tmp_path / "w").glob("part-*"):
        data = file.read_bytes()
        while data:
            member = z.decompressobj(wbits=31)
            record, data = member.decompress(data) + member.flush(), member.unused_data
            if not record:
                continue
            head = dict(x.split(": ", 1) for x in record.partition(b"\r\n\r\n")[0].decode().split("\r\n")[1:])
            assert record.startswith(b"WARC/1.0\r\n") and record.endswith(b"\r\n\r\n") and record.count(b"WARC/1.0") == 1
            members += head["WARC-Type"] != "warcinfo"
            ids[head["WARC-Record-ID"]] = head
            if head["WARC-Type"] == "revisit":
                named.append(head)
    assert members == 32 == sum(h["WARC-Type"] != "warcinfo" for h in ids.values()) and len(named) == 19
    for head in named:
        there = ids[head["WARC-Refers-To"]]
        assert there["WARC-Type"] == "response" and there["WARC-Payload-Digest"] == head["WARC-Payload-Digest"]
        assert (there["WARC-Target-URI"], there["WARC-Date"]) == (head["WARC-Refers-To-Target-URI"], head["WARC-Refers-To-Date"])


def test_members_are_inflated_one_after_the_other():
    import gzip

    parts = [b"", b"a" * 10, bytes(range(256)) * 2000, b"", b"end"]
    assert archives.inflate(b"".join(gzip.compress(p) for p in parts)) == b"".join(parts) and archives.inflate(b"plain") == b"plain"


def test_archives_through_spark(spark):
    big, small = "<p>" + "x" * 1000, "tiny"
    rows = [(1, "http://a b/1", big, 1), (2, None, big, 1), (5, "http://a/5", big, 1), (3, "http://a/3", small, 1), (4, "http://a/4", small, 1), (6, "http://a/6", None, 1), (7, "http://a/7", "\r\n\r\nWARC/1.0", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    got = {r.page_id: r for r in archives.convert(archives.arc_files(pages)).where("type <> 'warcinfo'").collect()}
    assert {i: (r.type, r.refers_to) for i, r in got.items()} == {1: ("revisit", 5), 2: ("revisit", 5), 5: ("response", None), 3: ("response", None), 4: ("response", None), 6: ("response", None), 7: ("response", None)}
    for i, _, html, _ in rows:
        data = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    assert got[1].url == "http://a%20b/1"
    assert archives.convert(archives.arc_files(pages.limit(0))).collect() == []


def test_pages_without_an_id_large_ones_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(archives, "FILE_BYTES", 4000)
    big = "<p>" + "x" * 3000
    rows = [(None, "http://a/0", big), (3, "http://a/3", big), (None, "http://a/0", "small"), (4, "http://a/4", big), (4, "http://a/4", big), (5, "http://a/5", "y" * 20_000)]
    got = archives.convert(archives.arc_files(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))).where("type <> 'warcinfo'").collect()
    want = [(None, "response", None, 3003), (None, "response", None, 5), (3, "revisit", 4, 3003), (4, "response", None, 3003), (4, "response", None, 3003), (5, "response", None, 20_000)]
    key = lambda x: (x[0] or 0, x[3])
    assert sorted(((r.page_id, r.type, r.refers_to, r.payload_bytes) for r in got), key=key) == sorted(want, key=key)


def test_partial_dates():
    assert [archives.iso_date(d) for d in ("1999", "199907", "19990715083000")] == ["1999-01-01T00:00:00Z", "1999-07-01T00:00:00Z", "1999-07-15T08:30:00Z"]


def test_inflating_members_of_all_sizes():
    rng = random.Random(3)
    parts = [rng.randbytes(n) for n in (0, 1, 2020, 2048, 2049, 6100, 6144, 65_500, 65_536, 200_000, 0, 5)]
    assert archives.inflate(archives.NOTHING.join(gzip.compress(p, archives.LEVEL, mtime=0) for p in parts)) == b"".join(parts)


# ---------------------------------------------------------------- 8 packing


def test_packing_holds_its_contract(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer())
    texts = [None, "", "a b", "x" * 5000, "word, " * 3000, "  odd \n spaces\t", "it's 12 cats", "<|endoftext|> a"] + [f"text {i} " * (i % 700) for i in range(200)]
    got = packing.pack_documents(docs_of(spark, texts), tokenizer()).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts):
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces))) and sum(r.length for r in pieces) == len(ids)
        assert all(r.length == 1024 for r in pieces[1:])
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for rows in by_sequence.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == list(np.cumsum([0] + [r.length for r in rows])[:-1]) and sum(r.length for r in rows) <= 1024
    assert len(by_sequence) <= 1.05 * math.ceil(sum(r.length for r in got) / 1024) + 1


def test_bounded_best_fit():
    packer = packing.BestFit(10, 2)
    assert [packer.place(n) for n in (6, 7, 3, 4, 8, 9, 2)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0), (2, 8)]
    packer = packing.BestFit(10, 1)
    assert [packer.place(n)[0] for n in (4, 7, 3, 3)] == [0, 1, 0, 0]  # the fullest open bin closes


def test_the_bound_acts_and_costs_little():
    rng = np.random.default_rng(0)
    lengths = np.where(rng.random(60_000) < 0.3, 1024, rng.integers(1, 1025, 60_000))
    packer = packing.BestFit(1024, packing.OPEN_BINS)
    for at in range(0, len(lengths), packing.LOOK_AHEAD):
        for n in -np.sort(-lengths[at : at + packing.LOOK_AHEAD]):
            packer.place(int(n))
    assert packer.closed > 0 and packer.open <= packing.OPEN_BINS
    assert packer.bins <= 1.02 * -(-lengths.sum() // 1024)


def test_rows_without_an_id_share_no_packer(spark):
    rows = spark.createDataFrame([(None, "a"), (None, "b"), (7, "a")] * 400, "doc_id long, text string")
    pieces = packing.token_pieces(rows, tokenizer(), 64)
    scratch = Scratch(spark, "t")
    kept = scratch.keep(pieces, "pieces")
    got = packing.pack(kept, kept.count(), 64, a_packer=100).collect()
    packers = Counter(r.sequence_id >> 32 for r in got)
    assert len(got) == 1200 and len(packers) == 12 and max(packers.values()) < 200
    assert sum(r.length for r in got) == sum(r.length for r in kept.collect())


def test_nothing_to_pack(spark):
    assert packing.pack_documents(docs_of(spark, ["a"]).limit(0), tokenizer()).collect() == []


# ---------------------------------------------------------------- 10 scoring


@pytest.mark.parametrize("seed", range(4))
def test_exchange_ends_in_a_local_optimum(seed):
    follows = np.random.default_rng(seed).poisson(0.3 + seed, (40, 40)) * [1, 1, 1000, 37][seed]
    of = brown.exchange(follows, 6)

    def information(classes):
        t = brown._counted(follows.astype(float), classes, 6)
        p = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return p(t) - p(t.sum(1)) - p(t.sum(0))

    best, total = information(of), follows.sum()
    assert all(information(np.where(np.arange(40) == u, c, of)) <= best + 1e-9 * total * np.log(total) for u in range(1, 40) for c in range(1, 6))


def test_exchange_ends_with_large_counts():
    rng = np.random.default_rng(1)
    of = brown.exchange(rng.zipf(1.3, (60, 60)).clip(max=10**6) * 997_331, 8)
    assert len(set(of.tolist())) > 2 and of[0] == 0 and (of[1:] > 0).all()


@pytest.mark.parametrize("carried", [100_000, 5])
def test_base_score_and_model_against_brute_force(spark, carried):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()][:60] + [(9001, None), (9002, ""), (9003, "zzz zzz unseen")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1))
    got = {r.doc_id: r for r in brown.score(df, classes=8, units=50, carried=carried).collect()}
    words = lambda t: (t or "").encode().lower().split() + [b"\n"]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    count = Counter(w for i, t in rows if not held(i) for w in words(t))
    total, kinds = sum(count.values()), len(count)
    for i, t in rows:
        w, r = words(t), got[i]
        base = sum(math.log10((count[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(w), sum(count[x] > 0 for x in w), total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and math.isfinite(r.score) and r.score < 0


@pytest.mark.parametrize("carried", [100_000, 60, 12])
def test_classes_and_score_against_brute_force(spark, monkeypatch, carried):
    """Given the exchanged words' classes, all counts, every other word's class and all scores are recomputed in plain Python."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()][:50]
    rows += [(9001, None), (9002, ""), (9003, "zzz zzz unseen"), rows[0], (9004, rows[1][1]), (9005, "word " * 30_000 + "rareword")]
    seen = {}
    monkeypatch.setattr(brown, "fit", lambda *a, run=brown.fit: seen.setdefault("fit", run(*a)))
    monkeypatch.setattr(brown, "sweeps", lambda *a, run=brown.sweeps: seen.setdefault("sweeps", run(*a)))
    monkeypatch.setattr(brown, "heavy", lambda *a, run=brown.heavy: seen.setdefault("top", run(*a)))
    K, least = 6, 20
    got = brown.score(spark.createDataFrame(rows, "doc_id long, text string"), classes=K, units=10, carried=carried, least=least).collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    texts = [(i, [b"\n"] + (t or "").encode().lower().split() + [b"\n"]) for i, t in rows]
    train = [w for i, w in texts if not held(i)]
    count = Counter(x for w in train for x in w[1:])
    by_size = sorted(((w, n) for w, n in count.items() if w != b"\n"), key=lambda x: (-x[1], x[0]))
    top = seen["top"]
    assert top == [w for w, _ in by_size[:carried]]
    of, exchanged, many, rising, between_ = seen["sweeps"]
    assert many.tolist() == [count[w] for w in [*top, b"\n"]] and all(x < y for x, y in zip(rising, rising[1:]))
    assert [c >= 0 for c in exchanged] == [i < 10 or count[w] >= least for i, w in enumerate(top)]
    cls = {w: int(c) for w, c in zip(top, exchanged) if c >= 0} | {b"\n": 0}
    follows = np.zeros((K, K))
    for w in train:
        for x, y in zip(w, w[1:]):
            if x in cls and y in cls:
                follows[cls[x], cls[y]] += 1
    assert (between_ == follows).all()
    after, before = brown.gains(follows)
    votes = {}
    for w in train:
        for x, y, z in zip(w, w[1:], w[2:]):
            if y not in cls:
                votes[y] = votes.get(y, 0) + after[cls.get(x, K)] + before[cls.get(z, K)]
    table = {r.word.encode(): (r["class"], r.n) for r in seen["fit"][1].collect()}
    assert {w: n for w, (_, n) in table.items()} == {w: n for w, n in count.items() if w not in top and w != b"\n"}
    final = {w: int(c) for w, c in zip(top, of)} | {w: c for w, (c, _) in table.items()} | {b"\n": 0}
    assert all(final[w] == c for w, c in cls.items()) and all(v[final[w]] >= v.max() - 1e-9 for w, v in votes.items())
    cls = final
    size, kinds, between = np.zeros(K), np.zeros(K), np.zeros((K, K))
    for w, n in count.items():
        size[cls[w]] += n
        kinds[cls[w]] += 1
    for w in train:
        for x, y in zip(w, w[1:]):
            between[cls[x], cls[y]] += 1
    unseen = 1 + int(np.argmax(kinds[1:]))
    want = []
    for i, w in texts:
        c = [cls.get(x, unseen) for x in w]
        total = sum(math.log10((between[a, b] + 0.1) / (between[a].sum() + 0.1 * K)) + math.log10((count[x] + 0.1) / (size[b] + 0.1 * (kinds[b] + 1))) for a, b, x in zip(c, c[1:], w[1:]))
        want.append((i, len(w) - 1, round(total, 4)))
    assert sorted((r.doc_id, r.n_tokens, round(r.score, 4)) for r in got) == sorted(want)


def test_contexts_and_their_table_against_brute_force(spark, monkeypatch):
    """Blocks of three words, words without a class and rare ones, a text of one word."""
    monkeypatch.setattr(brown, "BLOCK", 3)
    texts = ["a b c a", "d", None, "", "b x a d x", "c c c c c", "g f e d c b a"]
    top, of, K = [w.encode() for w in "abcdefg"], np.array([1, 2, -1, 3, 1, -1, 2]), 4
    numbers = brown.numbered(docs_of(spark, texts), top)
    kept = Scratch(spark, "t").keep(brown.contexts(numbers, of, K), "c")
    cells = {}
    for r in kept.collect():
        for cell, n in zip(np.frombuffer(r.cells, np.int32).tolist(), np.frombuffer(r.n, np.int64).tolist()):
            cells[(r.block * 3 + cell // (2 * (K + 1)), cell // (K + 1) % 2, cell % (K + 1))] = n
    cls = {w.decode(): int(c) for w, c in zip(top, of) if c >= 0} | {"\n": 0}
    place = {w.decode(): i for i, w in enumerate(top)} | {"\n": 7}
    want, table = Counter(), np.zeros((K, K))
    for t in texts:
        line = ["\n", *(t or "").split(), "\n"]
        for i, w in enumerate(line[1:], 1):
            if w in place:
                want[(place[w], 0, cls.get(line[i - 1], K))] += 1
                if w != "\n":
                    want[(place[w], 1, cls.get(line[i + 1], K))] += 1
            if w in cls and line[i - 1] in cls:
                table[cls[line[i - 1]], cls[w]] += 1
    assert cells == dict(want) and (brown.class_table(kept, of, K) == table).all()


def test_information_rises_every_sweep(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    top, scratch = brown.heavy(docs, 3000), Scratch(spark, "t")
    texts = scratch.keep(brown.numbered(docs, top), "numbered")
    of, exchanged, many, seen, _ = brown.sweeps(texts, np.where(np.arange(3000) < 50, 1 + np.arange(3000) % 15, -1), 16, scratch, least=25)
    assert len(seen) >= 3 and all(x < y for x, y in zip(seen, seen[1:])) and (exchanged >= 0).sum() > 500 and (of > 0).all()


def test_frequent_words_survive_the_bounded_count(spark):
    rng = random.Random(1)
    texts = [" ".join(["often", f"w{rng.randrange(10**6)}", rng.choice(["some", "more"]), f"v{rng.randrange(10**6)}"]) for _ in range(2000)]
    assert brown.heavy(docs_of(spark, texts).coalesce(1), 3, tracked=50) == [b"often", *sorted([b"more", b"some"], key=lambda w: -sum(w.decode() in t.split() for t in texts))]


def test_score_beats_single_words_on_held_out_texts(spark):
    got = brown.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_scoring_nothing(spark):
    assert brown.score(docs_of(spark, ["a"]).limit(0)).collect() == []


# ---------------------------------------------------------------- rows without an id, of all scoring operators


def test_scores_of_odd_rows(spark):
    """Null ids and texts, an empty one, repeated rows, a long one, columns with the results' names, labels of empty documents."""
    long_ = "word " * 40_000
    rows = [(i, f"good plain text number {i} of the set " + ("idiot stupid fool " if i % 3 == 0 else ""), 0.5, 1, "x") for i in range(60)]
    rows += [(None, "text without an id", 0.1, 0, "y"), (None, None, 0.1, 0, "y"), (100, "", 0.2, 1, "z"), (101, None, 0.2, 1, "z"), (5, rows[5][1], 0.5, 1, "x"), (102, long_, 0.3, 0, "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, predicted int, row string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 3 == 0)) for i in [*range(60), 100, 101, 102]] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    tox = quality.predictions(toxicity.score(docs, toxicity.fit(docs, labels)), toxicity.THRESHOLD).collect()
    good = quality.predictions(quality.score(docs, quality.fit(docs, labels)), quality.THRESHOLD).collect()
    lm = brown.score(docs.select("doc_id", "text", "row"), classes=4, units=20, least=5).collect()
    for got in (tox, good, lm):
        assert sorted(r.doc_id or -1 for r in got) == sorted(r[0] or -1 for r in rows)
        assert all(r.held_out is False for r in got if r.doc_id is None) and all(math.isfinite(r.score) for r in got)
        twice = [r.score for r in got if r.doc_id == 5]
        assert len(twice) == 2 and twice[0] == twice[1]
    assert {r.predicted for r in tox if r.doc_id is not None and r.doc_id < 60 and r.doc_id % 3 == 0} == {1} and {r.predicted for r in tox if r.doc_id in (100, 101, 102)} == {0}
    bench = spark.createDataFrame([(1, "idiot stupid fool"), (2, None), (None, "good plain text")], "item_id long, text string")
    hits = {(r.doc_id, r.n_words, r.n_hit > 0) for r in decontamination.find(docs.withColumn("spans", F.lit(1)), bench).collect()}
    assert (None, 0, False) in hits and (102, 40_000, False) in hits and (0, 11, True) in hits and (1, 8, False) in hits
