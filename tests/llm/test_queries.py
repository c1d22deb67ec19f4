"""The registered queries against their SQL, and the pipeline against its own rules."""

import re

import duckdb
import pytest

import corpus_pipeline
from marlspike.llm import queries, toxicity

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == names
    assert got == sorted((tuple(r[columns.index(c)] for c in names) for r in found.fetchall()), key=repr)


def by_hand(spark, docs, bench, tmp_path):
    """The stages without Spark's plans: one document after the other, SQL of another engine for the lines, all pairs for the copies, the tokenizer's own ids."""
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.read.parquet(f"{SF}/labels.parquet"))
    read = toxicity.Reader(model.characters)
    score = lambda t: model.score([w for w in (model.token_weight(read(x)) for x in set(toxicity.tokens(t))) if w])
    sizes = [len(docs)]
    kept = [(i, t) for i, t in docs if score(t or "") < toxicity.THRESHOLD]
    sizes.append(len(kept))

    spark.createDataFrame(kept, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    dropped = {i: {int(x) for x in d.split(",") if x} for i, _, _, d in con.execute(f"SELECT doc_id, n_lines, n_dropped, dropped FROM ({queries.ORACLE_SQL['op3_lines']})").fetchall()}
    after = []
    for i, t in kept:
        lines_ = (t or "").split("\n")
        left = "\n".join(x for n, x in enumerate(lines_) if n not in dropped[i])
        if not dropped[i] or left.replace("\n", " ").strip(" "):
            after.append((i, left if dropped[i] else t))
    sizes.append(len(after))

    words = lambda t: (t or "").encode().lower().split()
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := words(t)) else set() for i, t in after}
    first = {i: i for i in sets}

    def root(i):
        while first[i] != i:
            i = first[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                first[y] = x
    kept = [(i, t) for i, t in after if root(i) == i]
    sizes.append(len(kept))

    folded = lambda t: re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    windows = {tuple(w[j : j + min(10, len(w))]) for t in bench if (w := folded(t)) for j in range(max(1, len(w) - 9))}
    lengths = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[j : j + n]) in windows for n in lengths for j in range(len(w) - n + 1))
    kept = [(i, t) for i, t in kept if not hit(folded(t))]
    sizes.append(len(kept))

    tokenizer, pieces = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}
    for i, t in kept:
        tokens = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        head = len(tokens) % 1024 if len(tokens) > 1024 else len(tokens)
        starts = ([0] if head else []) + list(range(head, len(tokens), 1024))
        for k, (x, y) in enumerate(zip(starts, [*starts[1:], len(tokens)])):
            pieces[(i, k)] = (x, y - x, zlib.crc32(b"".join(n.to_bytes(4, "little") for n in tokens[x:y])))
    return pieces, sizes


def test_pipeline(spark, tmp_path):
    """Every piece of every document that is left, by hand; sequences are gapless and hold no more than they may."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want, sizes = by_hand(spark, docs, bench, tmp_path)
    assert all(a >= b > 0 for a, b in zip(sizes, sizes[1:])) and len(set(sizes)) >= 4, sizes
    got = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        ends = [0]
        for offset, length in sorted(parts):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 1024
    assert len(sequences) <= 1.1 * sum(v[1] for v in want.values()) / 1024 + 1
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash_dedup", "decontamination", "packing"]


def test_the_toxicity_stage_learns_from_all_labelled_rows(spark, tmp_path, monkeypatch):
    """A table of more than 20,000 labelled training rows; the model that the stage applies has counted each of them."""
    docs = spark.range(26_000).selectExpr("id AS doc_id", "concat(IF(id % 9 = 0, 'idiot ', 'winter '), 'w', id % 11) AS text")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.selectExpr("doc_id", "int(doc_id % 9 = 0) AS toxic").write.parquet(f"{tmp_path}/labels.parquet")
    used, clean = [], corpus_pipeline.toxicity.clean
    monkeypatch.setattr(corpus_pipeline.toxicity, "clean", lambda docs, model: used.append(model) or clean(docs, model))
    kept = corpus_pipeline.drop_toxic(spark, docs.where("doc_id < 900"), str(tmp_path)).count()
    want = docs.where("crc32(string(doc_id)) % 5 <> 0").selectExpr("count_if(doc_id % 9 = 0) AS toxic", "count_if(doc_id % 9 <> 0) AS other").first()
    assert want.toxic + want.other > 20_000
    assert (used[0].toxic, used[0].other) == (want.toxic, want.other) and used[0].counts["idiot"] == (want.toxic, 0)
    assert kept == 800


def test_stages_on_odd_rows(spark, tmp_path):
    """No rows, null texts and ids, empty and repeated rows, columns with the operators' names."""
    kind = "doc_id long, text string, lang string, n_hit long, dropped string"
    rows = [(1, None, "en", 1, "a"), (2, "", "en", 2, "b"), (None, "some words without an id", "de", 3, "c"), (3, "one two three four five six seven", "en", 4, "d"), (3, "one two three four five six seven", "en", 4, "d"), (4, "word " * 50_000, "en", 5, "e")]
    for some in ([], rows):
        docs = spark.createDataFrame(some, kind)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == [c.split()[0] for c in kind.split(", ")], name
            docs = spark.createDataFrame(docs.collect(), kind)
        if some:
            assert {1, 2, None, 3, 4} == {r.doc_id for r in docs.collect()}
        packed = corpus_pipeline.pack(spark, docs, SF).collect()
        assert (len(packed) > 0) == bool(some)
