"""The queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives, bpe, brown, centroids, decontamination, lexical, lines, minhash, packing, pii, quality, toxicity, vectors
from .common import Scratch, table


def op1_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=85)


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = docs.select("doc_id", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    gone = lines.recurring_lines(docs).select("doc_id", F.size("dropped").cast("long").alias("n_dropped"), F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped"))
    return counted.join(gone, "doc_id", "left").select("doc_id", "n_lines", F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), F.coalesce("dropped", F.lit("")).alias("dropped"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.predictions(quality.score(docs, model), quality.THRESHOLD)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = archives.convert(archives.arc_files(table(spark, sf_dir, "pages")))
    return read.where("type IN ('response', 'revisit')").select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return quality.predictions(toxicity.score(docs, model), toxicity.THRESHOLD)


def op10_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.with_inertia(*centroids.sort_means(table(spark, sf_dir, "embeddings")))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "lexical")
    index = lexical.build(table(spark, sf_dir, "documents"), scratch)
    found = lexical.search(index, table(spark, sf_dir, "benchmark"), scratch)
    scratch.drop(index.blocks)
    return found


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    how = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    found = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), *how), *how)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'), lambda x: x <> '') AS ws FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'), lambda x: x <> '') AS ws FROM benchmark
), p AS (
  SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS win
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
), d AS (
  SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE len(ws) > 0), (SELECT DISTINCT n FROM p) AS lengths
  WHERE i + n - 1 <= len(ws)
), h AS (
  SELECT d.doc_id, d.i, d.n, p.item FROM d JOIN p ON d.win = p.win AND d.n = p.n
), hit AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s AS a JOIN s AS b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS (
  SELECT a, b FROM c JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)
), r(id, reach) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.id, l.b FROM r JOIN l ON r.reach = l.a
), m AS (
  SELECT id, min(reach) AS component_id FROM r GROUP BY id
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents AS d JOIN m ON m.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

_BLOCKS = "len(toks) * 30 // 100 + 1"
_TURN = """k{t} AS (
  SELECT n, head, line, toks, j || ':' || array_to_string(toks[j * len(toks) // blocks + 1:(j + 1) * len(toks) // blocks], ' ') AS key
  FROM (SELECT n, head, line, toks, {blocks} AS blocks, unnest(range(0, {blocks})) AS j FROM o{t})
), b{t} AS (
  SELECT n, head, line, any_value(toks) AS toks, max({{'many': many, 'key': key}}).key AS key
  FROM k{t} JOIN (SELECT n, head, key, count(*) AS many FROM k{t} GROUP BY n, head, key HAVING count(*) > 1) USING (n, head, key) GROUP BY n, head, line
), e{t} AS (
  SELECT n, head, key, list(CASE WHEN top.many > 1 THEN top.token END ORDER BY place) AS wanted FROM (
    SELECT n, head, key, place, max({{'many': many, 'token': token}}) AS top FROM (
      SELECT n, head, key, place, token, count(*) AS many FROM (SELECT n, head, key, unnest(range(len(toks))) AS place, unnest(toks) AS token FROM b{t}) GROUP BY n, head, key, place, token
    ) GROUP BY n, head, key, place
  ) GROUP BY n, head, key
), f{t} AS (
  SELECT n, head, line, key FROM b{t} JOIN e{t} USING (n, head, key) WHERE 100 * len(list_filter(range(1, len(toks) + 1), lambda i: toks[i] = wanted[i])) >= 70 * len(toks)
), g{t} AS (
  SELECT n, head, line, '{t}' || key AS template FROM f{t} JOIN (SELECT n, head, key FROM f{t} GROUP BY n, head, key HAVING count(*) > 1) USING (n, head, key)
)"""
OP3_SQL = (
    r"""
WITH l AS (
  SELECT doc_id, line_no, line, len(tokens) AS n, tokens FROM (
    SELECT doc_id, line_no, line, string_split(line, ' ') AS tokens FROM (
      SELECT doc_id, line_no, regexp_replace(trim(regexp_replace(ls[line_no + 1], '[ \t\r\x0b\x0c]+', ' ', 'g')), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS line
      FROM (SELECT doc_id, ls, unnest(range(0, len(ls))) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))
    )
  ) WHERE len(list_filter(tokens, lambda x: x <> '<*>')) >= 4
), d AS (
  SELECT n, array_to_string(tokens[1:3], ' ') AS head, line, any_value(tokens) AS tokens, min(doc_id) AS lo, max(doc_id) AS hi, min(doc_id * 1000000 + line_no) AS start FROM l GROUP BY n, head, line
), p AS (
  SELECT n, head, place, token, count(*) AS c FROM (SELECT n, head, tokens, unnest(range(4, n + 1)) AS place, unnest(tokens[4:]) AS token FROM d) GROUP BY n, head, place, token
), top AS (
  SELECT n, head, list(token ORDER BY place) AS template FROM (SELECT n, head, place, token, row_number() OVER (PARTITION BY n, head, place ORDER BY c DESC, token DESC) AS r FROM p) WHERE r = 1 GROUP BY n, head
), a0 AS (
  SELECT d.n, d.head, d.line, d.tokens[4:] AS toks, 100 * len(list_filter(range(1, d.n - 2), lambda i: d.tokens[i + 3] = top.template[i])) >= 70 * (d.n - 3) AS alike FROM d JOIN top ON top.n = d.n AND top.head = d.head
), g0 AS (
  SELECT n, head, line, '' AS template FROM a0 JOIN (SELECT n, head FROM a0 WHERE alike GROUP BY n, head HAVING count(*) > 1) USING (n, head) WHERE alike
), o1 AS (
  SELECT n, head, line, toks FROM a0 ANTI JOIN g0 USING (n, head, line) WHERE len(toks) * 30 >= 100
), """
    + _TURN.format(t=1, blocks=_BLOCKS)
    + ", o2 AS (SELECT n, head, line, toks FROM o1 ANTI JOIN g1 USING (n, head, line)), "
    + _TURN.format(t=2, blocks=_BLOCKS)
    + r""", m AS (
  SELECT d.n, d.head, d.line, lo, hi, start, coalesce(x.template, 'line:' || d.line) AS template
  FROM d LEFT JOIN (SELECT * FROM g0 UNION ALL SELECT * FROM g1 UNION ALL SELECT * FROM g2) AS x USING (n, head, line)
), t AS (
  SELECT n, head, template, min(start) AS start, max(hi) AS last FROM m GROUP BY n, head, template HAVING min(start) // 1000000 < max(hi)
), h AS (
  SELECT DISTINCT l.doc_id, l.line_no FROM l JOIN m ON m.n = l.n AND m.line = l.line JOIN t ON t.n = m.n AND t.head = m.head AND t.template = m.template WHERE l.doc_id * 1000000 + l.line_no <> t.start
), c AS (
  SELECT doc_id, count(*) AS n_dropped, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS dropped FROM h GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped, coalesce(dropped, '') AS dropped
FROM documents LEFT JOIN c USING (doc_id)
"""
)

OP7_SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM m
"""

OP1_SQL = r"""
WITH RECURSIVE e AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e AS a JOIN e AS b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9
), n AS (
  SELECT a, count(*) AS n_links FROM l GROUP BY a
), r(id, reach) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON r.reach = l.a
), m AS (
  SELECT id, min(reach) AS component_id FROM r GROUP BY id
)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN m ON m.id = vec_id LEFT JOIN n ON n.a = vec_id
"""

_NEAREST = """a{i} AS MATERIALIZED (
  SELECT rid, vec_id, e.v AS v, min({{'d': dist, 'c': c}}) AS best
  FROM (SELECT rid, vec_id, k.v AS v, c, CAST(list_inner_product(k.v, k.v) + list_inner_product(m.v, m.v) - 2 * list_inner_product(k.v, m.v) AS BIGINT) AS dist FROM k, c{i} AS m) AS e
  GROUP BY rid, vec_id, e.v
)"""
_MOVED = """c{j} AS MATERIALIZED (
  SELECT c, coalesce(any_value(mean), any_value(old.v)) AS v FROM c{i} AS old LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n + n) % n)) // n AS DOUBLE) ORDER BY place) AS mean
    FROM (SELECT best.c AS c, place, sum(CAST(x AS BIGINT)) AS s, count(*) AS n FROM (SELECT best, unnest(v) AS x, unnest(range(1, 65)) AS place FROM a{i}) GROUP BY best.c, place) GROUP BY c
  ) USING (c) GROUP BY c
)"""
OP11_SQL = (
    """
WITH k AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS c, v FROM (SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, v FROM k WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT 40)
), """
    + ", ".join(f"{_NEAREST.format(i=i)}, {_MOVED.format(i=i, j=i + 1)}" for i in range(5))
    + f", {_NEAREST.format(i=5)}"
    + """, s AS (
  SELECT best.c AS c, CAST(sum(best.d) AS BIGINT) AS cluster_inertia FROM a5 GROUP BY best.c
)
SELECT vec_id, best.c AS cluster, best.d AS distance, cluster_inertia, (SELECT CAST(sum(best.d) AS BIGINT) FROM a5) AS inertia,
       sha256(array_to_string(list_transform(c5.v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a5 JOIN s ON s.c = best.c JOIN c5 ON c5.c = best.c
"""
)

OP12_SQL = r"""
WITH t AS (
  SELECT rid, doc_id, unnest(ws) AS term, len(ws) AS n FROM (
    SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'), lambda x: x <> '') AS ws FROM documents
  )
), f AS (
  SELECT rid, doc_id, term, any_value(n) AS n, count(*) AS tf FROM t GROUP BY rid, doc_id, term
), s AS (
  SELECT count(DISTINCT rid) AS n_docs, count(*) AS total FROM t
), q AS (
  SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'), lambda x: x <> '')) AS term FROM benchmark
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM f WHERE term IN (SELECT term FROM q) GROUP BY term), s
), p AS (
  SELECT item_id, rid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // total)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN f USING (term), s GROUP BY item_id, rid, doc_id
), r AS (
  SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM p WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""

QUERIES = {"op1_vectors": op1_vectors, "op7_archives": op7_archives, "op3_lines": op3_lines, "op2_minhash": op2_minhash, "op4_pii": op4_pii, "op5_quality": op5_quality, "op9_toxicity": op9_toxicity, "op10_brown": op10_brown, "op6_decontamination": op6_decontamination, "op8_packing": op8_packing, "op11_centroids": op11_centroids, "op12_lexical": op12_lexical, "op13_bpe": op13_bpe}
ORACLE_SQL = {"op1_vectors": OP1_SQL, "op7_archives": OP7_SQL, "op3_lines": OP3_SQL, "op2_minhash": OP2_SQL, "op6_decontamination": OP6_SQL, "op11_centroids": OP11_SQL, "op12_lexical": OP12_SQL}
