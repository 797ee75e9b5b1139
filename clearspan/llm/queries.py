"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_join, license_scan, line_dedup, near_dedup, phrase_mining, piece_coding, prefix_trie, quality_rules, source_mixing, substring_dedup, token_store, topk_search, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_frequent_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = """
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
hot AS (SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT l.*, h.k IS NOT NULL AS gone FROM lines l LEFT JOIN hot h ON l.k = h.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_rules.with_quality(docs, _table(spark, sf_dir, "labels"))
    return out.select("doc_id", *quality_rules.OUTPUTS)


#: Target shares of the domains.
TARGETS = {"clean": 0.90, "poor": 0.04, "toxic": 0.06}


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return source_mixing.mix_sources(docs, _table(spark, sf_dir, "labels"), TARGETS, keep_text=False)


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(_table(spark, sf_dir, "embeddings"), k=10, scale=1024.0)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT * FROM (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
WHERE rank <= 10
"""


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), window=20).drop("spans")


OP4_SQL = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
late AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(20)) AS i FROM late),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
marked AS (SELECT word.doc_id, word.i, word.word, gone.i IS NOT NULL AS gone FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.i = gone.i),
summed AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN summed s ON d.doc_id = s.doc_id
"""


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents")).drop("spans")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = token_store.write_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_store.read_tokens(manifest)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)


def op7_piece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every text and decodes it again; decoded_sha256 is that of the text itself."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = piece_coding.decode(piece_coding.encode(_table(spark, sf_dir, "documents"), model), model)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), "score", F.crc32("ids").alias("ids_crc32"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


def op11_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.near_vectors(_table(spark, sf_dir, "embeddings"), least=0.93)


OP11_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
linked AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (
  SELECT vec_id, vec_id AS top FROM embeddings
  UNION SELECT l.b AS vec_id, r.top FROM reach r JOIN linked l ON l.a = r.vec_id WHERE r.top < l.b),
tops AS (SELECT vec_id, min(top) AS top FROM reach GROUP BY vec_id),
counts AS (SELECT a, count(*) AS n FROM linked GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, top AS component_id, e.vec_id = top AS kept
FROM embeddings e JOIN tops ON e.vec_id = tops.vec_id LEFT JOIN counts ON a = e.vec_id
"""


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.collocations(_table(spark, sf_dir, "documents"), threshold=10, cover=50, top=2000)


OP12_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
split AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, 1 AS size, unnest(w) AS phrase FROM split
  UNION ALL SELECT lang, 2 AS size, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' '))) AS phrase FROM split WHERE len(w) > 1
  UNION ALL SELECT lang, 3 AS size, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS phrase FROM split WHERE len(w) > 2),
f AS (SELECT lang, size, phrase, count(*) AS a FROM grams GROUP BY lang, size, phrase HAVING count(*) >= 10),
totals AS (SELECT lang, count(*) AS n FROM grams WHERE size = 1 GROUP BY lang),
parts AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
cuts AS (
  SELECT p.lang, p.size, p.phrase, p.a, k, x.a AS l, y.a AS r, CAST((CAST(1000000 AS HUGEINT) * p.a * p.a) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM parts p, range(1, 3) t(k), f x, f y
  WHERE k < p.size AND x.lang = p.lang AND x.phrase = array_to_string(p.w[1:k], ' ') AND y.lang = p.lang AND y.phrase = array_to_string(p.w[k + 1:], ' ')),
least AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM parts WHERE size = 3
  UNION ALL SELECT lang, array_to_string(w[2:3], ' ') AS phrase, a FROM parts WHERE size = 3),
longest AS (SELECT lang, phrase, max(a) AS a FROM inside GROUP BY lang, phrase),
kept AS (SELECT c.* FROM least c LEFT JOIN longest o ON o.lang = c.lang AND o.phrase = c.phrase WHERE o.a IS NULL OR 100 * o.a < 50 * c.a)
SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, a, l, r, n, score FROM (
  SELECT k.*, n, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept k JOIN totals USING (lang))
WHERE rank <= 2000
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


OP13_SQL = """
WITH crc AS (
  SELECT range AS byte, list_reduce([range] || range(8), lambda r, k: CASE WHEN r % 2 = 1 THEN xor(3988292384, r // 2) ELSE r // 2 END) AS v FROM range(256)),
crcs AS (SELECT list(v ORDER BY byte) AS t FROM crc),
raw AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT c, c - c % 20 AS base, xor(4294967295, list_reduce([4294967295] || list_transform(string_split(CAST(c AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT)),
      lambda r, b: xor(r // 256, t[1 + xor(r % 256, b)]))) % 4 AS h
  FROM (SELECT DISTINCT c FROM raw), crcs),
parts AS (
  SELECT i.c, 0 AS own, k, role, text FROM ids i JOIN raw r ON r.c = i.base WHERE k <= h
  UNION ALL SELECT i.c, 1 AS own, k, role, text FROM ids i JOIN raw r ON r.c = i.c WHERE k > h),
turns AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, k) AS depth, md5(length(role) || ':' || role || text) AS h,
    len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS words FROM parts),
members AS (
  SELECT c, depth, words, string_agg(h, '' ORDER BY depth) OVER (PARTITION BY c ORDER BY depth) AS path FROM turns
  UNION ALL SELECT c, 0 AS depth, 0 AS words, '' AS path FROM ids),
deepest AS (SELECT c, max(depth) AS depth FROM members GROUP BY c),
ends AS (SELECT path, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ends FROM members JOIN deepest USING (c, depth) GROUP BY path),
nodes AS (SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs, min(words) AS words FROM members GROUP BY path, depth),
kids AS (SELECT left(path, 32 * (depth - 1)) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
flat AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (path)),
below AS (
  SELECT a.path, sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((b.n_convs - 1) * b.words) AS saved
  FROM (SELECT left(path, 32 * d) AS path, n_children, n_convs, words FROM flat, range((SELECT max(depth) + 1 FROM nodes)) r(d) WHERE d <= depth) b JOIN flat a USING (path) GROUP BY a.path)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n_convs, CAST(f.n_children AS BIGINT) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM flat f JOIN below USING (path) LEFT JOIN ends USING (path) LEFT JOIN nodes p ON f.depth > 0 AND p.path = left(f.path, 32 * (f.depth - 1))
"""


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_source_mixing": op2_source_mixing,
    "op3_exact_topk": op3_exact_topk,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_line_dedup": op6_line_dedup,
    "op7_piece_coding": op7_piece_coding,
    "op8_near_dedup": op8_near_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_store": op10_token_store,
    "op11_embedding_join": op11_embedding_join,
    "op12_phrase_mining": op12_phrase_mining,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLES = {"op3_exact_topk": OP3_SQL, "op4_substring_dedup": OP4_SQL, "op6_line_dedup": OP6_SQL, "op11_embedding_join": OP11_SQL, "op12_phrase_mining": OP12_SQL, "op13_prefix_trie": OP13_SQL}
