"""Registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandweave.llm.chat import chat_digest
from strandweave.llm.common import table
from strandweave.llm.decontaminate import contaminated
from strandweave.llm.licenses import TEMPLATES, bigrams, license_hits
from strandweave.llm.minhash_dedup import NearDedup, near_duplicates
from strandweave.llm.phrases import collocations
from strandweave.llm.pii import replaced
from strandweave.llm.quality_fm import quality
from strandweave.llm.resample import resampled
from strandweave.llm.secrets import secrets
from strandweave.llm.sentencepiece_viterbi import encoded_and_checked
from strandweave.llm.sharding import shard_digest
from strandweave.llm.vector_dedup import near_vectors
from strandweave.llm.warc import round_trip

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), NearDedup(width=2))


def op4_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_digest(table(spark, sf_dir, "documents"))


def op5_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op6_sentencepiece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_and_checked(table(spark, sf_dir, "documents"))


def op7_reply_tree_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations by turn, and conversation -7 of control strings."""
    hard = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -7L AS conv_id, turn, role, '{hard}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return chat_digest(table(spark, sf_dir, "conversations"), extra)


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replaced(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_replaced")


def op9_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


def op10_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_hits(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_warc_zstandard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Query]:
    found = [
        op1_decontamination,
        op2_quality_fm,
        op3_minhash_near_dedup,
        op4_external_shuffle,
        op5_nn_descent,
        op6_sentencepiece_viterbi,
        op7_reply_tree_chat,
        op8_pii_surrogates,
        op9_secret_forest,
        op10_license_dice,
        op11_importance_resampling,
        op12_phrase_mining,
        op13_warc_zstandard,
    ]
    return {f.__name__: f for f in found}


_OP3 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws
    ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh
  FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
c AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c WHERE 100 * k >= 80 * (na + nb - k)),
u AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (
  SELECT x AS node, y AS other FROM u
  UNION SELECT r.node, u.y FROM r JOIN u ON r.other = u.x),
m AS (SELECT node, min(other) AS low FROM r GROUP BY 1)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles,
  least(s.doc_id, coalesce(m.low, s.doc_id)) AS component_id,
  s.doc_id = least(s.doc_id, coalesce(m.low, s.doc_id)) AS kept
FROM s LEFT JOIN m ON m.node = s.doc_id
"""


_OP7 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
    length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')) AS shown
  FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY k)) AS loss_sha256,
  CAST(sum(12 + length(role) + 1 + shown + 11) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


_OP5 = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
l AS (
  SELECT a.vec_id AS p, b.vec_id AS q FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
r AS (SELECT p AS node, q AS other FROM l UNION SELECT r.node, l.q FROM r JOIN l ON r.other = l.p),
m AS (SELECT node, min(other) AS low FROM r GROUP BY 1),
n AS (SELECT p, count(*) AS c FROM l GROUP BY 1)
SELECT e.vec_id, coalesce(n.c, 0) AS n_links, least(e.vec_id, coalesce(m.low, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(m.low, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN m ON m.node = e.vec_id LEFT JOIN n ON n.p = e.vec_id
"""


def _op10() -> str:
    rows = ", ".join(f"('{k}', {sum(c.values())}, '{b}', {n})" for k, c in ((k, bigrams(t)) for k, t in TEMPLATES.items()) for b, n in c.items())
    return rf"""
WITH t(license_id, b, bigram, n) AS (VALUES {rows}),
units AS (
  SELECT doc_id, 'line' AS unit, unnest(string_split(text, chr(10))) AS body, unnest(range(len(string_split(text, chr(10))))) AS no
  FROM documents WHERE text <> ''
  UNION ALL
  SELECT doc_id, 'sentence', unnest(s), unnest(range(len(s))) FROM (
    SELECT doc_id, flatten(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '([.!?;:])[ \t]+', '\1' || chr(31), 'g')),
      lambda x: contains(x, chr(31))), lambda x: string_split(x, chr(31)))) AS s
    FROM documents WHERE text <> '')
  UNION ALL
  SELECT * FROM (
    SELECT doc_id, 'paragraph' AS unit, unnest(regexp_split_to_array(text, '
[ 	
]*
')) AS body,
      unnest(range(len(regexp_split_to_array(text, '
[ 	
]*
')))) AS no
    FROM documents WHERE text <> '') WHERE contains(trim(body, chr(10)), chr(10))
  UNION ALL
  SELECT doc_id, 'file', text, 0 FROM documents WHERE regexp_matches(text, '
[ 	
]*
')),
w AS (SELECT doc_id, unit, no, list_filter(regexp_split_to_array(lower(body), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM units),
g AS (
  SELECT doc_id, unit, no, len(w) - 1 AS a, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram
  FROM w WHERE len(w) > 1),
m AS (SELECT doc_id, unit, no, a, bigram, count(*) AS m FROM g GROUP BY ALL),
k AS (
  SELECT doc_id, unit, no, a, license_id, b, sum(least(m, n)) AS k FROM m JOIN t USING (bigram) GROUP BY ALL),
d AS (
  SELECT *, 2 * CAST(k AS DOUBLE) / (a + b) AS dice,
    row_number() OVER (PARTITION BY doc_id, unit, no ORDER BY 2 * CAST(k AS DOUBLE) / (a + b) DESC, license_id) AS r
  FROM k)
SELECT doc_id, unit, CAST(no AS BIGINT) AS unit_no, license_id, dice FROM d WHERE r = 1 AND dice >= 0.8
"""


#: The checksum of a text is folded over its bytes with the usual table of 256 steps, itself made by rule.
_OP11 = r"""
WITH tab AS MATERIALIZED (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
raw AS (
  SELECT 0 AS side, doc_id AS id, row_number() OVER () AS row_no, text FROM documents
  UNION ALL SELECT 1, NULL, -row_number() OVER (), text FROM benchmark),
w AS (
  SELECT side, id, row_no, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM raw),
g AS (
  SELECT side, row_no, unnest(list_concat(ws,
    list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]),
    list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) AS f
  FROM w),
k AS (SELECT side, row_no, f, count(*) AS n FROM g GROUP BY ALL),
b AS (
  SELECT f, xor(list_reduce(list_transform(range(1, length(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT)),
    lambda c, y: xor(t[1 + (xor(c, y) & 255)], c >> 8), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM k)), tab),
c AS (SELECT bucket, sum(n) FILTER (side = 0) AS s, sum(n) FILTER (side = 1) AS t FROM k JOIN b USING (f) GROUP BY 1),
z AS (SELECT sum(n) FILTER (side = 0) AS s, sum(n) FILTER (side = 1) AS t FROM k),
v AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(c.t, 0) AS DOUBLE) + 1) * (CAST(coalesce(z.s, 0) AS DOUBLE) + 10000)
    / ((CAST(coalesce(c.s, 0) AS DOUBLE) + 1) * (CAST(coalesce(z.t, 0) AS DOUBLE) + 10000)))) AS BIGINT) AS gain
  FROM c, z),
d AS (SELECT row_no, sum(n * gain) AS weight FROM k JOIN b USING (f) JOIN v USING (bucket) WHERE side = 0 GROUP BY 1),
e AS (
  SELECT id AS doc_id, len(ws) AS words, CAST(len(ws) + greatest(len(ws) - 1, 0) + greatest(len(ws) - 2, 0) AS BIGINT) AS n_features,
    CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM w LEFT JOIN d USING (row_no) WHERE side = 0),
o AS (
  SELECT *, CASE WHEN words >= 20 THEN row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id, n_features) END AS place,
    count(*) FILTER (words >= 20) OVER () AS n
  FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= n * 5 // 100 THEN place END AS rank FROM o
"""


_OP12 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY 1),
g AS (
  SELECT lang, j, unnest(list_transform(range(1, len(ws) - j + 2), lambda i: array_to_string(ws[i:i + j - 1], ' '))) AS phrase
  FROM (SELECT *, unnest(range(1, 5)) AS j FROM w) WHERE len(ws) >= j),
f AS MATERIALIZED (SELECT lang, j, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, j, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE j > 1),
k AS MATERIALIZED (
  SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS left_part, array_to_string(ws[k + 1:j], ' ') AS rest
  FROM (SELECT *, unnest(range(1, j)) AS k FROM c)),
cut AS (
  SELECT k.lang, k.phrase, k.a, k, l.a AS l, r.a AS r, CAST(2000000 * CAST(k.a AS HUGEINT) // (CAST(l.a AS HUGEINT) + r.a) AS BIGINT) AS score
  FROM k JOIN f AS l ON l.lang = k.lang AND l.phrase = left_part JOIN f AS r ON r.lang = k.lang AND r.phrase = rest),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM cut) WHERE o = 1),
inner_runs AS (
  SELECT DISTINCT c.lang, c.phrase AS longer, c.a AS f, array_to_string(c.ws[i:i + m - 1], ' ') AS phrase
  FROM c, range(2, 4) AS t(m), range(1, 4) AS u(i) WHERE m < c.j AND i + m - 1 <= c.j),
gone AS (SELECT DISTINCT b.lang, b.phrase FROM best b JOIN inner_runs USING (lang, phrase) WHERE 100 * f >= 80 * b.a),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, score
  FROM best ANTI JOIN gone USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


#: 20 bits, five digits of the hash, are four letters of base 32.
_OP13 = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha1(body) AS h, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_minhash_near_dedup": _OP3, "op5_nn_descent": _OP5, "op7_reply_tree_chat": _OP7, "op10_license_dice": _op10(), "op11_importance_resampling": _OP11, "op12_phrase_mining": _OP12, "op13_warc_zstandard": _OP13}
