"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reckoner.llm import html_main, maxplus, negatives, pii, ppm, spelling, tokenfiles, toxicity, warc
from reckoner.llm.common import fresh_path, table
from reckoner.llm.fingerprints import fingerprints
from reckoner.llm.neardup import near_duplicates
from reckoner.llm.tiling import decontaminate
from reckoner.llm.wordpiece import count_tokens


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = maxplus.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), verify=True, keep=["doc_id"])
    return coded.select("doc_id", F.size("ids").alias("n_pieces"), "ids", "same")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.archive(table(spark, sf_dir, "pages"), path)
    return warc.pages_of(spark, path)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_main.extract(pages, html_main.learn(pages), keep=["page_id", "url"])


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return toxicity.score(docs, model, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    fitted, counts = ppm.fit(docs.where(~held_out))
    return ppm.score(docs, fitted, counts).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = fresh_path(spark, "tokens")
    return tokenfiles.read(tokenfiles.write(docs, path, public_tokenizers.path("word_bpe_49k.json")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])


#: Runs of letters that are words of seven code points, or become so without one.
LETTERS = "([A-Za-z\u00C0-\u00FF]{7,})"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(1))).alias("run")).withColumn("run", F.translate("run", UPPER, LOWER))
    # A null id counts as the empty text.
    h, n = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))), F.char_length("run")
    at = (h % n).cast("int")
    deleted = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, n))
    words = runs.select(F.when(h % 31 == 0, deleted).otherwise(F.col("run")).alias("word"))
    counts = words.where(F.char_length("word") >= 7).groupBy("word").agg(F.count("*").alias("n")).where("n >= 2")
    return spelling.variants(counts)


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, keep=["doc_id"])
    base = F.filter("pii", lambda x: x["base"])
    kinds = F.transform(base, lambda x: x["kind"])
    counts = [(F.size(base) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.written(base), 256).alias("base_sha256"), pii.written(F.col("pii")).alias("spans"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0, vector="embedding")


QUERIES = {f.__name__: f for f in (op1_warc, op2_fingerprints, op3_main_text, op4_toxicity, op5_near_duplicates, op6_ppm, op7_token_files, op8_token_counts, op9_pieces, op10_decontamination, op11_spelling_variants, op12_personal_data, op13_hard_negatives)}
ORACLE: dict[str, str] = {
    "op1_warc": """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
 CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to, url
FROM f""",
    "op13_hard_negatives": """
WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, a.label = b.label AS same, b.id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE same QUALIFY k <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
 s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
QUALIFY rank <= 5""",
    # The checksum bit by bit in a table of 256, then byte by byte; near words by strings without a code point.
    "op11_spelling_variants": """
WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS c FROM range(256) AS r(i))),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]{7,}')) AS run FROM documents),
low AS (SELECT d, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k FROM runs GROUP BY 1, 2),
coded AS (SELECT run, k, hex(encode(d || ':' || run)) AS x FROM low),
hashed AS (SELECT run, k, xor(list_reduce(list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)),
  lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]), 4294967295), 4294967295) AS h FROM coded, crc),
made AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM made WHERE length(word) >= 7 GROUP BY 1 HAVING sum(k) >= 2),
cut AS (SELECT word, n, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT p.word AS w, q.word AS v, q.n FROM cut p JOIN cut q ON p.a = q.a AND p.b = q.b AND p.word <> q.word
 UNION SELECT p.word, q.word, q.n FROM cut p JOIN words q ON p.a || p.b = q.word UNION SELECT q.word, p.word, p.n FROM cut p JOIN words q ON p.a || p.b = q.word),
best AS (SELECT w, v, n, count(*) OVER (PARTITION BY w) AS n_near FROM near QUALIFY row_number() OVER (PARTITION BY w ORDER BY n DESC, v) = 1),
told AS (SELECT word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 10 * words.n THEN v END AS form, CASE WHEN best.n >= 10 * words.n THEN best.n END AS form_n FROM words LEFT JOIN best ON w = word),
walk AS (SELECT word, word AS here, 0 AS step FROM told UNION ALL SELECT walk.word, told.form, step + 1 FROM walk JOIN told ON told.word = walk.here WHERE told.form IS NOT NULL)
SELECT told.word, form, root, n, n_near, form_n FROM told JOIN (SELECT word, arg_max(here, step) AS root FROM walk GROUP BY 1) AS ends ON ends.word = told.word""",
    # Base spans: places of matches from what stands between them. No iban and no ssn stands in the tables, so ``spans`` has no others.
    "op12_personal_data": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, 0 AS rank, 'email' AS kind, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+') AS ms, string_split_regex(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+') AS ps FROM d
 UNION ALL SELECT doc_id, 1, 'ip', regexp_extract_all(t, '[0-9]+(?:\\.[0-9]+){3}'), string_split_regex(t, '[0-9]+(?:\\.[0-9]+){3}') FROM d
 UNION ALL SELECT doc_id, 2, 'card', regexp_extract_all(t, '[0-9](?:[ -]?[0-9])+'), string_split_regex(t, '[0-9](?:[ -]?[0-9])+') FROM d
 UNION ALL SELECT doc_id, 3, 'phone', regexp_extract_all(t, '\\+[0-9][ ().0-9-]+[0-9]'), string_split_regex(t, '\\+[0-9][ ().0-9-]+[0-9]') FROM d),
each AS (SELECT doc_id, rank, kind, ms, ps, unnest(range(1, len(ms) + 1)) AS k FROM m),
found AS (SELECT doc_id, rank, kind, ms[k] AS x, regexp_replace(ms[k], '[^0-9]', '', 'g') AS digits,
  CAST(list_sum(list_transform(ps[1:k], lambda p: length(p))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda p: length(p))), 0) AS BIGINT) AS at_ FROM each),
good AS (SELECT * FROM found WHERE CASE kind WHEN 'email' THEN true WHEN 'ip' THEN list_max(list_transform(string_split(x, '.'), lambda p: CAST(p AS HUGEINT))) <= 255
  WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
  ELSE length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(length(digits)), lambda i: CASE WHEN (length(digits) - i) % 2 = 1 THEN CAST(substr(digits, CAST(i + 1 AS BIGINT), 1) AS INT)
    ELSE CAST(substr(digits, CAST(i + 1 AS BIGINT), 1) AS INT) * 2 - CASE WHEN CAST(substr(digits, CAST(i + 1 AS BIGINT), 1) AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0 END),
told AS (SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
  string_agg(kind || ':' || at_ || ':' || (at_ + length(x)), ',' ORDER BY at_, rank) AS said FROM good GROUP BY 1)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(said, '')) AS base_sha256, coalesce(said, '') AS spans
FROM d LEFT JOIN told USING (doc_id)""",
}
