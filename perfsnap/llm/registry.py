"""The queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfsnap.llm import filter_audit, fm_index, language, packing, prefix_free, secrets, simhash, templates, token_groups, toxicity, urls, warc, whitening
from perfsnap.session import scratch_path, written

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The public byte-level vocabulary; its place is the package's affair."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path("byte_bpe_50k.json"))


@query("op1_decontamination")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP2_SQL = """
WITH lists AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS l FROM documents),
bytes AS (SELECT doc_id, unnest(l) AS b, unnest(range(1, len(l) + 1)) AS p FROM lists),
windows AS (
  SELECT doc_id, p, b, CASE WHEN count(*) OVER f = 100 THEN md5(string_agg(b, '') OVER f) END AS k FROM bytes
  WINDOW f AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 99 FOLLOWING)),
firsts AS (SELECT k, min(doc_id * 4294967296 + p) AS first FROM windows WHERE k IS NOT NULL GROUP BY k),
starts AS (SELECT w.doc_id, p, b, CASE WHEN doc_id * 4294967296 + p > first THEN p END AS again FROM windows w LEFT JOIN firsts f ON w.k = f.k),
covered AS (
  SELECT doc_id, p, b, coalesce(max(again) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) > p - 100, false) AS gone
  FROM starts),
edges AS (SELECT *, gone AND NOT lag(gone, 1, false) OVER (PARTITION BY doc_id ORDER BY p) AS opens FROM covered)
SELECT d.doc_id, count(p)::BIGINT AS n_bytes, (count(*) FILTER (gone))::BIGINT AS n_removed, (count(*) FILTER (opens))::BIGINT AS n_spans,
 sha256(unhex(coalesce(string_agg(b, '' ORDER BY p) FILTER (NOT gone), ''))) AS kept_sha256
FROM documents d LEFT JOIN edges e ON d.doc_id = e.doc_id GROUP BY d.doc_id
"""


@query("op2_prefix_free_parsing", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prefix_free.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
                        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = """
WITH lists AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM lists),
windows AS (
  SELECT doc_id, p, word, CASE WHEN count(*) OVER f = 50 THEN md5(string_agg(word, ' ') OVER f) END AS k FROM words
  WINDOW f AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
firsts AS (SELECT k, min(doc_id) AS first FROM windows WHERE k IS NOT NULL GROUP BY k),
starts AS (SELECT w.doc_id, p, word, coalesce(doc_id > first, false) AS again FROM windows w LEFT JOIN firsts f ON w.k = f.k),
covered AS (
  SELECT doc_id, p, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM starts)
SELECT d.doc_id, count(p)::BIGINT AS n_words, (count(*) FILTER (gone))::BIGINT AS n_removed,
 sha256(coalesce(string_agg(word, ' ' ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM documents d LEFT JOIN covered c ON d.doc_id = c.doc_id GROUP BY d.doc_id
"""


@query("op3_fm_index", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fm_index.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(reach.b) AS component_id
FROM documents d JOIN reach ON reach.a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""


@query("op4_token_groups", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_groups.near_components(table(spark, sf_dir, "documents"))


@query("op5_secret_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = secrets.train(secrets.labelled_findings(spark))
    found = secrets.scan(table(spark, sf_dir, "documents"), forest)
    return found.select("doc_id", "start", "length", F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), "chance", "secret")


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~language.held_out()))
    return language.identify(docs, model).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


OP7_SQL = """
WITH digests AS (
  SELECT page_id, coalesce(strlen(html), 0)::BIGINT AS payload_bytes, unhex(sha1(coalesce(html, '')))::BIT::VARCHAR AS bits FROM pages),
named AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(1, 6), lambda j: substr(bits, 5 * i + j, 1)::INT << (5 - j)))::INT, 1)), '') AS payload_digest
  FROM digests),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM named)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id <> first THEN first END AS refers_to
FROM firsts
"""


@query("op7_warc", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(warc.with_revisits(table(spark, sf_dir, "pages")), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query("op8_url_filter")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urls.judge(urls.url_parts(pages), rules, pages, "html")


@query("op9_simhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = written(simhash.compare_with_next(table(spark, sf_dir, "documents")), "compared")
    near = simhash.near_documents(found.select("doc_id", "fingerprint"), F.col("doc_id") % 20 == 0)
    texts = found.withColumns({c: simhash.as_text(c) for c in ("fingerprint", "edited_fingerprint")}).drop("next_id")
    return texts.join(near, "doc_id", "left")


GROUP_DOCS = 4096


@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pieces = packing.token_pieces(docs, tokenizer_path())
    digest = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    packed = packing.pack(digest, packing.group_count(docs, GROUP_DOCS))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


OP11_SQL = """
WITH flags AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
   list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
kinds AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w),
    100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t), regexp_matches(t, '[#$%&*|]'),
    doc_id > min(doc_id) OVER (PARTITION BY t)] AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM flags LEFT JOIN kinds USING (doc_id)),
counted AS (SELECT part, fails, good, toxic, count(*) AS n FROM failed GROUP BY ALL),
letters AS (SELECT unnest(range(1, 6)) AS i),
orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT o, unnest(range(1, 6)) AS step FROM orders),
seen AS (
  SELECT part, o, step, o[step] AS f, fails, good, toxic, n, fails[o[step]] AS here,
   len(list_filter(o[1:step - 1], lambda i: fails[i])) > 0 AS gone, len(list_filter(fails, lambda x: x)) AS k
  FROM counted, steps),
rows AS (
  SELECT part, o, step, f, coalesce(sum(n) FILTER (NOT gone AND NOT here), 0) AS kept, coalesce(sum(n) FILTER (here AND NOT gone), 0) AS removed,
   coalesce(sum(n) FILTER (here AND gone), 0) AS redundant, coalesce(sum(n) FILTER (here AND k = 1), 0) AS unique_fails,
   coalesce(sum(n) FILTER (here AND NOT gone AND good), 0) AS good_lost, coalesce(sum(n) FILTER (here AND NOT gone AND toxic), 0) AS toxic_lost
  FROM seen GROUP BY part, o, step, f)
SELECT part, array_to_string(list_transform(o, lambda i: substr('ABCDE', i::INT, 1)), '') AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
 redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
 (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM rows
"""


@query("op11_filter_audit", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_toxicity")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(written(toxicity.labelled(docs, table(spark, sf_dir, "labels")).where(~toxicity.held_out()), "labelled"))
    return toxicity.score(docs, model).withColumn("held_out", toxicity.held_out()).select("doc_id", "held_out", "score", "predicted", "n_hits", "terms")


@query("op13_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark, table(spark, sf_dir, "embeddings"))
