"""Registered queries ``opN_<name>`` and the DuckDB SQL of those that SQL can express.

Each query applies its operator, with production parameters, to its whole
table and returns the whole result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import embed_dup, filter_audit, language_id, license_scan, near_dup, packing, quality_classifier, quality_rules, sentencepiece_fst, substring_dedup, token_alignment, url_filter, warc
from .common import held_out, table, work_path

QUERIES: dict[str, Callable[..., DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_embedding_dup(spark, sf_dir: str) -> DataFrame:
    """Near-dedup of all embeddings whatever their labels: cosine >= 0.95."""
    return embed_dup.embedding_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


@register
def op2_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens, with a digest of each piece's ids."""
    pieces = packing.tokenised(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packing.place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


@register
def op3_near_dup(spark, sf_dir: str) -> DataFrame:
    """MinHash near-dedup of all documents: 3-word shingles, Jaccard >= 0.85."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), k=3, threshold=0.85).drop("key", "chosen")


@register
def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels that may be learned from."""
    out = quality_classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.drop("key")


@register
def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    """License phrases, labels and score of every document."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


#: (host, path, verdict), fixed by the query's contract
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


@register
def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    """Host, path, longest rule and verdict of every page's url."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


ORACLE["op6_url_filter"] = f"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest)
SELECT page_id, any_value(host) AS host, any_value(path) AS path,
       arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
       coalesce(arg_max(verdict, length(rule_host || rule_path)), 'allow') AS verdict
FROM parts LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
GROUP BY page_id"""


@register
def op7_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that may be learned from."""
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("nearest").alias("lang_pred"), "score", "rejected")


@register
def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Base limits and robust outlier verdicts of every document."""
    return quality_rules.quality_verdicts(table(spark, sf_dir, "documents")).drop("key")


@register
def op9_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back through their index."""
    index = warc.write_archives(table(spark, sf_dir, "pages"), work_path(spark, "archives"))
    found = warc.read_records(index, payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: 20 bits of the digest at a time are five hexadecimal and four base-32 digits
ORACLE["op9_warc"] = """
WITH hashed AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
top AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS response FROM hashed)
SELECT page_id, n::BIGINT AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::INTEGER >> (15 - 5 * (i % 4))) & 31), 1) FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response THEN response END AS refers_to
FROM top"""


@register
def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Every document's text encoded, and decoded again: number and digest of its ids, and whether the text came back."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = sentencepiece_fst.decode(sentencepiece_fst.encode(table(spark, sf_dir, "documents"), path), path)
    ids = F.array_join("ids", ",").cast("binary")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.crc32(ids).alias("ids_crc32"), (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("restored"))


@register
def op11_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without the words of 35-word windows that also start elsewhere."""
    out = substring_dedup.without_duplicates(table(spark, sf_dir, "documents"), size=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@register
def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    """Every document's tokens of two tokenizers aligned, with the corpus-wide counts of the linked pairs."""
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return token_alignment.alignment_scores(table(spark, sf_dir, "documents"), *paths, digest=True).withColumnRenamed("groups", "groups_sha256")


@register
def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    """What each of five filters removes from every part, in all 120 orders."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: documents alike in part, filters failed and labels are counted together, then every order is looked up
ORACLE["op13_filter_audit"] = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS first_id FROM t),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b,
        100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
        coalesce(first_id < w.doc_id, false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
      FROM w LEFT JOIN marks ON w.doc_id = marks.doc_id),
g AS (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
        || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails, good, toxic, count(*) AS n FROM d GROUP BY ALL),
l(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (SELECT p.x || q.x || r.x || s.x || t.x AS o FROM l p, l q, l r, l s, l t
           WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS (SELECT o, i AS step, substr(o, i, 1) AS f, substr(o, 1, i - 1) AS before FROM orders, range(1, 6) z(i)),
hit AS (SELECT part, o, step, f, n, good, toxic, contains(fails, f) AS fails_f, fails = f AS only_f,
          before <> '' AND regexp_matches(fails, '[' || before || '_]') AS gone FROM g, steps),
counted AS (SELECT part, o, step, f, sum(CASE WHEN NOT gone AND NOT fails_f THEN n ELSE 0 END) AS kept,
          sum(CASE WHEN fails_f AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN fails_f AND gone THEN n ELSE 0 END) AS redundant,
          sum(CASE WHEN only_f THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN fails_f AND NOT gone AND good THEN n ELSE 0 END) AS good_lost,
          sum(CASE WHEN fails_f AND NOT gone AND toxic THEN n ELSE 0 END) AS toxic_lost FROM hit GROUP BY part, o, step, f)
SELECT part, o AS filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted"""
