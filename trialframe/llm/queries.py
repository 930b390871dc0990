"""Queries over whole tables, one for each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, licenses, neardup, oracles, packing, pii, quality, secret_scan, substring, token_store, warc

#: Where the tokenizer's file is, and the id that ends a document.
TOKENIZER, END_ID = "byte_bpe_50k.json", 2


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.sanitised(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_removed", "n_general", F.sha2("clean_text", 256).alias("clean_sha256"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_spans(_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = warc.write_archives(_table(spark, sf_dir, "pages"))
    return warc.read_records(spark, folder, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(_table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_rules(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(_table(spark, sf_dir, "documents"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_store.write_store(_table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)
    token_store.root_of(store)
    return token_store.read_store(store).select("doc_id", F.col("start").cast("long").alias("start"), "n_tokens", "ids_crc32")


def op10_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, percent=85)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_pii, op2_decontamination, op3_license_scan, op4_warc, op5_secret_scan, op6_quality_rules, op7_best_fit_packing, op8_substring_dedup, op9_token_store, op10_minhash_near_dup)
    return {f.__name__: f for f in every}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP4 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, b, octet_length(b) AS n, sha1(b) AS h, min(page_id) OVER (PARTITION BY b) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""


def _op6() -> str:
    rules = {
        "few_words": f"n_words < {quality.MIN_WORDS}",
        "repeats": f"100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words",
        "symbols": "10 * n_symbols > 5 * word_chars",
        "dup_lines": "2 * n_dup_lines > n_words",
        "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
    }
    sums = ", ".join(f"count(*) FILTER ({r}) AS f_{k}" for k, r in rules.items())
    prior = ", ".join(f"least(greatest(sum(f_{k}) / sum(n), 1e-6), 1 - 1e-6) AS m_{k}, sum(f_{k} / n * f_{k}) / sum(n) AS q_{k}, sum(f_{k}) / sum(n) AS r_{k}" for k in rules)
    weight = ", ".join(
        f"m_{k}, least(greatest(m_{k} * (1 - m_{k}) / greatest(greatest(q_{k} - m_{k} * m_{k}, 0) - m_{k} * (1 - m_{k}) * h / t, 1e-9) - 1, 2.0), 1e4) AS w_{k}" for k in rules
    )
    bad = " OR ".join(f"(f_{k} + m_{k} * w_{k}) / (n + w_{k}) > {quality.HOST_LIMIT}" for k in rules)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
win AS (SELECT r, i, array_to_string(list_slice(w, i, i + 7), ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + o) AS n FROM rep, range(0, 8) t(o) GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT r, doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN cov USING (r) LEFT JOIN lines USING (r)),
hosts AS (SELECT source, count(*)::DOUBLE AS n, {sums} FROM m GROUP BY source),
prior AS (SELECT sum(n) AS t, count(*) AS h, {prior} FROM hosts),
fit AS (SELECT {weight} FROM prior),
bad AS (SELECT source FROM hosts, fit WHERE {bad}),
v AS (SELECT *, {rules["few_words"]} OR {rules["repeats"]} AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM v.source) AS kept FROM v
"""


_OP8 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT r, doc_id, i, md5_number(array_to_string(list_slice(w, i, i + 49), ' ')) AS g FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
hit AS (SELECT r, i FROM (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM win) WHERE first < doc_id),
pos AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
-- a word is covered if a reported window starts at it or up to 49 words before
cov AS (SELECT p.r, p.i, p.x, max(h.i) OVER (PARTITION BY p.r ORDER BY p.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM pos p LEFT JOIN hit h ON p.r = h.r AND p.i = h.i),
k AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(x, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM cov GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""

_OP10 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, list_slice(w, i, i + 2) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
  UNION ALL SELECT doc_id, w FROM d WHERE len(w) BETWEEN 1 AND 2)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT DISTINCT a AS v, a AS t FROM edge UNION SELECT r.v, e.b FROM reach r JOIN edge e ON e.a = r.t),
comp AS (SELECT v, min(t) AS c FROM reach GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id, d.doc_id = coalesce(c, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comp ON comp.v = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_pii": oracles.op1(), "op2_decontamination": oracles.op2(), "op4_warc": _OP4, "op5_secret_scan": oracles.op5(), "op6_quality_rules": _op6(), "op8_substring_dedup": _OP8, "op10_minhash_near_dup": _OP10}
