"""Registered queries: each operator over its whole table, with its production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freightgraph.llm.chunk_dedup import repeated_spans
from freightgraph.llm.conversation_repair import damaged, repair_conversations
from freightgraph.llm.decontaminate import CONTAINMENT, contaminated
from freightgraph.llm.fingerprint import fingerprint_documents
from freightgraph.llm.html_extract import extract_text
from freightgraph.llm.language_id import LanguageModel, identify_languages
from freightgraph.llm.license_scan import scan_licenses
from freightgraph.llm.packing import pack_documents
from freightgraph.llm.prefix_trie import conversation_trie
from freightgraph.llm.sharding import shard_rows
from freightgraph.llm.simhash import near_duplicates
from freightgraph.llm.toxicity import fit_toxicity, score_toxicity
from freightgraph.llm.url_filter import RULES, SOFT, SOFT_HITS, STRICT, filter_urls

SHARDS = 40
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS)


def fold() -> F.Column:
    """0 for held-out documents."""
    return F.crc32(F.col("doc_id").cast("string")) % 5


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filter_urls(table(spark, sf_dir, "pages"))
    return found.select("page_id", "host", "path", "rule", "verdict", "strict_terms", "soft_terms", "weight", "rejected")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), *tokenizer_paths())


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    dealt = shard_rows(rows, ["doc_id", "text_crc32", "size"], SHARDS)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = LanguageModel.fit(docs.where(fold() != 0))
    found = identify_languages(docs, model)
    return found.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score", "languages")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs.where(fold() != 0), labels.where(fold() != 0))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_url_filter, op2_packing, op3_fingerprint, op4_license_scan, op5_substring_dedup,
    op6_sharding, op7_simhash, op8_language_id, op9_decontamination, op10_toxicity,
    op11_conversation_repair, op12_html_extraction, op13_prefix_trie,
)}


def _url_filter_sql() -> str:
    hits = lambda words: " + ".join(
        f"CAST(regexp_matches(u, '(^|[^\\p{{L}}\\p{{N}}]){w}($|[^\\p{{L}}\\p{{N}}])') AS INTEGER)" for w in words)
    weigh = lambda words: " + ".join(
        f"{x} * CAST(regexp_matches(u, '(^|[^\\p{{L}}\\p{{N}}]){w}($|[^\\p{{L}}\\p{{N}}])') AS INTEGER)" for w, x in words.items())
    fits = lambda r: f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))"
    by_length = sorted(RULES, key=lambda r: (-r.host.count("."), -len(r.host), -len(r.path)))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r.text}'" for r in by_length)
    allow = ", ".join(f"'{r.text}'" for r in RULES if r.allow)
    return f"""
WITH a AS (SELECT page_id, url, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
b AS (SELECT page_id, u, translate(regexp_extract(r, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^([^/?#]*)([^?#]*)', 2) AS path FROM a),
c AS (SELECT page_id, host, path, CASE {rule} END AS rule, {hits(STRICT)} AS strict_terms, {hits(SOFT)} AS soft_terms, CAST({weigh(STRICT | SOFT)} AS DOUBLE) AS weight FROM b)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ({allow}) THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN strict_terms > 0 OR soft_terms >= {SOFT_HITS} THEN 'block' ELSE 'allow' END AS verdict,
  strict_terms, soft_terms, weight, (strict_terms > 0 OR soft_terms >= {SOFT_HITS}) AS rejected
FROM c"""


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _decontamination_sql() -> str:
    shingles = lambda t, k: f"""SELECT DISTINCT {k}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s
    FROM (SELECT {k}, {_WORDS} AS w FROM {t} WHERE {k} IS NOT NULL)"""  # noqa: E731
    return f"""
WITH d AS ({shingles("documents", "doc_id")}), q AS ({shingles("benchmark", "item_id")}),
n AS (SELECT item_id, count(*) AS n_shingles FROM q GROUP BY item_id),
h AS (SELECT doc_id, item_id, count(*) AS hits FROM d JOIN q USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, hits, n_shingles, round(hits / n_shingles, 6) AS containment
FROM h JOIN n USING (item_id) WHERE hits >= n_shingles * {CONTAINMENT}"""


ORACLES = {"op1_url_filter": _url_filter_sql(), "op9_decontamination": _decontamination_sql()}
