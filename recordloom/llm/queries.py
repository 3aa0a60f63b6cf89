"""Thin queries of the training-data operators, by the names the driver knows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import toxicity
from recordloom.llm.chat_format import link
from recordloom.llm.common import table, tokenizer_path
from recordloom.llm.decontaminate import decontaminate
from recordloom.llm.exact_dedup import exact_dedup
from recordloom.llm.fill_in_middle import fill_in_middle, restore
from recordloom.llm.html_extract import extract_pages, fit_pages
from recordloom.llm.near_dedup import near_duplicates
from recordloom.llm.sentencepiece_codec import encode
from recordloom.llm.sharding import shard
from recordloom.llm.token_counts import token_counts
from recordloom.llm.token_files import documents as documents_of_files
from recordloom.llm.token_files import write_token_files
from recordloom.llm.url_filter import filter_urls, parse_rule
from recordloom.llm.whitening import whiten
from recordloom.session import scratch_path

#: The rules that the contract of op5 states.
URL_RULES = ["block com/en/", "allow example.com/en/7", "allow net/de/", "block example.net/de/8", "block org/es/"]


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of equal texts and its group of near duplicates (similarity of 0.8 or more); the smallest id stays."""
    out = near_duplicates(table(spark, sf_dir, "documents"), sources=True)
    return out.select("doc_id", "class_id", F.col("component").alias("cluster_id"), "kept")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with the rebuilt tokenizer, decoded again and held against the sentencepiece library."""
    out = encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), parity=True)
    return out.select("doc_id", "n_tokens", F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), "round_trip", "parity")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every document by a model of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    out = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "severity", "p_toxic", F.col("toxic_pred").alias("toxic"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return extract_pages(pages.select("page_id", "url", "html"), fit_pages(pages)).select("page_id", "url", "text", "n_chars")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by URL_RULES; what no rule fits is allowed."""
    judged = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), [parse_rule(x) for x in URL_RULES])
    return judged.select("page_id", "host", "path", "rule", "verdict")


#: Tools that the conversations may call.
TOOLS = {"search": (["query"], {"query": "string", "limit": "integer"}), "calculate": (["expression"], {"expression": "string"})}


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a canonical message with its links and its place in the order."""
    return link(table(spark, sf_dir, "conversations"), TOOLS)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards with counts at most one apart."""
    out = shard(table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item in windows of 13 words."""
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document by piece_bpe_32k.model."""
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), limit=4096)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays of its equal texts (the largest doc_id)."""
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by word_bpe_49k.json, written as wavelet files in the order of doc_id and read back."""
    folder = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), folder, end_id=2)
    return documents_of_files(spark, folder)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its middle last, cut at lines, and the text rebuilt from that."""
    out = fill_in_middle(table(spark, sf_dir, "documents"), seed=7, rate=100, spm=50)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the four leading components of all distinct ones, whitened."""
    return whiten(table(spark, sf_dir, "embeddings"), components=4, scale=256)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_toxicity": op3_toxicity,
    "op4_html_extract": op4_html_extract,
    "op5_url_filter": op5_url_filter,
    "op6_chat_format": op6_chat_format,
    "op7_sharding": op7_sharding,
    "op8_decontaminate": op8_decontaminate,
    "op9_token_counts": op9_token_counts,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_token_files": op11_token_files,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_whitening": op13_whitening,
}

_W = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op5_url_filter": r"""
        WITH r(action, h, p, k) AS (VALUES ('block', 'com', '/en/', 0), ('allow', 'example.com', '/en/7', 1), ('allow', 'net', '/de/', 2), ('block', 'example.net', '/de/8', 3), ('block', 'org', '/es/', 4)),
        u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        v AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
        SELECT page_id, host, path, best.rule AS rule, coalesce(best.action, 'allow') AS verdict
        FROM v LEFT JOIN LATERAL (SELECT h || p AS rule, action FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC, k LIMIT 1) best ON true""",
    "op8_decontaminate": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, {_W}) AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all({_LOW}, {_W}) AS w FROM benchmark),
        g AS (SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS s
              FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
        ms AS (SELECT DISTINCT m FROM g),
        dg AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS s
               FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, ms WHERE len(w) >= m)),
        hit AS (SELECT doc_id, i, dg.m, item_id FROM dg JOIN g ON dg.s = g.s AND dg.m = g.m),
        a AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + m - 1)) AS x FROM hit) GROUP BY doc_id),
        c AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN a USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op12_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
        u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
        k AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
              CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
        p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM k)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
        FROM p""",
}
