"""Queries of the driver's contract: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op1_license, op2_chat, op3_substring, op4_decontaminate, op5_bpe, op6_quality, op7_simhash, op8_warc, op9_urls, op10_html, op11_pack, op12_trie, op13_fim
from .oracle import ORACLE_SQL as ORACLE_SQL


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def vocabulary(path: str | None = None) -> op5_bpe.Vocabulary:
    import public_tokenizers

    return op5_bpe.load(path or vocabulary_path(), public_tokenizers.PATTERN)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op1_license.scan(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return op2_chat.digests(op2_chat.segments(rows.unionByName(more)))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op3_substring.dedup(_read(spark, sf_dir, "documents"), digest=True)
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_decontaminate.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_bpe.digests(_read(spark, sf_dir, "documents"), vocabulary())


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_quality.judge(_read(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def captures(pages: DataFrame) -> DataFrame:
    """A crawl's records: each page as a full response, and for each page a 304 of the same address.

    The response of page p is recorded at second 10 * p with an ETag made from its content, its revisit at a second
    between two responses: 25 seconds before that (then there may be no earlier response, or an older one of the
    same canonical URL), or 55, 135 or 215 after it (then a newer one may have come). The revisit carries the ETag that
    p had, or for one page in seven another one, and newer caching headers.
    """
    own, p = F.coalesce(F.col("html"), F.lit("")), F.col("page_id").cast("long")
    tag = F.concat(F.lit('"'), F.substring(F.sha2(own, 256), 1, 16), F.lit('"'))
    kind = "map<string,string>"
    response = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), tag, F.lit("Date"), F.concat(F.lit("t"), F.col("page_id")))
    named = F.when(p % 7 == 3, F.lit('"old"')).otherwise(tag)
    revisit = F.create_map(F.lit("etag"), named, F.lit("date"), F.concat(F.lit("r"), F.col("page_id")), F.lit("content-length"), F.lit("0"))
    first = pages.select((2 * p).alias("record_id"), F.lit("response").alias("type"), "url", (10 * p).alias("time"), response.cast(kind).alias("headers"), own.alias("payload"))
    later = 10 * (p - 3 + 8 * (p % 4)) + 5
    again = pages.select((2 * p + 1).alias("record_id"), F.lit("revisit").alias("type"), "url", later.alias("time"), revisit.cast(kind).alias("headers"), F.lit(None).cast("string").alias("payload"))
    return first.unionByName(again)


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = captures(_read(spark, sf_dir, "pages").select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")))
    out = op8_warc.resolve(records)
    lines = F.array_join(F.transform("headers", lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return out.select("record_id", "url", "response_id", "outcome", lines.alias("headers"), F.sha2("payload", 256).alias("payload_sha256"), F.char_length("payload").cast("long").alias("payload_chars"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_urls.judge(_read(spark, sf_dir, "pages"), op9_urls.default_rules(spark), op9_urls.default_listed(spark))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_html.extract(_read(spark, sf_dir, "pages"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_pack.pack(_read(spark, sf_dir, "documents"), op11_pack.load(tokenizer_path()))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_trie.rebuilt_prefixes(_read(spark, sf_dir, "conversations"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_fim.digests(_read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_license_scan, op2_chat_formatting, op3_substring_dedup, op4_benchmark_decontamination, op5_byte_bpe, op6_quality_rules, op7_simhash_near_dedup, op8_warc_revisits, op9_url_filter, op10_html_extraction, op11_packing, op12_prefix_trie, op13_fill_in_middle)
}
