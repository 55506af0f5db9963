"""The registered queries opN_<name>, each a thin use of one operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import read
from .mixing import SQL as MIXING_SQL


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_tree import extract

    return extract(read(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify

    return identify(read(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(read(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from .byte_bpe import encode_documents

    return encode_documents(read(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=False).drop("round_trip")


def op1_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"), shingle=4, percent=80).drop("n_equal")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import plan

    return plan(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import replace_pii, session_key

    return replace_pii(read(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))


def op4_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lz_fingerprint import edited_likeness

    return edited_likeness(read(spark, sf_dir, "documents")).withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


def op5_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from .token_output import token_corpus

    return token_corpus(read(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), P.PATTERN, end_id=2, vocabulary=50_257, added_tokens=True)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {f.__name__: f for f in (op1_minhash_neardup, op2_source_mixing, op3_pii_surrogates, op4_lz_fingerprint, op5_token_binary, op6_quality_rules, op7_html_extraction, op8_language_id, op9_suffix_dedup, op10_byte_bpe)}

ORACLE_SQL: dict[str, str] = {"op2_source_mixing": MIXING_SQL}
