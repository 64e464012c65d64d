"""Registered queries of the document operators, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrix.llm import bpe, exact_dedup, fingerprints, licenses, mixing, near_dedup, packing, pii, quality, ranking, rules, spelling, token_counts
from attrix.llm.shared import read_documents
from attrix.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; another one is a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_pack_tokens")
def op1(spark, sf_dir):
    return packing.pack_documents(read_documents(spark, sf_dir), tokenizer_path("byte_bpe_multi_50k.tiktoken"))


@query("op2_exact_dedup", exact_dedup.SQL)
def op2(spark, sf_dir):
    return exact_dedup.exact_duplicates(read_documents(spark, sf_dir))


@query("op3_mix_sources", mixing.SQL)
def op3(spark, sf_dir):
    mixed = mixing.mix_sources(read_documents(spark, sf_dir))
    return mixed.select("doc_id", "source", "mix_rate", "mix_copy", "mix_key", F.coalesce("text", F.lit("")).alias("text"))


@query("op4_token_counts")
def op4(spark, sf_dir):
    return token_counts.token_counts(read_documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


@query("op5_byte_bpe")
def op5(spark, sf_dir):
    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    ids = bpe.encode(read_documents(spark, sf_dir), path, with_bytes=True)
    return ids.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op6_license_scan")
def op6(spark, sf_dir):
    return licenses.digest(licenses.scan_licenses(read_documents(spark, sf_dir)))


@query("op7_fingerprints")
def op7(spark, sf_dir):
    return fingerprints.compare_with_next(read_documents(spark, sf_dir))


@query("op8_quality")
def op8(spark, sf_dir):
    docs = read_documents(spark, sf_dir)
    return quality.score_documents(docs, quality.fit_quality(docs, read_table(spark, sf_dir, "labels")))


@query("op9_personal_data")
def op9(spark, sf_dir):
    return pii.digest(pii.personal_data(read_documents(spark, sf_dir)))


@query("op10_minhash_near_dedup", near_dedup.SQL)
def op10(spark, sf_dir):
    return near_dedup.near_duplicates(read_documents(spark, sf_dir), percent=85)


@query("op11_spelling_variants", spelling.SQL)
def op11(spark, sf_dir):
    return spelling.spelling_variants(read_documents(spark, sf_dir))


@query("op12_quality_rules")
def op12(spark, sf_dir):
    docs = read_documents(spark, sf_dir)
    return rules.apply_rules(docs, rules.fit_rules(docs, read_table(spark, sf_dir, "labels")))


@query("op13_ranked_search", ranking.SQL)
def op13(spark, sf_dir):
    return ranking.rank_documents(read_documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))
