"""Documents to token ids: quality, exact and near duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and reads all that the one before kept;
all but the last return the columns of documents.  ``run`` writes each stage's
rows to the shared folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attrix.llm import bpe, exact_dedup, mixing, near_dedup, quality
from attrix.llm.queries import tokenizer_path
from attrix.llm.shared import materialize, normal_text, pick, read_documents
from attrix.session import read_table

#: No SQL: the compression classifier and the encoder can't be said in it.
ORACLE_SQL = None
RANKS = "byte_bpe_multi_50k.tiktoken"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _plain(docs: DataFrame) -> DataFrame:
    """The columns of documents; more columns and clashing names go."""
    return pick(docs, **{c: c for c in COLUMNS})


def _chosen(docs: DataFrame, kept: DataFrame, digest: Column) -> DataFrame:
    """Rows of ``docs`` whose (id, digest) is in ``kept`` (doc_id, text_sha256), one of each.

    Both parts are one key, so the join and the choice share an exchange of the texts."""

    def key(d: Column) -> Column:
        return F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), d)

    kept = kept.select(key(F.col("text_sha256")).alias("kept_row"))
    rows = docs.withColumn("row", key(digest))
    return rows.join(kept, rows["row"] == kept["kept_row"], "left_semi").dropDuplicates(["row"]).drop("row")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score of at least its threshold); without labels, all."""
    docs = _plain(docs)
    model = quality.fit_quality(docs, read_table(spark, sf_dir, "labels"))
    if model.constant is not None:  # not fitted: no ground to reject any
        return docs
    scored = docs.withColumn("score", quality.quality_score(F.col("text"), model))
    return scored.filter(F.col("score") >= quality.THRESHOLD).drop("score")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, the one with the smallest id; a row without an id only where no row of its text has one."""
    docs = _plain(docs)
    kept = materialize(exact_dedup.exact_duplicates(docs).filter("kept").select("doc_id", "text_sha256"), "kept-exact")
    return _chosen(docs, kept, F.sha2(normal_text(F.col("text")), 256))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id; rows without an id all stay."""
    docs = _plain(docs)
    kept = near_dedup.near_duplicates(docs, percent=80, with_digest=True).filter("kept AND doc_id IS NOT NULL")
    named = _chosen(docs.filter("doc_id IS NOT NULL"), kept, F.sha2(F.coalesce("text", F.lit("")), 256))
    return named.unionByName(docs.filter("doc_id IS NULL"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in random order."""
    return mixing.mix_sources(_plain(docs)).select(*COLUMNS)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with digests of the ids and of the bytes that they decode to."""
    path = tokenizer_path(RANKS)
    ids = bpe.encode(docs, path, with_bytes=True)
    return ids.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mix_sources", mix_stage),
    ("encode", encode_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
