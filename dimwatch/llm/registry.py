"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ball_kmeans, decontam, langid, lm_scoring, media, mixing, ngram_join, pii, resharding, row_patterns, secrets, token_counts, toxicity
from .common import table

#: Each tokenizer file's place comes from the package that carries them.
TOKENIZER = "piece_bpe_32k.model"


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scored_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified_documents(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found_documents(table(spark, sf_dir, "documents"))


def op11_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resharding.resharded(table(spark, sf_dir, "documents"))


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.clustered(table(spark, sf_dir, "embeddings"))


def op13_row_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_patterns.find_matches(table(spark, sf_dir, "clicks"))


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_language_id, op3_ngram_jaccard_join, op4_token_counts, op5_benchmark_decontamination, op6_mixing, op7_toxicity, op8_secret_scan, op9_media_columns, op10_pii, op11_resharding, op12_ball_kmeans, op13_row_patterns)}
ORACLE_SQL: dict[str, str] = {"op6_mixing": mixing.SQL, "op12_ball_kmeans": ball_kmeans.SQL, "op13_row_patterns": row_patterns.SQL}
