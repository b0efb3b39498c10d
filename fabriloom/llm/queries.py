"""The registered queries of these operators, and SQL for those that SQL can express."""

from pyspark.sql import DataFrame, SparkSession

from fabriloom.llm import oracles
from fabriloom.llm.decontamination import op8_decontamination
from fabriloom.llm.fingerprints import op10_fingerprints
from fabriloom.llm.jaccard_join import op5_jaccard_join
from fabriloom.llm.language import op4_language
from fabriloom.llm.language_model import base_scores, op13_language_model
from fabriloom.llm.licenses import op9_licenses
from fabriloom.llm.merkle import op11_merkle
from fabriloom.llm.mixing import op1_mixing
from fabriloom.llm.quality import op6_quality
from fabriloom.llm.suffix_dedup import op7_suffix_dedup
from fabriloom.llm.toxicity import op3_toxicity
from fabriloom.llm.warc import op2_warc
from fabriloom.llm.whitening import embedding_deviations, op12_whitening


def licence_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9_licenses that SQL can express."""
    return op9_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10_fingerprints that SQL can express."""
    return op10_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


QUERIES = {f.__name__: f for f in (op1_mixing, op2_warc, op3_toxicity, op4_language, op5_jaccard_join, op6_quality, op7_suffix_dedup, op8_decontamination, op9_licenses, op10_fingerprints, op11_merkle, op12_whitening, op13_language_model, licence_phrases, edited_texts, embedding_deviations, base_scores)}

ORACLE_SQL: dict[str, str] = {
    "op2_warc": oracles.WARC,
    "op5_jaccard_join": oracles.JACCARD,
    "op7_suffix_dedup": oracles.SUFFIX,
    "op8_decontamination": oracles.DECONTAMINATION,
    "op11_merkle": oracles.MERKLE,
    "embedding_deviations": oracles.EMBEDDING_DEVIATIONS,
    "base_scores": oracles.BASE_SCORES,
    "licence_phrases": oracles.LICENCE_PHRASES,
    "edited_texts": oracles.EDITED_TEXTS,
}
