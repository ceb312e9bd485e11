"""A corpus pipeline of operators of notewright.llm: each stage takes what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.llm import decontaminate, language, packing, secrets, simhash
from notewright.llm.common import cut, table
from notewright.llm.queries import tokenizer


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts and texts without a letter. The network learns from the labelled ones."""
    label, score = fresh(docs, "pred"), fresh(docs, "score")
    out = language.predict(docs, language.train(docs), label_out=label, score_out=score)
    return out.where(F.col(label) != language.UNKNOWN).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, similarity 0.8 or more): the smallest id."""
    return simhash.deduplicate(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that repeat an item of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; n_chars follows."""
    spans, redacted = fresh(docs, "spans"), fresh(docs, "redacted")
    found = secrets.scan(docs, spans_col=spans, redacted_col=redacted)
    new = {"text": F.col(redacted), "n_chars": F.when(F.size(spans) > 0, F.length(redacted).cast("long")).otherwise(F.col("n_chars"))}
    return found.select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row for each piece, with its ids."""
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("language", identify), ("near_dedup", near_dedup), ("decontaminate", decontaminated), ("secrets", without_secrets), ("pack", packed)]
#: The network's and the tokenizer's results have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
