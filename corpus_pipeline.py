"""From raw documents to packed sequences, in stages that each write what they keep.

In every stage but the last an input column stays as it is, whatever its name, and

* a null text counts as empty; rows with a null in any other column are rows like others
* a text of any length is read whole; repeated rows are judged alike, each for itself
* an empty table gives an empty result (a model without a row to learn from rejects nothing
  but what has no letter, no word or too few)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import language, packing, quality, similar
from quillon.llm.common import discard, materialise, read_table, scratch
from quillon.llm.queries import vocabulary

#: A document whose best language has less of the probability is rejected.
LEAST_SCORE = 0.4


def _private(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` under names that no operator adds, and the name of the text."""
    return docs.toDF(*(f"__in{k}" for k in range(len(docs.columns)))), f"__in{docs.columns.index('text')}"


def _public(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*(F.col(f"__in{k}").alias(c) for k, c in enumerate(docs.columns)))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without text or letters, and those that fit no language.

    The model is learned from a sample of the rows whose ``lang`` and ``doc_id`` aren't null;
    if there is none, every text with a letter stays.
    """
    model = language.fit(docs, F.lit(True))
    rows, text = _private(docs)
    if model is None:
        return _public(rows.filter(F.coalesce(F.col(text), F.lit("")).rlike(r"\p{L}")), docs)
    found = language.identify(rows, model, text)
    return _public(found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)), docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what fails the base test or the rules learned from the labels."""
    rules = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    rows, text = _private(docs)
    return _public(quality.rate(rows, rules, text).filter("kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: words in shingles of five, similarity 0.8 or more.

    It is the one with the least doc_id.  Of repeated rows (doc_id and text) one stays;
    different texts with one doc_id are different documents; rows without a doc_id all stay.
    """
    return similar.keep_one(docs, shingle=5, similarity=0.8)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens; the last stage, so its columns are its own."""
    return packing.pack(packing.pieces(docs, vocabulary(), size=1024, eos=2), size=1024)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("best_fit_packing", best_fit_packing),
]

#: The stages learn models and tokenize, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each on what the one before wrote.

    A stage's tables are deleted once the next stage's output is written.
    """
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch() as kept:
            found = materialise(stage(spark, docs, sf_dir), name)
            kept.append(found)
        if before is not None:
            discard(before)
        docs = before = found
    out = STAGES[-1][1](spark, docs, sf_dir)
    discard(docs)  # packing has written its pieces and reads nothing else
    return out
