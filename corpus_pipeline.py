"""The corpus pipeline: toxicity, language, near-duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir), judges all documents that the stage before it kept, and
returns a DataFrame that is written as Parquet and read again as the next one's ``docs``. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoflow.llm import decontamination, language, neardup, packing, toxicity
from ontoflow.llm.common import read, shared_dir, vocabulary_path

#: Below this share of the largest possible agreement with the nearest profile, a text is in none of the
#: learnt languages. Of 51,282 table documents the least scores 0.35 (short ones, full of numbers and
#: addresses), and prose of those languages from elsewhere 0.34 to 0.39; Polish scores 0.17, Turkish 0.21,
#: Russian 0.00, base64 0.20, rows of consonants 0.23.
LEAST_LANGUAGE_SCORE = 0.28


def _unused(name: str, columns: list[str]) -> str:
    while name in columns:
        name = f"_{name}"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose toxicity score is below a half; the model learns from ``labels``.

    Null and empty texts, and those without a letter, aren't toxic. Rows that repeat are judged each, an
    empty table stays empty, and columns may have any name. Without labels nothing goes.
    """
    model = toxicity.fit_model(toxicity.training_rows(docs, read(spark, sf_dir, "labels")))
    score = _unused("toxic_score", docs.columns)
    return toxicity.score_toxicity(docs, model, keep=docs.columns, name=score).where(F.col(score) < 0.5).drop(score)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in a learnt language; those in none of them, and those without a letter, go.

    Profiles are learnt from the documents that aren't held out. A text is in none of the languages if it
    agrees with the nearest by less than LEAST_LANGUAGE_SCORE. Null texts go too; rows that repeat are
    judged each, and an empty table stays empty.
    """
    learnt = docs.where(~language.held_out(3, 1) & F.col("doc_id").isNotNull())
    profiles = language.learn_profiles(learnt)
    name, score = _unused("lang_pred", docs.columns), _unused("lang_score", docs.columns)
    judged = language.predict_language(docs, profiles, keep=docs.columns, names=(name, score))
    return judged.where((F.col(name) != language.UNDETERMINED) & (F.col(score) >= LEAST_LANGUAGE_SCORE)).drop(name, score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates: that with the smallest doc_id.

    Null texts are no duplicates and all stay; of rows that repeat one stays; an empty table stays empty.
    """
    return neardup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that hold no window of the benchmark.

    Null and empty texts hold none, and an empty benchmark rejects nothing. Rows that repeat are judged each.
    """
    found = _unused("found", docs.columns)
    judged = decontamination.find_passages(docs, read(spark, sf_dir, "benchmark"), keep=docs.columns, result=found)
    return judged.where(F.col(found)["n_hit"] == 0).drop(found)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids of what is left, with the ids.

    Null and empty texts are the end id alone; rows that repeat are packed each; an empty table gives none.
    """
    return packing.pack_documents(docs, vocabulary_path(), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL can't express the trained stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each result written to the shared folder and read again.

    Nulls, repeated rows and empty tables are as the stages say; other columns of ``documents`` go
    through all stages but the last.
    """
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
