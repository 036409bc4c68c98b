"""From raw documents to encoded training text, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns
of ``documents``. ``run`` writes every stage's result as Parquet in the shared folder and reads it again as the next
one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import decontaminate, language, near_dup, pieces, queries, toxicity
from foliant.llm.store import Scratch, collecting


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told: null texts, texts without a letter, and those whose codewords leave
    two languages nearly as likely."""
    return language.keep_identified(docs, queries.language_model(spark, sf_dir))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score is 0.7 or more."""
    return toxicity.keep_clean(docs, queries.toxicity_model(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group of near duplicates."""
    return near_dup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of any benchmark item occurs."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of the pieces, their number, and whether they decode to the text."""
    return pieces.encoded(docs, queries.piece_model())


STAGES = [
    ("language", identify_language),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode_pieces),
]

ORACLE_SQL = None  # models and a tokenizer; tested against brute force instead


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Tables of a stage are deleted once its result is written, and results once the next is."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    before = None
    for _, stage in STAGES:
        with collecting() as made:
            after = scratch.table(stage(spark, docs, sf_dir))
        for s in made:
            s.clear()
        if before is not None:
            scratch.drop(before)
        docs = before = after
    return docs
