"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir). Documents travel as one column beside what an operator reads, so a column
of theirs leaves a stage as it came, whatever its name; only the last stage adds columns, and replaces those of
its names. Defined results, beyond those of the operators: rows are judged one by one, repeated rows alike; an empty
table stays empty; a null in any column but text and those a stage names below changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.llm import language_id, mixing, near_copies, pieces, quality
from veldspar.llm._shared import carried, read, scratch_path
from veldspar.llm.queries import piece_model


def _framed(docs: DataFrame, *columns: str) -> DataFrame:
    """docs as one column, __docs, beside those that an operator reads."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__docs"), *columns)


def _beside_text(docs: DataFrame) -> DataFrame:
    """docs as their text and one column, __docs, of all others: what Python gets holds each text once."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("__docs"), "text")


def _columns(docs: DataFrame) -> list[Column]:
    """The columns of docs from _beside_text, in their order."""
    return [F.col("text") if c == "text" else F.col("__docs")[c].alias(c) for c in docs.columns]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that language identification rejects: those far from every learned language, those without a
    letter, and those with a null text. Learned from documents with a lang, which null ids are among."""
    model = language_id.fit(language_id.learned_rows(docs, F.col("doc_id")))
    found = language_id.identify(_beside_text(docs), model, keep=["__docs", "text"])
    return found.where(~F.col("lang_rejected")).select(*_columns(docs))


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that break a quality rule; null and empty texts break the first."""
    return quality.judge(_framed(docs, "text"), keep=["__docs"]).where("kept").select("__docs.*")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the least id, of each near-duplicate group; null ids come last, ties go by the
    whole row. Near copies have a similarity of 0.8 or more by words of five. Null and empty texts are one group, and rows that are equal in all columns are one document."""
    return near_copies.first_rows(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. A null source is a source; texts without words are not taken."""
    found = mixing.mix(_framed(docs, "text", "source"), keep=["__docs"], drawn_by=["__docs"]).where("copies > 0")
    return found.select("__docs", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("__docs.*")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids, the byte spans of their pieces, and the decoded text; null texts have no pieces."""
    found = pieces.encode(_beside_text(docs), piece_model(), keep=["__docs", "text"])
    new = found.columns[2:]
    return found.select(*_columns(docs.select(carried(docs, None, new))), *new)


STAGES = [
    ("language_id", keep_known_languages),
    ("quality_rules", keep_good_quality),
    ("simhash_dedup", keep_one_of_each_group),
    ("mix_sources", mix_sources),
    ("piece_encoding", encode_pieces),
]

#: Stages 1, 3 and 5 cannot be put in SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each materialised before the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
