"""A training corpus from `documents`: language, near-duplicates, benchmark passages, mixture, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbgrid.llm import langid
from plumbgrid.llm.common import cut_lineage, load, release, scratch
from plumbgrid.llm.decontaminate import decontaminate
from plumbgrid.llm.mixing import mixed_texts
from plumbgrid.llm.simhash import one_of_each_group
from plumbgrid.llm.token_files import token_output

#: Texts that switch between two or three languages stay; no language has three tenths of a rejected text's words.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters go, and those in which no language prevails."""
    return langid.in_one_language(docs, langid.learned(docs), LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, the one with the least id."""
    return one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words a twentieth or more stands in benchmark passages go."""
    return decontaminate(docs, load(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by weight; a row for each epoch that takes a document, the last of a source cut at its budget."""
    return mixed_texts(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the shared folder, and a row for each text in them."""
    return token_output(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: Learned labels and hash orders are beyond SQL; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`: doc_id, start, n_tokens, ids_crc32 of each text in the token files.

    Each stage's rows are written to the shared folder before the next one reads them, and what only led to them is
    deleted. Null, empty and repeated texts go through as the stages define it; an empty table gives no rows.
    """
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            done = keep(cut_lineage(stage(spark, docs, sf_dir), name))
        release(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
