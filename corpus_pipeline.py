"""A corpus from documents to token ids: five stages, each a training-data operator over all that the one before it kept.

Every stage is a function (spark, docs, sf_dir) -> DataFrame; all but the last return the columns of `documents`. Between stages the
table is written as Parquet and read again, so that no stage repeats another's work and lost executors cost one stage at most. Before a
stage executors give back the heap that the one before has left.

In all stages: a null doc_id stays null and is an id like any other, a null text counts as empty, other columns of any name and type
are kept as they are, texts of any length are read whole, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import queries as llm
from tidemark.llm.bpe import bpe_round_trip
from tidemark.llm.common import released, written
from tidemark.llm.decontaminate import decontaminated
from tidemark.llm.jaccard import one_of_each
from tidemark.llm.language import accepted_documents
from tidemark.llm.substrings import dedup_substrings
from tidemark.plans.session import ship_package


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; `lang` becomes what was identified.

    Null and empty texts and texts without letters go, for they are in no language. Of languages that are equally likely the first by name
    counts. Rows that are equal are judged alike and all stay.
    """
    ship_package(spark)
    return accepted_documents(released(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the least id, null last, and of equal ids that of the least hash of its text.

    Documents without words (null, empty, white space) are linked with nothing and stay, each row of them. Of rows that are equal in id and
    text one stays.
    """
    ship_package(spark)
    return one_of_each(released(docs))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand earlier; texts that lose nothing stay as they were, letter for letter.

    Null and empty texts and texts shorter than a window lose nothing; a text may lose all its words and is empty then, but its row stays.
    Rows that are equal in id and text are one document and are cut alike. `n_chars` follows where there is such a column.
    """
    ship_package(spark)
    names = docs.columns
    cut = dedup_substrings(released(docs)).toDF(*[f"_{i}" for i in range(len(names))], "kept", "words", "removed")
    changed = F.col("removed") > 0

    def column(i: int, name: str):
        own = F.col(f"_{i}")
        if name == "text":
            own = F.when(changed, F.col("kept")).otherwise(own)
        elif name == "n_chars":
            own = F.when(changed, F.length("kept")).otherwise(own).cast("long")
        return own.alias(name)

    return cut.select(*[column(i, name) for i, name in enumerate(names)])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item lies, near copies of items included.

    Rows are judged by their text alone, so equal texts go or stay together. Null and empty texts hold nothing and stay; items that are null
    or have no word lie nowhere; with an empty benchmark all documents stay.
    """
    ship_package(spark)
    return decontaminated(released(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the text they decode to: doc_id, n_tokens, ids_sha256, decoded_sha256, ids.

    A null or empty text has no ids. Rows that are equal give equal rows, one for each.
    """
    ship_package(spark)
    return bpe_round_trip(released(docs), llm.tokenizer_path("byte_bpe_50k.json"), with_ids=True)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("substring_dedup", substring_dedup), ("decontaminate", decontaminate), ("encode", encode)]

#: The stages learn, hash and search; SQL can't express them, so their results are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
