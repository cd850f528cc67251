"""The corpus pipeline: documents to token files, in five stages.

Each stage is (name, function of (spark, docs, sf_dir)); what one returns is written as Parquet and read again as the
docs of the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from causalframe.llm.decontam import decontaminated
from causalframe.llm.mixing import mixed
from causalframe.llm.scratch import table, written
from causalframe.llm.neardup import first_of_groups
from causalframe.llm.tokens import read_tokens, tokenizer_path, write_tokens
from causalframe.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. Null and empty texts have the score of no words; repeated rows are scored alike; without labels none goes."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays, that of the least doc_id: SimHash blocks, then Jaccard 0.8 or more on 5-word shingles.

    Texts without words, null ones too, are one group. A row without a doc_id comes last in its group; of rows that are
    equal in all columns one stays.
    """
    return first_of_groups(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold four fifths of the shingles of a benchmark item go. Null texts hold none, and items without words are held by none."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated so that sources have their target numbers of words. Those of no words stay; a null source is one."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mix, written to files and read back: doc_id, start, n_tokens, ids_crc32 of each document.

    A null or empty text has the end id alone; rows without a doc_id come first; repeated rows stay. Every stage gives no
    rows for no rows, and keeps columns of any name.
    """
    return read_tokens(*write_tokens(docs, tokenizer_path()))


STAGES = [("toxicity", toxicity), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]

#: No SQL: toxicity is learnt, and tokens come from a tokenizer's file. tests/llm/test_plain_versions.py sets each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
