"""Corpus preparation: the stages that turn raw documents into token files.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it kept. All but the
last return the columns of ``documents``, and others that there are, whatever their names. Between
stages the rows are written and read again. Null, empty and very long texts, rows that share an id,
repeated rows and empty tables go through every stage; what becomes of them stands at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from photolake.llm import mixture, simhash, suffix_match, tokens, toxicity
from photolake.llm.tables import table
from photolake.storage import materialize, scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds toxic go.

    Rows are judged one by one, by their whole text; a null text has no words. Without labels all stay.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.learned_rows())
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays.

    Of repeated rows one stays, and null and empty texts are one group; the smallest id decides, and a
    group without any id keeps its different texts.
    """
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go.

    Null texts have no words and stay; an empty benchmark takes nothing away.
    """
    return suffix_match.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, in the order of the schedule's slots.

    Documents without a word go; a null source is a source of its own; rows that share an id share what
    is taken of them once.
    """
    return mixture.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and what each document has in them.

    Documents follow each other as they stand in the table, which is how the mix has dealt them; a
    document that the mix takes twice is there twice. Where the table's order is not known, as it is not
    read from files, documents are in ascending order of ids, null ones first.
    """
    folder = scratch_path(spark, "corpus")
    kind = "long" if isinstance(docs.schema["doc_id"].dataType, T.IntegralType) else "string"
    rows, order = tokens.in_stored_order(docs)
    return tokens.read_token_files(tokens.write_token_files(rows, folder, order=order), folder, kind)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixture", mix_sources),
    ("token_files", write_tokens),
]

#: Classifier, fingerprints and tokenizer have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
