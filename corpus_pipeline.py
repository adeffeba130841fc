"""From raw documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. It is written
as Parquet to the shared folder and read again as the next stage's documents,
so an executor lost later costs no more than the running stage.

1. language ID: documents without a letter, and those whose language can't be
   told from the runner-up, go.
2. line dedup: lines of templates that recur across documents are dropped, but
   for the first; all documents stay.
3. n-gram Jaccard join: of each group of near duplicates the document with the
   smallest id stays.
4. mixing: each document is repeated as often as drawn for its source.
5. packing: pieces of token sequences.

Nulls, empty and very long texts, ties, repeated rows, empty tables and extra
columns: as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm.common import documents, stage
from ledgerline.llm.op1_language_id import keep_identified
from ledgerline.llm.op3_line_templates import drop_boilerplate
from ledgerline.llm.op6_packing import pack
from ledgerline.llm.op7_parity_join import keep_one_of_each
from ledgerline.llm.op9_mixing import mix_sources
from ledgerline.operators.sequence import discard, staged_within


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of the packed sequences."""
    return pack(docs)


STAGES = [
    ("language_id", keep_identified),
    ("line_dedup", drop_boilerplate),
    ("ngram_jaccard_join", keep_one_of_each),
    ("mixing", mix_sources),
    ("packing", pack_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; what a stage has staged goes when its result is written."""
    docs = before = documents(spark, sf_dir)
    for name, step in STAGES:
        with staged_within(spark) as block:
            docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
            block.keep(docs)
        if name != STAGES[0][0]:
            discard(before)
        before = docs
    return docs


# classifiers and the tokenizer are not SQL: tested stage by stage instead
ORACLE_SQL = None
