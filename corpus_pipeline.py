"""A corpus pipeline of five stages, each calling one operator of ``basketry.llm``.

``run`` applies them one after the other; between two stages the documents are written as Parquet and read again, so a
lost executor costs a re-read and no stage is computed twice. SQL can express neither the trained language filter nor
the sampled candidates, so there is no ORACLE_SQL; the tests hold ``run`` against brute force.

Every stage but the last returns the columns of ``documents``; ``n_chars`` follows the text. Documents with a null doc_id
pass the filters that compare ids; columns that ``documents`` does not have are dropped.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from basketry.functions.lineage import checkpoint_dir, cut_lineage
from basketry.llm import bpe, decontamination, language, lines, minhash
from basketry.llm.registry import table

ORACLE_SQL = None
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least share of n-grams that the language must hold, and letters from which it is asked for. Of the 10,000 documents of the
#: largest table, held-out ones included, the lowest share with as many letters is 0.46.
KNOWN, JUDGED = 0.25, 20


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the labelled ones: those without text or without a letter go, and those that hold at least
    ``JUDGED`` letters, but of whose n-grams less than ``KNOWN`` are of the language they are nearest to. Fewer letters are
    too little to reject by. Without labels every document with a letter stays."""
    model = language.train(docs.filter(~language.held_out()))
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    known = (F.col("known_share") >= KNOWN) | (F.char_length(F.regexp_replace("text", r"\P{L}+", "")) < JUDGED)
    return language.predict(docs, model, keep=COLUMNS).filter((F.col("lang_pred") != language.UNKNOWN) & known).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that a document of larger doc_id keeps, of those in three documents or more."""
    store = lines.LineStore(spark, f"{checkpoint_dir(spark)}/lines-{uuid.uuid4().hex}")
    store.insert(docs)
    return store.clean(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest doc_id, of each group of near-duplicates."""
    others = minhash.near_duplicates(docs).filter("doc_id <> class_id").select("doc_id")
    return docs.join(others, "doc_id", "left_anti").select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(found, "doc_id", "left_anti").select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text of every document."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id), ("line_dedup", line_dedup), ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination), ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
