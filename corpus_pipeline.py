"""A corpus pipeline of five stages, each written as Parquet and read again before the next.

``run`` applies ``STAGES`` to ``documents``. All stages but the last return the
columns of ``documents``; the last returns the token digests of what was kept.
Stages write under the session's ``spark.checkpoint.dir`` (a session in one process may lack it and gets a temporary folder); a run
leaves its stages there for its result, which is read from the last of them.

Defined results: a document goes in the first stage if its text is null, has no letter or fits no learned language; of equal
texts and of near copies the least id stays, a null id only without another; of repeated rows one stays; very long texts are
processed whole; extra columns pass all stages but the last unchanged; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitweave.llm import bpe, exact_dedup, language_id, mixing, simhash
from hitweave.llm.common import packed, shared_folder

#: Words a shingle and least similarity of near copies.
NEAR = (5, 0.8)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that could be told; texts that are null, have no letter or fit no learned language go."""
    model = language_id.fit(docs)
    rows = docs.select(packed(docs).alias("row"), "text")
    found = language_id.identify(rows, model, ["row"])
    return found.filter("lang_pred != 'und' AND NOT undecided").select("row.*")


def first_of_equals(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each set of equal texts."""
    return exact_dedup.keep_first(docs)


def first_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each set of near copies: SimHash links, or sets of five-word shingles of similarity 0.8 or more."""
    return simhash.keep_representatives(docs, similar=NEAR)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, sorted by their place in the mix of sources."""
    return mixing.interleave(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests."""
    return bpe.token_digests(docs, *bpe.public_vocabulary())


STAGES = [
    ("language", known_language),
    ("exact_dedup", first_of_equals),
    ("near_dedup", first_of_near),
    ("mixing", mixed),
    ("byte_bpe", tokens),
]

#: SimHash components and token ids are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
