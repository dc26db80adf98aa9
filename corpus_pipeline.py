"""The corpus pipeline: operators of ``crawlspark.llm`` as stages over ``documents``.

Every stage takes all rows that the one before it kept, of any columns, and all but the
last return the same columns. Defined cases: an empty table passes every stage as an empty
table; null texts and texts without a letter go in the first stage; rows with a null id
pass the stages that name documents by id; rows that repeat an id are judged by their own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crawlspark.llm import decontaminate, language_id, mixing, near_dup, sharding
from crawlspark.llm.common import discard, durable, keep, scratch, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language (by byte GRU trained on ``docs``); texts without a letter and those that the network rejects go.

    Where no row has a language there is nothing to learn, and all texts with a letter stay.
    """
    return language_id.accepted(docs, language_id.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 0.8 of five-word shingles: that of least id, then of least hash of its text.

    A row that repeats id and text stays once; rows that share only the id are different documents; rows without id all stay.
    """
    return near_dup.deduplicated(docs, width=5)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item to 0.8 of its five-word shingles; rows without id stay, as they cannot be named.

    All rows of an id go if one of them contains an item.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: 0 to 2 times. Its own source, size and hash of its id decide."""
    return mixing.mixed(docs)


def shard_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, repeats too, with the ``shard`` (``_shard`` where that name is taken) that the store keeps them in."""
    return sharding.sharded(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", shard_documents),
]
ORACLE_SQL = None  # language identification by a trained network has no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written and read again, and what it needed on the way is deleted."""
    docs, written = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        with scratch():
            docs = keep(durable(stage(spark, docs, sf_dir)))
        discard(*written)
        written = [docs]
    return docs
