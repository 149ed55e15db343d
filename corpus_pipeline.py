"""A corpus pipeline: toxicity, near duplicates, benchmark decontamination, token ids.

Each stage works on all that the one before it kept; run() writes and rereads the
tables between stages in the folder that the cluster shares. All stages but the last
return the columns of `documents`, whatever these are called; none of them fails on null
or empty texts, null or repeated ids, ties or empty tables, and each says what it does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import bpe, decontaminate, simhash, toxicity
from lexloom.llm.common import remove, shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from the labelled rows of `documents`, doesn't call toxic.

    Null, empty and wordless texts stay if the lexicon calls a text without hits clean;
    rows that share an id are judged each. Without labels the seed lexicon judges."""
    return toxicity.drop_toxic(docs, toxicity.train(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of SimHash near duplicates one row: that with the smallest doc_id, as `simhash.keep_first` orders rows.

    Null and blank texts are one group; rows that share an id but not a group all stay."""
    return simhash.keep_first(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of a benchmark item occurs; null and blank texts stay, as do all with an empty benchmark."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of the ids and of their decoding; a row each, null and empty texts without ids."""
    return bpe.encode(docs, ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_duplicates),
    ("decontaminate", drop_benchmark_leaks),
    ("bpe", token_ids),
]

#: SQL can express neither the learned lexicon nor the merges; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in their order, over whole `documents`; of the tables between them only that which the result reads stays."""
    docs = table(spark, sf_dir, "documents")
    base, last = shared_dir(spark), None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = f"{base}/{k}_{name}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if last:
            remove(spark, last)
        last = path
    return docs
