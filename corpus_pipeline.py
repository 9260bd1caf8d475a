"""The corpus pipeline: toxic documents go, near copies go, repeated passages go, sources are mixed to
their target weights, and what is left is packed into training sequences."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import mixing, packing, simhash, suffix_dedup, toxicity
from lectern.llm.common import ship, table, work_dir

#: Documents with a score above this are rejected.
TOXIC = 0.5


def apart(docs: DataFrame, names: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work(docs) with the columns of docs, where those called like an operator's own are kept from it."""
    held = {c: f"_held_{c}" for c in docs.columns if c in names}
    return work(docs.withColumnsRenamed(held)).select(*[F.col(held.get(c, c)).alias(c) for c in docs.columns])


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored TOXIC or more go; null and empty texts score as the bias alone and stay."""
    ship(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return apart(docs, ["_score"], lambda d: toxicity.score(d, model, "_score").where(F.col("_score") < TOXIC))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles) the row with the smallest doc_id stays."""
    ship(spark)
    return apart(docs, ["_text_id"], simhash.keep_first)


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every byte of a 200-byte passage that stands anywhere else goes; code points cut apart go whole."""
    ship(spark)

    def cut(d: DataFrame) -> DataFrame:
        kept = F.when(F.size("spans") > 0, suffix_dedup.whole_characters(F.col("kept"))).otherwise(F.col("text"))
        return suffix_dedup.remove_repeats(d).withColumn("text", kept).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))

    return apart(docs, ["kept", "spans"], cut)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh the square root of their size; a document stays as often as drawn."""
    return apart(docs, ["n_copies", "copy", "mix_key"], mixing.mix)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of 1024 tokens."""
    import public_tokenizers

    ship(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", remove_toxic),
    ("simhash near-dedup", near_dedup),
    ("suffix-array dedup", remove_passages),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: A trained model and sketches of all documents are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{work_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = os.path.join(base, str(k))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
