"""From documents to token ids: toxicity, line dedup, near dedup, mixing and encoding, one stage after another."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.llm import bpe, line_dedup, mixing, near_dedup, toxicity
from quirespark.shared import freeze, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose score is 0.5 or more; other rows as they are.

    Null, empty and very long texts are scored as any other; without a telling expression they stay. Repeated rows are
    judged alike, each by its text. Without labels of both classes every row stays. An empty table stays empty. A column
    of docs may have any name.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = "_toxicity_score"
    while score in docs.columns:
        score += "_"
    return toxicity.add_scores(docs, model, into=score).where(F.col(score) < 0.5).drop(score)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines that are in ten documents or more; n_chars follows the text.

    Every row stays. A null text becomes an empty one, of 0 characters. Rows that repeat an id, or have none, count as
    further documents. A text of only common lines becomes empty. Very long texts are split whole. An empty table stays
    empty.
    """
    return line_dedup.without_frequent_lines(docs, min_docs=10).withColumn("n_chars", F.char_length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; rows as they are.

    Null and empty texts are nobody's duplicates and stay. Of exact copies one stays, of rows that repeat an id too; rows
    without an id come after all others. Very long texts are compared whole. An empty table stays empty.
    """
    return near_dedup.first_of_each_group(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; rows as they are.

    Documents without words (null, empty or blank) have size 0: they weigh nothing and are repeated as others of their
    source, three times at most. A null source is a source of its own.
    Rows that repeat an id, or have none, are further documents. Reruns take the same. An empty table stays empty.
    """
    return mixing.mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """For every row of the mix doc_id, n_tokens, ids (little-endian unsigned 32-bit), ids_sha256 and decoded_sha256 (of
    the ids decoded again).

    Null and empty texts have no ids. Rows that repeat an id, or have none, are encoded each on its own, very long texts
    whole. An empty table stays empty.
    """
    back = bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY)
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("source_mixing", mix),
    ("byte_bpe", encode),
]

#: SQL expresses neither the model of the first stage nor the last; tests hold each stage against a plain version.
ORACLE_SQL = None


@contextmanager
def _batches_of(spark: SparkSession, size: str) -> Iterator[None]:
    """Meanwhile an Arrow batch ends once it holds `size`: what a task buffers outside the heap, and its Python worker
    once more, is that or one row."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with _batches_of(spark, "4m"):
        for name, stage in STAGES:
            docs = freeze(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
