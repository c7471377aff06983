"""Row keys for tables whose ids may be null or repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.shared import freeze, partitions


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """See keys_of; without the mark."""
    return keys_of(docs, id_col, text_col)[0]


def whole_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns key, id, text and rest, a struct of all columns but the text."""
    return keys_of(docs, id_col, text_col, [c for c in docs.columns if c != text_col])[0]


def keys_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rest: list[str] | None = None) -> tuple[DataFrame, bool]:
    """Columns key (a long, unique, in the order of the ids), id and text; with rest, a struct of these columns.

    Where the ids are whole numbers, without nulls or repeats, the key is the id itself. Otherwise the rows are put
    in order (nulls last; repeated ids by the hash of their texts), numbered, and written once, so that reruns of
    lost tasks see the same keys. Second: whether keys are ids.
    """
    more = [F.struct(*rest).alias("rest")] if rest is not None else []
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *more)
    if dict(own.dtypes)["id"] in ("bigint", "int", "smallint", "tinyint"):
        seen = own.agg(F.count(F.lit(1)).alias("n"), F.count("id").alias("some"), F.count_distinct("id").alias("distinct")).first()
        if seen.n == seen.some == seen.distinct:
            return own.select(F.col("id").cast("long").alias("key"), "*"), True
    order = [F.col("id").asc_nulls_last(), F.xxhash64("text").asc()]
    spread = own.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return freeze(spread.select(F.monotonically_increasing_id().alias("key"), "*"), "keyed"), False
