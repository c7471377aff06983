"""Running sums, places and quantiles within groups of any size.

A window over a few keys runs in as many tasks. Here the rows are dealt over ranges of key and order instead; each part
sums up by itself, and what came before it in its first key is carried over: one small row for each part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirespark.shared import freeze, partitions


def before(rows: DataFrame, by: list[str], order: list[Column], amount: Column, into: str) -> DataFrame:
    """rows with the sum of amount over the earlier rows of their key; `order` should be total, else ties fall anyhow.

    Null keys are a key like any other, null amounts count as 0. Rows are written once, so reruns see the same parts."""
    spread = rows.withColumn("_amount", F.coalesce(amount, F.lit(0)))
    spread = freeze(spread.repartitionByRange(partitions(rows.sparkSession), *by, *order).withColumn("_part", F.spark_partition_id()), "parts")
    inside = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = spread.groupBy(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), F.col("_part").alias("_p")).agg(F.sum("_amount").alias("_sum"))
    keys = [f"_k{i}" for i in range(len(by))]
    earlier = F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    # a part can only go on with the key in which the one before it ended, so these are fewer than the parts
    carried = freeze(sums.withColumn("_carried", earlier).where("_carried IS NOT NULL").drop("_sum"), "carried")
    meets = F.col("_part") == F.col("_p")
    for k, c in zip(keys, by, strict=True):
        meets = meets & F.col(c).eqNullSafe(F.col(k))
    own = spread.withColumn(into, F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
    whole = own.join(F.broadcast(carried), meets, "left").withColumn(into, F.col(into) + F.coalesce("_carried", F.lit(0)))
    return whole.drop("_amount", "_part", "_p", "_carried", *keys)


def numbered(rows: DataFrame, by: list[str], order: list[Column], into: str) -> DataFrame:
    """rows with their place in their key, from 0."""
    return before(rows, by, order, F.lit(1), into)


def counted(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value, n and before (how many smaller values the key has) of the distinct values of each key; nulls do not count."""
    distinct = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return before(distinct, by, [F.col(value)], F.col("n"), "before")


def quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """by, n (how many values are not null) and q, the quantiles at the shares, between neighbours in proportion. Values are
    counted before they are shuffled, and each group's places are looked up among its counted values."""
    own = freeze(counted(rows, by, value), "counted")
    total = own.groupBy(*by).agg(F.sum("n").alias("_n"))
    named = own
    for c in by:
        named = named.withColumnRenamed(c, f"_{c}")
    meets = F.lit(True)
    for c in by:
        meets = meets & F.col(c).eqNullSafe(F.col(f"_{c}"))
    both = named.join(freeze(total, "totals"), meets)  # small where groups are few, else no group is large
    at = lambda place: F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("n")), F.col(value).cast("double")))
    picks = []
    for s in shares:
        place = s * (F.col("_n") - 1)
        picks.append(F.struct(at(F.floor(place)).alias("low"), at(F.ceil(place)).alias("high")))
    found = both.groupBy(*by).agg(F.max("_n").alias("n"), *[p.alias(f"_q{i}") for i, p in enumerate(picks)])
    part = lambda i, s: F.col(f"_q{i}.low") + (F.col(f"_q{i}.high") - F.col(f"_q{i}.low")) * (s * (F.col("n") - 1) - F.floor(s * (F.col("n") - 1)))
    return found.select(*by, "n", F.array(*[part(i, s) for i, s in enumerate(shares)]).alias("q"))


def mean_ranks(rows: DataFrame, by: list[str], value: str, into: str) -> DataFrame:
    """rows with the rank of their value in their key, equal values sharing the mean of theirs; null for null values."""
    ranks = counted(rows, by, value).withColumn(into, F.col("before") + (F.col("n") + 1) / 2).drop("n", "before")
    meets = rows[value] == F.col("_v")
    for i, c in enumerate(by):
        ranks = ranks.withColumnRenamed(c, f"_k{i}")
        meets = meets & rows[c].eqNullSafe(F.col(f"_k{i}"))
    ranks = ranks.withColumnRenamed(value, "_v")
    return rows.join(ranks, meets, "left").drop("_v", *(f"_k{i}" for i in range(len(by))))
