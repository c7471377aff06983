"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirespark.llm.order import ranked
from quirespark.llm.rows import keyed, whole_rows
from quirespark.shared import freeze, table


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _no_null(source: Column) -> Column:
    return F.when(source.isNull(), "-").otherwise(F.concat(F.lit("+"), source.cast("string")))


def source_targets(sizes: DataFrame, weights: Sequence[int], max_epochs: int, share: float) -> DataFrame:
    """Columns sk, source_size, target. sizes: sk, source, size. Each round sends two sums to the driver."""
    totals = sizes.groupBy("sk", "source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").isNull().asc(), F.col("source").asc()]
    weight = F.element_at(F.lit(list(weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    t = ranked(totals, order, "sources").select("sk", "source_size", weight.cast("double").alias("w"), (F.col("source_size") * max_epochs).cast("double").alias("cap"))
    whole = (t.agg(F.sum("source_size")).first()[0] or 0) * share
    num, den, clamped = 0.0, 1.0, -1
    while True:
        full = F.col("w") * num / den > F.col("cap")
        s = t.agg(F.sum(full.cast("long")).alias("n"), F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("cap"), F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("w")).first()
        if not s.w or s.n == clamped:
            break
        clamped, num, den = s.n, max(whole - s.cap, 0.0), s.w
    return freeze(t.select("sk", "source_size", F.least("cap", F.col("w") * num / den).alias("target")), "targets")


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3, share: float = 1.0, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """How often the mix takes each document. Returns the id, size, source_size, target and taken (words).

    The size of a document is its number of words (runs of other characters than space and \\x09-\\x0D). Sources in
    the order of their code points, null last, have the weights in turn and divide share of all sizes between them.
    No target exceeds max_epochs times its source's size; what is cut off goes to the others by weight. A target of
    f whole sizes and a rest r takes each document f times, and once more those that come first by a seeded hash,
    until r is met as nearly as whole documents allow.

    Null and empty texts have size 0 and add nothing, and a source of such texts has target 0. Rows that repeat an
    id, or have none, are further documents. An empty table gives an empty result. Further columns are ignored. The
    hash is of the id and the seed, so reruns agree.
    """
    own = keyed(docs.withColumn(text_col, F.struct(F.col(text_col).alias("t"), F.col(source_col).alias("s"))), id_col, text_col)
    picked = _picked(own.select("key", "id", F.col("text.t").alias("text"), F.col("text.s").alias("source")), weights, max_epochs, share, seed)
    return picked.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def mixture(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3, share: float = 1.0, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself: each row of docs as often as mix_sources takes it."""
    own = whole_rows(docs, id_col, text_col)
    picked = _picked(own.select("key", "id", "text", F.col("rest")[source_col].alias("source")), weights, max_epochs, share, seed)
    often = own.join(picked.where("repeats > 0").select("key", "repeats"), "key")
    often = often.withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
    return often.select(*(F.col("text").alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in docs.columns))


def _picked(own: DataFrame, weights: Sequence[int], max_epochs: int, share: float, seed: int) -> DataFrame:
    """key, id, size, source_size, target and repeats for own: key, id, text, source."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string"))), 1, 8), 16, 10).cast("long")
    sizes = freeze(own.select("key", "id", "source", _no_null(F.col("source")).alias("sk"), word_count(F.col("text")).alias("size"), u.alias("u")), "sizes")
    sizes = sizes.withColumn("b", F.shiftright("u", 20))  # 4096 parts of a source, of which one holds the edge
    targets = source_targets(sizes, weights, max_epochs, share)
    times = F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0)).cast("long")
    targets = targets.withColumn("times", times).withColumn("rest", F.col("target") - F.col("times") * F.col("source_size"))
    parts = sizes.groupBy("sk", "b").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("sk").orderBy("b")) - F.col("n")
    edges = parts.withColumn("before", before).join(targets.select("sk", "rest"), "sk").where("before <= rest AND rest < before + n")
    plan = freeze(targets.join(edges.select("sk", "b", "before").withColumnRenamed("b", "edge"), "sk", "left"), "mix-plan")
    inside = F.sum("size").over(Window.partitionBy("sk", "b").orderBy("u", "key")) - F.col("size")
    picked = sizes.withColumn("inside", inside).join(plan, "sk")
    more = (F.col("b") < F.col("edge")) | ((F.col("b") == F.col("edge")) & (F.col("before") + F.col("inside") + F.col("size") / 2 <= F.col("rest")))
    return picked.select("key", "id", "size", "source_size", "target", (F.col("times") + F.coalesce(more, F.lit(False)).cast("long")).alias("repeats"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), weights=(5, 2, 1), max_epochs=3)


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('17:' || doc_id) AS m FROM documents),
u AS (SELECT *, list_sum(list_transform(range(1, 9), lambda i: (strpos('0123456789abcdef', substr(m, i, 1)) - 1) * (1::BIGINT << (4 * (8 - i)))))::BIGINT AS u FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3)]::DOUBLE AS w, (3 * source_size)::DOUBLE AS cap FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER a, 0) AS caps, sum(w) OVER b AS ws, (SELECT sum(source_size) FROM s)::DOUBLE AS total FROM w
  WINDOW a AS (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), b AS (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT arg_min(greatest(total - caps, 0), caps) AS num, arg_min(ws, caps) AS den FROM o WHERE w * greatest(total - caps, 0) / ws <= cap),
t AS (SELECT source, source_size, least(cap, w * num / den) AS target FROM w, l),
r AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS times FROM t),
c AS (SELECT u.*, sum(size) OVER (PARTITION BY source ORDER BY u, doc_id) - size AS before FROM u)
SELECT doc_id, size, source_size, target,
  (size * (times + CASE WHEN before + size / 2.0 <= target - times * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c JOIN r ON c.source IS NOT DISTINCT FROM r.source
"""
