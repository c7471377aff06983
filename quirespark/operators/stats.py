"""Measures of pauses, ranks and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirespark.operators import ordered

SHORT_MS = 100


def pacing_table(records: DataFrame, kind: str, pause: str, least: int = 15, least_long: int = 8) -> DataFrame:
    """For each kind of boundary: how many, the share of almost none, the median; of the others a log-normal fit."""
    long = F.when(F.col(pause) >= SHORT_MS, F.col(pause))
    n_long = F.count(long)
    fit = lambda c: F.when(n_long >= least_long, c)
    sums = records.groupBy(kind).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(pause) < SHORT_MS).cast("double")).alias("short_share"), fit(F.avg(F.log(long))).alias("mu"), fit(F.stddev_pop(F.log(long))).alias("sigma"), (n_long >= least_long).alias("fits"),
    ).where(F.col("n") >= least)
    middle = ordered.quantiles(records.select(kind, pause), [kind], pause, [0.5]).select(F.col(kind).alias("_a"), F.get("q", 0).alias("median_ms"))
    ends = ordered.quantiles(records.select(kind, long.alias("_long")), [kind], "_long", [0.03, 0.97]).select(F.col(kind).alias("_b"), F.col("q").alias("_q"))
    both = sums.join(middle, F.col(kind).eqNullSafe(F.col("_a")), "left").join(ends, F.col(kind).eqNullSafe(F.col("_b")), "left")
    edge = lambda i: F.when(F.col("fits"), F.get("_q", i))
    return both.select(kind, "n", "short_share", "median_ms", "mu", "sigma", edge(0).alias("lo_ms"), edge(1).alias("hi_ms"))


def regression(records: DataFrame, by: str, y: Column, x: Column, least: int = 100) -> DataFrame:
    """Least squares of y on x for each `by`: slope, intercept, t of the slope, n."""
    n, sxx = F.count(F.lit(1)), F.regr_sxx(F.col("_y"), F.col("_x"))
    s = records.withColumns({"_y": y, "_x": x}).where("_x IS NOT NULL AND _y IS NOT NULL").groupBy(by).agg(
        n.alias("n"), F.regr_slope(F.col("_y"), F.col("_x")).alias("slope"), F.regr_intercept(F.col("_y"), F.col("_x")).alias("intercept"), sxx.alias("_sxx"), F.regr_syy(F.col("_y"), F.col("_x")).alias("_syy"))
    resid = F.col("_syy") - F.col("slope") ** 2 * F.col("_sxx")
    t = F.col("slope") / F.sqrt(resid / (F.col("n") - 2) / F.col("_sxx"))
    return s.where(F.col("n") >= least).select(by, "n", "slope", "intercept", t.alias("t"))


def normal_equations(records: DataFrame, y: Column, features: list[Column]) -> DataFrame:
    """X'X and X'y as rows (i, j, value), j -1 for y, from one pass over the records; features include the constant."""
    xs = [F.lit(1.0), *features]
    named = records.select(*[x.cast("double").alias(f"x{i}") for i, x in enumerate(xs)], y.cast("double").alias("y"))
    sums = named.agg(*[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"c{i}_{j}") for i in range(len(xs)) for j in range(i, len(xs))], *[F.sum(F.col(f"x{i}") * F.col("y")).alias(f"y{i}") for i in range(len(xs))], F.sum(F.col("y") * F.col("y")).alias("yy"), F.count(F.lit(1)).alias("n"))
    return sums


def solve(sums: DataFrame, k: int) -> list[tuple[float, float]]:
    """Coefficients and t values from normal_equations with k columns (the constant among them)."""
    import numpy as np

    r = sums.first()
    xx = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    xy = np.array([r[f"y{i}"] for i in range(k)], float)
    beta = np.linalg.lstsq(xx, xy, rcond=None)[0]
    resid = r["yy"] - beta @ xy
    se = np.sqrt(np.maximum(np.diag(resid / (r["n"] - k) * np.linalg.pinv(xx)), 0))
    return [(float(b), float(b / s) if s else float("nan")) for b, s in zip(beta, se, strict=True)]


def spearman(records: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Rank correlation of x and y for each `by`; ties share the mean of their ranks."""
    ranked = ordered.mean_ranks(ordered.mean_ranks(records.select(by, x, y), [by], x, "_rx"), [by], y, "_ry")
    return ranked.groupBy(by).agg(F.corr("_rx", "_ry").alias("rho"), F.count(F.lit(1)).alias("n"))


def spread(records: DataFrame, by: str, value: str) -> DataFrame:
    """n, mean and the 10th, 25th, 50th, 75th and 90th percentile of each `by`."""
    p = ordered.quantiles(records.select(by, value), [by], value, [0.1, 0.25, 0.5, 0.75, 0.9]).select(F.col(by).alias("_by"), F.col("q").alias("p"))
    s = records.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).join(p, F.col(by).eqNullSafe(F.col("_by")), "left")
    return s.select(by, "n", "mean", *[F.get("p", i).alias(f"p{q}") for i, q in enumerate((10, 25, 50, 75, 90))])


def drawn_pause(key: Column, short_share: Column, mu: Column, sigma: Column, lo: Column, hi: Column) -> Column:
    """A pause drawn by a hash of its key, so that reruns agree: short ones even, others log-normal within two sigma and
    lo to hi. The sum of twelve even numbers stands for a normal one."""
    u = lambda k: F.pmod(F.xxhash64(key, F.lit(k)), F.lit(1 << 20)) / float(1 << 20)
    z = u(1)
    for k in range(2, 13):
        z = z + u(k)
    z = F.greatest(F.lit(-2.0), F.least(F.lit(2.0), z - 6))
    long = F.greatest(lo, F.least(hi, F.exp(mu + sigma * z)))
    return F.greatest(F.lit(40.0), F.when(u(0) < short_share, 20 + 80 * u(13)).otherwise(long))


def gender_of_pitch(frames: DataFrame, by: str, f0: str) -> DataFrame:
    """male below a median of 155, female above 175, else unknown; unknown below ten frames."""
    s = frames.groupBy(by).agg(F.count(f0).alias("n"), F.percentile(f0, F.lit(0.5)).alias("median"))
    return s.withColumn("gender", F.when(F.col("n") < 10, "unknown").when(F.col("median") < 155, "male").when(F.col("median") > 175, "female").otherwise("unknown"))


def cosine_to_centroid(vectors: DataFrame, by: str, id_col: str, vector: str) -> DataFrame:
    """Cosine of each vector to the mean of the normalised vectors of its `by`. A position's sums are small rows."""
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = vectors.withColumn("_u", F.transform(vector, lambda x: x.cast("double") / size(F.col(vector))))
    mean = unit.select(by, F.posexplode("_u").alias("i", "x")).groupBy(by, "i").agg(F.avg("x").alias("m"))
    centre = mean.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s.m).alias("_c"))
    dot = F.aggregate(F.zip_with("_u", "_c", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return unit.join(centre, by).select(id_col, by, (dot / size(F.col("_c"))).alias("cosine"))
