"""Recorded clips: their problems, attempts, corrections and leftovers; ordered updates of keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirespark.functions import text as T
from quirespark.operators import ordered

FAST, SLOW, LEAST_CHARS, DEAD_AIR, DASH_PAUSE, MOST_SILENT, LEAST_SECONDS = 1.6, 0.45, 25, 2.0, 1.5, 0.6, 1.5


def usual_pace(clips: DataFrame, by: str = "engine", least: int = 20) -> DataFrame:
    """The median pace of each engine over clips that are long enough, null where there are fewer than `least`."""
    ok = clips.where((F.col("chars") >= LEAST_CHARS) & (F.col("speech") > 0.5))
    middle = ordered.quantiles(ok.select(by, (F.col("chars") / F.col("speech")).alias("pace")), [by], "pace", [0.5])
    return middle.select(by, F.when(F.col("n") >= least, F.get("q", 0)).alias("median_pace"))


def problems(clips: DataFrame) -> DataFrame:
    """clips (text, chars, seconds, speech, longest_gap, silent_share, broken, median_pace) with their problems in order."""
    dashes = T.pauses_in(F.coalesce("text", F.lit("")))
    letters = F.char_length(F.regexp_replace("text", f"[^{T.LETTER}]", "")) / F.greatest(F.lit(1), F.char_length("text"))
    pace = F.col("chars") / F.col("speech")
    judged = F.col("median_pace").isNotNull() & (F.col("chars") >= LEAST_CHARS) & (F.col("speech") > 0) & (F.coalesce(letters, F.lit(1.0)) >= 0.5)
    found = F.array_compact(F.array(
        F.when(F.col("longest_gap") > DEAD_AIR + DASH_PAUSE * dashes, "dead air"),
        F.when((F.col("silent_share") > MOST_SILENT + F.when(dashes > 0, 0.2).otherwise(0.0)) & (F.col("seconds") >= LEAST_SECONDS), "mostly silence"),
        F.when(judged & (pace > FAST * F.col("median_pace")), "rushed").when(judged & (pace < SLOW * F.col("median_pace")), "drawn out"),
    ))
    return clips.withColumn("problems", F.when(F.col("broken").isNotNull(), F.array("broken")).otherwise(found))


def badness() -> Column:
    """How far a clip is from what is usual; 0 is ideal."""
    pace = 2 * F.abs(F.log((F.col("chars") / F.col("speech")) / F.col("median_pace")))
    judged = F.col("median_pace").isNotNull() & (F.col("chars") >= LEAST_CHARS) & (F.col("speech") > 0)
    base = F.greatest(F.lit(0.0), F.col("longest_gap") - 0.8) + 3 * F.greatest(F.lit(0.0), F.col("silent_share") - 0.3)
    return F.when(F.col("broken").isNotNull(), 1e9).otherwise(base + F.when(judged, pace).otherwise(0.0))


def best_attempts(attempts: DataFrame, clip: str, attempt: str) -> DataFrame:
    """For each clip the attempt of the least badness, ties to the earlier."""
    return attempts.withColumn("badness", badness()).groupBy(clip).agg(F.min_by(attempt, F.struct("badness", attempt)).alias("best"), F.min("badness").alias("badness"))


def take_due(takes: Column, bands: list[tuple[float, int]]) -> Column:
    """Whether some band (score, how many) has that many takes below its score."""
    below = lambda score: F.size(F.filter(takes, lambda t: t < score))
    due = F.lit(False)
    for score, need in bands:
        due = due | (below(score) >= need)
    return due


def take_summary(takes: DataFrame, name: str, order: str, score: str, good: float) -> DataFrame:
    """For each name: clips, the first and the median score, how many are below good."""
    return takes.groupBy(name).agg(
        F.count(F.lit(1)).alias("clips"), F.min_by(score, order).alias("first"), F.percentile(score, F.lit(0.5)).alias("median"), F.count_if(F.col(score) < good).alias("below_good"))


def adopted(scores: DataFrame, name: str, plain: str, score: str, good: float = 0.8, margin: float = 0.15) -> DataFrame:
    """The best spelling of each name if it is good enough and clearly above the plain one."""
    best = scores.groupBy(name).agg(F.max_by("spelling", F.struct(F.col(score), "spelling")).alias("spelling"), F.max(score).alias("score"), F.first(plain).alias("plain"))
    return best.withColumn("adopt", (F.col("score") >= good) & (F.col("score") >= F.col("plain") + margin))


def unused(files: DataFrame, planned: DataFrame, chapters: DataFrame, covered: DataFrame) -> DataFrame:
    """Files that no plan has; none at all unless the plan covers every chapter."""
    missing = chapters.join(covered, "chapter", "left_anti").agg((F.count(F.lit(1)) == 0).alias("whole"))
    return files.join(planned, "file", "left_anti").join(missing, F.col("whole")).drop("whole")


def search(rows: DataFrame, text: str, words: str) -> DataFrame:
    """Rows whose text holds all the words, whatever their case."""
    hay = F.lower(text)
    return rows.where(F.forall(F.split(F.lower(F.btrim(F.lit(words))), r"\s+"), lambda w: hay.contains(w)))


def first_source(sources: list[DataFrame], key: str, value: str) -> DataFrame:
    """For each key the value of the first source that has one, and which source it was."""
    every = None
    for i, s in enumerate(sources):
        one = s.select(key, F.col(value).alias("value"), F.lit(i).alias("source")).where(F.col(value).isNotNull())
        every = one if every is None else every.unionByName(one)
    return every.groupBy(key).agg(F.min_by(F.struct("value", "source"), F.struct("source", "value")).alias("v")).select(key, "v.value", "v.source")


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with the rows of new in place of those with the same key."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def three_way(current: DataFrame, snapshot: DataFrame, edited: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """current with cells of edited, but only those that were changed after the snapshot and differ from now."""
    c, s, e = current.alias("c"), snapshot.alias("s"), edited.alias("e")
    joined = c.join(s, key, "left").join(e, key, "left")
    write = {x: ~F.col(f"e.{x}").eqNullSafe(F.col(f"c.{x}")) & ~F.col(f"e.{x}").eqNullSafe(F.col(f"s.{x}")) & F.col(f"e.{x}").isNotNull() for x in columns}
    touched = None
    for w in write.values():
        touched = w if touched is None else touched | w
    return joined.select(key, *(F.when(w, F.col(f"e.{x}")).otherwise(F.col(f"c.{x}")).alias(x) for x, w in write.items()), F.when(touched, "user").otherwise(F.lit(None)).alias("edited_by"))


def pooled(rows: DataFrame, by: str, order: list, pools: dict[str, list[str]]) -> DataFrame:
    """Voices of each gender's pool dealt in turn, to the speakers with most lines first."""
    pool = F.create_map(*[x for k, v in pools.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    mine = F.element_at(pool, F.col(by))
    return ordered.numbered(rows, [by], order, "_n").withColumn("voice", F.get(mine, F.pmod("_n", F.size(mine)).cast("int"))).drop("_n")


def hash_pick(name: Column, pool: list[str]) -> Column:
    """One of 8 or 16 of a pool by the last digit of a name's md5: the same at every run."""
    digit = F.conv(F.right(F.md5(name), F.lit(1)), 16, 10).cast("int")
    return F.get(F.array(*map(F.lit, pool)), F.pmod(digit, F.lit(len(pool))))


def only_changed(wanted: DataFrame, cache: DataFrame, key: str, mark: str) -> DataFrame:
    """Rows that the cache has not, or has with another mark."""
    return wanted.join(cache.select(key, mark), [key, mark], "left_anti")


def differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that went (-) and came (+)."""
    return old.exceptAll(new).withColumn("sign", F.lit("-")).unionByName(new.exceptAll(old).withColumn("sign", F.lit("+")))
