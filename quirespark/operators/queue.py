"""Writes to the queue of jobs as updates of tables: new jobs, patches, guards, what commands do, how runs are recorded.

Ids are unique; where they are not, all rows of an id change alike. Null patches change nothing. A queue (`by`) is short: its
windows are of one queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WAITING = ("queued", "held", "paused")
ACTIVE = ("queued", "running", "paused")
_CLOCK = "([01][0-9]|2[0-3]):[0-5][0-9]"


def refusal(prepared: Column, not_before: Column, window: Column) -> Column:
    """Why a new job is not taken, or null. Empty times mean none."""
    time, span = F.coalesce(not_before, F.lit("")), F.coalesce(window, F.lit(""))
    bad_time = (time != "") & F.try_to_timestamp(time, F.lit("yyyy-MM-dd HH:mm")).isNull()
    return (
        F.when(~F.coalesce(prepared, F.lit(False)), "not prepared").when(bad_time, "no such time")
        .when((span != "") & ~span.rlike(f"^{_CLOCK}-{_CLOCK}$"), "no such window")
    )


def added(jobs: DataFrame, new: DataFrame, created: str) -> DataFrame:
    """jobs (id, work, title, not_before, window, status, created) and the new ones that are not refused, with defaults."""
    ok = new.where(refusal(F.col("prepared"), F.col("not_before"), F.col("window")).isNull())
    name = F.regexp_extract("work", "([^/]+)/*$", 1)
    rows = ok.select("id", "work", F.coalesce(F.nullif(F.col("title"), F.lit("")), name).alias("title"), "not_before", "window", F.lit("queued").alias("status"), F.lit(created).alias("created"))
    return jobs.select(*rows.columns).unionByName(rows)


def patched(jobs: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """jobs with what changes say that is not null."""
    c = changes.select(key, *[F.col(x).alias(f"_{x}") for x in columns])
    return jobs.join(c, key, "left").select(*[F.coalesce(f"_{x}", x).alias(x) if x in columns else F.col(x) for x in jobs.columns])


def waiting_for(jobs: DataFrame, work: str, status: str, newest: list[str]) -> DataFrame:
    """The newest waiting job of each book that has one."""
    waits = jobs.where(F.col(status).isin(*WAITING))
    return waits.groupBy(work).agg(F.max_by(F.struct(*waits.columns), F.struct(*newest)).alias("j")).select("j.*")


def started_now(jobs: DataFrame, by: str, order: str, commands: DataFrame) -> DataFrame:
    """jobs after `now n` in the queues that commands (by, number) name: the n-th of those active or held goes first, waits
    for nothing and is queued; running ones are to step aside. A number that does not exist, or a job that runs, changes
    nothing. Adds preempt and the new position, `pos`."""
    listed = F.col("status").isin(*ACTIVE, "held")
    numbered = jobs.withColumn("_n", F.when(listed, F.row_number().over(Window.partitionBy(by, listed).orderBy(order)))).join(commands, by, "left")
    hit = F.coalesce((F.col("_n") == F.col("number")) & (F.col("status") != "running"), F.lit(False))
    queue = Window.partitionBy(by)
    out = numbered.withColumn("_hit", hit).withColumn("_any", F.max("_hit").over(queue))
    out = out.withColumn("preempt", F.col("_any") & (F.col("status") == "running"))
    out = out.withColumn("status", F.when(F.col("_hit"), "queued").otherwise(F.col("status")))
    out = out.withColumn("not_before", F.when(~F.col("_hit"), F.col("not_before"))).withColumn("window", F.when(F.col("_hit"), "").otherwise(F.col("window")))
    return out.withColumn("pos", F.row_number().over(queue.orderBy(F.desc("_hit"), order))).drop("_n", "_hit", "_any", "number")


def stopped(jobs: DataFrame, by: str, commands: DataFrame) -> DataFrame:
    """jobs after `stop` in some queues: what runs there is held, with its progress in per cent in `stopped_at`."""
    c = commands.select(by).distinct().withColumn("_stop", F.lit(True))
    done, total = (F.try_element_at(F.split("progress", "/"), F.lit(k)).try_cast("double") for k in (1, 2))
    hit = F.coalesce("_stop", F.lit(False)) & (F.col("status") == "running")
    out = jobs.join(c, by, "left").withColumn("stopped_at", F.when(hit, F.coalesce(F.when(total > 0, F.floor(100 * done / total)), F.lit(0)).cast("int")))
    return out.withColumn("status", F.when(hit, "held").otherwise(F.col("status"))).drop("_stop")


def refused_edits(edits: DataFrame, jobs: DataFrame, work: str) -> DataFrame:
    """edits of books that are being made right now, with the title of the job that makes them."""
    running = jobs.where(F.col("status") == "running").groupBy(work).agg(F.min("title").alias("made_as"))
    return edits.join(running, work)


def recorded(runs: DataFrame, key: list[str], newest: list[str], keep: int = 300) -> DataFrame:
    """The last record of each key, and of those the newest `keep` (what a history keeps). Runs without characters or
    seconds are not recorded."""
    real = runs.where((F.col("chars") > 0) & (F.col("seconds") > 0))
    last = real.groupBy(*key).agg(F.max_by(F.struct(*runs.columns), F.struct(*newest)).alias("r")).select("r.*")
    return last.orderBy(*[F.desc(c) for c in newest], *key).limit(keep)


def without_cached(runs: DataFrame, factor: float = 1.5, least_s: float = 20.0) -> DataFrame:
    """runs (id, kind, engine, chars, seconds) without whole books that were faster than `factor` times their engine's speed
    of speech: they used clips made before. There is a row of speed for each engine, which goes to the runs where they are."""
    speech = runs.where((F.coalesce("kind", F.lit("")) != "job") & (F.col("seconds") >= least_s)).groupBy("engine").agg((F.sum("chars") / F.sum("seconds")).alias("_cps"))
    fast = (F.col("kind") == "job") & (F.col("chars") / F.greatest(F.col("seconds"), F.lit(1.0)) > factor * F.col("_cps"))
    return runs.join(F.broadcast(speech), "engine", "left").where(~F.coalesce(fast, F.lit(False))).drop("_cps")


def fresh_chars(runs: DataFrame, since: DataFrame) -> DataFrame:
    """book, engine and fresh: the characters that runs with an id of book-stamp made since a time (since: book, since)."""
    stem, stamp = F.regexp_extract("id", "^(.*)-([0-9]+)$", 1), F.regexp_extract("id", "^(.*)-([0-9]+)$", 2)
    r = runs.where(F.coalesce("kind", F.lit("")) != "job").select(stem.alias("book"), stamp.try_cast("long").alias("_at"), "engine", "chars").where("_at IS NOT NULL")
    return r.join(since, "book").where(F.col("_at") >= F.col("since")).groupBy("book", "engine").agg(F.sum("chars").alias("fresh"))


def learnt_chars(lines: DataFrame, fresh: DataFrame) -> DataFrame:
    """book, engine and chars that a finished book teaches: its characters, but no more than were made fresh."""
    n = lines.groupBy("book", "engine").agg(F.sum(F.char_length("text")).alias("n"))
    return n.join(fresh, ["book", "engine"], "left").select("book", "engine", F.least("n", F.coalesce("fresh", F.lit(0))).alias("chars"))


def active_seconds(jobs: DataFrame, ticks: DataFrame, key: str) -> DataFrame:
    """jobs with the time their stages ran added to `active`; negative ticks count nothing."""
    t = ticks.groupBy(key).agg(F.sum(F.greatest(F.col("seconds"), F.lit(0.0))).alias("_s"))
    return jobs.join(t, key, "left").withColumn("active", F.round(F.coalesce("active", F.lit(0.0)) + F.coalesce("_s", F.lit(0.0)), 1)).drop("_s")


def voices_for(voices: DataFrame, engine: str, gender: str | None) -> DataFrame:
    """The voices of an engine, those of the wanted gender first, then by name."""
    return voices.where(F.col("engine") == engine).orderBy((F.coalesce(F.col("gender") == gender, F.lit(False)) if gender else F.lit(False)).desc(), "name")
