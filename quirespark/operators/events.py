"""Events and jobs: windows of time, gaps, streaks, rates, queues."""

from __future__ import annotations

from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_window(ts: Column, window: Column) -> Column:
    """Whether the time of day lies in HH:MM-HH:MM, which may wrap past midnight."""
    at = F.hour(ts) * 60 + F.minute(ts)
    clock = lambda k: F.substring(window, k, 2).cast("int") * 60 + F.substring(window, k + 3, 2).cast("int")
    start, stop = clock(1), clock(7)
    return F.when(start <= stop, (at >= start) & (at < stop)).otherwise((at >= start) | (at < stop))


def next_opening(ts: Column, window: Column) -> Column:
    """ts itself inside its daily window, else when that opens next."""
    opens = F.to_timestamp_ntz(F.concat(F.date_format(ts, "yyyy-MM-dd"), F.lit(" "), F.substring(window, 1, 5), F.lit(":00")))
    return F.when(in_window(ts, window), ts).when(opens >= ts, opens).otherwise(opens + F.expr("INTERVAL 1 DAY"))


def gaps(events: DataFrame, by: str, ts: str, least_s: int) -> DataFrame:
    """Pauses of more than least_s seconds between events of each `by`."""
    until = F.lead(ts).over(Window.partitionBy(by).orderBy(ts, "event_id"))
    seconds = F.unix_seconds(until.cast("timestamp")) - F.unix_seconds(F.col(ts).cast("timestamp"))
    return events.withColumn("gap_s", seconds).where(F.col("gap_s") > least_s)


def streaks(events: DataFrame, by: str, order: list[str], bad: Column, halt: int) -> DataFrame:
    """For each `by` the longest run of bad events, and whether it reached halt."""
    w = Window.partitionBy(by).orderBy(*order)
    marked = events.withColumn("_bad", bad.cast("int")).withColumn("_run", F.sum(1 - F.col("_bad")).over(w))
    runs = marked.groupBy(by, "_run").agg(F.sum("_bad").alias("n")).groupBy(by).agg(F.max("n").alias("longest"))
    return runs.select(by, "longest", (F.col("longest") >= halt).alias("halted"))


def trailing_pace(events: DataFrame, by: str, ts: str, minutes: int, least_peak: int, share: float) -> DataFrame:
    """Events in the last minutes at each event, the highest such count so far, and whether the pace fell below share of it.

    Events are counted by key and second, and each count comes again, taken away, when it is no longer among the last
    minutes: a running sum, whose work does not grow with how many events a moment has. Seconds are dealt over stretches,
    four times as long as what is counted; the end of a stretch is also seen by the next one, and the highest count so far
    is carried from stretch to stretch, in one small row for each."""
    span = minutes * 60
    own = events.withColumn("_s", F.col(ts).cast("timestamp").cast("double").cast("long"))
    counted = own.groupBy(F.col(by).alias("_k"), F.col("_s").alias("_t")).agg(F.count(F.lit(1)).alias("_n")).withColumns({"_b": F.floor(F.col("_t") / (4 * span)), "_seen": F.lit(False)})
    tail = counted.where(F.pmod("_t", F.lit(4 * span)) > 3 * span).withColumns({"_b": F.col("_b") + 1, "_seen": F.lit(True)})
    come = counted.unionByName(tail)
    gone = come.withColumns({"_t": F.col("_t") + span, "_n": -F.col("_n"), "_seen": F.lit(True)})
    so_far = Window.partitionBy("_k", "_b").orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)
    n = come.unionByName(gone).withColumn("n", F.sum("_n").over(so_far)).where("NOT _seen").withColumn("peak", F.max("n").over(so_far))
    tops = n.groupBy(F.col("_k").alias("_k2"), F.col("_b").alias("_c")).agg(F.max("n").alias("_top"))
    earlier = F.max("_top").over(Window.partitionBy("_k2").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1))
    n = n.join(tops.select("_k2", "_c", earlier.alias("_top")), F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("_b") == F.col("_c")), "left")
    n = n.select("_k", "_t", "n", F.greatest("peak", "_top").alias("peak"))
    found = own.join(n, F.col(by).eqNullSafe(F.col("_k")) & F.col("_s").eqNullSafe(F.col("_t")), "left")
    return found.withColumn("slow", (F.col("peak") >= least_peak) & (F.col("n") < share * F.col("peak"))).drop("_s", "_k", "_t")


def rates(runs: DataFrame, engine: str, chars: str, seconds: str, whole: Column, least_s: float) -> DataFrame:
    """Characters a second of each engine as a ratio of sums; runs of whole books replace others where there are any."""
    ok = F.col(seconds) >= least_s
    ratio = lambda when: F.sum(F.when(when, F.col(chars))) / F.sum(F.when(when, F.col(seconds)))
    out = runs.groupBy(engine).agg(ratio(ok & whole).alias("_w"), ratio(ok & ~whole).alias("_s"), F.count_if(ok).alias("n_runs"))
    return out.select(engine, F.coalesce("_w", "_s").alias("rate"), F.col("_w").isNotNull().alias("whole"), "n_runs")


def newest_each(rows: DataFrame, by: str, order: list[Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") == 1).drop("_n")


def moved_to_top(jobs: DataFrame, queue: str, chosen: Column, position: str) -> DataFrame:
    """New positions with the chosen jobs first, both parts in their old order."""
    return jobs.withColumn("new_pos", F.row_number().over(Window.partitionBy(queue).orderBy(F.desc(chosen.cast("int")), position)))


def moved(jobs: DataFrame, queue: str, chosen: Column, position: str, where: str) -> DataFrame:
    """jobs with new_pos (from 1) after the chosen ones went to the top or the bottom, or one place up or down, keeping their
    order. Chosen jobs that stand together move over one neighbour as a whole; where there is none they stay."""
    if where not in ("top", "bottom", "up", "down"):
        raise ValueError(f"no place {where}")
    line, mark = Window.partitionBy(queue), F.coalesce(chosen, F.lit(False))
    if where in ("top", "bottom"):
        first = F.desc("_chosen") if where == "top" else F.asc("_chosen")
        return jobs.withColumn("_chosen", mark).withColumn("new_pos", F.row_number().over(line.orderBy(first, position))).drop("_chosen")
    step = -1 if where == "up" else 1
    rows = jobs.withColumns({"_chosen": mark, "_at": F.row_number().over(line.orderBy(position))})
    # a job that is not chosen, with the chosen ones that stand right behind it (or before it, on the way down)
    rows = rows.withColumn("_g", F.sum((~F.col("_chosen")).cast("int")).over(line.orderBy(F.asc("_at") if where == "up" else F.desc("_at"))))
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(queue, "_g")) - 1)
    new = F.when(~F.col("_chosen"), F.col("_at") - step * F.col("_n")).otherwise(F.col("_at") + F.when(F.col("_g") > 0, step).otherwise(0))
    return rows.withColumn("new_pos", new.cast("int")).drop("_chosen", "_at", "_g", "_n")


def finish_times(jobs: DataFrame, queue: str, position: str, seconds: str) -> DataFrame:
    """When jobs of a queue end that run one after another."""
    done = F.sum(seconds).over(Window.partitionBy(queue).orderBy(position).rowsBetween(Window.unboundedPreceding, 0))
    return jobs.withColumn("eta_s", done)


def finish_in_windows(jobs: DataFrame, queue: str, now: datetime, step_min: int = 5, most_days: int = 60) -> DataFrame:
    """queue, id and done_at for jobs (pos, seconds, window) that run in turn, each only within its daily window. The
    clock of one job starts where the last one stopped, so each queue is a fold; queues are independent."""

    def open_at(at: datetime, window: str) -> bool:
        if not window:
            return True
        m, (a, b) = at.hour * 60 + at.minute, [int(x[:2]) * 60 + int(x[3:]) for x in window.split("-")]
        return a <= m < b if a <= b else m >= a or m < b

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        at, out = now, []
        for job in rows.sort_values("pos").itertuples():
            left, end, step = float(job.seconds), at + timedelta(days=most_days), timedelta(minutes=step_min)
            while left > 0 and at < end:
                if open_at(at, job.window or ""):
                    used = min(left, step.total_seconds())
                    left -= used
                    at += timedelta(seconds=used)
                else:
                    at += step
            out.append((key[0], job.id, at if left <= 0 else None))
        return pd.DataFrame(out, columns=["queue", "id", "done_at"])

    own = jobs.select(F.col(queue).alias("queue"), "id", "pos", "seconds", "window")
    return own.groupBy("queue").applyInPandas(run, f"queue {dict(own.dtypes)['queue']}, id {dict(own.dtypes)['id']}, done_at timestamp_ntz")


def split_seconds(runs: DataFrame, rates_: DataFrame, engine: str, default: float = 20.0) -> DataFrame:
    """Seconds of a run shared between its engines by characters over their rate."""
    weighed = runs.join(rates_, engine, "left").withColumn("_w", F.col("chars") / F.coalesce("rate", F.lit(default)))
    return weighed.withColumn("share_s", F.col("seconds") * F.col("_w") / F.sum("_w").over(Window.partitionBy("run"))).drop("_w", "rate")


def latest_valid(events: DataFrame, key: str, ts: str, now: Column, ttl_s: int) -> DataFrame:
    """The last event of each key, and whether it still holds: a lease that runs out ttl_s seconds after it."""
    last = events.groupBy(key).agg(F.max(ts).alias("last"))
    return last.withColumn("held", F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("last").cast("timestamp")) < ttl_s)


def greedy_marks(rows: DataFrame, by: str, order: str, seconds: str, least_s: float) -> DataFrame:
    """rows with mark: true where at least least_s seconds have passed since the last mark (never the first row). The
    clock restarts at every mark, so each `by` is folded by aggregate()."""
    start = F.sum(seconds).over(Window.partitionBy(by).orderBy(order)) - F.col(seconds)
    listed = rows.withColumn("_clock", start).groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_clock").alias("clock")))).alias("l"))
    kind = dict(rows.dtypes)[order]
    empty = F.struct(F.array().cast(f"array<{kind}>").alias("marks"), F.lit(0.0).alias("since"))

    def step(s: Column, x: Column) -> Column:
        due = x.clock - s.since >= least_s
        return F.struct(F.when(due, F.array_append(s.marks, x.o)).otherwise(s.marks).alias("marks"), F.when(due, x.clock).otherwise(s.since).cast("double").alias("since"))

    return listed.select(by, F.aggregate("l", empty, step, lambda s: s.marks).alias("marks"))



def bridges(chapters: DataFrame, by: str, order: str, seconds: str, interval_s: float, choices: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """by and order of the chapters that begin with music: those that `greedy_marks` recommends, or, for a book that has a
    list of its own (`own`: by, order), that list; then the chapters that `choices` (by, order, turned: on or off) turns on
    are added and those that it turns off are taken away. The first chapter of a book never has any. A choice or entry for a
    chapter that there is not is kept, as it may yet come."""
    marks = greedy_marks(chapters, by, order, seconds, interval_s).select(by, F.explode("marks").alias(order))
    if own is not None:
        marks = marks.join(own.select(by).distinct(), by, "left_anti").unionByName(own.select(by, order))
    on, off = (choices.where(F.col("turned") == t).select(by, order) for t in ("on", "off"))
    first = chapters.groupBy(by).agg(F.min(order).alias(order))
    return marks.unionByName(on).distinct().join(off, [by, order], "left_anti").join(first, [by, order], "left_anti")
